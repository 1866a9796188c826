"""A text model's answers by rules: one for each task's title, from the data alone."""

from __future__ import annotations

import collections
import json
import re


def _data(text: str) -> dict:
    try:
        found = json.loads(text)
    except ValueError:
        return {"text": text}
    return found if isinstance(found, dict) else {"items": found}


def _common(texts: list[str]) -> list[str]:
    """Words that most of the texts have, the most common first."""
    counts = collections.Counter(w for t in texts for w in dict.fromkeys(re.findall(r"\w+", str(t).lower())))
    return [w for w, n in counts.most_common(6) if n > len(texts) / 2]


def _cluster(d: dict) -> dict:
    words = _common(d.get("items", []))
    return {
        "description": f"{len(d.get('items', []))} texts about {' '.join(words[:3]) or 'different things'}",
        "in_common": f"the words {', '.join(words)}" if words else "nothing"
    }


def _note(d: dict) -> dict:
    words = re.findall(r"\w+", str(d.get("output", "")))
    return {"note": "short" if len(words) < 6 else "long" if len(words) > 60 else f"about {words[0].lower()}"}


def _taxonomy(d: dict) -> dict:
    kinds = collections.Counter(str(n.get("note", "")) for n in d.get("notes", []))
    return {"labels": [{"label": k, "definition": f"outputs noted as {k}"} for k, _ in kinds.most_common(5)]}


def _label(d: dict) -> dict:
    labels = list(d.get("labels", {}))
    note = _note(d)["note"]
    return {"label": note if note in labels else labels[0] if labels else ""}


def _hypothesis(d: dict) -> dict:
    best = (d.get("causes") or [{"kind": "nothing", "target": ""}])[0]
    return {"hypothesis": f"The outputs follow the {best['kind'].replace('_', ' ')} {best['target']}."}


def _variants(d: dict) -> dict:
    section = str(d.get("section", ""))
    return {"variants": [f"{section} (in other words, {i + 1})" for i in range(int(d.get("number", 1)))]}


TASKS = {"cluster_description": _cluster, "trace_note": _note, "taxonomy": _taxonomy, "label": _label, "hypothesis": _hypothesis, "section_variants": _variants}


def answer(title: str, text: str) -> dict:
    return TASKS[title](_data(text)) if title in TASKS else {}
