"""Reports of findings: text, JSON, and one HTML file with the evidence's traces."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterable, Sequence
from html import escape

from spanloom.findings import Finding

STYLE = "body{font:15px/1.5 sans-serif;max-width:70em;margin:2em auto}table{border-collapse:collapse}td,th{padding:.2em .8em;border-bottom:1px solid #ccc;text-align:left;vertical-align:top}pre{white-space:pre-wrap}"


def as_dict(f: Finding) -> dict:
    return dataclasses.asdict(f) | {"key": f.key, "impact": f.impact, "title": f.title}


def as_text(findings: Sequence[Finding], notes: Sequence[str] = ()) -> str:
    lines = []
    for f in findings:
        lines.append(f"{f.id:>6}  {f.severity:<6} {f.impact:5.2f}  {f.title} ({f.affected} of {f.total}) [{f.status}]")
        if f.cause:
            lines.append(f"        cause: {f.cause['kind']} {f.cause['target']} ({f.cause['status']})")
        if f.fix:
            lines.append(f"        fix: {f.fix['description']}")
    return "\n".join([*(lines or ["no findings"]), *(f"note: {n}" for n in notes)])


def as_json(findings: Sequence[Finding], notes: Sequence[str] = ()) -> str:
    return json.dumps({"findings": [as_dict(f) for f in findings], "notes": list(notes)}, default=str, indent=1)


def as_html(findings: Sequence[Finding], notes: Sequence[str] = (), traces: Iterable[dict] = (), samples: dict[str, list[str]] | None = None) -> str:
    """``traces``: rows trace_id, span_id, depth, name, start_time, status, duration_ms in order; ``samples``: texts by cluster id."""
    traces, samples = list(traces), samples or {}
    trace_of = {r["span_id"]: r["trace_id"] for r in traces}
    parts = [f"<!doctype html><meta charset=utf-8><title>Findings</title><style>{STYLE}</style><h1>Findings</h1>"]
    for f in findings:
        links = " ".join(f'<a href="#t-{escape(trace_of[s])}">{escape(s)}</a>' if s in trace_of else escape(s) for s in f.evidence)
        rows = [
            ("category", f.category), ("severity", f.severity), ("impact", f"{f.impact:.2f}"),
            ("affected", f"{f.affected} of {f.total}"), ("seen", f"{f.first_seen} to {f.last_seen}"), ("status", f.status)
        ]
        rows += [("cause", f"{f.cause['kind']} {f.cause['target']}: {f.cause.get('hypothesis', '')} ({f.cause['status']})")] if f.cause else []
        rows += [("fix", f.fix["description"])] if f.fix else []
        table = "".join(f"<tr><th>{escape(k)}<td>{escape(str(v))}" for k, v in rows)
        more = "".join(f"<tr><th>{escape(k)}<td><pre>{escape(json.dumps(v, default=str) if not isinstance(v, str) else v)}</pre>" for k, v in f.details.items())
        texts = "".join(f"<li><pre>{escape(t)}</pre>" for t in samples.get(str(f.details.get("cluster_id")), []))
        diff = f"<pre>{escape(f.fix['diff'])}</pre>" if f.fix and f.fix.get("diff") else ""
        parts.append(
            f"<section id={escape(f.id)}><h2>{escape(f.id)} {escape(f.title)}</h2><table>{table}{more}</table>{diff}<p>evidence: {links}</p>{'<ul>' + texts + '</ul>' if texts else ''}</section>"
        )
    trace = None
    for r in traces:
        if r["trace_id"] != trace:
            parts.append(("</table>" if trace else "") + f"<h3 id='t-{escape(r['trace_id'])}'>Trace {escape(r['trace_id'])}</h3><table>")
            trace = r["trace_id"]
        indent = "&nbsp;" * 4 * int(r["depth"] or 0)
        parts.append(f"<tr><td>{indent}{escape(r['name'])}<td>{escape(str(r['start_time']))}<td>{escape(str(r['status']))}<td>{escape(str(r['duration_ms']))}")
    parts.append("</table>" if trace else "")
    return "".join([*parts, *(f"<p>note: {escape(n)}" for n in notes)])


FORMATS = {"text": as_text, "json": as_json, "html": as_html}
