"""Command line: ingest, analyze, review, label, explain, test, report, findings, set-status, query.

Exit codes: 0, 1 for an error of the library, 2 for wrong arguments. Models are named by ``MODULE:ATTRIBUTE[:ARGUMENT]``.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import SparkSession

from spanloom import reports
from spanloom.errors import SpanloomError
from spanloom.models.review import Console
from spanloom.workspace import STAGES, Workspace

PORTS = ("embedder", "llm", "replayer")


def port(text: str | None) -> Any:
    """The object that ``MODULE:ATTRIBUTE[:ARGUMENT]`` names; a class or function is called, with the argument if there is one."""
    if not text:
        return None
    module, _, rest = text.partition(":")
    name, _, argument = rest.partition(":")
    try:
        found = importlib.import_module(module)
        for part in name.split("."):
            found = getattr(found, part)
    except (ImportError, AttributeError) as error:
        raise SpanloomError(f"no {text!r}: {error}") from error
    return found(*([argument] if argument else [])) if callable(found) else found


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="spanloom")
    out.add_argument("workspace")
    for p in PORTS:
        out.add_argument(f"--{p}", metavar="MODULE:NAME")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple[str, dict]) -> None:
        sub = commands.add_parser(name)
        for flag, options in arguments:
            sub.add_argument(flag, **options)

    workflow, budget = ("--workflow", {}), ("--budget", {})
    command("ingest", ("sources", {"nargs": "+"}), ("--since", {}))
    command("analyze", workflow, ("--since", {}), ("--stages", {"default": ",".join(STAGES)}), budget)
    command("findings", ("--status", {}))
    command("report", workflow, ("--kind", {"default": "text", "choices": sorted(reports.FORMATS)}), ("--out", {}))
    command("set-status", ("finding", {}), ("status", {}), ("--note", {"default": ""}))
    command("explain", ("finding", {}))
    command("test", ("finding", {}), ("--variants", {"type": int, "default": 2}), ("--samples", {"type": int, "default": 20}), budget)
    command("review", workflow, ("--n", {"type": int, "default": 20}), budget)
    command("label", workflow, budget, ("--force", {"action": "store_true"}), ("--yes", {"action": "store_true"}))
    command("query", ("sql", {}))
    return out


def _confirm(io: Console) -> Callable[[int, int], bool]:
    return lambda n, tokens: io.ask(f"label {n} outputs, about {tokens} tokens?", ("yes", "no")).lower().startswith("y")


def run(args: argparse.Namespace, ws: Workspace, io: Any) -> str:
    name = args.command
    if name == "ingest":
        ws.ingest(*args.sources, since=args.since)
        return "\n".join(f"{i.source}: {i.added} new spans" for i in ws.ingested)
    if name == "analyze":
        found = ws.analyze(args.workflow, since=args.since, stages=[s for s in args.stages.split(",") if s], budget=args.budget)
        return reports.as_text(found, found.notes)
    if name == "findings":
        return reports.as_text(ws.findings(args.status))
    if name == "report":
        return ws.report(args.kind, args.workflow, args.out)
    if name == "set-status":
        return reports.as_text([ws.set_status(args.finding, args.status, args.note)])
    if name == "explain":
        return reports.as_text([ws.explain(args.finding)])
    if name == "test":
        f = ws.test(args.finding, variants=args.variants, samples=args.samples, budget=args.budget)
        return f"{reports.as_text([f])}\n{f.test['metric']}: {f.test['before']} to {f.test['after']} ({f.test['status']}, {f.test['best'] or 'no variant'})"
    if name == "review":
        done = ws.review(args.workflow, io, n=args.n, budget=args.budget)
        return "\n".join(f"{k}: {v}" for k, v in done.labels.items())
    if name == "label":
        done = ws.label_all(args.workflow, budget=args.budget, confirm=None if args.yes else _confirm(io), force=args.force)
        return "\n".join([*(f"{k}: {n}" for k, n in sorted(done.counts.items())), *done.notes])
    rows = ws.query(args.sql)
    return "\n".join(["\t".join(rows.columns), *("\t".join(map(str, r)) for r in rows.toLocalIterator())])


def main(argv: Sequence[str] | None = None, io: Any = None) -> int:
    args = parser().parse_args(argv)
    try:
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        ws = Workspace(spark, args.workspace, **{p: port(getattr(args, p)) for p in PORTS})
        print(run(args, ws, io or Console()))
    except SpanloomError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
