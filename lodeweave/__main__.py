"""Command line: ``python -m lodeweave COMMAND``, for the tree in the current folder."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from lodeweave import __version__
from lodeweave.plans.engine import Ambiguous, Engine, NotFound, Summary, shown
from lodeweave.sources import servers, setup, sinks


def parser() -> argparse.ArgumentParser:
    """Return the parser of all commands."""
    top = argparse.ArgumentParser(prog="lodeweave", description="Build a code graph of a source tree, keep it fresh, and ask it.")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, about: str, *places: str, json: bool = True) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=about)
        for place in places:
            one.add_argument(place)
        if json:
            one.add_argument("--json", action="store_true", help="print JSON")
        return one

    init = add("init", "make the folder, notes for agents, and a first graph", json=False)
    init.add_argument("--llm", default="", help="agents: codex, claude, cursor, all")
    init.add_argument("--no-generate", action="store_true")
    ready = add("setup", "make the graph and all notes for agents", json=False)
    full = add("generate", "build the graph anew")
    full.add_argument("path", nargs="?", default=".")
    full.add_argument("-l", "--lang", default="", help="languages, separated by commas")
    fresh = add("update", "bring the graph up to date")
    fresh.add_argument("--explain", action="store_true", help="say why files are affected")
    for one in (init, ready, full, fresh):
        one.add_argument("--format", default=None, help="text or jsonl")
    add("status", "tell what an update would do")
    add("doctor", "tell whether the graph is whole and fresh")
    find = add("symbol", "find symbols by name or id", "query")
    find.add_argument("--fuzzy", action="store_true")
    find.add_argument("--limit", type=int, default=10)
    for name, about in (("callers", "what calls a symbol"), ("callees", "what a symbol calls"), ("definition", "the symbol of a name or place"), ("references", "what refers to a symbol or place")):
        add(name, about, "query").add_argument("--lsp", action="store_true", help="ask a language server, too")
    steps = add("trace", "calls from a symbol on", "query")
    steps.add_argument("--depth", type=int, default=2)
    steps.add_argument("--lsp", action="store_true")
    add("path", "a shortest chain of calls", "start", "goal").add_argument("--lsp", action="store_true")
    note = add("enrich", "annotate a symbol", "target")
    note.add_argument("description", nargs="+")
    add("install-hook", "update before each commit", json=False)
    add("version", "print the version", json=False)
    return top


def _said(summary: Summary, explain: bool = False) -> str:
    lines = [f"scanned={summary.scanned} parsed={summary.parsed} reused={summary.reused} rewritten={summary.rewritten}"]
    lines += [f"{what}: {shown(names)}" for what, names in (("changed", summary.changed), ("deleted", summary.deleted)) if names]
    lines += [f"- {path}: {'; '.join(why)}" for path, why in sorted(summary.reasons.items()) if explain]
    return "\n".join(lines + [f"warning: {x}" for x in summary.issues])


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def _record(r: dict) -> str:
    tail = "".join(f" {k}={r[k]}" for k in ("confidence", "source", "score", "depth") if r.get(k) not in (None, ""))
    return (f"{r['id']} [{r['kind']}] {r['file']}:{r['line']}" if "kind" in r else f"{r['src']} -> {r['dst']}") + tail


def answer(spark: SparkSession, root: str, args: argparse.Namespace) -> tuple[object, str]:
    """Return what a command has to say, as data and as text."""
    lsp = bool(getattr(args, "lsp", False))
    engine = Engine(spark, root, runner=(lambda server, action, file, line: servers.asked(root, server, action, file, line)) if lsp else None)
    name = args.command
    if name in ("init", "setup"):
        os.makedirs(engine.context, exist_ok=True)
        agents = setup.agents_of("all" if name == "setup" else args.llm)
        written = setup.write_notes(root, agents) if agents else []
        lines = [f"Initialized {engine.context}"] + [f"Wrote {shown(written)}"] * bool(written)
        if name == "setup" or not args.no_generate and engine.has_sources():
            lines.append(_said(engine.generate(form=args.format)))
        return {"context": engine.context, "written": written}, "\n".join(lines)
    if name == "generate":
        done = Engine(spark, os.path.join(root, args.path)).generate(args.lang.split(",") if args.lang else None, args.format)
        return vars(done), _said(done)
    if name in ("update", "status"):
        done = engine.update(args.format) if name == "update" else engine.status()
        return vars(done), _said(done, name == "status" or args.explain)
    if name == "doctor":
        found = engine.doctor() | {"integrations": setup.present_notes(root)}
        servers_text = [f"server {k}: {v['server']} {'available' if v['available'] else v['reason']}" for k, v in found["servers"].items() if v["present"]]
        return found, "\n".join([f"{'healthy' if found['healthy'] else 'not healthy'}, format {found['format']}, {'clean' if found['clean'] else 'stale'}"] + [f"missing: {m}" for m in found["missing"]] + servers_text + [f"suggestion: {s}" for s in found["suggestions"]])
    if name == "symbol":
        rows = _dicts(engine.symbol(args.query, args.fuzzy, args.limit))
        if not rows:
            raise NotFound(f"symbol {args.query!r} not found")
        return {"query": args.query, "matches": rows}, "\n".join(map(_record, rows))
    if name == "enrich":
        made = engine.enrich(args.target, " ".join(args.description), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
        return made, f"annotated {made['symbol_id']}"
    if name == "path":
        rows = _dicts(engine.path(args.start, args.goal))
        return _with_server(engine, args.start, lsp, {"length": len(rows), "edges": rows}), "\n".join([f"length {len(rows)}", *map(_record, rows)])
    server = engine.server_of(args.query)["server"] if lsp and engine.server_of(args.query)["available"] else None
    if name == "definition":
        row = engine.definition(args.query, server)
        return _with_server(engine, args.query, lsp, {"query": args.query, "symbol": row}), _record(row)
    rows = _dicts({"callers": engine.callers, "callees": engine.callees, "trace": lambda q: engine.trace(q, args.depth), "references": lambda q: engine.references(q, server)}[name](args.query))
    return _with_server(engine, args.query, lsp, {"query": args.query, "results": rows}), "\n".join(map(_record, rows)) or "nothing"


def _with_server(engine: Engine, query: str, lsp: bool, data: dict) -> dict:
    return data | {"lsp": engine.server_of(query)} if lsp else data


def main(words: list[str] | None = None, spark: SparkSession | None = None, root: str | None = None) -> int:
    """Run a command; return the exit code."""
    args = parser().parse_args(words)
    root = os.path.abspath(root or os.getcwd())
    try:
        if args.command == "version":
            print(f"lodeweave {__version__}")
            return 0
        if args.command == "install-hook":
            print(f"Installed {setup.install_hook(root)}")
            return 0
        if getattr(args, "format", None):
            sinks.checked_format(args.format)
        if spark is None:
            spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", os.environ.get("LODEWEAVE_PARTITIONS", "8")).getOrCreate()
            spark.sparkContext.setLogLevel("ERROR")
        data, text = answer(spark, root, args)
    except (NotFound, Ambiguous, ValueError, OSError, servers.ServerError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    print(json.dumps(data, default=str, indent=2) if getattr(args, "json", False) else text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
