"""Command line: ``python -m rillstone VERB ...``."""

from __future__ import annotations

import argparse
import sys

from . import __version__, report, transform
from .export import lines
from .plans.filter_lang import compile_filter, cost, flow_columns
from .plans.query import FlowQuery


def _session():
    from .session import build_session

    spark = build_session("local[*]", "rillstone")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _flows(spark, path: str):
    from .pipeline import flows_of

    return flows_of(spark, path)


def _inspect(args) -> None:
    from .sources.datasources import read_captures
    from .sources.messages import inspect

    for r in inspect(read_captures(_session(), args.file)).orderBy("stream_id", "seq").toLocalIterator():
        print(f"[{r.seq if r.seq is not None else '-':>3}] {r.type_name or 'ERROR':<16} flags=0x{r.flags or 0:02x} len={r.len or 0:<5} {r.detail}")


def _run(args) -> None:
    flows = _flows(_session(), args.file)
    print(report.flow_summary(flows), end="")
    matched = flows.where(compile_filter(args.filter, flows, flow_columns(flows))) if args.filter else flows
    for r in lines(matched, args.format).toLocalIterator():
        print(r.line)


def _filter(args) -> None:
    if not args.file:
        print(f"ok: {cost(args.expression)} field reference(s)")
        return
    args.filter = args.expression
    _run(args)


def _query(args) -> None:
    query = FlowQuery().order_by(args.order, not args.ascending).limit(args.limit).aggregate("count", "sum_octets")
    if args.where:
        query = query.where(args.where)
    print(report.flows(query.run(_flows(_session(), args.file))), end="")


def _asm(args) -> None:
    with open(args.file, encoding="utf-8") as f:
        code = transform.assemble(f.read())
    print(" ".join(f"{b:02x}" for b in code))
    print(f"{len(code)} byte(s)")


def _snapshot(args) -> None:
    from .sources.datasources import decode_snapshots

    files = _session().read.format("binaryFile").load(args.file)
    print(report.flow_summary(decode_snapshots(files, "content")), end="")


def validated(messages):
    """``text``: how many messages, schemas and errors there are."""
    return messages.selectExpr("concat('messages=', count_if(error is null), ' schemas=', count_if(type_name in ('SCHEMA_DEF', 'SCHEMA_UPDATE')), ' errors=', count_if(error is not null)) as text")


def _validate(args) -> None:
    from .sources.datasources import read_captures

    print(validated(read_captures(_session(), args.file)).first().text)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("rillstone")
    verbs = out.add_subparsers(dest="verb", required=True)
    verbs.add_parser("version").set_defaults(run=lambda _: print(__version__))
    for name, run in (("inspect", _inspect), ("asm", _asm), ("snapshot", _snapshot), ("validate", _validate)):
        p = verbs.add_parser(name)
        p.add_argument("file")
        p.set_defaults(run=run)
    p = verbs.add_parser("run")
    p.add_argument("file")
    p.add_argument("filter", nargs="?")
    p.add_argument("--format", default="text")
    p.set_defaults(run=_run)
    p = verbs.add_parser("filter")
    p.add_argument("expression")
    p.add_argument("file", nargs="?")
    p.add_argument("--format", default="text")
    p.set_defaults(run=_filter)
    p = verbs.add_parser("query")
    p.add_argument("file")
    p.add_argument("--where")
    p.add_argument("--order", default="octets")
    p.add_argument("--ascending", action="store_true")
    p.add_argument("--limit", type=int, default=20)
    p.set_defaults(run=_query)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(args)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
