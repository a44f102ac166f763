"""python -m weftline.cli: eval, run, query, pipeline run, pipeline validate, repl."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from weftline.lang.diagnostics import ScriptError
from weftline.lang.evaluate import evaluate
from weftline.pipeline.config import PipelineError, parse
from weftline.pipeline.runner import Runner, read_value, rendered


def _input(args: argparse.Namespace) -> Any:
    if args.json is not None:
        return json.loads(args.json)
    if args.input == "-":
        told = sys.stdin.read()
        return json.loads(told) if (args.input_format or "json") == "json" else told
    return read_value(args.input, args.input_format) if args.input else None


def _print(value: Any, kind: str) -> None:
    print(value if isinstance(value, str) and kind == "text" else rendered(value, kind))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weftline", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, what in (("eval", "script"), ("run", "file")):
        c = commands.add_parser(name)
        c.add_argument(what)
        c.add_argument("--input")
        c.add_argument("--json")
        c.add_argument("--input-format")
        c.add_argument("--output-format", default="json")
    q = commands.add_parser("query", help="a script over Parquet tables, by Spark")
    q.add_argument("script")
    q.add_argument("--table", action="append", default=[], metavar="name=path")
    q.add_argument("--output")
    q.add_argument("--output-format")
    p = commands.add_parser("pipeline")
    steps = p.add_subparsers(dest="step", required=True)
    for name in ("run", "validate"):
        c = steps.add_parser(name)
        c.add_argument("file")
        if name == "run":
            c.add_argument("--source", action="append", default=[], metavar="name=path")
            c.add_argument("--source-envelope", action="append", default=[], metavar="name=path")
            c.add_argument("--output-dir")
            c.add_argument("--state-dir")
    s = steps.add_parser("status")
    s.add_argument("id")
    s.add_argument("--state-dir", required=True)
    commands.add_parser("repl").add_argument("--input")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "eval":
            _print(evaluate(args.script, _input(args)), args.output_format)
        elif args.command == "run":
            _print(evaluate(Path(args.file).read_text("utf-8-sig"), _input(args)), args.output_format)
        elif args.command == "query":
            _query(args)
        elif args.command == "repl":
            _repl(read_value(args.input) if args.input else None)
        elif args.step == "status":
            print((Path(args.state_dir) / f"{args.id}.json").read_text())
        else:
            pipeline = parse(Path(args.file).read_text("utf-8-sig"), Path(args.file).parent)
            for w in pipeline.warnings:
                print(f"warning: {w}", file=sys.stderr)
            if args.step == "validate":
                print("valid")
                return 0
            given = dict(s.split("=", 1) for s in args.source)
            payloads, about = {n: read_value(f) for n, f in given.items()}, {}
            for n, f in (s.split("=", 1) for s in args.source_envelope):
                whole = read_value(f)
                payloads[n], about[n] = whole["payload"], whole["source"]
            result = Runner(state_folder=args.state_dir).run(pipeline, payloads, about, args.output_dir)
            for e in result.errors:
                print(f"error: {e}", file=sys.stderr)
            print(rendered(result.response if result.response is not None else result.outputs, "json"))
            return 1 if result.errors else 0
    except (ScriptError, PipelineError, OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def _query(args: argparse.Namespace) -> None:
    from pyspark.sql import SparkSession

    from weftline.plans.engine import Engine
    from weftline.sources import files

    spark = SparkSession.builder.appName("weftline").getOrCreate()
    engine = Engine(spark)
    for name, path in (t.split("=", 1) for t in args.table):
        engine.bind(name, files.read(spark, path))
    df = engine.query(args.script)
    if args.output:
        files.write(df, args.output, args.output_format)
    else:
        df.show(100, truncate=False)


def _repl(document: Any) -> None:
    while True:
        try:
            line = input("> ")
        except EOFError:
            return
        if line.strip() in ("exit", "quit"):
            return
        try:
            print(rendered(evaluate(line, document), "json"))
        except ScriptError as e:
            print(e)


if __name__ == "__main__":
    sys.exit(main())
