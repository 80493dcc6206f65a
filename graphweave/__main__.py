"""Command line: ``version``, ``init``, ``explain``, ``run`` and ``serve``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from graphweave import config

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="print the version")
    init = commands.add_parser("init", help="write a sample configuration")
    init.add_argument("path", nargs="?", default="gateway.yaml")
    for name, text in (("explain", "print a query's steps and plan"), ("run", "print a query's answer"), ("serve", "answer queries over HTTP")):
        command = commands.add_parser(name, help=text)
        command.add_argument("--config", default="gateway.yaml")
        if name == "serve":
            command.add_argument("--port", type=int, default=9000)
        else:
            command.add_argument("query", help="a query, or @file")
            command.add_argument("--variables", type=json.loads, default={})
            command.add_argument("--operation")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "init":
        if Path(args.path).exists():
            print(f"{args.path} is there already", file=sys.stderr)
            return 1
        Path(args.path).write_text(config.SAMPLE, encoding="utf-8")
        return 0
    from pyspark.sql import SparkSession

    gateway, settings = config.load(SparkSession.builder.appName("graphweave").getOrCreate(), args.config)
    if args.command == "serve":
        from graphweave.server import server

        with server(gateway, args.port, settings.get("mode", "fused")) as running:
            running.serve_forever()
        return 0
    query = Path(args.query[1:]).read_text(encoding="utf-8") if args.query.startswith("@") else args.query
    if args.command == "explain":
        print(gateway.explain(query, args.variables, args.operation))
        return 0
    answer = gateway.execute(query, args.variables, args.operation, "nested", settings.get("mode", "fused"))
    print(answer.to_json())
    return 0 if answer.data is not None else 1


if __name__ == "__main__":
    sys.exit(main())
