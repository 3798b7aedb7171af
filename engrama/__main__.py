"""``python -m engrama serve|tools --root FOLDER``: HTTP, or JSON-RPC lines on standard input and output."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .api import Config, Engine
from .schema import CONSOLIDATE_AFTER_S
from .server import serve, stdio
from .streaming.feeds import lifecycle_stream
from .tenancy import ApiKey, Auth, Registry


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="engrama")
    p.add_argument("command", choices=["serve", "tools"])
    p.add_argument("--root", required=True, help="folder of the collections, in any store Spark can write")
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--key", action="append", default=[], help="KEY or KEY:namespace,namespace; none: open to all")
    p.add_argument("--log", choices=["text", "json", "off"], default="text")
    p.add_argument("--agent", help="the agent that the tools act for")
    p.add_argument("--namespace", default="default")
    p.add_argument("--consolidate-after", type=int, default=CONSOLIDATE_AFTER_S, help="seconds")
    p.add_argument("--lifecycle", type=int, default=300, help="seconds between runs; 0: none")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("engrama").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = Config(consolidate_after_s=args.consolidate_after)
    registry = Registry(spark, args.root, lambda s, root, name: Engine(s, root, name, config))
    registry.open_existing()
    if args.command == "tools":
        stdio(registry.get_or_create(args.namespace), args.agent, sys.stdin, sys.stdout)
        return
    if args.lifecycle:
        lifecycle_stream(spark, lambda: registry.open.values(), f"{args.root.rstrip('/')}/.lifecycle", f"{args.lifecycle} seconds")
    serve(registry, Auth([ApiKey.parse(k) for k in args.key]), args.port, args.log).serve_forever()


if __name__ == "__main__":
    main()
