"""python -m epochal COMMAND --table NAME=PATH[:EPOCH_COLUMN] ... STATEMENT

check: the refusal code of a statement, or ok.  parse: its parsed plan.  path: how it would be answered.
explain: that, and Spark's plan.  run: its rows.  time: the seconds of each phase of running it.
Only run and time run anything.  --strict refuses what is outside the strict fragment, --anchor reads as of an epoch.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.refusal import Refused
from .session import Engine


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="epochal", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("check", "parse", "path", "explain", "run", "time"))
    parser.add_argument("statement")
    parser.add_argument("--table", action="append", default=[], help="NAME=PATH or NAME=PATH:EPOCH_COLUMN of a Parquet table")
    parser.add_argument("--strict", action="store_true")
    parser.add_argument("--anchor", type=int)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("epochal").getOrCreate()
    engine = Engine(spark, strict=args.strict)
    for table in args.table:
        name, _, path = table.partition("=")
        head, colon, epoch = path.rpartition(":")
        timed = bool(colon) and "/" not in epoch and bool(epoch)
        engine.catalog.parquet(name, head if timed else path, epoch=epoch if timed else None)
    try:
        if args.command == "check":
            code = engine.check(args.statement)
            print(code)
            return int(code != "ok")
        if args.command == "parse":
            print(engine.planned(args.statement, args.anchor).plan)
        elif args.command == "path":
            print(engine.serve_path(args.statement))
        elif args.command == "explain":
            print(engine.explain(args.statement))
        elif args.command == "run":
            engine.sql(args.statement, args.anchor).show(1000, truncate=False)
        else:
            for phase, seconds in engine.timed(args.statement, args.anchor).items():
                print(f"{phase}\t{seconds:.3f}")
    except Refused as e:
        print(e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
