"""Command line: list queries, run one, list a library folder, or check a configuration."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from babelshelf.operators import nesting, options
from babelshelf.session import build_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="babelshelf")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names of the catalogue queries")
    run = commands.add_parser("run", help="run a catalogue query and show or write its result")
    run.add_argument("name")
    run.add_argument("data", help="folder of the Parquet tables")
    run.add_argument("--out", help="folder for the result as Parquet")
    scan = commands.add_parser("scan", help="classify the files and folders of a library")
    scan.add_argument("root")
    scan.add_argument("--trailer", action="append", default=["trailer"])
    scan.add_argument("--special", action="append", default=[])
    rescan = commands.add_parser("rescan", help="bring the saved listing of a library up to date and count what changed")
    rescan.add_argument("root")
    rescan.add_argument("listing", help="folder of the saved listing")
    rescan.add_argument("--format", action="append", help="extension of files that aren't ignored; all if not given")
    rescan.add_argument("--ignore", action="append", default=[], help="name of a folder that is never opened")
    commands.add_parser("config_check", help="read a configuration file").add_argument("file")
    args = parser.parse_args(argv)

    if args.command == "config_check":
        found = options.load_config(args.file)
        print("no such file" if found is None else json.dumps(found, indent=4, ensure_ascii=False))
        return int(found is None)
    from babelshelf import catalog

    if args.command == "queries":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = build_session()
    if args.command == "run":
        df = catalog.QUERIES[args.name](spark, args.data)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(50, truncate=False)
    elif args.command == "rescan":
        from babelshelf.sources import library

        print(json.dumps(library.refresh(spark, args.root, args.listing, args.format, tuple(args.ignore))))
    else:
        from babelshelf.sources import listing

        entries = listing.walked(spark, args.root).where("NOT ignored AND error IS NULL")
        nesting.classify(entries.select("path", "kind"), args.special, args.trailer).orderBy(F.split("path", "/")).show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
