"""python -m lexicask ingest | stat | compact | drop"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexicask.plans.index import Index, IndexRefused, drop
from lexicask.plans.ingest import ingest
from lexicask.schema import Features
from lexicask.sources import linedocs

FIELDS = ("title", "body", "random_label")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="lexicask", description="Positioned-token index of text fields.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, says in (("ingest", "append a binary line-documents file"), ("stat", "bytes of each section of each field"), ("compact", "merge all generations"), ("drop", "delete the index")):
        one = commands.add_parser(name, help=says)
        one.add_argument("--db", required=True, help="path of the index")
        if name == "ingest":
            one.add_argument("--bin-file", required=True)
            one.add_argument("--limit", type=int)
            one.add_argument("--batch-size", type=int, help="documents of a commit (all by default)")
            one.add_argument("--field", action="append", choices=FIELDS, help="fields to index (all by default)")
    args = top.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexicask").getOrCreate()
    if args.command == "drop":
        print(drop(spark, args.db))
        return 0
    try:
        if args.command == "ingest":
            fields = {f: f for f in args.field or FIELDS}
            index = Index.open(spark, args.db, dict.fromkeys(fields, Features.POSITIONS))
            _, said = ingest(index, linedocs.read(spark, args.bin_file, args.limit), fields, batch_size=args.batch_size)
            print(f"{said['n_docs']} documents, {said['total_bytes']} bytes, {said['docs_per_second']:.0f} documents/s, {said['gb_per_hour']:.2f} GB/hour")
            return 0
        index = Index.open(spark, args.db)
    except IndexRefused as e:
        print(e)
        return 1
    if args.command == "stat":
        for row in index.stat().collect():
            print(f"{row['field']}\t{row['section']}\t{row['size']}\t{row['rows']} rows")
    else:
        compacted = index.compact()
        compacted.vacuum()
        print(f"{len(index.manifest.generations)} generations to {len(compacted.manifest.generations)}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
