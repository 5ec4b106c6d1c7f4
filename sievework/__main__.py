"""Command line: ``python -m sievework overview|hybrid|chunk ROOT ...``, results as JSON on standard output."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import chunks, retrieve, tree
from .sources.extract import base_relations
from .sources.scan import scan


def as_json(df: DataFrame) -> list[dict]:
    """The rows of a small result, each as a JSON object."""
    return [json.loads(x) for x in df.toJSON().collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    parser = argparse.ArgumentParser(prog="sievework", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("overview")
    p.add_argument("root")
    p.add_argument("--depth", type=int, default=2)
    p.add_argument("--scope")
    p = sub.add_parser("hybrid")
    p.add_argument("root")
    p.add_argument("query")
    p.add_argument("--channels", default="", help="comma list of structural, bm25, vector")
    p.add_argument("--limit", type=int, default=retrieve.LIMIT)
    p.add_argument("--explain", action="store_true")
    p = sub.add_parser("chunk")
    p.add_argument("root")
    p.add_argument("to", help="folder for the NDJSON files")
    p.add_argument("--policies", default="function,class")
    p.add_argument("--tests", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("sievework").getOrCreate()
    base = base_relations(scan(spark, args.root)[0])
    if args.command == "overview":
        result: object = as_json(tree.overview(base, args.root, args.depth, args.scope))
    elif args.command == "chunk":
        made = chunks.chunks(base, tuple(args.policies.split(",")), with_tests=args.tests)
        chunks.write_ndjson(made, args.to)
        result = {"chunks": made.count(), "path": args.to}
    else:
        names, made = retrieve.parse_channels(args.channels), chunks.chunks(base)
        if args.explain:
            result = {k: as_json(v) for k, v in retrieve.explain(made, base["symbols"], args.query, names, args.limit).items()}
        else:
            result = as_json(retrieve.hybrid(made, base["symbols"], args.query, names, args.limit))
    json.dump(result, out or sys.stdout, indent=2, ensure_ascii=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
