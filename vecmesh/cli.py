"""Command line: python -m vecmesh.cli --root DIR create|train|insert|delete|search|stats|maintain ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import routing
from .sources.collection import Engine


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vecmesh")
    out.add_argument("--root", required=True)
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("create", "train", "insert", "delete", "search", "stats", "flush", "maintain", "list"):
        one = sub.add_parser(name)
        if name != "list":
            one.add_argument("name")
        if name == "create":
            one.add_argument("--dim", type=int, required=True)
            one.add_argument("--metric", default="L2")
            one.add_argument("--capacity", type=int, default=1000)
        if name in ("train", "insert"):
            one.add_argument("--vectors", required=True, help='JSON: {"id": [numbers], ...}')
        if name == "train":
            one.add_argument("--buckets", type=int)
        if name == "delete":
            one.add_argument("--ids", type=int, nargs="+", required=True)
        if name == "search":
            one.add_argument("--vector", required=True, help="JSON list")
            one.add_argument("--k", type=int, default=10)
            one.add_argument("--target", type=float, default=routing.TARGET)
            one.add_argument("--decay", type=float, default=routing.DECAY)
            one.add_argument("--density", type=float, default=routing.DENSITY)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, quiet: bool = False):
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("vecmesh").getOrCreate()
    engine = Engine(spark, args.root)
    if args.command == "list":
        out = engine.names()
    elif args.command == "create":
        engine.create(args.name, args.dim, args.metric, args.capacity)
        out = "ok"
    else:
        target = engine.open(args.name)
        frame = lambda rows: spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "id long, embedding array<float>")
        if args.command == "train":
            out = target.train(frame(json.loads(args.vectors).items()), args.buckets)
        elif args.command == "insert":
            out = target.insert(frame(json.loads(args.vectors).items()))
        elif args.command == "delete":
            out = target.delete(spark.createDataFrame([(i,) for i in args.ids], "id long"))
        elif args.command == "search":
            asked = frame([(0, json.loads(args.vector))]).withColumnRenamed("id", "query_id")
            out = [(r["id"], r["score"]) for r in target.search(asked, args.k, args.target, args.decay, args.density).orderBy("rank").collect()]
        elif args.command == "stats":
            out = [r.asDict() for r in target.stats().orderBy("bucket_id").collect()]
        else:
            out = target.flush() if args.command == "flush" else target.maintain()
    if not quiet:
        print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
