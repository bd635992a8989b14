"""Command line: build an index, convert references to binary files, score bodies by an index, generate requests.

    python -m tessera build-index REFERENCES.json[.gz] INDEX [--kind ivf|cells|levels|flat] [--clusters 2048] [--lines]
    python -m tessera build-index BINARY INDEX --binary [--kind ...]
    python -m tessera convert REFERENCES.json[.gz] BINARY [--clusters 2048] [--files 1] [--lines]
    python -m tessera score BODIES OUT --index INDEX
    python -m tessera generate N OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessera.plans import index, scorers
from tessera.plans.storage import kept, scratch
from tessera.sources import binary
from tessera.sources import references as R
from tessera.sources import requests as S
from tessera.streaming.score import score_batch


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build-index")
    build.add_argument("references")
    build.add_argument("index")
    build.add_argument("--kind", choices=("flat", "ivf", "cells", "levels"), default="ivf", help="levels: cells cut at the middle of their range, level by level, at exact ranks")
    build.add_argument("--binary", action="store_true", help="the references are binary files; clusters that they have are taken as they are")
    convert = commands.add_parser("convert")
    convert.add_argument("references")
    convert.add_argument("binary")
    convert.add_argument("--files", type=int, default=1)
    for command in (build, convert):
        command.add_argument("--clusters", type=int, default=2048, help="clusters or cells; 0 means none")
        command.add_argument("--lines", action="store_true", help="the references are JSON lines")
    score = commands.add_parser("score")
    score.add_argument("bodies")
    score.add_argument("out")
    score.add_argument("--index", required=True)
    made = commands.add_parser("generate")
    made.add_argument("n", type=int)
    made.add_argument("out")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with scratch():
        run(spark, args)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command in ("build-index", "convert"):
        from_binary = getattr(args, "binary", None) is True
        rows = kept(binary.read(spark, args.references) if from_binary else R.references(R.read_json(spark, args.references, args.lines)))
    if args.command == "convert":
        if args.clusters == 0:
            binary.write(rows, args.binary, args.files)
        else:
            centroids, assigned = index.build_ivf(rows, args.clusters)
            binary.write_clustered(assigned, centroids, args.binary, args.files)
    elif args.command == "build-index":
        if args.kind == "flat" or args.clusters == 0:
            index.save(args.index, rows.drop("cluster_id"))
        elif args.kind == "ivf" and from_binary and rows.where("cluster_id is null").isEmpty():
            index.save(args.index, rows, "ivf", binary.read_centroids(spark, args.references))
        elif args.kind == "ivf":
            centroids, assigned = index.build_ivf(rows.drop("cluster_id"), args.clusters)
            index.save(args.index, assigned, "ivf", centroids)
        elif args.kind == "levels":
            index.save(args.index, index.build_levels(rows.drop("cluster_id"), max(0, args.clusters.bit_length() - 1), "midpoint"), "cells")
        else:
            index.save(args.index, index.build_cells(rows.drop("cluster_id"), args.clusters), "cells")
    elif args.command == "score":
        bodies = spark.read.text(args.bodies).withColumnRenamed("value", "body")
        score_batch(bodies, scorers.load(spark, args.index)).write.parquet(args.out)
    else:
        S.to_body(S.generate(spark, args.n)).select("body").write.text(args.out)


if __name__ == "__main__":
    main()
