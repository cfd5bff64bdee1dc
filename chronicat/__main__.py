"""Command line: count, seed, convert, snapshot, validate, ingest."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicat import __version__
from chronicat.functions import hashing, paths
from chronicat.operators import asof, validation
from chronicat.plans import convert
from chronicat.sources import archives, catalog
from chronicat.streaming import ingest


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("chronicat")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("count", help="count the files below a folder")
    c.add_argument("path")
    c.add_argument("--progress", action="store_true", help="tell the counts of the folders below")
    c = sub.add_parser("seed", help="write generated files, or with --table their catalog")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-c", "--count", type=int, default=10_000)
    c.add_argument("-v", "--verbose", action="store_true")
    c.add_argument("--table", action="store_true", help="one Parquet table instead of files")
    c = sub.add_parser("convert", help="turn a folder into log, blobs and archives")
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-s", "--size", type=int, default=5000, help="files of an archive, about")
    c.add_argument("-t", "--tolerance", type=int, default=1, help="times that size which an archive may reach")
    c.add_argument("-v", "--verbose", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--legacy", action="store_true", help="contents in archives by bucket, not by folder")
    c = sub.add_parser("snapshot", help="list live files or those of a day")
    c.add_argument("store")
    c.add_argument("path", help="live/... or snapshots/YYYY/MM/DD/...")
    c = sub.add_parser("validate", help="check archives, and repair them")
    c.add_argument("-p", "--path", required=True)
    c.add_argument("-v", "--verbose", action="store_true")
    c.add_argument("-r", "--repair", action="store_true")
    c.add_argument("--dry-run", action="store_true", help="with --repair: only tell what would be done")
    c.add_argument("--remove-backup", action="store_true", help="delete .bak files after a repair")
    c = sub.add_parser("ingest", help="commit the files that land in a folder")
    c.add_argument("landing")
    c.add_argument("store")
    c.add_argument("--once", action="store_true")
    c.add_argument("--clean", choices=("off", "delete", "archive"), default="off", help="what becomes of committed files")
    c.add_argument("--archive", help="where they go with --clean archive")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("chronicat").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return {"count": _count, "seed": _seed, "convert": _convert, "snapshot": _snapshot, "validate": _validate, "ingest": _ingest}[a.command](spark, a)


def _count(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.progress:
        catalog.counts_by_folder(spark, a.path).orderBy("folder").show(1000, truncate=False)
    print(catalog.count_files(spark, a.path))
    return 0


def _seed(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = catalog.seed(spark, a.count)
    if a.table:
        rows.select("name", "ts", "content", hashing.target(F.sha2("content", 256)).alias("target")).write.mode("errorifexists").parquet(a.output)
    else:
        catalog.write_seed(rows, a.output)
    if a.verbose:
        rows.groupBy(F.size(F.split("folder", "/")).alias("depth")).agg(F.count("*").alias("files"), F.countDistinct("content").alias("contents")).orderBy("depth").show()
    return 0


def _convert(spark: SparkSession, a: argparse.Namespace) -> int:
    if paths.paths_overlap(a.input, a.output):
        print("input and output overlap", file=sys.stderr)
        return 2
    most = a.size * max(1, a.tolerance)
    if a.verbose or a.dry_run:
        convert.plan(spark, a.input, most).groupBy("manifest", "include_subdirs").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy("manifest").show(1000, truncate=False)
    if a.dry_run:
        return 0
    done = convert.convert(spark, a.input, a.output, most, packed=not a.legacy)
    if a.legacy:
        convert.pack_buckets(spark.read.parquet(f"{a.output}/blobs").select("target", "content"), f"{a.output}/data").count()
    done.show(truncate=False)
    return 0


def _snapshot(spark: SparkSession, a: argparse.Namespace) -> int:
    _, at, rest = paths.resolve(a.path)
    rows = asof.snapshot(spark.read.parquet(f"{a.store}/log"), at)
    rows.where(F.startswith("name", F.lit(rest))).orderBy("manifest", "name").show(1000, truncate=False)
    return 0


def check(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(archives, findings) of the archives below a path."""
    members = archives.read_archives(spark, path, contents=False)
    entries = catalog.archive_manifests(members).withColumnRenamed("manifest", "archive")
    found = validation.findings(members.select("archive").distinct(), entries, members.where("not corrupted"), catalog.stored_metadata(members), members.where("corrupted"))
    return members.select("archive"), found


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    checked, found = check(spark, a.path)
    found = found.persist()
    if a.verbose:
        validation.joined(found).orderBy("archive").show(1000, truncate=False)
    left = validation.summary(checked, found).first()
    print(left.asDict())
    if a.repair and left["total_errors"]:
        plan = validation.preview(found)
        if a.dry_run:
            validation.rendered_plan(plan).orderBy("archive").show(1000, truncate=False)
        else:
            done = archives.repair_archives(plan, a.remove_backup).collect()  # a row per damaged archive
            for row in sorted(done):
                print(row.asDict())
            left = validation.summary(*check(spark, a.path)).first()
            print(left.asDict())
    found.unpersist()
    return int(left["total_errors"] > 0)


def _ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    ingest.start(spark, a.landing, a.store, every=None if a.once else "30 seconds", clean=a.clean, archive=a.archive).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
