"""Time travel over a change log: snapshots, current state, compaction."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronicat import errors
from chronicat.functions import paths

KEY = ("manifest", "name")


def _one(cat: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy(*order)
    return cat.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def until(cat: DataFrame, at: datetime | None) -> DataFrame:
    """Rows with ts <= at; the bound must stand below any choice of version."""
    return cat if at is None else cat.where(F.col("ts") <= F.lit(at).cast("timestamp_ntz" if dict(cat.dtypes)["ts"] == "timestamp_ntz" else "timestamp"))


def alive(cat: DataFrame) -> DataFrame:
    return cat.where(F.col("target") != "")


def latest(cat: DataFrame, at: datetime | None = None) -> DataFrame:
    """Newest version of each name by ``at``, tombstones included; of equal
    times the first row of the manifest."""
    return _one(until(cat, at), F.desc("ts"), F.asc("pos"))


def snapshot(cat: DataFrame, at: datetime | None = None) -> DataFrame:
    return alive(latest(cat, at))


def live(cat: DataFrame, mode: str = "latest") -> DataFrame:
    """Current files: ``latest`` version, or (``first``) the first row of each
    name that isn't a tombstone."""
    if mode == "latest":
        return snapshot(cat)
    if mode == "first":
        return _one(alive(cat), F.asc("pos"))
    raise ValueError(mode)


def collapse(cat: DataFrame) -> DataFrame:
    """One version per name, tombstones kept; of equal times the last row."""
    return _one(cat, F.desc("ts"), F.desc("pos"))


def last_state(cat: DataFrame) -> DataFrame:
    """Last row of each name in table order, whatever its time."""
    return _one(cat, F.desc("pos"))


def history(cat: DataFrame, prefix: str = "") -> DataFrame:
    """Versions of names under a prefix, numbered, with their end of life."""
    w = Window.partitionBy(*KEY).orderBy("ts", "pos")
    rows = cat.where(F.startswith("name", F.lit(prefix))) if prefix else cat
    return rows.withColumns({"version": F.row_number().over(w).cast("bigint"), "until_ts": F.lead("ts").over(w)})


def point(cat: DataFrame, manifest: str, name: str, at: datetime | None = None) -> DataFrame:
    return snapshot(cat.where((F.col("manifest") == manifest) & (F.col("name") == name)), at)


def under_prefix(cat: DataFrame, prefix: str, at: datetime | None = None) -> DataFrame:
    return snapshot(cat.where(F.startswith("name", F.lit(prefix))), at)


def versions_under(cat: DataFrame, prefix: str) -> DataFrame:
    """Every living version under a prefix, as a plain listing keeps them."""
    return alive(cat.where(F.startswith("name", F.lit(prefix))))


def any_under(cat: DataFrame, prefix: str, at: datetime | None = None) -> DataFrame:
    """One row: found. Without a time any living version counts."""
    rows = versions_under(cat, prefix) if at is None else under_prefix(cat, prefix, at)
    return rows.limit(1).agg((F.count("*") > 0).alias("found"))


def removed(cat: DataFrame, manifest: str, name: str, at: datetime) -> DataFrame:
    """The log with a tombstone appended (never an update in place)."""
    pos = cat.where(F.col("manifest") == manifest).agg(F.coalesce(F.max("pos"), F.lit(-1)) + 1).first()[0]
    spark = cat.sparkSession
    row = spark.range(1).select(F.lit(manifest).alias("manifest"), F.lit(pos).cast("bigint").alias("pos"), F.lit(name).alias("name"), F.lit("").alias("target"), F.lit(0).cast("bigint").alias("size"), F.lit(at).cast(dict(cat.dtypes)["ts"]).alias("ts"))
    return cat.unionByName(row, allowMissingColumns=True)


def ordered(cat: DataFrame) -> DataFrame:
    return cat.orderBy("ts", "manifest", "pos")


def sequence(cat: DataFrame) -> DataFrame:
    """Rows with ``seq``, their place by time (then pos) in their manifest."""
    return cat.withColumn("seq", F.row_number().over(Window.partitionBy("manifest").orderBy("ts", "pos")).cast("bigint") - 1)


def at_position(cat: DataFrame, pos: int, manifest: str | None = None) -> DataFrame:
    """The row at a position of one manifest, or of each; none out of range."""
    rows = cat.where(F.col("pos") == pos)
    return rows if manifest is None else rows.where(F.col("manifest") == manifest)


def without_position(cat: DataFrame, pos: int, manifest: str | None = None) -> DataFrame:
    """All other rows; an ``OutOfRange`` (IndexError) if no row is there."""
    if at_position(cat, pos, manifest).limit(1).isEmpty():
        raise errors.OutOfRange(pos)
    here = F.col("pos") == pos
    return cat.where(~(here if manifest is None else here & (F.col("manifest") == manifest)))


def attributes(cat: DataFrame) -> DataFrame:
    """Stat-like projection of files; ``inode`` if rows have one."""
    return cat.select("manifest", "name", "pos", "size", F.col("ts").alias("mtime"), F.col("ts").alias("ctime"), F.lit("0644").alias("mode"), *[c for c in ("inode",) if c in cat.columns])


def folder_attributes(cat: DataFrame) -> DataFrame:
    """(manifest, dir, inode, mode) of every folder above a name, '' the root."""
    up = cat.select("manifest", F.explode(paths.ancestors(F.col("name"))).alias("dir")).distinct()
    return up.select("manifest", "dir", F.lit(1).cast("bigint").alias("inode"), F.lit("0755").alias("mode"))
