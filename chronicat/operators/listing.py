"""Directories and manifests: children, nearest manifest, calendars."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicat.functions import paths
from chronicat.operators import asof


def children(cat: DataFrame, directory: str = "", at: datetime | None = None, live: bool = False) -> DataFrame:
    """(entry, kind) of a directory. ``live`` lists every living version, so a
    file may repeat; otherwise the snapshot by ``at``."""
    rows = cat.where(paths.under(F.col("name"), directory))
    rows = asof.alive(rows) if live else asof.snapshot(rows, at)
    rest = rows.select(paths.below(F.col("name"), directory).alias("rest"))
    deep = F.contains("rest", F.lit("/"))
    files = rest.where(~deep).select(F.col("rest").alias("entry"), F.lit("file").alias("kind"))
    dirs = rest.where(deep).select(paths.first_segment(F.col("rest")).alias("entry"), F.lit("dir").alias("kind")).distinct()
    return files.unionByName(dirs)


def nearest_manifest(names: DataFrame, manifests: DataFrame, path: str = "path", directory: str = "dir") -> DataFrame:
    """(path, dir): the deepest manifest folder at or above each path; no
    other one is tried. Paths without any are left out."""
    full = names.select(F.col(path).alias("path"))
    up = full.withColumn("dir", F.explode(paths.ancestors(F.col("path"))))
    found = up.join(manifests.select(F.col(directory).alias("dir")).distinct(), "dir")
    return found.groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))


def find_entries(names: DataFrame, cat: DataFrame, at: datetime | None = None) -> DataFrame:
    """Snapshot rows that full paths lead to, through their nearest manifest
    (cat.manifest is its folder)."""
    near = nearest_manifest(names, cat.select(F.col("manifest").alias("dir")))
    rest = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    wanted = near.withColumn("name", rest).withColumnRenamed("dir", "manifest")
    return wanted.join(asof.snapshot(cat, at), ["manifest", "name"])


def by_name(entries: DataFrame) -> DataFrame:
    """Entries of one directory in the order of names."""
    return entries.orderBy("entry", "kind")


def _within(cat: DataFrame, first: str, end: str):
    """Days from first up to end, as bounds that reach the scan."""
    if "local_date" in cat.columns:
        return (F.col("local_date") >= first) & (F.col("local_date") < end)
    at = {"timestamp_ntz": F.to_timestamp_ntz, "date": F.to_date}.get(dict(cat.dtypes)["ts"], F.to_timestamp)
    return (F.col("ts") >= at(F.lit(first))) & (F.col("ts") < at(F.lit(end)))


def calendar(cat: DataFrame, year: str | None = None, month: str | None = None) -> DataFrame:
    """Years, months of a year or days of a month with any row, tombstones too."""
    day = F.col("local_date") if "local_date" in cat.columns else F.date_format("ts", "yyyy-MM-dd")
    d = [F.substring(day, 1, 4).alias("year"), F.substring(day, 6, 2).alias("month"), F.substring(day, 9, 2).alias("day")]
    if year is None:
        return cat.select(d[0]).distinct()
    if month is None:
        return cat.where(_within(cat, f"{year}-01-01", f"{int(year) + 1:04d}-01-01")).select(*d[:2]).distinct()
    after = f"{int(year) + 1:04d}-01-01" if month == "12" else f"{year}-{int(month) + 1:02d}-01"
    return cat.where(_within(cat, f"{year}-{month}-01", after)).select(*d).distinct()


def snapshot_dates(cat: DataFrame) -> DataFrame:
    """``latest`` and every yyyy/MM/dd."""
    day = F.translate("local_date", "-", "/") if "local_date" in cat.columns else F.date_format("ts", "yyyy/MM/dd")
    dates = cat.select(day.alias("snapshot")).distinct()
    return dates.unionByName(cat.sparkSession.range(1).select(F.lit("latest").alias("snapshot")))


def calendar_rollup(cat: DataFrame) -> DataFrame:
    """Rows by year, month and day with subtotals."""
    d = cat.select(F.date_format("ts", "yyyy").alias("year"), F.date_format("ts", "MM").alias("month"), F.date_format("ts", "dd").alias("day"))
    return d.rollup("year", "month", "day").agg(F.count("*").alias("n"))
