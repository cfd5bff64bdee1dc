"""Counts and metadata of catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicat import __version__, errors
from chronicat.operators import asof

#: What the metadata of a manifest holds.
FIELDS = ("engine_version", "total_file_count", "target_file_count", "uncompressed_size", "compressed_size", "oldest_file_ts", "newest_file_ts")


def aggregates() -> list:
    return [
        F.countDistinct("name").alias("total_file_count"),
        F.countDistinct("target").alias("target_file_count"),  # '' is one
        F.sum("size").cast("bigint").alias("uncompressed_size"),
        F.min("ts").alias("oldest_file_ts"),
        F.max("ts").alias("newest_file_ts"),
    ]


def metadata(cat: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """Metadata of each manifest; compressed_size from archives (manifest,
    compressed_size) or 0."""
    out = cat.groupBy("manifest").agg(*aggregates())
    if archives is not None:
        out = out.join(archives, "manifest", "left")
    size = F.coalesce("compressed_size", F.lit(0)) if archives is not None else F.lit(0)
    return out.withColumns({"compressed_size": size.cast("bigint"), "engine_version": F.lit(__version__)})


def metadata_global(cat: DataFrame) -> DataFrame:
    return cat.agg(*aggregates())


def active_count(cat: DataFrame) -> DataFrame:
    """Names per manifest whose last row in table order is alive."""
    return asof.last_state(cat).groupBy("manifest").agg(F.count_if(F.col("target") != "").alias("active_files"))


def dir_stats(names: DataFrame) -> DataFrame:
    """Least and most files of a folder."""
    folder = F.regexp_extract("name", r"^(.*)/", 1)
    return names.groupBy(folder.alias("dir")).count().agg(F.min("count").alias("min_files"), F.max("count").alias("max_files"), F.count("*").alias("dirs"))


def bytes_by_day(cat: DataFrame) -> DataFrame:
    """Rows and bytes written each day, and bytes so far."""
    from pyspark.sql import Window

    day = cat.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("size").cast("bigint").alias("bytes"))
    return day.withColumn("total_bytes", F.sum("bytes").over(Window.orderBy("day")).cast("bigint"))  # a row per day


def next_ids(registry: DataFrame, floor: int = 0) -> DataFrame:
    """The next free id: above every known one and the floor."""
    return registry.agg((F.greatest(F.coalesce(F.max("inode"), F.lit(0)), F.lit(floor)) + 1).cast("decimal(20,0)").alias("next_inode"))


def with_ids(rows: DataFrame, floor: int) -> DataFrame:
    """Unique ids above a floor, without a shuffle (not dense)."""
    return rows.withColumn("inode", (F.lit(floor + 1) + F.monotonically_increasing_id()).cast("decimal(20,0)"))


def without_ids(registry: DataFrame, gone: DataFrame) -> DataFrame:
    return registry.join(gone, "inode", "left_anti")


def registry_size(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("size"))


def with_id(registry: DataFrame, inode: int) -> DataFrame:
    """The rows of an id; none if it isn't known."""
    return registry.where(F.col("inode") == inode)


def name_of(registry: DataFrame, inode: int) -> str:
    row = with_id(registry, inode).select("name").first()
    if row is None:
        raise errors.IdNotFound(inode)
    return row["name"]
