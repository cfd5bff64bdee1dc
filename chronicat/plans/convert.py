"""Bulk conversion of a folder: scan, address, boundaries, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronicat.functions import hashing
from chronicat.operators import boundaries, content, stats
from chronicat.sources import archives, catalog

#: Bytes that an archive of contents holds, about.
ARCHIVE_BYTES = 512 << 20


def plan(spark: SparkSession, root: str, target: int = boundaries.TARGET) -> DataFrame:
    """Catalog rows of a folder's files with their boundary; writes nothing."""
    files = catalog.scan_files(spark, root)
    of = boundaries.assigned(files.select(F.col("name").alias("path")), target)
    rows = files.join(of, files.name == of.path).drop(of.path)
    cut = F.when(F.col("boundary") == "", F.col("name")).otherwise(F.expr("substring(name, length(boundary) + 2)"))
    return rows.select(F.col("boundary").alias("manifest"), cut.alias("name"), "target", "size", "ts", "inode", "content", "include_subdirs")


def positioned(rows: DataFrame) -> DataFrame:
    """rows with pos: the order of ts and name within a manifest."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("manifest").orderBy("ts", "name")).cast("bigint") - 1)


def archive_members(log: DataFrame, contents: DataFrame) -> DataFrame:
    """(archive, member, content): for each manifest of the log its document,
    its metadata and the contents (target, content) that it names."""
    name = F.concat(F.when(F.col("manifest") == "", F.lit("root")).otherwise(F.col("manifest")), F.lit(archives.ARCHIVE))
    log = catalog.with_modified(log)
    documents = catalog.envelope(log).select(name.alias("archive"), F.lit(archives.MANIFEST).alias("member"), F.encode("value", "UTF-8").alias("content"))
    meta = stats.metadata(log).select(name.alias("archive"), F.lit(archives.METADATA).alias("member"), F.encode(F.to_json(F.struct(*[c for c in stats.FIELDS])), "UTF-8").alias("content"))
    held = log.where("target <> ''").select("manifest", "target").distinct().join(contents, "target").select(name.alias("archive"), F.col("target").alias("member"), "content")
    return documents.unionByName(meta).unionByName(held)


def convert(spark: SparkSession, root: str, out: str, target: int = boundaries.TARGET, packed: bool = True) -> DataFrame:
    """Write log, blobs and metadata below ``out`` as Parquet, and (packed) an
    archive per boundary below ``out``/data; returns the global metadata. The
    input isn't touched."""
    rows = plan(spark, root, target)
    positioned(rows.drop("content")).write.mode("overwrite").parquet(f"{out}/log")
    blobs = rows.select("target", "content").dropDuplicates(["target"])
    blobs.withColumn("bucket", F.split_part("target", F.lit("-"), F.lit(1))).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/blobs")
    log = spark.read.parquet(f"{out}/log")
    stats.metadata(log).write.mode("overwrite").parquet(f"{out}/metadata")
    if packed:
        archives.write_archives(archive_members(log, spark.read.parquet(f"{out}/blobs").select("target", "content")), f"{out}/data").count()
    return stats.metadata_global(log)


def pack_buckets(blobs: DataFrame, root: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of (target, content) by bucket; a bucket of more than ``most``
    bytes is split by the digest's sub-bucket."""
    own = blobs.select("target", "content", F.split_part("target", F.lit("-"), F.lit(1)).alias("bucket"))
    total = own.groupBy("bucket").agg(F.ceil(F.sum(F.length("content")) / most).alias("parts"))  # at most BUCKETS rows
    sub = F.pmod(hashing.subbucket(hashing.sha_of_target(F.col("target"))), F.greatest("parts", F.lit(1)))
    name = F.concat("bucket", F.lit("-"), F.lpad(sub.cast("string"), 5, "0"), F.lit(archives.ARCHIVE))
    return archives.write_archives(own.join(F.broadcast(total), "bucket").select(name.alias("archive"), F.col("target").alias("member"), "content"), root)


def repack_buckets(blobs: DataFrame, old_members: DataFrame, root: str) -> DataFrame:
    """Archives of new blobs merged with what the old ones held."""
    old = old_members.where("not corrupted").select(F.col("member").alias("target"), "content")
    return pack_buckets(content.merged(blobs.select("target", "content"), old), root)
