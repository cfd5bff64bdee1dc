"""Micro-batch ingestion: files landing in a folder become blobs and log rows.

Each batch writes its own folder of the log and of the blobs, keyed by batch
id, so a replay overwrites what it wrote and nothing is doubled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronicat.functions import hashing
from chronicat.sources import stores
from chronicat.sources.catalog import FILES

LOG = "manifest string, pos bigint, name string, target string, size bigint, ts timestamp"
BLOBS = "target string, content binary"


def landing(spark: SparkSession, folder: str, clean: str = "off", archive: str | None = None) -> DataFrame:
    """Files that land in a folder. ``clean`` says what becomes of those that
    are committed: off, delete, or archive (moved below ``archive``)."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("cleanSource", clean)
    return (reader.option("sourceArchiveDir", archive) if archive else reader).load(folder)


def rows_of(files: DataFrame, folder: str, manifest: str = "") -> DataFrame:
    """Log rows and contents; empty files aren't persisted."""
    name = stores.below(files.sparkSession, F.col("path"), folder)
    sha = hashing.content_sha(F.col("content"))
    return files.where("length > 0").select(F.lit(manifest).alias("manifest"), name.alias("name"), hashing.target(sha).alias("target"), F.col("length").alias("size"), F.col("modificationTime").alias("ts"), "content")


def read_log(spark: SparkSession, store: str) -> DataFrame:
    """The committed log; pos grows with the batch."""
    return spark.read.schema(LOG + ", batch bigint").parquet(f"{store}/log")


def read_blobs(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(BLOBS + ", batch bigint, bucket bigint").parquet(f"{store}/blobs")


def placed(rows: DataFrame, batch_id: int) -> DataFrame:
    """rows with pos: their place by ts and name in the batch, above those of
    earlier batches. Ranges are sorted apart and counted; a count per partition
    goes to the driver."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = rows.repartitionByRange(parts, "ts", "name").sortWithinPartitions("ts", "name")
    sort = sort.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).persist()
    counts = {r["__part"]: r["count"] for r in sort.groupBy("__part").count().collect()}
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    before = spark.createDataFrame(offsets, "__part int, __before bigint")
    out = sort.join(F.broadcast(before), "__part")
    return out.withColumn("pos", F.lit(batch_id << 40) + F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def commit(batch: DataFrame, batch_id: int, folder: str, store: str, manifest: str = "") -> None:
    """Write one batch: new blobs first, so no log row lacks its content. Only
    buckets that the batch touches are read."""
    spark = batch.sparkSession
    rows = rows_of(batch, folder, manifest).persist()
    try:
        blobs = rows.select("target", "content").dropDuplicates(["target"]).withColumn("bucket", F.split_part("target", F.lit("-"), F.lit(1)).cast("bigint"))
        touched = [r["bucket"] for r in blobs.select("bucket").distinct().collect()]  # at most BUCKETS
        old = _before(spark, f"{store}/blobs", BLOBS, batch_id, touched)
        new = blobs.join(old.select("target"), "target", "left_anti")
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/blobs/batch={batch_id}")
        placed(rows.drop("content"), batch_id).write.mode("overwrite").parquet(f"{store}/log/batch={batch_id}")
    finally:
        rows.unpersist()


def _before(spark: SparkSession, path: str, schema: str, batch_id: int, buckets: list[int]) -> DataFrame:
    if not stores.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", batch bigint, bucket bigint").parquet(path).where((F.col("batch") < batch_id) & F.col("bucket").isin(buckets))


def start(spark: SparkSession, folder: str, store: str, manifest: str = "", every: str | None = "30 seconds", clean: str = "off", archive: str | None = None) -> StreamingQuery:
    """Run until stopped; with every=None take what is there and end."""
    writer = landing(spark, folder, clean, archive).writeStream.option("checkpointLocation", f"{store}/checkpoint")
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.foreachBatch(lambda df, i: commit(df, i, folder, store, manifest)).start()
