"""Where catalog rows come from: manifests, file scans, tables and a generator;
and how manifests are written."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicat import errors
from chronicat.functions import hashing
from chronicat.sources import stores
from chronicat.sources.archives import ARCHIVE, MANIFEST, METADATA

ENTRY = "struct<size:bigint,inode:decimal(20,0),modified:string,name:string,target:string>"
ENVELOPE = f"entries array<{ENTRY}>, sorted boolean"
FILES = "path string, modificationTime timestamp, length bigint, content binary"
#: Files of the engine's own, which a scan leaves out.
OWN = r"(^|/)(manifest|metadata)\.json$|\.(zip|bak|lock|part|new)$"


def with_time(rows: DataFrame) -> DataFrame:
    """Adds ts (instant) and local_date (day in the entry's own offset)."""
    return rows.withColumns({"ts": F.try_to_timestamp("modified"), "local_date": F.substring("modified", 1, 10)})


def exploded(envelopes: DataFrame) -> DataFrame:
    """Catalog rows from (manifest, entries, sorted); empty manifests vanish."""
    rows = envelopes.select("manifest", F.posexplode_outer("entries").alias("pos", "e")).where("e is not null")
    return with_time(rows.select("manifest", F.col("pos").cast("bigint").alias("pos"), "e.name", F.coalesce("e.target", F.lit("")).alias("target"), "e.size", "e.inode", "e.modified"))


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all manifests below a folder; ``manifest`` is the folder of each
    below the root ('' for one in the root). Unreadable ones give no rows."""
    files = spark.read.schema(ENVELOPE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", MANIFEST).json(root)
    name = stores.below(spark, stores.decoded(F.col("_metadata.file_path")), root)
    return exploded(files.select(F.regexp_replace(name, f"/?{MANIFEST}$", "").alias("manifest"), "entries", "sorted"))


def envelope(rows: DataFrame) -> DataFrame:
    """(manifest, value): one JSON document per manifest, entries by pos."""
    e = F.struct("pos", F.struct("size", "inode", "modified", "name", "target").alias("e"))
    grouped = rows.groupBy("manifest").agg(F.sort_array(F.collect_list(e)).alias("all"))
    return grouped.select("manifest", F.to_json(F.struct(F.transform("all", lambda x: x["e"]).alias("entries"), F.lit(True).alias("sorted"))).alias("value"))


def with_modified(rows: DataFrame) -> DataFrame:
    """Adds the text of ts, where rows have none."""
    if "modified" in rows.columns:
        return rows
    zone = "" if dict(rows.dtypes)["ts"] == "timestamp_ntz" else "XXX"
    text = F.date_format("ts", f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{zone}")
    return rows.withColumn("modified", F.concat(text, F.lit("Z")) if not zone else text)


def _documents(batches, root: str):
    for b in batches:
        for manifest, value in zip(b.column("manifest").to_pylist(), b.column("value").to_pylist(), strict=True):
            stores.put("/".join(filter(None, (root, manifest, MANIFEST))), value.encode() + b"\n")
        yield b.select(["manifest"])


def write_manifests(rows: DataFrame, root: str) -> int:
    """One JSON document per manifest, in the folder of its name below root,
    as ``read_manifests`` reads it; returns how many. A document replaces the
    one before only when it is whole."""
    rows = with_modified(rows)
    rows = rows if "inode" in rows.columns else rows.withColumn("inode", F.lit(0).cast("decimal(20,0)"))
    root = stores.qualified(rows.sparkSession, root)
    return envelope(rows).mapInArrow(partial(_documents, root=root), "manifest string").count()


def scan_files(spark: SparkSession, root: str, recursive: bool = True, skip: str = OWN) -> DataFrame:
    """One row per regular file but the engine's own: path, name (below root),
    size, ts, inode (of the path, as stores have none), sha, target, content."""
    if not stores.is_folder(spark, root):
        raise errors.ExpectedFolder(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).where(~F.col("path").rlike(skip))
    name = stores.below(spark, F.col("path"), root)
    inode = F.conv(F.hex(F.xxhash64("path")), 16, 10).cast("decimal(20,0)")
    out = files.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("ts"), inode.alias("inode"), hashing.content_sha(F.col("content")).alias("sha"), "content")
    return out.withColumn("target", hashing.target(F.col("sha")))


def count_files(spark: SparkSession, root: str) -> int:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path").count()


def counts_by_folder(spark: SparkSession, root: str) -> DataFrame:
    """(folder, files) of the folders right below root, '' for its own files."""
    name = stores.below(spark, F.col("path"), root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(name.alias("name"))
    return files.groupBy(F.when(F.contains("name", F.lit("/")), F.substring_index("name", "/", 1)).otherwise("").alias("folder")).agg(F.count("*").alias("files"))


def archive_manifests(members: DataFrame) -> DataFrame:
    """Catalog rows of the manifests inside archives."""
    inside = members.where(F.col("member") == MANIFEST).select(F.col("archive").alias("manifest"), F.from_json(F.col("content").cast("string"), f"struct<{ENVELOPE.replace(' array', ':array').replace(' boolean', ':boolean')}>").alias("d"))
    return exploded(inside.select("manifest", "d.entries", "d.sorted"))


def is_archive(path: F.Column) -> F.Column:
    return F.endswith(path, F.lit(ARCHIVE))


def stored_metadata(members: DataFrame) -> DataFrame:
    """(archive, total_file_count, target_file_count) that archives tell."""
    inside = members.where(F.col("member") == METADATA).select("archive", F.from_json(F.col("content").cast("string"), "total_file_count bigint, target_file_count bigint").alias("m"))
    return inside.select("archive", "m.*")


def events_catalog(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The events table read as a change log of files, with more of its columns."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sha = hashing.content_sha(F.col("props"))
    return e.select(
        F.concat(F.lit("site"), (F.col("user_id") % 10).cast("string")).alias("manifest"),
        F.col("event_id").alias("pos"),
        F.concat(F.lit("dev"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"), F.lit(".json")).alias("name"),
        F.when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(hashing.target(sha)).alias("target"),
        F.length("props").cast("bigint").alias("size"),
        F.col("ts"),
        *more,
    )


def seed(spark: SparkSession, files: int = 10_000, contents: int = 50, per_dir: int = 1000, key: int = 42) -> DataFrame:
    """A deterministic catalog of generated files: name, content, ts, folder.
    Dates are uniform over a year; depths follow a fixed mix."""
    n = F.col("id")
    roll = lambda k, m: F.conv(F.substring(F.sha2(F.concat_ws("-", n.cast("string"), F.lit(str(key + k))), 256), 1, 12), 16, 10).cast("bigint") % m
    ts = F.timestamp_add("SECOND", roll(0, 365 * 86_400), F.to_timestamp_ntz(F.lit("2024-01-01")))
    depth = roll(1, 100)
    levels = F.when(depth < 5, 1).when(depth < 10, 2).when(depth < 15, 3).when(depth < 25, 4).when(depth < 40, 5).otherwise(6)
    folder = F.array_join(F.slice(F.split(F.date_format(ts, "yyyy/MM/dd/HH/mm/ss"), "/"), F.lit(1), levels), "/")
    content = F.concat(F.sha2(roll(2, contents).cast("string"), 256), F.lit("\n"))
    ext = F.when(roll(3, 2) == 0, ".json").otherwise(".txt")
    part = F.concat(F.lit("part"), F.lpad(F.floor(n / per_dir).cast("string"), 6, "0"))  # bounds a folder
    return spark.range(files).select(F.concat_ws("/", folder, part, F.concat(F.lpad(F.lower(F.hex(n)), 8, "0"), ext)).alias("name"), content.alias("content"), ts.alias("ts"), folder.alias("folder"))


def _seed_files(batches, root: str):
    for b in batches:
        for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
            stores.put(f"{root}/{name}", content.encode())
        yield b.select(["name"])


def write_seed(rows: DataFrame, root: str) -> int:
    """The seeded files themselves, below root; returns how many."""
    return rows.select("name", "content").repartition("name").mapInArrow(partial(_seed_files, root=stores.qualified(rows.sparkSession, root)), "name string").count()
