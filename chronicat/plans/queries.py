"""The registered queries: each operator over whole driver tables.

The events table is read as the change log of a catalog; its archives are the
targets but for those in one bucket of seven, with a few members nobody names."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronicat.functions import bytes as ranges
from chronicat.functions import hashing, paths
from chronicat.operators import asof, boundaries, content, listing, stats, validation
from chronicat.sources import archives, catalog

MID = datetime(2024, 1, 15, 23, 59, 59)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


cat = catalog.events_catalog


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _members(spark: SparkSession, sf: str) -> DataFrame:
    c = cat(spark, sf)
    held = asof.alive(c).where("try_cast(split_part(target, '-', 1) as bigint) % 7 <> 0").select(F.col("manifest").alias("archive"), F.col("target").alias("member")).distinct()
    junk = c.where("pos % 97 = 0").select(F.col("manifest").alias("archive"), F.concat(F.lit("junk-"), F.col("pos").cast("string")).alias("member"))
    each = c.select(F.col("manifest").alias("archive")).distinct()
    own = each.where("archive <> 'site3'").select("archive", F.lit(catalog.MANIFEST).alias("member"))
    meta = each.where("archive <> 'site4'").select("archive", F.lit(catalog.METADATA).alias("member"))
    return held.unionByName(junk).unionByName(own).unionByName(meta)


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return cat(spark, sf).withColumnRenamed("manifest", "archive")


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    real = validation.recount(_entries(spark, sf))
    wrong = F.when(F.col("archive") == "site5", 1).otherwise(0)
    return real.select("archive", (F.col("total_file_count") + wrong).alias("total_file_count"), "target_file_count")


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    e = _entries(spark, sf)
    archives = e.select("archive").distinct()
    return validation.findings(archives, e, _members(spark, sf), _stored(spark, sf), archives.where("archive = 'site9'"))


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    return cat(spark, sf).select(F.col("pos").alias("inode"), "name")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return cat(spark, sf).select(F.concat_ws("/", "manifest", "name").alias("path")).distinct()


@query
def asof_snapshot(spark, sf):
    return asof.snapshot(cat(spark, sf), MID)


@query
def asof_point(spark, sf):
    return asof.point(cat(spark, sf), "site3", "dev3/click.json", MID)


@query
def asof_prefix(spark, sf):
    return asof.under_prefix(cat(spark, sf), "dev1", MID)


@query
def prefix_exists_asof(spark, sf):
    return asof.any_under(cat(spark, sf), "dev10/", MID)


@query
def prefix_exists(spark, sf):
    return asof.any_under(cat(spark, sf), "dev99999/")


@query
def live_latest(spark, sf):
    return asof.live(cat(spark, sf))


@query
def live_first(spark, sf):
    return asof.live(cat(spark, sf), "first")


@query
def live_prefix_versions(spark, sf):
    return asof.versions_under(cat(spark, sf), "dev10/")


@query
def collapse(spark, sf):
    return asof.collapse(cat(spark, sf))


@query
def last_state(spark, sf):
    return asof.last_state(cat(spark, sf))


@query
def active_count(spark, sf):
    return stats.active_count(cat(spark, sf))


@query
def version_history(spark, sf):
    return asof.history(cat(spark, sf))


@query
def table_remove_position(spark, sf):
    return asof.without_position(cat(spark, sf), 42)


@query
def table_get_position(spark, sf):
    return asof.at_position(cat(spark, sf), 42)


@query
def tombstone_append(spark, sf):
    return asof.snapshot(asof.removed(cat(spark, sf), "site3", "dev3/click.json", datetime(2024, 2, 1)))


@query
def file_attributes(spark, sf):
    return asof.attributes(cat(spark, sf))


@query
def oldest_newest(spark, sf):
    return cat(spark, sf).groupBy("manifest").agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


@query
def dir_children_asof(spark, sf):
    return listing.children(cat(spark, sf), "", MID)


@query
def dir_children_asof_nested(spark, sf):
    return listing.children(cat(spark, sf), "dev3", MID)


@query
def dir_children_live(spark, sf):
    return listing.children(cat(spark, sf), "dev3", live=True)


@query
def calendar_years(spark, sf):
    return listing.calendar(cat(spark, sf))


@query
def calendar_months(spark, sf):
    return listing.calendar(cat(spark, sf), "2024")


@query
def calendar_days(spark, sf):
    return listing.calendar(cat(spark, sf), "2024", "01")


@query
def calendar_months_orders(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"))
    return listing.calendar(o, "1995")


@query
def snapshot_dates(spark, sf):
    return listing.snapshot_dates(cat(spark, sf))


@query
def calendar_rollup(spark, sf):
    return listing.calendar_rollup(cat(spark, sf))


@query
def metadata_by_manifest(spark, sf):
    return stats.metadata(cat(spark, sf)).drop("engine_version")


@query
def metadata_global(spark, sf):
    return stats.metadata_global(cat(spark, sf))


@query
def bytes_by_day(spark, sf):
    return stats.bytes_by_day(cat(spark, sf))


@query
def dir_stats(spark, sf):
    return stats.dir_stats(_files(spark, sf).withColumnRenamed("path", "name"))


@query
def next_inode(spark, sf):
    return stats.next_ids(_table(spark, sf, "events").select(F.col("event_id").cast("decimal(20,0)").alias("inode")), 500)


@query
def registry_size(spark, sf):
    return stats.registry_size(_registry(spark, sf))


@query
def registry_lookup(spark, sf):
    return stats.with_id(_registry(spark, sf), 42)


@query
def registry_remove(spark, sf):
    ids = _registry(spark, sf).select("inode")
    return stats.without_ids(ids, ids.where("inode % 3 = 0"))


@query
def cas_target(spark, sf):
    d = content.addressed(_table(spark, sf, "documents"), "text")
    return d.select("doc_id", "sha", "target", hashing.subbucket(F.col("sha")).alias("subbucket"))


@query
def cas_dedup(spark, sf):
    d = content.addressed(_table(spark, sf, "documents"), "text")
    return d.groupBy("target").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("refs"))


@query
def cas_put(spark, sf):
    d = content.addressed(_table(spark, sf, "documents"), "text").select("doc_id", "target")
    old, new = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    return content.put(old, new, "doc_id")


@query
def merge_bucket_keep_new(spark, sf):
    d = content.addressed(_table(spark, sf, "documents"), "text").select("doc_id", "target")
    old, new = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    return content.merged(new, old)


@query
def bucket_fill(spark, sf):
    return content.bucket_fill(cat(spark, sf))


@query
def list_buckets(spark, sf):
    return content.buckets(cat(spark, sf))


@query
def content_join(spark, sf):
    return content.content_of(asof.snapshot(cat(spark, sf)), _members(spark, sf)).select("manifest", "name", "target", "archive")


@query
def hash_path_parse(spark, sf):
    t = F.col("target")
    return cat(spark, sf).select("pos", hashing.sha_of_target(t).alias("sha"), hashing.work_prefix(t).alias("work"), hashing.archive_prefix(t).alias("zip"))


@query
def hash_name(spark, sf):
    p = _table(spark, sf, "pages")
    return p.select("page_id", hashing.hashed_name(F.col("url"), F.sha2("html", 256)).alias("name"))


@query
def zip_path(spark, sf):
    work = F.concat(F.lit("/store/work/"), hashing.work_prefix(F.col("target")))
    return asof.alive(cat(spark, sf)).select("pos", hashing.archive_path(work, "/store/work", "/store/data").alias("path"))


@query
def hex_digits(spark, sf):
    c = F.substring("props", F.lit(3), F.lit(1))
    return cat_props(spark, sf).select("event_id", hashing.hex_digit(c).alias("digit"))


def cat_props(spark, sf):
    return _table(spark, sf, "events").select("event_id", "props")


@query
def path_overlap(spark, sf):
    f = _files(spark, sf)
    dirs = spark.createDataFrame([("site1",), ("site1/dev1",), ("site1/dev11",), ("site",)], "dir string")
    return f.join(F.broadcast(dirs), paths.overlap(F.col("path"), F.col("dir"))).select("path", "dir")


@query
def date_validity(spark, sf):
    e = _table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy").alias("y"), F.date_format("ts", "MM").alias("m"), F.lpad((F.col("event_id") % 33).cast("string"), 2, "0").alias("d"))
    return e.select("event_id", paths.date_valid(F.col("y"), F.col("m"), F.col("d")).alias("valid"))


@query
def day_snapshot_cutoff(spark, sf):
    c = cat(spark, sf)
    days = c.select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    return days.select("day", paths.day_end(F.col("day")).alias("cutoff"))


@query
def nearest_manifest(spark, sf):
    f = _files(spark, sf)
    dirs = f.where("path like '%/dev%7/%'").select(F.regexp_extract("path", "^(.*)/", 1).alias("dir")).unionByName(f.select(F.substring_index("path", "/", 1).alias("dir"))).distinct()
    return listing.nearest_manifest(f, dirs)


@query
def find_entries_asof(spark, sf):
    return listing.find_entries(_files(spark, sf), cat(spark, sf), MID).select("path", "manifest", "name", "target", "ts")


@query
def boundary_counts(spark, sf):
    return boundaries.over(_files(spark, sf), 30)


@query
def archive_boundaries(spark, sf):
    return boundaries.boundaries(_files(spark, sf), 30)


@query
def archive_boundaries_small(spark, sf):
    return boundaries.boundaries(_files(spark, sf), 4)


@query
def file_to_boundary(spark, sf):
    return boundaries.assigned(_files(spark, sf), 30)


@query
def missing_targets(spark, sf):
    return validation.missing_targets(_entries(spark, sf), _members(spark, sf)).select("archive", "pos", "name", "target")


@query
def orphans(spark, sf):
    return validation.orphans(_entries(spark, sf), _members(spark, sf))


@query
def metadata_mismatch(spark, sf):
    return validation.mismatches(_entries(spark, sf), _stored(spark, sf))


@query
def validate_findings(spark, sf):
    return _findings(spark, sf)


@query
def validate_summary(spark, sf):
    return validation.summary(_entries(spark, sf).select("archive"), _findings(spark, sf))


@query
def repair_preview(spark, sf):
    return validation.preview(_findings(spark, sf))


@query
def repair_entries(spark, sf):
    return validation.repaired(_entries(spark, sf), _members(spark, sf))[0].select("archive", "pos", "name", "target")


@query
def repair_members(spark, sf):
    return validation.repaired(_entries(spark, sf), _members(spark, sf))[1].select("archive", "member")


@query
def repair_metadata(spark, sf):
    return validation.repaired(_entries(spark, sf), _members(spark, sf))[2].select("archive", "total_file_count", "target_file_count", "uncompressed_size")


@query
def archive_member_counts(spark, sf):
    return archives.member_counts(_members(spark, sf))


@query
def manifest_envelope(spark, sf):
    c = cat(spark, sf).withColumns({"inode": F.col("pos").cast("decimal(20,0)"), "modified": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")})
    back = catalog.envelope(c).select("manifest", F.from_json("value", "struct<entries:array<" + catalog.ENTRY + ">,sorted:boolean>").alias("d"))
    return catalog.exploded(back.select("manifest", "d.entries")).select("manifest", F.col("pos"), "name", "target", "size")


@query
def seed_shape(spark, sf):
    return catalog.seed(spark).select("name", "ts", hashing.target(F.sha2("content", 256)).alias("target"))


@query
def log_order(spark, sf):
    return asof.sequence(cat(spark, sf)).select("manifest", "seq", "pos", "name", "ts")


@query
def scan_all(spark, sf):
    """Every manifest written and read back, all rows as one table."""
    c = cat(spark, sf).withColumns({"inode": F.col("pos").cast("decimal(20,0)")})
    back = catalog.envelope(catalog.with_modified(c)).select("manifest", F.from_json("value", "struct<entries:array<" + catalog.ENTRY + ">,sorted:boolean>").alias("d"))
    return catalog.exploded(back.select("manifest", "d.entries")).select("manifest", "name", "target", "size", F.to_timestamp_ntz(F.substring("modified", 1, 26)).alias("ts"))


@query
def dir_children_by_name(spark, sf):
    rows = listing.by_name(listing.children(cat(spark, sf), "dev3/", MID))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("entry")).cast("bigint"))


@query
def folder_attributes(spark, sf):
    return asof.folder_attributes(cat(spark, sf))


@query
def error_join(spark, sf):
    return validation.joined(_findings(spark, sf))


@query
def repair_summary(spark, sf):
    return validation.rendered_plan(validation.preview(_findings(spark, sf)))


@query
def content_overlay(spark, sf):
    raw, at = F.encode("text", "UTF-8"), (F.col("doc_id") % 200).cast("int")
    return _table(spark, sf, "documents").select("doc_id", F.sha2(ranges.written(raw, F.encode(F.lit("PATCHED"), "UTF-8"), at), 256).alias("written"), F.sha2(ranges.truncated(raw, F.lit(300)), 256).alias("truncated"))


@query
def validate_altered(spark, sf):
    """Contents that aren't what their target says: one in thirteen is cut."""
    c = asof.alive(cat(spark, sf, "props"))
    held = c.select(F.col("manifest").alias("archive"), F.col("target").alias("member"), F.encode(F.when(F.col("pos") % 13 == 0, F.substring("props", 2, 1 << 20)).otherwise(F.col("props")), "UTF-8").alias("content"))
    return validation.altered(_entries(spark, sf), held).select("archive", "pos", "name").distinct()


@query
def scan_members(spark, sf):
    """Whether each archive holds its manifest (member lookup)."""
    m = _members(spark, sf)
    return m.groupBy("archive").agg(F.bool_or(F.col("member") == archives.MANIFEST).alias("has_manifest"), F.bool_or(F.col("member") == archives.METADATA).alias("has_metadata"))


@query
def own_files(spark, sf):
    """Names that a scan keeps: those that aren't the engine's own."""
    m = _members(spark, sf)
    return m.where(~F.col("member").rlike(catalog.OWN)).groupBy("archive").agg(F.count("*").alias("kept"))


@query
def path_depth(spark, sf):
    f = _files(spark, sf)
    return f.select("path", (F.size(F.split("path", "/")) - 1).cast("bigint").alias("depth"), catalog.is_archive(F.col("path")).alias("is_archive"))


@query
def seed_by_depth(spark, sf):
    """The mix of folder depths of the seeded files."""
    return catalog.seed(spark).groupBy(F.size(F.split("folder", "/")).cast("bigint").alias("depth")).agg(F.count("*").alias("files"), F.countDistinct("content").alias("contents"))
