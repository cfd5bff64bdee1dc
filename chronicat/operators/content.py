"""Content-addressed blobs: dedup, put, buckets, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicat.functions import hashing


def addressed(rows: DataFrame, content: str = "content") -> DataFrame:
    sha = hashing.content_sha(F.col(content))
    return rows.withColumns({"sha": sha, "target": hashing.target(sha)})


def first_writer(rows: DataFrame, order: str) -> DataFrame:
    """One row per target, the first in order. Only keys are ranked; contents
    are joined once."""
    first = rows.groupBy("target").agg(F.min(order).alias(order))
    return rows.join(first, ["target", order], "left_semi")


def put(store: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Rows to append to a store: new targets, first writer each."""
    return first_writer(new, order).join(store.select("target"), "target", "left_anti")


def merged(new: DataFrame, old: DataFrame, key: str = "target") -> DataFrame:
    """new, and what of old it doesn't replace."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def bucket_fill(rows: DataFrame) -> DataFrame:
    b = F.split_part("target", F.lit("-"), F.lit(1)).cast("bigint")
    return rows.where("target <> ''").groupBy(b.alias("bucket")).agg(F.countDistinct("target").alias("blobs"), F.count("*").alias("refs"))


def buckets(rows: DataFrame) -> DataFrame:
    """(bucket, subbucket) of the targets in use."""
    part = lambda i: F.split_part("target", F.lit("-"), F.lit(i))
    return rows.where("target <> ''").select(part(1).alias("bucket"), part(2).alias("subbucket")).distinct()


def content_of(entries: DataFrame, members: DataFrame) -> DataFrame:
    """Entries joined to archive members by target; of several archives the
    first by name."""
    first = members.groupBy("member").agg(F.min("archive").alias("archive"))
    return entries.join(first, entries.target == first.member).drop("member")
