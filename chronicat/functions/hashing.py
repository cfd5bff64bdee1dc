"""Content addresses: ``bucket-subbucket-sha256`` and their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS, SUBBUCKETS = 1000, 100_000


def content_sha(content: Column) -> Column:
    return F.sha2(content, 256)


def bucket(sha: Column) -> Column:
    """Bucket of a digest, from its first 16 bits."""
    return F.conv(F.substring(sha, 1, 4), 16, 10).cast("bigint") % BUCKETS


def target(sha: Column, sub: int = 0) -> Column:
    return F.concat_ws("-", bucket(sha).cast("string"), F.lit(f"{sub:05d}"), sha)


def subbucket(sha: Column) -> Column:
    """Last five hex digits modulo 100000; other characters count as 0, and
    digests below five characters give 0."""
    tail = F.regexp_replace(F.lower(F.right(sha, F.lit(5))), "[^0-9a-f]", "0")
    return F.when(F.length(sha) < 5, F.lit(0)).otherwise(F.pmod(F.conv(tail, 16, 10).cast("bigint"), F.lit(SUBBUCKETS))).cast("bigint")


def hex_digit(c: Column) -> Column:
    return F.coalesce(F.when(c.rlike("^[0-9a-fA-F]$"), F.conv(c, 16, 10).cast("bigint")), F.lit(0))


def sha_of_target(t: Column) -> Column:
    """The digest of a target of exactly three parts, else null."""
    parts = F.split(t, "-")
    return F.when(F.size(parts) == 3, F.get(parts, F.lit(2)))


def work_prefix(t: Column) -> Column:
    parts = F.split(t, "-")
    return F.when(F.size(parts) >= 3, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))


def archive_prefix(t: Column) -> Column:
    parts = F.split(t, "-")
    return F.when(F.size(parts) >= 3, F.concat_ws("-", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))


def hashed_name(path: Column, sha: Column) -> Column:
    """``<dir>/<sha><ext>`` for a file path."""
    return F.concat(F.regexp_extract(path, r"^(.*/)?", 0), sha, F.regexp_extract(path, r"(\.[^./]*)$", 1))


def archive_path(work_dir: Column, base: str, data_dir: str, ext: str = ".zip") -> Column:
    """Place of the archive of a work folder: its path below base, joined by
    dashes."""
    rel = F.regexp_replace(F.when(F.startswith(work_dir, F.lit(base)), F.substring(work_dir, len(base) + 1, 10_000)).otherwise(work_dir), "^/+", "")
    return F.concat(F.lit(data_dir.rstrip("/") + "/"), F.regexp_replace(rel, "/", "-"), F.lit(ext))
