"""Archive boundaries: folders grouped so that archives stay small.

over(d) holds if d's tree has more than ``target`` files. A folder that isn't
over, below one that is (or the root), is one archive with its subfolders; a
folder that is over is one with its direct files, if it has any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET = 5000


def folder_counts(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(dir, parent, total, own) of every folder above a file (path), and of
    the given ones (dir), which may be empty."""
    parts = F.split("path", "/")
    n = F.size(parts) - 1
    each = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"), F.when(i > 0, F.array_join(F.slice(parts, F.lit(1), i - 1), "/")).alias("parent"), (i == n).cast("bigint").alias("own"), F.lit(1).cast("bigint").alias("one")),
    )
    rows = files.select(F.explode(each).alias("x")).select("x.*")
    if folders is not None:
        p = F.split("path", "/")
        up = F.transform(F.sequence(F.lit(0), F.size(p)), lambda i: F.struct(F.array_join(F.slice(p, F.lit(1), i), "/").alias("dir"), F.when(i > 0, F.array_join(F.slice(p, F.lit(1), i - 1), "/")).alias("parent"), F.lit(0).cast("bigint").alias("own"), F.lit(0).cast("bigint").alias("one")))
        rows = rows.unionByName(folders.select(F.col("dir").alias("path")).where("path <> ''").select(F.explode(up).alias("x")).select("x.*"))
    return rows.groupBy("dir", "parent").agg(F.sum("one").alias("total"), F.sum("own").alias("own"))


def over(files: DataFrame, target: int = TARGET) -> DataFrame:
    """(dir, total, is_over): the true total, not one cut off at the target."""
    return folder_counts(files).select("dir", "total", (F.col("total") > target).alias("is_over"))


def boundaries(files: DataFrame, target: int = TARGET, folders: DataFrame | None = None) -> DataFrame:
    """(path, include_subdirs, files)."""
    t = folder_counts(files, folders)
    q = t.select(F.col("dir").alias("q_dir"), F.col("total").alias("q_total"))
    j = t.join(q, t.parent == q.q_dir, "left")
    small, root = F.col("total") <= target, F.col("parent").isNull()
    keep = (small & (root | (F.col("q_total") > target))) | (~small & (F.col("own") > 0))
    return j.where(keep).select(F.col("dir").alias("path"), small.alias("include_subdirs"), F.when(small, F.col("total")).otherwise(F.col("own")).alias("files"))


def assigned(files: DataFrame, target: int = TARGET) -> DataFrame:
    """(path, boundary, include_subdirs): the highest folder above a file that
    isn't over, else its own folder."""
    n = F.size(F.split("path", "/"))
    up = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/").alias("dir")))).alias("x")).select("path", "x.depth", "x.dir")
    with_over = up.join(over(files, target), "dir")
    best = with_over.groupBy("path").agg(F.min(F.when(~F.col("is_over"), F.col("depth"))).alias("top"), F.max("depth").alias("own"))
    depth = F.coalesce("top", "own")
    return best.select("path", F.array_join(F.slice(F.split("path", "/"), F.lit(1), depth), "/").alias("boundary"), F.col("top").isNotNull().alias("include_subdirs"))
