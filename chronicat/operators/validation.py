"""Consistency of archives: findings, preview, repair.

Inputs: entries (archive, pos, name, target, size, ts), members (archive,
member), stored metadata (archive, total_file_count, target_file_count) and
damaged archives (archive)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicat.operators import asof, stats
from chronicat.sources.archives import MANIFEST, METADATA

RESERVED = (MANIFEST, METADATA)


def missing_targets(entries: DataFrame, members: DataFrame) -> DataFrame:
    """A row per living entry whose content isn't in its archive."""
    m = members.select("archive", F.col("member").alias("target"))
    return asof.alive(entries).join(m, ["archive", "target"], "left_anti")


def orphans(entries: DataFrame, members: DataFrame) -> DataFrame:
    """Members, but for the reserved ones, that no entry names."""
    e = asof.alive(entries).select("archive", F.col("target").alias("member"))
    return members.where(~F.col("member").isin(*RESERVED)).select("archive", "member").distinct().join(e, ["archive", "member"], "left_anti")


def recount(entries: DataFrame) -> DataFrame:
    return stats.metadata(entries.withColumn("manifest", F.col("archive"))).withColumnRenamed("manifest", "archive")


def mismatches(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """(archive, field, stored, actual) where metadata and rows disagree."""
    names = ("total_file_count", "target_file_count")
    real = recount(entries).select("archive", *[F.col(n).alias(f"real_{n}") for n in names])
    j = stored.join(real, "archive")
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("bigint").alias("stored"), F.col(f"real_{n}").alias("actual")) for n in names])
    return j.select("archive", F.explode(each).alias("x")).select("archive", "x.*").where("stored <> actual")


def findings(archives: DataFrame, entries: DataFrame, members: DataFrame, stored: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """(archive, kind, context). A damaged archive has that finding alone."""
    row = lambda df, kind, ctx: df.select("archive", F.lit(kind).alias("kind"), ctx.alias("context"))
    bad = damaged.select("archive").distinct() if damaged is not None else archives.limit(0).select("archive")
    fine = lambda df: df.join(bad, "archive", "left_anti")
    has = lambda name: members.where(F.col("member") == name).select("archive").distinct()
    out = row(bad, "corrupted", F.lit(""))
    out = out.unionByName(row(fine(archives).join(has(MANIFEST), "archive", "left_anti"), "missing manifest", F.lit("")))
    out = out.unionByName(row(fine(archives).join(has(METADATA), "archive", "left_anti"), "missing metadata", F.lit("")))
    out = out.unionByName(row(fine(missing_targets(entries, members)), "missing target", F.concat_ws(": ", "name", "target")))
    out = out.unionByName(row(fine(orphans(entries, members)), "orphan", F.col("member")))
    return out.unionByName(row(fine(mismatches(entries, stored)), "metadata mismatch", F.concat_ws(" ", "field", F.col("stored").cast("string"), F.col("actual").cast("string"))))


def summary(archives: DataFrame, found: DataFrame) -> DataFrame:
    a = archives.agg(F.countDistinct("archive").alias("archives_checked"))
    f = found.agg(F.countDistinct("archive").alias("archives_with_errors"), F.count("*").alias("total_errors"))
    return a.crossJoin(f)  # one row each


def preview(found: DataFrame) -> DataFrame:
    """What a repair would do to each archive."""
    kind = F.col("kind")
    return found.groupBy("archive").agg(
        F.bool_or(kind.isin("missing metadata", "metadata mismatch")).alias("metadata_regenerated"),
        F.count_if(kind == "orphan").alias("orphaned_files_removed"),
        F.count_if(kind == "missing target").alias("missing_entries_fixed"),
        (~F.bool_or(kind.isin("corrupted", "missing manifest"))).alias("repairable"),
    )


def rendered(found: DataFrame) -> DataFrame:
    """(archive, message) of every finding: its kind and what it is about."""
    return found.select("archive", F.when(F.col("context") == "", F.col("kind")).otherwise(F.concat_ws(": ", "kind", "context")).alias("message"))


def joined(found: DataFrame) -> DataFrame:
    """(archive, errors): the messages of each archive as one, in order. An
    archive's findings are few; they are bounded by its rows and members."""
    return rendered(found).groupBy("archive").agg(F.array_join(F.sort_array(F.collect_list("message")), "\n").alias("errors"))


def rendered_plan(plan: DataFrame) -> DataFrame:
    """(archive, summary): what a repair would do, in words."""
    parts = F.concat_ws(
        ", ",
        F.when(F.col("metadata_regenerated"), F.lit("metadata regenerated")),
        F.when(F.col("orphaned_files_removed") > 0, F.concat(F.col("orphaned_files_removed").cast("string"), F.lit(" orphaned removed"))),
        F.when(F.col("missing_entries_fixed") > 0, F.concat(F.col("missing_entries_fixed").cast("string"), F.lit(" missing entries fixed"))),
    )
    return plan.select("archive", F.when(~F.col("repairable"), "not repairable").when(parts == "", "nothing to do").otherwise(parts).alias("summary"))


def repaired(entries: DataFrame, members: DataFrame, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, members, metadata) without orphans and dangling entries;
    tombstones stay. Archives that can't be repaired are returned as they are."""
    stuck = None if found is None else found.where(F.col("kind").isin("corrupted", "missing manifest")).select("archive").distinct()
    m = members.select("archive", F.col("member").alias("target")).distinct()
    e = entries.where("target = ''").unionByName(asof.alive(entries).join(m, ["archive", "target"], "left_semi"))
    used = asof.alive(e).select("archive", F.col("target").alias("member")).distinct()
    kept = members.where(F.col("member").isin(*RESERVED)).unionByName(members.where(~F.col("member").isin(*RESERVED)).join(used, ["archive", "member"], "left_semi"))
    if stuck is not None:
        same = lambda new, old: new.join(stuck, "archive", "left_anti").unionByName(old.join(stuck, "archive", "left_semi"))
        e, kept = same(e, entries), same(kept, members)
    return e, kept, recount(e)


def altered(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """Entries whose content has another digest than their target says, each
    once. Contents are compared before they meet entries: many entries and many
    copies share a target, and their pairs grow with the square."""
    c = contents.select("archive", F.col("member").alias("target"), F.sha2("content", 256).alias("actual"))
    bad = c.where(F.split_part("target", F.lit("-"), F.lit(3)) != F.col("actual")).select("archive", "target").distinct()
    return asof.alive(entries).join(bad, ["archive", "target"], "left_semi")
