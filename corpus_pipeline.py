"""Corpus pipeline: toxicity, exact dedup, SimHash near-dedup, benchmark
decontamination, packing. Each stage reads what its predecessor wrote.

Defined cases of all stages: an empty table gives an empty one; null texts count
as empty; a null doc_id is larger than all others; rows with the same doc_id and
text are one document from exact dedup on; texts are read whole at any length;
further columns pass through all stages but the last, whatever their names. A
score right at the threshold, as any above it, rejects; of copies the smallest
doc_id stays, ties go by a hash of the text; without labels nothing is toxic,
and without items nothing is a benchmark's copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronicat.llm import common as C
from chronicat.llm import decontamination, exact_dedup, packing, simhash, toxicity


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    return toxicity.keep_clean(docs, C.read_table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text, that with the smallest doc_id."""
    C.reachable(spark)
    return exact_dedup.keep_first(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    C.reachable(spark)
    return simhash.keep_one(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontamination.keep_uncontaminated(docs, C.read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    C.reachable(spark)
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("simhash near-dedup", apart), ("decontamination", unseen), ("packing", packed)]

#: Hashes of shingles, alignment and a learned model aren't expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
