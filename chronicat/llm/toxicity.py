"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and
skip-grams. L1 leaves few weights, which are broadcast to score every text.

Defined cases: null text is empty and scores the bias; a document with several
labels counts as toxic if one says so; labels without a document and null
labels teach nothing; of several texts of one doc_id the least is learned;
without any label every score is next to 0; ties of the sample's hash go by
doc_id; repeated rows are scored each; very long texts are scored whole; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import linear

#: Labelled documents that the model is fitted on at most, by hash of doc_id:
#: up to a third toxic ones, the rest clean.
MAX_TRAIN = 12_000
#: A score from here on counts as toxic.
THRESHOLD = 0.3


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(order, text, target). Rows are chosen by one hash and learned in the
    order of another: the chosen rows of the rarer class reach further up the
    first hash, and would come last in its order, without the others."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("target"))
    known = known.where(~held_out()).withColumn("choice", F.xxhash64("doc_id"))
    toxic = known.where("target = 1").orderBy("choice", "doc_id").limit(max_train // 3)
    some = toxic.unionByName(known.where("target = 0").orderBy("choice", "doc_id").limit(max_train - max_train // 3))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_of().alias("text"))
    sample = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "target").agg(F.min("text").alias("text"))
    return sample.select(F.xxhash64(F.lit("order"), "doc_id").alias("order"), "text", "target")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    weights = linear.train(training_sample(docs, labels, max_train))
    if len(weights[0]) == 0:
        return np.array([1 << linear.BITS]), np.array([-20], np.float32)
    return weights


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    texts = docs.select("doc_id", held_out().alias("held_out"), C.text_of().alias("text"))
    out = linear.score(texts, fit(docs, labels, max_train))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """docs without those that the model rejects; its columns."""
    score = linear.score_of(C.text_of(), fit(docs, labels, max_train), docs.sparkSession)
    return docs.where(score < THRESHOLD)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(C.read_table(spark, sf_dir, "documents"), C.read_table(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}
