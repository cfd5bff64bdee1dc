"""Quality by weak labels.

Eight heuristic labellers vote good, bad or nothing on a document.
Expectation-maximisation estimates how often each is right from the counts of
vote patterns (at most 3**8, counted over all documents); the posterior of a
pattern is the label of its documents. On a bounded sample those labels train a
linear scorer over hashed words, which scores every text. No gold label is
used. Votes are cast once and written with a key of doc_id and text; texts are
read again only to be scored.

Defined cases: null text is empty and votes as such; repeated rows count and
are scored each; of several texts of one doc_id the scorer
learns one, the same at every run;
ties of the sample's hash go by doc_id; a mean of exactly 0.5 is kept; very long
texts vote and are scored whole; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import linear

#: Documents that the scorer is fitted on at most, by hash of doc_id.
MAX_TRAIN = 8_000
ROUNDS = 50


def _share(pattern: str):
    """Share of characters that the pattern's class removes."""
    n = F.greatest(F.length("text"), F.lit(1))
    return (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))) / n


def votes(docs: DataFrame) -> DataFrame:
    """key, doc_id, votes: two bits a labeller, 1 good, 2 bad, 0 none."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = docs.select(C.row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), C.text_of().alias("text")).withColumn("w", words)
    n = F.greatest(F.size("w"), F.lit(1)).cast("double")
    d = d.select("key", "doc_id", n.alias("n"), F.size(F.array_distinct("w")).alias("distinct"), (F.length("text") / n).alias("mean"), _share(r"[!*$%&#@~^|=+<>{}\\]+").alias("symbols"), _share(r"\p{Lu}+").alias("upper"), _share(r"\p{L}+").alias("letters"), _share(r"[.]+").alias("stops"), _share(r"[0-9]+").alias("digits"))
    c = F.col

    def labeller(good, bad):
        return F.when(bad, 2).when(good, 1).otherwise(0)

    each = [
        labeller(c("symbols") < 0.005, c("symbols") > 0.03),
        labeller(c("upper") < 0.1, c("upper") > 0.3),
        # Distinct words grow about as the root of all, at any length.
        labeller(c("distinct") > 5 * F.sqrt("n"), c("distinct") < 3 * F.sqrt("n")),
        labeller((c("mean") > 4) & (c("mean") < 9), (c("mean") < 2.5) | (c("mean") > 14)),
        labeller(c("n") >= 50, c("n") < 12),
        labeller(c("letters") > 0.75, c("letters") < 0.6),
        labeller(c("stops") > 0.004, (c("stops") == 0) & (c("n") >= 30)),
        labeller(c("digits") < 0.01, c("digits") > 0.1),
    ]
    total = F.lit(0)
    for i, v in enumerate(each):
        total = total + v * (4**i)
    return d.select("key", "doc_id", total.cast("int").alias("votes"))


def posterior(counts: dict[int, int], labellers: int = 8, rounds: int = ROUNDS) -> tuple[dict[int, float], np.ndarray, float]:
    """EM over vote patterns: P(good) of each pattern, P(vote | class) and
    P(good). Starts from the majority of votes."""
    patterns = sorted(counts)
    if not patterns:
        return {}, np.zeros((labellers, 3, 2)), 0.5
    n = np.array([counts[p] for p in patterns], float)
    v = np.array([[(p >> (2 * i)) & 3 for i in range(labellers)] for p in patterns])
    good = ((v == 1).sum(axis=1) - 3 * (v == 2).sum(axis=1)) > 0
    q = np.where(good, 0.9, 0.1)
    for _ in range(rounds):
        prior = float(np.clip((q * n).sum() / n.sum(), 0.01, 0.99))
        table = np.empty((labellers, 3, 2))
        for k in range(3):
            on = (v == k) * n[:, None]
            table[:, k, 0], table[:, k, 1] = on.T @ (1 - q), on.T @ q
        table += 1.0
        table /= table.sum(axis=1, keepdims=True)
        log = np.log([1 - prior, prior])[None] + np.log(table[np.arange(labellers)[None], v]).sum(axis=1)
        q = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return dict(zip(patterns, q.tolist(), strict=True)), table, prior


def quality(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Every row: doc_id, posterior (of its votes), score (of its text, 0 to
    1), kept (the mean of both is 0.5 or more)."""
    spark = docs.sparkSession
    voted = C.stash(votes(docs), "votes")
    counts = {r["votes"]: r["count"] for r in voted.groupBy("votes").count().collect()}  # at most 3**8 rows
    q, _, _ = posterior(counts)
    if not q:
        return docs.select("doc_id", F.lit(0.5).alias("posterior"), F.lit(0.5).alias("score"), F.lit(True).alias("kept")).limit(0)
    table = F.broadcast(spark.createDataFrame(list(q.items()), "votes int, posterior double"))
    labelled = voted.join(table, "votes").select("key", "doc_id", "posterior")
    some = labelled.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("key", "posterior")).alias("own")).select(F.xxhash64("doc_id").alias("order"), "doc_id", "own.*")
    some = F.broadcast(some.orderBy("order", "doc_id").limit(max_train))
    texts = docs.select(C.row_key().alias("key"), C.text_of().alias("text"))
    sample = texts.join(some, "key").groupBy("order", "posterior").agg(F.min("text").alias("text")).select("order", "text", F.col("posterior").alias("target"))
    scored = C.stash(linear.score(texts, linear.train(sample)), "scores")
    # Rows with one key have one text, and so one score.
    scores = scored.groupBy("key").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    out = C.attach(labelled, scores, "key", "n", sum(counts.values()), "inner").select("doc_id", "posterior", "score")
    return out.withColumn("kept", (F.col("posterior") + F.col("score")) / 2 >= 0.5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(C.read_table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
