"""Hashed word n-grams and skip-grams, and FTRL-proximal logistic regression
over them (per-coordinate rates, L1 sparsity)."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common as C

#: Bits of the feature space.
BITS = 24
#: Features of fewer documents of the sample are not learned.
LEAST = 3
#: Bytes of text whose features are made at a time, as they take some 20 times
#: that.
SLICE = 1 << 20
PUNCTUATION = ".,;:!?\"'()[]{}<>*_-"
WEIGHTS = "feature int, weight float"


def _word(word: str) -> str:
    return word.lower().strip(PUNCTUATION) or word


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every unigram, bigram and skip-gram (one word
    skipped); repeats included."""
    offsets, codes, words = C.split_words(texts)
    h = C.word_hashes([_word(w) for w in words], 7)[codes] if words else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    docs, found = [doc], [h]
    with np.errstate(over="ignore"):
        for gap, a, b in ((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9, 0x27D4EB2F165667C5)):
            same = np.flatnonzero(doc[:-gap] == doc[gap:]) if len(doc) > gap else np.zeros(0, np.int64)
            docs.append(doc[same])
            found.append(h[same] * np.uint64(a) + h[same + gap] * np.uint64(b))
    return np.concatenate(docs), (C.mix(np.concatenate(found)) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal over ``size`` coordinates: w = -(z - sign(z) l1) / ((beta
    + sqrt(n)) / alpha + l2) where |z| > l1, else 0. The bias stands behind
    them."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = (np.zeros(size + 1, np.float32) for _ in range(2))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0)

    def learn(self, at: np.ndarray, target: float) -> float:
        """One step on a document with distinct coordinates ``at``, the last
        of them the bias."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = np.float32(p - target)
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g
        return float(p)


def _train(batches, epochs: int, options: dict):
    """Weights of the features that LEAST documents hold, and of the bias,
    which goes by feature 2**BITS. Only those features get a coordinate."""
    parts, targets = [], []
    times = np.zeros(1 << BITS, np.uint8)  # documents of a feature, up to LEAST
    for b in batches:
        for s in C.slices(b, limit=SLICE):
            doc, found = features(s.column("text"))
            both = np.unique(doc << BITS | found)
            own = (both & ((1 << BITS) - 1)).astype(np.int32)
            parts.append((own, np.searchsorted(both, np.arange(1, len(s) + 1) << BITS)))
            some, n = np.unique(own, return_counts=True)
            times[some] = np.minimum(times[some] + n, LEAST)
            targets += np.asarray(s.column("target")).tolist()
            del doc, found, both, own, some, n
    ids = np.flatnonzero(times >= LEAST).astype(np.int32)
    del times
    model, seen = Ftrl(len(ids), **options), []
    for i, (own, ends) in enumerate(parts):
        parts[i] = None  # one part after the other gives way to its learned features
        places = np.searchsorted(ids, own)
        learned = ids[np.minimum(places, len(ids) - 1)] == own if len(ids) else np.zeros(len(own), bool)
        ends = np.concatenate(([0], np.cumsum(learned)))[ends]
        places = np.insert(places[learned].astype(np.int32), ends, np.int32(len(ids)))  # each document's last is the bias
        seen += np.split(places, (ends + np.arange(1, len(ends) + 1))[:-1])
        del own, learned, places
    seen = list(zip(seen, targets, strict=True))
    for _ in range(epochs):
        for at, target in seen:
            model.learn(at, target)
    w = model.weights(slice(None)).astype(np.float32)
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, 1 << BITS)[at].astype(np.int32)), pa.array(w[at])], names=["feature", "weight"])


def train(sample: DataFrame, epochs: int = 4, **options) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, values) from (order, text, target). The sample is
    bounded by the caller, so one task learns from it, in a fixed order."""
    ordered = sample.repartition(1).sortWithinPartitions("order").select("text", F.col("target").cast("double"))
    rows = ordered.mapInArrow(partial(_train, epochs=epochs, options=options), WEIGHTS).toArrow()
    return np.asarray(rows["feature"]), np.asarray(rows["weight"])


class Scorer:
    """Scores of texts by sparse weights. ``some`` tells by the low bits which
    features may have one; those are looked up by bisection."""

    LOW = (1 << 18) - 1

    def __init__(self, at: np.ndarray, w: np.ndarray):
        order = np.argsort(at)
        self.at, self.w = at[order].astype(np.int64), w[order]
        self.bias = float(self.w[-1]) if len(at) and self.at[-1] == 1 << BITS else 0.0
        self.some = np.zeros(self.LOW + 1, bool)
        self.some[self.at[self.at < 1 << BITS] & self.LOW] = True

    def __call__(self, texts: pa.Array) -> np.ndarray:
        doc, found = features(texts)
        may = np.flatnonzero(self.some[found & self.LOW])
        doc, found = doc[may], found[may]
        place = np.searchsorted(self.at, found)
        hit = self.at[np.minimum(place, len(self.at) - 1)] == found if len(found) else np.zeros(0, bool)
        both = np.unique(doc[hit] << BITS | place[hit])  # presence, not counts
        total = np.bincount(both >> BITS, self.w[both & ((1 << BITS) - 1)], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


_READY: list = [None, None]


def _scorer(model) -> Scorer:
    """Made of the broadcast weights, kept by the worker for its next task."""
    if _READY[0] is not model.value:
        _READY[:] = model.value, Scorer(*model.value)
    return _READY[1]


def _score(batches, model):
    for b in batches:
        scores = [_scorer(model)(s.column("text")) for s in C.slices(b, limit=SLICE)]
        score = np.concatenate(scores) if scores else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score, pa.float64())], names=[*b.schema.names[:-1], "score"])


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The columns of docs with ``score`` in place of its last one, ``text``.
    The broadcast holds at most 2**BITS weights."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    schema = StructType([*docs.schema.fields[:-1], StructField("score", DoubleType())])
    return docs.mapInArrow(partial(_score, model=model), schema)


def score_of(text: Column, weights: tuple[np.ndarray, np.ndarray], spark: SparkSession) -> Column:
    """The score of a text column; only that column goes to Python."""
    model = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        scores = [_scorer(model)(s.column("text")) for s in C.slices(batch, limit=SLICE)]
        return pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    return scored(text)
