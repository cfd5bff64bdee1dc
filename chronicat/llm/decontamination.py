"""Benchmark decontamination: n-gram seeds, then Smith-Waterman.

Word trigrams of the test items are looked up in every document; where some
stand close together, the passage around them is a candidate. A candidate is
passed over only where it can't reach the threshold: each word of the item
scores once at most, so the words it shares with the passage bound the score.
All others are aligned with the item word by word, however often the item's
seeds occur elsewhere; the score is the best local alignment over the item's
length.

Defined cases: null and empty texts match nothing, nor do items without a word;
items below three words are one seed; repeated rows are reported each; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

GRAM = 3
#: Share of the best possible alignment from which a passage is a copy.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Items are broadcast in blocks of at most so many bytes of text and rows.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 20_000
#: Words of passages, or of the item for each if it is longer, that are scored
#: side by side (one longer stands alone).
CELLS = 1 << 18
PUNCTUATION = ".,;:!?\"'()[]{}<>*_-"


def plain(word: str) -> str:
    return word.lower().strip(PUNCTUATION) or word


def words_of(text: str) -> list[str]:
    return [plain(w) for w in text.encode("utf-8", "surrogatepass").decode("utf-8", "replace").replace("\x1c", " ").split()]


def grams(words: list[str], n: int = GRAM) -> list[tuple[str, ...]]:
    return list(zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else [tuple(words)] * bool(words)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks that fit a broadcast, read one by one; the driver
    holds one block at a time. Without items one empty block."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        if block and (size + len(r[1]) > BLOCK_BYTES or len(block) >= BLOCK_ROWS):
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    yield block


class Seeds:
    """Seeds of a block, the items that hold each, and numbered words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, words_of(t)) for i, t in items]
        self.seeds: dict[tuple, int] = {}
        self.of: list[list[int]] = []
        for k, (_, words) in enumerate(self.items):
            for g in dict.fromkeys(grams(words)):
                n = self.seeds.setdefault(g, len(self.of))
                if n == len(self.of):
                    self.of.append([])
                self.of[n].append(k)
        self.numbers = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in self.items for w in words))}
        self.short = {len(g) for g in self.seeds} - {GRAM}


_READY: list = [None, None]


def _ready(block) -> Seeds:
    if _READY[0] is not block.value:
        _READY[:] = block.value, Seeds(block.value)
    return _READY[1]


def _passages(held: Seeds, s: pa.RecordBatch):
    """Plain words of a slice by code, the codes of its texts in a row, their
    numbers in the block (-1: in no item), where texts begin, and by item the
    document and reach of each passage around its seeds."""
    offsets, codes, words = C.split_words(s.column("text"))
    plains = [plain(w) for w in words]
    numbers = np.fromiter((held.numbers.get(w, -1) for w in plains), np.int64, len(plains))[codes] if words else np.zeros(0, np.int64)
    found: dict[tuple[int, int], list[int]] = {}
    for n in {GRAM, *held.short}:
        if len(numbers) < n:
            continue
        run = numbers[: len(numbers) - n + 1] >= 0
        for j in range(1, n):
            run &= numbers[j : len(numbers) - n + 1 + j] >= 0
        for at in np.flatnonzero(run).tolist():
            seed = held.seeds.get(tuple(plains[c] for c in codes[at : at + n].tolist()))
            if seed is not None:
                doc = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + n <= offsets[doc + 1]:
                    for k in held.of[seed]:
                        found.setdefault((doc, k), []).append(at)
    by_item: dict[int, list[tuple[int, int, int]]] = {}
    for (doc, k), places in found.items():
        places.sort()
        reach = len(held.items[k][1]) + 8
        lo, hi = int(offsets[doc]), int(offsets[doc + 1])
        start = 0
        for i in range(1, len(places) + 1):
            if i == len(places) or places[i] - places[i - 1] > reach:
                by_item.setdefault(k, []).append((doc, max(lo, places[start] - reach), min(hi, places[i - 1] + reach)))
                start = i
    return plains, codes, numbers, offsets, by_item


def _side_by_side(spans: list[tuple[int, int, int]], least: int):
    """The passages of an item in parts of at most CELLS words when padded to
    the longest, and to ``least``."""
    spans = sorted(spans, key=lambda x: x[2] - x[1])
    at = 0
    while at < len(spans):
        stop = at + 1
        while stop < len(spans) and (stop + 1 - at) * max(least, spans[stop][2] - spans[stop][1]) <= CELLS:
            stop += 1
        yield spans[at:stop]
        at = stop


def align(item: list[str], passage: list[str]) -> tuple[float, int, int]:
    """Best local alignment (Smith-Waterman): score and its words in the
    passage [from, to)."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(item))}
    p = np.array([ids.get(w, -1) for w in passage])
    score, origin = np.zeros(len(p) + 1), np.arange(len(p) + 1)
    best = (0.0, 0, 0)
    steps = np.arange(len(p) + 1) * GAP
    for w in item:
        diagonal = score[:-1] + np.where(p == ids[w], MATCH, MISMATCH)
        up = score[1:] + GAP
        new = np.concatenate(([0.0], np.maximum(np.maximum(diagonal, up), 0)))
        came = np.concatenate(([0], np.where(diagonal >= up, origin[:-1], origin[1:])))
        came = np.where(new > 0, came, np.arange(len(p) + 1))
        ahead = np.maximum.accumulate(new - steps)  # gaps in the item
        side = ahead + steps
        source = np.maximum.accumulate(np.where(new - steps == ahead, np.arange(len(p) + 1), 0))
        origin = np.where(side > new, came[source], came)
        score = np.maximum(new, side)
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (float(score[at]), int(origin[at]), at)
    return best


def shared(item: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """For passages (numbers of words, a row each, padded by -1): how many
    words of the item find a partner, each word of a passage used once. No
    alignment has more matches."""
    ids, wanted = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(ids, passages), len(ids) - 1)
    row, column = np.nonzero(ids[at] == passages)
    n = np.bincount(row * len(ids) + at[row, column], minlength=len(passages) * len(ids)).reshape(len(passages), -1)
    return np.minimum(n, wanted).sum(axis=1)


def scores(item: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """The scores that ``align`` gives, of passages side by side."""
    score, best = np.zeros((len(passages), passages.shape[1] + 1)), np.zeros(len(passages))
    steps = np.arange(passages.shape[1] + 1) * GAP
    for w in item.tolist():
        new = np.maximum(score + GAP, 0)
        np.maximum(new[:, 1:], score[:, :-1] + np.where(passages == w, MATCH, MISMATCH), out=new[:, 1:])
        score = np.maximum.accumulate(new - steps, axis=1) + steps
        np.maximum(best, score.max(axis=1), out=best)
    return best


def _found(batches, block, threshold: float):
    """A row per document, item and passage that reaches the threshold."""
    held = _ready(block)
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for s in C.slices(b):
            plains, codes, numbers, offsets, by_item = _passages(held, s)
            for k, spans in by_item.items():
                item, words = held.items[k]
                own = np.array([held.numbers[w] for w in words])
                for part in _side_by_side(spans, len(words)):
                    rows = np.full((len(part), max(z - a for _, a, z in part)), -1)
                    for i, (_, a, z) in enumerate(part):
                        rows[i, : z - a] = numbers[a:z]
                    may = np.flatnonzero(shared(own, rows) * MATCH / (MATCH * len(words)) >= threshold)
                    for i in may[scores(own, rows[may]) / (MATCH * len(words)) >= threshold].tolist():
                        doc, a, z = part[i]
                        score, lo, hi = align(words, [plains[c] for c in codes[a:z].tolist()])
                        start = a - int(offsets[doc])
                        for column, value in zip(out, (s.column("doc_id")[doc].as_py(), item, score / (MATCH * len(words)), start + lo, start + hi), strict=True):
                            column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], names=["doc_id", "item_id", "score", "word_from", "word_to"])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, word_from, word_to of every passage of a
    document that copies a test item."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_of().alias("text"))
    out = None
    for items in blocks(benchmark):
        block = spark.sparkContext.broadcast(items)
        found = texts.mapInArrow(partial(_found, block=block, threshold=threshold), "doc_id long, item_id long, score double, word_from long, word_to long")
        out = found if out is None else out.unionByName(found)
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that hold a copy of a test item; its columns. A row
    goes by its doc_id and text, as ids may be null or shared."""
    key = C.row_key()
    named = docs.select(key.alias("doc_id"), "text")
    gone = C.stash(contaminated(named, benchmark, threshold).select(F.col("doc_id").alias("k")).distinct(), "leaks", docs.count())
    rows = C.without(docs.withColumn("__key", key), gone, gone.count(), "__key")
    return rows.select(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.read_table(spark, sf_dir, "documents"), C.read_table(spark, sf_dir, "benchmark"))


SQL: dict[str, str] = {}
