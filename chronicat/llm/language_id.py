"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces,
by a forward pass; expectation-maximisation (forward-backward) fits the pieces
on a bounded sample per language. A text's score for a language is the product
over its words. Words are the letters of white-space tokens, in lower case,
behind a word-start mark; one of more than 24 characters counts as several
words of that length, so that no product underflows.

Defined cases: ``und`` and score 0 for null texts and texts without a letter,
and everywhere if no language can be learned; of languages beyond MAX_LANGS
those with the fewest documents aren't learned (ties by name); of equal scores
the first name wins; repeated rows are scored each; very long texts are scored
whole, by parts; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Documents of each language that the model is fitted on, by hash of doc_id.
MAX_TRAIN = 400
#: Languages that are learned at most, those with most documents: bounds the
#: broadcast, whatever the column holds.
MAX_LANGS = 200
CUT, ROUNDS, FLOOR = 24, 3, 1e-7
#: Numbers (words x languages) that a worker holds about.
CELLS = 3 << 20
MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """All pieces of letters (and the mark), found by hash. Piece n is any
    other single character; the last row, of probability zero, is no piece."""

    def __init__(self, model: str):
        import public_tokenizers as P
        import sentencepiece

        coder = sentencepiece.SentencePieceProcessor(model_file=P.path(model))
        pieces = {coder.id_to_piece(i).lower() for i in range(coder.get_piece_size()) if not (coder.is_control(i) or coder.is_unknown(i) or coder.is_byte(i))}
        self.pieces = sorted(p for p in pieces if p.removeprefix(MARK).isalpha() or p == MARK)
        self.n, self.tables, self.longest = len(self.pieces), {}, max(map(len, self.pieces))
        for size in range(1, self.longest + 1):
            own = [(i, p) for i, p in enumerate(self.pieces) if len(p) == size]
            if own:
                h = C.rolling(np.array([[ord(c) for c in p] for _, p in own], np.uint64).ravel(), size, int(BASE))[::size]
                order = np.argsort(h)
                self.tables[size] = h[order], np.array([i for i, _ in own])[order]

    def lookup(self, letters: np.ndarray) -> list[np.ndarray]:
        """letters: words of equal length, a row each. For every size, the
        piece that starts at each position (n + 1: none)."""
        words, length = letters.shape
        codes, out = letters.astype(np.uint64), []
        h = np.zeros((words, length), np.uint64)
        with np.errstate(over="ignore"):
            for size in range(1, min(self.longest, length) + 1):
                h = h[:, : length - size + 1] * BASE + codes[:, size - 1 :]
                table, ids = self.tables.get(size, (np.zeros(1, np.uint64), np.array([self.n + 1])))
                at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                out.append(np.where(table[at] == h, ids[at], self.n if size == 1 else self.n + 1))
        return out


@lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def forward(found: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Probability of every prefix: words x positions x languages."""
    words, length = found[0].shape
    alpha = np.zeros((words, length + 1, p.shape[1]))
    alpha[:, 0] = 1
    for t in range(1, length + 1):
        for size in range(1, min(len(found), t) + 1):
            alpha[:, t] += alpha[:, t - size] * p[found[size - 1][:, t - size]]
    return alpha


def expected(found: list[np.ndarray], p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that occur counts times."""
    words, length = found[0].shape
    alpha = forward(found, p)[:, :, 0]
    beta = np.zeros((words, length + 1))
    beta[:, length] = 1
    for t in range(length - 1, -1, -1):
        for size in range(1, min(len(found), length - t) + 1):
            beta[:, t] += beta[:, t + size] * p[found[size - 1][:, t], 0]
    total, scale = np.zeros(len(p)), counts / np.maximum(alpha[:, length], 1e-300)
    for size, ids in enumerate(found, 1):
        use = alpha[:, : length - size + 1] * p[ids, 0] * beta[:, size:] * scale[:, None]
        total += np.bincount(ids.ravel(), use.ravel(), len(p))
    return total


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def chunks(word: str) -> list[str]:
    w = MARK + letters(word).lower()
    return [w[i : i + CUT] for i in range(0, len(w), CUT)] if len(w) > 1 else []


def _by_length(words: list[str], most: int = 20_000):
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == length)
        for lo in range(0, len(at), most):
            some = at[lo : lo + most]
            yield some, np.frombuffer("".join(words[i] for i in some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), length)


def _count(batches):
    """(lang, word, times) of the letters of every word."""
    for b in batches:
        for s in C.slices(b):
            offsets, codes, words = C.split_words(s.column("text"))
            made = [chunks(w) for w in words]
            lang = s.column("lang").dictionary_encode()
            of = np.repeat(np.asarray(lang.indices, np.int64), np.diff(offsets))
            pair, times = np.unique(of * max(1, len(words)) + codes, return_counts=True)
            out: dict = {}
            for k, n in zip(pair.tolist(), times.tolist(), strict=True):
                for w in made[k % len(words)]:
                    key = k // len(words), w
                    out[key] = out.get(key, 0) + n
            names = lang.dictionary.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k, _ in out], pa.string()), pa.array([w for _, w in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["lang", "word", "times"])


def _fit(batches, model: str):
    """Piece probabilities of one language, from all its (lang, word, times)."""
    v = vocabulary(model)
    words: dict[str, int] = {}
    lang = None
    for b in batches:
        for name, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            lang, words[w] = name, words.get(w, 0) + n
    if lang is None:
        return
    names, times = list(words), np.array(list(words.values()), float)
    groups = [(times[at], v.lookup(codes)) for at, codes in _by_length(names)]
    p = np.full((v.n + 2, 1), 1 / (v.n + 1))
    p[v.n + 1] = 0
    for _ in range(ROUNDS):
        total = sum((expected(found, p, counts) for counts, found in groups), np.zeros(v.n + 2))
        p[:, 0] = total / max(total.sum(), 1e-300) + FLOOR
        p[v.n + 1] = 0
        p /= p.sum()
    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([p[:, 0].tolist()], pa.list_(pa.float32()))], names=["lang", "p"])


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, model: str = "piece_bpe_32k.model", max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities: pieces x languages). One task fits a language
    from the words of at most max_train documents."""
    from pyspark.sql import Window

    ids = docs.where("lang is not null and text is not null").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("order"))
    ids = C.stash(ids, "labelled")
    learned = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).select("lang")
    some = ids.join(F.broadcast(learned), "lang")
    # The smallest hashes, by tournament: no task gets more than 8 times
    # max_train rows of a language, but for the first round's 512 slots.
    for slots in (512, 64, 8, 1):
        w = Window.partitionBy("lang", F.pmod("order", F.lit(slots))).orderBy("order", "doc_id")
        some = some.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_train)
    some = some.select("doc_id", F.col("lang").alias("learn")).distinct()
    sample = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), C.text_of().alias("text")).join(F.broadcast(some), "doc_id").where("lang = learn")
    words = sample.select("lang", "text").mapInArrow(_count, "lang string, word string, times long")
    words = words.groupBy("lang", "word").agg(F.sum("times").alias("times"))
    rows = words.groupBy("lang").applyInArrow(lambda t: _fit_lang(t, model), "lang string, p array<float>").orderBy("lang").collect()  # MAX_LANGS rows at most
    return [r["lang"] for r in rows], np.array([r["p"] for r in rows], np.float32).T


def _fit_lang(table, model):
    return pa.Table.from_batches(list(_fit(table.to_batches(), model)))


_SEEN: dict[str, int] = {}
_ROWS: list = [None, None]


def _score(batches, fitted, model: str):
    langs, p = fitted.value
    p, v = p.astype(np.float64), vocabulary(model)
    if _ROWS[0] is not fitted.value:
        _SEEN.clear()
        _ROWS[:] = fitted.value, np.zeros((1 << 12, len(langs)))
    for b in batches:
        pred, score = [], []
        for s in C.slices(b, "text", C.SLICE_BYTES * 4 // max(4, len(langs))):
            offsets, codes, words = C.split_words(s.column("text"))
            if len(_SEEN) + len(words) > CELLS // len(langs):
                _SEEN.clear()
            new = [w for w in words if w not in _SEEN]
            if new:
                parts = [chunks(w) for w in new]
                flat = [c for x in parts for c in x]
                lengths = np.array([len(x) for x in parts])
                log = np.zeros((len(flat) + 1, len(langs)))
                for at, letter in _by_length(flat, max(100, CELLS // (2 * CUT * len(langs)))):
                    log[at] = np.log(np.maximum(forward(v.lookup(letter), p)[:, -1], 1e-300))
                total = np.cumsum(np.concatenate((np.zeros((1, len(langs))), log[:-1])), axis=0)
                ends = np.cumsum(lengths)
                value = total[ends] - total[ends - lengths]
                base = len(_SEEN)
                while len(_ROWS[1]) < base + len(new):
                    _ROWS[1] = np.concatenate((_ROWS[1], np.zeros_like(_ROWS[1])))
                _ROWS[1][base : base + len(new)] = value
                _SEEN.update(zip(new, range(base, base + len(new)), strict=True))
            at = np.fromiter((_SEEN[w] for w in words), np.int64, len(words))[codes] if words else codes
            sums, doc = np.zeros((len(s), len(langs))), np.repeat(np.arange(len(s)), np.diff(offsets))
            for lo in range(0, len(at), CELLS // len(langs)):
                part = doc[lo : lo + CELLS // len(langs)]
                edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                sums[part[edge]] += np.add.reduceat(_ROWS[1][at[lo : lo + len(part)]], edge)
            best = sums.argmax(axis=1)
            share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            some = np.asarray(s.column("letters").fill_null(False))
            pred += [langs[i] if ok else "und" for i, ok in zip(best, some, strict=True)]
            score.append(np.where(some, share, 0.0))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))], names=["doc_id", "held_out", "lang_pred", "score"])


def language_id(docs: DataFrame, model: str = "piece_bpe_32k.model", max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    langs, p = fit(docs, model, max_train)
    if not langs:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    fitted = docs.sparkSession.sparkContext.broadcast((langs, p))  # at most MAX_LANGS x vocabulary
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), C.text_of().alias("text"))
    return rows.mapInArrow(partial(_score, fitted=fitted, model=model), "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(C.read_table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
