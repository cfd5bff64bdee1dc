"""Packing by cutting-stock column generation.

Documents are tokenised once. Whole 1024-token blocks are sequences of their
own; what remains of each document is an item of 1 to 1023 tokens. The
histogram of item lengths (at most 1023 numbers) feeds a linear program whose
columns are patterns, multisets of lengths that fill a sequence exactly. New
columns come from a knapsack dynamic program over the dual prices. The rounded
solution says how many sequences of each pattern to fill; items are ranked
among those of their length, and a rank decides pattern, sequence and offset.
Items that no exact pattern takes are cut at the powers of two of their length;
equal parts fill sequences, and the last ones stand at a power of two, where no
padding is due. So nothing is padded, and only the items of the last step are
cut.

Defined cases: null text is empty; an empty document is its end token alone;
repeated rows are packed each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SIZE = 1024
#: Simplex steps at most; what the program then leaves uncovered is cut.
STEPS = 300
#: Items of one length and bucket are ranked in one task; about so many.
RANKED = 20_000


@lru_cache(maxsize=2)
def encoder(name: str = "byte_bpe_50k.json"):
    """Text to ids. The byte-level file has a twin for a faster library with
    the same ids; other names go through ``tokenizers``."""
    import public_tokenizers as P

    if name == "byte_bpe_50k.json":
        import tiktoken

        with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
        return lambda text: coder.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(P.path(name))
    return lambda text: coder.encode(text, add_special_tokens=False).ids


def document_ids(text: str | None, tokenizer: str = "byte_bpe_50k.json", end: int = 0) -> np.ndarray:
    return np.array([*encoder(tokenizer)(text or ""), end], dtype="<u4")


def powers(length: int) -> list[int]:
    """The powers of two of a length, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def _tokenise(batches, tokenizer: str, size: int):
    for b in batches:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for text in b.column(1):
            ids = document_ids(text.as_py(), tokenizer)
            n, whole = len(ids), len(ids) // size
            raw = memoryview(ids.tobytes())
            rest = raw[4 * whole * size :]
            parts, at = [], 0
            for p in powers(n - whole * size):
                parts.append(zlib.crc32(rest[at : at + 4 * p]))
                at += 4 * p
            for column, value in zip(rows, (n, [zlib.crc32(raw[4 * i * size : 4 * (i + 1) * size]) for i in range(whole)], n - whole * size, zlib.crc32(rest), parts), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(pa.int64())), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.list_(pa.int64()))], names=["doc_id", "n", "blocks", "rest", "rest_crc", "parts"])


class Patterns:
    """max sum(size * x) over patterns, each length used at most as often as it
    is there. Revised simplex on an explicit inverse: slack columns start, the
    pairs and triples that fill a sequence enter first, then the columns that
    the knapsack program prices."""

    def __init__(self, lengths: list[int], counts: list[int], size: int = SIZE, steps: int = STEPS):
        self.lengths, self.size = lengths, size
        self.m, self.have = len(lengths), np.array(counts, dtype=np.float64)
        self.columns: list[np.ndarray | None] = [None] * self.m  # of the basis; None: slack
        self.inverse, self.x, self.cost = np.eye(self.m), self.have.copy(), np.zeros(self.m)
        at = {n: i for i, n in enumerate(lengths)}
        free = np.zeros(size + 1, dtype=np.int64)
        free[lengths] = counts
        for pattern, _ in self._greedy(free):
            column = np.zeros(self.m)
            for n, k in pattern.items():
                column[at[n]] = k
            if size - self.cost @ (self.inverse @ column) > 1e-6 * size:
                self._enter(column, float(size), column)
        for self.steps in range(steps):
            price = self.cost @ self.inverse
            column, worth = self.knapsack(np.maximum(price, 0))
            if column is None or size - worth <= 1e-6 * size:
                negative = int(np.argmin(price))  # a slack may come back
                if price[negative] >= -1e-9:
                    break
                column, gain, entering = np.eye(self.m)[negative], 0.0, None
            else:
                gain, entering = float(size), column
            if not self._enter(column, gain, entering):
                break

    def _enter(self, column: np.ndarray, gain: float, entering: np.ndarray | None) -> bool:
        """One pivot; False if nothing bounds the column."""
        d = self.inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, self.x / d, np.inf)
        row = int(np.argmin(ratio))
        if not np.isfinite(ratio[row]):
            return False
        self.inverse[row] /= d[row]
        x_new = ratio[row]
        others = np.flatnonzero(np.abs(d) > 1e-12)
        others = others[others != row]
        self.inverse[others] -= np.outer(d[others], self.inverse[row])
        self.x -= d * x_new
        self.x[row] = x_new
        self.x = np.maximum(self.x, 0)
        self.cost[row], self.columns[row] = gain, entering
        return True

    def knapsack(self, price: np.ndarray) -> tuple[np.ndarray | None, float]:
        """The cheapest multiset of lengths that fills a sequence exactly."""
        best, last = np.full(self.size + 1, np.inf), np.full(self.size + 1, -1, dtype=np.int64)
        best[0] = 0
        lengths = np.array(self.lengths)
        for c in range(1, self.size + 1):
            n = int(np.searchsorted(lengths, c, side="right"))
            if n:
                total = best[c - lengths[:n]] + price[:n]
                i = int(total.argmin())
                best[c], last[c] = total[i], i
        if not np.isfinite(best[self.size]):
            return None, np.inf
        column, c = np.zeros(self.m), self.size
        while c:
            column[last[c]] += 1
            c -= self.lengths[last[c]]
        return column, float(best[self.size])

    def rounded(self) -> list[tuple[dict[int, int], int]]:
        """(pattern, times) within the counts: the program's, rounded down,
        then pairs and triples of what is left that fill a sequence."""
        left = self.have.astype(np.int64)
        out = []
        for column, x in zip(self.columns, self.x, strict=True):
            if column is not None:
                used = np.flatnonzero(column)
                times = min(int(x + 1e-6), *(int(left[i] // column[i]) for i in used))
                if times > 0:
                    left[used] -= (column[used] * times).astype(np.int64)
                    out.append(({self.lengths[i]: int(column[i]) for i in used}, times))
        free = np.zeros(self.size + 1, dtype=np.int64)
        free[self.lengths] = left
        return out + self._greedy(free)

    def _greedy(self, free: np.ndarray) -> list[tuple[dict[int, int], int]]:
        """Pairs and triples of the free lengths that fill a sequence."""
        out = []
        for a in range(self.size - 1, 0, -1):
            while free[a]:
                free[a] -= 1
                found = self._fill(free, self.size - a)
                if found is None:
                    free[a] += 1
                    break
                pattern = {n: [a, *found].count(n) for n in (a, *found)}
                # Repeats at once, as often as the rarest of its lengths allows.
                times = 1 + min(int(free[n] - (k if n != a else k - 1)) // k for n, k in pattern.items())
                for n, k in pattern.items():
                    free[n] -= k * times - (n == a)
                out.append((pattern, times))
        return out

    @staticmethod
    def _fill(free: np.ndarray, need: int) -> tuple[int, ...] | None:
        if free[need]:
            return (need,)
        below = free[1:need]
        both = np.flatnonzero((below > 0) & (below[::-1] > 0)) + 1
        for b in both[::-1]:
            if 2 * b != need or free[b] > 1:
                return (int(b), int(need - b))
        return None


def rules(histogram: dict[int, int], size: int = SIZE, steps: int = STEPS) -> list[tuple]:
    """(rest, rank_from, rank_to, t0, each, unit, seq0, offset0, start, part):
    an item with that rank goes to sequence seq0 + t // each at offset
    offset0 + t % each * unit, where t = t0 + rank - rank_from; part is the
    number of its piece, -1 for the whole item. Bounded by size, not by data."""
    lengths = sorted(n for n, c in histogram.items() if c and n)
    if not lengths:
        return []
    solved = Patterns(lengths, [histogram[n] for n in lengths], size, steps)
    taken, out, seq = dict.fromkeys(lengths, 0), [], 0
    for pattern, times in solved.rounded():
        offset = 0
        for n, each in pattern.items():
            out.append((n, taken[n], taken[n] + each * times, 0, each, n, seq, offset, 0, -1))
            taken[n] += each * times
            offset += each * n
        seq += times
    for unit in (1 << b for b in range(size.bit_length() - 2, -1, -1)):
        each = size // unit
        of = [(n, histogram[n] - taken[n]) for n in lengths if n & unit and histogram[n] > taken[n]]
        total = sum(c for _, c in of)
        full = total // each * each
        spans = [(0, full, each, seq)] if full else []
        seq += full // each
        at = full
        for p in powers(total - full):  # the last ones fill a power of two each
            spans.append((at, at + p, p, seq))
            at, seq = at + p, seq + 1
        base = 0
        for n, c in of:
            part, start = powers(n).index(unit), n & ~(2 * unit - 1)
            for lo, hi, k, first in spans:
                a, b = max(lo, base), min(hi, base + c)
                if a < b:
                    out.append((n, taken[n] + a - base, taken[n] + b - base, a - lo, k, unit, first, 0, start, part))
            base += c
    return out


RULES = "rest int, rank_from long, rank_to long, t0 long, each long, unit long, seq0 long, offset0 long, start0 long, part int"


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", size: int = SIZE) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    spark = docs.sparkSession
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = C.stash(tokens.mapInArrow(partial(_tokenise, tokenizer=tokenizer, size=size), "doc_id long, n long, blocks array<long>, rest int, rest_crc long, parts array<long>"), "tokens")
    buckets = tokens.count() // RANKED + 1
    items = tokens.where("rest > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "n", "rest_crc"), F.lit(buckets)))
    per = C.stash(items.groupBy("rest", "bucket").count(), "histogram", buckets * size)
    histogram = {r["rest"]: r["n"] for r in per.groupBy("rest").agg(F.sum("count").alias("n")).collect()}  # below size rows
    table = spark.createDataFrame(rules(histogram, size) or [(0,) * 10], RULES)
    before = F.sum("count").over(_window("rest").orderBy("bucket")) - F.col("count")
    per = per.select("rest", "bucket", before.alias("before"))
    ranked = items.withColumn("rank", F.row_number().over(_window("rest", "bucket").orderBy("doc_id", "n", "rest_crc")) - 1)
    ranked = ranked.join(per, ["rest", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(table), "rest").where("rank >= rank_from and rank < rank_to")
    t = F.col("t0") + F.col("rank") - F.col("rank_from")
    rest = placed.select(
        "doc_id",
        (F.col("n") - F.col("rest") + F.col("start0")).alias("start"),
        F.col("unit").alias("length"),
        F.when(F.col("part") < 0, F.col("rest_crc")).otherwise(F.get("parts", F.col("part"))).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        (F.lit(2) * (F.col("seq0") + F.floor(t / F.col("each"))) + 1).cast("long").alias("sequence_id"),
        (F.col("offset0") + t % F.col("each") * F.col("unit")).cast("long").alias("offset"),
    )
    # Rows of a written table keep their place, so these numbers outlast retries.
    whole = tokens.where("n >= %d" % size).select("doc_id", "n", F.posexplode("blocks").alias("block", "crc"))
    whole = whole.select(
        "doc_id",
        (F.col("block").cast("long") * size).alias("start"),
        F.lit(size).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        (F.lit(2) * F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return whole.unionByName(rest)


def _window(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.read_table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
