"""SimHash near-dedup through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to the
vector of their bit counts. The Manhattan distance of two such vectors never
exceeds the Hamming distance of the fingerprints, so vectors further apart than
the threshold k need no look. The range join runs over a grid: the segments are
dealt to k + r blocks; where at most k segments differ, at least r blocks agree
in every coordinate, so a vector is put in one cell for every choice of r
blocks, and pairs within k share a cell. Pairs of a cell pass the Manhattan
bound first and the exact Hamming distance then. The more fingerprints there
are, the more blocks have to agree, so that cells stay small; any choice finds
the same pairs. Cells with many members are cut into chunks whose pairs are compared in separate tasks, and each task tells
only a spanning star of what it linked, so neither memory nor output grows with
the square of a group.

Defined cases: null and empty texts, and texts of white space only, have
fingerprint zero and are linked; fewer words than a shingle make one shingle;
repeated rows link; a bit set in exactly half the shingles is 0; very long texts
are hashed whole; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEGMENTS, LOW_BITS = 32, 0x5555555555555555
#: Fingerprints of one cell that one task compares with each other.
CHUNK = 2048
#: Work of comparing two fingerprints, that of moving one to a cell being 1.
PAIR = 0.01


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the words' shingles; repeats count."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes.split: 0x20 and 0x09-0x0D
    if not w:
        return 0
    n = len(w) - words + 1
    if n < 1:
        return _majority([xxhash.xxh64_intdigest(b" ".join(w), seed)])
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]).tolist()
    starts, digest = [0, *ends], xxhash.xxh64_intdigest
    return _majority([digest(joined[starts[i] : ends[i + words - 1] - 1], seed) for i in range(n)])


def _majority(hashes: list[int]) -> int:
    h = np.array(hashes, dtype="<u8")
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches, words: int):
    for b in batches:
        ids, texts, *carried = b.columns
        fps = np.fromiter((fingerprint(t.as_py(), words) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([ids, pa.array(fps.view(np.int64)), *carried], names=["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, words: int = 4, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the longs that are carried along: fp as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried).mapInArrow(partial(_fingerprints, words=words), ", ".join(f"{c} long" for c in ("doc_id", "fp", *carried)))


def blocks(k: int, extra: int) -> list[int]:
    """Masks of the k + extra blocks of segments."""
    n = k + extra
    masks = [0] * n
    for s in range(SEGMENTS):
        masks[s * n // SEGMENTS] |= 3 << (2 * s)
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(fps: DataFrame, k: int, extra: int) -> DataFrame:
    """One row per fingerprint and choice of ``extra`` blocks: grid, cell, fp.
    pc holds all 32 bit counts, each in unary (00, 01, 11); a cell is pc under
    a mask."""
    masks = [_signed(sum(c)) for c in combinations(blocks(k, extra), extra)]
    fp, half = F.col("fp"), F.shiftrightunsigned("fp", 1)
    low, high = fp.bitwiseOR(half).bitwiseAND(F.lit(LOW_BITS)), fp.bitwiseAND(half).bitwiseAND(F.lit(LOW_BITS))
    pc = low.bitwiseOR(F.shiftleft(high, 1))
    counts = fps.select("fp", pc.alias("pc"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("grid"), F.col("pc").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)]))
    return counts.select("fp", at.alias("c")).select("c.grid", "c.cell", "fp")


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (each place's least fellow, flat) after a[i] and b[i] are made
    fellows."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def link(keys: np.ndarray, fps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within k of each other among neighbours of equal key (keys are
    sorted): as a star per component, fp -> representative. Pairs are joined
    as they are found, so memory grows with the number of fingerprints only."""
    at, shift, root = np.arange(len(fps) - 1), 1, np.arange(len(fps))
    half = fps >> np.uint64(1)
    unary = ((fps | half) & np.uint64(LOW_BITS)) | ((fps & half & np.uint64(LOW_BITS)) << np.uint64(1))
    while len(at):
        at = at[at + shift < len(fps)]
        at = at[keys[at] == keys[at + shift]]
        near = at[np.bitwise_count(unary[at] ^ unary[at + shift]) <= k]  # Manhattan distance of the counts
        near = near[np.bitwise_count(fps[near] ^ fps[near + shift]) <= k]
        root = _join(root, near, near + shift)
        shift += 1
    far = root != np.arange(len(fps))
    return fps[far], fps[root[far]]


def _links(batches, k: int):
    """Batches come sorted by (grid, cell, part); a run may go on in the next."""

    def told(key, fp):
        a, b = link(key, fp, k)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["x", "y"])

    key = fp = np.zeros(0, np.uint64)
    for b in batches:
        new = [np.asarray(c).astype(np.int64).view(np.uint64) for c in b.columns]
        with np.errstate(over="ignore"):
            run = C.mix(new[1] ^ C.mix(new[0] * np.uint64(0x9E3779B97F4A7C15) + new[2]))
        key, fp = np.concatenate((key, run)), np.concatenate((fp, new[3]))
        if len(key):
            cut = len(key) - int(np.argmax(key[::-1] != key[-1])) if (key != key[-1]).any() else 0
            if cut:
                yield told(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
    if len(key):
        yield told(key, fp)


def agreeing(n: int, k: int) -> int:
    """How many blocks shall agree for n fingerprints: the least estimated
    work. More blocks make more rows (one per grid), but larger cells of the
    space, of about 1.5 bits a segment, hold fewer fingerprints each; PAIR is
    the cost of a comparison, that of a row being 1."""
    work = lambda r: comb(k + r, r) * (1 + PAIR * n / 2 ** (1.5 * SEGMENTS * r / (k + r)))
    return min(range(3, 13), key=work)


def links(fps: DataFrame, n: int, k: int = 4, extra: int | None = None) -> DataFrame:
    """(x, y) over n distinct fingerprints: a graph with the same components as
    all pairs at Hamming distance up to k."""
    spark = fps.sparkSession
    extra = extra or agreeing(n, k)
    grid = cells(fps, k, extra)
    crowded = C.stash(grid.groupBy("grid", "cell").count().where(F.col("count") > CHUNK), "cells", n * comb(k + extra, k))
    n = crowded.count()
    parts = F.col("parts")
    if n:
        crowded = crowded.select("grid", "cell", F.ceil(F.col("count") / CHUNK).cast("int").alias("parts"))
        # Few cells are crowded: beyond 100,000 the join shuffles instead.
        grid = grid.join(F.broadcast(crowded) if n <= 100_000 else crowded, ["grid", "cell"], "left")
        mine = F.pmod(F.xxhash64("fp"), F.coalesce(parts, F.lit(1))).cast("int")
        grid = grid.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)))
        part = F.least("mine", "other").cast("long") * (1 << 31) + F.greatest("mine", "other")
        grid = grid.select("grid", "cell", part.alias("part"), "fp")
    else:
        grid = grid.select("grid", "cell", F.lit(0).cast("long").alias("part"), "fp")
    size = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = grid.repartition(size, "grid", "cell", "part").sortWithinPartitions("grid", "cell", "part")
    return sort.mapInArrow(partial(_links, k=k), "x long, y long")


def simhash_groups(docs: DataFrame, words: int = 4, k: int = 4, carried: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs: doc_id, fp (signed), component_id, and size, the
    number of rows with that fingerprint; then the longs carried along."""
    total = docs.count()
    # Dealt out anew, as each file costs a process where Hadoop's native library
    # is missing, and texts are read in many tasks.
    prints = C.stash(fingerprints(docs, words, carried).hint("rebalance"), "prints", total)
    reps = C.stash(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "reps", total)
    n = reps.count()
    most = n * comb(k + agreeing(n, k), k)
    near = links(reps.select("fp"), n, k).distinct()
    ends = near.join(reps.select(F.col("fp").alias("x"), F.col("rep").alias("a")), "x").join(reps.select(F.col("fp").alias("y"), F.col("rep").alias("b")), "y").select("a", "b")
    root = C.components(ends, rows=most)
    full = reps.join(root, reps.rep == root.node, "left").select("fp", "size", F.coalesce("root", "rep").alias("component_id"))
    out = C.attach(prints, full, "fp", "size", total, "inner").select("doc_id", "fp", "component_id", "size", *carried)
    return C.in_few(out, total)


def keep_one(docs: DataFrame, words: int = 4, k: int = 4) -> DataFrame:
    """One document of each component, that with the smallest doc_id (null is
    the largest, equal ones go by a hash of the text); the columns of docs.
    Rows with the same doc_id and text are one document: one of them stays."""
    key = C.row_key()
    # Components of keys, as doc_ids may be null or stand for several texts.
    named = docs.select(key.alias("doc_id"), "text", F.col("doc_id").cast("long").alias("id"))
    near = C.stash(simhash_groups(named, words, k, ("id",)).select(F.col("doc_id").alias("key"), "component_id", "id"), "near", docs.count())
    total = near.count()
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    first = C.stash(near.groupBy("component_id").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1"), "first", total)
    drop = C.attach(near, first, "component_id", "n", total, "inner").where(F.col("key") != F.col("first.key")).select(F.col("key").alias("k"))
    drop = C.stash(drop, "drop", total)
    rows = C.without(docs.withColumn("__key", key), drop, drop.count(), "__key")
    if not near.groupBy("key").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["__key"])
    return rows.select(*docs.columns)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(C.read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("size").alias("same_fingerprint"))


SQL: dict[str, str] = {}
