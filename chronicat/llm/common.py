"""What the operators of this subpackage share: reading tables, tables kept in
the cluster's shared folder, whitespace tokenising on Arrow buffers, key joins
that stay balanced when one key holds much of the input, and connected
components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step holds as word arrays at a time.
SLICE_BYTES = 3 << 20
#: A key is hot when it holds more than this share of the rows, so that there
#: are at most 2 * HOT_KEYS hot keys however large the input is.
HOT_KEYS = 1000
#: Rows of a narrow table that one task writes, where that leaves enough tasks.
TASK_ROWS = 200_000

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_MADE: dict[str, SparkSession] = {}


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it
    (on a cluster it is installed, or given by --py-files), and keep Arrow
    batches of whole texts small, by rows and by bytes, unless the session
    says otherwise."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2000")
    if spark.conf.get(BATCH_BYTES) in ("67108864", "67108864b", "64MB"):
        spark.conf.set(BATCH_BYTES, "8388608")
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, (root, env.get("PYTHONPATH"))))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a
    temporary one if all runs on one machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="chronicat-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def in_few(df: DataFrame, rows: int, least: int | None = None) -> DataFrame:
    """A narrow table of about ``rows`` rows at most, in a task for each
    TASK_ROWS of them instead of one for each shuffle partition; ``least``
    tasks at least, or two a core."""
    return df.coalesce(max(least or 2 * df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS + 1))


def stash(df: DataFrame, name: str, rows: int | None = None, least: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. Cuts the
    lineage, and survives the loss of any executor. ``rows`` and ``least``: a
    narrow table is written ``in_few`` tasks, a file each."""
    spark = df.sparkSession
    if rows is not None:
        df = in_few(df, rows, least)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    _MADE[path] = spark
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stash`` returned and nothing needs any more."""
    for path in (t._stashed for t in tables):
        spark = _MADE.pop(path)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Delete every table that ``stash`` wrote; results that were not yet
    written become unreadable."""
    for path, spark in list(_MADE.items()):
        if spark.sparkContext._jsc is None:  # it has been stopped
            return
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        del _MADE[path]


def _release_at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM may have ended before Python
        return


atexit.register(_release_at_exit)


def text_of(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key():
    """A well mixed long of doc_id and text: null and shared ids tell texts
    apart, and rows with the same doc_id and text are one document."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.sha2(text_of(), 256))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text (one
    longer text stands alone)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: offsets (one more than
    texts), a code per word, and the word of each code."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    codes = np.asarray(coded.indices, dtype=np.int64)
    if "" in words:
        keep = codes != words.index("")
        before = np.concatenate(([0], np.cumsum(keep)))
        codes, offsets = codes[keep], before[offsets]
    return offsets, codes, words


def word_hashes(words: list[str], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hash of every n consecutive values."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out *= np.uint64(base)
            out += h[j : j + m]
    return out


def attach(left: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """Join ``groups`` (one row per key, ``size`` = rows of ``left`` with that
    key) to ``left``. Keys with more than 1/HOT_KEYS of the rows go by a
    broadcast of at most HOT_KEYS rows (the sizes sum to ``total``), all others
    by an ordinary join, so no task gets a hot key."""
    limit = max(1000, total // HOT_KEYS)
    if total <= limit:
        return left.join(groups, key, how)
    hot, cold = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    by_hot = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return by_hot.unionByName(rest)


class KeySet:
    """A set of 64-bit keys as a bit table, for tests that may say yes in error
    but never no. Built in slices by the executors; ``bits`` is a broadcast of
    at most ``LIMIT`` bytes, or None where so many keys don't fit: callers then
    join. ``keys`` needs a long column k whose bits are well mixed."""

    LIMIT, EACH, SLICE = 64 << 20, 8, 20

    def __init__(self, keys: DataFrame, n: int):
        spark = keys.sparkSession
        self.log = max(self.SLICE, int(np.ceil(np.log2(max(1, n) * self.EACH))))
        self.bits = None
        if 1 << (self.log - 3) > self.LIMIT:
            return
        low, log = self.log - self.SLICE, self.log

        def fill(batches):
            made: dict[int, np.ndarray] = {}
            for b in batches:
                at = np.asarray(b.column(0)).view(np.uint64) >> np.uint64(64 - log)
                for part in np.unique(at >> np.uint64(KeySet.SLICE)).tolist():
                    own = (at[at >> np.uint64(KeySet.SLICE) == part] & np.uint64((1 << KeySet.SLICE) - 1)).astype(np.int64)
                    table = made.setdefault(part, np.zeros(1 << (KeySet.SLICE - 3), np.uint8))
                    np.bitwise_or.at(table, own >> 3, (1 << (own & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([t.tobytes() for t in made.values()], pa.binary())], names=["part", "bits"])

        part = F.shiftrightunsigned("k", 64 - low) if low else F.lit(0)
        table = np.zeros(1 << (self.log - 3), np.uint8)
        width = 1 << (self.SLICE - 3)
        if n:
            dealt = keys.select("k").repartition(max(1, min(1 << low, int(spark.conf.get("spark.sql.shuffle.partitions")))), part) if low else keys.select("k")
            for r in dealt.mapInArrow(fill, "part long, bits binary").toLocalIterator():
                table[r["part"] * width : (r["part"] + 1) * width] |= np.frombuffer(bytes(r["bits"]), np.uint8)
        self.bits = spark.sparkContext.broadcast(table)

    @staticmethod
    def has(table: np.ndarray, log: int, keys: np.ndarray) -> np.ndarray:
        at = (keys.view(np.uint64) >> np.uint64(64 - log)).astype(np.int64)
        return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def maybe(self, key):
        """A condition on a long column: False only if the key isn't there."""

        bits, log = self.bits, self.log

        @F.arrow_udf("boolean")
        def hit(k: pa.Array) -> pa.Array:
            return pa.array(KeySet.has(bits.value, log, np.asarray(k)))

        return hit(key)


def without(docs: DataFrame, keys: DataFrame, n: int, key: str) -> DataFrame:
    """docs whose ``key`` (a well mixed long) isn't in keys.k (n rows). Only
    rows that the key set can't clear are shuffled."""
    gone = keys.select(F.col("k").alias(key)).distinct()
    known = KeySet(keys, n)
    if known.bits is None:
        return docs.join(gone, key, "left_anti")
    tried = docs.withColumn("__maybe", known.maybe(F.col(key)))
    clear = tried.where("not __maybe").drop("__maybe")
    return clear.unionByName(tried.where("__maybe").drop("__maybe").join(gone.hint("shuffle_merge"), key, "left_anti"))


def matching(docs: DataFrame, keys: DataFrame, n: int, key: str) -> DataFrame:
    """docs that share ``key`` with a row of keys, joined to it; only rows that
    may match are shuffled."""
    known = KeySet(keys.select(F.col(key).alias("k")), n)
    tried = docs if known.bits is None else docs.where(known.maybe(F.col(key)))
    return tried.join(keys.hint("shuffle_merge"), key)


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """Connected components of an undirected graph given as pairs of longs, by
    alternating large-star and small-star steps. Returns (node, root) for every
    node that has an edge and isn't the smallest of its component. ``rows``:
    about how many edges there are at most, if known."""
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    e, before = stash(e, "edges", rows), None
    while True:
        n, sign = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, sign) == before:
            break
        before = (n, sign)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = least.withColumn("m", F.least("u", "m"))
        large = attach(both, least, "u", "n", 2 * n, "inner").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stash(large, "edges", n, 1)  # read several times below
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = attach(large, least, "a", "n", n, "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        old, e = e, stash(small, "edges", 2 * n, 1)
        discard(old, large)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))

