"""Exact dedup over a cuckoo-filter index of live digests.

The index is bucketed by digest. The cuckoo filter of a bucket decides: a digest
that it doesn't hold is new and is stored without a look at the stored keys; a
digest that it may hold is put aside and looked up among them. Digests can be
taken back (documents that are withdrawn); one without live rows leaves filter
and store. A filter that overflows is rebuilt at twice its size from the stored
keys. What the index calls copies is verified on content: texts that may be hit
are dealt to buckets by digest and content, and a digest with two contents is
split by content.

Defined cases: a null text counts as empty; empty texts are copies of each
other; rows with the same doc_id and text are copies too; a null doc_id is
larger than all others; texts of any length are hashed and compared whole; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SPACE = r"[\x20\x09-\x0D]+"
#: Distinct digests that one bucket of the index holds, about.
BUCKET_KEYS = 200_000
#: Filters of repeated digests are broadcast up to this size; beyond, a join.
FILTER_BYTES = 64 << 20


class CuckooFilter:
    """16-bit fingerprints, four slots a bucket, two buckets a key. Keys are
    64-bit numbers; the filter keeps no keys, its owner does."""

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int = 1024):
        self.n = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.9)))))
        self.table = np.zeros((self.n, self.SLOTS), dtype=np.uint16)
        self.used = 0

    @classmethod
    def loaded(cls, table: bytes) -> CuckooFilter:
        out = cls(1)
        out.table = np.frombuffer(table, np.uint16).reshape(-1, cls.SLOTS)
        out.n = len(out.table)
        return out

    def _place(self, key: int) -> tuple[int, int, int]:
        tag = (key >> 48) & 0xFFFF or 1
        first = key & (self.n - 1)
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ (((tag * 0x5BD1E995) >> 3) & (self.n - 1))

    def __contains__(self, key: int) -> bool:
        tag, i, j = self._place(key)
        return tag in self.table[i].tolist() or tag in self.table[j].tolist()

    def insert(self, key: int) -> bool:
        """False when it overflows: the owner then rebuilds it larger."""
        tag, i, j = self._place(key)
        for at in (i, j):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = tag
                self.used += 1
                return True
        moved, at = [], i
        for k in range(self.KICKS):
            slot = (k * 7 + tag) % self.SLOTS
            moved.append((at, slot, int(self.table[at, slot])))
            self.table[at, slot], tag = tag, moved[-1][2]
            at = self._other(at, tag)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = tag
                self.used += 1
                return True
        for at, slot, old in reversed(moved):  # as it was before
            self.table[at, slot] = old
        return False

    def delete(self, key: int) -> bool:
        tag, i, j = self._place(key)
        for at in (i, j):
            slots = np.flatnonzero(self.table[at] == tag)
            if len(slots):
                self.table[at, slots[0]] = 0
                self.used -= 1
                return True
        return False


class DigestIndex:
    """Live digests of one bucket: filter in front, stored keys behind."""

    #: Digests put aside before they are looked up together.
    ASIDE = 50_000

    def __init__(self, capacity: int = 1024):
        self.filter, self.resized = CuckooFilter(capacity), 0
        self.stored: list[list] = []  # [digest, smallest doc_id, live rows]
        self.aside: list[tuple] = []

    @staticmethod
    def short(digest: bytes) -> int:
        return int.from_bytes(digest[8:16], "big")

    def add(self, digest: bytes, doc_id: int | None, rows: int = 1) -> bool:
        """False if the digest is surely new; else it is put aside."""
        if self.short(digest) in self.filter:
            self.aside.append((digest, doc_id, rows))
            if len(self.aside) >= self.ASIDE:
                self.settle()
            return True
        self._store(digest, doc_id, rows)
        return False

    def _store(self, digest: bytes, doc_id: int | None, rows: int) -> None:
        while not self.filter.insert(self.short(digest)):
            self._grow()
        self.stored.append([digest, doc_id, rows])

    def _places(self, digests: set[bytes]) -> dict[bytes, int]:
        return {entry[0]: i for i, entry in enumerate(self.stored) if entry[0] in digests}

    def settle(self) -> None:
        """Look up what the filter may hold: a copy, or new after all."""
        at = self._places({digest for digest, _, _ in self.aside})
        for digest, doc_id, rows in self.aside:
            if digest in at:
                entry = self.stored[at[digest]]
                entry[1] = min((x for x in (entry[1], doc_id) if x is not None), default=None)
                entry[2] += rows
            else:
                at[digest] = len(self.stored)
                self._store(digest, doc_id, rows)
        self.aside = []

    def remove(self, gone: dict[bytes, int]) -> int:
        """Take back so many rows of digests; returns how many digests have no
        row left. Those leave the filter and the stored keys."""
        self.settle()
        at, dead = self._places({d for d in gone if self.short(d) in self.filter}), set()
        for digest, i in at.items():
            self.stored[i][2] -= gone[digest]
            if self.stored[i][2] <= 0:
                self.filter.delete(self.short(digest))
                dead.add(i)
        self.stored = [entry for i, entry in enumerate(self.stored) if i not in dead]
        return len(dead)

    def _grow(self) -> None:
        capacity = self.filter.n * self.filter.SLOTS
        while True:
            capacity *= 2
            self.resized += 1
            bigger = CuckooFilter(capacity)
            if all(bigger.insert(self.short(entry[0])) for entry in self.stored):
                self.filter = bigger
                return


def normalised(column: str = "text"):
    return F.regexp_replace(C.text_of(column), SPACE, " ")


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


ENTRY = "digest binary, doc_id long, n long, gone long"


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ((),) * 4, kinds, strict=True)], names=["digest", "doc_id", "n", "gone"])


def _local(batches):
    """One row per digest of a batch, so that copies meet before the shuffle."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by("digest").aggregate([("doc_id", "min"), ("n", "sum"), ("gone", "sum")])
        t = t.select(["digest", "doc_id_min", "n_sum", "gone_sum"]).rename_columns(["digest", "doc_id", "n", "gone"])
        yield from t.combine_chunks().to_batches()


def _index(batches):
    """One bucket of the index: (digest, smallest live doc_id, live rows, rows
    taken back) of every digest; 0 live rows if it left the index."""
    index, gone = DigestIndex(), {}
    for b in batches:
        for digest, doc_id, n, back in zip(*(c.to_pylist() for c in b.columns), strict=True):
            index.add(digest, doc_id, n)
            if back:
                gone[digest] = gone.get(digest, 0) + back
    index.remove(gone)
    for at in range(0, len(index.stored), 50_000):
        part = index.stored[at : at + 50_000]
        yield _entries([(d, doc_id, n, gone.pop(d, 0)) for d, doc_id, n in part])
    yield _entries([(d, None, 0, n) for d, n in gone.items()])


def digests(docs: DataFrame, hashed=sha256) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashed(normalised()).alias("digest"))


def build_index(keyed: DataFrame, total: int) -> DataFrame:
    """The index of (doc_id, digest, gone: the row was taken back), by hash
    buckets."""
    parts = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_KEYS + 1)
    live = F.when(~F.col("gone"), F.col("doc_id"))
    local = keyed.select("digest", live.alias("doc_id"), F.lit(1).cast("long").alias("n"), F.col("gone").cast("long").alias("gone")).mapInArrow(_local, ENTRY)
    return local.repartition(parts, "digest").mapInArrow(_index, ENTRY)


def _filters(batches, buckets: int):
    made: dict[int, DigestIndex] = {}
    for b in batches:
        for digest in b.column(0).to_pylist():
            made.setdefault(bucket_of(digest, buckets), DigestIndex()).add(digest, 0)
    for index in made.values():
        index.settle()
    yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([i.filter.table.tobytes() for i in made.values()], pa.binary())], names=["bucket", "filter"])


def bucket_of(digest: bytes, buckets: int) -> int:
    return int.from_bytes(digest[:4], "big") % buckets


def broadcast_filters(groups: DataFrame, n: int):
    """The cuckoo filters of all buckets, broadcast; None where they might
    exceed FILTER_BYTES (a key takes 2 to 9 bytes)."""
    if n * 9 > FILTER_BYTES:
        return None
    buckets = n // BUCKET_KEYS + 1
    dealt = groups.select("digest").repartition(buckets, F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(buckets)))
    rows = dealt.mapInArrow(partial(_filters, buckets=buckets), "bucket int, filter binary").collect()  # one row per bucket and bound as above
    return groups.sparkSession.sparkContext.broadcast((buckets, {r["bucket"]: bytes(r["filter"]) for r in rows}))


def maybe_live(filters, digest):
    """Condition on a digest column: False only for digests not in the index."""

    @F.arrow_udf("boolean")
    def hit(column: pa.Array) -> pa.Array:
        buckets, tables = filters.value
        ready = {k: CuckooFilter.loaded(v) for k, v in tables.items()}
        none = CuckooFilter(1)
        return pa.array([DigestIndex.short(d) in ready.get(bucket_of(d, buckets), none) for d in column.to_pylist()], pa.bool_())

    return hit(digest)


def exact_dedup(docs: DataFrame, retracted: DataFrame | None = None, hashed=sha256) -> DataFrame:
    """Every row of docs: doc_id, keep_id, group_size, kept, text_sha256. Of
    equal texts the smallest doc_id stays (of equal rows, one). Rows whose
    doc_id is in ``retracted`` are taken back from the index: they aren't kept
    and don't count; keep_id is null where no other copy is left."""
    keyed = digests(docs, hashed)
    if retracted is None:
        keyed = keyed.withColumn("gone", F.lit(False))
    else:
        back = retracted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("gone", F.lit(True))
        keyed = keyed.join(back, "doc_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    keyed = C.stash(keyed, "digests")
    total = keyed.count()
    groups = C.stash(build_index(keyed, total).where("n > 1 or gone > 0"), "index", total)  # a digest seen once needs no check
    hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("content")).withColumn("digest", hashed(F.col("content")))
    n = groups.count()
    filters = broadcast_filters(groups, n)
    if filters is None:
        some = hits.join(groups.select("digest").hint("shuffle_merge"), "digest", "left_semi")
    else:
        some = hits.where(maybe_live(filters, F.col("digest")))
    # Of equal contents one goes on from each task; grouping compares them whole.
    unlike = some.groupBy("digest", "content").agg(F.lit(1).alias("one")).groupBy("digest").count().where("count > 1").select("digest")
    unlike = C.stash(unlike, "unlike", n)
    entry = groups.select("digest", F.col("doc_id").alias("first"), "n", F.lit(True).alias("known"), (F.col("n") + F.col("gone")).alias("rows"))
    if unlike.isEmpty():
        out = C.attach(keyed, entry, "digest", "rows", total)
    else:  # one digest, several contents: these are told apart by content
        back = keyed.where("gone").select("doc_id").distinct().withColumn("gone", F.lit(True))
        named = hits.join(unlike, "digest").join(back, "doc_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
        own = named.groupBy("digest", "content").agg(F.min(F.when(~F.col("gone"), F.col("doc_id"))).alias("first"), F.count_if(~F.col("gone")).alias("n"), F.count("*").alias("rows"))
        own = own.withColumn("known", F.lit(True)).withColumn("content_key", F.struct("digest", "content")).drop("digest", "content")
        named = named.withColumn("content_key", F.struct("digest", "content"))
        apart = C.attach(named, own, "content_key", "rows", total).drop("content_key", "content")
        out = C.attach(keyed.join(unlike, "digest", "left_anti"), entry, "digest", "rows", total).unionByName(apart)
    first = F.when(F.col("known"), F.col("first")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        first.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (first.eqNullSafe(F.col("doc_id")) & ~F.col("gone")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, retracted: DataFrame | None = None) -> DataFrame:
    """docs without the rows that copy one with a smaller doc_id, and without
    retracted ones; its columns. Rows with the same doc_id and text are one
    document: one of them stays."""
    gone = C.stash(exact_dedup(docs, retracted).where("not kept or group_size > 1").select("doc_id", "text_sha256", "kept"), "copies", docs.count())
    key = F.xxhash64("doc_id", "__sha")
    rows = docs.withColumn("__sha", F.sha2(normalised(), 256)).withColumn("__key", key)
    drop = gone.where("not kept").select(F.xxhash64("doc_id", "text_sha256").alias("k"))
    rows = C.without(rows, drop, drop.count(), "__key")
    if not gone.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "__sha"])
    return rows.select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(C.read_table(spark, sf_dir, "documents"))


SQL = {
    "op2_exact_dedup": r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
  min(doc_id) over w = doc_id as kept, sha256(t) as text_sha256
from n window w as (partition by t)
""",
}
