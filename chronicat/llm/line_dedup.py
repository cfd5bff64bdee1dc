"""Line dedup over content-defined chunks of lines.

Line hashes are rolled over two lines; where the rolled hash is divisible by
SPARSITY a chunk ends, so boundaries follow content and survive shifts. A chunk
of two lines or more that occurred before (smaller doc_id, or earlier in the
same document) is removed, after chunks of equal hash were compared byte by
byte; should two differ, all of that hash stay.

A repeated run needn't be made of whole chunks: it may begin or end within one,
or hold none. So what the chunks leave is taken up at every line: windows of
two lines that lie in no removed chunk are looked up in the same way, and each
line of any repeated run of two lines or more goes, wherever it stands. Pieces
may overlap, as in three equal lines, of which the first stays.

Defined cases: null text is empty; an empty text is one empty line; rows with
the same doc_id and text are one document; ties of doc_id go by a hash of the
text; chunks have no greatest length, and very long texts are read whole; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SPARSITY, LEAST_LINES = 3, 2


def bounds(lines: list[bytes]) -> list[int]:
    """Where chunks begin, and the number of lines."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))
    rolled = h.copy()
    rolled[1:] = C.rolling(h, 2, 0x9E3779B97F4A7C15)
    out = [0]
    for end in (np.flatnonzero(C.mix(rolled) % np.uint64(SPARSITY) == 0) + 1).tolist():
        if end - out[-1] >= LEAST_LINES:
            out.append(end)
    return out if out[-1] == len(lines) else [*out, len(lines)]


def pieces(text: bytes) -> Iterator[tuple[bool, bytes, int, int, bytes, int]]:
    """Chunks and windows: (is a chunk, hash, first line, lines, piece, number
    of the chunk that holds it or -1). Hashes of the two kinds never meet."""
    lines = text.split(b"\n")
    if len(lines) < LEAST_LINES:
        return
    edges, last = bounds(lines), len(lines) - LEAST_LINES
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if hi - lo >= LEAST_LINES:
            piece = b"\n".join(lines[lo:hi])
            yield True, xxhash.xxh128_digest(piece, 1), lo, hi - lo, piece, k
        for at in range(lo, min(hi - 1, last) + 1):
            piece = b"\n".join(lines[at : at + LEAST_LINES])
            yield False, xxhash.xxh128_digest(piece, 0), at, LEAST_LINES, piece, k if at + LEAST_LINES <= hi else -1


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


PLACES = "is_chunk boolean, h long, g long, row long, doc_id long, at long, n long, chunk long"


def _places(batches):
    for b in batches:
        for s in C.slices(b):
            found = [(kind, digest, row, doc_id, at, n, k) for row, doc_id, text in zip(s.column("row").to_pylist(), s.column("doc_id").to_pylist(), _texts(s), strict=True) for kind, digest, at, n, _, k in pieces(text)]
            kinds, digests, *rest = zip(*found, strict=True) if found else ((),) * 7
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.bool_()), *_halves(list(digests)), *(pa.array(c, pa.int64()) for c in rest)], names=[c.split()[0] for c in PLACES.split(", ")])


def _contents(batches, known, log: int):
    """(h, g, piece) of the pieces that may recur."""
    for b in batches:
        for s in C.slices(b):
            found = [(digest, piece) for text in _texts(s) for _, digest, _, _, piece, _ in pieces(text)]
            h, g = _halves([d for d, _ in found])
            out = pa.RecordBatch.from_arrays([h, g, pa.array([x for _, x in found], pa.binary())], names=["h", "g", "piece"])
            yield out if known is None else out.filter(pa.array(C.KeySet.has(known.value, log, np.asarray(h))))


def _cut(batches):
    for b in batches:
        removed, sha, texts = [], [], []
        for text, spans in zip(_texts(b), b.column("spans").to_pylist(), strict=True):
            lines = text.split(b"\n")
            gone = np.zeros(len(lines), bool)
            for span in spans:
                gone[span["at"] : span["at"] + span["n"]] = True
            kept = b"\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g)
            removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], names=["row", "n_removed", "kept_sha256", "kept_text"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(C.row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), C.text_of().alias("text"))


def _spans(rows: DataFrame, seams: bool) -> DataFrame:
    """(row, at, n): the lines of every piece that occurred before."""
    places = C.stash(rows.mapInArrow(_places, PLACES).where(F.lit(seams) | F.col("is_chunk")), "pieces")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "at")).alias("first")
    again = C.stash(places.groupBy("h", "g").agg(first, F.count("*").alias("times")).where("times > 1"), "again")
    known = C.KeySet(again.select(F.col("h").alias("k")), again.count())
    contents = rows.mapInArrow(partial(_contents, known=known.bits, log=known.log), "h long, g long, piece binary")
    # Equal pieces of a task meet before the shuffle; grouping compares their bytes.
    unlike = contents.groupBy("h", "g", "piece").agg(F.lit(1).alias("one")).groupBy("h", "g").count().where("count > 1").select("h", "g")
    again = C.stash(again.join(unlike, ["h", "g"], "left_anti").select(F.struct("h", "g").alias("key"), "first", "times"), "again")
    total = again.agg(F.sum("times")).first()[0] or 0
    # Only pieces that may recur are shuffled.
    may = (places if known.bits is None else places.where(known.maybe(F.col("h")))).withColumn("key", F.struct("h", "g"))
    inner = F.xxhash64("row", "chunk")

    def late(of: DataFrame) -> DataFrame:
        own = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "at")
        return C.attach(of, again, "key", "times", total, "inner").where(own != F.col("first")).select("row", "at", "n", inner.alias("chunk"))

    chunks = C.stash(late(may.where("is_chunk")), "chunks")
    if not seams:
        return chunks.drop("chunk")
    # Of equal windows the first lies in no removed chunk: that would have come earlier.
    rest = C.without(may.where("not is_chunk").withColumn("inner", inner), chunks.select(F.col("chunk").alias("k")), chunks.count(), "inner")
    return chunks.unionByName(late(rest)).drop("chunk")


def _left(rows: DataFrame, seams: bool) -> DataFrame:
    spans = C.stash(_spans(rows, seams).groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("spans")), "spans")
    some = C.matching(rows, spans, spans.count(), "row").select("row", "text", "spans")
    return some.mapInArrow(_cut, "row long, n_removed long, kept_sha256 string, kept_text string").dropDuplicates(["row"])


def line_dedup(docs: DataFrame, seams: bool = True) -> DataFrame:
    """Every row of docs: doc_id, n_lines, n_removed, kept_sha256. Without
    ``seams`` only whole chunks go."""
    rows = _rows(docs)
    cut = C.stash(_left(rows, seams).drop("kept_text"), "cut")
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    heads = C.stash(rows.select("row", "doc_id", lines.alias("lines"), F.sha2("text", 256).alias("sha")), "heads")
    return heads.join(cut, "row", "left").select("doc_id", F.col("lines").alias("n_lines"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def strip_repeated_lines(docs: DataFrame, seams: bool = True) -> DataFrame:
    """docs with the repeated lines taken out of ``text``; other columns as
    they are."""
    cut = C.stash(_left(_rows(docs), seams).select(F.col("row").alias("__row"), F.col("kept_text").alias("__kept")), "cut")
    out = docs.withColumn("__row", C.row_key()).join(cut, "__row", "left").withColumn("text", F.coalesce("__kept", "text"))
    return out.select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(C.read_table(spark, sf_dir, "documents"))


#: A line goes if a pair of neighbouring lines that occurred before holds it.
SQL = {
    "op5_line_dedup": r"""
with lines as (
  select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents)),
pairs as (
  select doc_id, pos, line, lead(line) over (partition by doc_id order by pos) as next from lines),
late as (
  select doc_id, pos, line, next is not null and row_number() over (partition by line, next order by doc_id, pos) > 1 as late from pairs),
marked as (
  select doc_id, pos, line, late or coalesce(lag(late) over (partition by doc_id order by pos), false) as gone from late)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
""",
}
