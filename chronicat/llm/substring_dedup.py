"""Substring dedup by relative Lempel-Ziv factors.

Every document is both reference and text to factor. Reference blocks are
indexed by content-defined anchors: of every window of 20 words, the eight-word
phrase with the least hash. A block holds, of all documents, the words around
one anchor; equal windows have equal anchors at the same offset, so a document
has to be factored only against the blocks of its own anchors, and only where
an anchor occurs again.

A block is read in the order of doc_id and start. A factor begins at a window
that occurred before and is carried on greedily, window by window, as long as
its occurrence in the reference goes on as well. Where it doesn't, a boundary,
the next window is looked up anew among all the block holds, so windows that
straddle two factors are found too. Words are compared, hashes only propose.
Factors of 20 words and more are the duplicate spans; ``factors`` returns them
with their references.

Whole copies of a word sequence are settled first, by the SHA-256 of the
sequence. Occurrences in the same slice of a task are factored there before the
shuffle, so a passage that is everywhere costs one row per slice; anchors that
very many slices hold are split by window.

Defined cases: null texts have no words; documents below 20 words lose none;
rows with the same doc_id and text are one document, so neither precedes the
other; of equal windows the one with the smallest doc_id, then the earliest,
stays (ties of doc_id go by a hash of the text); very long texts are factored
whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, PHRASE = 20, 8
#: Text that is factored at a time.
SLICE = 2 << 20
#: Anchors that more slices than these hold are split by window.
CROWDED = 10_000
#: Rows that a task factors, about.
BLOCK_ROWS = 250_000
EMPTY = hashlib.sha256(b"").digest()


def _heads(batches):
    for b in batches:
        n, sha = [], []
        for t in b.column(2):
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.binary())], names=["row", "doc_id", "n_words", "sha"])


def _windows_of(texts, window: int, phrase: int):
    """Code and hash of every word, the words, document of each, where texts
    begin, starts of whole windows, their anchors' positions, phrase hashes."""
    offsets, codes, words = C.split_words(texts)
    hashes = C.word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.zeros(0, np.int64)
    if len(hashes) >= window:
        starts = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
    if not len(starts):
        return codes, hashes, words, doc, offsets, starts, starts, np.zeros(0, np.uint64)
    phrases = C.mix(C.rolling(hashes, phrase, 0x9E3779B97F4A7C15))
    views, anchors = sliding_window_view(phrases, window - phrase + 1), np.empty(len(starts), np.int64)
    for at in range(0, len(starts), 1 << 18):
        some = starts[at : at + (1 << 18)]
        low, high = some[0], some[-1] + 1
        anchors[at : at + (1 << 18)] = views[low:high].argmin(axis=1)[some - low] + some
    return codes, hashes, words, doc, offsets, starts, anchors, phrases


def _anchors(batches, window: int, phrase: int):
    """(anchor, times): a row per distinct anchor and slice."""
    for b in batches:
        for s in C.slices(b, "text", SLICE):
            *_, anchors, phrases = _windows_of(s.column("text"), window, phrase)
            found, times = np.unique(phrases[np.unique(anchors)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int32))], names=["anchor", "times"])


def _first(group: np.ndarray, w: np.ndarray, codes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Of every window (its words are codes[at : at + window], w their hash) the
    first one in its group with the same words."""
    out, todo = np.arange(len(at)), np.arange(len(at))
    while len(todo):
        by = todo[np.lexsort((w[todo], group[todo]))]
        new = np.concatenate(([True], (w[by][1:] != w[by][:-1]) | (group[by][1:] != group[by][:-1])))
        first = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        by, first = by[~new], first[~new]
        same = np.ones(len(by), bool)
        for j in range(window):
            same &= codes[at[first] + j] == codes[at[by] + j]
        out[by[same]] = first[same]
        todo = np.sort(by[~same])  # equal hashes of different words: once more
    return out


def _breaks(*steady: np.ndarray, rising: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where a run ends: a steady column changes or a rising one doesn't go up
    by one."""
    out = np.zeros(max(0, len(rising[0]) - 1), bool)
    for x in steady:
        out |= x[1:] != x[:-1]
    for x in rising:
        out |= np.diff(x) != 1
    return np.concatenate(([True], out)) if len(rising[0]) else np.zeros(0, bool)


def _joined(words: list[str], codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """codes[lo:hi] as words joined by one space, for each lo and hi."""
    sizes = hi - lo
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(lo - ends[:-1], sizes) + np.arange(ends[-1])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words, pa.string()).take(pa.array(codes[at]))), " ")


FACTORS = "key long, doc_id long, row long, start long, until long, source long, source_start long, words string, anchor long"
FOUND = "row long, start long, until long, source long, source_start long"


def _factors(batches, known, log: int, crowded, crowded_log: int, window: int, phrase: int):
    """What the slices tell the blocks: the words around anchors that recur
    (until = 0; of windows that occur again in the slice the first only; one
    row for neighbours at one anchor), and the factors whose reference is in
    the slice: windows [start, until) equal those from source_start on. Equal
    windows have equal keys: the anchor, or for crowded ones the window."""
    for b in batches:
        for s in C.slices(b, "text", SLICE):
            row, ids = np.asarray(s.column("row")), np.asarray(s.column("doc_id").fill_null(0))
            null = np.asarray(s.column("doc_id").is_null())
            order = np.lexsort((row, ids, null))
            row, ids, null = row[order], ids[order], null[order]
            codes, hashes, words, doc, offsets, starts, anchors, phrases = _windows_of(s.column("text").take(pa.array(order)), window, phrase)
            if known is not None and len(starts):
                some = C.KeySet.has(known.value, log, phrases[anchors])
                starts, anchors = starts[some], anchors[some]
            if not len(starts):
                continue
            w = np.zeros(len(starts), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(window):
                    w = w * np.uint64(0xD6E8FEB86659FD93) + hashes[starts + j]
            w, key = C.mix(w), phrases[anchors]
            if crowded is not None:
                key = np.where(C.KeySet.has(crowded.value, crowded_log, key), w, key)
            of = doc[starts]
            again = np.concatenate(([False], (row[1:] == row[:-1]) & (ids[1:] == ids[:-1]) & (null[1:] == null[:-1])))
            rank = np.cumsum(~again)[of]  # rows of the same document share a rank
            local = starts - offsets[of]
            first = _first(np.zeros(len(w), np.int8), w, codes, starts, window)
            new = first == np.arange(len(first))
            keep, late = np.flatnonzero(new), np.flatnonzero((rank[first] != rank) | (local[first] != local))
            at = keep[_breaks(of[keep], key[keep], rising=(starts[keep],))]
            cut = np.flatnonzero(_breaks(of[keep], key[keep], rising=(starts[keep],)))
            last = keep[np.append(cut[1:], len(keep)) - 1]
            run = np.flatnonzero(_breaks(of[late], of[first[late]], rising=(starts[late], starts[first[late]])))
            begin, end = late[run], late[np.append(run[1:], len(late))[: len(run)] - 1]
            rows, source = np.concatenate((at, begin)), first[begin]
            no = np.zeros(len(at), np.int64)
            whole = lambda x, y, mask: pa.array(np.concatenate((x, y)), mask=mask)
            told = np.concatenate((np.ones(len(at), bool), null[of[source]]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((key[at].view(np.int64), row[of[begin]]))),
                    pa.array(ids[of[rows]], mask=null[of[rows]]),
                    pa.array(row[of[rows]]),
                    pa.array(local[rows]),
                    pa.array(np.concatenate((no, local[end] + 1))),
                    whole(no, ids[of[source]], told),
                    whole(no, local[source], np.concatenate((np.ones(len(at), bool), np.zeros(len(begin), bool)))),
                    pa.concat_arrays([_joined(words, codes, starts[at], starts[last] + window), pa.array([""] * len(begin), pa.string())]),
                    pa.array(phrases[anchors[rows]].view(np.int64)),
                ],
                names=[c.split()[0] for c in FACTORS.split(", ")],
            )


def _late(batches, window: int):
    """Rows come sorted by key, doc_id, row, start: the words of blocks, which
    are factored against what came before under the same key, and the factors
    that are known, which pass. Of a key that goes on in the next batch, the
    rows with a new window are held."""
    held = None
    for b in batches:
        n = 0
        if held is not None:
            n, b = len(held), pa.Table.from_batches([held, b.select(held.schema.names)]).combine_chunks().to_batches()[0] if len(b) else held
        if len(b) == n:
            continue
        key, row, start, until = (np.asarray(b.column(c)) for c in ("key", "row", "start", "until"))
        offsets, codes, _ = C.split_words(b.column("words"))
        sizes = np.maximum(np.diff(offsets) - window + 1, 0)
        of = np.repeat(np.arange(len(key)), sizes)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at, starts = offsets[of] + inner, start[of] + inner
        w = C.mix(C.rolling(C.mix(codes.astype(np.uint64) + np.uint64(1)), window, 0xD6E8FEB86659FD93))[at]
        first = _first(key[of], w, codes, at, window)
        late = (row[of][first] != row[of]) | (starts[first] != starts)
        late[of < n] = False
        late = np.flatnonzero(late)
        mine, theirs = of[late], of[first[late]]
        run = np.flatnonzero(_breaks(row[mine], theirs, rising=(starts[late], starts[first[late]])))
        begin, end = late[run], late[np.append(run[1:], len(late))[: len(run)] - 1]
        fresh = pa.RecordBatch.from_arrays(
            [pa.array(row[of[begin]]), pa.array(starts[begin]), pa.array(starts[end] + 1), b.column("doc_id").take(pa.array(of[first[begin]])), pa.array(starts[first[begin]])],
            names=[c.split()[0] for c in FOUND.split(", ")],
        )
        yield fresh
        yield b.slice(n).filter(pa.array(until[n:] > 0)).select(fresh.schema.names)
        on = np.zeros(len(key), bool)
        on[of[first == np.arange(len(first))]] = True
        held = b.filter(pa.array(on & (key == key[-1])))


def _cut(batches, window: int):
    for b in batches:
        removed, sha, texts = [], [], []
        for text, starts, untils in zip(b.column("text"), b.column("starts"), b.column("untils"), strict=True):
            words = np.array((text.as_py() or "").encode("utf-8", "surrogatepass").split(), dtype=object)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.asarray(starts.values), 1)
            np.add.at(edge, np.asarray(untils.values) - 1 + window, -1)
            left = words[np.cumsum(edge)[:-1] == 0]
            kept = b" ".join(left.tolist())
            removed.append(len(words) - len(left))
            sha.append(hashlib.sha256(kept).digest())
            texts.append(kept.decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(removed, pa.int64()), pa.array(sha, pa.binary()), pa.array(texts, pa.string())], names=["row", "removed", "kept_sha", "kept_text"])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _repeats(docs: DataFrame, window: int, phrase: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heads with ``copy`` and ``first``; rows that aren't copies; their
    factors)."""
    rows = _rows(docs)
    heads = C.stash(rows.mapInArrow(_heads, "row long, doc_id long, n_words long, sha binary"), "heads")
    total = heads.count()
    copies = C.stash(heads.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    marked = C.attach(heads, copies, "sha", "n", total).withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    plain, heads = heads, C.stash(marked.select("row", "doc_id", "n_words", "sha", "copy", "first"), "heads")
    C.discard(plain)
    gone = heads.where("copy").select(F.col("row").alias("k"))
    once = C.without(rows, gone, gone.count(), "row")
    anchors = once.mapInArrow(partial(_anchors, window=window, phrase=phrase), "anchor long, times int")
    again = C.stash(anchors.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1"), "anchors")
    known = C.KeySet(again.select(F.col("anchor").alias("k")), again.count())
    often = again.where(F.col("times") > CROWDED)  # at most one in CROWDED
    crowded = C.KeySet(often.select(F.col("anchor").alias("k")), often.count())
    found = once.mapInArrow(partial(_factors, known=known.bits, log=known.log, crowded=crowded.bits, crowded_log=crowded.log, window=window, phrase=phrase), FACTORS)
    if known.bits is None:
        found = found.where("until > 0").unionByName(found.where("until = 0").join(again, "anchor", "left_semi"))
    # Rows for the blocks are about as many as slices that hold recurring anchors.
    many = again.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), many // BLOCK_ROWS)
    found = found.drop("anchor").repartition(parts, "key").sortWithinPartitions("key", F.col("doc_id").asc_nulls_last(), "row", "start")
    return heads, once, C.stash(found.mapInArrow(partial(_late, window=window), FOUND), "factors")


def _left(once: DataFrame, late: DataFrame, window: int) -> DataFrame:
    """What is left of the documents that lose a part."""
    spans = C.stash(late.groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("until").alias("untils")), "spans")
    some = C.matching(once, spans, spans.count(), "row")
    return some.select("row", "text", "starts", "untils").mapInArrow(partial(_cut, window=window), "row long, removed long, kept_sha binary, kept_text string").dropDuplicates(["row"])


def factors(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, start, length, source, source_start: the words of doc_id from
    start on are those of document ``source`` from source_start on. Factors
    may overlap; whole copies are one factor."""
    heads, _, late = _repeats(docs, window, phrase)
    names = heads.select("row", "doc_id").distinct()
    part = late.join(names, "row").select("doc_id", "start", (F.col("until") - F.col("start") + window - 1).alias("length"), "source", "source_start")
    whole = heads.where(F.col("copy") & (F.col("n_words") >= window)).select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length"), F.col("first").alias("source"), F.lit(0).cast("long").alias("source_start"))
    return part.unionByName(whole)


def substring_dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    heads, once, late = _repeats(docs, window, phrase)
    cut = C.stash(_left(once, late, window).drop("kept_text"), "cut")
    whole = F.col("copy") & (F.col("n_words") >= window)
    out = heads.join(cut, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
    )


def strip_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """docs with the duplicate words taken out of ``text`` (words of changed
    texts are joined by one space); other columns as they are."""
    heads, once, late = _repeats(docs, window, phrase)
    cut = C.stash(_left(once, late, window).select("row", "kept_text"), "cut")
    copy = heads.where((F.col("n_words") >= window) & F.col("copy")).select("row").distinct().withColumn("kept_text", F.lit(""))
    keyed = docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    gone = cut.unionByName(copy).select(F.col("row").alias("__row"), F.col("kept_text").alias("__kept"))
    out = keyed.join(gone, "__row", "left").withColumn("text", F.coalesce("__kept", "text"))
    return out.select(*docs.columns)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(C.read_table(spark, sf_dir, "documents"))


SQL = {
    "op6_substring_dedup": r"""
with words as (
  select doc_id, unnest(words) as word, unnest(range(len(words))) as pos
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents)),
windows as (
  select doc_id, pos, word, string_agg(word, ' ') over w as passage, count(*) over w as n
  from words window w as (partition by doc_id order by pos rows between current row and 19 following)),
late as (
  select doc_id, pos, word, n = 20 and row_number() over (partition by n, passage order by doc_id, pos) > 1 as late from windows),
marked as (
  select doc_id, pos, word, bool_or(late) over (partition by doc_id order by pos rows between 19 preceding and current row) as gone from late),
per as (
  select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by pos) filter (not gone) as kept
  from marked group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join per on d.doc_id = per.doc_id
""",
}
