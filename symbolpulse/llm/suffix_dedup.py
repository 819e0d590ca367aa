"""Repeated passages by sparse suffix arrays.

Of all suffixes of all texts only those at minimiser positions are kept: every window of
``least`` words picks the position in it whose next words hash lowest, so two equal windows
pick the same one.  The kept suffixes are sorted by their first words and then by all words
that their windows span; neighbours in that order are compared.  Equal neighbours repeat
as a whole.  Neighbours that only begin alike are extended to the left and right, window
by window.  Suffixes without a neighbour of another document are dropped at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import stored
from .common import WORD, batches_of, join_counted, map_texts, spare
from .minhash_dedup import ODD, WordHashes, _mixed

BATCH_BYTES = 1 << 21
SEED_WORDS = 16
INVERSE = np.uint64(pow(int(ODD), -1, 2**64))


class Batch:
    """The words of some texts in a row, with hashes of any stretch of them."""

    def __init__(self, texts: list[str | None], known: WordHashes):
        words = [(t or "").encode().split() for t in texts]
        self.lens = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.lens) - self.lens
        flat = np.fromiter((known[w] for own in words for w in own), np.uint64, int(self.lens.sum()))
        self.doc = np.repeat(np.arange(len(texts)), self.lens)
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(flat), ODD, np.uint64)])
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(len(flat), INVERSE, np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum(flat * power[:-1])]

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the words ``begin`` to ``end`` (exclusive)."""
        return _mixed((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))

    def window_starts(self, least: int) -> np.ndarray:
        """Starts of the windows that lie in one text."""
        start = np.arange(max(0, len(self.doc) - least + 1))
        return start[self.doc[start] == self.doc[start + least - 1]]


def _suffixes(texts: list[str | None], least: int, known: WordHashes):
    """Kept suffixes: text, first and last window start, hash of the seed words, hash of the whole stretch."""
    batch = Batch(texts, known)
    starts = batch.window_starts(least)
    if not len(starts):
        return [np.zeros(0, np.int64)] * 5
    seed = min(SEED_WORDS, least)
    at = np.arange(len(batch.doc) - seed + 1)
    heads = batch.hashes(at, at + seed)
    places = least - seed + 1
    lowest = np.empty(len(starts), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(heads, places)
    for i in range(0, len(starts), 1 << 18):
        part = starts[i : i + (1 << 18)]
        lowest[i : i + (1 << 18)] = part + view[part].argmin(axis=1)
    new = np.flatnonzero(np.r_[True, (lowest[1:] != lowest[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[new[1:], len(starts)] - 1
    low, high, seat = starts[new], starts[last], lowest[new]
    whole = _mixed(batch.hashes(low, high + least) + (seat - low).astype(np.uint64))
    own = batch.doc[low]
    shift = batch.first[own]
    return own, low - shift, high - shift, heads[seat].view(np.int64), whole.view(np.int64)


def suffixes(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id, low, high, head, whole`` of the kept suffixes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in batches_of([len(t or "") for t in texts], BATCH_BYTES):
                own, low, high, head, whole = _suffixes(texts[a:b], least, known)
                ids = batch.column(0).slice(a, b - a).take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(head, pa.int64()), pa.array(whole, pa.int64())],
                    ["doc_id", "low", "high", "head", "whole"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    return map_texts(rows, run, "doc_id long, low int, high int, head long, whole long")


NEIGHBOURS = (
    "doc_id long, low int, high int, head long, whole long, head_first long, head_last long, "
    "whole_first long, whole_last long, contested boolean, cut boolean, whole_cut boolean"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes of a partition next to their neighbours; those of one document alone go.

    Groups at the ends of a partition may go on in the next one: they are marked as cut.
    """
    columns = [[], [], [], [], []]
    for batch in batches:
        for kept, column in zip(columns, batch.columns, strict=True):
            kept.append(column.to_numpy(zero_copy_only=False))
    if not columns[0]:
        return
    doc, low, high, head, whole = (np.concatenate(c) for c in columns)
    n = len(doc)
    if not n:
        return
    new_head = np.r_[True, head[1:] != head[:-1]]
    new_whole = new_head | np.r_[True, whole[1:] != whole[:-1]]

    def ends(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, n])
        return np.repeat(np.minimum.reduceat(doc, at), size), np.repeat(np.maximum.reduceat(doc, at), size)

    head_first, head_last = ends(new_head)
    whole_first, whole_last = ends(new_whole)
    group = np.cumsum(new_head) - 1
    contested = (np.bincount(group, new_whole) > 1)[group]
    cut = (group == 0) | (group == group[-1])
    run = np.cumsum(new_whole) - 1
    whole_cut = (run == 0) | (run == run[-1])
    keep = cut | (head_first != head_last)
    arrays = (doc, low, high, head, whole, head_first, head_last, whole_first, whole_last, contested, cut, whole_cut)
    names = [part.split()[0] for part in NEIGHBOURS.split(", ")]
    at = np.flatnonzero(keep)
    for i in range(0, len(at), 50_000):
        part = at[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in arrays], names)


def neighbours(rows: DataFrame) -> DataFrame:
    """Suffixes that share their seed with another document.

    The sort key ends with the document, so a group of any size spreads over partitions; the
    pieces that partition bounds cut are told what their group holds elsewhere.
    """
    order = ["head", "whole", "doc_id"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(sorted_.select("doc_id", "low", "high", "head", "whole").mapInArrow(_compare, NEIGHBOURS), "neighbours")
    # A partition has two ends, so these are two groups for each partition at most; that bound allows their broadcast.
    heads = found.where("cut").groupBy("head").agg(
        F.min("head_first").alias("_first"), F.max("head_last").alias("_last"),
        (F.max("contested") | (F.min("whole") != F.max("whole"))).alias("_contested"),
    )
    wholes = found.where("whole_cut").groupBy("head", "whole").agg(F.min("whole_first").alias("_from"), F.max("whole_last").alias("_to"))
    # All rows of a cut group are marked, so the others find no partner and keep what they know.
    told = found.join(F.broadcast(heads), ["head"], "left").join(F.broadcast(wholes), ["head", "whole"], "left")
    mended = {"head_first": "_first", "head_last": "_last", "contested": "_contested", "whole_first": "_from", "whole_last": "_to"}
    known = [F.coalesce(mended[c], c).alias(c) if c in mended else F.col(c) for c in found.columns if c not in ("cut", "whole_cut")]
    return told.select(*known).where("head_first <> head_last")


def _windows(docs: DataFrame, stretches: DataFrame, least: int) -> DataFrame:
    """``doc_id, start, window`` for every window start in the stretches (``doc_id, low, high``)."""
    lists = stretches.groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("parts"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(lists.hint("shuffle_hash"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts, parts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in batches_of([len(t or "") for t in texts], BATCH_BYTES):
                own = Batch(texts[a:b], known)
                doc, start = [], []
                for i, stretch in enumerate(parts[a:b]):
                    most = own.lens[i] - least + 1  # a row that repeats a doc_id may have a shorter text
                    at = np.unique(np.concatenate([np.arange(p["low"], min(p["high"] + 1, most)) for p in stretch]))
                    doc.append(np.full(len(at), i))
                    start.append(at)
                doc, start = np.concatenate(doc), np.concatenate(start)
                begin = own.first[doc] + start
                ids = batch.column(0).slice(a, b - a).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(start, pa.int32()), pa.array(own.hashes(begin, begin + least).view(np.int64), pa.int64())],
                    ["doc_id", "start", "window"],
                )

    return map_texts(rows, run, "doc_id long, start int, window long")


def repeated_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """``doc_id, start_word, end_word, n_words, is_first``: passages that other documents hold too.

    A passage is a longest stretch of words (end exclusive, words are parted by the six ASCII
    blanks) covered by windows of ``least`` words that occur in two documents or more.
    ``is_first`` tells whether the document is the smallest doc_id that holds them; adjoining
    stretches that differ in that are rows of their own and may overlap.  Documents without
    such a window have no row; so have null, empty and shorter texts.  Rows that repeat a
    doc_id are one document, a null doc_id takes no part.
    """
    found = stored(neighbours(stored(suffixes(docs, least), "suffixes")), "shared-seeds")
    # The first holder of a contested stretch may not be the first of its windows: they tell.
    whole = found.where("whole_first <> whole_last and (not contested or doc_id <> whole_first)").select(
        "doc_id", F.col("low").alias("start"), (F.col("high") + least).alias("end"), (F.col("doc_id") == F.col("whole_first")).alias("is_first")
    )
    # Of equal stretches two documents stand for all; the others are known to repeat.
    ends = found.where("contested and (doc_id = whole_first or doc_id = whole_last)").select("doc_id", "low", "high")
    windows = stored(_windows(docs, ends, least).distinct(), "windows")
    again = stored(
        windows.groupBy("window")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .where("first <> last")
        .drop("last"),
        "repeated-windows",
    )
    parts = join_counted(windows, again, ["window"]).select(
        "doc_id", "start", (F.col("start") + least).alias("end"), (F.col("doc_id") == F.col("first")).alias("is_first")
    )
    merged = whole.unionByName(parts).groupBy("doc_id", "is_first").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def join(out, span):
        last = F.element_at(out, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        touches = (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] >= span["start"])
        return F.when(touches, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(span)))

    spans = F.aggregate("spans", none, join)
    return merged.select("doc_id", "is_first", F.explode(spans).alias("s")).select(
        "doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"),
        (F.col("s.end") - F.col("s.start")).alias("n_words"), "is_first",
    )


def without_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` whose texts lose the words of repeated passages, but where they stand first.

    Words that a first passage covers stay; what is left is joined by single blanks.  Texts
    without a passage to drop stay as they are.
    """
    own, stay, go = (spare(docs, name) for name in ("_id", "_stay", "_go"))
    lists = passages.groupBy(F.col("doc_id").alias(own)).agg(
        F.collect_list(F.when(F.col("is_first"), F.struct("start_word", "end_word"))).alias(stay),
        F.collect_list(F.when(~F.col("is_first"), F.struct("start_word", "end_word"))).alias(go),
    )
    inside = lambda spans, i: F.exists(spans, lambda s: (s["start_word"] <= i) & (i < s["end_word"]))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    left = F.array_join(F.filter(words, lambda w, i: ~inside(F.col(go), i) | inside(F.col(stay), i)), " ")
    joined = docs.join(lists.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(own), "left")
    return joined.withColumn("text", F.when(F.size(go) > 0, left).otherwise(F.col("text"))).select(*docs.columns)
