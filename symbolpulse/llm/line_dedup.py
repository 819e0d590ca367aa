"""Removal of lines that many documents share, with two Bloom filters.

One pass marks the hashes of line keys seen once and seen twice.  A second pass sends only
keys of the second filter through a shuffle, where their documents are counted exactly.
The filters have a fixed size; when they fill up more keys are sent, the result stays the
same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import stored
from .common import join_counted, map_texts, spare

BLANKS = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 16


def keys_of(text: str | None, least: int) -> set[bytes]:
    """Distinct line keys of at least ``least`` code points."""
    found = {line.strip(BLANKS).lower() for line in (text or "").encode().split(b"\n")}
    return {k for k in found if len(k) >= least and (k.isascii() or len(k.decode()) >= least)}


def places(keys: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in a filter of ``bits`` bits (a power of two)."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(32) & mask).astype(np.int64)


def is_set(bitmap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (bitmap[a >> 3] >> (a & 7) & bitmap[b >> 3] >> (b & 7) & 1).astype(bool)


def put(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _filters(docs: DataFrame, least: int, bits: int) -> DataFrame:
    """The two filters in chunks, one row each: ``chunk, once, twice``."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            keys = [k for text in batch.column(0).to_pylist() for k in keys_of(text, least)]
            a, b = places(keys, bits)
            pair, n = np.unique(a << 32 | b, return_counts=True)
            a, b = pair >> 32, pair & 0xFFFFFFFF
            again = is_set(once, a, b) | (n > 1)
            for at in (a, b):
                put(twice, at[again])
                put(once, at)
        size = min(CHUNK, bits // 8)
        for i in range(0, bits // 8, size):
            if once[i : i + size].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // size], pa.int32()), pa.array([once[i : i + size].tobytes()]), pa.array([twice[i : i + size].tobytes()])],
                    ["chunk", "once", "twice"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = once = twice = None
        for batch in batches:
            for i, o, t in zip(*(batch.column(c).to_pylist() for c in ("chunk", "once", "twice")), strict=True):
                o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
                chunk, once, twice = (i, o, t) if once is None else (i, once | o, twice | t | (once & o))
        if once is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([once.tobytes()]), pa.array([twice.tobytes()])], ["chunk", "once", "twice"]
            )

    shape = "chunk int, once binary, twice binary"
    # A task holds one pair of filters however many splits it reads: two tasks a core are enough.
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return map_texts(docs.select("text").coalesce(2 * cores), mark, shape).groupBy("chunk").applyInArrow(merge, shape)


def suspects(docs: DataFrame, least: int, bits: int) -> DataFrame:
    """``doc_id, key`` of the keys that the second filter holds."""
    size = min(CHUNK, bits // 8)
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in _filters(docs, least, bits).select("chunk", "twice").collect():  # bits / 8 bytes at most
        bitmap[row.chunk * size : (row.chunk + 1) * size] = np.frombuffer(row.twice, np.uint8)
    known = docs.sparkSession.sparkContext.broadcast(bitmap)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = keys_of(text, least)
                rows += [i] * len(own)
                keys += own
            hit = np.flatnonzero(is_set(known.value, *places(keys, bits)))
            ids = batch.column(0).take(pa.array(np.array(rows, np.int64)[hit]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([keys[i].decode() for i in hit], pa.string())], ["doc_id", "key"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), probe, "doc_id long, key string")


def filter_bits(docs: DataFrame, most: int) -> int:
    """A power of two with about ten bits for every expected key, ``most`` at most."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(most, max(1 << 16, 1 << int(chars / 40 * 10).bit_length()))


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, most_bits: int = 1 << 30) -> DataFrame:
    """``docs`` without their shared lines, and the columns ``n_lines`` and ``n_dropped``.

    A line's key is the line without blanks at its ends, A-Z in lower case.  Keys of at least
    ``least_chars`` code points that ``least_docs`` documents hold lose all their lines except
    those of the largest ``doc_id`` that holds them.  ``most_bits`` bounds each filter (an
    eighth of it in bytes is broadcast).

    A null text counts as one empty line and stays null.  Rows that repeat a doc_id are one
    document here; a null doc_id is one document too and never the largest.  Columns named
    ``n_lines`` or ``n_dropped`` are replaced, all others stay.
    """
    found = stored(suspects(docs, least_chars, filter_bits(docs, most_bits)).distinct(), "line-suspects")
    repeated = stored(
        found.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= least_docs),
        "line-repeats",
    )
    kept = docs.drop("n_lines", "n_dropped")
    own, drop = spare(docs, "_id"), spare(docs, "_drop")
    drops = (
        join_counted(found, repeated, ["key"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias(own))
        .agg(F.collect_set("key").alias(drop))
    )
    joined = kept.join(drops.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left").drop(own)
    names = [*kept.columns, "n_lines", "n_dropped"]
    shape = kept.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    at = kept.columns.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                n, left = (text or "").count("\n") + 1, 0
                if drop:
                    gone = {k.encode() for k in drop}
                    stay = [x for x in text.encode().split(b"\n") if x.strip(BLANKS).lower() not in gone]
                    text, left = b"\n".join(stay).decode(), n - len(stay)
                texts.append(text)
                lines.append(n)
                dropped.append(left)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names)

    return map_texts(joined, rewrite, shape)
