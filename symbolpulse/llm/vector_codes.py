"""Compression of vectors: one codebook for each part of a vector, equal-average search.

A vector becomes integers ``floor(4096 * x)`` and is cut into equal consecutive parts.  Every
part position has its own codebook; a part is coded by the index of its nearest entry.

The search sorts the entries of a codebook by the sum of their components.  For a part ``p`` and
an entry ``e`` of ``k`` components, ``(sum(p) - sum(e))**2 / k`` is at most the squared distance,
so the search starts at the sum of the part and goes outward to both sides; a side is done as
soon as this bound is strictly greater than the best distance.  An equal bound goes on,
because a tie may go to a lower index.

Rows cross no shuffle while codebooks are trained: each task adds up its parts by entry, and those
sums, one small row for each entry and task, are all that is merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import stored
from .common import spare

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Below this magnitude, differences, squares and sums of a batch stay exact in 64 bits.
SMALL = 1 << 24
ROWS_AT_ONCE = 4096
#: Components below this keep all sums within 38 digits, up to a million million rows.
FITS_DECIMAL = 2.0**60
#: Sums of greater components are merged in so many groups first, then once more.
MERGE_GROUPS = 64
SUMS = "part int, entry int, bucket int, n string, sums array<string>"

#: ``books[part]`` is a list of entries, each a list of integers.
Books = list[list[list[int]]]


def usable(vector: Column) -> Column:
    """True for a vector whose components are all there and finite."""

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return vector.isNotNull() & ~F.exists(vector, bad)


def whole(x: float) -> int:
    """``floor(4096 * x)`` without rounding and without overflow."""
    return math.floor(x * SCALE) if abs(x) < 2.0**900 else int(x) * SCALE


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """:func:`whole` of each component: 64-bit integers where they are small, else Python's."""
    values = values.astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    out = np.empty(values.shape, object)
    out[...] = [[whole(float(x)) for x in row] for row in values]
    return out


class EqualAverageSearch:
    """Nearest entries of one codebook; ties go to the lower index."""

    def __init__(self, entries: list[list[int]]):
        big = any(abs(x) >= SMALL for e in entries for x in e)
        book = np.array(entries, object if big else np.int64).reshape(len(entries), -1)
        sums = book.sum(axis=1) if book.shape[1] else np.zeros(len(entries), np.int64)
        self.index = np.array(sorted(range(len(entries)), key=lambda i: (sums[i], i)))
        self.book, self.sums = book[self.index], sums[self.index]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance for each row of ``parts``."""
        rows, width = parts.shape
        kind = object if object in (parts.dtype, self.book.dtype) else np.int64
        parts = parts.astype(kind)
        totals = parts.sum(axis=1) if width else np.zeros(rows, np.int64)
        best, found = np.full(rows, -1, kind), np.zeros(rows, np.int64)
        above = np.searchsorted(self.sums, totals)

        def outward(active: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Compare the active rows with their entries ``at``; returns the rows to go on with."""
            gap = totals[active] - self.sums[at]
            near = ((best[active] < 0) | (gap * gap <= best[active] * width)).astype(bool)
            active, at = active[near], at[near]
            apart = parts[active] - self.book[at]
            far = (apart * apart).sum(axis=1) if width else np.zeros(len(active), np.int64)
            entry = self.index[at]
            better = ((best[active] < 0) | (far < best[active]) | ((far == best[active]) & (entry < found[active]))).astype(bool)
            best[active[better]], found[active[better]] = far[better], entry[better]
            return active

        up = down = np.arange(rows)
        for step in range(len(self.index)):
            up = up[above[up] + step < len(self.index)]
            up = outward(up, above[up] + step)
            down = down[above[down] - 1 - step >= 0]
            down = outward(down, above[down] - 1 - step)
            if not len(up) and not len(down):
                break
        return found, best


def _batches(column: pa.Array, length: int, parts: int) -> np.ndarray:
    """The vectors as rows of ``parts`` equal parts, filled up with zeros to ``length``."""
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), length))
    at = np.repeat(np.arange(len(column)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return whole_numbers(out).reshape(len(column), parts, length // parts)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield batch.slice(first, ROWS_AT_ONCE)


def _floor_mean(total: int, n: int) -> int:
    return total // n


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of tasks added up, in integers of any size."""
    sums = [sum(column) for column in zip(*(map(int, s) for s in frame["sums"]))]
    first = frame.iloc[0]
    return pd.DataFrame(
        {"part": [first["part"]], "entry": [first["entry"]], "bucket": [first["bucket"]], "n": [str(sum(map(int, frame["n"])))], "sums": [[str(s) for s in sums]]}
    )


def _merge_big(sums: DataFrame) -> DataFrame:
    sums = sums.groupBy("part", "entry", "bucket").applyInPandas(_merged, SUMS)
    return sums.groupBy("part", "entry").applyInPandas(_merged, SUMS)


def _merge(sums: DataFrame) -> DataFrame:
    """The sums of all tasks, one row for each entry in use."""
    each = sums.select("part", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("i", "x"))
    each = each.groupBy("part", "entry", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    return each.groupBy("part", "entry").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"].cast("string")).alias("all")).select(
        "part", "entry", F.element_at("all", 1).alias("n"), F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))).alias("sums")
    )


def _round(vectors: DataFrame, books: Books, length: int, big: bool) -> Books:
    """One assignment of all parts, and the entries moved to the means of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [EqualAverageSearch(b) for b in books]
        count = np.zeros((len(books), len(books[0])), object)
        total = np.zeros((len(books), len(books[0]), length // len(books)), object)
        task = 0
        for batch in (p for b in batches for p in _pieces(b)):
            ints = _batches(batch.column("vector"), length, len(books))
            task = (task + batch.num_rows) % MERGE_GROUPS
            for part, search in enumerate(searches):
                found, _ = search.nearest(ints[:, part])
                for entry in np.unique(found):
                    mine = ints[:, part][found == entry]
                    count[part, entry] += len(mine)
                    total[part, entry] += mine.sum(axis=0).astype(object)
        used = [(p, e) for p in range(len(books)) for e in range(len(books[0])) if count[p, e]]
        if used:
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([p for p, _ in used], pa.int32()), "entry": pa.array([e for _, e in used], pa.int32()),
                    "bucket": pa.array([task] * len(used), pa.int32()), "n": [str(count[u]) for u in used],
                    "sums": pa.array([[str(s) for s in total[u]] for u in used], pa.list_(pa.string())),
                }
            )

    sums = vectors.select("vector").mapInArrow(run, SUMS)
    moved = [[list(e) for e in book] for book in books]
    for row in (_merge_big(sums) if big else _merge(sums)).collect():
        moved[row.part][row.entry] = [_floor_mean(int(s), int(row.n)) for s in row.sums]
    return moved


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Books, int]:
    """Codebooks of ``vectors(vec_id, vector)`` and the length that vectors are filled up to.

    The first entries are the parts of the vectors with the smallest ``vec_id`` (null last, equal ids by
    their components); a table of fewer vectors has fewer entries.  An entry that no part is
    nearest to stays as it is.  Only codebooks reach the driver: ``parts * entries`` rows a round.
    """
    greatest = F.array_max(F.transform("vector", lambda x: F.abs(x).cast("double")))
    longest, most = vectors.agg(F.max(F.size("vector")), F.max(greatest)).first()
    if longest is None:
        return [[] for _ in range(parts)], 0
    length = -(-longest // parts) * parts
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").take(entries)
    seeds = [[whole(float(x)) for x in r.vector] + [0] * (length - len(r.vector)) for r in first]
    width = length // parts
    books = [[s[p * width : (p + 1) * width] for s in seeds] for p in range(parts)]
    for _ in range(rounds):
        books = _round(vectors, books, length, (most or 0.0) * SCALE >= FITS_DECIMAL)
    return books, length


def encode(vectors: DataFrame, books: Books, length: int) -> DataFrame:
    """``vectors`` with ``codes array<int>`` and ``error long`` in place of ``vector``.

    ``error`` is the sum of the squared distances; null where it does not fit in 64 bits.
    """
    others = [c for c in vectors.columns if c != "vector"]
    shape = vectors.select(*others, F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [EqualAverageSearch(b) for b in books]
        for batch in (p for b in batches for p in _pieces(b)):
            ints = _batches(batch.column("vector"), length, len(books))
            found, far = zip(*(s.nearest(ints[:, p]) for p, s in enumerate(searches)))
            codes = np.stack(found, axis=1).astype(np.int32)
            errors = [e if e < 1 << 63 else None for e in map(int, sum(f.astype(object) for f in far))]
            offsets = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * len(books))
            columns = [batch.column(c) for c in others]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "codes", "error"])

    return vectors.mapInArrow(run, shape)


def decode(coded: DataFrame, books: Books) -> DataFrame:
    """``coded`` with ``vector array<double>``, the entries that its ``codes`` name."""

    def component(value: int) -> float:
        return value / SCALE

    flat = F.array(*[F.array(*[F.array(*[F.lit(component(x)) for x in e]) for e in b]) for b in books])
    return coded.withColumn("vector", F.flatten(F.transform("codes", lambda c, p: F.get(F.get(flat, p), c))))


def compress(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, Books]:
    """``vec_id, label, codes, error, label_error`` of each usable vector, and the codebooks.

    ``label_error`` adds up ``error`` over all rows of the same label, null being a label of its own.
    Rows whose vector is null or holds null, NaN or infinite components are left out.  Shorter vectors
    count as filled up with zeros to the longest one and to a multiple of ``parts``, empty ones too.
    Repeated ids are rows of their own, a null id stays null.  Sums that do not fit in
    64 bits are null.  An empty table gives no rows and empty codebooks.  Other columns are left out, so no name can clash.
    """
    kept = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(usable(F.col("vector")))
    books, length = train(kept, parts, entries, rounds)
    if not books[0]:
        empty = kept.select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
        return empty.withColumn("label_error", F.col("error")).where("false"), books
    coded = stored(encode(kept, books, length), "vector-codes")
    return with_label_error(coded), books


def with_label_error(coded: DataFrame, hot_share: int = 1000) -> DataFrame:
    """``coded`` with ``label_error``; a label may own any share of the rows.

    Labels with more than one ``hot_share``-th of all rows are fewer than ``hot_share``, which bounds
    their broadcast; all others meet their sums by a shuffle.
    """
    same, n = spare(coded, "same"), spare(coded, "n")
    sums = coded.groupBy(F.col("label").alias(same)).agg(
        F.count(F.lit(1)).alias(n), F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error")).alias("label_error")
    )
    sums = stored(sums, "label-errors")
    limit = (sums.agg(F.sum(n)).first()[0] or 0) // hot_share
    hot = F.broadcast(sums.where(F.col(n) > limit).drop(n))
    cold = sums.where(F.col(n) <= limit).drop(n)
    meet = coded["label"].eqNullSafe(F.col(same))
    few = coded.join(hot, meet)
    rest = coded.join(hot.select(same), meet, "left_anti")
    rest = rest.join(cold.hint("shuffle_hash"), rest["label"].eqNullSafe(F.col(same)))
    return few.drop(same).unionByName(rest.drop(same))
