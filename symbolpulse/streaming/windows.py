"""Windowed rollups of streams that take rows in any order and lose none.

A micro-batch is rolled up to partial rows: sums, counts, and first and last values with their place in
time.  Partials of a window can be merged in any order, so a row may come as late as it likes; no
state and no watermark decide about it.  The sink writes the partials of a batch as one segment and folds
segments as they grow in number: of ``fold`` batches one segment, of ``fold`` such segments the
next.  A row is therefore rewritten a logarithmic number of times.

A segment is named by the batches it holds and gets its name when it is complete.  Readers
leave out a segment that lies within another, so a fold, a crash behind it and a repeated batch
change no result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Batch = Callable[[DataFrame, int], None]
SEGMENT = re.compile(r"batches-(\d+)-(\d+)$")


@dataclass(frozen=True)
class Windows:
    """A rollup by window and key.

    ``partial`` are aggregates of rows, ``merge`` aggregates of partial columns of the same
    names, ``result`` the columns made of merged partials.
    """

    at: str
    length: str
    partial: Mapping[str, Column]
    merge: Mapping[str, Column]
    result: Mapping[str, Column]
    keep: Column | None = None
    keys: tuple[str, ...] = ("ticker",)

    def partials(self, rows: DataFrame) -> DataFrame:
        """Partial rows of a batch; a row without a time is in no window."""
        rows = rows.where(F.col(self.at).isNotNull() if self.keep is None else F.col(self.at).isNotNull() & self.keep)
        grouped = rows.groupBy(F.window(self.at, self.length).alias("w"), *self.keys)
        found = grouped.agg(*(c.alias(n) for n, c in self.partial.items()))
        return found.select(F.col("w.start").alias("start"), *self.keys, *self.partial)

    def merged(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy("start", *self.keys).agg(*(c.alias(n) for n, c in self.merge.items()))

    def finished(self, partials: DataFrame) -> DataFrame:
        """One row for each window and key."""
        return self.merged(partials).select("start", *self.keys, *(c.alias(n) for n, c in self.result.items()))


def _files(spark: SparkSession, path: str):
    """Hadoop's view of ``path``, so any file system works."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def segments(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """First batch, last batch and folder of each segment that is within no other."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    spans = sorted(((int(m[1]), -int(m[2])) for m in map(SEGMENT.match, names) if m))
    out: list[tuple[int, int, str]] = []
    for first, last in ((a, -b) for a, b in spans):
        if not out or last > out[-1][1]:
            out.append((first, last, f"{path}/batches-{first}-{last}"))
    return out


def _put(rows: DataFrame, path: str, first: int, last: int) -> None:
    """Write a segment under another name, then give it its own."""
    spark = rows.sparkSession
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    rows.write.parquet(draft)
    files, target = _files(spark, f"{path}/batches-{first}-{last}")
    files.delete(target, True)
    if not files.rename(_files(spark, draft)[1], target):
        raise OSError(f"cannot name {draft} as {target}")


def into_windows(path: str, windows: Windows, fold: int = 16) -> Batch:
    """Sink of a stream of rows; read its table with :func:`read_windows`."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _put(windows.partials(batch), path, number, number)
        span = fold
        while (number + 1) % span == 0:
            first = number + 1 - span
            inside = [s for s in segments(spark, path) if first <= s[0] and s[1] <= number]
            if len(inside) > 1:
                parts = spark.read.parquet(*(s[2] for s in inside))
                _put(windows.merged(parts), path, first, number)
                for a, b, folder in inside:
                    if (a, b) != (first, number):
                        files, old = _files(spark, folder)
                        files.delete(old, True)
            span *= fold

    return write


def read_windows(spark: SparkSession, path: str, windows: Windows) -> DataFrame:
    """All windows of the batches so far; segments hold each window once, so one shuffle merges them."""
    found = segments(spark, path)
    if not found:
        raise FileNotFoundError(path)
    return windows.finished(spark.read.parquet(*(s[2] for s in found)))
