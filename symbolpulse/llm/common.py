"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
#: Words and blanks as Java patterns: only these six characters separate words.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_counted(
    rows: DataFrame, keyed: DataFrame, keys: Sequence[str], count: str = "n", how: str = "inner", hot_share: int = 1000
) -> DataFrame:
    """``rows`` joined with ``keyed`` (one row per key), safe for keys that own many rows.

    ``keyed[count]`` is the number of rows of a key; the result leaves it out.  Keys with more than one
    ``hot_share``-th of all rows are fewer than ``hot_share``; that bound allows their
    broadcast.  All other keys meet by a shuffle.  ``how`` is inner or left.  Both inputs
    are read twice, so store them first.
    """
    keys = list(keys)
    total, most = keyed.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    limit = max(total // hot_share, 1000)
    if most <= limit:
        return rows.join(keyed.drop(count), keys, how)
    hot, cold = keyed.where(F.col(count) > limit).drop(count), keyed.where(F.col(count) <= limit).drop(count)
    few = rows.join(F.broadcast(hot), keys, "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return few.unionByName(rest.join(cold, keys, how))


def map_texts(rows: DataFrame, run: Callable, shape) -> DataFrame:
    """``rows.mapInArrow`` in batches of a thousand rows.

    Rows carry whole texts; the session's own batch size is meant for rows of some numbers, and
    an executor holds several batches for each core.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return rows.mapInArrow(run, shape)


def spare(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def batches_of(lengths: Sequence[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges whose lengths add up to ``most`` at most, or of one item."""
    out, first, total = [], 0, 0
    for i, n in enumerate(lengths):
        if i > first and total + n > most:
            out.append((first, i))
            first, total = i, 0
        total += n
    if first < len(lengths):
        out.append((first, len(lengths)))
    return out


Query = Callable[[SparkSession, str], DataFrame]
