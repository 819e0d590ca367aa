"""Exact order statistics that never gather a whole group in one task.

Values are counted first, then located through two order-preserving cells (coarse,
fine) and finally by value.  Every window runs over the cells of one parent cell,
so its size is bounded by the cell grid and not by the rows of a group: a group may
hold a third of the data, all of it distinct.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = ["_coarse", "_fine"]


def _fine_cell(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.shiftright(value.cast("bigint"), 21)
    # ln keeps the order (it is semi-monotonic); +800 makes it positive for all doubles.
    size = F.floor((F.ln(F.abs(value)) + 800) * float(2**30)).cast("bigint")
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("bigint"))


def with_cells(df: DataFrame, value: str) -> DataFrame:
    # Never NULL: joins on cells then add no null filter that would repeat the value's
    # whole expression at the scan.
    fine = F.coalesce(_fine_cell(F.col(value), df.schema[value].dataType), F.lit(0).cast("bigint"))
    bits = 21 if isinstance(df.schema[value].dataType, T.IntegralType) else 20
    return df.withColumn("_fine", fine).withColumn("_coarse", F.shiftright(F.col("_fine"), bits))


def _running(parent: Sequence[str], order: str, weight: str) -> Column:
    frame = Window.partitionBy(*parent).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(frame), F.lit(0))


def values_at(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    low: Callable[[Column], Column],
    high: Callable[[Column], Column],
) -> DataFrame:
    """Distinct values that cover the zero-based ranks ``low`` .. ``high`` of each group.

    ``low`` and ``high`` map the group size to a rank.  Output: keys, ``value``,
    ``_below`` (rows before it), ``_n`` (its rows), ``_low``, ``_high``.
    """
    keys = list(keys)
    counts = with_cells(
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")),
        value,
    )
    hit = (F.col("_below") <= F.col("_high")) & (F.col("_below") + F.col("_n") > F.col("_low"))

    top = counts.groupBy(*keys, "_coarse").agg(F.sum("_n").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    top = (
        top.withColumn("_below", _running(keys, "_coarse", "_n"))
        .withColumn("_total", total)
        .withColumn("_low", low(F.col("_total")))
        .withColumn("_high", high(F.col("_total")))
        .where(hit)
    )
    carried = ["_low", "_high", "_base"]
    found = top.withColumnRenamed("_below", "_base").select(*keys, "_coarse", *carried)
    middle = (
        counts.join(found, [*keys, "_coarse"])
        .groupBy(*keys, *CELLS, *carried)
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_below", F.col("_base") + _running([*keys, "_coarse"], "_fine", "_n"))
        .where(hit)
    )
    found = middle.drop("_base", "_n").withColumnRenamed("_below", "_base")
    return (
        counts.join(found, [*keys, *CELLS])
        .withColumn("_below", F.col("_base") + _running([*keys, *CELLS], value, "_n"))
        .where(hit)
        .select(*keys, value, "_below", "_n", "_low", "_high")
    )


def medians(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per group."""
    found = values_at(
        df, keys, value, lambda n: F.floor((n - 1) / 2), lambda n: F.floor(n / 2)
    )
    covers = lambda rank: (F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_n"))
    pick = lambda rank: F.max(F.when(covers(F.col(rank)), F.col(value)))
    return found.groupBy(*keys).agg(((pick("_low") + pick("_high")) / 2).alias(out))


def first_by_hash(df: DataFrame, keys: Sequence[str], ident: str, seed: int, size) -> DataFrame:
    """The first ``size(group size)`` rows of each group in a seeded hash order.

    The hash value at the last wanted rank is found with :func:`values_at`; rows
    below it are taken, and ties at it (same hash) are settled by ``ident``.
    """
    keys = list(keys)
    # The first 60 bits of the digest, as a number that keeps the order of the text.
    digest = F.md5(F.concat(F.col(ident).cast("string"), F.lit(f"-{seed}")))
    marked = df.withColumn("_hash", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))
    last = lambda n: size(n) - 1
    cut = values_at(marked, keys, "_hash", last, last).select(
        *keys, F.col("_hash").alias("_cut"), (F.col("_high") - F.col("_below") + 1).alias("_room")
    )
    # One row for each group; groups are classes here.
    joined = marked.join(F.broadcast(cut), keys)
    below = joined.where(F.col("_hash") < F.col("_cut"))
    ties = joined.where(F.col("_hash") == F.col("_cut")).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys, "_hash").orderBy(ident))
    )
    return below.unionByName(ties.where(F.col("_rn") <= F.col("_room")).drop("_rn")).select(*df.columns)


def quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row ``quantile``: the exact value at share ``q``, between two values in proportion."""
    at = lambda n: q * (n - 1)
    found = values_at(df, [], value, lambda n: F.floor(at(n)), lambda n: F.ceil(at(n)))
    total = df.where(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("_total"))
    covers = lambda rank: (F.col("_below") <= F.col(rank)) & (F.col(rank) < F.col("_below") + F.col("_n"))
    ends = found.agg(
        F.max(F.when(covers("_low"), F.col(value))).alias("_a"), F.max(F.when(covers("_high"), F.col(value))).alias("_b"), F.max("_low").alias("_low")
    )
    # Both sides are one row.
    return ends.join(F.broadcast(total)).select((F.col("_a") + (F.col("_b") - F.col("_a")) * (at(F.col("_total")) - F.col("_low"))).alias("quantile"))


def roc_auc(df: DataFrame, keys: Sequence[str], label: str, proba: str) -> DataFrame:
    """Area under the ROC curve per group, NULL with one class only (MET2).

    A positive beats the negatives below it.  Pairs are counted where they part:
    in different coarse cells, in different fine cells of one coarse cell, or at
    different values of one fine cell; equal values count half.
    """
    keys = list(keys)
    known = df.where(F.col(label).isNotNull() & F.col(proba).isNotNull())
    is_pos = F.col(label) == 1
    points = with_cells(
        known.groupBy(*keys, proba).agg(
            F.count_if(is_pos).alias("_pos"), F.count_if(~is_pos).alias("_neg")
        ),
        proba,
    )
    parts = []
    for parent, order in ((keys, "_coarse"), ([*keys, "_coarse"], "_fine"), ([*keys, *CELLS], proba)):
        level = points
        if order != proba:
            level = points.groupBy(*dict.fromkeys([*parent, order])).agg(
                F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")
            )
        half = F.col("_neg") / 2 if order == proba else F.lit(0.0)
        once = F.lit(1 if order == "_coarse" else 0)
        parts.append(
            level.withColumn("_less", _running(parent, order, "_neg")).select(
                *keys,
                (F.col("_pos") * (F.col("_less") + half)).alias("_wins"),
                (F.col("_pos") * once).alias("_pos"),
                (F.col("_neg") * once).alias("_neg"),
            )
        )
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return every.groupBy(*keys).agg(F.try_divide(F.sum("_wins"), pairs).alias("roc_auc"))
