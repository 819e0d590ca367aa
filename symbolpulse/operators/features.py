"""Price and sentiment features for next-day models.

Every feature of a day uses earlier days only.  Steps and labels are windows, which share partition and order; what is
taken from several rows before comes from :mod:`..functions.rolling`, since a sliding window adds up each of its
rows again, for each of its aggregates.  A frame is dealt by ticker once; rows per ticker are bounded by days.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.rolling import Batch, Known, Rolling
from .prices import by_day

BARS = ["open", "high", "low", "volume"]


def _prev(column: str, k: int = 1) -> Column:
    return F.lag(column, k).over(by_day())


def _before(column: str, k: int = 1) -> Rolling:
    return Rolling("before", (column,), k, 1)


def _mean(column: str, n: int, least: int) -> Rolling:
    return Rolling("mean", (column,), n, least)


def _std(column: str, n: int, least: int) -> Rolling:
    return Rolling("std", (column,), n, least)


def _sum(column: str, n: int, least: int) -> Rolling:
    return Rolling("sum", (column,), n, least)


def lag_features(column: str) -> dict[str, Rolling]:
    """Values of the three rows before (WIN1)."""
    return {f"{column}_lag{k}": _before(column, k) for k in (1, 2, 3)}


def rolling_features(column: str) -> dict[str, Rolling]:
    """Mean and deviation of the 3 and 7 rows before (WIN2)."""
    return {
        f"{column}_ma3": _mean(column, 3, 1),
        f"{column}_std3": _std(column, 3, 2),
        f"{column}_ma7": _mean(column, 7, 3),
        f"{column}_std7": _std(column, 7, 3),
    }


def return_features() -> dict[str, Rolling]:
    """Returns over 1, 3, 5 and 10 rows up to the row before (WIN3)."""
    return {f"return_{k}d": Rolling("growth", ("close",), k, 1) for k in (1, 3, 5, 10)}


def sentiment_features() -> dict[str, Rolling]:
    """Change and momentum of sentiment (WIN4)."""
    return {
        "sentiment_change1": _before("_dsent"),
        "sentiment_momentum3": _sum("_dsent", 3, 1),
        "sentiment_momentum7": _sum("_dsent", 7, 1),
    }


def volatility_features() -> dict[str, Rolling]:
    """Deviation and sum of the last seven returns (WIN5)."""
    return {"volatility_7d": _std("_ret", 7, 2), "return_momentum7": _sum("_ret", 7, 2)}


def correlation_feature() -> dict[str, Rolling]:
    """Correlation of return and sentiment over seven rows, at least three pairs (WIN6)."""
    return {"price_sentiment_corr7": Rolling("corr", ("_ret", "sentiment"), 7, 3)}


def volume_features() -> dict[str, Rolling]:
    """Change of volume and its three-row mean (WIN7)."""
    return {"volume_change1": _before("_dvol"), "volume_momentum3": _mean("_dvol", 3, 1)}


def rsi_feature() -> dict[str, Rolling]:
    """Relative strength over 14 rows with plain means (WIN8)."""
    return {"rsi": Rolling("rsi", ("_gain", "_loss"), 14, 3)}


def macd_features() -> dict[str, Rolling]:
    """MACD, its signal line and their difference (WIN9), recursive means of all rows before."""
    return {name: Rolling(kind, ("close",), 0, 0) for name, kind in (("macd", "macd"), ("macd_signal", "signal"), ("macd_hist", "hist"))}


def band_features() -> dict[str, Rolling]:
    """Bollinger band over 20 rows, at least five (WIN10)."""
    return {f"bb_{name}": Rolling(kind, ("close",), 20, 5) for name, kind in (("middle", "mean"), ("upper", "upper"), ("lower", "lower"))}


#: Rows of so many days form a block; the products of a block stay far from the limits of doubles.
BLOCK_DAYS = 1024


def with_recursive_means(frame: DataFrame, means: dict[str, tuple[str, int]]) -> DataFrame:
    """Add recursive means ``name: (column, span)`` over the days of a ticker, from its first value on.

    With ``a = 2 / (span + 1)``, a row maps the mean before it to ``p * mean + q``.  Such maps compose,
    so within a block of days a mean is ``P * carry + P * sum(q / P)`` with running products ``P``,
    and the carry is a fold over the ends of earlier blocks.  After ``k - 1`` rows without a value the old mean weighs
    ``(1 - a) ** k``.  All windows share one partition and order: one shuffle, one sort.
    """
    day = Window.partitionBy("ticker").orderBy("_block", "date")
    before = day.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("ticker", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = frame.withColumn("_block", F.floor(F.unix_date("date") / BLOCK_DAYS)).withColumn("_n", F.row_number().over(day))
    rows = rows.withColumn("_ends", F.coalesce(F.lead("_block").over(day) > F.col("_block"), F.lit(False)))
    columns = {column for column, _ in means.values()}
    rows = rows.withColumns({f"_last_{c}": F.last(F.when(F.col(c).isNotNull(), F.col("_n")), ignorenulls=True).over(before) for c in columns})
    maps: dict[str, Column] = {}
    for name, (column, span) in means.items():
        x, last, a = F.col(column), F.col(f"_last_{column}"), 2.0 / (span + 1.0)
        old = F.pow(F.lit(1.0 - a), F.col("_n") - last)
        maps[f"_p_{name}"] = F.when(x.isNull() | last.isNull(), 1.0).otherwise(old / (old + a))
        maps[f"_q_{name}"] = F.when(x.isNull(), 0.0).when(last.isNull(), x).otherwise(a * x / (old + a))
    rows = rows.withColumns(maps)
    rows = rows.withColumns({f"_p_{m}": F.exp(F.sum(F.ln(f"_p_{m}")).over(inside)) for m in means})
    rows = rows.withColumns({f"_q_{m}": F.col(f"_p_{m}") * F.sum(F.col(f"_q_{m}") / F.col(f"_p_{m}")).over(inside) for m in means})

    def carry(name: str) -> Column:
        end = F.struct(F.col(f"_p_{name}").alias("p"), F.col(f"_q_{name}").alias("q"))
        return F.collect_list(F.when(F.col("_ends"), end)).over(before)

    rows = rows.withColumns({f"_carry_{m}": carry(m) for m in means})
    folded = lambda m: F.aggregate(f"_carry_{m}", F.lit(0.0), lambda y, e: e["p"] * y + e["q"])
    started = lambda c: F.col(c).isNotNull() | F.col(f"_last_{c}").isNotNull()
    result = {m: F.when(started(c), F.col(f"_p_{m}") * folded(m) + F.col(f"_q_{m}")) for m, (c, _) in means.items()}
    return rows.select(*frame.columns, *(value.alias(name) for name, value in result.items()))


def with_macd(frame: DataFrame) -> DataFrame:
    """Add ``_macd`` and ``_signal``, which no window frame expresses (WIN9); rows without a date are left out."""
    dated = frame.where(F.col("date").isNotNull())
    moved = with_recursive_means(dated, {"_fast": ("close", 12), "_slow": ("close", 26)})
    moved = moved.withColumn("_macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return with_recursive_means(moved, {"_signal": ("_macd", 9)})


def with_future_row(frame: DataFrame) -> DataFrame:
    """One extra row per ticker on the day after its last, without measures (WIN13)."""
    is_last = F.lead("date").over(by_day()).isNull()
    copies = F.when(is_last, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    doubled = frame.where(F.col("date").isNotNull()).withColumn("_copies", copies)
    rows = doubled.select(*frame.columns, F.explode("_copies").alias("is_future"))
    blank = lambda c: F.when(~F.col("is_future"), F.col(c)).alias(c)
    return rows.select(
        "ticker",
        F.when(F.col("is_future"), F.date_add("date", 1)).otherwise(F.col("date")).alias("date"),
        *[blank(c) for c in frame.columns if c not in ("ticker", "date")],
        "is_future",
    )


def with_steps(frame: DataFrame) -> DataFrame:
    """Row-to-row differences the rolling features build on."""
    change = lambda c: F.try_divide(F.col(c), _prev(c)) - 1
    move = F.col("close") - _prev("close")
    steps = {
        "_ret": change("close"),
        "_dsent": F.col("sentiment") - _prev("sentiment"),
        "_gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))),
        "_loss": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0))),
    }
    if "volume" in frame.columns:
        steps["_dvol"] = change("volume")
    return frame.withColumns(steps)


def labels() -> dict[str, Column]:
    """Does the close rise to the next row, and by how much (WIN12)."""
    following = F.lead("close").over(by_day())
    return {
        "y": (following > F.col("close")).cast("double"),
        "actual_return": F.try_divide(following, F.col("close")) - 1,
    }


def ticker_starts(tickers: pa.Array) -> np.ndarray:
    """Rows with another ticker than the one before."""
    codes = tickers.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(codes[1:] != codes[:-1]) + 1


def whole_tickers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of whole tickers; the rows of the last one wait for the next batch."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting and waiting[0].column("ticker")[0] != batch.column("ticker")[0]:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting = []
        starts = ticker_starts(batch.column("ticker"))
        if len(starts):
            yield pa.Table.from_batches([*waiting, batch.slice(0, starts[-1])]).combine_chunks()
            waiting, batch = [], batch.slice(starts[-1])
        waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _batch(table: pa.Table) -> Batch:
    """A table of whole tickers, sorted by ticker and date."""

    def read(name: str) -> Known:
        column = table.column(name).combine_chunks()
        return pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)

    starts = ticker_starts(table.column("ticker").combine_chunks())
    first = np.zeros(table.num_rows, dtype=np.int64)
    first[starts] = starts
    return Batch(np.arange(table.num_rows) - np.maximum.accumulate(first), read)


def feature_rows(
    frame: DataFrame,
    features: dict[str, Rolling],
    keep: Sequence[str] = ("ticker", "date"),
    fill: bool = False,
    shown: Callable[[str, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Columns ``keep`` and features of the rows of :func:`stepped_frame`; ``keep`` has ticker and date.

    With ``fill`` a feature is its last known value, 0 before the first (WIN11).  ``shown(name, values)`` gives the values to
    return; for so many columns, Spark would make one method too long for the JVM to compile.
    """
    needed = {c for feature in features.values() for c in feature.columns}
    rows = frame.select(*keep, *sorted(needed - {*keep}))
    schema = StructType([*(rows.schema[c] for c in keep), *(StructField(name, DoubleType()) for name in features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for table in whole_tickers(batches):
                batch, columns = _batch(table), [table.column(c) for c in keep]
                for name, feature in features.items():
                    column = batch.feature(feature)
                    value, known = batch.filled(column) if fill else column
                    columns.append(pa.array(shown(name, value) if shown else value, pa.float64(), mask=~known))
                yield from pa.Table.from_arrays(columns, schema.names).to_batches()

    return rows.sortWithinPartitions("ticker", "date").mapInArrow(run, schema)


def feature_groups(frame: DataFrame, macd: bool = True) -> dict[str, Rolling]:
    groups: dict[str, Rolling] = {}
    for column in ["close", "sentiment", *[b for b in BARS if b in frame.columns]]:
        groups |= lag_features(column) | rolling_features(column)
    groups |= return_features() | sentiment_features() | volatility_features() | correlation_feature()
    if "volume" in frame.columns:
        groups |= volume_features()
    groups |= rsi_feature()
    if macd:
        groups |= macd_features()
    return groups | band_features()


def join_sentiment(prices: DataFrame, daily: DataFrame) -> DataFrame:
    """Prices with the sentiment of the day, 0 where there is none (JON2)."""
    return prices.join(daily.select("ticker", "date", "sentiment"), ["ticker", "date"], "left").withColumn(
        "sentiment", F.coalesce("sentiment", F.lit(0.0))
    )


def stepped_frame(frame: DataFrame, partitions: int | None = None) -> DataFrame:
    """``frame`` with future rows and helper columns, dealt by ticker, ready for feature columns.

    ``partitions`` is a number of tasks that adaptive execution keeps, for long work on few rows.
    """
    numeric = [c for c in ["close", "sentiment", *BARS] if c in frame.columns]
    typed = frame.select("ticker", "date", *[F.col(c).cast("double").alias(c) for c in numeric])
    # Dealt here and not by a window, which falls away where its columns are not asked for.
    dealt = typed.repartition("ticker") if partitions is None else typed.repartition(partitions, "ticker")
    full = with_future_row(dealt).withColumn("sentiment", F.coalesce("sentiment", F.lit(0.0)))
    return with_steps(full)


def feature_frame(
    frame: DataFrame,
    macd: bool = True,
    only: Sequence[str] | None = None,
    shown: Callable[[str, np.ndarray], np.ndarray] | None = None,
    also: dict[str, Column] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """All features or ``only`` some, labels and the future row per ticker (FEA1).

    ``frame``: ticker, date, close, sentiment and any of open, high, low, volume.  ``also`` are more columns, made of
    the labelled rows while these are narrow and dealt by ticker.  Rows of a ticker lie side by side, by date.
    """
    also = also or {}
    stepped = stepped_frame(frame, partitions)
    features = feature_groups(stepped, macd)
    if only is not None:
        features = {name: features[name] for name in only}
    kept = ["ticker", "date", "is_future", "close"]
    labelled = stepped.withColumns(labels()).withColumns(also)
    wide = feature_rows(labelled, features, [*kept, "y", "actual_return", *also], fill=True, shown=shown)
    return wide.select(*kept, *features, "y", "actual_return", *also)


def training_rows(features: DataFrame) -> DataFrame:
    """Rows with a label (FEA1)."""
    known = F.col("y").isNotNull() & F.col("actual_return").isNotNull()
    return features.where(~F.col("is_future") & known)
