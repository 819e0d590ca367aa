"""Prices: FX and post as-of joins, latest rows, resampling, returns, correlations.

``prices`` has one row per (date, ticker), so the rows of a ticker are bounded by
the number of days; windows over one ticker rest on that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.symbols import loose_symbol
from .tables import first_per_key


def by_day() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def fx_calendar(fx: DataFrame, pair: str = "EURUSD") -> DataFrame:
    """The rate in force on each day from the first to the last quote.

    At most one row per calendar day, which is what makes broadcasting it safe.
    """
    quotes = fx.where(F.col("pair") == pair).groupBy("date").agg(F.max("rate_usd_per_eur").alias("rate"))
    following = F.lead("date").over(Window.orderBy("date"))
    last_day = F.coalesce(F.date_sub(following, 1), F.col("date"))
    return quotes.select("rate", F.sequence("date", last_day).alias("_days")).select(
        F.explode("_days").alias("fx_day"), "rate"
    )


def attach_rate(prices: DataFrame, fx: DataFrame, pair: str = "EURUSD") -> DataFrame:
    """Add ``rate``: the latest FX quote not after the row's date, else NULL (ASF1).

    Days after the last quote look up the last quote's day; the join is then an
    equi join with a broadcast calendar and the prices are not shuffled.
    """
    last_quote = fx.where(F.col("pair") == pair).agg(F.max("date")).scalar()
    dated = prices.withColumn("fx_day", F.least("date", last_quote))
    return dated.join(F.broadcast(fx_calendar(fx, pair)), "fx_day", "left").drop("fx_day")


def with_eur(prices: DataFrame, fx: DataFrame, pair: str = "EURUSD") -> DataFrame:
    """USD columns and their EUR values (ASF1)."""
    if "adj_close" not in prices.columns:
        prices = prices.withColumn("adj_close", F.col("close"))
    money = ["open", "high", "low", "close", "adj_close"]
    return attach_rate(prices, fx, pair).select(
        "date",
        "ticker",
        *money,
        "volume",
        *[F.try_divide(c, "rate").alias(f"{c}_eur") for c in money],
    )


def latest_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Whole row with the greatest ``order`` per key, by partial aggregation (RNK1).

    Of rows with the same ``order`` the one with the greatest other columns counts, in the order
    they stand in, so the result does not hang on how rows are dealt to tasks.
    """
    rest = [c for c in df.columns if c not in keys]
    place = F.when(F.col(order).isNotNull(), F.struct(order, *[c for c in rest if c != order]))
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def latest_prices(prices: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Latest close per ticker (RNK1)."""
    if symbols is not None:
        prices = prices.join(symbols.select("ticker").distinct(), "ticker", "left_semi")
    return latest_rows(prices.select("ticker", "date", "close"), ["ticker"], "date")


def latest_prices_eur(prices: DataFrame, fx: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Latest close per ticker in both currencies; the as-of join sees the latest rows only (ASF2)."""
    latest = attach_rate(latest_prices(prices, symbols), fx)
    return latest.select("ticker", "date", "close", F.try_divide("close", "rate").alias("close_eur"))


def forward_returns(posts: DataFrame, prices: DataFrame, horizons: Sequence[int] = (1, 3, 7)) -> DataFrame:
    """``return_<h>d`` per post: h trading rows after the first one not before it (ASF3).

    Post days are made distinct first, so the window that looks for the base row
    sees at most one row per ticker and day, however many posts there are.
    """
    names = [f"return_{h}d" for h in horizons]
    ahead = prices.select(
        "ticker",
        "date",
        *[
            F.try_divide(F.lead("close", h).over(by_day()) - F.col("close"), "close").alias(n)
            for h, n in zip(horizons, names)
        ],
    )
    base = ahead.withColumn("_row", F.struct(*names)).select("ticker", "date", "_row")
    days = posts.select("ticker", F.to_date("created_utc").alias("date")).distinct()
    asked = days.join(ahead.select("ticker").distinct(), "ticker", "left_semi")
    marked = asked.withColumn("_row", F.lit(None).cast(base.schema["_row"].dataType))
    both = base.withColumn("_asked", F.lit(False)).unionByName(marked.withColumn("_asked", F.lit(True)))
    # "Next row" is looked up as "last row so far" on descending days: a frame that
    # only grows stays linear.
    downward = Window.partitionBy("ticker").orderBy(F.col("date").desc(), F.col("_asked"))
    following = F.last("_row", ignorenulls=True).over(
        downward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = both.withColumn("_base", following).where("_asked").select(
        "ticker", F.col("date").alias("_day"), *[F.col(f"_base.{n}").alias(n) for n in names]
    )
    kept = [c for c in posts.columns if c not in names]
    return (
        posts.select(*kept)
        .withColumn("_day", F.to_date("created_utc"))
        .join(found, ["ticker", "_day"], "left")
        .select(*kept, *names)
    )


def _weekly(closes: DataFrame) -> DataFrame:
    newest = first_per_key(closes, ["ticker"], F.col("date").desc(), n=15)
    whole = Window.partitionBy("ticker")
    known = newest.where(F.col("close").isNotNull()).withColumn("_last", F.max("date").over(whole))
    old = F.col("date") <= F.date_sub("_last", 7)
    picked = known.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by("close", "date").alias("_latest"),
        F.max_by(F.when(old, F.col("close")), F.when(old, F.col("date"))).alias("_past"),
        F.min_by("close", "date").alias("_first"),
    )
    reference = F.coalesce("_past", F.when(F.col("_n") >= 2, F.col("_first")))
    usable = (F.col("_latest") > 0) & (reference > 0)
    return picked.select(
        "ticker", F.when(usable, F.col("_latest") / reference - 1).alias("weekly_return")
    )


def weekly_returns(prices: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Return over seven days from the last 15 rows per ticker (ASF4)."""
    closes = prices.select("ticker", "date", "close")
    if symbols is not None:
        closes = closes.join(symbols.select("ticker").distinct(), "ticker", "left_semi")
    return _weekly(closes).where(F.col("weekly_return").isNotNull())


def listed_weekly_returns(prices: DataFrame, listed: DataFrame, max_symbols: int = 10) -> DataFrame:
    """The first ``max_symbols`` symbols of a list that have a weekly return (WIN15).

    ``listed``: symbol, position.
    """
    wanted = (
        listed.select(loose_symbol("symbol").alias("ticker"), "position")
        .where(F.col("ticker").isNotNull())
        .groupBy("ticker")
        .agg(F.min("position").alias("position"))
    )
    return (
        weekly_returns(prices, wanted)
        .join(wanted, "ticker")
        .orderBy("position", "ticker")
        .limit(max_symbols)
    )


def last_two_closes(prices: DataFrame) -> DataFrame:
    """Last and previous close, and the change in percent (AGG13)."""
    newest = first_per_key(prices.select("ticker", "date", "close"), ["ticker"], F.col("date").desc(), n=2)
    latest = F.max_by("close", "date")
    # With one row only there is no previous close.
    previous = F.when(F.count(F.lit(1)) == 2, F.min_by("close", "date"))
    pair = newest.groupBy("ticker").agg(latest.alias("last_close"), previous.alias("prev_close"))
    return pair.withColumn("change_pct", (F.try_divide("last_close", "prev_close") - 1) * 100)


def daily_bars(ticks: DataFrame, *order: Column) -> DataFrame:
    """Daily bar per ticker from intraday rows, for all days at once (AGG14).

    ``ticks``: ticker, ts, open, high, low, close, volume.  ``order`` settles equal
    times.  Partial aggregation only; a busy ticker does not gather in one task.
    """
    at = F.struct(F.col("ts"), *order)
    priced = ticks.where(
        F.coalesce("open", "high", "low", "close").isNotNull()
    )
    return priced.groupBy("ticker", F.to_date("ts").alias("date")).agg(
        F.min_by("open", at).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", at).alias("close"),
        F.sum(F.coalesce("volume", F.lit(0))).cast("bigint").alias("volume"),
    )


def daily_changes(prices: DataFrame) -> DataFrame:
    """Change of the close against the row before (WIN14)."""
    change = F.try_divide("close", F.lag("close").over(by_day())) - 1
    return prices.select("ticker", "date", "close", change.alias("return"))


def _average_rank(column: str) -> Column:
    ordered = Window.partitionBy("ticker").orderBy(column)
    ties = F.count(F.lit(1)).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(ordered) + (ties - 1) / 2


def _correlation(x: str, y: str) -> Column:
    """Pearson correlation, NULL when a side does not vary."""
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def return_sentiment_correlations(
    prices: DataFrame, sentiment: DataFrame, min_samples: int = 5
) -> DataFrame:
    """Pearson and Spearman of daily return against sentiment per symbol (AGG15, JON1).

    ``sentiment``: date, ticker, sentiment.  Symbols match in upper case.
    """
    scored = sentiment.where(F.col("sentiment").isNotNull()).select(
        "date", F.upper("ticker").alias("ticker"), "sentiment"
    )
    changes = daily_changes(prices).select("date", F.upper("ticker").alias("ticker"), "return")
    paired = changes.join(scored, ["ticker", "date"]).where(F.col("return").isNotNull())
    ranked = paired.withColumn("_rr", _average_rank("return")).withColumn(
        "_rs", _average_rank("sentiment")
    )
    return (
        ranked.groupBy("ticker")
        .agg(
            _correlation("return", "sentiment").alias("pearson"),
            _correlation("_rr", "_rs").alias("spearman"),
            F.count(F.lit(1)).alias("samples"),
        )
        .where(F.col("samples") >= min_samples)
    )
