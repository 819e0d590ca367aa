"""Overview tables per symbol, and the short lists of a market update."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import hotness_level
from .lists import alias_lists
from .prices import (
    last_two_closes,
    latest_prices_eur,
    latest_rows,
    return_sentiment_correlations,
    weekly_returns,
)
from .rollups import mention_change, trailing_sentiment


def top_trends(trends: DataFrame, as_of: datetime, n: int = 5, min_mentions: int = 2) -> DataFrame:
    """Hottest symbols of the day (TOP1)."""
    today = F.to_date(F.lit(as_of).cast("timestamp"))
    day = trends.where((F.col("date") == today) & (F.col("mentions") >= min_mentions))
    return day.orderBy(F.col("hotness").desc(), F.col("mentions").desc(), "ticker").limit(n)


def latest_predictions(predictions: DataFrame, horizon: int = 1) -> DataFrame:
    """Latest prediction per ticker for one horizon (RNK1)."""
    return latest_rows(predictions.where(F.col("horizon_days") == horizon), ["ticker"], "as_of")


def top_signals(predictions: DataFrame, signal: str, n: int = 5) -> DataFrame:
    """Most confident latest signals of one kind (TOP2)."""
    rows = latest_predictions(predictions).where(F.lower("signal") == signal)
    return rows.orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "ticker").limit(n)


def top_posts(enriched: DataFrame) -> DataFrame:
    """Return after the best-rated post per ticker (TOP5)."""
    rated = enriched.where(
        F.col("sentiment_weighted").isNotNull() & F.col("return_3d").isNotNull()
    )
    best = F.struct("sentiment_weighted", "id")
    return rated.groupBy("ticker").agg(F.max_by("return_3d", best).alias("top_post_return_3d"))


def stock_overview(
    symbols: DataFrame,
    prices: DataFrame,
    fx: DataFrame,
    predictions: DataFrame,
    daily: DataFrame,
    trends: DataFrame,
    as_of: datetime,
) -> DataFrame:
    """One row per requested symbol: prices, signal, sentiment, mentions, return (OVW1).

    Every side is reduced to one row per ticker before it is joined.
    """
    wanted = symbols.select(F.upper("ticker").alias("ticker")).distinct()
    near = lambda df: df.join(wanted, "ticker", "left_semi")
    price = latest_prices_eur(near(prices), fx).select(
        "ticker", F.col("close").alias("price_usd"), F.col("close_eur").alias("price_eur")
    )
    signal = latest_predictions(near(predictions)).select(
        "ticker",
        F.col("signal").alias("ml_signal"),
        F.col("confidence").alias("ml_confidence"),
        F.col("expected_return").alias("ml_expected_return"),
        F.col("as_of").alias("signal_as_of"),
        F.col("version").alias("signal_version"),
    )
    mood = latest_rows(near(daily), ["ticker"], "date").select(
        "ticker",
        "sentiment_weighted",
        F.col("posts").alias("sentiment_posts"),
        F.col("date").alias("sentiment_date"),
    )
    today = near(trends).where(F.col("date") == F.to_date(F.lit(as_of).cast("timestamp"))).select(
        "ticker", F.col("mentions").alias("mentions_today"), F.col("hotness").alias("hotness_today")
    )
    out = wanted
    for side in (price, signal, mood, today, weekly_returns(near(prices))):
        out = out.join(side, "ticker", "left")
    return out.withColumn("generated_at", F.lit(as_of).cast("timestamp"))


def detail_overview(
    symbols: DataFrame,
    prices: DataFrame,
    fx: DataFrame,
    predictions: DataFrame,
    daily: DataFrame,
    hourly: DataFrame,
    trends: DataFrame,
    enriched: DataFrame,
    aliases: DataFrame,
    state: DataFrame,
    as_of: datetime,
) -> DataFrame:
    """The overview with changes, trailing sentiment, aliases, correlation and metrics (OVW2)."""
    out = stock_overview(symbols, prices, fx, predictions, daily, trends, as_of)
    wanted = symbols.select(F.upper("ticker").alias("ticker")).distinct()
    near = lambda df: df.join(wanted, "ticker", "left_semi")
    mood = near(daily).select("date", "ticker", F.col("sentiment_weighted").alias("sentiment"))
    sides = [
        last_two_closes(near(prices)).select("ticker", F.col("change_pct").alias("change_1d_pct")),
        trailing_sentiment(near(daily), near(hourly), as_of).select(
            "ticker", "weighted_7d", "weighted_last_day", "weighted_24h"
        ),
        mention_change(near(trends), as_of).select(
            "ticker", F.col("change_pct").alias("mention_change_pct"), hotness_level("hotness").alias("hotness_level")
        ),
        alias_lists(near(aliases)).select("ticker", F.array_join("aliases", ", ").alias("aliases")),
        return_sentiment_correlations(near(prices), mood).select(
            "ticker", F.col("pearson").alias("correlation"), F.col("samples").alias("correlation_samples")
        ),
        top_posts(near(enriched)),
        state.select("ticker", "accuracy", "f1", "avg_strategy_return", "long_win_rate"),
    ]
    for side in sides:
        out = out.join(side, "ticker", "left")
    return out
