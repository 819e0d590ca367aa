"""Sentiment and mention rollups of posts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_col
from ..functions.scores import finite, post_weight, vote_weight
from ..functions.times import local_day, utc_day, utc_hour
from .ranks import medians


def _weighted_mean(weighted: str, upvotes: str) -> Column:
    return F.try_divide(F.sum(weighted), F.nullif(F.sum(vote_weight(upvotes)), F.lit(0.0)))


def _rollup(enriched: DataFrame, bucket: Column, name: str) -> DataFrame:
    return (
        enriched.where(F.col("sentiment_weighted").isNotNull())
        .groupBy(bucket.alias(name), "ticker")
        .agg(
            F.avg("sentiment_dict").alias("sentiment_dict"),
            _weighted_mean("sentiment_weighted", "upvotes").alias("sentiment_weighted"),
            F.count(F.lit(1)).alias("posts"),
        )
    )


def backfill_start(as_of: datetime, days: int, unit: str) -> Column:
    """Start of the recomputed range, cut at the hour or day."""
    moment = F.lit(as_of).cast("timestamp")
    if unit == "hour":
        return F.date_trunc("hour", moment - F.expr(f"INTERVAL {days * 24} HOURS"))
    return F.date_trunc("day", moment) - F.expr(f"INTERVAL {days} DAYS")


def _recent(enriched: DataFrame, as_of: datetime | None, days: int, unit: str) -> DataFrame:
    if as_of is None or days <= 0:
        return enriched
    kind = enriched.schema["created_utc"].dataType
    return enriched.where(F.col("created_utc") >= backfill_start(as_of, days, unit).cast(kind))


def hourly_sentiment(enriched: DataFrame, as_of: datetime | None = None, backfill_days: int = 0) -> DataFrame:
    """Sentiment per hour and symbol; 0 days recompute everything (AGG1)."""
    recent = _recent(enriched, as_of, backfill_days, "hour")
    return _rollup(recent, utc_hour("created_utc"), "created_utc")


def daily_sentiment(enriched: DataFrame, as_of: datetime | None = None, backfill_days: int = 0) -> DataFrame:
    """Sentiment per day and symbol; 0 days recompute everything (AGG1)."""
    recent = _recent(enriched, as_of, backfill_days, "day")
    return _rollup(recent, utc_day("created_utc"), "date")


def daily_trends(enriched: DataFrame) -> DataFrame:
    """Mentions, mean votes and hotness per day and symbol (AGG2)."""
    return (
        enriched.where(F.col("sentiment_dict").isNotNull())
        .groupBy(utc_day("created_utc").alias("date"), "ticker")
        .agg(F.count(F.lit(1)).alias("mentions"), F.avg("upvotes").alias("avg_upvotes"))
        .withColumn("hotness", F.col("mentions") * F.col("avg_upvotes"))
    )


def daily_sentiment_stats(posts: DataFrame) -> DataFrame:
    """Count, mean, weighted mean and exact median per day and symbol (AGG3).

    ``posts``: ticker, created_utc, sentiment, upvotes, num_comments.
    """
    keys = ["date", "ticker"]
    scored = posts.select(
        utc_day("created_utc").alias("date"),
        "ticker",
        F.coalesce(finite("sentiment"), F.lit(0.0)).alias("sentiment"),
        post_weight("upvotes", "num_comments").alias("weight"),
    )
    stats = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.avg("sentiment").alias("sentiment_mean"),
        (F.sum(F.col("sentiment") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-9))).alias(
            "sentiment_weighted"
        ),
    )
    return stats.join(medians(scored, keys, "sentiment", "sentiment_median"), keys)


def local_daily_sentiment(posts: DataFrame, zone: str = "Europe/Berlin") -> DataFrame:
    """Weighted sum and mean per local day and symbol (AGG4)."""
    weight = post_weight("upvotes", "num_comments")
    score = F.coalesce(finite("sentiment"), F.lit(0.0))
    grouped = posts.groupBy(local_day("created_utc", zone).alias("date"), "ticker").agg(
        F.count("text").alias("posts"),
        F.sum(score * weight).alias("wgt_sum"),
        F.sum(weight).alias("_weight"),
    )
    mean = F.coalesce(F.try_divide("wgt_sum", "_weight"), F.lit(0.0))
    return grouped.select("date", "ticker", "posts", "wgt_sum", mean.alias("wgt_mean"))


def mean_by_symbol(symbols: DataFrame, posts: DataFrame) -> DataFrame:
    """Mean score per listed symbol, 0 without posts (AGG5)."""
    means = posts.groupBy("ticker").agg(F.avg(F.coalesce("sentiment", F.lit(0.0))).alias("sentiment"))
    return symbols.join(means, "ticker", "left").select(
        "ticker", F.coalesce("sentiment", F.lit(0.0)).alias("sentiment")
    )


def bucket_summary(posts: DataFrame) -> DataFrame:
    """Mean, exact median, valid scores and posts per symbol (AGG6)."""
    scored = posts.select("ticker", finite("sentiment").alias("sentiment"))
    stats = scored.groupBy("ticker").agg(
        F.avg("sentiment").alias("mean"),
        F.count("sentiment").alias("valid"),
        F.count(F.lit(1)).alias("total"),
    )
    return stats.join(medians(scored, ["ticker"], "sentiment", "median"), "ticker", "left")


def training_sentiment(posts: DataFrame) -> DataFrame:
    """Plain daily mean per symbol, as the classifier takes it (AGG7)."""
    dated = posts.where(F.col("created_utc").isNotNull())
    return dated.groupBy(utc_day("created_utc").alias("date"), "ticker").agg(
        F.avg(F.coalesce(finite("sentiment"), F.lit(0.0))).alias("sentiment")
    )


def trailing_sentiment(daily: DataFrame, hourly: DataFrame, as_of: datetime) -> DataFrame:
    """Sentiment of the last 7 days, 24 hours, 1 hour and latest day (AGG8)."""
    moment = F.lit(as_of).cast("timestamp")
    day_start = F.date_sub(F.to_date(moment), 7)
    recent_day = (F.col("date") >= day_start) & (F.col("date") <= F.to_date(moment))
    with_weight = recent_day & F.col("sentiment_weighted").isNotNull()
    by_day = daily.groupBy("ticker").agg(
        F.avg(F.when(recent_day, F.col("sentiment_dict"))).alias("dict_7d"),
        F.avg(F.when(recent_day, F.col("sentiment_weighted"))).alias("weighted_7d"),
        F.coalesce(F.sum(F.when(with_weight, F.col("posts"))), F.lit(0)).alias("posts_7d"),
        F.max_by("sentiment_weighted", "date").alias("weighted_last_day"),
    )

    def within(hours):
        start = (moment - F.expr(f"INTERVAL {hours} HOURS")).cast(hourly.schema["created_utc"].dataType)
        end = moment.cast(hourly.schema["created_utc"].dataType)
        return (F.col("created_utc") >= start) & (F.col("created_utc") <= end)

    by_hour = (
        hourly.where(within(24))
        .groupBy("ticker")
        .agg(
            F.avg("sentiment_weighted").alias("weighted_24h"),
            F.avg(F.when(within(1), F.col("sentiment_weighted"))).alias("weighted_1h"),
        )
    )
    return by_day.join(by_hour, "ticker", "left")


def mention_change(trends: DataFrame, as_of: datetime) -> DataFrame:
    """Mentions of the day against the mean of the seven days before, in percent (AGG9)."""
    today = F.to_date(F.lit(as_of).cast("timestamp"))
    is_today = F.col("date") == today
    week = (F.col("date") >= F.date_sub(today, 7)) & (F.col("date") < today)
    counted = (
        trends.where((F.col("date") >= F.date_sub(today, 7)) & (F.col("date") <= today))
        .groupBy("ticker")
        .agg(
            F.coalesce(F.max(F.when(is_today, F.col("mentions"))), F.lit(0)).alias("mentions"),
            F.max(F.when(is_today, F.col("hotness"))).alias("hotness"),
            F.avg(F.when(week, F.col("mentions"))).alias("avg_mentions"),
        )
    )
    change = (F.try_divide("mentions", "avg_mentions") - 1) * 100
    return counted.withColumn("change_pct", F.coalesce(change, F.lit(0.0)))


def multi_hits(posts: DataFrame, minimum: int = 2) -> DataFrame:
    """Symbols with at least ``minimum`` posts (AGG16)."""
    return posts.groupBy("ticker").agg(F.count(F.lit(1)).alias("posts")).where(F.col("posts") >= minimum)


def post_and_comment_counts(posts: DataFrame) -> DataFrame:
    """Posts, and those that are comments by their id (FLT4)."""
    return posts.agg(
        F.count(F.lit(1)).alias("posts"), F.count_if(as_col("id").contains("_")).alias("comments")
    )
