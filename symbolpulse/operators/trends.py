"""Mention trends: lift against a smoothed baseline, spikes, automatic watchlist."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import as_col
from ..functions.fixed_values import WATCHLIST_RULES
from . import ranks
from .tables import first_per_key, merge_candidates


def _stamp(df: DataFrame, moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp").cast(df.schema["created_utc"].dataType)


def _cell(mentions: DataFrame, as_of: datetime, lookback_days: int, window_hours: int):
    """Window and baseline sums of one grid cell."""
    start = _stamp(mentions, as_of - timedelta(days=lookback_days))
    split = _stamp(mentions, as_of - timedelta(hours=window_hours))
    created, tagged = F.col("created_utc"), F.col("tagged_at")
    # The window may be longer than the look-back; tags count from the earlier start.
    earliest = F.least(start, split)
    valid = tagged.isNull() | (tagged >= earliest)
    now = created <= _stamp(mentions, as_of)
    recent = F.sum(F.when(valid & now & (created >= split), F.col("weight")))
    base = F.sum(F.when(valid & (created >= start) & (created < split), F.col("weight")))
    return F.struct(
        F.lit(lookback_days).alias("lookback_days"),
        F.lit(window_hours).alias("window_hours"),
        recent.alias("recent"),
        F.coalesce(base, F.lit(0.0)).alias("base"),
    )


def mention_counts(
    mentions: DataFrame, as_of: datetime, grid: Sequence[tuple[int, int]]
) -> DataFrame:
    """Window and baseline mentions per symbol and (look-back days, window hours) (AGG12).

    All grid cells come out of one pass and one shuffle of partial sums.
    """
    cells = [_cell(mentions, as_of, lookback, window) for lookback, window in grid]
    return (
        mentions.groupBy("symbol")
        .agg(F.array(*cells).alias("cells"))
        .select("symbol", F.posexplode("cells").alias("grid_no", "cell"))
        .select("symbol", "grid_no", "cell.*")
    )


def _lift_floor(counts: DataFrame, min_lift: float, quantile: float | None) -> Column:
    """Least lift, adapted to a quantile of the baseline rates when asked (TRD3)."""
    if quantile is None:
        return F.lit(float(min_lift))
    q = ranks.quantile(counts, "rate", quantile).scalar()
    ratio = F.max(F.greatest(F.lit(1.0), F.col("base_hours") / F.col("window_hours")))
    ratio = counts.agg(ratio.alias("ratio")).scalar()
    return F.when(
        q < 1.0, F.greatest(F.lit(1.5), min_lift * F.greatest(q, F.lit(0.1)))
    ).otherwise(F.greatest(F.lit(float(min_lift)), min_lift * q / ratio))


def score_counts(
    counts: DataFrame,
    min_mentions: int = 20,
    min_lift: float = 3.0,
    k_smooth: float = 0.5,
    lift_quantile: float | None = None,
) -> DataFrame:
    """Smoothed rate, lift and trend per row of :func:`mention_counts` (TRD1)."""
    hours = F.greatest(F.lit(1.0), F.col("lookback_days") * 24.0 - F.col("window_hours"))
    rated = counts.withColumn("base_hours", hours).withColumn(
        "rate", (F.col("base") + k_smooth) / (F.col("base_hours") + k_smooth)
    )
    mentions = F.bround("recent", 0).cast("bigint")
    expected = F.greatest(F.lit(1e-6), F.col("rate") * F.col("window_hours"))
    return (
        rated.where(F.col("recent").isNotNull())
        .withColumn("mentions", mentions)
        .withColumn("lift", F.col("mentions") / expected)
        .withColumn("trend", F.col("lift") * F.log1p(F.col("mentions").cast("double")))
        .where(F.col("mentions") >= min_mentions)
        .where(F.col("lift") >= _lift_floor(rated, min_lift, lift_quantile))
        .select(
            "symbol",
            "grid_no",
            "lookback_days",
            "window_hours",
            "mentions",
            F.col("rate").alias("baseline_rate_per_h"),
            "lift",
            "trend",
        )
    )


def candidate_order() -> list[Column]:
    """Known symbols first, then trend, lift and mentions (TOP4); the symbol breaks ties."""
    return [F.col(c).desc() for c in ("is_known", "trend", "lift", "mentions")] + [F.col("symbol")]


def mark_known(candidates: DataFrame, known: DataFrame, promoted: DataFrame | None = None) -> DataFrame:
    """Flag ``is_known`` from the known set and validated discoveries (JON6, JON7)."""
    names = known.select("symbol")
    if promoted is not None:
        names = names.unionByName(promoted.select("symbol"))
    flags = names.distinct().withColumn("_known", F.lit(True))
    return candidates.join(flags, "symbol", "left").withColumn(
        "is_known", F.coalesce("_known", F.lit(False))
    ).drop("_known")


def trend_scan(
    mentions: DataFrame,
    known: DataFrame,
    as_of: datetime,
    lookback_days: int = 7,
    window_hours: int = 24,
    min_mentions: int = 20,
    min_lift: float = 3.0,
    k_smooth: float = 0.5,
    lift_quantile: float | None = None,
    promoted: DataFrame | None = None,
) -> DataFrame:
    """Symbols mentioned more than their baseline lets expect, unsorted (TRD1).

    ``mentions`` is the output of ``mentions.symbol_mentions``.  Sort with
    :func:`candidate_order`.
    """
    counts = mention_counts(mentions, as_of, [(lookback_days, window_hours)])
    scored = score_counts(counts, min_mentions, min_lift, k_smooth, lift_quantile)
    return mark_known(scored.drop("grid_no", "lookback_days", "window_hours"), known, promoted)


def trend_grid(
    mentions: DataFrame,
    known: DataFrame,
    as_of: datetime,
    lookbacks: Sequence[int] = (3, 7),
    windows: Sequence[int] = (12, 24),
    min_mentions: int = 20,
    min_lift: float = 3.0,
    promoted: DataFrame | None = None,
) -> DataFrame:
    """Best scan per symbol over a grid; the earlier cell wins ties (TRD4, RNK3)."""
    grid = [(lookback, window) for lookback in lookbacks for window in windows]
    scored = score_counts(mention_counts(mentions, as_of, grid), min_mentions, min_lift)
    best = first_per_key(scored, ["symbol"], F.col("trend").desc(), F.col("grid_no"))
    return mark_known(best, known, promoted)


def scan_tables(scan: DataFrame, target: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """What a scan writes back: its history rows, and the candidate table after it (SNK3, UPS2).

    ``scan`` is the output of :func:`trend_scan`, ``target`` the candidate table so far.
    """
    measured = scan.withColumnRenamed("mentions", "mentions_24h")
    history = measured.withColumn("ts", F.lit(as_of).cast("timestamp"))
    return history, merge_candidates(target, measured, as_of)


def with_weekly_returns(candidates: DataFrame, weekly: DataFrame, limit: int = 10) -> DataFrame:
    """Weekly return for the first ``limit`` candidates that have one, in list order."""
    joined = candidates.join(weekly.select(F.col("ticker").alias("symbol"), "weekly_return"), "symbol", "left")
    shown = joined.where(F.col("weekly_return").isNotNull()).orderBy(*candidate_order()).limit(limit)
    picked = shown.select("symbol", F.col("weekly_return").alias("_shown"))
    return joined.join(picked, "symbol", "left").withColumn("weekly_return", F.col("_shown")).drop("_shown")


def spikes(
    posts: DataFrame,
    as_of: datetime,
    window_hours: int = 24,
    baseline_days: int = 7,
    min_mentions: int = 3,
    ratio: float = 2.0,
) -> DataFrame:
    """Symbols with many recent posts against the days before (TRD2)."""
    created = F.col("created_utc")
    split = _stamp(posts, as_of - timedelta(hours=window_hours))
    start = _stamp(posts, as_of - timedelta(days=baseline_days))
    recent = F.count_if((created >= split) & (created <= _stamp(posts, as_of)))
    base = F.count_if((created >= start) & (created < split))
    counted = posts.groupBy("ticker").agg(recent.alias("recent"), base.alias("baseline"))
    high = (F.col("baseline") == 0) | (F.col("recent") / F.greatest("baseline", F.lit(1)) >= ratio)
    return counted.where((F.col("recent") >= min_mentions) & high)


def _is_pattern(pattern: str) -> bool:
    """Does the engine that will run it take the pattern?"""
    try:
        SparkSession.active().sql("SELECT '' RLIKE :pattern", args={"pattern": pattern}).collect()
    except PySparkException:
        return False
    return True


def parse_rules(raw: str) -> list[tuple[str | None, int, float]]:
    """``PATTERN:mentions:lift,...`` to rules; unreadable ones are skipped (JON10)."""
    rules: list[tuple[str | None, int, float]] = []
    for part in raw.split(","):
        pieces = part.split(":")
        if len(pieces) != 3:
            continue
        pattern = pieces[0].strip()
        try:
            limits = int(pieces[1]), float(pieces[2])
        except ValueError:
            continue
        if not _is_pattern(pattern):
            continue
        rules.append((None if pattern.lower() == "default" else pattern, *limits))
    return rules


def rule_thresholds(
    symbol: Column | str, rules: str = WATCHLIST_RULES, default: tuple[int, float] = (25, 3.5)
) -> tuple[Column, Column]:
    """Least mentions and lift of the first rule that fits the symbol (JON10).

    Rules are configuration: they become one CASE expression, no join.
    """
    mentions, lift = F.lit(default[0]), F.lit(float(default[1]))
    for pattern, min_mentions, min_lift in reversed(parse_rules(rules)):
        fits = F.lit(True) if pattern is None else as_col(symbol).rlike(pattern)
        mentions = F.when(fits, min_mentions).otherwise(mentions)
        lift = F.when(fits, min_lift).otherwise(lift)
    return mentions, lift


def auto_watchlist(
    candidates: DataFrame,
    watchlist: DataFrame,
    known: DataFrame,
    rules: str = WATCHLIST_RULES,
    default: tuple[int, float] = (25, 3.5),
    max_new: int = 3,
    top: int = 20,
    scope: str = "_GLOBAL_",
) -> DataFrame:
    """Rows to add to the watchlist: the best known candidates above their limits (TRD5)."""
    order = [F.col("trend").desc(), F.col("lift").desc(), F.col("mentions_24h").desc(), F.col("symbol")]
    best = candidates.orderBy(*order).limit(top)
    min_mentions, min_lift = rule_thresholds("symbol", rules, default)
    fit = (
        best.where(F.col("mentions_24h").isNotNull() & F.col("lift").isNotNull())
        .join(watchlist.select("symbol"), "symbol", "left_anti")
        .join(known.select("symbol"), "symbol", "left_semi")
        .where((F.col("mentions_24h") >= min_mentions) & (F.col("lift") >= min_lift))
    )
    note = F.format_string("auto-added %d m24h, lift %.1f, trend %.2f", "mentions_24h", "lift", "trend")
    return fit.orderBy(*order).limit(max_new).select(
        F.lit(scope).alias("chat_id"), "symbol", note.alias("note")
    )


def recent_posts(posts: DataFrame, as_of: datetime, lookback_days: int = 7, window_hours: int = 24) -> DataFrame:
    """Posts a scan at ``as_of`` looks at; the range reaches the scan of the files."""
    hours = max(lookback_days * 24, window_hours)
    start = _stamp(posts, as_of - timedelta(hours=hours))
    return posts.where((F.col("created_utc") >= start) & (F.col("created_utc") <= _stamp(posts, as_of)))
