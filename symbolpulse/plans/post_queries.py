"""Rollups, weights and filters over posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import times
from ..operators import rollups, tables, trends
from . import views as V
from .registry import query
from .rounding import rounded

AS_OF = "TIMESTAMP '2024-01-30 12:00:00'"

HOURLY = """
    SELECT date_trunc('hour', created_utc) AS created_utc, ticker,
           avg(sentiment_dict) AS sentiment_dict,
           sum(sentiment_weighted) / nullif(sum(1 + log10(1 + upvotes)), 0) AS sentiment_weighted,
           count(*) AS posts
    FROM enriched WHERE sentiment_weighted IS NOT NULL {extra} GROUP BY 1, 2"""
DAILY = """
    SELECT CAST(created_utc AS DATE) AS date, ticker,
           avg(sentiment_dict) AS sentiment_dict,
           sum(sentiment_weighted) / nullif(sum(1 + log10(1 + upvotes)), 0) AS sentiment_weighted,
           count(*) AS posts
    FROM enriched WHERE sentiment_weighted IS NOT NULL {extra} GROUP BY 1, 2"""
TRENDS = """
    SELECT CAST(created_utc AS DATE) AS date, ticker, count(*) AS mentions,
           avg(upvotes) AS avg_upvotes, count(*) * avg(upvotes) AS hotness
    FROM enriched WHERE sentiment_dict IS NOT NULL GROUP BY 1, 2"""
ROUND_MOOD = "round(sentiment_dict, 6) AS sentiment_dict, round(sentiment_weighted, 6) AS sentiment_weighted, posts"
WEIGHT = "(1 + log10(1 + greatest(upvotes, 0)) + 0.2 * log10(1 + greatest(num_comments, 0)))"


@query("agg1_hourly", f"SELECT created_utc, ticker, {ROUND_MOOD} FROM ({HOURLY.format(extra='')})", "enriched", stamps="created_utc")
def agg1_hourly(spark, sf):
    return rounded(rollups.hourly_sentiment(V.enriched(spark, sf)))


@query("agg1_daily", f"SELECT date, ticker, {ROUND_MOOD} FROM ({DAILY.format(extra='')})", "enriched", dates="date")
def agg1_daily(spark, sf):
    return rounded(rollups.daily_sentiment(V.enriched(spark, sf)))


_HOUR_CUT = f"AND created_utc >= date_trunc('hour', {AS_OF} - INTERVAL 168 HOUR)"


@query(
    "agg1_backfill",
    f"SELECT created_utc, ticker, {ROUND_MOOD} FROM ({HOURLY.format(extra=_HOUR_CUT)})",
    "enriched",
    stamps="created_utc",
)
def agg1_backfill(spark, sf):
    return rounded(rollups.hourly_sentiment(V.enriched(spark, sf), V.EVENTS_AS_OF, 7))


@query(
    "agg2",
    f"SELECT date, ticker, mentions, round(avg_upvotes, 6) AS avg_upvotes, round(hotness, 4) AS hotness FROM ({TRENDS})",
    "enriched",
    dates="date",
)
def agg2(spark, sf):
    out = rollups.daily_trends(V.enriched(spark, sf))
    return out.withColumn("avg_upvotes", F.round("avg_upvotes", 6)).withColumn("hotness", F.round("hotness", 4))


@query(
    "agg3",
    f"""
    SELECT CAST(created_utc AS DATE) AS date, ticker, count(*) AS n_posts,
           round(avg(coalesce(sentiment, 0)), 6) AS sentiment_mean,
           round(sum(coalesce(sentiment, 0) * {WEIGHT}) / greatest(sum({WEIGHT}), 1e-9), 6) AS sentiment_weighted,
           round(median(coalesce(sentiment, 0)), 6) AS sentiment_median
    FROM posts GROUP BY 1, 2""",
    "posts",
    dates="date",
)
def agg3(spark, sf):
    return rounded(rollups.daily_sentiment_stats(V.posts(spark, sf)))


@query(
    "agg4",
    f"""
    SELECT CAST(created_utc + INTERVAL 1 HOUR AS DATE) AS date, ticker, count(*) AS posts,
           round(sum(coalesce(sentiment, 0) * {WEIGHT}), 4) AS wgt_sum,
           round(sum(coalesce(sentiment, 0) * {WEIGHT}) / sum({WEIGHT}), 6) AS wgt_mean
    FROM posts GROUP BY 1, 2""",  # January: Berlin is one hour ahead
    "posts",
    dates="date",
)
def agg4(spark, sf):
    out = rollups.local_daily_sentiment(V.posts(spark, sf).withColumn("text", F.col("id")))
    return out.withColumn("wgt_sum", F.round("wgt_sum", 4)).withColumn("wgt_mean", F.round("wgt_mean", 6))


@query(
    "agg5",
    """
    SELECT s.ticker, round(coalesce(avg(coalesce(p.sentiment, 0)) FILTER (p.id IS NOT NULL), 0), 6) AS sentiment
    FROM suppliers s LEFT JOIN market_posts p ON s.ticker = p.ticker GROUP BY 1""",
    "suppliers market_posts",
)
def agg5(spark, sf):
    return rounded(rollups.mean_by_symbol(V.suppliers(spark, sf), V.market_posts(spark, sf)))


@query(
    "agg6",
    """
    SELECT ticker, round(avg(sentiment), 6) AS mean, round(median(sentiment), 6) AS median,
           count(sentiment) AS valid, count(*) AS total
    FROM market_posts GROUP BY 1""",
    "market_posts",
)
def agg6(spark, sf):
    return rounded(rollups.bucket_summary(V.market_posts(spark, sf)))


@query(
    "agg7",
    """
    SELECT CAST(created_utc AS DATE) AS date, ticker, round(avg(coalesce(sentiment, 0)), 6) AS sentiment
    FROM market_posts GROUP BY 1, 2""",
    "market_posts",
    dates="date",
)
def agg7(spark, sf):
    return rounded(rollups.training_sentiment(V.market_posts(spark, sf)))


@query(
    "agg8",
    f"""
    WITH daily AS ({DAILY.format(extra='')}), hourly AS ({HOURLY.format(extra='')}),
    d AS (
        SELECT ticker,
               avg(sentiment_dict) FILTER (date BETWEEN DATE '2024-01-23' AND DATE '2024-01-30') AS dict_7d,
               avg(sentiment_weighted) FILTER (date BETWEEN DATE '2024-01-23' AND DATE '2024-01-30') AS weighted_7d,
               CAST(coalesce(sum(posts) FILTER (date BETWEEN DATE '2024-01-23' AND DATE '2024-01-30'
                    AND sentiment_weighted IS NOT NULL), 0) AS BIGINT) AS posts_7d,
               arg_max(sentiment_weighted, date) AS weighted_last_day
        FROM daily GROUP BY 1),
    h AS (
        SELECT ticker, avg(sentiment_weighted) AS weighted_24h,
               avg(sentiment_weighted) FILTER (created_utc >= {AS_OF} - INTERVAL 1 HOUR) AS weighted_1h
        FROM hourly WHERE created_utc BETWEEN {AS_OF} - INTERVAL 24 HOUR AND {AS_OF} GROUP BY 1)
    SELECT ticker, round(dict_7d, 6) AS dict_7d, round(weighted_7d, 6) AS weighted_7d, posts_7d,
           round(weighted_last_day, 6) AS weighted_last_day, round(weighted_24h, 6) AS weighted_24h,
           round(weighted_1h, 6) AS weighted_1h
    FROM d LEFT JOIN h USING (ticker)""",
    "enriched",
)
def agg8(spark, sf):
    rows = V.enriched(spark, sf)
    daily, hourly = rollups.daily_sentiment(rows), rollups.hourly_sentiment(rows)
    return rounded(rollups.trailing_sentiment(daily, hourly, V.EVENTS_AS_OF))


@query(
    "agg9",
    f"""
    WITH t AS ({TRENDS}),
    c AS (
        SELECT ticker, coalesce(max(mentions) FILTER (date = DATE '2024-01-30'), 0) AS mentions,
               max(hotness) FILTER (date = DATE '2024-01-30') AS hotness,
               avg(mentions) FILTER (date >= DATE '2024-01-23' AND date < DATE '2024-01-30') AS avg_mentions
        FROM t WHERE date BETWEEN DATE '2024-01-23' AND DATE '2024-01-30' GROUP BY 1)
    SELECT ticker, mentions, round(hotness, 4) AS hotness, round(avg_mentions, 6) AS avg_mentions,
           round(coalesce((mentions / nullif(avg_mentions, 0) - 1) * 100, 0), 6) AS change_pct FROM c""",
    "enriched",
)
def agg9(spark, sf):
    out = rollups.mention_change(rollups.daily_trends(V.enriched(spark, sf)), V.EVENTS_AS_OF)
    return rounded(out.withColumn("hotness", F.round("hotness", 4)))


@query("agg16", "SELECT ticker, count(*) AS posts FROM market_posts GROUP BY 1 HAVING count(*) >= 2", "market_posts")
def agg16(spark, sf):
    return rollups.multi_hits(V.market_posts(spark, sf))


@query("flt4", "SELECT count(*) AS posts, count(*) FILTER (contains(id, '_')) AS comments FROM posts", "posts")
def flt4(spark, sf):
    return rollups.post_and_comment_counts(V.posts(spark, sf))


@query(
    "flt1",
    """
    SELECT * FROM (SELECT ticker, date, close FROM prices)
    WHERE ticker IN (SELECT upper(symbol) FROM watchlist)""",
    "prices watchlist",
    dates="date",
)
def flt1(spark, sf):
    wanted = V.watchlist(spark, sf).select(F.lower("symbol"))
    return tables.in_symbols(V.prices(spark, sf).select("ticker", "date", "close"), wanted)


@query(
    "flt2",
    """
    SELECT id, op, CASE op WHEN '<' THEN 30000 < price WHEN '>' THEN 30000 > price
                           WHEN '<=' THEN 30000 <= price WHEN '>=' THEN 30000 >= price END AS holds
    FROM alerts""",
    "alerts",
)
def flt2(spark, sf):
    return V.alerts(spark, sf).select("id", "op", S.price_test("op", F.lit(30000.0), "price").alias("holds"))


@query(
    "flt3",
    f"""
    SELECT date, ticker, CAST(CASE WHEN hotness > 0 THEN least(floor(hotness / 500), 3) ELSE 0 END AS INTEGER) AS level
    FROM ({TRENDS})""",
    "enriched",
    dates="date",
)
def flt3(spark, sf):
    trend = rollups.daily_trends(V.enriched(spark, sf))
    return trend.select("date", "ticker", S.hotness_level("hotness").alias("level"))


@query("wgt1", f"SELECT id, round({WEIGHT}, 6) AS weight FROM posts", "posts")
def wgt1(spark, sf):
    return rounded(V.posts(spark, sf).select("id", S.post_weight("upvotes", "num_comments").alias("weight")))


@query("wgt2", "SELECT id, round(sentiment_weighted, 6) AS sentiment_weighted FROM enriched", "enriched")
def wgt2(spark, sf):
    weighted = F.col("sentiment") * S.vote_weight("upvotes")
    return rounded(V.posts(spark, sf).select("id", weighted.alias("sentiment_weighted")))


@query(
    "mth1",
    """
    SELECT event_id, round(ln(1 + value), 6) AS log1p, round(log10(1 + value), 6) AS log10,
           round(least(greatest(value - 20, -5), 5), 6) AS clamped, round_even(value, 0) AS even
    FROM events""",
)
def mth1(spark, sf):
    value = F.col("value")
    return rounded(
        V.load(spark, sf, "events").select(
            "event_id",
            F.log1p(value).alias("log1p"),
            F.log10(1 + value).alias("log10"),
            S.clamp(value - 20, -5, 5).alias("clamped"),
            F.bround(value, 0).alias("even"),
        )
    )


@query(
    "dat1",
    """
    SELECT event_id, date_trunc('hour', ts) AS hour, CAST(ts AS DATE) AS day,
           CAST(ts + INTERVAL 1 HOUR AS DATE) AS berlin_day,
           make_timestamp(CAST(epoch(ts) AS BIGINT) * 1000000) AS second
    FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""",
    dates="day berlin_day",
    stamps="hour second",
)
def dat1(spark, sf):
    rows = V.load(spark, sf, "events").select(
        "event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts")
    )
    return rows.select(
        "event_id",
        times.utc_hour("ts").alias("hour"),
        times.utc_day("ts").alias("day"),
        times.local_day("ts").alias("berlin_day"),
        times.from_epoch(F.unix_timestamp("ts")).alias("second"),
    )


@query(
    "scr3",
    """
    SELECT id, round(least(greatest(coalesce(sentiment, 0) * 5 / 4, -0.6), 0.6), 6) AS boost FROM posts""",
    "posts",
)
def scr3(spark, sf):
    return rounded(V.posts(spark, sf).select("id", S.scaled_boost(F.col("sentiment") * 5).alias("boost")))


_ENTRIES = """
    SELECT id, upvotes / CAST(500 AS DOUBLE) AS a, num_comments / CAST(100 AS DOUBLE) AS b, ticker FROM posts"""


def _entries(spark, sf):
    rows = V.posts(spark, sf).select(
        "id", (F.col("upvotes") / 500.0).alias("a"), (F.col("num_comments") / 100.0).alias("b"), "ticker"
    )
    entry = lambda label, score: F.struct(label.alias("label"), score.alias("score"))
    busy = F.when(F.col("ticker") == "ERROR", F.lit("Bearish")).otherwise(F.lit("neutral"))
    label = F.when(F.col("ticker") == "CLICK", F.lit("bullish")).otherwise(F.lit(" POSITIVE"))
    return rows.select(
        "id",
        F.array(
            entry(label, F.col("a")),
            entry(F.lit("Negative"), F.when(F.col("ticker") != "ERROR", F.col("b")).otherwise(F.lit(0.0))),
            entry(label, F.col("a") / 2),
            entry(busy, F.col("b") / 3),
        ).alias("entries"),
    )


@query(
    "scr5",
    f"""
    SELECT id, round(greatest(-1, least(1, a - CASE WHEN ticker = 'ERROR' THEN b / 3 ELSE b END)), 6) AS scalar,
           round(greatest(-1, least(1, CASE WHEN ticker = 'CLICK' THEN 0 ELSE 0 END
                 - CASE WHEN ticker = 'ERROR' THEN 0 ELSE b END)), 6) AS last_scalar
    FROM ({_ENTRIES})""",
    "posts",
)
def scr5(spark, sf):
    return rounded(
        _entries(spark, sf).select(
            "id", S.label_scalar("entries").alias("scalar"), S.label_scalar_last("entries").alias("last_scalar")
        )
    )


_MIX = """
    SELECT id, sentiment AS model, CASE WHEN ticker <> 'VIEW' THEN num_comments / CAST(100 AS DOUBLE) ELSE 0 END AS second,
           CASE WHEN upvotes > 10 THEN CAST(upvotes % 5 - 2 AS DOUBLE) END AS lexicon, ticker
    FROM posts"""


def _mix(spark, sf):
    up = F.col("upvotes")
    return V.posts(spark, sf).select(
        "id",
        F.col("sentiment").alias("model"),
        F.when(F.col("ticker") != "VIEW", F.col("num_comments") / 100.0).otherwise(0.0).alias("second"),
        F.when(up > 10, (up % 5 - 2).cast("double")).alias("lexicon"),
        "ticker",
    )


@query(
    "scr6",
    f"""
    SELECT id, round(greatest(-1, least(1, CASE WHEN abs(model) < 0.2 AND second <> 0
                     THEN 0.6 * model + 0.4 * second ELSE model END
               + greatest(-0.6, least(0.6, coalesce(lexicon, 0) / 4)))), 6) AS score
    FROM (SELECT * REPLACE (coalesce(model, 0) AS model) FROM ({_MIX}))""",
    "posts",
)
def scr6(spark, sf):
    rows = _mix(spark, sf).withColumn("model", F.coalesce("model", F.lit(0.0)))
    return rounded(rows.select("id", S.blend("model", "second", "lexicon").alias("score")))


@query(
    "scr8",
    f"""
    SELECT id, round(CASE WHEN ticker = 'ERROR' THEN 0 ELSE coalesce(nullif(model, 0), lexicon, 0) END, 6) AS score,
           round(CASE WHEN ticker = 'ERROR' THEN 0 ELSE coalesce(nullif(model, 0), second, 0) END, 6) AS with_second
    FROM ({_MIX})""",
    "posts",
)
def scr8(spark, sf):
    text = F.when(F.col("ticker") == "ERROR", "  ").otherwise(F.col("ticker"))
    rows = _mix(spark, sf).withColumn("text", text)
    return rounded(
        rows.select(
            "id",
            S.first_score("text", "model", None, "lexicon").alias("score"),
            S.first_score("text", "model", "second", "lexicon").alias("with_second"),
        )
    )


@query(
    "scr9",
    f"""
    SELECT id, round(CASE WHEN model IS NOT NULL THEN model WHEN ticker <> 'ERROR' THEN second END, 6) AS score
    FROM ({_MIX})""",
    "posts",
)
def scr9(spark, sf):
    text = F.when(F.col("ticker") == "ERROR", "").otherwise(F.col("ticker"))
    rows = _mix(spark, sf).withColumn("text", text)
    return rounded(rows.select("id", S.fill_score("model", "text", "second").alias("score")))


@query(
    "scr10",
    "SELECT id, CASE WHEN sentiment > 0 THEN 'Buy' WHEN sentiment < 0 THEN 'Sell' ELSE 'Hold' END AS advice FROM posts",
    "posts",
)
def scr10(spark, sf):
    return V.posts(spark, sf).select("id", S.recommendation("sentiment").alias("advice"))


@query(
    "trd2",
    """
    WITH c AS (
        SELECT ticker,
               count(*) FILTER (created_utc >= TIMESTAMP '2024-01-29 12:00:00'
                            AND created_utc <= TIMESTAMP '2024-01-30 12:00:00') AS recent,
               count(*) FILTER (created_utc >= TIMESTAMP '2024-01-23 12:00:00'
                            AND created_utc < TIMESTAMP '2024-01-29 12:00:00') AS baseline
        FROM posts GROUP BY 1)
    SELECT * FROM c WHERE recent >= 3 AND (baseline = 0 OR recent / greatest(baseline, 1) >= 0.15)""",
    "posts",
)
def trd2(spark, sf):
    # Events come evenly; a low ratio lets the rule split the five types.
    return trends.spikes(V.posts(spark, sf), V.EVENTS_AS_OF, ratio=0.15)


@query(
    "dst2",
    """
    SELECT ticker, id, created_utc FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY created_utc DESC, id) AS rn FROM posts) WHERE rn = 1""",
    "posts",
    stamps="created_utc",
)
def dst2(spark, sf):
    rows = V.posts(spark, sf).select("ticker", "id", "created_utc")
    return tables.first_per_key(rows, ["ticker"], F.col("created_utc").desc(), F.col("id"))


@query(
    "rnk2",
    """
    SELECT ticker, id FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY created_utc DESC, id) AS rn FROM posts) WHERE rn <= 100""",
    "posts",
)
def rnk2(spark, sf):
    rows = V.posts(spark, sf).select("ticker", "id", "created_utc")
    return tables.first_per_key(rows, ["ticker"], F.col("created_utc").desc(), F.col("id"), n=100).select("ticker", "id")


@query(
    "set2",
    """
    SELECT id, ticker FROM posts WHERE created_utc < TIMESTAMP '2024-01-20 00:00:00' AND ticker <> 'CLICK'
    UNION ALL
    SELECT CASE WHEN ticker <> 'SIGNUP' THEN id END, ticker FROM posts p
    WHERE (created_utc >= TIMESTAMP '2024-01-10 00:00:00' OR ticker = 'CLICK')
      AND (ticker = 'SIGNUP' OR NOT EXISTS (SELECT 1 FROM posts q WHERE q.id = p.id
           AND q.created_utc < TIMESTAMP '2024-01-20 00:00:00' AND q.ticker <> 'CLICK'))""",
    "posts",
)
def set2(spark, sf):
    rows = V.posts(spark, sf)
    old = rows.where("created_utc < timestamp'2024-01-20 00:00:00' AND ticker <> 'CLICK'").select("id", "ticker")
    new = rows.where("created_utc >= timestamp'2024-01-10 00:00:00' OR ticker = 'CLICK'").select(
        F.when(F.col("ticker") != "SIGNUP", F.col("id")).alias("id"), "ticker"
    )
    return tables.merge_posts(old, new)
