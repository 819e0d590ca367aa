"""As-of joins, returns, bars, correlations and short lists over prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overview, prices, rollups
from . import views as V
from .post_queries import TRENDS
from .registry import query
from .rounding import rounded

MARKET_ENRICHED = """
    SELECT *, sentiment AS sentiment_dict, sentiment * (1 + log10(1 + upvotes)) AS sentiment_weighted
    FROM market_posts"""


def market_enriched(spark, sf):
    return V.market_posts(spark, sf).withColumns(
        {
            "sentiment_dict": F.col("sentiment"),
            "sentiment_weighted": F.col("sentiment") * (1 + F.log10(1 + F.col("upvotes"))),
        }
    )


_EUR = ", ".join(
    f"round(p.{c} / f.rate_usd_per_eur, 4) AS {c}_eur" for c in ("open", "high", "low", "close", "adj_close")
)


@query(
    "asf1",
    f"""
    SELECT p.date, p.ticker, p.open, p.high, p.low, p.close, p.adj_close, p.volume, {_EUR}
    FROM prices p ASOF LEFT JOIN (SELECT * FROM fx WHERE pair = 'EURUSD') f ON p.date >= f.date""",
    "prices fx",
    dates="date",
)
def asf1(spark, sf):
    return rounded(prices.with_eur(V.prices(spark, sf), V.fx(spark, sf)), 4)


@query(
    "asf2",
    """
    WITH last AS (SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM prices GROUP BY 1)
    SELECT p.ticker, p.date, p.close, round(p.close / f.rate_usd_per_eur, 4) AS close_eur
    FROM last p ASOF LEFT JOIN fx f ON p.date >= f.date""",
    "prices fx",
    dates="date",
)
def asf2(spark, sf):
    return rounded(prices.latest_prices_eur(V.prices(spark, sf), V.fx(spark, sf)), 4)


AHEAD = """
    SELECT ticker, date,
           (lead(close, 1) OVER w - close) / nullif(close, 0) AS return_1d,
           (lead(close, 3) OVER w - close) / nullif(close, 0) AS return_3d,
           (lead(close, 7) OVER w - close) / nullif(close, 0) AS return_7d
    FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)"""


@query(
    "asf3",
    f"""
    WITH a AS ({AHEAD})
    SELECT p.id, p.ticker, p.created_utc, round(a.return_1d, 6) AS return_1d,
           round(a.return_3d, 6) AS return_3d, round(a.return_7d, 6) AS return_7d
    FROM market_posts p ASOF LEFT JOIN a ON p.ticker = a.ticker AND CAST(p.created_utc AS DATE) <= a.date""",
    "prices market_posts",
    stamps="created_utc",
)
def asf3(spark, sf):
    rows = V.market_posts(spark, sf).select("id", "ticker", "created_utc")
    return rounded(prices.forward_returns(rows, V.prices(spark, sf)))


WEEKLY = """
    SELECT ticker, latest / reference - 1 AS weekly_return FROM (
        SELECT ticker, arg_max(close, date) AS latest,
               coalesce(arg_max(close, date) FILTER (date <= last - 7),
                        CASE WHEN count(*) >= 2 THEN arg_min(close, date) END) AS reference
        FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS last FROM (
                SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM prices)
              WHERE rn <= 15 AND close IS NOT NULL)
        GROUP BY 1) WHERE latest > 0 AND reference > 0"""


@query("asf4", f"SELECT ticker, round(weekly_return, 6) AS weekly_return FROM ({WEEKLY})", "prices")
def asf4(spark, sf):
    return rounded(prices.weekly_returns(V.prices(spark, sf)))


@query(
    "win15",
    f"""
    WITH w AS ({WEEKLY}), listed AS (
        SELECT 'S' || s_suppkey AS ticker, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS position FROM supplier)
    SELECT ticker, round(weekly_return, 6) AS weekly_return, position FROM w JOIN listed USING (ticker)
    ORDER BY position LIMIT 10""",
    "prices",
)
def win15(spark, sf):
    # Positions by balance: ties cannot happen after adding the key as a fraction.
    listed = V.load(spark, sf, "supplier").select(
        F.concat(F.lit(" $s"), F.col("s_suppkey")).alias("symbol"), "s_acctbal", "s_suppkey"
    )
    ranked = listed.orderBy(F.col("s_acctbal").desc(), "s_suppkey").withColumn(
        "position", F.struct((-F.col("s_acctbal")).alias("a"), F.col("s_suppkey").alias("b"))
    )
    out = prices.listed_weekly_returns(V.prices(spark, sf), ranked, 10)
    place = F.row_number().over(prices.Window.orderBy("position.a", "position.b"))
    return rounded(out.select("ticker", "weekly_return", place.alias("position")))


@query("rnk1", "SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM prices GROUP BY 1", "prices", dates="date")
def rnk1(spark, sf):
    return prices.latest_prices(V.prices(spark, sf))


@query(
    "rnk1_signals",
    """
    SELECT ticker, arg_max(signal, as_of) AS signal, max(as_of) AS as_of FROM predictions
    WHERE horizon_days = 1 GROUP BY 1""",
    "predictions",
    stamps="as_of",
)
def rnk1_signals(spark, sf):
    return overview.latest_predictions(V.predictions(spark, sf)).select("ticker", "signal", "as_of")


@query(
    "jon9",
    """
    SELECT ticker, date, sentiment, posts FROM market_daily d
    WHERE date = (SELECT max(date) FROM market_daily e WHERE e.ticker = d.ticker)""",
    "market_daily",
    dates="date",
)
def jon9(spark, sf):
    return prices.latest_rows(V.market_daily(spark, sf), ["ticker"], "date")


@query(
    "agg13",
    """
    SELECT ticker, max(CASE WHEN rn = 1 THEN close END) AS last_close, max(CASE WHEN rn = 2 THEN close END) AS prev_close,
           round((max(CASE WHEN rn = 1 THEN close END) / nullif(max(CASE WHEN rn = 2 THEN close END), 0) - 1) * 100, 6) AS change_pct
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM prices) GROUP BY 1""",
    "prices",
)
def agg13(spark, sf):
    return rounded(prices.last_two_closes(V.prices(spark, sf)))


@query(
    "agg14",
    """
    SELECT ticker, CAST(ts AS DATE) AS date, round(arg_min(open, row(ts, event_id)), 6) AS open, round(max(high), 6) AS high,
           round(min(low), 6) AS low, round(arg_max(close, row(ts, event_id)), 6) AS close,
           CAST(sum(coalesce(volume, 0)) AS BIGINT) AS volume
    FROM ticks GROUP BY 1, 2""",
    "ticks",
    dates="date",
)
def agg14(spark, sf):
    return rounded(prices.daily_bars(V.ticks(spark, sf), F.col("event_id")))


@query(
    "win14",
    """
    SELECT ticker, date, close, round(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1, 6) AS return
    FROM prices""",
    "prices",
    dates="date",
)
def win14(spark, sf):
    return rounded(prices.daily_changes(V.prices(spark, sf)))


CORRELATIONS = """
    WITH r AS (SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM prices),
    j AS (SELECT r.ticker, ret, sentiment FROM r JOIN market_daily USING (ticker, date) WHERE ret IS NOT NULL),
    k AS (SELECT *, rank() OVER (PARTITION BY ticker ORDER BY ret) + (count(*) OVER (PARTITION BY ticker, ret) - 1) / 2.0 AS rr,
                 rank() OVER (PARTITION BY ticker ORDER BY sentiment)
                 + (count(*) OVER (PARTITION BY ticker, sentiment) - 1) / 2.0 AS rs FROM j)
    SELECT ticker, round(corr(ret, sentiment), 6) AS pearson,
           round(corr(CAST(rr AS DOUBLE), CAST(rs AS DOUBLE)), 6) AS spearman, count(*) AS samples
    FROM k GROUP BY 1 HAVING count(*) >= 5"""


@query("agg15", CORRELATIONS, "prices market_daily")
def agg15(spark, sf):
    return rounded(prices.return_sentiment_correlations(V.prices(spark, sf), V.market_daily(spark, sf)))


@query(
    "jon1",
    """
    WITH r AS (SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM prices)
    SELECT ticker, date, round(ret, 6) AS return, sentiment FROM r JOIN market_daily USING (ticker, date)""",
    "prices market_daily",
    dates="date",
)
def jon1(spark, sf):
    changes = prices.daily_changes(V.prices(spark, sf)).select("ticker", "date", "return")
    mood = V.market_daily(spark, sf).select("ticker", "date", "sentiment")
    return rounded(changes.join(mood, ["ticker", "date"]))


@query(
    "top1",
    f"""
    SELECT ticker, mentions, round(hotness, 4) AS hotness FROM ({TRENDS})
    WHERE date = DATE '2024-01-30' AND mentions >= 2 ORDER BY hotness DESC, mentions DESC, ticker LIMIT 5""",
    "enriched",
)
def top1(spark, sf):
    best = overview.top_trends(rollups.daily_trends(V.enriched(spark, sf)), V.EVENTS_AS_OF)
    return rounded(best.select("ticker", "mentions", "hotness"), 4)


_LATEST_SIGNALS = """
    SELECT ticker, arg_max(signal, as_of) AS signal,
           max_by(struct_pack(c := confidence), as_of).c AS confidence
    FROM predictions WHERE horizon_days = 1 GROUP BY 1"""


@query(
    "top2",
    f"""
    SELECT ticker, signal, confidence FROM (
        SELECT *, row_number() OVER (PARTITION BY signal ORDER BY coalesce(confidence, 0) DESC, ticker) AS rn
        FROM ({_LATEST_SIGNALS}) WHERE signal IN ('buy', 'sell')) WHERE rn <= 5""",
    "predictions",
)
def top2(spark, sf):
    rows = V.predictions(spark, sf)
    both = overview.top_signals(rows, "buy").unionByName(overview.top_signals(rows, "sell"))
    return both.select("ticker", "signal", "confidence")


@query(
    "top5",
    f"""
    WITH a AS ({AHEAD}), e AS ({MARKET_ENRICHED}),
    j AS (SELECT e.ticker, e.id, e.sentiment_weighted, a.return_3d
          FROM e ASOF LEFT JOIN a ON e.ticker = a.ticker AND CAST(e.created_utc AS DATE) <= a.date)
    SELECT ticker, round(arg_max(return_3d, row(round(sentiment_weighted, 9), id)), 6) AS top_post_return_3d
    FROM j WHERE sentiment_weighted IS NOT NULL AND return_3d IS NOT NULL GROUP BY 1""",
    "prices market_posts",
)
def top5(spark, sf):
    rows = prices.forward_returns(market_enriched(spark, sf), V.prices(spark, sf))
    rows = rows.withColumn("sentiment_weighted", F.round("sentiment_weighted", 9))
    return rounded(overview.top_posts(rows))


@query("set1", "SELECT ticker FROM suppliers UNION SELECT symbol FROM watchlist", "suppliers watchlist")
def set1(spark, sf):
    watched = V.watchlist(spark, sf).select(F.col("symbol").alias("ticker"))
    return V.suppliers(spark, sf).unionByName(watched).distinct()


@query("set3", "SELECT ticker FROM suppliers WHERE ticker NOT IN (SELECT symbol FROM watchlist)", "suppliers watchlist")
def set3(spark, sf):
    watched = V.watchlist(spark, sf).select(F.col("symbol").alias("ticker"))
    return V.suppliers(spark, sf).join(watched, "ticker", "left_anti")
