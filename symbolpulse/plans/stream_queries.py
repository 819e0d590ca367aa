"""Streams over the event files, run to their end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables, trends
from ..operators.storage import new_folder
from ..streaming import streams
from ..streaming.windows import Windows, into_windows, read_windows
from . import views as V
from .post_queries import HOURLY, ROUND_MOOD
from .registry import ORACLES, query
from .rounding import rounded


#: Options of the stream's reader; tests set how many files make a batch.
READ_OPTIONS: dict[str, str] = {}
#: Batches that become one segment.
FOLD = 16


def _events(spark, sf):
    """The event table, one file or a folder of them, as a stream.

    The path is written as a pattern: a stream takes any other path for a folder.
    """
    schema = V.load(spark, sf, "events").schema
    return spark.readStream.schema(schema).options(**READ_OPTIONS).parquet(f"{sf}/events.parque[t]")


def _folders(spark):
    base = new_folder(spark, "stream")
    return f"{base}/table", f"{base}/progress"


def _table(spark, stream, windows: Windows):
    """Run a stream into windows and read them."""
    path, progress = _folders(spark)
    streams.run_available(stream, into_windows(path, windows, fold=FOLD), progress, "append")
    return read_windows(spark, path, windows)


@query("str1", "SELECT id, ticker FROM posts", "posts")
def str1(spark, sf):
    path, progress = _folders(spark)
    # Every post comes twice.
    rows = V.posts_of(_events(spark, sf))
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    streams.run_available(twice, streams.distinct_sink(path), progress, "append")
    return spark.read.parquet(path).select("id", "ticker")


@query("str2", f"SELECT created_utc AS start, ticker, {ROUND_MOOD} FROM ({HOURLY.format(extra='')})", "enriched", stamps="start")
def str2(spark, sf):
    rows = V.enriched_of(V.posts_of(_events(spark, sf)))
    return rounded(_table(spark, rows, streams.sentiment_windows()))


@query(
    "str3",
    """
    SELECT ticker AS symbol, CAST(count(*) FILTER (created_utc >= TIMESTAMP '2024-01-29 12:00:00') AS DOUBLE) AS recent,
           CAST(count(*) FILTER (created_utc >= TIMESTAMP '2024-01-23 12:00:00'
                             AND created_utc < TIMESTAMP '2024-01-29 12:00:00') AS DOUBLE) AS base
    FROM posts WHERE created_utc < TIMESTAMP '2024-01-30 13:00:00' GROUP BY 1""",
    "posts",
)
def str3(spark, sf):
    rows = V.posts_of(_events(spark, sf)).withColumn("weight", F.lit(1.0))
    hours = streams.hourly_mentions(_table(spark, rows, streams.mention_windows()))
    return trends.mention_counts(hours, V.EVENTS_AS_OF, [(7, 24)]).select("symbol", "recent", "base")


@query(
    "str4",
    """
    WITH r AS (SELECT p_partkey AS id, upper(['view', 'click', 'error', 'signup', 'purchase'][1 + p_partkey % 5]) AS ticker,
                      CASE WHEN p_size < 25 THEN '<' ELSE '>=' END AS op, p_size * 1.0::DOUBLE AS price FROM part),
    l AS (SELECT upper(event_type) AS ticker, min(value) AS low, max(value) AS high FROM events GROUP BY 1)
    SELECT id, CASE WHEN op = '<' THEN low >= price ELSE high < price END AS active FROM r JOIN l USING (ticker)""",
)
def str4(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("VIEW", "CLICK", "ERROR", "SIGNUP", "PURCHASE")])
    rules = V.load(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        kinds[F.col("p_partkey") % 5].alias("ticker"),
        F.when(F.col("p_size") < 25, "<").otherwise(">=").alias("op"),
        F.col("p_size").cast("double").alias("price"),
        F.lit(True).alias("active"),
    )
    path, progress = _folders(spark)
    ticks = V.ticks_of(_events(spark, sf)).select("ticker", "ts", F.col("open").alias("price"))
    streams.run_available(ticks, streams.alert_sink(rules, path), progress, "append")
    return streams.remaining_rules(rules, spark.read.parquet(path)).select("id", "active")


@query(
    "str5",
    ORACLES["agg14"].replace("CAST(ts AS DATE) AS date", "CAST(ts AS DATE) AS start").replace("(date, '%Y-%m-%d') AS date", "(start, '%Y-%m-%d') AS start"),
)
def str5(spark, sf):
    bars = _table(spark, V.ticks_of(_events(spark, sf)), streams.bar_windows(F.col("event_id")))
    return rounded(bars.withColumn("start", F.to_date("start")))


@query(
    "str6",
    """
    SELECT date_trunc('hour', created_utc) AS start, ticker, count(*) AS mentions FROM posts
    WHERE created_utc >= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1, 2""",
    "posts",
    stamps="start",
)
def str6(spark, sf):
    rows = V.posts_of(_events(spark, sf)).withColumn("weight", F.lit(1.0))
    hours = _table(spark, rows, streams.mention_windows())
    return tables.purge(hours, "start", V.EVENTS_AS_OF, 10).select("start", "ticker", "mentions")
