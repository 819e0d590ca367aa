"""Deduplication, tumbling rollups, bars and alerts over streams.

Rollups are partial rows that the sink merges (see ``windows``), so rows count however late they come.
Results do not depend on how a stream is cut or ordered, and a repeated micro-batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import price_test, vote_weight
from .windows import Windows

Batch = Callable[[DataFrame, int], None]


def distinct_sink(path: str, delay_days: int = 7) -> Batch:
    """Sink that keeps each post id once among posts at most ``delay_days`` apart (STR1).

    A batch is compared with the kept posts of its own days and the days around them, folders of
    other days are not read.  Of equal ids in a batch the first by time stays.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy("id").agg(F.min_by(F.struct(*batch.columns), "created_utc").alias("row")).select("row.*")
        fresh = fresh.withColumn("day", F.to_date("created_utc"))
        low, high = fresh.agg(F.min("day"), F.max("day")).first()
        try:
            kept = spark.read.parquet(path).where(F.col("batch") < number)
            near = kept.where(F.col("day").between(F.date_sub(F.lit(low), delay_days), F.date_add(F.lit(high), delay_days)))
            near = near.select("id", F.col("day").alias("kept_day"))
            close = (fresh["id"] == near["id"]) & (F.abs(F.date_diff(fresh["day"], near["kept_day"])) <= delay_days)
            fresh = fresh.join(near, close, "left_anti")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day").parquet(f"{path}/batch={number}")

    return write


def sentiment_windows(length: str = "1 hour") -> Windows:
    """Sentiment per window and symbol (STR2)."""
    sums = ["sum_dict", "n_dict", "sum_weighted", "weight", "posts"]
    return Windows(
        at="created_utc",
        length=length,
        keep=F.col("sentiment_weighted").isNotNull(),
        partial={
            "sum_dict": F.sum("sentiment_dict"),
            "n_dict": F.count("sentiment_dict"),
            "sum_weighted": F.sum("sentiment_weighted"),
            "weight": F.sum(vote_weight("upvotes")),
            "posts": F.count(F.lit(1)),
        },
        merge={c: F.sum(c) for c in sums},
        result={
            "sentiment_dict": F.try_divide("sum_dict", "n_dict"),
            "sentiment_weighted": F.try_divide("sum_weighted", "weight"),
            "posts": F.col("posts"),
        },
    )


def mention_windows() -> Windows:
    """Mentions per hour and symbol; trend scans sum these hours (STR3)."""
    return Windows(
        at="created_utc",
        length="1 hour",
        partial={"mentions": F.count(F.lit(1)), "weight": F.sum("weight")},
        merge={c: F.sum(c) for c in ("mentions", "weight")},
        result={c: F.col(c) for c in ("mentions", "weight")},
    )


def hourly_mentions(hours: DataFrame) -> DataFrame:
    """Hour rows in the form ``trends.mention_counts`` takes: a row weighs its mentions."""
    return hours.select(
        F.col("ticker").alias("symbol"),
        F.col("start").alias("created_utc"),
        F.col("mentions").cast("double").alias("weight"),
        F.lit(None).cast("timestamp").alias("tagged_at"),
    )


def bar_windows(*order: Column) -> Windows:
    """Daily bars that refresh while their day goes on (STR5); ``order`` breaks ties of time."""
    at = F.struct(F.col("ts"), *order)

    def end(value: str) -> Column:
        return F.struct(at.alias("at"), F.col(value).alias("value"))

    return Windows(
        at="ts",
        length="1 day",
        keep=F.coalesce("open", "high", "low", "close").isNotNull(),
        partial={
            "first": F.min_by(end("open"), at),
            "high": F.max("high"),
            "low": F.min("low"),
            "last": F.max_by(end("close"), at),
            "volume": F.sum(F.coalesce("volume", F.lit(0))).cast("bigint"),
        },
        merge={
            "first": F.min_by("first", "first.at"),
            "high": F.max("high"),
            "low": F.min("low"),
            "last": F.max_by("last", "last.at"),
            "volume": F.sum("volume"),
        },
        result={
            "open": F.col("first.value"),
            "high": F.col("high"),
            "low": F.col("low"),
            "close": F.col("last.value"),
            "volume": F.col("volume"),
        },
    )


def alert_sink(rules: DataFrame, fired_path: str) -> Batch:
    """Sink that lets each rule fire once, at any price that meets it (STR4).

    A rule looks at the lowest and highest price of its ticker in a micro-batch, so how the
    stream is cut does not matter.  ``fired_path`` holds the rules fired so far: one folder for
    the first micro-batch and for each one that fired a rule, so there are no more folders
    than rules.  A rule found there is not active any more; a repeated batch replaces its folder.
    """

    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        active = rules.where("active")
        try:
            fired = spark.read.parquet(fired_path).where(F.col("batch") < number)
            active = active.join(fired.select("id"), "id", "left_anti")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        prices = batch.groupBy("ticker").agg(F.min("price").alias("low"), F.max("price").alias("high"))
        reached = F.when(F.col("op").isin("<", "<="), F.col("low")).otherwise(F.col("high"))
        hits = active.join(prices, "ticker").withColumn("last_price", reached).where(price_test("op", "last_price", "price"))
        hits = hits.drop("low", "high")
        if number == 0 or not hits.isEmpty():
            hits.write.mode("overwrite").parquet(f"{fired_path}/batch={number}")

    return judge


def remaining_rules(rules: DataFrame, fired: DataFrame) -> DataFrame:
    """Rules with the fired ones switched off (STR4)."""
    hit = fired.select("id").distinct().withColumn("_hit", F.lit(True))
    return rules.join(hit, "id", "left").withColumn(
        "active", F.col("active") & F.col("_hit").isNull()
    ).select(*rules.columns)


def run_available(stream: DataFrame, sink: Batch, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; runs jobs."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
