"""Watchlists, alert rules and alias lists as change batches on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_col
from ..functions.scores import price_test
from .tables import delete_keys, first_per_key, insert_absent, number_rows, upsert

ALERT_OPS = ("<", ">", "<=", ">=")


def _symbol(column: Column | str) -> Column:
    return F.upper(F.trim(as_col(column)))


def add_to_watchlist(watchlist: DataFrame, adds: DataFrame) -> DataFrame:
    """Watchlist with added symbols; a known symbol gets the new note (WCH1).

    ``adds``: chat_id, symbol, note, seq; the highest ``seq`` per symbol counts.
    """
    clean = adds.select("chat_id", _symbol("symbol").alias("symbol"), "note", "seq").where(
        F.coalesce("symbol", F.lit("")) != ""
    )
    latest = first_per_key(clean, ["chat_id", "symbol"], F.col("seq").desc(), F.col("note")).drop("seq")
    return upsert(watchlist, latest, ["chat_id", "symbol"])


def remove_from_watchlist(watchlist: DataFrame, removes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining watchlist and the number of rows removed (WCH1, DEL2)."""
    doomed = removes.select("chat_id", _symbol("symbol").alias("symbol")).distinct()
    return delete_keys(watchlist, doomed, ["chat_id", "symbol"])


def watched_symbols(watchlist: DataFrame, scope: str | None = None) -> DataFrame:
    """Symbols and notes of a scope, or the distinct symbols of all (WCH1, DST1)."""
    if scope is None:
        return watchlist.select("symbol").distinct()
    return watchlist.where(F.col("chat_id") == scope).select("symbol", "note")


def check_op(op: str) -> str:
    if op not in ALERT_OPS:
        raise ValueError(f"unknown operator {op!r}")
    return op


def put_alerts(alerts: DataFrame, adds: DataFrame) -> DataFrame:
    """Alert table with added rules: one per ticker, kept id or the next free one (ALR1).

    ``adds``: ticker, op, price and a unique bigint ``seq`` that gives their order.
    Rules with an unknown operator are dropped; see :func:`rejected_alerts`.
    """
    valid = adds.where(F.col("op").isin(*ALERT_OPS)).withColumn("ticker", F.upper("ticker"))
    latest = first_per_key(valid, ["ticker"], F.col("seq").desc())
    arrival = valid.groupBy("ticker").agg(F.min("seq").alias("_first"))
    batch = latest.join(arrival, "ticker")
    ids = alerts.groupBy("ticker").agg(F.min("id").alias("id"))
    columns = ["id", "ticker", "op", "price", "active"]
    on = F.lit(True).alias("active")
    changed = batch.join(ids, "ticker").select("id", "ticker", "op", F.col("price").cast("double").alias("price"), on)
    top = alerts.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()
    fresh = number_rows(batch.join(ids, "ticker", "left_anti"), "_first", top, "id").select(
        "id", "ticker", "op", F.col("price").cast("double").alias("price"), on
    )
    return upsert(alerts.select(*columns), changed, ["id"]).unionByName(fresh)


def rejected_alerts(adds: DataFrame) -> DataFrame:
    """Added rules with an unknown operator."""
    return adds.where(~F.col("op").isin(*ALERT_OPS))


def switch_alerts(alerts: DataFrame, ids: DataFrame, active: bool) -> DataFrame:
    """Alert table with the given ids switched on or off (ALR1)."""
    flagged = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return alerts.join(flagged, "id", "left").withColumn(
        "active", F.when(F.col("_hit"), F.lit(active)).otherwise(F.col("active"))
    ).select(*alerts.columns)


def active_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where("active")


def judge_alerts(alerts: DataFrame, latest: DataFrame) -> DataFrame:
    """Active alerts with price and ``triggered``; no price means not triggered (ALR2, JON11).

    ``latest``: ticker, price.  Keep the rows that are not triggered as the new
    active set.
    """
    priced = alerts.where("active").join(
        latest.select("ticker", F.col("price").alias("last_price")), "ticker", "left"
    )
    hit = price_test("op", "last_price", "price")
    return priced.withColumn("triggered", F.coalesce(hit, F.lit(False)))


def judge_thresholds(alerts: DataFrame, latest: DataFrame) -> DataFrame:
    """The same for rules with ``threshold`` and ``direction`` above or below (JON11)."""
    rules = alerts.withColumns(
        {
            "op": F.when(F.col("direction") == "above", ">=").otherwise("<="),
            "price": F.col("threshold"),
            "active": F.lit(True),
        }
    )
    return judge_alerts(rules, latest).select(*alerts.columns, "last_price", "triggered")


def add_aliases(aliases: DataFrame, adds: DataFrame) -> DataFrame:
    """Alias table with new pairs; known pairs keep their source (ALS1).

    ``adds``: ticker, alias, source.
    """
    clean = adds.select(
        _symbol("ticker").alias("ticker"), F.trim("alias").alias("alias"), "source"
    ).where("ticker != '' AND alias != ''")
    own = aliases.select("ticker", "alias", "source")
    return own.unionByName(insert_absent(own, clean, ["ticker", "alias"], F.col("source")))


def remove_aliases(aliases: DataFrame, removes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining aliases and the number of rows removed (ALS1)."""
    doomed = removes.select(_symbol("ticker").alias("ticker"), F.trim("alias").alias("alias")).distinct()
    return delete_keys(aliases, doomed, ["ticker", "alias"])


def alias_lists(aliases: DataFrame) -> DataFrame:
    """Sorted aliases per ticker (ALS1)."""
    return aliases.groupBy("ticker").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
