"""Table schemas, their keys, and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DDL = {
    "prices": (
        "date date, ticker string, open double, high double, low double, "
        "close double, adj_close double, volume bigint"
    ),
    "posts": (
        "id string, created_utc timestamp, title string, text string, "
        "upvotes int, num_comments int"
    ),
    "enriched": (
        "id string, ticker string, created_utc timestamp, text string, upvotes int, "
        "sentiment_dict double, sentiment_weighted double, sentiment_ml double, "
        "return_1d double, return_3d double, return_7d double"
    ),
    "sentiment_hourly": (
        "created_utc timestamp, ticker string, sentiment_dict double, "
        "sentiment_weighted double, posts int"
    ),
    "sentiment_daily": (
        "date date, ticker string, sentiment_dict double, sentiment_weighted double, posts int"
    ),
    "daily_sentiment": (
        "date date, ticker string, n_posts int, sentiment_mean double, "
        "sentiment_weighted double, sentiment_median double, updated_at timestamp"
    ),
    "trends": "date date, ticker string, mentions int, avg_upvotes double, hotness double",
    "predictions": (
        "as_of timestamp, ticker string, horizon_days int, signal string, "
        "confidence double, expected_return double, version string"
    ),
    "fx_rates": "date date, pair string, rate_usd_per_eur double",
    "alerts": "id bigint, ticker string, op string, price double, active boolean",
    "training_state": (
        "ticker string, latest_price_date date, price_row_count bigint, "
        "latest_sentiment_date date, sentiment_row_count bigint, latest_post_utc timestamp, "
        "trained_at timestamp, accuracy double, f1 double, roc_auc double, "
        "precision_score double, recall_score double, avg_strategy_return double, "
        "long_win_rate double"
    ),
    "candidates": (
        "symbol string, mentions_24h int, baseline_rate_per_h double, lift double, "
        "trend double, first_seen timestamp, last_seen timestamp"
    ),
    "candidates_history": (
        "ts timestamp, symbol string, mentions_24h int, baseline_rate_per_h double, "
        "lift double, trend double"
    ),
    "aliases": "ticker string, alias string, source string, added_at timestamp",
    "watchlist": "chat_id string, symbol string, note string",
}

KEYS = {
    "prices": ["date", "ticker"],
    "posts": ["id"],
    "enriched": ["id", "ticker"],
    "sentiment_hourly": ["ticker", "created_utc"],
    "sentiment_daily": ["date", "ticker"],
    "daily_sentiment": ["date", "ticker"],
    "trends": ["date", "ticker"],
    "predictions": ["ticker", "horizon_days", "version"],
    "fx_rates": ["date", "pair"],
    "alerts": ["id"],
    "training_state": ["ticker"],
    "candidates": ["symbol"],
    "aliases": ["ticker", "alias"],
    "watchlist": ["chat_id", "symbol"],
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def assert_columns(df: DataFrame, table: str) -> DataFrame:
    """Raise if ``df`` lacks a column of ``table``; looks at the schema only."""
    missing = [f.name for f in schema_of(table).fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    return df


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project to the columns of ``table``, casting; bad values become NULL."""
    assert_columns(df, table)
    return df.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema_of(table).fields]
    )
