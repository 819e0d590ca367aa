"""Where queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import ctes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY, MOMENT = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _times_as_text(df: DataFrame) -> DataFrame:
    """Days and moments as text, so that both engines show them alike."""
    shown = []
    for name, kind in df.dtypes:
        if kind == "date":
            shown.append(F.date_format(name, DAY).alias(name))
        elif kind.startswith("timestamp"):
            shown.append(F.date_format(name, MOMENT).alias(name))
        else:
            shown.append(F.col(name))
    return df.select(*shown)


def query(
    name: str, sql: str | None = None, views: str = "", dates: str = "", stamps: str = ""
) -> Callable[[Query], Query]:
    """Register a query.

    ``views`` lists the derived tables its SQL starts from, ``dates`` and ``stamps``
    its columns of days and moments.
    """

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _times_as_text(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            body = ctes(views.split(), sql)
            shown = [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates.split()]
            shown += [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in stamps.split()]
            if shown:
                body = f"SELECT * REPLACE ({', '.join(shown)}) FROM (\n{body})"
            ORACLES[name] = body
        return fn

    return register
