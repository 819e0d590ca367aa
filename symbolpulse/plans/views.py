"""Market tables derived from the given tables, in Spark and in SQL.

The given tables hold no prices or posts, so both sides derive them by the same
rules: suppliers are symbols, line items are trades and posts about them, events
are posts and ticks of five busy symbols, documents are post texts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_AS_OF = datetime(2024, 1, 30, 12)
DOCS_AS_OF = datetime(2024, 1, 8)
MARKET_AS_OF = datetime(2001, 6, 15, 12)

# Aliases of made-up symbols: words and word pairs of the corpus.
ALIASES = [
    ("THI", "thing"), ("ATT", "attion"), ("ERI", "ering"), ("ONI", "oning"), ("THB", "thble"),
    ("OFT", "of the"), ("AND.X", "and"), ("NICHT", "nicht"), ("DIE", "die"), ("DEL", "del"),
    ("QUE.A", "que"), ("TRE", "tre."), ("COM", "to the"), ("WAS", "Was"),
]
# Companies behind symbols that texts mention; names make aliases.
MASTER = [
    ("CI", "Thing Group Inc."), ("LA", "Attion & Co"), ("ES", "Es Holding AG"), ("EL", "El Corp"),
    ("LE", "Le Group"), ("UN", "Un Ltd"), ("TH", "Th Holdings plc"), ("ON", "Oning SE"), ("ER", "Er SA"),
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def _trades(spark: SparkSession, sf_dir: str, dealt: bool) -> DataFrame:
    """Line items with ``date`` and ``ticker``, as they lie or ``dealt`` by both.

    Few trades of a ticker and day meet in one task of the scan, and the state of an aggregate is twice as wide as a
    trade: where bars meet other rows of the same day, dealing the trades writes less, and the bars are joined where they lie.
    """
    rows = load(spark, sf_dir, "lineitem").withColumns(
        {"date": F.to_date("l_shipdate"), "ticker": F.concat(F.lit("S"), F.col("l_suppkey"))}
    )
    return rows.repartition("ticker", "date") if dealt else rows


def prices(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Daily bars per supplier; the day's trades in a total order."""
    item = _trades(spark, sf_dir, dealt)
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return (
        item.groupBy("ticker", "date")
        .agg(
            F.min_by("l_extendedprice", at).alias("open"),
            F.max("l_extendedprice").alias("high"),
            F.min("l_extendedprice").alias("low"),
            F.max_by("l_extendedprice", at).alias("close"),
            F.max_by(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4), at).alias("adj_close"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("volume"),
        )
        .select("date", "ticker", "open", "high", "low", "close", "adj_close", "volume")
    )


def market_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts about suppliers, some days before the trade."""
    item = load(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    return item.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"),
        F.expr(
            "cast(l_shipdate as timestamp) - make_dt_interval(l_linenumber)"
            " + make_dt_interval(0, cast(l_partkey % 24 as int))"
        ).alias("created_utc"),
        (F.col("l_quantity").cast("int") * (part % 30).cast("int")).alias("upvotes"),
        F.col("l_linenumber").alias("num_comments"),
        F.when(part % 11 != 0, F.round((F.col("l_discount") - 0.05) * 20, 2)).alias("sentiment"),
    )


def market_daily(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Mean sentiment per supplier and day of the trade."""
    item = _trades(spark, sf_dir, dealt)
    days = item.groupBy("ticker", "date").agg(
        F.round(F.avg((F.col("l_discount") - 0.05) * 20), 6).alias("sentiment"),
        F.count(F.lit(1)).alias("posts"),
    )
    return days.select("date", "ticker", "sentiment", "posts")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts_of(load(spark, sf_dir, "events"))


def posts_of(events: DataFrame) -> DataFrame:
    """Posts about the five event types, from a table or a stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    event = F.col("event_id")
    comment = F.when(F.col("event_type") == "view", F.concat(F.lit("e"), event, F.lit("_c"), k))
    return events.select(
        F.coalesce(comment, F.concat(F.lit("e"), event)).alias("id"),
        F.upper("event_type").alias("ticker"),
        F.col("ts").cast("timestamp").alias("created_utc"),
        F.floor("value").cast("int").alias("upvotes"),
        k.alias("num_comments"),
        F.when(k != 7, (k - 50) / 50.0).alias("sentiment"),
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched_of(posts(spark, sf_dir))


def enriched_of(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("sentiment", "sentiment_dict").withColumn(
        "sentiment_weighted", F.col("sentiment_dict") * (1 + F.log10(1 + F.col("upvotes")))
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_of(load(spark, sf_dir, "events"))


def ticks_of(events: DataFrame) -> DataFrame:
    price = F.col("value")
    return events.select(
        F.upper("event_type").alias("ticker"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        price.alias("open"),
        (price + 1).alias("high"),
        (price - 1).alias("low"),
        (price + 0.5).alias("close"),
        F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("volume"),
    )


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rate per month."""
    return (
        load(spark, sf_dir, "orders")
        .groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"))
        .agg(F.round(F.avg("o_totalprice") / 150000, 4).alias("rate_usd_per_eur"))
        .select("date", F.lit("EURUSD").alias("pair"), "rate_usd_per_eur")
    )


def text_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts spread over one week."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"),
        F.expr(
            "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id * 7919 % 10080 as int))"
        ).alias("created_utc"),
        F.col("source").alias("title"),
        "text",
        (F.col("doc_id") % 50).cast("int").alias("upvotes"),
        (F.col("doc_id") % 9).cast("int").alias("num_comments"),
        "lang",
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a deterministic, informative probability."""
    noise = (F.col("doc_id") * 7919 % 1000) / 1000.0
    return load(spark, sf_dir, "labels").select(
        "doc_id",
        F.concat(F.lit("G"), F.col("toxic")).alias("ticker"),
        F.col("quality").alias("y"),
        F.round(0.3 * F.col("quality") + 0.6 * noise, 3).alias("p"),
        F.round(noise - 0.45, 3).alias("actual_return"),
    )


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "ticker string, alias string")


def master(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MASTER, "symbol string, name string")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as companies with the usual suffixes."""
    size = F.col("p_size")
    suffix = (
        F.when(size < 10, " Inc.")
        .when(size < 20, " Holding  AG")
        .when(size < 30, " & Co")
        .when(size < 40, " Group Ltd.")
        .otherwise("")
    )
    return load(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey"), F.lit(".de")).alias("symbol"),
        F.concat(F.initcap("p_name"), F.lit(" "), F.col("p_brand"), suffix).alias("name"),
        "p_size",
        "p_type",
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers watch suppliers; the newest customer of a pair gives the note."""
    return load(spark, sf_dir, "customer").groupBy(
        F.col("c_mktsegment").alias("chat_id"),
        F.concat(F.lit("S"), F.col("c_nationkey")).alias("symbol"),
    ).agg(F.max_by("c_name", "c_custkey").alias("note"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price rule per part, on a supplier."""
    size = F.col("p_size")
    op = F.when(size < 12, "<").when(size < 25, ">").when(size < 38, "<=").otherwise(">=")
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("S"), F.col("p_partkey") % 400).alias("ticker"),
        op.alias("op"),
        (F.col("p_retailprice") * 30).alias("price"),
        (F.col("p_type") != "ECONOMY").alias("active"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per part, for a supplier."""
    size, key = F.col("p_size"), F.col("p_partkey")
    signal = F.when(size < 20, "buy").when(size < 35, "sell").otherwise("hold")
    return load(spark, sf_dir, "part").select(
        F.expr("timestamp'2001-06-01 00:00:00' + make_dt_interval(p_size % 14, 0, cast(p_partkey % 1440 as int), cast(p_partkey % 50 as int))").alias("as_of"),
        F.concat(F.lit("S"), key % 150).alias("ticker"),
        F.when(size % 5 == 0, 3).otherwise(1).alias("horizon_days"),
        signal.alias("signal"),
        F.when(size % 7 != 0, (key * 37 % 1000) / 1000.0).alias("confidence"),
        ((key * 13 % 200) / 1000.0 - 0.1).alias("expected_return"),
        F.concat(F.lit("ml-v2:"), F.lower("p_type")).alias("version"),
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol list."""
    return load(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"))


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)



SQL = {
    "prices": """
        SELECT CAST(l_shipdate AS DATE) AS date, 'S' || l_suppkey AS ticker,
               arg_min(l_extendedprice, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
               max(l_extendedprice) AS high, min(l_extendedprice) AS low,
               arg_max(l_extendedprice, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
               arg_max(round(l_extendedprice * (1 - l_discount), 4),
                       row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS adj_close,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
        FROM lineitem GROUP BY 1, 2""",
    "market_posts": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
               'S' || l_suppkey AS ticker,
               l_shipdate - to_days(l_linenumber) + to_hours(CAST(l_partkey % 24 AS INTEGER)) AS created_utc,
               CAST(l_quantity AS INTEGER) * CAST(l_partkey % 30 AS INTEGER) AS upvotes,
               l_linenumber AS num_comments,
               CASE WHEN l_partkey % 11 <> 0 THEN round((l_discount - 0.05) * 20, 2) END AS sentiment
        FROM lineitem""",
    "market_daily": """
        SELECT CAST(l_shipdate AS DATE) AS date, 'S' || l_suppkey AS ticker,
               round(avg((l_discount - 0.05) * 20), 6) AS sentiment, count(*) AS posts
        FROM lineitem GROUP BY 1, 2""",
    "posts": """
        SELECT CASE WHEN event_type = 'view' THEN 'e' || event_id || '_c' || k ELSE 'e' || event_id END AS id,
               upper(event_type) AS ticker, ts AS created_utc, CAST(floor(value) AS INTEGER) AS upvotes,
               k AS num_comments, CASE WHEN k <> 7 THEN (k - 50) / CAST(50 AS DOUBLE) END AS sentiment
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "enriched": """
        SELECT id, ticker, created_utc, upvotes, num_comments, sentiment AS sentiment_dict,
               sentiment * (1 + log10(1 + upvotes)) AS sentiment_weighted
        FROM posts""",
    "ticks": """
        SELECT upper(event_type) AS ticker, ts, event_id, value AS open, value + 1 AS high,
               value - 1 AS low, value + 0.5 AS close,
               CASE WHEN user_id % 5 <> 0 THEN user_id END AS volume
        FROM events""",
    "fx": """
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, 'EURUSD' AS pair,
               round(avg(o_totalprice) / 150000, 4) AS rate_usd_per_eur
        FROM orders GROUP BY 1""",
    "text_posts": """
        SELECT CAST(doc_id AS VARCHAR) AS id,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 7919 % 10080) AS created_utc,
               source AS title, text, CAST(doc_id % 50 AS INTEGER) AS upvotes,
               CAST(doc_id % 9 AS INTEGER) AS num_comments, lang
        FROM documents""",
    "scores": """
        SELECT doc_id, 'G' || toxic AS ticker, quality AS y,
               round(0.3 * quality + 0.6 * ((doc_id * 7919 % 1000) / CAST(1000 AS DOUBLE)), 3) AS p,
               round((doc_id * 7919 % 1000) / CAST(1000 AS DOUBLE) - 0.45, 3) AS actual_return
        FROM labels""",
    "aliases": f"SELECT * FROM (VALUES {_values(ALIASES)}) AS v(ticker, alias)",
    "master": f"SELECT * FROM (VALUES {_values(MASTER)}) AS v(symbol, name)",
    "companies": """
        SELECT 'p' || p_partkey || '.de' AS symbol,
               array_to_string(list_transform(string_split(p_name, ' '),
                   lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || p_brand ||
               CASE WHEN p_size < 10 THEN ' Inc.' WHEN p_size < 20 THEN ' Holding  AG'
                    WHEN p_size < 30 THEN ' & Co' WHEN p_size < 40 THEN ' Group Ltd.' ELSE '' END AS name,
               p_size, p_type
        FROM part""",
    "watchlist": """
        SELECT c_mktsegment AS chat_id, 'S' || c_nationkey AS symbol, arg_max(c_name, c_custkey) AS note
        FROM customer GROUP BY 1, 2""",
    "alerts": """
        SELECT p_partkey AS id, 'S' || (p_partkey % 400) AS ticker,
               CASE WHEN p_size < 12 THEN '<' WHEN p_size < 25 THEN '>'
                    WHEN p_size < 38 THEN '<=' ELSE '>=' END AS op,
               p_retailprice * 30 AS price, p_type <> 'ECONOMY' AS active
        FROM part""",
    "predictions": """
        SELECT TIMESTAMP '2001-06-01 00:00:00' + to_days(p_size % 14) + to_minutes(p_partkey % 1440)
                 + to_seconds(p_partkey % 50) AS as_of,
               'S' || (p_partkey % 150) AS ticker,
               CASE WHEN p_size % 5 = 0 THEN 3 ELSE 1 END AS horizon_days,
               CASE WHEN p_size < 20 THEN 'buy' WHEN p_size < 35 THEN 'sell' ELSE 'hold' END AS signal,
               CASE WHEN p_size % 7 <> 0 THEN (p_partkey * 37 % 1000) / CAST(1000 AS DOUBLE) END AS confidence,
               (p_partkey * 13 % 200) / CAST(1000 AS DOUBLE) - 0.1 AS expected_return,
               'ml-v2:' || lower(p_type) AS version
        FROM part""",
    "suppliers": "SELECT 'S' || s_suppkey AS ticker FROM supplier",
}
NEEDS = {"enriched": ["posts"]}


def ctes(names: list[str], body: str) -> str:
    """``body`` behind a WITH clause of the named views and those they need."""
    ordered: list[str] = []
    for name in names:
        for part in [*NEEDS.get(name, []), name]:
            if part not in ordered:
                ordered.append(part)
    if not ordered:
        return body
    head = ",\n".join(f"{name} AS ({SQL[name]})" for name in ordered)
    rest = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if rest.startswith(start):
            return f"{start}{head},\n{rest[len(start):]}"
    return f"WITH {head}\n{rest}"
