"""Readers of price, FX, post, feed, alias, lexicon and label files.

Every reader takes a path (file, folder or glob) and returns rows of a table schema.  What it
does to the rows after reading is a function of its own (``*_rows``), from DataFrame to DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import normal_word
from ..functions.text import normal_form
from ..operators.tables import first_per_key

BARS = ["open", "high", "low", "close"]
BAR_CSV = "Date string, Open string, High string, Low string, Close string, Volume string"
CHART_JSON = (
    "chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<quote: array<struct<"
    "open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>>>>>>"
)
POST_JSON = (
    "id string, title string, created_utc double, selftext string, score int, num_comments int, "
    "comments array<struct<id: string, body: string, created_utc: double, score: int>>"
)


def _file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^([^/]*?)\.[^.]*$", 1)


def _since(df: DataFrame, start: date | None) -> DataFrame:
    return df if start is None else df.where(F.col("date") >= F.lit(start))


def daily_bars_csv(spark: SparkSession, path: str, start: date | None = None) -> DataFrame:
    """Daily bars, one file per ticker; the file name gives the ticker (SRC1)."""
    raw = spark.read.schema(BAR_CSV).option("header", True).csv(path)
    return bar_rows(raw.select("*", _file_stem().alias("file")), start)


def bar_rows(raw: DataFrame, start: date | None = None) -> DataFrame:
    """Text columns ``Date, Open, .., Volume, file`` to price rows; ``file`` is the ticker with its country."""
    ticker = F.upper(F.regexp_replace("file", r"\.[a-z]{2}$", ""))
    return _since(
        raw.select(
            F.col("Date").try_cast("date").alias("date"),
            ticker.alias("ticker"),
            *[F.col(c.title()).try_cast("double").alias(c) for c in BARS],
            F.lit(None).cast("double").alias("adj_close"),
            F.col("Volume").try_cast("double").cast("bigint").alias("volume"),
        ),
        start,
    )


def chart_bars(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``ticker, ts, open..volume`` of chart payloads with parallel arrays (SRC2).

    One JSON document per file, named after the ticker.  Rows without any price are
    dropped.
    """
    raw = spark.read.schema(CHART_JSON).option("multiLine", True).json(path)
    result = F.col("chart.result").getItem(0)
    quote = F.get(result["indicators"]["quote"], F.lit(0))
    columns = [*BARS, "volume"]
    arrays = raw.select(
        F.upper(_file_stem()).alias("ticker"), result["timestamp"].alias("ts"), *[quote[c].alias(c) for c in columns]
    )
    return chart_rows(arrays)


def chart_rows(arrays: DataFrame) -> DataFrame:
    """Parallel arrays ``ts`` (seconds), ``open`` .. ``volume`` of a ticker to rows."""
    rows = arrays.select("ticker", F.inline(F.arrays_zip("ts", *BARS, "volume")))
    return rows.na.drop("all", subset=BARS).withColumn("ts", F.timestamp_seconds("ts"))


def chart_daily(spark: SparkSession, path: str) -> DataFrame:
    """Chart payload rows as price rows (SRC2)."""
    return chart_bars(spark, path).select(
        F.to_date("ts").alias("date"), "ticker", *BARS, F.lit(None).cast("double").alias("adj_close"), "volume"
    )


def normal_history(df: DataFrame, ticker: str | Column) -> DataFrame:
    """History columns in title case to the price schema; missing ones NULL (SRC3)."""
    names = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}
    names |= {next(c for c in ("Date", "Datetime", "index", "date") if c in df.columns): "date"}
    out = df.withColumnsRenamed(names)
    for column in ("adj_close", "volume"):
        if column not in out.columns:
            out = out.withColumn(column, F.lit(None).cast("double"))
    name = F.lit(ticker) if isinstance(ticker, str) else ticker
    return out.withColumn("ticker", name).select(
        F.to_date("date").alias("date"), "ticker", *BARS, "adj_close", F.col("volume").cast("bigint").alias("volume")
    )


def fx_csv(spark: SparkSession, path: str, pair: str = "EURUSD", start: date | None = None) -> DataFrame:
    """FX quotes of one pair; rows without date or rate are dropped (SRC4)."""
    return fx_rows(spark.read.schema(BAR_CSV).option("header", True).csv(path), pair, start)


def fx_rows(raw: DataFrame, pair: str = "EURUSD", start: date | None = None) -> DataFrame:
    """Text columns ``Date, Close`` to rates."""
    rows = raw.select(
        F.col("Date").try_cast("date").alias("date"),
        F.lit(pair).alias("pair"),
        F.col("Close").try_cast("double").alias("rate_usd_per_eur"),
    )
    return _since(rows.na.drop(), start)


def posts_json(
    spark: SparkSession,
    hot: str,
    new: str | None = None,
    comment_limit: int = 0,
) -> DataFrame:
    """Posts of JSON lines; the first non-empty comments of hot posts become rows (SRC5).

    The first source of an id wins: hot posts, their comments, then new posts.
    """
    read = lambda path: spark.read.schema(POST_JSON).json(path)
    return post_rows(read(hot), None if new is None else read(new), comment_limit)


def post_rows(hot_posts: DataFrame, new_posts: DataFrame | None = None, comment_limit: int = 0) -> DataFrame:
    """Posts in the schema of the JSON files to post rows, with the comments of hot ones."""

    def rows_of(df, rank):
        return df.select(
            "id",
            F.timestamp_seconds("created_utc").alias("created_utc"),
            F.coalesce("title", F.lit("")).alias("title"),
            F.coalesce("selftext", F.lit("")).alias("text"),
            F.coalesce("score", F.lit(0)).alias("upvotes"),
            F.coalesce("num_comments", F.lit(0)).alias("num_comments"),
            F.lit(rank).alias("_rank"),
        )

    parts = [rows_of(hot_posts, 0)]
    if comment_limit > 0:
        full = F.filter("comments", lambda c: F.coalesce(c["body"], F.lit("")) != "")
        each = hot_posts.select("id", "created_utc", F.explode(F.slice(full, 1, comment_limit)).alias("c"))
        parts.append(
            each.select(
                F.concat_ws("_", "id", "c.id").alias("id"),
                F.timestamp_seconds(F.coalesce("c.created_utc", "created_utc")).alias("created_utc"),
                F.lit("").alias("title"),
                F.col("c.body").alias("text"),
                F.coalesce("c.score", F.lit(0)).alias("upvotes"),
                F.lit(0).alias("num_comments"),
                F.lit(1).alias("_rank"),
            )
        )
    if new_posts is not None:
        parts.append(rows_of(new_posts, 2))
    every = reduce(DataFrame.unionByName, parts)
    return first_per_key(every, ["id"], F.col("_rank"), F.col("created_utc")).drop("_rank")


def feed_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Items of RSS or Atom files: id, title, created_utc, text (SRC6)."""
    schema = (
        "guid string, id string, link string, title string, description string, summary string, "
        "pubDate string, published string, updated string"
    )
    return feed_rows(spark.read.schema(schema).option("rowTag", row_tag).xml(path))


def feed_rows(raw: DataFrame) -> DataFrame:
    """Text columns of RSS and Atom items to rows."""
    rss = F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return raw.select(
        F.coalesce("guid", "id", "link", "title").alias("id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(rss, F.try_to_timestamp("published"), F.try_to_timestamp("updated")).alias("created_utc"),
        F.coalesce("description", "summary", F.lit("")).alias("text"),
    )


def _json_map(text: DataFrame, kind: str) -> DataFrame:
    return text.select(F.explode(F.from_json("value", kind)).alias("key", "value"))


def aliases_json(spark: SparkSession, path: str, source: str = "seed") -> DataFrame:
    """``{symbol: [alias, ..]}`` to alias rows; blanks are skipped (SRC7)."""
    return alias_rows(spark.read.option("wholetext", True).text(path), source)


def alias_rows(text: DataFrame, source: str = "seed") -> DataFrame:
    """Alias rows of JSON objects, one in each ``value``."""
    rows = _json_map(text, "map<string, array<string>>")
    named = rows.select(F.upper("key").alias("ticker"), F.explode("value").alias("alias"))
    return named.select("ticker", F.trim("alias").alias("alias"), F.lit(source).alias("source")).where("alias != ''")


def lexicon_json(spark: SparkSession, path: str, base: dict[str, int] | None = None) -> dict[str, int]:
    """``{word: score}`` added to ``base``; the first definition wins (SRC8).

    A lexicon is configuration: it is read once and travels in the plan.
    """
    merged = dict(base or {})
    text = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    # Files in the order of their names; words in the order in which they stand.
    rows = text.select("file", F.posexplode(F.map_entries(F.from_json("value", "map<string, int>"))).alias("at", "entry"))
    for row in rows.orderBy("file", "at").toLocalIterator():
        merged.setdefault(normal_word(row["entry"]["key"].lower(), merged.keys()), row["entry"]["value"])
    return merged


def lexicon_rows(text: DataFrame, base: dict[str, int] | None = None, markers: Iterable[str] = ()) -> DataFrame:
    """``word, score`` of JSON objects ``{word: score}`` (``file, value``) added to ``base`` (SRC8).

    Words are brought to their normal form, but for those of ``base`` and ``markers``.  The first
    definition wins: ``base``, then files by name, then words as they stand.  Null scores are skipped.
    For lexicons too large to travel in the plan; their rows join tokens as any table does.
    """
    base = base or {}
    rows = text.select("file", F.posexplode(F.map_entries(F.from_json("value", "map<string, int>"))).alias("at", "entry"))
    word = normal_form(F.lower("entry.key"), {*base, *markers})
    rows = rows.select(word.alias("word"), F.col("entry.value").alias("score"), F.struct("file", "at").alias("place"))
    added = rows.where(F.col("score").isNotNull() & ~F.col("word").isin(*base)).groupBy("word").agg(F.min_by("score", "place").alias("score"))
    return added.unionByName(text.sparkSession.createDataFrame(list(base.items()), "word string, score int"))


def marker_rows(text: DataFrame, intensities: dict[str, float] | None = None, markers: Iterable[str] = ()) -> DataFrame:
    """``kind, word, weight`` of marker files ``{"intensities": {word: weight}, "markers": [word]}`` (SRC9).

    ``text`` has ``file, value``.  Intensities override the given ones, the last file by name wins, and
    a word that one file repeats takes its last weight; markers extend the given ones and have no weight.
    """
    spark = text.sparkSession
    parsed = text.select("file", F.from_json("value", "intensities map<string, double>, markers array<string>").alias("c"))
    given = spark.createDataFrame(list((intensities or {}).items()), "word string, weight double")
    given = given.select("word", "weight", F.struct(F.lit(None).cast("string").alias("file"), F.lit(-1).alias("at")).alias("place"))
    own = parsed.select("file", F.posexplode(F.map_entries("c.intensities")).alias("at", "entry"))
    own = own.select(F.lower("entry.key").alias("word"), F.col("entry.value").alias("weight"), F.struct("file", "at").alias("place"))
    weights = own.where("weight is not null").unionByName(given).groupBy("word").agg(F.max_by("weight", "place").alias("weight"))
    named = parsed.select(F.explode("c.markers").alias("word")).where("word is not null")
    named = named.unionByName(spark.createDataFrame([(m,) for m in markers], "word string")).select(F.lower("word").alias("word")).distinct()
    return weights.select(F.lit("intensity").alias("kind"), "word", "weight").unionByName(
        named.select(F.lit("marker").alias("kind"), "word", F.lit(None).cast("double").alias("weight"))
    )


def labelled_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows labelled positive or negative of CSV files (SRC10)."""
    raw = spark.read.schema("text string, label string").option("header", True).option("multiLine", True).csv(list(paths))
    return labelled_rows(raw)


def labelled_rows(raw: DataFrame) -> DataFrame:
    """Rows with one of the two labels."""
    return raw.where(F.col("label").isin("positive", "negative"))


def security_master(spark: SparkSession, path: str) -> DataFrame:
    """Symbol and name of a CSV whose columns go by one of several titles (SRC11)."""
    return master_rows(spark.read.option("header", True).csv(path))


def master_rows(raw: DataFrame) -> DataFrame:
    """Symbol and name out of columns that go by one of several titles."""

    def pick(*titles):
        found = next((c for c in raw.columns if c.lower() in titles), None)
        if found is None:
            raise ValueError(f"no column titled {' or '.join(titles)}")
        return F.col(f"`{found}`")

    return raw.select(
        F.upper(F.trim(pick("symbol", "ticker"))).alias("symbol"), pick("description", "name", "company").alias("name")
    )


def stored_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts as stored; sort where an order is needed (SRC12)."""
    return stored_rows(spark.read.parquet(path))


def stored_rows(rows: DataFrame) -> DataFrame:
    """The post columns of a stored table."""
    return rows.select("id", "created_utc", "title", "text", "upvotes", "num_comments")
