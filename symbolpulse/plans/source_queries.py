"""What the readers do to rows, on rows of the given tables in the shape of their files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators.storage import new_folder
from ..operators.tables import first_per_key
from ..sources import readers, writers
from . import views as V
from .registry import query

_DAY = "strftime(l_shipdate, '%Y-%m-%d')"


def _bar_texts(spark, sf):
    """Line items as text columns of a bar file; some values cannot be read."""
    text = lambda c: F.col(c).cast("string")
    return V.load(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("Date"),
        text("l_partkey").alias("Open"),
        F.when(F.col("l_linenumber") < 3, F.col("l_returnflag")).otherwise(text("l_suppkey")).alias("High"),
        F.lit("").alias("Low"),
        text("l_quantity").alias("Close"),
        text("l_orderkey").alias("Volume"),
        F.concat(F.lit("s"), "l_suppkey", F.when(F.col("l_suppkey") % 2 == 0, ".us").otherwise("")).alias("file"),
    )


_BARS = f"""
    SELECT TRY_CAST(CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE {_DAY} END AS DATE) AS date, 'S' || l_suppkey AS ticker,
           CAST(l_partkey AS DOUBLE) AS open, CASE WHEN l_linenumber >= 3 THEN CAST(l_suppkey AS DOUBLE) END AS high,
           CAST(NULL AS DOUBLE) AS low, CAST(l_quantity AS DOUBLE) AS close, CAST(NULL AS DOUBLE) AS adj_close, CAST(l_orderkey AS BIGINT) AS volume
    FROM lineitem"""


@query("src1", _BARS, dates="date")
def src1(spark, sf):
    return readers.bar_rows(_bar_texts(spark, sf))


@query(
    "src2",
    """
    SELECT upper(event_type) AS ticker, date_trunc('second', ts) AS ts, value AS open,
           CASE WHEN user_id % 3 > 0 THEN value + 1 END AS high, value - 1 AS low, value AS close, CAST(user_id AS BIGINT) AS volume
    FROM events WHERE user_id % 7 <> 0""",
    stamps="ts",
)
def src2(spark, sf):
    dropped = F.col("user_id") % 7 == 0
    price = lambda c: F.when(~dropped, c)
    item = F.struct(
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("ts"),
        price(F.col("value")).alias("open"),
        price(F.when(F.col("user_id") % 3 > 0, F.col("value") + 1)).alias("high"),
        price(F.col("value") - 1).alias("low"),
        price(F.col("value")).alias("close"),
        F.col("user_id").cast("bigint").alias("volume"),
    )
    # Documents of a type and hour, as the files of a service would be, of a bounded number of bars:
    # a block holds consecutive rows of one input partition.
    block = F.shiftright(F.monotonically_increasing_id(), 10).alias("block")
    rows = V.load(spark, sf, "events").select("event_type", F.date_trunc("hour", "ts").alias("hour"), block, item.alias("bar"))
    grouped = rows.groupBy("event_type", "hour", "block").agg(F.collect_list("bar").alias("r"))
    columns = ["ts", *readers.BARS, "volume"]
    arrays = grouped.select(F.upper("event_type").alias("ticker"), *[F.col(f"r.{c}").alias(c) for c in columns])
    return readers.chart_rows(arrays)


@query(
    "src3",
    "SELECT date, ticker, open, high, low, close, CAST(NULL AS DOUBLE) AS adj_close, volume FROM prices",
    "prices",
    dates="date",
)
def src3(spark, sf):
    titled = V.prices(spark, sf).drop("adj_close").withColumnsRenamed(
        {"date": "Datetime", "open": "Open", "high": "High", "low": "Low", "close": "Close", "volume": "Volume"}
    )
    return readers.normal_history(titled, F.col("ticker"))


@query(
    "src4",
    f"""SELECT CAST({_DAY} AS DATE) AS date, 'EURUSD' AS pair, CAST(l_quantity AS DOUBLE) AS rate_usd_per_eur
    FROM lineitem WHERE l_linenumber <> 7""",
    dates="date",
)
def src4(spark, sf):
    return readers.fx_rows(_bar_texts(spark, sf))


_POSTS = """
    c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations WHERE text IS NOT NULL),
    head AS (SELECT conv_id, text FROM c WHERE k = 1),
    body AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS n FROM c WHERE k > 1 AND text <> '')"""


@query(
    "src5",
    f"""
    WITH {_POSTS}
    SELECT CAST(conv_id AS VARCHAR) AS id, TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id % 10000 AS INTEGER)) AS created_utc,
           CASE WHEN conv_id % 3 = 0 THEN '' ELSE 't' || conv_id END AS title, text, CAST(conv_id % 50 AS INTEGER) AS upvotes, 0 AS num_comments FROM head
    UNION ALL
    SELECT conv_id || '_' || turn, TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id % 10000 AS INTEGER)), '', text, 0, 0
    FROM body WHERE n <= 2 AND conv_id % 2 = 0""",
    stamps="created_utc",
)
def src5(spark, sf):
    turns = V.load(spark, sf, "conversations").where("text IS NOT NULL")
    comment = F.struct(
        F.col("turn").cast("string").alias("id"), F.col("text").alias("body"), F.lit(None).cast("double").alias("created_utc"), F.lit(None).cast("int").alias("score")
    )
    # The first turn is the post; two comments need at most three turns with a text.  The group limit works before the shuffle.
    key = F.struct("turn", "role", "text")
    head = turns.groupBy("conv_id").agg(F.min(key).alias("post"))
    few = first_per_key(turns.where("text <> ''"), ["conv_id"], *[F.col(c) for c in ("turn", "role", "text")], n=3)
    few = few.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", comment.alias("c")))).alias("few"))
    whole = head.join(few, "conv_id", "left")
    rest = F.when(F.col("post.text") != "", F.slice("few", 2, 3)).otherwise(F.col("few"))
    posts = whole.select(
        F.col("conv_id").cast("string").alias("id"),
        F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("t"), "conv_id")).alias("title"),
        (F.lit(1704067200.0) + F.col("conv_id") % 10000 * 60).alias("created_utc"),
        F.col("post.text").alias("selftext"),
        (F.col("conv_id") % 50).cast("int").alias("score"),
        F.lit(None).cast("int").alias("num_comments"),
        F.transform(rest, lambda x: x["c"]).alias("comments"),
    )
    hot = F.col("id").cast("bigint") % 2 == 0
    # New posts hold every post again; hot ones win.
    return readers.post_rows(posts.where(hot), posts, 2)


@query(
    "src6",
    """
    SELECT coalesce(CASE WHEN page_id % 4 = 0 THEN 'g' || page_id END, CASE WHEN page_id % 4 < 3 THEN url END, 'T' || page_id) AS id,
           'T' || page_id AS title, TIMESTAMP '2024-01-01 10:00:00' + to_days(CAST(page_id % 28 AS INTEGER)) AS created_utc, md5(html) AS text
    FROM pages""",
    stamps="created_utc",
)
def src6(spark, sf):
    page, none = F.col("page_id"), F.lit(None).cast("string")
    at = F.expr("timestamp'2024-01-01 10:00:00' + make_dt_interval(cast(page_id % 28 as int))")
    raw = V.load(spark, sf, "pages").select(
        F.when(page % 4 == 0, F.concat(F.lit("g"), page)).alias("guid"),
        none.alias("id"),
        F.when(page % 4 < 3, F.col("url")).alias("link"),
        F.concat(F.lit("T"), page).alias("title"),
        F.when(page % 2 == 0, F.col("html")).alias("description"),
        F.col("html").alias("summary"),
        F.when(page % 3 == 0, F.date_format(at, "EEE, d MMM yyyy HH:mm:ss '+0000'")).alias("pubDate"),
        F.when(page % 3 == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("published"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated"),
    )
    return readers.feed_rows(raw).withColumn("text", F.md5("text"))


@query(
    "src7",
    """
    SELECT ticker, alias, 'seed' AS source FROM (
        SELECT upper('p' || p_partkey) AS ticker, unnest([trim(p_name), p_brand]) AS alias FROM part) WHERE alias <> ''""",
)
def src7(spark, sf):
    rows = V.load(spark, sf, "part").select(
        F.to_json(
            F.create_map(F.concat(F.lit("p"), "p_partkey"), F.array(F.concat(F.lit(" "), "p_name", F.lit(" ")), F.col("p_brand"), F.lit("  ")))
        ).alias("value")
    )
    return readers.alias_rows(rows)


_FILE = "lpad(CAST(p_partkey AS VARCHAR), 10, '0')"
_SUFFIX = "['', 'st', 't', 'e'][1 + p_partkey % 4]"


def _part_files(spark, sf, value):
    """One JSON file for each part."""
    return V.load(spark, sf, "part").select(F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("file"), value.alias("value"))


def _part_word(n: int):
    suffix = F.element_at(F.array(F.lit(""), F.lit("st"), F.lit("t"), F.lit("e")), (1 + F.col("p_partkey") % 4).cast("int"))
    return F.concat(F.split_part("p_name", F.lit(" "), F.lit(n)), suffix)


@query(
    "src8",
    f"""
    WITH w AS (SELECT {_FILE} AS file, 0 AS pos, split_part(p_name, ' ', 1) || {_SUFFIX} AS w, p_size AS score FROM part
               UNION ALL SELECT {_FILE}, 1, split_part(p_name, ' ', 2) || {_SUFFIX}, -p_size FROM part),
    n AS (SELECT file, pos, score, CASE WHEN length(w) <= 4 OR w IN ('gear', 'widgete', 'ringst') THEN w
              WHEN w LIKE '%st' THEN left(w, length(w) - 2) || 'en' WHEN w LIKE '%t' THEN left(w, length(w) - 1) || 'en'
              WHEN w LIKE '%e' THEN w || 'n' ELSE w END AS word FROM w)
    SELECT word, CAST(arg_min(score, row(file, pos)) AS INTEGER) AS score FROM n WHERE word NOT IN ('gear', 'widgete') GROUP BY 1
    UNION ALL SELECT 'gear', 9 UNION ALL SELECT 'widgete', 3""",
)
def src8(spark, sf):
    value = F.to_json(F.create_map(F.upper(_part_word(1)), F.col("p_size").cast("int"), _part_word(2), -F.col("p_size").cast("int")))
    return readers.lexicon_rows(_part_files(spark, sf, value), {"gear": 9, "widgete": 3}, ["ringst"])


@query(
    "src9",
    f"""
    SELECT 'intensity' AS kind, lower(p_brand) AS word, arg_max(p_size / 4, p_partkey) AS weight FROM part GROUP BY 2
    UNION ALL SELECT 'intensity', w, x FROM (VALUES ('mega', 2), ('brand#1', 99)) AS given(w, x) WHERE w NOT IN (SELECT lower(p_brand) FROM part)
    UNION ALL (SELECT DISTINCT 'marker', split_part(p_name, ' ', 1) || {_SUFFIX}, CAST(NULL AS DOUBLE) FROM part
               UNION SELECT 'marker', unnest(['nie', 'ohne']), NULL)""",
)
def src9(spark, sf):
    value = F.to_json(
        F.struct(F.create_map("p_brand", F.col("p_size") / 4).alias("intensities"), F.array(F.upper(_part_word(1))).alias("markers"))
    )
    return readers.marker_rows(_part_files(spark, sf, value), {"mega": 2.0, "brand#1": 99.0}, ["nie", "ohne"])


@query(
    "src10",
    """
    SELECT CAST(doc_id AS VARCHAR) AS text, CASE WHEN toxic = 1 THEN 'negative' ELSE 'positive' END AS label
    FROM labels WHERE toxic = 1 OR quality = 1""",
)
def src10(spark, sf):
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return readers.labelled_rows(V.load(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("text"), label.alias("label")))


@query("src11", "SELECT 'P' || p_partkey AS symbol, p_name AS name FROM part")
def src11(spark, sf):
    raw = V.load(spark, sf, "part").select(
        "p_size", F.concat(F.lit(" p"), "p_partkey", F.lit(" ")).alias("Ticker"), F.col("p_name").alias("DESCRIPTION")
    )
    return readers.master_rows(raw)


@query(
    "src12",
    "SELECT id, created_utc, title, md5(text) AS text, upvotes, num_comments FROM text_posts",
    "text_posts",
    stamps="created_utc",
)
def src12(spark, sf):
    return readers.stored_rows(V.text_posts(spark, sf)).withColumn("text", F.md5("text"))


# --- sinks: written, read back ------------------------------------------------


@query("snk1", "SELECT id, ticker, created_utc, upvotes, num_comments FROM posts", "posts", stamps="created_utc")
def snk1(spark, sf):
    rows = V.posts(spark, sf).select("id", "ticker", "created_utc", "upvotes", "num_comments")
    path = new_folder(spark, "posts-json")
    writers.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query(
    "snk2",
    "SELECT ticker, count(*) AS days, max(date) AS last_date, max(close) AS high_close, CASE WHEN count(*) % 2 = 0 THEN 'even, \"days\"' END AS note FROM prices GROUP BY 1",
    "prices",
    dates="last_date",
)
def snk2(spark, sf):
    days = F.count(F.lit(1))
    table = V.prices(spark, sf).groupBy("ticker").agg(
        days.alias("days"), F.max("date").alias("last_date"), F.max("close").alias("high_close"), F.when(days % 2 == 0, 'even, "days"').alias("note")
    )
    path = new_folder(spark, "overview-csv")
    writers.write_overview(table, path)
    return spark.read.schema(table.schema).option("header", True).csv(path)


@query(
    "snk3",
    """
    SELECT ticker AS symbol, count(*) AS mentions, CAST(m AS TIMESTAMP) AS ts
    FROM posts, (VALUES ('2024-01-08 09:30:00'), ('2024-01-08 18:00:00'), ('2024-01-09 09:30:00')) AS v(m)
    WHERE created_utc < CAST(m AS TIMESTAMP) GROUP BY 1, 3""",
    "posts",
    stamps="ts",
)
def snk3(spark, sf):
    path = new_folder(spark, "history")
    # The second scan is written twice; a repeated scan replaces itself.
    for moment in (datetime(2024, 1, 8, 9, 30), datetime(2024, 1, 8, 18), datetime(2024, 1, 8, 18), datetime(2024, 1, 9, 9, 30)):
        seen = V.posts(spark, sf).where(F.col("created_utc") < F.lit(moment).cast("timestamp"))
        scan = seen.groupBy(F.col("ticker").alias("symbol")).agg(F.count(F.lit(1)).alias("mentions"))
        writers.append_history(scan, path, moment)
    return spark.read.parquet(path).select("symbol", "mentions", "ts")
