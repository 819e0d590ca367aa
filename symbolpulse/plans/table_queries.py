"""Table maintenance, lists, alerts, watchlist rules and overview tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from .. import schemas

from ..operators import lists, overview, prices, rollups, scoring, tables, trends
from ..operators.storage import stored
from . import views as V
from .price_queries import AHEAD, MARKET_ENRICHED, WEEKLY, market_enriched
from .registry import query
from .rounding import rounded

ROW = "date, ticker, close, volume"


def _bars(spark, sf):
    return V.prices(spark, sf).select("date", "ticker", "close", "volume")


def _batch(spark, sf):
    """A later delivery: restated bars of 2000 and new ones after it."""
    late = _bars(spark, sf).where(F.col("date") >= "2000-01-01")
    return late.withColumn("close", F.col("close") * 2)


_OLD = f"(SELECT {ROW} FROM prices WHERE date < DATE '2001-01-01')"
_NEW = "(SELECT date, ticker, close * 2 AS close, volume FROM prices WHERE date >= DATE '2000-01-01')"


@query(
    "ups1",
    f"SELECT * FROM {_OLD} o WHERE NOT EXISTS (SELECT 1 FROM {_NEW} n WHERE n.date = o.date AND n.ticker = o.ticker) UNION ALL SELECT * FROM {_NEW}",
    "prices",
    dates="date",
)
def ups1(spark, sf):
    old = _bars(spark, sf).where(F.col("date") < "2001-01-01")
    return tables.upsert(old, _batch(spark, sf), ["date", "ticker"])


_SIGHT = "TIMESTAMP '2001-06-15 12:00:00'"


def _candidates(spark, sf):
    """Suppliers as candidates."""
    return V.load(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"),
        (F.col("s_nationkey") * 5).alias("mentions_24h"),
        F.lit(0.5).alias("baseline_rate_per_h"),
        F.round(F.abs("s_acctbal") / 1000, 3).alias("lift"),
        F.round(F.col("s_acctbal") / 100, 2).alias("trend"),
        "s_nationkey",
    )


CANDIDATES = """
    SELECT 'S' || s_suppkey AS symbol, s_nationkey * 5 AS mentions_24h, 0.5::DOUBLE AS baseline_rate_per_h,
           round(abs(s_acctbal) / 1000, 3) AS lift, round(s_acctbal / 100, 2) AS trend, s_nationkey FROM supplier"""


@query(
    "ups2",
    f"""
    WITH c AS ({CANDIDATES}), t AS (SELECT * FROM c WHERE s_nationkey < 18), s AS (SELECT * FROM c WHERE s_nationkey > 7)
    SELECT coalesce(t.symbol, s.symbol) AS symbol, CASE WHEN s.symbol IS NULL THEN t.mentions_24h ELSE s.mentions_24h + 1 END AS mentions_24h,
           coalesce(s.baseline_rate_per_h, t.baseline_rate_per_h) AS baseline_rate_per_h,
           coalesce(s.lift, t.lift) AS lift, coalesce(s.trend, t.trend) AS trend,
           CASE WHEN t.symbol IS NULL THEN {_SIGHT} ELSE TIMESTAMP '2001-06-01 00:00:00' END AS first_seen,
           CASE WHEN s.symbol IS NULL THEN TIMESTAMP '2001-06-01 00:00:00' ELSE {_SIGHT} END AS last_seen
    FROM t FULL JOIN s ON t.symbol = s.symbol""",
    stamps="first_seen last_seen",
)
def ups2(spark, sf):
    rows = _candidates(spark, sf)
    seen = F.lit(datetime(2001, 6, 1)).cast("timestamp")
    target = rows.where("s_nationkey < 18").withColumns({"first_seen": seen, "last_seen": seen}).drop("s_nationkey")
    scan = rows.where("s_nationkey > 7").withColumn("mentions_24h", F.col("mentions_24h") + 1)
    return tables.merge_candidates(target, scan.drop("s_nationkey"), V.MARKET_AS_OF)


@query(
    "ups3",
    """
    SELECT id, ticker FROM posts p WHERE created_utc >= TIMESTAMP '2024-01-10'
      AND NOT EXISTS (SELECT 1 FROM posts q WHERE q.id = p.id AND q.created_utc < TIMESTAMP '2024-01-20')""",
    "posts",
)
def ups3(spark, sf):
    rows = V.posts(spark, sf).select("id", "ticker", "created_utc")
    stored = rows.where("created_utc < timestamp'2024-01-20'")
    return tables.insert_absent(stored, rows.where("created_utc >= timestamp'2024-01-10'"), ["id"]).select("id", "ticker")


@query(
    "ups4",
    """
    SELECT coalesce(CASE WHEN signal <> 'sell' THEN as_of END, TIMESTAMP '2001-06-15 12:00:00') AS as_of, ticker,
           coalesce(nullif(horizon_days, 3), 1) AS horizon_days, signal, confidence, round(expected_return, 6) AS expected_return,
           CASE WHEN version LIKE '%economy' THEN 'ml-v2' ELSE version END AS version
    FROM predictions WHERE signal <> 'hold' AND ticker <> 'S7'""",
    "predictions",
    stamps="as_of",
)
def ups4(spark, sf):
    raw = V.predictions(spark, sf).withColumns(
        {
            "as_of": F.when(F.col("signal") != "sell", F.col("as_of")),
            "horizon_days": F.nullif("horizon_days", F.lit(3)),
            "signal": F.when(F.col("signal") != "hold", F.col("signal")),
            "ticker": F.when(F.col("ticker") == "S7", "").otherwise(F.col("ticker")),
            "version": F.when(F.col("version").endswith("economy"), "").otherwise(F.col("version")),
        }
    )
    return rounded(tables.prediction_rows(raw, V.MARKET_AS_OF))


@query("del1", f"SELECT {ROW} FROM prices WHERE date >= DATE '2001-06-15' - 180", "prices", dates="date")
def del1(spark, sf):
    return tables.purge(_bars(spark, sf), "date", date(2001, 6, 15), 180)


@query("del1_posts", "SELECT id FROM posts WHERE created_utc >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 DAY", "posts")
def del1_posts(spark, sf):
    return tables.purge(V.posts(spark, sf), "created_utc", V.EVENTS_AS_OF, 10).select("id")


_GONE = "chat_id = 'MACHINERY' OR symbol IN ('S1', 'S3')"


def _removed(spark, sf):
    watched = V.watchlist(spark, sf)
    return watched, watched.where(_GONE).select("chat_id", F.lower(F.concat(F.lit(" "), "symbol")).alias("symbol"))


@query("del2", f"SELECT * FROM watchlist WHERE NOT ({_GONE})", "watchlist")
def del2(spark, sf):
    return lists.remove_from_watchlist(*_removed(spark, sf))[0]


@query("del2_removed", f"SELECT count(*) AS removed FROM watchlist WHERE {_GONE}", "watchlist")
def del2_removed(spark, sf):
    return lists.remove_from_watchlist(*_removed(spark, sf))[1]


TODAY = date(2001, 6, 17)  # a Sunday; the last trading day is Friday the 15th


def _starts(spark, sf):
    symbols = V.suppliers(spark, sf).unionByName(spark.createDataFrame([("NEW",)], "ticker string"))
    return tables.next_start(_bars(spark, sf).where(F.col("date") <= "2001-06-15"), symbols)


STARTS = """
    SELECT s.ticker, max(p.date) AS last_date, max(p.date) + 1 AS start_date
    FROM (SELECT ticker FROM suppliers UNION SELECT 'NEW') s
    LEFT JOIN (SELECT * FROM prices WHERE date <= DATE '2001-06-15') p USING (ticker) GROUP BY 1"""


@query("inc1", STARTS, "suppliers prices", dates="last_date start_date")
def inc1(spark, sf):
    return _starts(spark, sf)


@query(
    "inc2",
    f"""
    WITH s AS ({STARTS})
    SELECT p.date, p.ticker, p.close, p.volume FROM prices p LEFT JOIN s USING (ticker)
    WHERE last_date IS NULL OR p.date > last_date OR (last_date = DATE '2001-06-15' AND p.date = DATE '2001-06-15')""",
    "suppliers prices",
    dates="date",
)
def inc2(spark, sf):
    return tables.new_rows(_bars(spark, sf), _starts(spark, sf), TODAY)


@query(
    "inc3",
    f"SELECT ticker, start_date FROM ({STARTS}) WHERE start_date IS NULL OR start_date <= DATE '2001-06-15'",
    "suppliers prices",
    dates="start_date",
)
def inc3(spark, sf):
    return tables.due_symbols(_starts(spark, sf), TODAY).select("ticker", "start_date")


_SOURCES = """
    all_ AS (SELECT date, ticker, close, CAST(substr(ticker, 2) AS INTEGER) % 4 AS k FROM prices),
    one AS (SELECT date, ticker, close FROM all_ WHERE k = 0),
    two AS (SELECT date, ticker, close * 2 AS close FROM all_ WHERE k <= 1),
    three AS (SELECT date, ticker, close * 3 AS close FROM all_)"""


@query(
    "inc4",
    f"""
    WITH {_SOURCES}
    SELECT * FROM one UNION ALL SELECT * FROM two WHERE ticker NOT IN (SELECT ticker FROM one)
    UNION ALL SELECT * FROM three WHERE ticker NOT IN (SELECT ticker FROM one) AND ticker NOT IN (SELECT ticker FROM two)""",
    "prices",
    dates="date",
)
def inc4(spark, sf):
    rows = _bars(spark, sf).drop("volume")
    part = F.substring("ticker", 2, 10).cast("int") % 4
    priced = lambda times: rows.withColumn("close", F.col("close") * times)
    return tables.merge_sources(rows.where(part == 0), priced(2).where(part <= 1), priced(3))


@query("val1", "SELECT date, ticker, open, high, low, close, adj_close, volume FROM prices", "prices", dates="date")
def val1(spark, sf):
    return schemas.conform(V.prices(spark, sf), "prices")


@query(
    "val2",
    """
    SELECT TRY_CAST(CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS DATE) AS date,
           'S' || l_suppkey AS ticker, CAST(l_partkey AS DOUBLE) AS open,
           TRY_CAST(CASE WHEN l_linenumber < 4 THEN l_returnflag ELSE CAST(l_orderkey AS VARCHAR) END AS DOUBLE) AS high,
           CAST(NULL AS DOUBLE) AS low, l_quantity AS close, CAST(NULL AS DOUBLE) AS adj_close, CAST(l_linenumber AS DOUBLE) AS volume
    FROM lineitem""",
    dates="date",
)
def val2(spark, sf):
    text = F.date_format("l_shipdate", "yyyy-MM-dd")
    raw = V.load(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(text).alias("date"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"),
        F.col("l_partkey").cast("string").alias("open"),
        F.when(F.col("l_linenumber") < 4, F.col("l_returnflag")).otherwise(F.col("l_orderkey").cast("string")).alias("high"),
        F.lit("").alias("low"),
        F.col("l_quantity").cast("string").alias("close"),
        F.lit(None).cast("string").alias("adj_close"),
        F.col("l_linenumber").cast("string").alias("volume"),
    )
    return tables.coerce_prices(raw)


@query(
    "val3",
    """
    SELECT coalesce(CASE WHEN lang <> 'de' THEN CAST(doc_id AS VARCHAR) END, 'n' || doc_id) AS id, md5(text) AS text,
           CAST(CASE WHEN source = 'web' THEN 0 ELSE least(greatest(n_chars * 5000 - 1000000, 0), 10000000) END AS INTEGER) AS upvotes
    FROM documents WHERE lang <> 'fr'""",
)
def val3(spark, sf):
    votes = (F.col("n_chars") * 5000 - 1000000).cast("string")
    raw = V.load(spark, sf, "documents").select(
        F.when(F.col("lang") != "de", F.concat(F.lit(" "), F.col("doc_id"))).alias("id"),
        F.concat(F.lit("n"), F.col("doc_id")).alias("name"),
        F.when(F.col("lang") != "fr", "2024-01-01 10:00:00").otherwise("unknown").alias("created_utc"),
        F.when(F.col("source") == "web", "many").otherwise(votes).alias("upvotes"),
        "text",
    )
    return tables.clean_posts(raw).select("id", F.md5("text").alias("text"), "upvotes")


@query(
    "enr1",
    """
    SELECT id, upper(title) AS ticker, upvotes, round(s, 6) AS sentiment_dict, round(s * (1 + log10(1 + upvotes)), 6) AS sentiment_weighted
    FROM (SELECT *, CAST(length(text) % 3 - 1 AS DOUBLE) AS s FROM text_posts)""",
    "text_posts",
)
def enr1(spark, sf):
    raw = V.text_posts(spark, sf).withColumn("ticker", F.col("title"))
    done = scoring.enrich_posts(raw, score=lambda text: F.length(text) % 3 - 1)
    return rounded(done.select("id", "ticker", "upvotes", "sentiment_dict", "sentiment_weighted"))


# --- lists and alerts ----------------------------------------------------------

@query("dst1", "SELECT DISTINCT symbol FROM watchlist", "watchlist")
def dst1(spark, sf):
    return lists.watched_symbols(V.watchlist(spark, sf))


_ADDS = "SELECT p_brand AS chat_id, 'S' || (p_partkey % 300) AS symbol, p_name AS note, p_partkey AS seq FROM part WHERE p_size > 5"


@query(
    "wch1",
    f"""
    WITH a AS ({_ADDS}), l AS (SELECT chat_id, symbol, arg_max(note, seq) AS note FROM a GROUP BY 1, 2),
    t AS (SELECT p_brand AS chat_id, 'S' || p_size AS symbol, 'old' AS note FROM part GROUP BY ALL)
    SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.chat_id = t.chat_id AND l.symbol = t.symbol) UNION ALL SELECT * FROM l""",
)
def wch1(spark, sf):
    part = V.load(spark, sf, "part")
    target = part.select(F.col("p_brand").alias("chat_id"), F.concat(F.lit("S"), "p_size").alias("symbol"), F.lit("old").alias("note"))
    name = F.concat(F.lit(" s"), F.col("p_partkey") % 300)
    adds = part.select(
        F.col("p_brand").alias("chat_id"),
        F.when(F.col("p_size") > 5, name).otherwise(" ").alias("symbol"),
        F.col("p_name").alias("note"),
        F.col("p_partkey").alias("seq"),
    )
    return lists.add_to_watchlist(target.distinct(), adds)


_ALERT_ROWS = """
    WITH t AS (SELECT min(id) AS id, ticker, arg_min(op, id) AS op, min(id) * 10.0::DOUBLE AS price, FALSE AS active FROM alerts
               WHERE ticker < 'S2' GROUP BY ticker),
    a AS (SELECT ticker, op, price, id AS seq FROM alerts WHERE op <> '<='),
    l AS (SELECT ticker, arg_max(op, seq) AS op, arg_max(price, seq) AS price, min(seq) AS first FROM a GROUP BY 1),
    n AS (SELECT (SELECT max(id) FROM t) + row_number() OVER (ORDER BY first) AS id, ticker, op, price, TRUE AS active
          FROM l WHERE ticker NOT IN (SELECT ticker FROM t))
    SELECT t.id, t.ticker, coalesce(l.op, t.op) AS op, round(coalesce(l.price, t.price), 4) AS price, l.ticker IS NOT NULL AS active
    FROM t LEFT JOIN l USING (ticker) UNION ALL SELECT id, ticker, op, round(price, 4), active FROM n"""


@query("alr1", _ALERT_ROWS, "alerts")
def alr1(spark, sf):
    rules = V.alerts(spark, sf)
    target = (
        rules.where("ticker < 'S2'")
        .groupBy("ticker")
        .agg(F.min("id").alias("id"), F.min_by("op", "id").alias("op"), (F.min("id") * 10.0).alias("price"))
        .withColumn("active", F.lit(False))
    )
    adds = rules.select(
        F.lower("ticker").alias("ticker"),
        F.when(F.col("op") == "<=", "==").otherwise(F.col("op")).alias("op"),
        "price",
        F.col("id").alias("seq"),
    )
    return rounded(lists.put_alerts(target, adds), 4)


@query("alr1_switch", "SELECT id, ticker, op, round(price, 4) AS price, CASE WHEN op = '<' THEN TRUE ELSE active END AS active FROM alerts", "alerts")
def alr1_switch(spark, sf):
    rules = V.alerts(spark, sf)
    return rounded(lists.switch_alerts(rules, rules.where("op = '<'").select("id"), True), 4)


_LATEST = "(SELECT ticker, arg_max(close, date) AS last_price FROM prices GROUP BY 1)"


@query(
    "alr2",
    f"""
    SELECT id, ticker, last_price, coalesce(CASE op WHEN '<' THEN last_price < price WHEN '>' THEN last_price > price
        WHEN '<=' THEN last_price <= price WHEN '>=' THEN last_price >= price END, FALSE) AS triggered
    FROM alerts LEFT JOIN {_LATEST} USING (ticker) WHERE active""",
    "alerts prices",
)
def alr2(spark, sf):
    latest = prices.latest_prices(V.prices(spark, sf)).select("ticker", F.col("close").alias("price"))
    return lists.judge_alerts(V.alerts(spark, sf), latest).select("id", "ticker", "last_price", "triggered")


@query(
    "jon11",
    f"""
    SELECT id, ticker, last_price, coalesce(CASE WHEN op < '=' THEN last_price >= price ELSE last_price <= price END, FALSE) AS triggered
    FROM alerts LEFT JOIN {_LATEST} USING (ticker)""",
    "alerts prices",
)
def jon11(spark, sf):
    latest = prices.latest_prices(V.prices(spark, sf)).select("ticker", F.col("close").alias("price"))
    rules = V.alerts(spark, sf).select(
        "id", "ticker", F.col("price").alias("threshold"), F.when(F.col("op") < "=", "above").otherwise("below").alias("direction")
    )
    return lists.judge_thresholds(rules, latest).select("id", "ticker", "last_price", "triggered")


_ALIAS_ROWS = "(SELECT DISTINCT upper(p_type) AS ticker, split_part(p_name, ' ', 1) AS alias, 'seed' AS source FROM part WHERE p_size < 20)"
_ALIAS_ADDS = "(SELECT upper(p_type) AS ticker, p_name AS alias, min(p_brand) AS source FROM part GROUP BY 1, 2 UNION ALL SELECT upper(p_type), split_part(p_name, ' ', 1), min(p_brand) FROM part GROUP BY 1, 2)"


def _alias_rows(spark, sf):
    part = V.load(spark, sf, "part")
    first = F.substring_index("p_name", " ", 1)
    own = part.where("p_size < 20").select(F.upper("p_type").alias("ticker"), first.alias("alias"), F.lit("seed").alias("source"))
    ticker = F.concat(F.lower("p_type"), F.lit(" ")).alias("ticker")
    adds = part.select(ticker, F.col("p_name").alias("alias"), F.col("p_brand").alias("source")).unionByName(
        part.select(ticker, F.concat(first, F.lit(" ")).alias("alias"), F.col("p_brand").alias("source"))
    )
    return lists.add_aliases(own.distinct(), adds)


_ALIAS_STATE = f"SELECT * FROM {_ALIAS_ROWS} UNION ALL SELECT * FROM {_ALIAS_ADDS} WHERE (ticker, alias) NOT IN (SELECT ticker, alias FROM {_ALIAS_ROWS})"


@query("als1", _ALIAS_STATE)
def als1(spark, sf):
    return _alias_rows(spark, sf)


@query(
    "als1_list",
    f"SELECT ticker, string_agg(alias, '|' ORDER BY alias) AS aliases FROM ({_ALIAS_STATE}) WHERE alias NOT LIKE 'red%' GROUP BY 1",
)
def als1_list(spark, sf):
    rows = _alias_rows(spark, sf)
    left, _ = lists.remove_aliases(rows, rows.where("alias LIKE 'red%'"))
    return lists.alias_lists(left).select("ticker", F.array_join("aliases", "|").alias("aliases"))


# --- watchlist rules -------------------------------------------------------------

RULES = "S1.*:10:2.5,bad,S[:1:1,x:y:z,S2$:5:0.5,DEFAULT:25:3.5"
_LIMITS = """CASE WHEN regexp_matches(symbol, 'S1.*') THEN 10 WHEN regexp_matches(symbol, 'S2$') THEN 5 ELSE 25 END AS min_mentions,
    CAST(CASE WHEN regexp_matches(symbol, 'S1.*') THEN 2.5 WHEN regexp_matches(symbol, 'S2$') THEN 0.5 ELSE 3.5 END AS DOUBLE) AS min_lift"""


@query("jon10", f"SELECT symbol, {_LIMITS} FROM ({CANDIDATES})")
def jon10(spark, sf):
    mentions, lift = trends.rule_thresholds("symbol", RULES)
    return _candidates(spark, sf).select("symbol", mentions.alias("min_mentions"), lift.alias("min_lift"))


_PICKED = f"""
    WITH c AS ({CANDIDATES} ORDER BY trend DESC, lift DESC, mentions_24h DESC, symbol LIMIT 20),
    k AS (SELECT *, {_LIMITS} FROM c WHERE symbol NOT IN (SELECT symbol FROM watchlist) AND symbol IN (SELECT ticker FROM prices))
    SELECT * FROM k WHERE mentions_24h >= min_mentions AND lift >= min_lift
    ORDER BY trend DESC, lift DESC, mentions_24h DESC, symbol LIMIT 3"""


def _picked(spark, sf):
    known = V.prices(spark, sf).select(F.col("ticker").alias("symbol")).distinct()
    return trends.auto_watchlist(_candidates(spark, sf), V.watchlist(spark, sf), known, RULES)


@query("top3", f"SELECT symbol FROM ({_PICKED})", "watchlist prices")
def top3(spark, sf):
    return _picked(spark, sf).select("symbol")


@query(
    "trd5",
    f"""
    SELECT '_GLOBAL_' AS chat_id, symbol, printf('auto-added %d m24h, lift %.1f, trend %.2f', mentions_24h, lift, trend) AS note
    FROM ({_PICKED})""",
    "watchlist prices",
)
def trd5(spark, sf):
    return _picked(spark, sf)


# --- overview --------------------------------------------------------------------

_MARKET_DAILY = f"""
    SELECT CAST(created_utc AS DATE) AS date, ticker, avg(sentiment_dict) AS sentiment_dict,
           sum(sentiment_weighted) / nullif(sum(1 + log10(1 + upvotes)), 0) AS sentiment_weighted, count(*) AS posts
    FROM ({MARKET_ENRICHED}) WHERE sentiment_weighted IS NOT NULL GROUP BY 1, 2"""
_MARKET_TRENDS = f"""
    SELECT CAST(created_utc AS DATE) AS date, ticker, count(*) AS mentions, avg(upvotes) AS avg_upvotes,
           count(*) * avg(upvotes) AS hotness FROM ({MARKET_ENRICHED}) WHERE sentiment_dict IS NOT NULL GROUP BY 1, 2"""

OVERVIEW = f"""
    pr AS (SELECT p.ticker, p.close AS price_usd, p.close / f.rate_usd_per_eur AS price_eur
           FROM (SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM prices GROUP BY 1) p
           ASOF LEFT JOIN fx f ON p.date >= f.date),
    sg AS (SELECT ticker, max(as_of) AS signal_as_of, max_by(struct_pack(s := signal, c := confidence, e := expected_return, v := version), as_of) AS r
           FROM predictions WHERE horizon_days = 1 GROUP BY 1),
    md AS ({_MARKET_DAILY}),
    mo AS (SELECT ticker, max(date) AS sentiment_date, arg_max(sentiment_weighted, date) AS sentiment_weighted,
                  arg_max(posts, date) AS sentiment_posts FROM md GROUP BY 1),
    mt AS ({_MARKET_TRENDS}),
    td AS (SELECT ticker, mentions AS mentions_today, hotness AS hotness_today FROM mt WHERE date = DATE '2001-06-15'),
    wk AS ({WEEKLY}),
    ov AS (
        SELECT s.ticker, price_usd, round(price_eur, 4) AS price_eur, r.s AS ml_signal, r.c AS ml_confidence,
               round(r.e, 6) AS ml_expected_return, signal_as_of, r.v AS signal_version,
               round(sentiment_weighted, 6) AS sentiment_weighted, CAST(sentiment_posts AS DOUBLE) AS sentiment_posts, sentiment_date,
               CAST(mentions_today AS DOUBLE) AS mentions_today, round(hotness_today, 4) AS hotness_today,
               round(weekly_return, 6) AS weekly_return, TIMESTAMP '2001-06-15 12:00:00' AS generated_at
        FROM suppliers s LEFT JOIN pr USING (ticker) LEFT JOIN sg USING (ticker) LEFT JOIN mo USING (ticker)
        LEFT JOIN td USING (ticker) LEFT JOIN wk USING (ticker))"""


def _sides(spark, sf):
    rows = market_enriched(spark, sf)
    return (
        V.suppliers(spark, sf),
        V.prices(spark, sf),
        V.fx(spark, sf),
        V.predictions(spark, sf),
        rollups.daily_sentiment(rows),
        rollups.hourly_sentiment(rows),
        rollups.daily_trends(rows),
        rows,
    )


def _plain(df):
    """Counts that may be missing as doubles; prices to four digits."""
    four = {"price_eur", "hotness_today"}
    shown = []
    for name, kind in df.dtypes:
        if name in {"sentiment_posts", "mentions_today", "correlation_samples", "hotness_level"}:
            shown.append(F.col(name).cast("double").alias(name))
        elif kind == "double":
            shown.append((F.round(name, 4 if name in four else 6) + 0.0).alias(name))
        else:
            shown.append(F.col(name))
    return df.select(*shown)


@query(
    "ovw1",
    f"WITH {OVERVIEW} SELECT * FROM ov",
    "suppliers prices fx predictions market_posts",
    dates="sentiment_date",
    stamps="signal_as_of generated_at",
)
def ovw1(spark, sf):
    symbols, price, fx, signal, daily, _hourly, trend, _rows = _sides(spark, sf)
    return _plain(overview.stock_overview(symbols, price, fx, signal, daily, trend, V.MARKET_AS_OF))


@query(
    "ovw2",
    f"""
    WITH {OVERVIEW},
    mh AS (SELECT date_trunc('hour', created_utc) AS created_utc, ticker,
                  sum(sentiment_weighted) / nullif(sum(1 + log10(1 + upvotes)), 0) AS sentiment_weighted
           FROM ({MARKET_ENRICHED}) WHERE sentiment_weighted IS NOT NULL GROUP BY 1, 2),
    c1 AS (SELECT ticker, (max(CASE WHEN rn = 1 THEN close END) / nullif(max(CASE WHEN rn = 2 THEN close END), 0) - 1) * 100 AS x
           FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM prices) GROUP BY 1),
    s7 AS (SELECT ticker, avg(sentiment_weighted) FILTER (date BETWEEN DATE '2001-06-08' AND DATE '2001-06-15') AS a,
                  arg_max(sentiment_weighted, date) AS b FROM md GROUP BY 1),
    h24 AS (SELECT ticker, avg(sentiment_weighted) AS x FROM mh
            WHERE created_utc BETWEEN TIMESTAMP '2001-06-14 12:00:00' AND TIMESTAMP '2001-06-15 12:00:00' GROUP BY 1),
    mc AS (SELECT ticker, coalesce((coalesce(max(mentions) FILTER (date = DATE '2001-06-15'), 0)
                  / avg(mentions) FILTER (date < DATE '2001-06-15') - 1) * 100, 0) AS x,
                  max(hotness) FILTER (date = DATE '2001-06-15') AS h
           FROM mt WHERE date BETWEEN DATE '2001-06-08' AND DATE '2001-06-15' GROUP BY 1),
    al AS (SELECT symbol AS ticker, string_agg(DISTINCT note, ', ' ORDER BY note) AS aliases FROM watchlist GROUP BY 1),
    rt AS (SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM prices),
    co AS (SELECT ticker, corr(ret, sentiment_weighted) AS c, count(*) AS n FROM rt JOIN md USING (ticker, date)
           WHERE ret IS NOT NULL AND sentiment_weighted IS NOT NULL GROUP BY 1 HAVING count(*) >= 5),
    ah AS ({AHEAD}), en AS ({MARKET_ENRICHED}),
    tp AS (SELECT ticker, arg_max(return_3d, row(round(sentiment_weighted, 9), id)) AS top FROM (
               SELECT en.ticker, en.id, en.sentiment_weighted, ah.return_3d
               FROM en ASOF LEFT JOIN ah ON en.ticker = ah.ticker AND CAST(en.created_utc AS DATE) <= ah.date)
           WHERE sentiment_weighted IS NOT NULL AND return_3d IS NOT NULL GROUP BY 1),
    tr AS (SELECT 'S' || s_suppkey AS ticker, s_nationkey / 25 AS accuracy, s_acctbal / 10000 AS f1, 0.01::DOUBLE AS avg_strategy_return,
                  0.5::DOUBLE AS long_win_rate FROM supplier)
    SELECT ov.*, round(c1.x, 6) AS change_1d_pct, round(s7.a, 6) AS weighted_7d, round(s7.b, 6) AS weighted_last_day,
           round(h24.x, 6) AS weighted_24h, round(mc.x, 6) AS mention_change_pct,
           CAST(CASE WHEN mc.ticker IS NULL THEN NULL WHEN h > 0 THEN least(floor(h / 500), 3) ELSE 0 END AS DOUBLE) AS hotness_level,
           aliases, round(co.c, 6) AS correlation, CAST(co.n AS DOUBLE) AS correlation_samples,
           round(tp.top, 6) AS top_post_return_3d, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, avg_strategy_return, long_win_rate
    FROM ov LEFT JOIN tp USING (ticker) LEFT JOIN c1 USING (ticker) LEFT JOIN s7 USING (ticker) LEFT JOIN h24 USING (ticker) LEFT JOIN mc USING (ticker)
    LEFT JOIN al USING (ticker) LEFT JOIN co USING (ticker) LEFT JOIN tr USING (ticker)""",
    "suppliers prices fx predictions market_posts watchlist",
    dates="sentiment_date",
    stamps="signal_as_of generated_at",
)
def ovw2(spark, sf):
    symbols, price, fx, signal, daily, hourly, trend, rows = _sides(spark, sf)
    # Five sides read the closes and three the daily sentiment, all by ticker: both are made once.
    price = tables.gathered(stored(price.select("date", "ticker", "close"), "closes"), ["ticker"], ["date", "close"])
    mood = ["date", "sentiment_dict", "sentiment_weighted", "posts"]
    daily = tables.gathered(stored(daily, "moods"), ["ticker"], mood)
    names = V.watchlist(spark, sf).select(F.col("symbol").alias("ticker"), F.col("note").alias("alias"))
    state = V.load(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"),
        (F.col("s_nationkey") / 25).alias("accuracy"),
        (F.col("s_acctbal") / 10000).alias("f1"),
        F.lit(0.01).alias("avg_strategy_return"),
        F.lit(0.5).alias("long_win_rate"),
    )
    posts = prices.forward_returns(rows, price).withColumn("sentiment_weighted", F.round("sentiment_weighted", 9))
    return _plain(
        overview.detail_overview(
            symbols, price, fx, signal, daily, hourly, trend, posts, names, state, V.MARKET_AS_OF
        )
    )


@query("jon8", f"SELECT symbol, trend FROM ({CANDIDATES}) WHERE symbol NOT IN (SELECT symbol FROM watchlist)", "watchlist")
def jon8(spark, sf):
    watched = V.watchlist(spark, sf).select("symbol")
    return _candidates(spark, sf).join(watched, "symbol", "left_anti").select("symbol", "trend")
