"""Small cases with known results, and brute-force twins of the scaled operators."""

import os
import random
import re
import statistics
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from symbolpulse import schemas
from symbolpulse.plans import catalog
from symbolpulse.operators import evaluation, features, lists, mentions, prices, ranks, rollups, scoring, tables, training, trends

POSTS = "id string, created_utc timestamp, text string"


def by(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_enrich_twice_gives_one_row(spark):
    raw = spark.createDataFrame(
        [("p1", "nvda", "2024-01-01 10:00:00", "x", "9"), (" ", "nvda", "2024-01-01", "x", "9"), ("p2", "nvda", "soon", "x", "1")],
        "id string, ticker string, created_utc string, text string, upvotes string",
    )
    once = scoring.enrich_posts(raw, score=lambda text: F.lit(0.5))
    again = tables.upsert(once, once, ["id", "ticker"])
    row = again.collect()
    assert len(row) == 1 and row[0].ticker == "NVDA" and row[0].sentiment_weighted == 1.0


def test_daily_trends(spark):
    rows = spark.createDataFrame(
        [("a", "X", datetime(2024, 1, 1, 5), 1, 0.1), ("b", "X", datetime(2024, 1, 1, 9), 3, 0.2), ("c", "X", datetime(2024, 1, 1), 9, None)],
        "id string, ticker string, created_utc timestamp, upvotes int, sentiment_dict double",
    )
    r = rollups.daily_trends(rows).first()
    assert (r.mentions, r.avg_upvotes, r.hotness) == (2, 2.0, 4.0)


def test_forward_returns_skip_gaps(spark):
    bars = spark.createDataFrame(
        [(date(2024, 1, d), "X", c) for d, c in ((1, 10.0), (2, 11.0), (4, 14.0), (8, 20.0))],
        "date date, ticker string, close double",
    )
    posts = spark.createDataFrame(
        [("a", "X", datetime(2024, 1, 1, 7)), ("early", "X", datetime(2023, 5, 1)), ("late", "X", datetime(2024, 1, 9)), ("none", "Y", datetime(2024, 1, 1))],
        "id string, ticker string, created_utc timestamp",
    )
    got = by(prices.forward_returns(posts, bars), "id", "return_1d", "return_3d", "return_7d")
    assert got["a"][:2] == pytest.approx((0.1, 1.0)) and got["a"][2] is None
    assert got["early"][:2] == pytest.approx((0.1, 1.0))
    assert got["late"] == (None, None, None) and got["none"] == (None, None, None)


def test_fx_rate_in_force(spark):
    bars = spark.createDataFrame([(date(2024, 1, d), "X", 10.0, 1) for d in (1, 3, 5, 9)], "date date, ticker string, close double, volume bigint")
    bars = bars.withColumns({c: F.col("close") for c in ("open", "high", "low")})
    fx = spark.createDataFrame([(date(2024, 1, 2), "EURUSD", 2.0), (date(2024, 1, 5), "EURUSD", 4.0), (date(2024, 1, 1), "GBPUSD", 9.0)], "date date, pair string, rate_usd_per_eur double")
    got = prices.with_eur(bars, fx).orderBy("date").collect()
    assert [r.close_eur for r in got] == [None, 5.0, 2.5, 2.5] and got[0].adj_close == 10.0


def test_hot_group_median_matches(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.uniform(-1, 1), rng.uniform(-1e9, 1e9), rng.randint(-3, 3) * 1.0, 0.0])) for _ in range(4001)]
    rows += [(f"k{i % 7}", rng.uniform(0.5, 0.5001)) for i in range(300)] + [("one", 2.5), ("gap", None)]
    got = by(ranks.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m"), "k", "m")
    want = {}
    for key in {k for k, _ in rows} - {"gap"}:
        want[key] = statistics.median(v for k, v in rows if k == key and v is not None)
    assert got == pytest.approx(want)


def test_auc_matches_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), rng.choice([round(rng.random(), 2), rng.random(), 0.0])) for _ in range(400)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    frame = spark.createDataFrame(rows, "y int, p double")
    assert ranks.roc_auc(frame, [], "y", "p").first().roc_auc == pytest.approx(want)
    assert ranks.roc_auc(frame.where("y = 1"), [], "y", "p").first().roc_auc is None


def test_samples_have_exact_sizes(spark):
    rows = spark.createDataFrame([(i, "positive" if i < 30 else "negative") for i in range(130)], "id bigint, label string")
    assert by(training.undersample(rows, "label", "id").groupBy("label").count(), "label", "count") == {"positive": 30, "negative": 30}
    split = training.stratified_test(rows, "label", "id").groupBy("label").agg(F.count_if("is_test").alias("n"))
    assert by(split, "label", "n") == {"positive": 6, "negative": 20}


def test_numbers_are_consecutive_over_blocks(spark):
    rows = spark.createDataFrame([(s,) for s in (5, 70_000, 3, 9_000_000_000, 65_536, 65_535)], "seq bigint")
    got = by(tables.number_rows(rows, "seq", 11, "n"), "seq", "n")
    assert [got[s] for s in sorted(got)] == list(range(11, 17))


def test_numbers_of_sparse_values(spark):
    values = [i * 3_000_000_017 - 500 * 3_000_000_017 for i in range(1000)]
    rows = spark.createDataFrame([(s,) for s in values], "seq bigint")
    got = by(tables.number_rows(rows, "seq", 1, "n"), "seq", "n")
    assert [got[s] for s in values] == list(range(1, 1001))


def test_upsert_keeps_keys_unique(spark):
    target = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "k string, v int, seq int")
    changes = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", 4, 1), ("c", 4, 1)], "k string, v int, seq int")
    assert by(tables.upsert(target, changes, ["k"]), "k", "v") == {"a": 3, "b": 1, "c": 4}
    first = tables.upsert(target, changes, ["k"], F.col("seq"))
    assert by(first, "k", "v") == {"a": 2, "b": 1, "c": 4} and first.count() == 3


def test_broken_models_fail_unless_skipped(spark):
    def broken(texts):
        raise RuntimeError("no model")

    rows = spark.createDataFrame([("some text", "en")], "text string, lang string")
    with pytest.raises(Exception, match="no model"):
        scoring.score_texts(rows, english=broken).collect()
    assert scoring.score_texts(rows, english=broken, skip_errors=True).first().method == "rule-only"


def test_exact_quantiles(spark):
    values = [0.5, 1.25, 1.25, 3.0, 8.5, 20.0, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for q in (0.0, 0.3, 0.5, 0.9, 1.0):
        want = rows.agg(F.percentile("v", F.lit(q)).alias("p")).first().p
        assert abs(ranks.quantile(rows, "v", q).first()["quantile"] - want) < 1e-12


NAMES = [("NVO", "novo-nordisk"), ("NVO", "novo"), ("CPP", "c++"), ("GME", "game stop"), ("UML", "über"), ("RHM.DE", "rhm.de"), ("TAG", "#tag"), ("END", "end.")]
TEXTS = ["novo-nordisk rises", "Novo nordisk", "c++ and c++x, xc++", "GAME  stop", "the game stop!", "(game stop)", "über", "xüber ober", "RHM.DE.", "rhm.dex", "a#tag ##tag", "#tag", "the end.", "end.x", "$end. y", "x$end.", "novo_x novox", "", "c++"]


def _bucket_rule(alias, text):
    return re.search(rf"(?<![A-Za-z0-9]){re.escape(alias)}(?![A-Za-z0-9])", text, re.I)


def _trend_rule(alias, text):
    a = re.escape(alias)
    return re.search(rf"(?<!\w)[$#]{a}(?!\w)", text, re.I) or re.search(rf"\b{a}\b", text, re.I)


@pytest.mark.parametrize("rule,test", [("bucket", _bucket_rule), ("trend", _trend_rule)])
def test_alias_matches_equal_patterns(spark, rule, test):
    rng = random.Random(3)
    parts = ["novo", "-", "nordisk", " ", "c++", "c", "+", "game", "stop", "ü", "ber", "rhm.de", "#", "tag", "$", "end", ".", "x", "_", "7", "\n"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(1500)]
    posts = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    names = spark.createDataFrame(NAMES, "symbol string, alias string")
    got = {(r.id, r.symbol) for r in mentions.alias_matches(posts, names, rule, ["id"]).collect()}
    want = {(i, s) for i, t in enumerate(texts) for s, a in NAMES if test(a, t)}
    assert got == want


def test_exchange_forms_share_names(spark):
    posts = spark.createDataFrame([("1", datetime(2024, 1, 1), "t", "Rheinmetall up", 1, 0)], "id string, created_utc timestamp, title string, text string, upvotes int, num_comments int")
    aliases = spark.createDataFrame([("RHM.DE", "rheinmetall")], "ticker string, alias string")
    symbols = spark.createDataFrame([("rhm",)], "ticker string")
    rows = mentions.bucket_posts(posts, symbols, aliases).collect()
    assert [(r.ticker, r.id, r.text) for r in rows] == [("RHM", "1", "t\nRheinmetall up")]


def test_candidate_symbols(spark):
    posts = spark.createDataFrame([("$AAPL to the moon",), ("I also like TSLA",), ("#tsla future",)], "text string")
    assert by(mentions.candidate_symbols(posts), "symbol", "total", "cashtag") == {"AAPL": (1, 1), "TSLA": (2, 1)}


AS_OF = datetime(2024, 1, 8)


def test_tag_words_count_only_inside_the_look_back(spark):
    hours = lambda h: AS_OF - timedelta(hours=h)
    posts = [("1", hours(1), "abc here"), ("2", hours(2), "more ABC"), ("3", hours(140), "$ABC")]
    named = spark.createDataFrame([("X", "x")], "symbol string, alias string")
    found = mentions.symbol_mentions(spark.createDataFrame(posts, POSTS), named)
    counts = trends.mention_counts(found, AS_OF, [(3, 24), (7, 24)]).where("symbol = 'ABC'")
    assert by(counts, "grid_no", "recent", "base") == {0: (None, 0.0), 1: (2.0, 1.0)}


def test_trend_scan_formula(spark):
    posts = [(str(i), AS_OF - timedelta(hours=i % 20), "$HOT now") for i in range(25)]
    posts += [(f"b{i}", AS_OF - timedelta(hours=30 + i), "HOT") for i in range(4)]
    named = spark.createDataFrame([("HOT", "HOT")], "symbol string, alias string")
    found = mentions.symbol_mentions(spark.createDataFrame(posts, POSTS), named)
    row = trends.trend_scan(found, named, AS_OF).first()
    rate = 4.5 / (144 + 0.5)
    assert (row.symbol, row.mentions, row.is_known) == ("HOT", 25, True)
    assert row.lift == pytest.approx(25 / (rate * 24)) and row.trend == pytest.approx(row.lift * np.log1p(25))


def test_spikes(spark):
    rows = [("AAA", AS_OF - timedelta(hours=h)) for h in (1, 2, 3)] + [("BBB", AS_OF - timedelta(days=d)) for d in (2, 3)]
    got = trends.spikes(spark.createDataFrame(rows, "ticker string, created_utc timestamp"), AS_OF)
    assert [r.ticker for r in got.collect()] == ["AAA"]


def test_weekly_return(spark):
    rows = [(AS_OF.date() - timedelta(days=7), "X", 102.0), (AS_OF.date(), "X", 112.0), (AS_OF.date(), "ONE", 5.0)]
    got = by(prices.weekly_returns(spark.createDataFrame(rows, "date date, ticker string, close double")), "ticker", "weekly_return")
    assert got == {"X": pytest.approx(112 / 102 - 1)}


def test_auto_watchlist(spark):
    candidates = spark.createDataFrame([("HOT", 40, 0.1, 5.0, 9.0), ("LOW", 40, 0.1, 1.0, 8.0)], "symbol string, mentions_24h int, baseline_rate_per_h double, lift double, trend double")
    empty = spark.createDataFrame([], schemas.DDL["watchlist"])
    row = trends.auto_watchlist(candidates, empty, candidates, "DEFAULT:10:2").collect()
    assert [(r.chat_id, r.symbol, r.note) for r in row] == [("_GLOBAL_", "HOT", "auto-added 40 m24h, lift 5.0, trend 9.00")]


def test_rules_skip_bad_ones():
    assert trends.parse_rules(".*.DE:15:2.5,DEFAULT:25:3.5,x,a:b:c,[:1:1") == [(".*.DE", 15, 2.5), (None, 25, 3.5)]


def test_backtest_and_signal(spark):
    rows = [(date(2024, 1, i + 1), "X", c, s) for i, (c, s) in enumerate(((10.0, 1), (11.0, 0), (12.0, 1), (11.0, 0)))]
    got = evaluation.backtest(spark.createDataFrame(rows, "date date, ticker string, close double, signal int")).first()
    assert got.avg_strategy_return == pytest.approx((1 / 10 - 1 / 12) / 2) and got.long_trades == 2
    frame = spark.createDataFrame([(0.8,), (0.2,), (0.5,), (None,)], "p double")
    shown = [tuple(r.s) for r in frame.select(evaluation.trade_signal("p", F.lit(0.6)).alias("s")).collect()]
    assert shown[0] == ("buy", 0.8, pytest.approx(0.2)) and shown[1] == ("sell", 0.8, pytest.approx(0.2))
    assert shown[2] == ("hold", 0.5, pytest.approx(0.1)) and shown[3] == (None, None, None)


def test_alerts(spark):
    empty = spark.createDataFrame([], schemas.DDL["alerts"])
    adds = spark.createDataFrame([("nvda", ">", 100.0, 1), ("AMZN", "<", 50.0, 2), ("BAD", "==", 1.0, 3)], "ticker string, op string, price double, seq bigint")
    table = lists.put_alerts(empty, adds)
    assert by(table, "ticker", "id", "active") == {"NVDA": (1, True), "AMZN": (2, True)}
    assert [r.ticker for r in lists.rejected_alerts(adds).collect()] == ["BAD"]
    off = lists.switch_alerts(table, spark.createDataFrame([(1,)], "id bigint"), False)
    assert [r.ticker for r in lists.active_alerts(off).collect()] == ["AMZN"]
    more = spark.createDataFrame([("NVDA", "<", 7.0, 1), ("NEW", ">", 1.0, 2)], "ticker string, op string, price double, seq bigint")
    assert by(lists.put_alerts(off, more), "ticker", "id", "op", "active") == {"NVDA": (1, "<", True), "AMZN": (2, "<", True), "NEW": (3, ">", True)}
    rules = spark.createDataFrame([(1, "ABC", 100.0, "above"), (2, "XYZ", 50.0, "below"), (3, "NO", 1.0, "above")], "id int, ticker string, threshold double, direction string")
    latest = spark.createDataFrame([("ABC", 150.0), ("XYZ", 60.0)], "ticker string, price double")
    assert by(lists.judge_thresholds(rules, latest), "ticker", "triggered") == {"ABC": True, "XYZ": False, "NO": False}
    with pytest.raises(ValueError):
        lists.check_op("==")


def test_watchlist(spark):
    empty = spark.createDataFrame([], schemas.DDL["watchlist"])
    kind = "chat_id string, symbol string, note string, seq int"
    adds = spark.createDataFrame([("1", "aapl", "tech", 1), ("1", " msft", "tech", 2), ("2", "msft", None, 3), ("2", "goog", None, 4), ("1", "", None, 5)], kind)
    table = lists.add_to_watchlist(empty, adds)
    assert {r.symbol for r in lists.watched_symbols(table).collect()} == {"AAPL", "GOOG", "MSFT"}
    left, removed = lists.remove_from_watchlist(table, spark.createDataFrame([("1", "aapl"), ("1", "zzz")], "chat_id string, symbol string"))
    assert removed.first().removed == 1 and left.count() == 3
    again = lists.add_to_watchlist(table, spark.createDataFrame([("1", "MSFT", "new", 1)], kind))
    assert by(lists.watched_symbols(again, "1"), "symbol", "note") == {"AAPL": "tech", "MSFT": "new"}


def test_summary_ignores_bad_scores(spark):
    rows = [("X", "0.5"), ("X", "-0.1"), ("X", "0.1"), ("X", "0.2"), ("Y", None), ("Y", "nan"), ("Y", "abc")]
    got = by(rollups.bucket_summary(spark.createDataFrame(rows, "ticker string, sentiment string")), "ticker", "mean", "median", "valid", "total")
    assert got["X"] == (pytest.approx(0.175), pytest.approx(0.15), 4, 4) and got["Y"] == (None, None, 0, 3)


def test_missing_votes_do_not_spoil_the_mean(spark):
    rows = [("X", datetime(2024, 1, 1), 0.4, float("nan"), float("nan")), ("X", datetime(2024, 1, 1), 0.2, 5.0, 0.0)]
    got = rollups.daily_sentiment_stats(spark.createDataFrame(rows, "ticker string, created_utc timestamp, sentiment double, upvotes double, num_comments double")).first()
    assert got.n_posts == 2 and 0.2 < got.sentiment_weighted < 0.4


def test_increment(spark):
    friday = date(2024, 1, 5)
    bars = spark.createDataFrame([(friday, "OLD", 1.0), (friday - timedelta(days=3), "LATE", 1.0)], "date date, ticker string, close double")
    symbols = spark.createDataFrame([("OLD",), ("LATE",), ("NEW",)], "ticker string")
    starts = tables.next_start(bars, symbols)
    sunday = friday + timedelta(days=2)
    assert {r.ticker for r in tables.due_symbols(starts, sunday).collect()} == {"LATE", "NEW"}
    loaded = spark.createDataFrame([(friday, "OLD", 2.0), (friday - timedelta(days=1), "OLD", 2.0), (friday, "LATE", 2.0), (date(1999, 1, 1), "NEW", 2.0)], "date date, ticker string, close double")
    assert sorted(r.ticker for r in tables.new_rows(loaded, starts, sunday).collect()) == ["LATE", "NEW", "OLD"]
    assert by(tables.next_start(bars, symbols, date(2020, 1, 1)), "ticker", "start_date")["OLD"] == date(2020, 1, 1)


def test_purge_and_schema(spark):
    rows = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 2, 10),)], "date date")
    assert tables.purge(rows, "date", date(2024, 2, 10), 30).count() == 1
    with pytest.raises(ValueError):
        schemas.assert_columns(rows, "prices")


def test_features_match_pandas(spark):
    rng = np.random.default_rng(4)
    n = 40
    pdf = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=n, freq="2D").date, "ticker": "X"})
    pdf["close"], pdf["sentiment"] = 100 + rng.normal(size=n).cumsum(), rng.normal(size=n)
    got = features.feature_frame(spark.createDataFrame(pdf)).orderBy("date").toPandas()
    c, s = pd.concat([pdf["close"], pd.Series([np.nan])], ignore_index=True), pd.concat([pdf["sentiment"], pd.Series([0.0])], ignore_index=True)
    r, d = c.pct_change(fill_method=None), c.diff()
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    gain, loss = d.clip(lower=0).rolling(14, min_periods=3).mean(), (-d.clip(upper=0)).rolling(14, min_periods=3).mean()
    want = {
        "close_std7": c.rolling(7, min_periods=3).std().shift(1),
        "sentiment_momentum3": s.diff().rolling(3, min_periods=1).sum().shift(1),
        "price_sentiment_corr7": r.rolling(7, min_periods=3).corr(s).shift(1),
        "return_10d": c.pct_change(10, fill_method=None).shift(1),
        "rsi": (100 - 100 / (1 + gain / loss.replace(0, np.nan))).shift(1),
        "macd_signal": macd.ewm(span=9, adjust=False).mean().shift(1),
        "bb_upper": (c.rolling(20, min_periods=5).mean() + 2 * c.rolling(20, min_periods=5).std()).shift(1),
    }
    for name, series in want.items():
        np.testing.assert_allclose(got[name], series.ffill().fillna(0), rtol=1e-8, atol=1e-9, err_msg=name)
    assert got["is_future"].sum() == 1 and got["y"].isna().sum() == 2


def test_models_are_out_of_fold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for ticker in ("A", "B"):
        move = rng.normal(size=120)
        for i in range(120):
            rows.append((ticker, date(2024, 1, 1) + timedelta(days=i), i == 119, 100.0, float(move[i]), None if i == 119 else float(move[i] + 0.3 * rng.normal() > 0), None if i == 119 else float(move[i] / 100)))
    rows += [("FLAT", date(2024, 1, 1) + timedelta(days=i), False, 1.0, 0.0, 1.0, 0.0) for i in range(20)]
    frame = spark.createDataFrame(rows, "ticker string, date date, is_future boolean, close double, x double, y double, actual_return double")
    scored = training.ticker_probabilities(frame, ["x"])
    table = by(training.evaluate_probabilities(scored), "ticker", "accuracy", "roc_auc", "evaluation_size", "signal")
    assert set(table) == {"A", "B"}
    for accuracy, auc, size, signal in table.values():
        assert 0.7 < accuracy <= 1 and 0.7 < auc <= 1 and size == 95 and signal in ("buy", "sell", "hold")


def test_training_is_skipped_for_the_same_snapshot(spark):
    kind = "ticker string, latest_price_date date, price_row_count bigint, latest_sentiment_date date, sentiment_row_count bigint, latest_post_utc timestamp"
    stored = spark.createDataFrame([("X", date(2024, 1, 1), 5, None, 0, None), ("Y", date(2024, 1, 1), 5, None, 0, None)], kind)
    now = spark.createDataFrame([("X", date(2024, 1, 1), 5, None, 0, None), ("Y", date(2024, 1, 2), 6, None, 0, None), ("Z", None, 0, None, 0, None)], kind)
    assert {r.ticker for r in training.changed_symbols(now, stored).collect()} == {"Y", "Z"}


def test_scorer_routing(spark):
    rows = spark.createDataFrame([("good", "en"), ("gut", "de"), ("", "en"), ("long call", "fr")], "text string, lang string")
    positive = lambda texts: [[{"label": "positive", "score": 0.5}] for _ in texts]

    def broken(texts):
        raise RuntimeError

    got = by(scoring.score_texts(rows, english=positive, other=broken, fallback=lambda texts: [0.9] * len(texts), skip_errors=True), "text", "score", "method")
    assert got == {"good": (0.5, "model:english"), "gut": (0.9, "fallback"), "": (0.0, "empty"), "long call": (1.0, "fallback")}
    alone = by(scoring.score_texts(rows, english=positive), "text", "method")
    assert alone["gut"] == "model:english"
    assert by(scoring.score_texts(rows), "text", "score", "method")["long call"] == (0.4, "rule-only")


def test_weekly_returns_go_to_the_first_candidates_that_have_one(spark):
    rows = [("A", 9.0, True), ("B", 8.0, True), ("C", 7.0, True), ("D", 99.0, False)]
    candidates = spark.createDataFrame(rows, "symbol string, trend double, is_known boolean").withColumns(
        {"lift": F.lit(1.0), "mentions": F.lit(5)}
    )
    weekly = spark.createDataFrame([("B", 0.1), ("C", 0.2), ("D", 0.3)], "ticker string, weekly_return double")
    got = by(trends.with_weekly_returns(candidates, weekly, 2), "symbol", "weekly_return")
    assert got == {"A": None, "B": 0.1, "C": 0.2, "D": None}


NAMED = [("A", "alpha"), ("A", "alpha beta"), ("B", "b.c"), ("C", "(gamma)"), ("D", "delta."), ("E", "the"), ("F", "of the"), ("G", "ünï")]
MIXED = [
    "Alpha beta, b.c and (gamma)", "alphabeta b.cd gamma", "of the delta. The end", "$BRK.B and #zed", "zed, brk.b! x_zed", "brk b", "ünï ünïx", "", None, "$Q-R-S q-r-s q-r",
    "delta.x (gamma)", "#alpha of  the",
]


@pytest.mark.parametrize("rule", ["bucket", "trend"])
def test_names_match_alike_by_broadcast_and_by_shuffle(spark, monkeypatch, rule):
    posts = spark.createDataFrame([(i, t) for i, t in enumerate(MIXED * 3)], "id int, text string").repartition(3)
    names = spark.createDataFrame(NAMED, "symbol string, alias string")
    few = sorted(map(tuple, mentions.alias_matches(posts, names, rule, ["id"]).collect()))
    monkeypatch.setattr(mentions, "BROADCAST_BYTES", 0)
    assert few and sorted(map(tuple, mentions.alias_matches(posts, names, rule, ["id"]).collect())) == few
    assert mentions.alias_matches(posts, names.where("false"), rule, ["id"]).count() == 0


def test_full_bitset_drops_no_word(spark, monkeypatch):
    monkeypatch.setattr(mentions, "MOST_BITS", 64)
    words = [f"w{i}" for i in range(500)]
    posts = spark.createDataFrame([(i, f"{w} other") for i, w in enumerate(words)], "id int, text string")
    names = spark.createDataFrame([(w.upper(), w) for w in words], "symbol string, alias string")
    assert mentions.alias_matches(posts, names, "trend", ["id"]).count() == 500


def test_mentions_read_texts_once(spark, monkeypatch, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(str(i), at + timedelta(hours=i), t) for i, t in enumerate(MIXED)]
    spark.createDataFrame(rows, "id string, created_utc timestamp, text string").write.parquet(str(tmp_path / "posts"))
    posts = spark.read.parquet(str(tmp_path / "posts"))
    names = spark.createDataFrame(NAMED, "symbol string, alias string")
    plan = mentions.postings(posts.withColumn("weight", F.lit(1.0)), names, ["id", "created_utc", "weight"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text#") and plan.count("Relation [id#") == 1
    got = {(r.id, r.symbol): r.tagged_at for r in mentions.symbol_mentions(posts, names).collect()}
    # Tags count everywhere, as words too, also those with signs inside.
    expected = {("3", "BRK.B"): None, ("3", "ZED"): None, ("4", "ZED"): at + timedelta(hours=3), ("4", "BRK.B"): at + timedelta(hours=3), ("9", "Q-R-S"): None}
    assert {k: v for k, v in got.items() if k[1] in ("BRK.B", "ZED", "Q-R-S")} == expected
    monkeypatch.setattr(mentions, "BROADCAST_BYTES", 0)
    assert {(r.id, r.symbol): r.tagged_at for r in mentions.symbol_mentions(posts, names).collect()} == got


@pytest.mark.parametrize("block_days", [5, 1024])
def test_recursive_means_equal_pandas(spark, monkeypatch, block_days):
    monkeypatch.setattr(features, "BLOCK_DAYS", block_days)
    rng = random.Random(8)
    start = date(2015, 1, 1)
    rows = []
    for ticker, n in (("A", 1), ("B", 60), ("C", 900), ("D", 40)):
        day = start
        for i in range(n):
            day += timedelta(days=rng.choice([1, 1, 3, 9]))
            gap = ticker == "D" and (i < 4 or rng.random() < 0.4) or rng.random() < 0.02
            rows.append((ticker, day, None if gap else rng.uniform(-5, 100)))
    df = spark.createDataFrame(rows, "ticker string, date date, close double").repartition(4)
    got = features.with_recursive_means(df, {"m": ("close", 12), "s": ("close", 26)})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") == 1 and plan.count("Sort [") == 1 and "Python" not in plan
    for ticker, days in got.toPandas().sort_values("date").groupby("ticker"):
        for name, span in (("m", 12), ("s", 26)):
            want = days["close"].astype(float).ewm(span=span, adjust=False).mean()
            np.testing.assert_allclose(days[name].astype(float), want, rtol=1e-11, atol=1e-11)
    assert features.with_macd(df.where("false")).count() == 0


def test_latest_rows_settle_equal_times(spark):
    at, rows = datetime(2024, 1, 2), []
    for signal, confidence in (("buy", 0.4), ("sell", 0.1), ("sell", None), ("hold", 0.9)):
        rows.append(("X", at, signal, confidence))
    rows += [("X", at - timedelta(days=1), "zero", 1.0), ("X", None, "zero", 1.0), ("Y", None, "buy", 1.0)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        made = spark.createDataFrame(order, "ticker string, as_of timestamp, signal string, confidence double").coalesce(1)
        got = by(prices.latest_rows(made, ["ticker"], "as_of"), "ticker", "as_of", "signal", "confidence")
        assert got == {"X": (at, "sell", 0.1), "Y": (None, None, None)}


def test_names_that_begin_alike_meet_only_texts_they_stand_in(spark):
    names = spark.createDataFrame([(f"S{i}", f"the w{i}") for i in range(800)], "symbol string, alias string")
    posts = spark.createDataFrame([(i, "the other, the w7 the  w8 w9") for i in range(20)], "id int, text string")
    prepared = mentions._Names(mentions.alias_patterns(names, "bucket"))
    places = mentions._candidates(posts, prepared, "bucket", ["id"]).select("id", F.explode_outer(mentions._places(prepared)).alias("p"))
    assert places.where("p IS NOT NULL").count() == 20
    assert {r.symbol for r in mentions.alias_matches(posts, names, "bucket", ["id"]).collect()} == {"S7"}


def test_posts_and_their_tags_are_not_shuffled_word_by_word(spark):
    at = datetime(2024, 1, 1)
    rows = [(str(i), at + timedelta(hours=i), t) for i, t in enumerate(MIXED)]
    names = spark.createDataFrame(NAMED, "symbol string, alias string")
    posts = spark.createDataFrame(rows, "id string, created_utc timestamp, text string")
    tags = spark.createDataFrame([("ZED", at)], "symbol string, tagged_at timestamp")
    found = mentions.tag_words(posts, tags, ["id"])
    assert sorted(map(tuple, found.collect())) == [("4", "ZED", at)]
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    once = {tuple(r) for r in mentions.symbol_mentions(posts, names).collect()}
    # A post that comes twice counts once, also with other texts.
    other = spark.createDataFrame([("3", at + timedelta(hours=3), "$zed zed"), ("4", at + timedelta(hours=4), "again zed")], posts.schema)
    twice = mentions.symbol_mentions(posts.unionByName(posts).unionByName(other), names).collect()
    assert len(twice) == len(once) and {tuple(r) for r in twice} == once


def test_large_tag_tables_meet_words_by_a_shuffle(spark, monkeypatch):
    at = datetime(2024, 1, 1)
    posts = spark.createDataFrame([(str(i), f"w{i % 7} Tag{i} tag{i} #tag{i + 1}") for i in range(50)], "id string, text string")
    tags = spark.createDataFrame([(f"TAG{i}", at) for i in range(50)], "symbol string, tagged_at timestamp")
    few = sorted(map(tuple, mentions.tag_words(posts, tags, ["id"]).collect()))
    monkeypatch.setattr(mentions, "TAG_BYTES", 0)
    assert few == sorted((str(i), f"TAG{i}", at) for i in range(50))
    assert sorted(map(tuple, mentions.tag_words(posts, tags, ["id"]).collect())) == few


def test_words_get_their_normal_form_once(spark, tmp_path):
    texts = ["$abc, x.y;\nZed the abc", "#Brk.b! brk-b 12 \tq.\n", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows.withColumns({c: F.lit(c) for c in ("source", "lang")}).write.parquet(str(tmp_path / "documents.parquet"))
    strict, loose = (catalog.QUERIES[name](spark, str(tmp_path)) for name in ("sym4", "sym5"))
    assert by(strict, "symbol", "n") == {"ABC": 2, "BRK.B": 1, "Q": 1}
    assert by(loose, "symbol", "n") == {"ABC": 2, "BRK.B": 1, "BRK-B": 1, "Q": 1}
    for got in (strict, loose):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and "upper" in line]


def _ticker_rows(spark):
    rng, rows = random.Random(9), []
    for ticker, n in (("A", 1), ("B", 90), (None, 6), ("C", 30), ("D", 4)):
        for i in range(n):
            odd = rng.choice([None, 0.0, float("nan")]) if ticker == "C" else rng.choice([None, 5.0, 5.0])
            values = [odd if rng.random() < 0.2 else rng.uniform(-5, 100) for _ in range(3)]
            rows.append((ticker, date(2024, 1, 1) + timedelta(days=2 * i), *values))
    return spark.createDataFrame(rows, "ticker string, date date, close double, sentiment double, volume double").repartition(4)


def _windows():
    """The features as sliding windows."""
    back = lambda n: prices.by_day().rowsBetween(-n, -1)
    over = lambda agg, c, n, least: F.when(F.count(c).over(back(n)) >= least, agg(c).over(back(n)))
    pair = F.when(F.col("_ret").isNotNull(), F.col("sentiment"))
    spread = F.stddev_pop("_ret").over(back(7)) * F.stddev_pop(pair).over(back(7))
    varies = [F.max(c).over(back(7)) > F.min(c).over(back(7)) for c in (F.col("_ret"), pair)]
    corr = F.try_divide(F.covar_pop("_ret", "sentiment").over(back(7)), spread)
    close = lambda k: F.lag("close", k).over(prices.by_day())
    gain, loss = over(F.avg, "_gain", 14, 3), over(F.avg, "_loss", 14, 3)
    return {
        "volume_lag2": F.lag("volume", 2).over(prices.by_day()),
        "close_ma3": over(F.avg, "close", 3, 1),
        "close_std7": over(F.stddev_samp, "close", 7, 3),
        "sentiment_std3": over(F.stddev_samp, "sentiment", 3, 2),
        "sentiment_momentum7": over(F.sum, "_dsent", 7, 1),
        "return_10d": F.try_divide(close(1), close(11)) - 1,
        "price_sentiment_corr7": F.when((F.count("_ret").over(back(7)) >= 3) & varies[0] & varies[1], corr),
        "rsi": 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(gain, loss)),
        "bb_lower": over(F.avg, "close", 20, 5) - 2 * over(F.stddev_samp, "close", 20, 5),
    }


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_features_equal_windows(spark, batch):
    stepped, windows = features.stepped_frame(_ticker_rows(spark)), _windows()
    groups = features.feature_groups(stepped)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        key = lambda r: (str(r.ticker), r.date)
        got = sorted(features.feature_rows(stepped, {n: groups[n] for n in windows}).collect(), key=key)
        want = sorted(stepped.select("ticker", "date", *[w.alias(n) for n, w in windows.items()]).collect(), key=key)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == len(want) == 136 and [key(r) for r in got] == [key(r) for r in want]
    for a, b in zip(got, want):
        for name in windows:
            assert (a[name] is None) == (b[name] is None), (a, b, name)
            if b[name] is not None:
                assert a[name] == pytest.approx(b[name], rel=1e-12, abs=1e-12, nan_ok=True), (a, b, name)


def test_feature_frame_adds_up_no_sliding_windows(spark):
    wide = features.feature_frame(_ticker_rows(spark))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "RowFrame, -7" not in plan and "RowFrame, -3" not in plan and plan.count("Exchange hashpartitioning(ticker") == 1


def test_bucket_posts_score_a_post_once(spark):
    at, calls = datetime(2024, 1, 1), spark.sparkContext.accumulator(0)

    def score(text):
        @F.pandas_udf("double")
        def length(texts: pd.Series) -> pd.Series:
            calls.add(len(texts))
            return texts.str.len().astype(float)

        return length(text)

    rows = [("1", at, "t", "aa bb cc", 1, 1), ("1", at, "t", "aa again", 1, 1), ("2", at, "t", "cc", 1, 1), ("3", at, "t", "none", 1, 1)]
    posts = spark.createDataFrame(rows, "id string, created_utc timestamp, title string, text string, upvotes int, num_comments int")
    names = spark.createDataFrame([(n.upper(), n) for n in ("aa", "bb", "cc")], "ticker string, alias string")
    got = mentions.bucket_posts(posts, names.select("ticker"), names, score=score)
    assert got.columns == ["ticker", "id", "created_utc", "text", "upvotes", "num_comments", "sentiment"]
    want = [(s, "1", n) for s in ("AA", "BB", "CC") for n in (10.0, 10.0)] + [("CC", "2", 4.0)]
    assert sorted((r.ticker, r.id, r.sentiment) for r in got.collect()) == want and calls.value == 3


def test_market_frame_is_joined_where_trades_were_dealt_to(spark, tmp_path):
    from symbolpulse.plans import feature_queries, views

    day = datetime(2024, 1, 1)
    rows = [(i, 1, s, i, 2.0, 100.0 + i, 0.01 * i, d) for i, (s, d) in enumerate([(1, day), (1, day), (2, day), (1, day + timedelta(days=1)), (None, day), (2, None)])]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp"
    spark.createDataFrame([*rows, rows[0]], kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    key = lambda r: str(tuple(r))
    for view in (views.prices, views.market_daily):
        assert sorted(view(spark, str(tmp_path), dealt=True).collect(), key=key) == sorted(view(spark, str(tmp_path)).collect(), key=key)
    frame = feature_queries.frame(spark, str(tmp_path))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("REPARTITION_BY_COL") == 2
    got = {(r.ticker, str(r.date)): (r.open, r.close, r.volume, r.sentiment) for r in frame.collect()}
    assert got[("S1", "2024-01-01")] == (100.0, 101.0, 6, pytest.approx(-0.933333)) and len(got) == 5


def test_gathered_rows_share_one_shuffle(spark):
    day = date(2024, 1, 1)
    rows = [("A", day, 1.5, 2, True), ("A", day, 1.5, 2, True), ("A", None, None, None, None), ("B", day, -0.0, 2**40, False), (None, day, 3.0, 1, None)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, posts long, flag boolean")
    got = tables.gathered(df, ["ticker"], ["date", "close", "posts", "flag"])
    assert got.dtypes == df.dtypes and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    last = got.where("flag").groupBy("ticker").agg(F.max("close").alias("last"))
    move = got.select("ticker", (F.col("close") - F.lag("close").over(prices.by_day())).alias("move"))
    plan = last.join(move.hint("merge"), "ticker")
    assert len(plan.collect()) == 3
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("Exchange hashpartitioning" in line and "Reused" not in line for line in text.splitlines()) == 1


def test_overview_makes_bars_once(spark, tmp_path):
    day = datetime(2001, 6, 10)
    tables_ = {
        "supplier": ([(i, i, 100.0 * i) for i in range(4)], "s_suppkey long, s_nationkey int, s_acctbal double"),
        "customer": ([(i, f"c{i}", i % 4, "AUTO") for i in range(8)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "part": ([(i, 5 + i, "ECONOMY") for i in range(6)], "p_partkey long, p_size int, p_type string"),
        "orders": ([(datetime(2001, 5 + i % 2, 1), 150000.0 + i) for i in range(4)], "o_orderdate timestamp, o_totalprice double"),
        "lineitem": (
            [(i, 1 + i % 9, i % 4, 1, 5.0, 100.0 + i, 0.01 * (i % 9), day - timedelta(days=i // 8)) for i in range(160)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp",
        ),
    }
    for name, (rows, kind) in tables_.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = catalog.QUERIES["ovw2"](spark, str(tmp_path))
    # The line items of posts are left in the plan, not those of bars.
    assert "l_extendedprice" not in got._jdf.queryExecution().executedPlan().toString()
    closes = {r.ticker: (r.price_usd, round(r.change_1d_pct, 3)) for r in got.collect()}
    assert closes == {f"S{i}": (104.0 + i, round(100 * (104 + i) / (112 + i) - 100, 3)) for i in range(4)}


def test_many_names_meet_texts_in_one_shuffle(spark, monkeypatch):
    texts = ["the red fox and the red fox", "a red  fox, the red fox", "the red", "red fox the", "(the red) fox", None, "", "Fox"]
    posts = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "id int, text string")

    def found(names, small):
        monkeypatch.setattr(mentions, "BROADCAST_BYTES", 1 << 20 if small else 0)
        table = spark.createDataFrame([(n.upper(), n) for n in names], "symbol string, alias string")
        return {rule: mentions.alias_matches(posts, table, rule, ["id"]) for rule in ("bucket", "trend")}

    bare = ["the red", "red fox", "the red fox", "fox"]
    for names in (bare, [*bare, "(the red)", "fox,"]):
        for rule, hits in found(names, True).items():
            want = sorted(map(tuple, hits.collect()))
            assert len(want) > 4 and want == sorted(map(tuple, found(names, False)[rule].collect()))
    plan = found(bare, False)["bucket"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 3  # names, places, hits
