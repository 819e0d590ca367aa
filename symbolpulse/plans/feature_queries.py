"""Feature groups, metrics, thresholds, signals and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.fixed_values import DUAL_GRID, F1_GRID
from ..operators import evaluation, features, ranks, storage, training
from . import views as V
from .registry import query
from .rounding import rounded

# Rows with future row and steps; "@" stands for the window frame of the n rows before.
STEPS = """
    base AS (
        SELECT p.ticker, p.date, CAST(open AS DOUBLE) AS open, high, low, close, CAST(volume AS DOUBLE) AS volume,
               coalesce(m.sentiment, 0) AS sentiment, FALSE AS is_future
        FROM prices p LEFT JOIN market_daily m USING (ticker, date)),
    rows_ AS (
        SELECT * FROM base UNION ALL
        SELECT ticker, max(date) + 1, NULL, NULL, NULL, NULL, NULL, 0, TRUE FROM base GROUP BY 1),
    steps AS (
        SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, sentiment - lag(sentiment) OVER w AS dsent,
               volume / nullif(lag(volume) OVER w, 0) - 1 AS dvol, close - lag(close) OVER w AS move
        FROM rows_ WINDOW w AS (PARTITION BY ticker ORDER BY date))"""


def _w(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _agg(fn: str, column: str, n: int, least: int) -> str:
    return f"CASE WHEN count({column}) OVER {_w(n)} >= {least} THEN {fn}({column}) OVER {_w(n)} END"


def _lag(column: str, k: int = 1) -> str:
    return f"lag({column}, {k}) OVER (PARTITION BY ticker ORDER BY date)"


def _lags(c: str) -> dict[str, str]:
    return {f"{c}_lag{k}": _lag(c, k) for k in (1, 2, 3)}


def _rolling(c: str) -> dict[str, str]:
    return {
        f"{c}_ma3": _agg("avg", c, 3, 1),
        f"{c}_std3": _agg("stddev_samp", c, 3, 2),
        f"{c}_ma7": _agg("avg", c, 7, 3),
        f"{c}_std7": _agg("stddev_samp", c, 7, 3),
    }


COLUMNS = ["close", "sentiment", "open", "high", "low", "volume"]
GAIN = "CASE WHEN move IS NOT NULL THEN greatest(move, 0) END"
LOSS = "CASE WHEN move IS NOT NULL THEN greatest(-move, 0) END"
_PAIRS = _w(7)
GROUPS_SQL: dict[str, dict[str, str]] = {
    "win1": {k: v for c in COLUMNS for k, v in _lags(c).items()},
    "win2": {k: v for c in COLUMNS for k, v in _rolling(c).items()},
    "win3": {f"return_{k}d": f"{_lag('close')} / nullif({_lag('close', k + 1)}, 0) - 1" for k in (1, 3, 5, 10)},
    "win4": {
        "sentiment_change1": _lag("dsent"),
        "sentiment_momentum3": _agg("sum", "dsent", 3, 1),
        "sentiment_momentum7": _agg("sum", "dsent", 7, 1),
    },
    "win5": {"volatility_7d": _agg("stddev_samp", "ret", 7, 2), "return_momentum7": _agg("sum", "ret", 7, 2)},
    "win6": {
        "price_sentiment_corr7": f"""CASE WHEN count(ret) OVER {_PAIRS} >= 3
            AND max(ret) OVER {_PAIRS} > min(ret) OVER {_PAIRS}
            AND max(CASE WHEN ret IS NOT NULL THEN sentiment END) OVER {_PAIRS}
              > min(CASE WHEN ret IS NOT NULL THEN sentiment END) OVER {_PAIRS}
            THEN corr(ret, sentiment) OVER {_PAIRS} END"""
    },
    "win7": {"volume_change1": _lag("dvol"), "volume_momentum3": _agg("avg", "dvol", 3, 1)},
    "win8": {
        "rsi": f"""100 - 100 / (1 + CASE WHEN count(move) OVER {_w(14)} >= 3 THEN avg({GAIN}) OVER {_w(14)} END
            / nullif(CASE WHEN count(move) OVER {_w(14)} >= 3 THEN avg({LOSS}) OVER {_w(14)} END, 0))"""
    },
    "win10": {
        "bb_middle": _agg("avg", "close", 20, 5),
        "bb_upper": f"{_agg('avg', 'close', 20, 5)} + 2 * {_agg('stddev_samp', 'close', 20, 5)}",
        "bb_lower": f"{_agg('avg', 'close', 20, 5)} - 2 * {_agg('stddev_samp', 'close', 20, 5)}",
    },
}


def _digits(name: str) -> int:
    """Prices and volumes compare to four digits, ratios to six."""
    big = ("close_", "open_", "high_", "low_", "volume_lag", "volume_ma", "volume_std", "bb_", "macd", "rsi")
    return 4 if name.startswith(big) else 6


# Means of cents end in exact halves; the shift keeps both engines on one side.
HALF = 0.501


def _round_sql(expr: str, name: str) -> str:
    scale = f"1e{_digits(name)}"
    return f"floor(({expr}) * {scale} + {HALF}) / {scale} AS {name}"


def _group_sql(exprs: dict[str, str]) -> str:
    shown = ", ".join(_round_sql(e, n) for n, e in exprs.items())
    return f"WITH {STEPS} SELECT ticker, date, {shown} FROM steps"


def _filled(name: str) -> str:
    last = (
        f"coalesce(last_value({name} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"
    )
    return _round_sql(last, name)


def frame(spark, sf):
    """Bars with sentiment, joined where the line items of a ticker and day were dealt to."""
    return features.join_sentiment(V.prices(spark, sf, dealt=True).drop("adj_close"), V.market_daily(spark, sf, dealt=True))


def _shown(name, values):
    scale = 10.0 ** _digits(name)
    return np.floor(values * scale + HALF) / scale


def _group(name: str, columns) -> None:
    @query(name, _group_sql(GROUPS_SQL[name]), "prices market_daily", dates="date")
    def run(spark, sf):
        return features.feature_rows(features.stepped_frame(frame(spark, sf)), columns(), shown=_shown)


_group("win1", lambda: {k: v for c in COLUMNS for k, v in features.lag_features(c).items()})
_group("win2", lambda: {k: v for c in COLUMNS for k, v in features.rolling_features(c).items()})
_group("win3", features.return_features)
_group("win4", features.sentiment_features)
_group("win5", features.volatility_features)
_group("win6", features.correlation_feature)
_group("win7", features.volume_features)
_group("win8", features.rsi_feature)
_group("win10", features.band_features)

MACD = """
    n AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM base),
    e AS (
        SELECT ticker, date, rn, close AS fast, close AS slow, CAST(0 AS DOUBLE) AS sig FROM n WHERE rn = 1
        UNION ALL
        SELECT ticker, date, rn, fast, slow, sig + 0.2 * ((fast - slow) - sig) FROM (
            SELECT n.ticker, n.date, n.rn, e.fast + 2.0 / 13.0 * (n.close - e.fast) AS fast,
                   e.slow + 2.0 / 27.0 * (n.close - e.slow) AS slow, e.sig
            FROM e JOIN n ON n.ticker = e.ticker AND n.rn = e.rn + 1)),
    m AS (SELECT r.ticker, r.date, lag(fast - slow) OVER w AS macd, lag(sig) OVER w AS macd_signal
          FROM rows_ r LEFT JOIN e USING (ticker, date) WINDOW w AS (PARTITION BY ticker ORDER BY r.date))"""


@query(
    "win9",
    f"""WITH RECURSIVE {STEPS}, {MACD}
    SELECT ticker, date, {_round_sql('macd', 'macd')}, {_round_sql('macd_signal', 'macd_signal')},
           {_round_sql('(macd - macd_signal)', 'macd_hist')} FROM m""",
    "prices market_daily",
    dates="date",
)
def win9(spark, sf):
    return features.feature_rows(features.stepped_frame(frame(spark, sf)), features.macd_features(), shown=_shown)


@query(
    "win11",
    f"""
    WITH {STEPS}, f AS (SELECT *, {GROUPS_SQL['win8']['rsi']} AS rsi FROM steps)
    SELECT ticker, date, {_filled('rsi')} FROM f""",
    "prices market_daily",
    dates="date",
)
def win11(spark, sf):
    stepped = features.stepped_frame(frame(spark, sf))
    return features.feature_rows(stepped, features.rsi_feature(), fill=True, shown=_shown)


_LABELS = f"""
    WITH {STEPS}
    SELECT ticker, date, is_future,
           CASE WHEN close IS NOT NULL AND lead(close) OVER w IS NOT NULL
                THEN CAST(lead(close) OVER w > close AS DOUBLE) END AS y,
           lead(close) OVER w / nullif(close, 0) - 1 AS actual_return
    FROM steps WINDOW w AS (PARTITION BY ticker ORDER BY date)"""


@query(
    "win12",
    f"SELECT ticker, date, y, round(actual_return, 6) AS actual_return FROM ({_LABELS})",
    "prices market_daily",
    dates="date",
)
def win12(spark, sf):
    stepped = features.stepped_frame(frame(spark, sf)).withColumns(features.labels())
    return rounded(stepped.select("ticker", "date", "y", "actual_return"))


@query(
    "win13",
    "SELECT ticker, date, close, FALSE AS is_future FROM prices UNION ALL SELECT ticker, max(date) + 1, NULL, TRUE FROM prices GROUP BY 1",
    "prices",
    dates="date",
)
def win13(spark, sf):
    rows = V.prices(spark, sf).select("ticker", "date", "close")
    return features.with_future_row(rows).select("ticker", "date", "close", "is_future")


@query(
    "jon2",
    """
    SELECT p.ticker, p.date, p.close, coalesce(m.sentiment, 0) AS sentiment
    FROM prices p LEFT JOIN market_daily m USING (ticker, date)""",
    "prices market_daily",
    dates="date",
)
def jon2(spark, sf):
    return features.join_sentiment(V.prices(spark, sf).select("ticker", "date", "close"), V.market_daily(spark, sf))


_ALL = {name: expr for group in GROUPS_SQL.values() for name, expr in group.items()}


@query(
    "fea1",
    f"""
    WITH RECURSIVE {STEPS}, {MACD},
    f AS (SELECT ticker, date, is_future, close, {', '.join(f'{e} AS {n}' for n, e in _ALL.items())},
                 CASE WHEN close IS NOT NULL AND lead(close) OVER w IS NOT NULL
                      THEN CAST(lead(close) OVER w > close AS DOUBLE) END AS y,
                 lead(close) OVER w / nullif(close, 0) - 1 AS actual_return
          FROM steps WINDOW w AS (PARTITION BY ticker ORDER BY date)),
    g AS (SELECT f.*, m.macd, m.macd_signal, m.macd - m.macd_signal AS macd_hist FROM f JOIN m USING (ticker, date))
    SELECT ticker, date, is_future, close, {', '.join(_filled(n) for n in [*_ALL, 'macd', 'macd_signal', 'macd_hist'])},
           y, {_round_sql('actual_return', 'actual_return')} FROM g""",
    "prices market_daily",
    dates="date",
)
def fea1(spark, sf):
    wide = features.feature_frame(frame(spark, sf), shown=_shown)
    scale = 10.0 ** _digits("actual_return")
    return wide.withColumn("actual_return", F.floor(F.col("actual_return") * scale + HALF) / scale)


# --- metrics -----------------------------------------------------------------

_COUNTS = """
    SELECT ticker, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp,
           count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn
    FROM scores GROUP BY 1"""


@query(
    "met1",
    f"""
    SELECT ticker, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
           round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
           round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
           round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
    FROM ({_COUNTS})""",
    "scores",
)
def met1(spark, sf):
    guessed = V.scores(spark, sf).withColumn("guess", (F.col("p") >= 0.5).cast("int"))
    return rounded(evaluation.classification_metrics(guessed, ["ticker"], "y", "guess"))


def _auc_sql(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    cols = f"{keys}, " if keys else ""
    group = "GROUP BY ALL"
    return f"""
    SELECT {cols}round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
           / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 6) AS roc_auc
    FROM (SELECT *, rank() OVER ({part} ORDER BY p)
            + (count(*) OVER (PARTITION BY {cols}p) - 1) / CAST(2 AS DOUBLE) AS r FROM scores) {group}"""


@query("met2", _auc_sql(""), "scores")
def met2(spark, sf):
    return rounded(ranks.roc_auc(V.scores(spark, sf), [], "y", "p"))


@query("met2_groups", _auc_sql("ticker"), "scores")
def met2_groups(spark, sf):
    return rounded(ranks.roc_auc(V.scores(spark, sf), ["ticker"], "y", "p"))


def _grid_sql(grid) -> str:
    points = evaluation.even_grid(*grid)
    return ", ".join(f"({i}, CAST({t!r} AS DOUBLE))" for i, t in enumerate(points))


@query(
    "met3",
    f"""
    WITH g AS (SELECT * FROM (VALUES {_grid_sql(F1_GRID)}) AS v(i, t)),
    c AS (SELECT ticker, i, t, coalesce(2 * count(*) FILTER (y = 1 AND p >= t)
              / nullif(2 * count(*) FILTER (y = 1 AND p >= t) + count(*) FILTER (y = 0 AND p >= t)
                       + count(*) FILTER (y = 1 AND p < t), 0), 0) AS f1
          FROM scores CROSS JOIN g GROUP BY 1, 2, 3)
    SELECT ticker, round(arg_max(t, row(f1, -i)), 6) AS threshold, round(max(f1), 6) AS f1 FROM c GROUP BY 1""",
    "scores",
)
def met3(spark, sf):
    return rounded(evaluation.best_f1_threshold(V.scores(spark, sf), ["ticker"], "y", "p"))


@query(
    "met4",
    f"""
    WITH g AS (SELECT * FROM (VALUES {_grid_sql(DUAL_GRID)}) AS v(i, t)),
    c AS (SELECT ticker, i, t,
                 coalesce(count(*) FILTER (y = 1 AND p >= t) / nullif(count(*) FILTER (p >= t), 0), 0) AS prec,
                 coalesce(count(*) FILTER (y = 0 AND p <= t) / nullif(count(*) FILTER (y = 0), 0), 0) AS rec
          FROM scores CROSS JOIN g GROUP BY 1, 2, 3)
    SELECT ticker, round(arg_max(t, row(prec, -i)), 6) AS buy_threshold,
           round(arg_max(t, row(rec, -i)), 6) AS sell_threshold FROM c GROUP BY 1""",
    "scores",
)
def met4(spark, sf):
    return rounded(evaluation.dual_thresholds(V.scores(spark, sf), ["ticker"], "y", "p"))


@query(
    "met5",
    """
    WITH h AS (SELECT ticker, CASE WHEN volume >= 26 THEN lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 END AS r
               FROM prices)
    SELECT ticker, round(coalesce(avg(r), 0), 6) AS avg_strategy_return,
           round(avg(CASE WHEN r IS NOT NULL THEN CAST(r > 0 AS DOUBLE) END), 6) AS long_win_rate, count(r) AS long_trades
    FROM h GROUP BY 1""",
    "prices",
)
def met5(spark, sf):
    rows = V.prices(spark, sf).withColumn("signal", (F.col("volume") >= 26).cast("int"))
    return rounded(evaluation.backtest(rows))


@query(
    "agg18",
    """
    SELECT ticker, u AS n_up, d AS n_down, round(greatest(u, d) / (u + d), 6) AS majority_accuracy,
           round(CASE WHEN u > d THEN 2 * u / (2 * u + d) ELSE 0 END, 6) AS majority_f1,
           round(u / (u + d), 6) AS hold_accuracy, round(2 * u / (2 * u + d), 6) AS hold_f1
    FROM (SELECT ticker, count(*) FILTER (y = 1) AS u, count(*) FILTER (y = 0) AS d FROM scores GROUP BY 1)""",
    "scores",
)
def agg18(spark, sf):
    return rounded(evaluation.class_baselines(V.scores(spark, sf), ["ticker"], "y"))


_SIGNAL = """
    SELECT doc_id, p, least(greatest(buy, 0), 1) AS b, least(greatest(sell, 0), least(greatest(buy, 0), 1)) AS s, er
    FROM (SELECT doc_id, CASE WHEN p <> 0.3 THEN p END AS p, 0.6 AS buy, 0.4 AS sell,
                 CASE WHEN actual_return < -0.3 THEN actual_return END AS er FROM scores)"""


@query(
    "sig1",
    f"""
    SELECT doc_id,
           CASE WHEN p IS NULL THEN NULL WHEN er < 0 THEN 'sell' WHEN p >= b THEN 'buy' WHEN p <= s THEN 'sell' ELSE 'hold' END AS signal,
           round(CASE WHEN p IS NULL THEN NULL WHEN er < 0 THEN 1 - p WHEN p >= b THEN p WHEN p <= s THEN 1 - p
                      ELSE greatest(p, 1 - p) END, 6) AS confidence,
           round(CASE WHEN p IS NULL THEN NULL WHEN er < 0 THEN abs(er) WHEN p >= b THEN p - b WHEN p <= s THEN s - p
                      ELSE greatest(least(b - p, p - s), 0) END, 6) AS margin
    FROM ({_SIGNAL})""",
    "scores",
)
def sig1(spark, sf):
    rows = V.scores(spark, sf).select(
        "doc_id",
        F.when(F.col("p") != 0.3, F.col("p")).alias("p"),
        F.when(F.col("actual_return") < -0.3, F.col("actual_return")).alias("er"),
    )
    signal = evaluation.trade_signal("p", F.lit(0.6), F.lit(0.4), "er")
    return rounded(rows.withColumn("s", signal).select("doc_id", "s.signal", "s.confidence", "s.margin"))


@query(
    "sig2",
    """
    WITH m AS (SELECT ticker, avg(actual_return) FILTER (y = 1) AS up, avg(actual_return) FILTER (y = 0) AS down FROM scores GROUP BY 1)
    SELECT doc_id, round(coalesce(p * up + (1 - p) * down, p * up, (1 - p) * down), 6) AS expected
    FROM scores JOIN m USING (ticker)""",
    "scores",
)
def sig2(spark, sf):
    rows = V.scores(spark, sf)
    moves = evaluation.mean_moves(rows, ["ticker"])
    expected = evaluation.expected_return("p", "avg_up", "avg_down")
    return rounded(rows.join(moves, "ticker").select("doc_id", expected.alias("expected")))


# --- folds, samples, models ---------------------------------------------------

_FOLDS = f"""
    WITH l AS (SELECT * FROM ({_LABELS}) WHERE NOT is_future AND y IS NOT NULL AND actual_return IS NOT NULL),
    c AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n,
                 least(sum(CAST(y = 1 AS INTEGER)) OVER (PARTITION BY ticker), sum(CAST(y = 0 AS INTEGER)) OVER (PARTITION BY ticker)) AS least_,
                 row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos FROM l),
    k AS (SELECT *, least(5, greatest(2, least_)) AS k FROM c WHERE least_ >= 2),
    s AS (SELECT *, n // (k + 1) AS size, n - k * (n // (k + 1)) AS start FROM k)
    SELECT ticker, date, CAST(CASE WHEN n >= k + 1 THEN CASE WHEN pos < start THEN -1 ELSE (pos - start) // greatest(size, 1) END
           WHEN pos < greatest(floor(n * 0.8), 1) THEN -1 ELSE 0 END AS INTEGER) AS fold FROM s"""


@query("mod2", _FOLDS, "prices market_daily", dates="date")
def mod2(spark, sf):
    labelled = features.stepped_frame(frame(spark, sf)).withColumns(features.labels())
    return training.expanding_folds(features.training_rows(labelled)).select("ticker", "date", "fold")


# The order of the sample: the first digits of a digest of the id and the seed.
_DRAWN = "SELECT *, row_number() OVER (PARTITION BY y ORDER BY left(md5(doc_id || '-42'), 15), doc_id) AS place, count(*) OVER (PARTITION BY y) AS size FROM scores"


@query(
    "mod3",
    f"""SELECT doc_id, ticker, y, p, actual_return FROM ({_DRAWN})
    WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n FROM scores GROUP BY y))""",
    "scores",
)
def mod3(spark, sf):
    return training.undersample(V.scores(spark, sf), "y", "doc_id")


@query(
    "mod4",
    f"SELECT doc_id, ticker, y, p, actual_return, place <= ceil(size * 0.2) AS is_test FROM ({_DRAWN})",
    "scores",
)
def mod4(spark, sf):
    return training.stratified_test(V.scores(spark, sf), "y", "doc_id")


_STATE_VIEWS = "prices market_daily market_posts"
_SNAPSHOTS = """
    SELECT ticker, p.d AS latest_price_date, coalesce(p.n, 0) AS price_row_count, m.d AS latest_sentiment_date,
           coalesce(m.n, 0) AS sentiment_row_count, q.t AS latest_post_utc
    FROM (SELECT ticker, max(date) AS d, count(date) AS n FROM {prices} GROUP BY 1) p
    FULL JOIN (SELECT ticker, max(date) AS d, count(date) AS n FROM {daily} GROUP BY 1) m USING (ticker)
    FULL JOIN (SELECT ticker, max(created_utc) AS t FROM market_posts GROUP BY 1) q USING (ticker)"""
_SNAP_NOW = _SNAPSHOTS.format(prices="prices", daily="market_daily")
_SNAP_OLD = _SNAPSHOTS.format(
    prices="(SELECT * FROM prices WHERE date < DATE '2001-08-01')",
    daily="(SELECT * FROM market_daily WHERE date < DATE '2001-08-20')",
)


def _snapshots(spark, sf, price_end=None, mood_end=None):
    price, mood = V.prices(spark, sf), V.market_daily(spark, sf)
    if price_end:
        price, mood = price.where(F.col("date") < price_end), mood.where(F.col("date") < mood_end)
    return training.training_snapshots(price, mood, V.market_posts(spark, sf))


@query("agg17", _SNAP_NOW, _STATE_VIEWS, dates="latest_price_date latest_sentiment_date", stamps="latest_post_utc")
def agg17(spark, sf):
    return _snapshots(spark, sf)


@query(
    "mod5",
    f"""
    WITH a AS ({_SNAP_NOW}), b AS ({_SNAP_OLD})
    SELECT a.* FROM a LEFT JOIN b ON a.ticker = b.ticker
         AND a.latest_price_date IS NOT DISTINCT FROM b.latest_price_date AND a.price_row_count = b.price_row_count
         AND a.latest_sentiment_date IS NOT DISTINCT FROM b.latest_sentiment_date
         AND a.sentiment_row_count = b.sentiment_row_count AND a.latest_post_utc IS NOT DISTINCT FROM b.latest_post_utc
    WHERE b.ticker IS NULL""",
    _STATE_VIEWS,
    dates="latest_price_date latest_sentiment_date",
    stamps="latest_post_utc",
)
def mod5(spark, sf):
    return training.changed_symbols(_snapshots(spark, sf), _snapshots(spark, sf, "2001-08-01", "2001-08-20"))


MODEL_COLUMNS = ["close_lag1", "close_ma3", "return_1d", "return_3d", "sentiment_lag1", "sentiment_ma3", "volatility_7d", "rsi"]


def _model_rows(spark, sf, only=None):
    """Features, labels and folds; a fixed number of tasks, as there are few rows and long work."""
    folds = {"fold": training.fold_number(trains=F.expr(training.LABELLED))}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return features.feature_frame(frame(spark, sf), only=only, also=folds, partitions=tasks)


@query("mod1")
def mod1(spark, sf):
    scored = training.ticker_probabilities(_model_rows(spark, sf, MODEL_COLUMNS), MODEL_COLUMNS)
    return rounded(training.evaluate_probabilities(scored))


@query("mod1_models")
def mod1_models(spark, sf):
    """Three types of model per ticker on all features, each with its whole search."""
    wide = _model_rows(spark, sf)
    plain = ("ticker", "date", "is_future", "close", "y", "actual_return", "fold")
    scored = training.ticker_models(wide, [c for c in wide.columns if c not in plain])
    return rounded(training.evaluate_probabilities(scored, ["ticker", "model"]))


@query("mod6")
def mod6(spark, sf):
    scored = training.ticker_probabilities(_model_rows(spark, sf, MODEL_COLUMNS), MODEL_COLUMNS)
    return rounded(training.model_predictions(training.evaluate_probabilities(scored)))


@query("mod1_pooled")
def mod1_pooled(spark, sf):
    # Every stage of the pipeline reads the rows, the solver many times: their features are made once.
    wide = features.feature_frame(frame(spark, sf), only=MODEL_COLUMNS)
    known = storage.stored(features.training_rows(wide), "pooled-rows")
    rows = training.with_class_weights(known)
    model = training.pooled_pipeline(MODEL_COLUMNS).fit(rows)
    from pyspark.ml.functions import vector_to_array

    proba = vector_to_array("probability").getItem(1)
    tested = model.transform(rows).select("ticker", "y", proba.alias("proba"), F.col("prediction").cast("int").alias("guess"))
    metrics = evaluation.classification_metrics(tested, [], "y", "guess")
    return rounded(metrics, 3)
