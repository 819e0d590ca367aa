import json
import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from symbolpulse.operators import rollups
from symbolpulse.plans import catalog, stream_queries
from symbolpulse.sources import readers, writers
from symbolpulse.streaming import streams, windows


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_daily_bars_csv(spark, tmp_path):
    put(tmp_path, "nvda.us.csv", "Date,Open,High,Low,Close,Volume\n2024-01-01,1,2,0.5,1.5,100\n2024-01-02,x,2,1,2,\nbad,1,1,1,1,1\n")
    rows = readers.daily_bars_csv(spark, str(tmp_path), date(2024, 1, 1)).orderBy("date").collect()
    assert [(r.ticker, str(r.date), r.open, r.volume) for r in rows] == [("NVDA", "2024-01-01", 1.0, 100), ("NVDA", "2024-01-02", None, None)]


def test_chart_json(spark, tmp_path):
    quote = {"open": [1.0, None, 3.0], "high": [1.0, None, 3.0], "low": [1.0, None, 2.0], "close": [1.0, None, None], "volume": [5, None, 7]}
    body = {"chart": {"result": [{"timestamp": [1704067200, 1704070800, 1704153600], "indicators": {"quote": [quote]}}]}}
    put(tmp_path, "ABC.json", json.dumps(body))
    rows = readers.chart_daily(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.ticker, str(r.date), r.close) for r in rows] == [("ABC", "2024-01-01", 1.0), ("ABC", "2024-01-02", None)]


def test_history_and_fx(spark, tmp_path):
    frame = spark.createDataFrame([("2024-01-01", 1.0, 1.0, 1.0, 1.0)], "Date string, Open double, High double, Low double, Close double")
    assert readers.normal_history(frame, "X").first().volume is None
    path = put(tmp_path, "eurusd.csv", "Date,Open,High,Low,Close\n2024-01-01,1,1,1,1.1\n2024-01-02,1,1,1,\n")
    assert [r.rate_usd_per_eur for r in readers.fx_csv(spark, path).collect()] == [1.1]


def test_posts_with_comments(spark, tmp_path):
    hot = {"id": "h1", "title": "t", "created_utc": 1704067200, "selftext": "x", "score": 3, "num_comments": 2,
           "comments": [{"id": "c0", "body": ""}, {"id": "c1", "body": "one", "score": 1}, {"id": "c2", "body": "two"}]}
    new = [{"id": "n1", "created_utc": 1704067300}, {"id": "h1", "title": "other", "created_utc": 1}]
    a = put(tmp_path, "hot.json", json.dumps(hot))
    b = put(tmp_path, "new.json", "\n".join(json.dumps(p) for p in new))
    rows = {r.id: r for r in readers.posts_json(spark, a, b, 1).collect()}
    assert set(rows) == {"h1", "h1_c1", "n1"} and rows["h1"].title == "t" and rows["h1_c1"].num_comments == 0


def test_feed(spark, tmp_path):
    path = put(tmp_path, "feed.xml", "<rss><channel><item><link>u</link><title>T</title><description>S</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>")
    row = readers.feed_items(spark, path).first()
    assert (row.id, row.text, row.created_utc) == ("u", "S", datetime(2024, 1, 1, 10))


def test_dictionaries_and_labels(spark, tmp_path):
    path = put(tmp_path, "a.json", '{"abc": ["One ", "", "two"]}')
    assert {(r.ticker, r.alias) for r in readers.aliases_json(spark, path).collect()} == {("ABC", "One"), ("ABC", "two")}
    path = put(tmp_path, "l.json", '{"Accident": -1, "buy": 9}')
    assert readers.lexicon_json(spark, path, {"buy": 1}) == {"buy": 1, "accidenen": -1}
    path = put(tmp_path, "t.csv", "text,label\na,positive\nb,neutral\nc,negative\n")
    assert readers.labelled_texts(spark, path).count() == 2
    path = put(tmp_path, "m.csv", "Ticker,Description\nabc ,A Corp\n")
    assert tuple(readers.security_master(spark, path).first()) == ("ABC", "A Corp")
    bad = put(tmp_path, "bad.csv", "x,y\n1,2\n")
    with pytest.raises(ValueError):
        readers.security_master(spark, bad)


def test_lexicons_and_markers_as_rows(spark):
    files = spark.createDataFrame(
        [("b", '{"Kaufst": 3, "neu": 1, "none": null}'), ("a", '{"kauft": 2, "Buy": 9, "heute": 4}'), ("c", None), ("d", "not json")], "file string, value string"
    )
    got = {tuple(r) for r in readers.lexicon_rows(files, {"buy": 1}, ["heute"]).collect()}
    assert got == {("buy", 1), ("kaufen", 2), ("neu", 1), ("heute", 4)}
    assert readers.lexicon_rows(files.limit(0)).count() == 0
    configs = spark.createDataFrame(
        [("b", '{"intensities": {"Mega": 5}, "markers": ["Nie", null]}'), ("a", '{"intensities": {"mega": 4, "super": 3}}'), ("c", "{}"), ("d", None)],
        "file string, value string",
    )
    got = {tuple(r) for r in readers.marker_rows(configs, {"mega": 2.0, "strong": 2.0}, ["no", "nie"]).collect()}
    assert got == {
        ("intensity", "mega", 5.0), ("intensity", "super", 3.0), ("intensity", "strong", 2.0), ("marker", "nie", None), ("marker", "no", None)
    }
    assert readers.marker_rows(configs.limit(0)).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("B", 1.0), ("A", 2.0)], "ticker string, price double")
    writers.write_overview(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    writers.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    history = str(tmp_path / "history")
    for at in (datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 2), datetime(2024, 1, 1, 2)):
        writers.append_history(rows, history, at)
    assert spark.read.parquet(history).count() == 4


UPSERT = "k string, v int, day string"


def _upsert(spark, path, rows):
    writers.upsert_partitions(spark.createDataFrame(rows, UPSERT), path, ["k"], "day")


def _values(table):
    return {(r.k, r.v, r.day) for r in table.collect()}


def test_upsert_touches_only_its_days(spark, tmp_path):
    path = str(tmp_path / "t")
    _upsert(spark, path, [("a", 1, "d1"), ("b", 1, "d1"), ("c", 1, "d2")])
    before = {f for f in writers.read_table(spark, path).where("day = 'd2'").inputFiles() if "day=d2" in f}
    for _ in range(2):
        _upsert(spark, path, [("a", 2, "d1"), ("z", 2, "d1")])
    table = writers.read_table(spark, path)
    assert _values(table) == {("a", 2, "d1"), ("b", 1, "d1"), ("z", 2, "d1"), ("c", 1, "d2")}
    assert before and before <= set(table.inputFiles())


def test_readers_see_the_table_before_or_after_an_upsert(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    _upsert(spark, path, [("a", 1, "d1"), ("b", 1, "d2")])
    old = writers.read_table(spark, path)
    publish, seen = writers._publish, []

    def late(*args):
        # All files are written; the version is not out yet.
        seen.append(_values(writers.read_table(spark, path)))
        publish(*args)

    monkeypatch.setattr(writers, "_publish", late)
    _upsert(spark, path, [("a", 2, "d1"), ("c", 2, "d3")])
    assert seen == [{("a", 1, "d1"), ("b", 1, "d2")}]
    # A reader that began before goes on with its version.
    assert _values(old) == {("a", 1, "d1"), ("b", 1, "d2")}
    now = {("a", 2, "d1"), ("b", 1, "d2"), ("c", 2, "d3")}
    assert _values(writers.read_table(spark, path)) == now

    def stopped(*args):
        raise RuntimeError("stopped")

    monkeypatch.setattr(writers, "_publish", stopped)
    with pytest.raises(RuntimeError):
        _upsert(spark, path, [("a", 3, "d1")])
    assert _values(writers.read_table(spark, path)) == now

    def second(spark_, path_, number, folders):
        publish(spark_, path_, number, folders)
        publish(spark_, path_, number, folders)

    monkeypatch.setattr(writers, "_publish", second)
    with pytest.raises(FileExistsError):
        _upsert(spark, path, [("d", 4, "d4")])
    monkeypatch.setattr(writers, "_publish", publish)
    now |= {("d", 4, "d4")}
    assert writers.vacuum(spark, path, keep=1) == 2
    assert _values(writers.read_table(spark, path)) == now
    _upsert(spark, path, [("d", 5, "d4")])
    assert _values(writers.read_table(spark, path)) == now - {("d", 4, "d4")} | {("d", 5, "d4")}
    with pytest.raises(FileNotFoundError):
        writers.read_table(spark, str(tmp_path / "none"))


KIND = "id string, ticker string, created_utc timestamp, upvotes int, sentiment_dict double, sentiment_weighted double"


def _batches(spark, folder, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    post = lambda i: (f"p{i}", "XY"[i % 2], start + timedelta(minutes=13 * (i * 7 % 50)), i, i / 10, i / 5)
    parts = [[post(i) for i in range(k, 50, 3)] for k in range(3)]
    stream = _batches(spark, tmp_path / "in", parts)
    out = str(tmp_path / "out")
    hours = streams.sentiment_windows()
    streams.run_available(stream, windows.into_windows(out, hours), str(tmp_path / "cp"), "append")
    got = {(r.start, r.ticker): (r.posts, round(r.sentiment_weighted, 9)) for r in windows.read_windows(spark, out, hours).collect()}
    batch = rollups.hourly_sentiment(spark.read.parquet(str(tmp_path / "in")))
    assert got == {(r.created_utc, r.ticker): (r.posts, round(r.sentiment_weighted, 9)) for r in batch.collect()}


def test_stream_deduplicates_and_alerts_fire_once(spark, tmp_path):
    at = datetime(2024, 1, 1)
    parts = [[("p1", "X", at, 150, 0.0, 0.0)], [("p1", "X", at, 150, 0.0, 0.0), ("p2", "X", at, 160, 0.0, 0.0)]]
    stream = _batches(spark, tmp_path / "in", parts)
    out = str(tmp_path / "ids")
    streams.run_available(stream, streams.distinct_sink(out), str(tmp_path / "cp1"), "append")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["p1", "p2"]
    rules = spark.createDataFrame([(1, "X", ">", 100.0, True), (2, "X", "<", 100.0, True)], "id bigint, ticker string, op string, price double, active boolean")
    ticks = stream.select("ticker", F.col("created_utc").alias("ts"), F.col("upvotes").cast("double").alias("price"))
    fired = str(tmp_path / "fired")
    streams.run_available(ticks, streams.alert_sink(rules, fired), str(tmp_path / "cp2"), "append")
    assert [r.id for r in spark.read.parquet(fired).collect()] == [1]
    left = streams.remaining_rules(rules, spark.read.parquet(fired))
    assert {r.id: r.active for r in left.collect()} == {1: False, 2: True}


def _write_in_turn(rows, folder, order):
    """One file for each fifth of the time; the stream reads them by age, in this order."""
    os.makedirs(folder)
    files = rows.repartitionByRange(len(order), "ts")
    for age, part in enumerate(order):
        draft = f"{folder}-{part}"
        files.where(F.spark_partition_id() == part).coalesce(1).write.parquet(draft)
        (name,) = [n for n in os.listdir(draft) if n.endswith(".parquet")]
        os.rename(f"{draft}/{name}", f"{folder}/{part}-{name}")
        os.utime(f"{folder}/{part}-{name}", (1_700_000_000 + 60 * age,) * 2)


@pytest.mark.parametrize("order", [[0], [0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 4, 0, 3, 1]], ids=["one", "sorted", "reversed", "mixed"])
@pytest.mark.parametrize("name", ["str1", "str2", "str3", "str4", "str5", "str6"])
def test_streams_do_not_depend_on_batches_or_their_order(spark, tmp_path, monkeypatch, name, order):
    source = "/root/testdata/sf0.001"
    if not os.path.isdir(source):
        pytest.skip("no test tables")
    _write_in_turn(spark.read.parquet(f"{source}/events.parquet"), f"{tmp_path}/events.parquet", order)
    spark.read.parquet(f"{source}/part.parquet").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    run = catalog.QUERIES[name]
    whole = sorted(map(str, run(spark, source).collect()))
    monkeypatch.setitem(stream_queries.READ_OPTIONS, "maxFilesPerTrigger", "1")
    monkeypatch.setattr(stream_queries, "FOLD", 2)
    assert whole and sorted(map(str, run(spark, str(tmp_path)).collect())) == whole


def test_segments_fold_and_survive_repeats(spark, tmp_path):
    hours = streams.mention_windows()
    path = str(tmp_path / "t")
    sink = windows.into_windows(path, hours, fold=2)
    at = datetime(2024, 1, 1)
    rows = lambda i: spark.createDataFrame([("X", at, 1.0), ("Y", at + timedelta(hours=i % 3), 2.0), ("Z", None, 1.0)], "ticker string, created_utc timestamp, weight double")
    for i in [0, 1, 1, 2, 3, 3, 2, 4, 5, 6]:
        sink(rows(i), i)
        done = windows.segments(spark, path)
        assert done[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(done, done[1:]))
    assert [s[:2] for s in done] == [(0, 3), (4, 5), (6, 6)]
    got = {(r.ticker, r.start): (r.mentions, r.weight) for r in windows.read_windows(spark, path, hours).collect()}
    assert got == {("X", at): (7, 7.0), **{("Y", at + timedelta(hours=h)): (n, 2.0 * n) for h, n in ((0, 3), (1, 2), (2, 2))}}
    # A fold that stopped before it removed its parts.
    windows._put(hours.partials(rows(1)), path, 1, 1)
    assert windows.read_windows(spark, path, hours).where("ticker = 'X'").first().mentions == 7


def test_ids_stay_once_in_any_order(spark, tmp_path):
    sink = streams.distinct_sink(str(tmp_path / "ids"), delay_days=2)
    day = lambda d, h=0: datetime(2024, 1, d, h)
    shape = "id string, ticker string, created_utc timestamp"
    for number, rows in enumerate([[("a", "X", day(9)), ("a", "X", day(9, 1)), ("b", "X", day(9))], [("a", "X", day(8)), ("c", "X", day(1))], [("a", "X", day(20)), ("c", "X", day(3))]]):
        for _ in range(2):
            sink(spark.createDataFrame(rows, shape), number)
    got = sorted((r.id, r.created_utc.day, r.created_utc.hour) for r in spark.read.parquet(str(tmp_path / "ids")).collect())
    assert got == [("a", 9, 0), ("a", 20, 0), ("b", 9, 0), ("c", 1, 0)]


def test_alerts_fire_at_any_crossing(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rules = spark.createDataFrame([(1, "X", ">", 100.0, True), (2, "X", "<", 95.0, True), (3, "X", ">", 200.0, True)], "id bigint, ticker string, op string, price double, active boolean")
    prices = [("p1", "X", at, 150, 0.0, 0.0), ("p2", "X", at + timedelta(hours=1), 90, 0.0, 0.0)]
    for cut in ([prices], [prices[:1], prices[1:]]):
        folder = tmp_path / f"in{len(cut)}"
        ticks = _batches(spark, folder, cut).select("ticker", F.col("created_utc").alias("ts"), F.col("upvotes").cast("double").alias("price"))
        fired = str(tmp_path / f"fired{len(cut)}")
        streams.run_available(ticks, streams.alert_sink(rules, fired), str(tmp_path / f"cp{len(cut)}"), "append")
        assert sorted(r.id for r in spark.read.parquet(fired).collect()) == [1, 2]
