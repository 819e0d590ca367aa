"""WARC archives, vector codes and conversation repair against brute force, and all SQL twins of this package."""

import glob
import gzip
import hashlib
import math
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from symbolpulse.llm import conversation_repair, queries, vector_codes, warc
from symbolpulse.operators.storage import new_folder

SF_DIR = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    got = queries.QUERIES[name](spark, SF_DIR)
    result = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    same = [[str(r[columns.index(c)]) for c in sorted(columns)] for r in result.fetchall()]
    assert sorted([str(r[c]) for c in sorted(columns)] for r in got.collect()) == sorted(same)


# ---------------------------------------------------------------- archives


def archive(folder):
    return {os.path.basename(f): open(f, "rb").read() for f in glob.glob(folder.removeprefix("file:") + "/*.warc.gz")}


def expected_records(rows):
    """Key, bytes, digest, type and target of each record; all records with the greatest key are kept."""
    groups = {}
    for key, _, text in rows:
        groups.setdefault((text or "").encode(), []).append(key)
    out = []
    for payload, keys in groups.items():
        first = (len(payload), hashlib.sha1(payload).hexdigest())
        best = max(keys, key=lambda k: (k is not None, k))
        for key in keys:
            if len(payload) < warc.LEAST_REVISIT or key == best:
                out.append((key, *first, "response", None))
            else:
                out.append((key, *first, "revisit", best))
    return sorted(out, key=str)


PAGES = [
    (1, "http://a/1", "x" * 2000), (9, None, "x" * 2000), (9, "http://a/ü b\r\nX: 1", "x" * 2000), (4, "", "x" * 999), (5, "u", "x" * 999), (5, "u", "x" * 999),
    (None, "u", None), (None, "u", "é" * 500), (7, "u", "é" * 500), (8, "u", ""), (2, "u", "WARC/1.1\r\n\r\n" * 200), (3, "u", " €\U0001f600" * 300_000),
]
SHAPE = "page_id long, url string, html string, key string, payload int"


def pages(spark, rows, parts):
    return spark.createDataFrame([(*r, "other", 0) for r in rows], SHAPE).repartition(parts)


def read_back(spark, manifest):
    found = warc.read_warc(manifest, ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]).select(
        F.col("key").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long")
    )
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_archive_round_trip(spark):
    assert read_back(spark, warc.write_warc(pages(spark, PAGES, 3), new_folder(spark, "t"))) == expected_records(PAGES)
    empty = warc.write_warc(pages(spark, PAGES, 1).where("false"), new_folder(spark, "t"))
    assert read_back(spark, empty) == []


def test_archive_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}", "".join(rng.choices("abcdef ", k=rng.choice([10, 900, 1500, 6000])))) for i in range(300)]
    rows += [(1000 + i, "http://copy", rows[7][2] * 3) for i in range(100)]
    files = []
    for parts in (1, 5):
        folder = new_folder(spark, "t")
        manifest = warc.write_warc(pages(spark, rows, parts), folder, shard_bytes=200_000, file_bytes=30_000)
        assert read_back(spark, manifest) == expected_records(rows)
        files.append(archive(folder))
        listed = {r.file.rsplit("/", 1)[1]: r for r in manifest.collect()}
        assert {n: hashlib.sha256(b).hexdigest() for n, b in files[-1].items()} == {n: r.sha256 for n, r in listed.items()}
        assert not glob.glob(folder.removeprefix("file:") + "/_temporary*")
        # Ranges: files in order hold keys in order, and none is much above the limit.
        ends = [(int(r.first_key), int(r.last_key), r.bytes) for _, r in sorted(listed.items())]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:])) and len(ends) > 4
        assert max(e[2] for e in ends) < 30_000 + 8_000
    assert files[0] == files[1]


def test_archive_deals_a_hot_group(spark):
    rows = [(5, "u", "small")] * 3000 + [(i, "u", f"page {i}") for i in range(300)]
    manifest = warc.write_warc(pages(spark, rows, 4), new_folder(spark, "t"), shard_bytes=150_000)
    assert read_back(spark, manifest) == expected_records(rows)
    shards = [r.n for r in manifest.groupBy("shard").agg(F.sum("records").alias("n")).collect()]
    assert len(shards) > 8 and max(shards) < 600
    found = warc.read_warc(manifest, ["record_id"])
    assert found.distinct().count() == len(rows)


def test_record_names_and_headers(spark):
    folder = new_folder(spark, "t")
    warc.write_warc(pages(spark, PAGES, 2), folder)
    found = [r for b in archive(folder).values() for r in warc.parse_records(__import__("io").BytesIO(b))]
    ids = {r["record_id"]: r for r in found}
    assert len(ids) == len(PAGES)
    assert all("\r" not in r["url"] and " " not in r["url"] for r in found)
    whole = b"".join(gzip.decompress(b) for b in archive(folder).values())
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == len(PAGES)


def test_reader_refuses_a_changed_record(spark):
    raw = warc.record_bytes("1", "u", b"payload", "0", None, False, warc.DATE)
    import io

    assert next(warc.parse_records(io.BytesIO(raw)))["payload"] == b"payload"
    with pytest.raises(ValueError):
        next(warc.parse_records(io.BytesIO(raw.replace(b"\r\n\r\npayload", b"\r\n\r\npayl0ad"))))


# ---------------------------------------------------------------- vector codes


def codes_by_force(rows, parts=8, entries=16, rounds=6):
    kept = [(i, l, [vector_codes.whole(float(x)) for x in v]) for i, l, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    length = -(-max((len(r[2]) for r in kept), default=0) // parts) * parts
    kept = [(i, l, v + [0] * (length - len(v))) for i, l, v in kept]
    w = length // parts
    cut = [[r[2][p * w : (p + 1) * w] for r in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def near(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut[p]:
                groups.setdefault(near(books[p], x)[1], []).append(x)
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for n, (i, label, _) in enumerate(kept):
        found = [near(books[p], cut[p][n]) for p in range(parts)]
        out.append((i, label, [k for _, k in found], sum(d for d, _ in found)))
    return books, out


def compare_codes(spark, rows, **limits):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, error int, codes string").repartition(3)
    coded, books = vector_codes.compress(df, **limits)
    expected, found = codes_by_force(rows, **limits)
    assert books == expected
    sums = {}
    for _, label, _, error in found:
        sums[label] = sums.get(label, 0) + error
    fits = lambda x: x if x < 1 << 63 else None
    expected = [(i, l, c, fits(e), fits(sums[l]) if all(fits(x[3]) is not None for x in found if x[1] == l) else None) for i, l, c, e in found]
    assert sorted(map(str, (tuple(r) for r in coded.select("vec_id", "label", "codes", "error", "label_error").collect()))) == sorted(map(str, expected))


def test_codes_against_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2]), [rng.choice([-1.0, 0.0, 0.25, rng.random()]) for _ in range(16)]) for i in range(250)]
    rows += [(i, 1, rows[3][2]) for i in range(300, 400)] + [(7, 2, rows[9][2]), (None, 2, rows[11][2]), (500, 3, None), (501, 3, [float("nan")] * 16), (502, 3, [None] * 16)]
    compare_codes(spark, rows)


def test_codes_of_odd_vectors(spark):
    compare_codes(spark, [(1, 1, []), (2, 1, [0.5] * 3), (3, None, [1e30, -1.0]), (4, None, [-1e38] * 9), (4, None, [-1e38] * 9), (5, 2, [1e308])] * 2, parts=4, entries=3, rounds=3)
    compare_codes(spark, [(1, 1, []), (2, 1, [])])
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert vector_codes.compress(empty)[0].count() == 0


def test_search_looks_at_ties_on_both_sides():
    search = vector_codes.EqualAverageSearch([[4, 0], [0, 4], [2, 2], [0, 0], [0, 4]])
    import numpy as np

    found, far = search.nearest(np.array([[2, 2], [0, 4], [1, 1], [2, 0], [100, 100]]))
    assert found.tolist() == [2, 1, 2, 0, 2] and far.tolist() == [0, 0, 2, 4, 2 * 98**2]


def test_decoded_vectors_are_near(spark):
    rows = [(i, 0, [float(i % 4)] * 8) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    coded, books = vector_codes.compress(df)
    assert all(r.vector == [float(r.vec_id % 4)] * 8 for r in vector_codes.decode(coded, books).collect())


# ---------------------------------------------------------------- conversations

STEP = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("3", "u"): "2", ("2", "a"): "3"}


def repaired_by_force(rows):
    """Dynamic programming from the end over whole strings of edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:256], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        left = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    after = None
    for i in range(len(rows), -1, -1):
        ways = {q: [] for q in "0123"}
        if i == len(rows):
            ways["0"].append((0, "", ()))
            ways["3"].append((0, "", ()))
        else:
            _, role, text = rows[i]
            more = 5 if faults[i] == "truncated" else 0
            for q in "0123":
                edits = [(2, "D", q, ())]
                if faults[i] not in ("blank", "duplicate"):
                    edits.append((more, "K", STEP.get((q, role[:1])), (f"{role}:{text}",)))
                    edits += [(more + 1, "R", STEP.get((q, n[0])), (f"{n}:{text}",)) for n in ("user", "assistant")]
                ways[q] += [(c + after[to][0], e + after[to][1], out + after[to][2]) for c, e, to, out in edits if to in after]
        for _ in range(4):
            best = {q: min(w) for q, w in ways.items() if w}
            for q in "0123":
                for n in ("user", "assistant"):
                    if (to := STEP.get((q, n[0]))) in best:
                        c, e, out = best[to]
                        ways[q].append((c + 5, "I" + e, (f"{n}:",) + out))
        after = {q: min(w) for q, w in ways.items() if w}
    cost, audit, out = after["0"]
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def compare_turns(rows, found):
    conversations = {}
    for conv, turn, role, text in rows:
        conversations.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == {c: repaired_by_force(r) for c, r in conversations.items()}


def odd_turns(seed, convs, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "sx", "ubuntu"]
    return [
        (c, rng.choice([None, i, i, i, i + 1]), rng.choice(roles), rng.choice(["a.", "b", "", "  ", None, "c!\n", "e?", "f", f"g.{i}", f"h{i}", f"i!{i}!", "long " * 100 + f"{i}."]))
        for c in convs
        for i in range(rng.randint(1, most))
    ]


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("convs", "most", "block_rows"), [(200, 12, 512), (60, 12, 2), (3, 400, 512), (3, 400, 70)])
def test_repair_against_force(spark, convs, most, block_rows):
    rows = odd_turns(most + block_rows, [None, *range(convs)], most)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{TURNS}, fault string, at int").repartition(4)
    compare_turns(rows, conversation_repair.digests(conversation_repair.repair(df, block_rows)))


def test_repair_of_one_hot_text(spark):
    rows = [(1, t, "user", "same.") for t in range(800)] + [(1, None, "user", "same.")] * 200 + odd_turns(1, [2], 20)
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    compare_turns(rows, conversation_repair.digests(conversation_repair.repair(df, 100)))


def test_repaired_turns_are_legal(spark):
    rows = odd_turns(9, range(50), 9)
    repaired = conversation_repair.repair(spark.createDataFrame(rows, TURNS), 3)
    turns = {}
    for r in sorted(repaired.all_turns().collect(), key=lambda r: r.at):
        turns.setdefault(r.conv_id, []).extend(t.role[0] for t in r.turns)
    import re

    assert all(re.fullmatch("(s?(ua)+)?", "".join(t)) for t in turns.values())
    assert repaired.reports().count() == 50


def test_damage_and_query(spark, tmp_path):
    rows = odd_turns(3, [None, *range(120)], 8) + [(c, 0, "user", "once.") for c in range(1000, 1100)]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    left = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        left += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path))
    gone = {r[0] for r in rows} - {r[0] for r in left}
    assert gone
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert all(tuple(r[1:]) == nothing for r in got.collect() if r[0] in gone)
    compare_turns(left, got.where(~F.coalesce(F.col("conv_id").isin(*gone), F.lit(False))))


def test_no_conversations(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_repair.digests(conversation_repair.repair(empty)).count() == 0
