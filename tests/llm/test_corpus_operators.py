"""Operators over a whole corpus against brute force: passages, mixing, vectors, near duplicates, the pipeline."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from symbolpulse.llm import embedding_join, minhash_dedup, source_mix, suffix_dedup
from symbolpulse.llm.components import components

ODD = [None, "", "  ", "one", "two words", "a b c", "a b c d", "a b c d", "w " * 20_000]


def words_of(text):
    return (text or "").encode().split()


class Links:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(30)] + [(2000, i) for i in range(2001, 2100)]
    links = Links({x for p in pairs for x in p})
    for a, b in pairs:
        links.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: links.root(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0


def _corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    texts = [" ".join(word() for _ in range(rng.randint(1, 140))) for _ in range(n)]
    passages = [" ".join(word() for _ in range(k)) for k in (20, 49, 50, 51, 80, 200)]
    for i in range(n // 3):
        texts.append(" ".join([texts[rng.randrange(n)], rng.choice(passages), word()]))
    for i in range(n // 2):
        words = texts[rng.randrange(n)].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return [*texts, *ODD, *texts[:5]]


@pytest.mark.parametrize("width,percent", [(5, 80), (4, 80), (2, 60)])
def test_near_duplicates(spark, width, percent):
    texts = _corpus(3)
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, n int, key string")
    sets = []
    for t in texts:
        w = words_of((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    links = Links(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links.join(a, b)
    rows = minhash_dedup.near_duplicates(docs, width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {
        i: (len(sets[i]), links.root(i), links.root(i) == i) for i in range(len(texts))
    }


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id bigint, text string"
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f"), (9, None), (9, "")], schema)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in minhash_dedup.near_duplicates(rows).collect())
    assert got == [(-1, 2, -1, True), (3, 2, 3, True), (7, 2, 3, False), (7, 2, 3, False), (9, 0, 9, True), (9, 0, 9, True)]


def test_near_duplicates_link_sets_not_ids(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**9)}"
    a, b, c = ([word() for _ in range(60)] for _ in range(3))
    text = " ".join
    schema = "doc_id int, text string, n int, node string"
    rows = spark.createDataFrame([(1, text(a), 1, "x"), (5, text([*a, "z"]), 2, "x"), (5, text(c), 3, None)], schema)
    got = sorted((r.n, r.doc_id, r.n_shingles, r.component_id, r.kept) for r in _kept(rows))
    assert got == [(1, 1, 56, 1, True), (2, 5, 57, 1, False), (3, 5, 56, 5, True)]
    rows = spark.createDataFrame([(1, text(a), 1, ""), (5, text([*a, "z"]), 2, ""), (5, text(b), 3, ""), (3, text([*b, "q"]), 4, "")], schema)
    got = sorted((r.n, r.doc_id, r.component_id, r.kept) for r in _kept(rows))
    assert got == [(1, 1, 1, True), (2, 5, 1, False), (3, 5, 3, False), (4, 3, 3, True)]


def test_pipeline_drops_rows_not_ids(spark):
    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "ac"]
    rows = [(1, texts[0]), (5, texts[0] + " z"), (5, texts[1]), (5, None), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id int, text string, _address int")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in left))) == sorted(map(str, [rows[0], *rows[2:]]))


def test_embeddings_link_vectors_not_ids(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.01]), (1, [1.0, 0.01, 0.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, same string")
    got = sorted(tuple(r) for r in embedding_join.near_embeddings(table).collect())
    assert got == [(1, 1, 1, True), (3, 1, 3, True), (5, 1, 1, False), (5, 1, 3, False)]


def _kept(rows):
    """Near duplicates with the column ``n`` of the rows handed on under a free name."""
    found = minhash_dedup.near_duplicates(rows.withColumn("own", rows["n"]), keep=["own"])
    return found.withColumnRenamed("own", "n").collect()


def test_near_duplicates_behind_a_template(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    template = [word() for _ in range(250)]
    pages = [template + [word() for _ in range(50)] for _ in range(40)]
    for _ in range(6):
        own = [word() for _ in range(40)]
        pages += [template + own + [word() for _ in range(15)] for _ in range(2)]
    # One band of two values: the bucket of the template hides the pairs behind its first pages.
    texts = [" ".join(p) for p in pages]
    hashed = minhash_dedup.shingles_of(texts, 5, minhash_dedup.WordHashes())
    keys = minhash_dedup.band_keys(minhash_dedup.signatures(hashed, 2, minhash_dedup._probes(2)), 2)[:, 0].tolist()
    common = collections.Counter(keys).most_common(1)[0][0]
    pages = [p for p, k in zip(pages, keys, strict=True) if k == common]
    sets = [{tuple(p[k : k + 5]) for k in range(len(p) - 4)} for p in pages]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(pages)) for a in range(b)}
    near = {p for p, s in alike.items() if s >= 0.8}
    assert near and len(pages) > 20 and all(0.65 < s < 0.75 for p, s in alike.items() if p not in near)
    docs = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(pages)], "doc_id bigint, text string")
    rows = minhash_dedup.near_duplicates(docs, bands=1, rows=2).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i - 1 if (i - 1, i) in near else i for i in range(len(pages))}


def test_near_duplicates_compare_a_bucket_once(spark, monkeypatch):
    """A template's bucket is read once, however many of its pages link with nothing, and its hidden pairs are found."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    template = [word() for _ in range(300)]
    pages = [template + [word() for _ in range(50)] for _ in range(30)]
    for _ in range(5):
        own = [word() for _ in range(45)]
        pages += [template + own + [word() for _ in range(5)] for _ in range(2)]
    written = []
    monkeypatch.setattr(minhash_dedup, "stored", lambda df, name, plain=minhash_dedup.stored: (written.append(name), plain(df, name))[1])
    docs = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(pages)], "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, percent=90).collect()}
    assert found == {i: i - 1 if i > 30 and i % 2 else i for i in range(40)}
    assert written.count("bucket-members") == written.count("stars") == 1


def test_neighbours_of_a_group_over_many_partitions(spark):
    """Groups that partition bounds cut know their whole extent, by a join that keeps every row once."""
    rows = [(i, 0, 5, 7, 40 + (i > 250)) for i in range(300)] + [(i, 9, 9, 1000 + i // 2, i // 2) for i in range(300)] + [(5, 50, 50, 1, 1), (5, 60, 60, 1, 1)]
    table = spark.createDataFrame(rows, "doc_id bigint, low int, high int, head bigint, whole bigint")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = suffix_dedup.neighbours(table)
        got = sorted(tuple(r) for r in found.drop("contested").collect())
        contested = {(r.head, r.contested) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    large = [(i, 0, 5, 7, 41, 0, 299, 251, 299) if i > 250 else (i, 0, 5, 7, 40, 0, 299, 0, 250) for i in range(300)]
    small = [(i, 9, 9, 1000 + i // 2, i // 2, *[i // 2 * 2, i // 2 * 2 + 1] * 2) for i in range(300)]
    assert got == sorted(large + small)
    assert contested == {(7, True)} | {(1000 + i, False) for i in range(150)}
    assert "MapInArrow" not in plan


def _passages(texts, least):
    holders = collections.defaultdict(set)
    for i, t in enumerate(texts):
        w = words_of(t)
        for k in range(len(w) - least + 1):
            holders[tuple(w[k : k + least])].add(i)
    out = set()
    for i, t in enumerate(texts):
        w = words_of(t)
        for first in (True, False):
            spans = []
            for k in range(len(w) - least + 1):
                own = holders[tuple(w[k : k + least])]
                if len(own) > 1 and (min(own) == i) == first:
                    if spans and spans[-1][1] >= k:
                        spans[-1][1] = k + least
                    else:
                        spans.append([k, k + least])
            out |= {(i, a, b, b - a, first) for a, b in spans}
    return out


@pytest.mark.parametrize("seed,least", [(3, 50), (4, 50), (5, 12)])
def test_repeated_passages(spark, seed, least):
    texts = _corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, head string")
    found = suffix_dedup.repeated_passages(docs, least)
    assert {tuple(r) for r in found.collect()} == _passages(texts, least)
    assert found.count() == len(_passages(texts, least))


def test_texts_without_repeats(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [f"one {shared} two", f"three {shared} four", None, "alone"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, shared, 5)], "doc_id bigint, text string, _go int")
    left = suffix_dedup.without_repeats(docs, suffix_dedup.repeated_passages(docs))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r._go) for r in left.collect() if r.text) == [
        (-1, shared, 5), (0, texts[0], 5), (1, "three four", 5), (3, "alone", 5)
    ]
    assert suffix_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(9)
    sources = ["b", "a", "é", None, "z", "tiny", "none"]
    rows = []
    for i in range(900):
        source = rng.choices(sources[:6], [10, 3, 2, 2, 1, 0.02])[0]
        rows.append((i, " ".join(f"{i}_{k}" for k in range(rng.choice([0, 1, 5, 80, 400]))), source, 1))
    rows += [(900, None, "none", 1), (901, "  ", None, 1), (902, "q " * 30_000, "b", 1), (5, rows[5][1], rows[5][2], 1), (None, "x y", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    got = source_mix.mix_sizes(docs).collect()
    assert got and sorted(map(str, got)) == sorted(map(str, source_mix.mix_sizes(docs.repartition(5)).collect()))
    size = collections.Counter()
    for _, t, s, _ in rows:
        size[s] += len(words_of(t))
    order = sorted(x for x in size if x is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left = {}, 1.5 * sum(size.values())
    while True:
        rest = [s for s in order if s not in target]
        level = left / sum(weight[s] for s in rest)
        full = [s for s in rest if level * weight[s] >= 2 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
    target |= {s: level * weight[s] for s in rest}
    taken = collections.Counter()
    source_of = {r[0]: r[2] for r in rows}
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(0.03 * target[s], 2 * 128)
    assert source_mix.mix_sizes(docs.limit(0)).count() == 0


def test_mixed_texts(spark):
    rows = [(i, " ".join(f"{i}_{k}" for k in range(200)), "ab"[i % 2], 0, 7) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint, _row int")
    mixed = source_mix.mix_documents(docs, block=16).collect()
    taken = {r.doc_id: r.taken for r in source_mix.mix_sizes(docs, block=16).collect()}
    assert {r.doc_id: len(r.text.split()) for r in mixed} == {i: n for i, n in taken.items() if n}
    for r in mixed:
        passes = [p.split() for p in r.text.split("\n")]
        assert len(passes) <= 2 and r.n_chars == len(r.text) and r._row == 7
        assert all(p == sorted(p, key=lambda w: int(w.split("_")[1])) and len(set(p)) == len(p) for p in passes)


def test_permutations():
    for n in (1, 2, 3, 17, 1000, 4097):
        got = source_mix._permuted(np.arange(n), n, 5)
        assert sorted(got.tolist()) == list(range(n))


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings(spark, block):
    rng = np.random.RandomState(3)
    base = rng.randn(60, 12)
    x = np.concatenate([base, base[rng.randint(0, 60, 200)] + rng.randn(200, 12) * rng.choice([0.02, 0.2, 0.5], (200, 1)), base[:10], np.repeat(base[:1], 40, 0), base[:5] * 3])
    vectors = [v.tolist() for v in x] + [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 0.0], [2.0, 0.1]]
    rows = [(i, v, 1, "n") for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, n string")
    n = len(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    links, count = Links(range(len(vectors))), {i: 0 for i in range(len(vectors))}
    for a in range(n):
        count[a] = int(near[a].sum()) - 1
        for b in np.flatnonzero(near[a]):
            links.join(a, int(b))
    last = len(vectors) - 1
    links.join(last, last - 1)
    count[last] = count[last - 1] = 1
    got = embedding_join.near_embeddings(table, block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (count[i], links.root(i), links.root(i) == i) for i in count}
    assert embedding_join.near_embeddings(table.limit(0)).count() == 0


def test_pipeline(spark):
    rng = random.Random(2)
    words = ["the", "of", "house", "tree", "river", "walking", "bright", "morning", "window", "paper", "garden", "simple", "stone"]
    line = "This very same line stands in many of the documents"
    texts = [" ".join(rng.choices(words, k=rng.randint(60, 200))) + f" {i}\n{line}" for i in range(120)]
    toxic = [int(i % 5 == 0) for i in range(120)]
    texts = [t.replace("river", "zorgling") + " zorgling flibnarx" if x else t for t, x in zip(texts, toxic, strict=True)]
    texts += [texts[1], "more " + texts[2], None, ""]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id bigint, quality int, toxic int")

    def run(stage, rows):
        return stage(spark, rows, "unused").cache()

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "table", lambda *_: labels)
        clean = run(corpus_pipeline.drop_toxic, docs)
    left = {r.doc_id for r in clean.collect()}
    assert not left & {i for i, t in enumerate(toxic) if t} and left >= {i for i, t in enumerate(toxic) if not t}
    lines = run(corpus_pipeline.drop_shared_lines, clean)
    assert lines.columns == docs.columns and lines.where(F.col("text").contains(line)).count() == 1
    assert lines.where("n_chars <> length(text)").count() == 0
    single = run(corpus_pipeline.drop_near_duplicates, lines)
    ids = {r.doc_id for r in single.collect()}
    assert single.columns == docs.columns and not ids & {120, 121} and {122, 123} <= ids
    mixed = run(corpus_pipeline.mix_sources, single)
    assert mixed.columns == docs.columns and mixed.count() > 0
    tokens = run(corpus_pipeline.tokenize, mixed)
    assert {r.doc_id: r.decoded for r in tokens.collect()} == {r.doc_id: r.text for r in mixed.collect()}
    assert tokens.where("n_tokens <> size(ids)").count() == 0


def test_embeddings_of_floats_travel_as_floats(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 5)).astype(np.float32)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate([*base, *base[:5], *(base[:6] + np.float32(0.01))])] + [(90, None), (91, [0.0] * 5)]
    sent, tasks = [], embedding_join._tasks

    def seen(cells, block):
        sent.append(dict(cells.dtypes)["embedding"])
        return tasks(cells, block)

    monkeypatch.setattr(embedding_join, "_tasks", seen)
    got = {}
    for kind in ("array<float>", "array<double>", "array<decimal(20,15)>"):
        rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast("array<float>").cast(kind))
        got[kind] = sorted(map(tuple, embedding_join.near_embeddings(rows, block=4).collect()))
    assert sent == ["array<float>", "array<double>", "array<double>"]
    assert len(got["array<float>"]) == 25 and got["array<float>"] == got["array<double>"] and sum(r[1] for r in got["array<float>"]) >= 20
