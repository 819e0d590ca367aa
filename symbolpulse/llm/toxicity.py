"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on words of ordinary documents, one on the
pieces of words that toxic documents hold many times as often as ordinary ones.  Every window of a text is
compressed with the ordinary dictionary and with both; where the toxic one shortens it by
some bytes, the window is suspicious.  A calibrated threshold (a logistic curve over the
largest gain, the suspicious windows and the number of windows) turns that into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, map_texts, spare

GRAM = 5
SUSPICIOUS = 3
RATIO = 20
WINDOW = re.compile(r"\S.{0,62}\S*", re.S)


@dataclass
class Model:
    """Two dictionaries and the calibration."""

    ordinary: bytes
    toxic: bytes
    weights: list[float]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        min_match=GRAM, strategy=zstandard.STRATEGY_GREEDY, search_log=4, target_length=24, window_log=18, chain_log=14,
        hash_log=14, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params
    )


def windows(text: str) -> list[bytes]:
    """The whole text in windows of some 64 characters that end with a word."""
    return [f" {w} ".encode() for w in WINDOW.findall(text.lower().replace("\n", " "))]


def _gains(text: str, plain: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> tuple[int, int, int]:
    """Largest gain in bytes, number of suspicious windows, number of windows."""
    most = strong = 0
    own = windows(text)
    for w in own:
        gain = len(plain.compress(w)) - len(toxic.compress(w))
        if gain > 0:
            most = max(most, gain)
            strong += gain >= SUSPICIOUS
    return most, strong, len(own)


def _features(most, strong, n) -> np.ndarray:
    most, strong, n = (np.asarray(x, float) for x in (most, strong, n))
    return np.stack([np.ones_like(n), np.minimum(most, 12), np.log1p(np.minimum(strong, 20)), np.log1p(n)], 1)


def gain_names(docs: DataFrame) -> list[str]:
    return [spare(docs, name) for name in ("_most", "_strong", "_windows")]


def with_gains(docs: DataFrame, ordinary: bytes, toxic: bytes, keep: Sequence[str] = ()) -> DataFrame:
    """``docs`` with ``_most, _strong, _windows`` of each whole text in place of the text.

    ``keep`` may name ``text``, which then stays.
    """
    rest = docs.select(*(c for c in docs.columns if c != "text" or c in keep))
    names = [*rest.columns, *gain_names(docs)]
    shape = rest.withColumns({c: F.lit(0).cast("long") for c in names[-3:]}).schema
    contents = docs.sparkSession.sparkContext.broadcast((ordinary, toxic + b"\n" + ordinary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [_compressor(c) for c in contents.value]
        for batch in batches:
            got = [_gains(text or "", *both) for text in batch.column(batch.num_columns - 1).to_pylist()]
            added = [pa.array([g[i] for g in got], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names)

    return map_texts(docs.select(*rest.columns, F.col("text").alias(spare(docs, "_read"))), run, shape)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, float]]:
    """Texts of up to ``most`` labelled rows a class, chosen by hash; rows each stands for."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_y"))
    )
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(9))
    parts = [known.where(F.col("_y") == y).orderBy(order, "doc_id").limit(most) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * most rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts, {y: max(1.0, counts.get(y, 0) / most) for y in (0, 1)}


def train(docs: DataFrame, labels: DataFrame, most_docs: int = 4000, most_words: int = 4000, least_docs: int = 3) -> Model:
    """Train on a bounded sample: ``most_docs`` labelled rows a class, ``most_words`` words a dictionary.

    Three quarters of the sample make the dictionaries, the last quarter the calibration.
    Rows whose crc32 leaves no remainder by 5 are never used.  Without rows of both classes
    every score is the share of toxic rows in the calibration.
    """
    sample, stands_for = _sample(docs, labels, most_docs)
    calibrates = F.xxhash64("doc_id", F.lit(7)) % 4 == 0
    learnt = sample.where(~calibrates).select("_y", F.split(F.lower("text"), BLANK).alias("_words"))
    # Toxic copies count once: near copies share the smallest hash of their three-word windows.
    places = F.sequence(F.lit(0), F.greatest(F.size("_words") - 3, F.lit(0)))
    window = F.transform(places, lambda i: F.xxhash64(*[F.coalesce(F.get("_words", i + k), F.lit("")) for k in range(3)]))
    toxic = learnt.where("_y = 1").withColumn("_alike", F.array_min(window)).dropDuplicates(["_alike"]).drop("_alike")
    n_toxic, n_ordinary = toxic.count(), learnt.where("_y = 0").count()
    least = max(least_docs, n_toxic // 200)
    # Smoothed shares: a mislabelled or quoting row lowers the ratio and does not decide alone.
    telling = (F.col("_t") + 0.5) * (n_ordinary + 1) >= RATIO * (F.col("_o") + 0.5) * (n_toxic + 1)
    words = (
        learnt.where("_y = 0")
        .unionByName(toxic)
        .select("_y", F.explode(F.array_distinct("_words")).alias("word"))
        .where(F.length("word") > 0)
        .groupBy("word")
        .agg(F.sum("_y").alias("_t"), F.sum(1 - F.col("_y")).alias("_o"))
    )
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    grams = F.when(
        F.length(padded) >= GRAM,
        F.transform(F.sequence(F.lit(1), F.length(padded) - GRAM + 1), lambda i: F.substring(padded, i, F.lit(GRAM))),
    )
    pieces = words.select("word", "_t", "_o", F.explode(F.array_distinct(grams)).alias("gram"))
    marks = (
        pieces.groupBy("gram")
        .agg(F.sum("_t").alias("_t"), F.sum("_o").alias("_o"))
        .where(telling & (F.col("_t") >= least))
        .orderBy(F.desc("_t"), "gram")
        .limit(5 * most_words)
    )
    good = {r["gram"] for r in marks.collect()}  # 5 * most_words at most
    toxic_words = (
        pieces.join(F.broadcast(marks.select("gram")), "gram", "left_semi")
        .groupBy("word")
        .agg(F.max("_t").alias("_t"))
        .orderBy(F.desc("_t"), "word")
        .limit(most_words)
        .collect()
    )
    common = words.where((F.col("_o") > 0) & ~(telling & (F.col("_t") >= least))).orderBy(F.desc("_o"), "word").limit(most_words // 2).collect()
    ordinary = " ".join(r["word"] for r in reversed(common)).encode()
    parts = dict.fromkeys(p for r in toxic_words for p in _marked(f" {r['word']} ", good))
    content = "\n".join(reversed(parts)).encode()
    rows = with_gains(sample.where(calibrates), ordinary, content).collect()  # at most 2 * most_docs rows
    return Model(ordinary, content, _calibrate(rows, stands_for))


def _marked(word: str, good: set[str]) -> list[str]:
    """The longest stretches of ``word`` that marked pieces cover."""
    covered = [False] * len(word)
    for i in range(len(word) - GRAM + 1):
        if word[i : i + GRAM] in good:
            covered[i : i + GRAM] = [True] * GRAM
    out, start = [], None
    for i, c in enumerate([*covered, False]):
        if c and start is None:
            start = i
        elif not c and start is not None:
            out.append(word[start:i])
            start = None
    return out


def _calibrate(rows: list, stands_for: dict[int, float]) -> list[float]:
    """Weights of a logistic curve (Newton steps, a small ridge)."""
    y = np.array([r["_y"] for r in rows], float)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return [float(np.log(share / (1 - share))), 0.0, 0.0, 0.0]
    x = _features(*([r[c] for r in rows] for c in ("_most", "_strong", "_windows")))
    each = np.where(y == 1, stands_for[1], stands_for[0])
    ridge = np.diag([1e-3, 0.05, 0.05, 0.05])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (p - y)) + ridge @ w
        curve = (x * (each * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ()) -> DataFrame:
    """``docs`` without ``text`` and with ``score``, 0 to 1, higher for texts more likely toxic.

    Null and empty texts have no window and get the score of none.  Rows are independent;
    a column named ``score`` is replaced.  With ``text`` in ``keep`` the text stays.
    """
    w = model.weights
    own = docs.drop("score")
    rest = [c for c in own.columns if c != "text" or c in keep]
    most, strong, n = (F.col(name) for name in gain_names(own))
    most, strong = F.least(most, F.lit(12)), F.least(strong, F.lit(20))
    z = w[0] + w[1] * most + w[2] * F.log1p(strong) + w[3] * F.log1p(n)
    return with_gains(own, model.ordinary, model.toxic, keep).select(*rest, (1 / (1 + F.exp(-z))).alias("score"))
