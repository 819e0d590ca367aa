"""Near duplicates by one-permutation MinHash.

A text is the set of its word shingles.  Equal sets are one class at once.  One hash of each
shingle picks a bin and a value; the least value of a bin is the signature, and empty bins
borrow by optimal densification: each probes its own pseudorandom sequence of bins.  Bands
of the signature form buckets; in a bucket all members are compared with one center, so a
bucket of n members has n - 1 candidates.  Candidates are confirmed on the full sets.
Buckets of three or more whose center does not hold all members are compared further by an
exact prefix-filter join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.storage import stored
from .common import batches_of, join_counted, map_texts
from .components import components

BATCH_BYTES = 1 << 21
KNOWN = 100_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingles_of(texts: list[str | None], width: int, known: WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``width``-word shingles.

    A shorter text has one, its whole sequence; a text without words has none.
    """
    words = [(t or "").encode().lower().split() for t in texts]  # blanks of bytes are the six ASCII ones
    lens = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((known[w] for own in words for w in own), np.uint64, int(lens.sum()))
    rolled = np.zeros(max(0, len(flat) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * ODD + flat[k : k + len(rolled)]
    rolled = _mixed(rolled)
    out, at = [], 0
    for n in lens.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        else:
            h = np.full(min(n, 1), n, np.uint64)
            for w in flat[at : at + n]:
                h = h * ODD + w
            out.append(_mixed(h + np.uint64(1)))
        at += n
    return out


def _probes(bins: int, seed: int = 0) -> np.ndarray:
    """Bins that each empty bin asks, in turn."""
    rng = np.random.Generator(np.random.Philox(key=seed + 77))
    return rng.integers(0, bins, (4 * bins, bins))


def signatures(sets: list[np.ndarray], bins: int, probes: np.ndarray) -> np.ndarray:
    """One-permutation signatures (one row each) of sets that are not empty."""
    shift = np.uint64(64 - (bins - 1).bit_length())
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    none = np.uint64(2**64 - 1)
    sig = np.full((len(sets), bins), none, np.uint64)
    np.minimum.at(sig.reshape(-1), row * bins + (flat >> shift).astype(np.int64), flat << np.uint64(64) - shift)
    filled, empty = sig != none, np.nonzero(sig == none)
    out = sig.copy()
    turn = 0
    while len(empty[0]):
        asked = probes[turn, empty[1]] if turn < len(probes) else np.zeros(len(empty[1]), np.int64) + (turn % bins)
        hit = filled[empty[0], asked]
        # A borrowed value tells which bin it came from and at which turn nothing else: ties stay rare.
        out[empty[0][hit], empty[1][hit]] = sig[empty[0][hit], asked[hit]] + asked[hit].astype(np.uint64) * ODD
        empty = (empty[0][~hit], empty[1][~hit])
        turn += 1
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit bucket key for every band of ``rows`` signature values."""
    bands = sig.shape[1] // rows
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for k in range(rows):
        key = _mixed(key * ODD + sig[:, k : bands * rows : rows])
    return key


def _map_sets(docs: DataFrame, width: int, shape: str, fill, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep`` and what ``fill`` makes of the shingle sets of a batch."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    passed = rows.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            own = batch.columns[:-1]
            for a, b in batches_of([len(t or "") for t in texts], BATCH_BYTES):
                sets = shingles_of(texts[a:b], width, known)
                names, columns = fill(sets)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in own), *columns], [*batch.schema.names[:-1], *names])

    return map_texts(rows, run, StructType(passed.schema.fields + StructType.fromDDL(shape).fields))


def _lists(sets, kind) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64), kind))


def _names(sets: list[np.ndarray]) -> pa.Array:
    """One name for equal sets."""
    return pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())


def sketches(docs: DataFrame, width: int, bands: int, rows: int, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``keep``, ``n, set_id, keys``: size and identity of the shingle set, its bucket keys."""
    bins = bands * rows
    probes = _probes(bins)

    def fill(sets: list[np.ndarray]):
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = [np.zeros(0, np.uint64)] * len(sets)
        if full:
            for i, k in zip(full, band_keys(signatures([sets[i] for i in full], bins, probes), rows), strict=True):
                keys[i] = k
        sizes = pa.array([len(s) for s in sets], pa.int64())
        return ["n", "set_id", "keys"], [sizes, _names(sets), _lists(keys, pa.int64())]

    return _map_sets(docs, width, "n long, set_id binary, keys array<long>", fill, keep)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, node, shingles``; ``node`` is the ``set_id`` of the sketch."""
    return _map_sets(
        docs, width, "node binary, shingles array<long>", lambda sets: (["node", "shingles"], [_names(sets), _lists(sets, pa.int64())])
    )


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a, b``) of nodes whose sets share ``percent`` of their union or more.

    Centers with many members are copied, so that a thousand members at most meet a copy.
    """
    counts = stored(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "centers").withColumn("copies", F.expr("cast(n div 1000 + 1 as int)"))
    kept = pairs.columns
    spread = join_counted(pairs, counts, ["b"]).withColumn("salt", F.pmod(F.hash("a"), F.col("copies")))
    centers = counts.select("b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")).join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb")), "b"
    )
    members = spread.select(*kept, "salt").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa")), "a")
    both = members.join(centers, ["b", "salt"])
    shared = F.size(F.array_intersect("_sa", "_sb"))
    union = F.size("_sa") + F.size("_sb") - shared
    return both.where(100 * shared >= percent * union).select(*kept)


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, keep: Sequence[str] = ()
) -> DataFrame:
    """``doc_id``, ``keep``, ``n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``).

    Words are lower-cased (A-Z) and parted by the six ASCII blanks.  Documents whose sets share
    ``percent`` of their union are linked; ``component_id`` is the smallest doc_id reachable
    and ``kept`` marks that document.  Null texts and texts without words have no shingles and
    are linked with nothing.  Rows that repeat a doc_id with the same text give equal rows, of
    which all are marked kept or none; with other texts each row belongs to the group of its
    own text, as sets are linked, not ids.  A null doc_id is linked with nothing and its component
    is null.  ``keep`` names further columns of ``docs`` to hand on, called otherwise than the
    columns of the sketch (``n, set_id, keys``) and of the result; columns left out may have any name.

    Two texts of that similarity share no bucket with a probability below 1e-7 at 32 bands of 4.
    """
    keep = list(keep)
    sketch = stored(sketches(docs, width, bands, rows, keep), "sketches")
    sized = sketch.where("n > 0 and doc_id is not null")
    classes = stored(sized.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")), "set-classes")
    reps = classes.select("set_id", F.col("rep").alias("doc_id"))
    keyed = sized.join(reps, ["set_id", "doc_id"], "left_semi").select("set_id", "n", "keys").dropDuplicates(["set_id"])
    entries = keyed.select(F.explode("keys").alias("key"), F.col("set_id").alias("node"), "n")
    full = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("size", F.col("m"))
    members = join_counted(entries, stored(full, "buckets"), ["key"], "m")
    found = _linked(docs, classes, members, width, percent)
    named = classes.join(found.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = stored(named.withColumn("comp", F.coalesce("comp", "set_id")), "set-components")
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    known = join_counted(named, stored(least, "components"), ["comp"], "sets").select("set_id", "component_id", "m")
    joined = join_counted(sketch.select("doc_id", *keep, "n", "set_id"), stored(known, "set-components"), ["set_id"], "m", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id", *keep, F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _relabelled(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """``nodes`` with the names in ``comp`` replaced by those of ``moved`` (``node, component``)."""
    names = nodes.columns
    counts = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("_m"))
    keyed = stored(moved.withColumnRenamed("node", "comp").join(counts, "comp"), "moved")
    joined = join_counted(nodes, keyed, ["comp"], "_m", "left")
    return stored(joined.withColumn("comp", F.coalesce("component", "comp")).select(*names), "nodes")


def _linked(docs: DataFrame, classes: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """``node, comp`` of the bucket members (``key, node, n, size`` of the bucket).

    The members of each bucket are compared once with its most central one, the one whose buckets
    hold the most members.  Copies with edits of their own are nearest to such a center, so a member
    that it does not hold is rarely held by another.  A bucket of two is settled by that; members
    of larger buckets that then still hold several components go to :func:`_finished`.
    """
    whole = Window.partitionBy("node")  # a node has one row for each band
    rows = stored(members.withColumn("deg", F.sum("size").over(whole)).select("key", "node", "n", "size", "deg"), "bucket-members")
    nodes = stored(rows.groupBy("node").agg(F.max("n").alias("n")).withColumn("comp", F.col("node")), "nodes")
    sources = classes.join(nodes.select(F.col("node").alias("set_id")), "set_id", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.join(sources.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = full_sets(texts, width).select("node", "shingles").join(nodes.select("node").hint("shuffle_hash"), "node", "left_semi")
    sets = stored(sets.dropDuplicates(["node"]), "full-sets")
    first = rows.groupBy("key").agg(F.max(F.struct("deg", "node", "n")).alias("center"), F.first("size").alias("m"))
    at = stored(first.select("key", "m", F.col("center.node").alias("_c"), F.col("center.n").alias("_n")), "stars")
    near = 100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")
    pairs = join_counted(rows, at, ["key"], "m").where(near & (F.col("node") != F.col("_c"))).select(F.col("node").alias("a"), F.col("_c").alias("b"))
    held = stored(confirmed(stored(pairs.distinct(), "candidates"), sets, percent), "confirmed")
    if not held.isEmpty():
        nodes = _relabelled(nodes, stored(components(held), "moved"))
    return _finished(_undecided(rows, nodes), nodes, sets, percent)


def _undecided(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members (``node``) of the buckets of three or more that hold several components of ``nodes``."""
    large = rows.where("size > 2").select("key", "node").join(nodes.select("node", "comp"), "node")
    split = large.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m"))
    split = stored(split.where("low <> high").select("key", "m"), "split")
    return join_counted(rows.select("key", "node"), split, ["key"], "m").select("node").distinct()


def _finished(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, comp`` after the links that the stars did not compare.

    Such a pair shares a bucket that still holds several components, and ``members`` are those
    of these buckets.  They meet by a prefix filter, which loses no pair: with shingles in one order, rarest first,
    two sets that share ``percent`` of their union share a shingle in the first
    n - ceil(percent * n / 100) + 1 of each, and behind the first shared one enough must be
    left on both sides.
    """
    named = nodes.select("node", "comp")
    left = stored(nodes.join(members.hint("shuffle_hash"), "node", "left_semi"), "apart")
    if left.isEmpty():
        return named
    pairs = _prefix_pairs(left, sets, percent)
    held = stored(confirmed(stored(pairs, "candidates"), sets, percent), "confirmed")
    if held.isEmpty():
        return named
    moved = stored(components(held.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "moved")
    return _relabelled(nodes, moved).select("node", "comp")


def _prefix_pairs(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a, b, ca, cb`` of ``left`` (``node, n, comp``) that a prefix filter lets through.

    Only members outside the largest component of a shingle look for partners, so a large
    group is not compared with itself; shingles with many members are salted.
    """
    shingles = left.join(sets, "node").select("node", "n", "comp", F.explode("shingles").alias("shingle"))
    shingles = stored(shingles, "shingles")
    counts = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("df", F.col("m"))
    common = join_counted(shingles, stored(counts, "shingle-counts"), ["shingle"], "m")
    ordered = common.groupBy("node", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("own"))
    # Shingles of one set only come first in the order: they take places and meet nobody.
    alone = F.col("n") - F.size("own")
    first = F.expr(f"n - (n * {percent} + 99) div 100 + 1") - alone
    prefix = ordered.withColumns({"alone": alone, "first": first.cast("int")}).where("first > 0")
    entries = prefix.select("node", "n", "comp", "alone", F.posexplode(F.slice("own", F.lit(1), F.col("first"))).alias("i", "at"))
    # ``rest``: the shingles of the set from this one on.
    entries = stored(entries.select("node", "n", "comp", F.col("at.shingle").alias("shingle"), (F.col("n") - F.col("alone") - F.col("i")).alias("rest")), "prefixes")
    groups = entries.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("k"))
    tops = groups.groupBy("shingle").agg(F.max(F.struct("k", "comp"))["comp"].alias("top"), F.sum("k").alias("m"), F.count(F.lit(1)).alias("groups"))
    tops = tops.where("groups > 1").select("shingle", "top", "m", F.expr("cast(m div 1000 + 1 as int)").alias("copies"))
    met = stored(join_counted(entries, stored(tops, "tops"), ["shingle"], "m"), "met")
    probes = met.where("comp <> top").select(
        "shingle", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("rest").alias("ra"),
        F.col("top"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"),
    )
    held = met.select(
        "shingle", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("rest").alias("rb"),
        F.pmod(F.hash("node"), F.col("copies")).alias("salt"),
    )
    both = probes.join(held, ["shingle", "salt"]).where(
        (F.col("ca") != F.col("cb"))
        & ((F.col("cb") == F.col("top")) | (F.col("a") < F.col("b")))
        & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        & ((100 + percent) * F.least("ra", "rb") >= percent * (F.col("na") + F.col("nb")))
    )
    low = F.col("a") < F.col("b")
    return both.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(low, F.col("ca")).otherwise(F.col("cb")).alias("ca"), F.when(low, F.col("cb")).otherwise(F.col("ca")).alias("cb"),
    ).distinct()
