"""Exact metric range join of embeddings.

Unit vectors lie ``r`` apart or nearer if and only if their cosine reaches the threshold.
Pivots partition the vectors, each to its nearest pivot.  A vector is copied to another
cell only if the triangle inequality lets a vector of that cell lie within ``r``; every
pair of cells meets in one of the two.  Cells are joined independently, in pairs of
blocks of bounded size, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import stored
from .common import join_counted
from .components import components

BLOCK = 2048


def unit(vectors) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linkable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pivots(classes: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Pivots for every number of components: some vectors chosen by hash, ``most`` at most."""
    out = {}
    for dims, n in classes.groupBy("dims").count().collect():
        wanted = min(most, max(1, math.ceil(math.sqrt(n) / 12)))
        rows = classes.where(F.col("dims") == dims).orderBy(F.xxhash64("same"), "same").select("embedding").limit(wanted).collect()
        out[dims] = unit([r["embedding"] for r in rows])
    return out


def _cells(classes: DataFrame, pivots: dict[int, np.ndarray], r: float) -> DataFrame:
    """``dims, cell, home, same, n, embedding``: each vector in its cell and where it may be needed."""
    sent = classes.sparkSession.sparkContext.broadcast(pivots)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dims, part in frame.groupby("dims"):
                p = sent.value[dims]
                for at in range(0, len(part), 2000):
                    rows = part.iloc[at : at + 2000]
                    yield _placed(rows, p, r)

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.select("dims", "same", "n", "embedding").mapInPandas(
        place, f"dims int, cell int, home boolean, same string, n long, embedding {kind}"
    )


def _placed(rows: pd.DataFrame, p: np.ndarray, r: float) -> pd.DataFrame:
    cos = np.clip(unit(rows["embedding"]) @ p.T, -1, 1)
    far = np.sqrt(2 - 2 * cos)
    home = far.argmin(axis=1)
    nearest = far[np.arange(len(far)), home]
    # A vector u of cell q is no nearer to this one's pivot p than to q.  Within r of v that
    # needs d(v, q) <= d(v, p) + 2 r, and that v lies within r of the plane between p and q.
    apart = np.sqrt(np.maximum(2 - 2 * np.clip(p @ p.T, -1, 1), 1e-18))[home]
    to_plane = (far**2 - nearest[:, None] ** 2) / (2 * apart)
    near = (far <= nearest[:, None] + 2 * r + 1e-9) & (to_plane <= r + 1e-9)
    near &= np.arange(len(p)) < home[:, None]
    i, cell = np.nonzero(near)
    i, cell = np.r_[np.arange(len(rows)), i], np.r_[home, cell]
    out = rows.iloc[i][["dims", "same", "n", "embedding"]].copy()
    out["cell"], out["home"] = cell, np.arange(len(i)) < len(rows)
    return out[["dims", "cell", "home", "same", "n", "embedding"]]


def _tasks(cells: DataFrame, block: int) -> DataFrame:
    """Rows copied to the block pairs of their cell: own blocks with each other and with visitors."""
    counts = cells.groupBy("dims", "cell").agg(
        F.expr(f"cast(ceil(count_if(home) / {block}) as int)").alias("own"), F.expr(f"cast(ceil(count_if(not home) / {block}) as int)").alias("guests")
    )
    sized = cells.join(F.broadcast(stored(counts, "cells")), ["dims", "cell"])  # one row for each pivot
    mixed = F.xxhash64("same")
    block_of = F.when(F.col("home"), F.pmod(mixed, F.col("own"))).otherwise(F.pmod(mixed, F.col("guests"))).cast("int")
    b = F.col("b")

    def task(kind: str, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))

    up_to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    among = F.transform(up_to("own"), lambda x: task("own", F.least(b, x), F.greatest(b, x), (b > x).cast("int")))
    hosts = F.transform(up_to("guests"), lambda x: task("guest", b, x, F.lit(0)))
    visits = F.transform(up_to("own"), lambda x: task("guest", x, b, F.lit(1)))
    tasks = F.when(F.col("home"), F.concat(among, hosts)).otherwise(visits)
    return sized.withColumn("b", block_of).withColumn("t", F.explode(tasks)).select("dims", "cell", "t.*", "same", "n", "embedding")


def _join_block(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Linked rows of one block pair: linked vectors on the other side, one vector reachable here (``root``)."""
    same = frame["kind"].iloc[0] == "own" and frame["i"].iloc[0] == frame["j"].iloc[0]
    left = frame if same else frame[frame["side"] == 0]
    right = frame if same else frame[frame["side"] == 1]
    empty = pd.DataFrame({"same": np.zeros(0, str), "links": np.zeros(0, np.int64), "root": np.zeros(0, str)})
    if not len(left) or not len(right):
        return empty
    x, y = unit(left["embedding"]), unit(right["embedding"])
    found = []
    for at in range(0, len(x), 512):
        i, j = np.nonzero(x[at : at + 512] @ y.T >= least)
        found.append((i + at, j))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    if same:
        i, j = i[i != j], j[i != j]
    if not len(i):
        return empty
    # Places in the pair of blocks stand for vectors until the end.
    names = left["same"].to_numpy() if same else np.r_[left["same"].to_numpy(), right["same"].to_numpy()]
    root_a = np.arange(len(left))
    root_b = root_a if same else np.arange(len(left), len(names))
    while True:
        before = root_a.sum() + root_b.sum()
        low = np.minimum(root_a[i], root_b[j])
        np.minimum.at(root_a, i, low)
        np.minimum.at(root_b, j, low)
        if root_a.sum() + root_b.sum() == before:
            break
    links_a = np.bincount(i, right["n"].to_numpy(float)[j], len(left)).astype(np.int64)
    out = [pd.DataFrame({"same": left["same"].to_numpy(), "links": links_a, "root": names[root_a]})[links_a > 0]]
    if not same:
        links_b = np.bincount(j, left["n"].to_numpy(float)[i], len(right)).astype(np.int64)
        out.append(pd.DataFrame({"same": right["same"].to_numpy(), "links": links_b, "root": names[root_b]})[links_b > 0])
    return pd.concat(out)


def near_embeddings(vectors: DataFrame, least: float = 0.95, most_pivots: int = 4096, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding``).

    Two vectors are linked if the cosine is ``least`` or more.  ``n_links`` counts the other
    rows linked directly, ``component_id`` is the smallest vec_id reachable, ``kept`` marks that
    row.  Null and zero vectors, vectors with a null or non-finite component, and rows without
    a vec_id are linked with nothing; vectors of different lengths are never linked.  Equal
    vectors are joined once; rows that repeat a vec_id count as rows of their own, as vectors are
    linked, not ids.  Only these two columns are read, so others may have any name.
    """
    r = math.sqrt(2 - 2 * least)
    # Copies of a vector go to many pairs of blocks; floats travel as floats and become doubles where they are compared.
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = stored(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.when(linkable(F.col("embedding")) & F.col("vec_id").isNotNull(), F.col("embedding").cast(kind)).alias("embedding"),
        ).withColumn("same", F.md5(F.col("embedding").cast("array<double>").cast("string"))),
        "vectors",
    )
    good = rows.where("embedding is not null")
    groups = good.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    first = good.join(groups.select("same", F.col("rep").alias("vec_id")), ["same", "vec_id"], "left_semi").dropDuplicates(["same"])
    classes = stored(
        groups.join(first.select("same", "embedding"), "same").withColumn("dims", F.size("embedding")), "vector-classes"
    )
    cells = stored(_cells(classes, _pivots(classes, most_pivots), r), "cells")
    found = _tasks(cells, block).groupBy("dims", "cell", "kind", "i", "j").applyInPandas(
        lambda frame: _join_block(frame, least), "same string, links long, root string"
    )
    found = stored(found, "vector-links")
    links = found.groupBy("same").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("same").alias("a"), F.col("root").alias("b")))
    named = classes.select("same", "rep", "n").join(links, "same", "left").join(reach.withColumnRenamed("node", "same"), "same", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "same")), "named")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("m"))
    known = join_counted(named, stored(smallest, "components"), ["component"], "m").select(
        "same", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    joined = join_counted(rows, stored(known, "vector-components"), ["same"], how="left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
