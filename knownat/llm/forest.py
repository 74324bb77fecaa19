"""Near duplicates among vectors by a forest of random-projection trees with spill.

A tree splits the vectors of one label again and again at random directions; vectors close to a split go to both sides.  Only
vectors that share a leaf are compared, each pair exactly and once for the whole forest.  Splits are fitted per node on a
bounded sample of its vectors (``SAMPLE``), a few levels a round, and every vector is routed; rounds go on until no leaf is large.
A node whose vectors are all close to one another is not split: it is a leaf of any size, whose pairs are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import stored
from knownat.llm.components import connected

TREES, LEAF, LEVELS = 6, 512, 4
#: At most about this many vectors of a node are sampled to fit its splits.
SAMPLE = 4096
#: Vectors whose projection lies this close to a split go to both sides.
SPILL = 0.03
BLOCK = 2048
KEY = ["tree", "label", "dim", "node"]


@lru_cache(maxsize=4096)
def direction(seed: int, dim: int) -> np.ndarray:
    vector = np.random.default_rng(seed).normal(size=dim)
    return vector / np.linalg.norm(vector)


def units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of length one, in double precision."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def best_split(x: np.ndarray, seed: int, tries: int = 8) -> tuple[int, float] | None:
    """The direction and place with the widest thin stretch in the middle; None if the vectors are all alike."""
    if np.square(x.mean(0)).sum() >= 0.9:
        return None
    best, found = -1.0, None
    width = max(1, len(x) // 50)
    for attempt in range(tries):
        p = np.sort(x @ direction(seed + attempt, x.shape[1]))
        low, high = len(p) // 5, len(p) - len(p) // 5 - width
        if high <= low:
            return None
        gaps = p[low + width:high + width] - p[low:high]
        at = int(gaps.argmax())
        if gaps[at] > best:
            best, found = gaps[at], (seed + attempt, float(p[low + at] + p[low + at + width]) / 2)
    return found


def fit_splits(x: np.ndarray, per_row: float, seed: int, levels: int = LEVELS) -> np.ndarray:
    """A small tree in heap order: seed and threshold of each split, NaN where there is none; ``per_row``: vectors a sample stands for."""
    splits = np.full((1 << levels, 2), np.nan)

    def grow(rows: np.ndarray, place: int) -> None:
        if place >= len(splits) or len(rows) * per_row <= LEAF or len(rows) < 16:
            return
        found = best_split(x[rows], seed + 16 * place)
        if found is None:
            return
        splits[place] = found
        p = x[rows] @ direction(found[0], x.shape[1])
        grow(rows[p <= found[1] + SPILL], 2 * place)
        grow(rows[p >= found[1] - SPILL], 2 * place + 1)

    grow(np.arange(len(x)), 1)
    return splits


def route(x: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, place)`` of every leaf of the small tree that a vector belongs to."""
    rows, places = [], []
    waiting = [(np.arange(len(x)), 1)]
    while waiting:
        own, place = waiting.pop()
        if not len(own):
            continue
        if place >= len(splits) or np.isnan(splits[place, 0]):
            rows.append(own)
            places.append(np.full(len(own), place))
            continue
        p = x[own] @ direction(int(splits[place, 0]), x.shape[1])
        waiting.append((own[p <= splits[place, 1] + SPILL], 2 * place))
        waiting.append((own[p >= splits[place, 1] - SPILL], 2 * place + 1))
    return np.concatenate(rows), np.concatenate(places)


def grow_forest(points: DataFrame, trees: int = TREES, rounds: int = 30) -> DataFrame:
    """``cid, leaf`` for every leaf of every tree that a point belongs to; points have ``cid, label, dim, embedding``."""
    label_kind = points.schema["label"].dataType.simpleString()
    schema = f"cid long, tree int, label {label_kind}, dim int, node long, embedding array<float>, open boolean"

    def fit(group: pa.Table) -> pa.Table:
        first = {name: group.column(name)[0].as_py() for name in (*KEY, "size")}
        x = units(group.column("embedding"))
        seed = (first["node"] * 1_000_003 + first["tree"] * 7919) % (1 << 40)
        splits = fit_splits(x, first["size"] / len(x), seed)
        return pa.table({
            "tree": pa.array([first["tree"]], pa.int32()), "label": group.column("label").slice(0, 1).combine_chunks(),
            "dim": pa.array([first["dim"]], pa.int32()), "node": pa.array([first["node"]], pa.int64()),
            "splits": pa.array([splits.astype("<f8").tobytes()], pa.binary())})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("cid", "tree", "label", "dim", "node", "embedding")
        for batch in batches:
            for value in batch.column("splits").unique():
                part = batch.filter(pa.compute.equal(batch.column("splits"), value)) if value.is_valid else batch.filter(
                    pa.compute.is_null(batch.column("splits")))
                for dim in set(part.column("dim").to_pylist()):
                    own = part.filter(pa.compute.equal(part.column("dim"), dim))
                    splits = np.frombuffer(value.as_py(), "<f8").reshape(-1, 2)
                    rows, places = route(units(own.column("embedding")), splits)
                    taken = own.select(names).take(pa.array(rows))
                    node = np.asarray(taken.column("node")) * (1 << LEVELS + 1) + places
                    # A place at the bottom may be split on; one higher up is a leaf.
                    yield pa.RecordBatch.from_arrays(
                        [*(taken.column(n) for n in names[:4]), pa.array(node % (1 << 61)), taken.column("embedding"),
                         pa.array(places >= len(splits))], [*names, "open"])

    rows = points.select("cid", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "label", "dim",
                         F.lit(1).cast("long").alias("node"), "embedding", F.lit(True).alias("open"))
    done: list[DataFrame] = []
    leaf = F.xxhash64(*KEY).alias("leaf")
    for _ in range(rounds):
        sizes = rows.where("open").groupBy(*KEY).agg(F.count("*").alias("size")).where(F.col("size") > LEAF)
        large = rows.where("open").join(sizes, KEY)
        drawn = F.abs(F.xxhash64("cid", "tree", "node") % 1_000_000) < F.lit(1_000_000.0 * SAMPLE) / F.col("size")
        splits = large.where(drawn).groupBy(*KEY).applyInArrow(
            fit, f"tree int, label {label_kind}, dim int, node long, splits binary")
        done.append(rows.where("NOT open").select("cid", leaf))
        done.append(rows.where("open").join(sizes.select(*KEY), KEY, "left_anti").select("cid", leaf))
        rows = stored(large.join(splits, KEY, "left").withColumn(
            "splits", F.coalesce("splits", F.lit(np.full(4, np.nan).astype("<f8").tobytes()))).mapInArrow(send, schema), "forest")
        if rows.isEmpty():
            break
    else:
        done.append(rows.select("cid", leaf))
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found.distinct()


def leaf_links(members: DataFrame, least: float) -> DataFrame:
    """Links inside leaves: per point the linked rows this leaf accounts for, and an edge to the least id it is connected with.

    ``members`` has ``leaf, size, cid, rep, copies, embedding, leaves``.  A pair is counted in the least leaf it shares.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cid", "leaf"), blocks).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "rep", "copies",
        "embedding", "leaves")

    def run(group: pa.Table) -> pa.Table:
        leaf, within = group.column("leaf")[0].as_py(), group.column("i")[0].as_py() == group.column("j")[0].as_py()
        own, cid, rep, copies = (np.asarray(group.column(c).combine_chunks()) for c in ("own", "cid", "rep", "copies"))
        x = units(group.column("embedding"))
        lists = group.column("leaves").to_pylist()
        before = [[v for v in one if v < leaf] for one in lists]
        width = max(1, max(map(len, before)))
        # Empty places hold small marks of their own, which no two rows share.
        earlier = -1 - np.arange(len(x) * width, dtype=np.int64).reshape(len(x), width)
        for row, one in enumerate(before):
            earlier[row, :len(one)] = one
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(x), np.int64)
        rank[order] = np.arange(len(x))
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(x), 256):
            near = x[a:a + 256] @ x.T >= least
            first, second = np.nonzero(near)
            first = first + a
            fit = first < second if within else own[first] < own[second]
            first, second = first[fit], second[fit]
            for s in range(0, len(first), 1 << 16):
                f, g = first[s:s + (1 << 16)], second[s:s + (1 << 16)]
                again = (earlier[f][:, :, None] == earlier[g][:, None, :]).any((1, 2))
                np.add.at(links, f[~again], copies[g[~again]])
                np.add.at(links, g[~again], copies[f[~again]])
            if len(first):
                edges.append((first, second))
        if edges:
            first, second = (np.concatenate(side) for side in zip(*edges))
            label = rank.copy()
            while True:
                least_label = label.copy()
                np.minimum.at(least_label, first, label[second])
                np.minimum.at(least_label, second, label[first])
                least_label = np.minimum(least_label, least_label[order[least_label]])
                if (least_label == label).all():
                    break
                label = least_label
            label = order[label]
        return pa.table({"cid": cid, "links": links, "a": rep, "b": rep[label]})

    return dealt.groupBy("leaf", "i", "j").applyInArrow(run, "cid long, links long, a long, b long")


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vector.isNotNull() & whole & F.exists(vector, lambda v: v != 0)


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors of equal, not null labels link at a cosine of ``least`` or more, computed in double precision.  Vectors that are null,
    zero, of another length, or hold null or non-finite components link with nothing; so do rows without an id, whose component
    is null.  Equal vectors are one point with a count, so copies add no pairs; repeated rows count as links of one another.
    Rows that repeat an id are one node of the components.  Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<float>").alias("embedding"))
    good = rows.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    grouped = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    points = stored(grouped.select(
        F.monotonically_increasing_id().alias("cid"), "rep", "copies", "label", F.size("embedding").alias("dim"), "embedding"), "points")
    leaves = stored(grow_forest(points), "leaves")
    sizes = leaves.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1")
    shared = leaves.join(sizes, "leaf")
    # A point's leaves are as many as there are trees, times a small spill.
    signature = shared.groupBy("cid").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    members = shared.join(signature, "cid").join(points.select("cid", "rep", "copies", "embedding"), "cid")
    found = stored(leaf_links(members, least), "vector-links")
    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    components = connected(found.select("a", "b")).withColumnRenamed("id", "rep")
    same = points.join(linked, "cid", "left").join(components, "rep", "left").select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), F.coalesce("links", F.lit(0)).alias("links"), "copies",
        F.coalesce("component", "rep").alias("component"))
    joined = rows.withColumn("_good", usable(F.col("embedding")) & F.col("vec_id").isNotNull()).join(
        same, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")) & F.col("_good"), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
