"""Joins in space without a tree: points meet through the cells of a grid."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import cut

AXES = ("x", "y", "z")


def cell(p: Column, size) -> Column:
    return F.floor(p / size).cast("long")


def _prefixed(points: DataFrame, id: str, mark: str) -> DataFrame:
    return points.select(F.col(id).alias(f"{mark}id"), *[F.col(a).alias(f"{mark}{a}") for a in AXES])


def distance(a: str, b: str) -> Column:
    return F.sqrt(sum(((F.col(f"{a}{x}") - F.col(f"{b}{x}")) ** 2 for x in AXES), F.lit(0.0)))


def radius_join(left: DataFrame, right: DataFrame, radius: float, left_id: str = "splat_id", right_id: str = "splat_id") -> DataFrame:
    """(lid, rid, dist): all pairs at distance <= radius, a point with itself included.

    Right points lie in one cell of edge ``radius``, left points are sent to the 27 cells around theirs, so each pair
    meets once. Points with null, NaN or infinite coordinates pair with none.
    """
    sound = lambda df: df.where(reduce(lambda a, b: a & b, [F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(F.col(x)) < float("inf")) for x in AXES]))
    l, r = _prefixed(sound(left), left_id, "l"), _prefixed(sound(right), right_id, "r")
    r = r.select("*", *[cell(F.col(f"r{a}"), radius).alias(f"c{a}") for a in AXES])
    steps = F.array(*[F.struct(*[F.lit(d).alias(a) for d, a in zip((i, j, k), AXES)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    l = l.select("*", F.explode(steps).alias("d"))
    l = l.select("lid", "lx", "ly", "lz", *[(cell(F.col(f"l{a}"), radius) + F.col(f"d.{a}")).alias(f"c{a}") for a in AXES])
    pairs = l.join(r, [f"c{a}" for a in AXES]).select("lid", "rid", distance("l", "r").alias("dist"))
    return pairs.where(F.col("dist") <= radius)


#: Points of a leaf of the k-d tree at most and at least, about; points of a tile within a leaf.
LEAF, LEAST_LEAF, TILE = 50_000, 2_000, 256
#: Points that the tree is made of for each leaf, and leaves at most.
SAMPLE, LEAVES = 64, 20_000


class Leaves:
    """A k-d tree over a sample: regions that fill space, so every point lies in one leaf."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.at, self.child = [], [], []
        self.boxes: list[np.ndarray] = []
        self._grow(sample, leaves, np.array([[-np.inf] * 3, [np.inf] * 3]))
        self.box = np.stack(self.boxes)

    def _grow(self, p: np.ndarray, leaves: int, box: np.ndarray) -> int:
        """The node made: a number below zero is a leaf."""
        wide = int(np.argmax(p.max(0) - p.min(0))) if len(p) > 1 else 0
        at = float(np.median(p[:, wide])) if len(p) > 1 else 0.0
        low = p[:, wide] < at if len(p) > 1 else None
        if leaves < 2 or low is None or not low.any():
            self.boxes.append(box)
            return -len(self.boxes)
        node = len(self.axis)
        self.axis.append(wide)
        self.at.append(at)
        self.child.append((0, 0))
        left, right = box.copy(), box.copy()
        left[1, wide] = right[0, wide] = at
        self.child[node] = self._grow(p[low], leaves // 2, left), self._grow(p[~low], leaves - leaves // 2, right)
        return node

    def leaf_of(self, p: np.ndarray) -> np.ndarray:
        if not self.axis:
            return np.zeros(len(p), np.int32)
        axis, at, child = np.array(self.axis), np.array(self.at), np.array(self.child)
        node = np.zeros(len(p), np.int64)
        while (inner := np.flatnonzero(node >= 0)).size:
            n = node[inner]
            node[inner] = child[n, (p[inner, axis[n]] >= at[n]).astype(int)]
        return (-1 - node).astype(np.int32)


def _gap(low: np.ndarray, high: np.ndarray, box_low: np.ndarray, box_high: np.ndarray) -> np.ndarray:
    """Least distance between boxes; points are boxes too."""
    return np.sqrt((np.maximum(np.maximum(box_low - high, low - box_high), 0) ** 2).sum(-1))


def _tiles(p: np.ndarray) -> list[np.ndarray]:
    """Indices of ``p`` in tiles of at most TILE points, by halves along the longest side."""
    todo, out = [np.arange(len(p))], []
    while todo:
        i = todo.pop()
        if len(i) <= TILE:
            out.append(i)
            continue
        axis = int(np.argmax(p[i].max(0) - p[i].min(0)))
        order = np.argpartition(p[i, axis], len(i) // 2)
        todo += [i[order[: len(i) // 2]], i[order[len(i) // 2 :]]]
    return out


def _best(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least of each row in order, ties to the smaller id; infinite ones do not count."""
    most = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(d), 1), np.inf)
    row, col = np.nonzero((d <= most) & (d < np.inf))
    order = np.lexsort((ids[col], d[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], col[nth < k]


def _search(q: np.ndarray, q_ids: np.ndarray, reach: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, distance): the k nearest of ``p`` other than itself for each query, none beyond its ``reach``.

    Of points at one place only the k + 1 of least id can be among the nearest, so a heap of copies costs no more.
    """
    order = np.lexsort((ids, p[:, 2], p[:, 1], p[:, 0]))
    p, ids = p[order], ids[order]
    new = np.concatenate([[True], (p[1:] != p[:-1]).any(1)]) if len(p) else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0)) if len(p) else np.empty(0, np.int64)
    few = np.arange(len(p)) - first <= k
    p, ids = p[few], ids[few]
    tiles = _tiles(p) if len(p) else []
    low, high = (np.stack([f(p[t], axis=0) for t in tiles]) if tiles else np.empty((0, 3)) for f in (np.min, np.max))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for own in _tiles(q) if len(p) else []:
        far = _gap(q[own].min(0), q[own].max(0), low, high)
        near, limit = np.argsort(far, kind="stable"), reach[own]
        count = np.cumsum([len(tiles[t]) for t in near])
        begin = int(np.searchsorted(count, k + 1)) + 1

        def distances(some: np.ndarray, own: np.ndarray = own) -> tuple[np.ndarray, np.ndarray]:
            c = np.concatenate([tiles[t] for t in some])
            d = np.sqrt(((q[own][:, None, :] - p[c][None, :, :]) ** 2).sum(-1))
            d[q_ids[own][:, None] == ids[c][None, :]] = np.inf
            return d, c

        d, c = distances(near[:begin])
        if begin < len(near):
            kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(own), np.inf)
            limit = np.minimum(limit, kth)
            d, c = distances(near[: max(begin, int(np.searchsorted(far[near], limit.max(), "right")))])
        d[d > reach[own][:, None]] = np.inf
        row, col = _best(d, ids[c], k)
        out.append((own[row], ids[c[col]], d[row, col]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, ids.dtype), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def knn(points: DataFrame, k: int, id: str = "splat_id") -> DataFrame:
    """(id, neighbor, dist, rank): the k nearest other points of each point, ties to the smaller id.

    Points are dealt to the leaves of a k-d tree over a bounded sample, so dense places get small leaves. Each leaf finds
    the nearest among its own; a point whose k-th distance reaches into other leaves asks those, and only such points are
    ranked once more. Fewer than k other points are all returned. Points with null, NaN or infinite coordinates have no
    neighbours and are none.
    """
    spark = points.sparkSession
    kind = points.schema[id].dataType.simpleString()
    sound = reduce(lambda a, b: a & b, [F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(F.col(x)) < float("inf")) for x in AXES])
    p = points.where(sound).select(F.col(id).alias("id"), *[F.col(a).cast("double").alias(a) for a in AXES])
    n = p.count()
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = int(min(LEAVES, max(1, -(-n // min(LEAF, max(LEAST_LEAF, n // tasks))))))
    sample = np.array(p.orderBy(F.xxhash64("id")).limit(SAMPLE * leaves).select(*AXES).collect() if leaves > 1 else [], np.float64).reshape(-1, 3)
    tree = Leaves(sample, leaves)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=tree.leaf_of(b[list(AXES)].to_numpy(np.float64)))

    placed = cut(p.mapInPandas(place, f"id {kind}, x double, y double, z double, leaf int"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        at, ids, leaf = pdf[list(AXES)].to_numpy(np.float64), pdf["id"].to_numpy(), int(pdf["leaf"].iloc[0])
        row, rid, dist = _search(at, ids, np.full(len(at), np.inf), at, ids, k)
        full = np.bincount(row, minlength=len(at)) >= k
        kth = np.full(len(at), np.inf)
        np.maximum.at(reached := np.zeros(len(at)), row, dist)
        kth[full] = reached[full]
        asked = []
        others = np.flatnonzero((_gap(at.min(0), at.max(0), tree.box[:, 0], tree.box[:, 1]) <= kth.max()) & (np.arange(len(tree.box)) != leaf))
        for t in _tiles(at) if len(others) else []:
            some = others[_gap(at[t].min(0), at[t].max(0), tree.box[others, 0], tree.box[others, 1]) <= kth[t].max()]
            i, j = np.nonzero(_gap(at[t][:, None], at[t][:, None], tree.box[some, 0][None], tree.box[some, 1][None]) <= kth[t][:, None])
            asked.append((t[i], some[j]))
        i, to = (np.concatenate(x) for x in zip(*asked)) if asked else (np.empty(0, np.int64), np.empty(0, np.int64))
        open_ = np.zeros(len(at), bool)
        open_[i] = True
        order = np.lexsort((rid, dist, row))
        row, rid, dist = row[order], rid[order], dist[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row) + 1
        found = pd.DataFrame({"id": ids[row], "neighbor": rid, "dist": dist, "rank": np.where(open_[row], 0, nth), "leaf": -1, "x": 0.0, "y": 0.0, "z": 0.0})
        asks = pd.DataFrame({"id": ids[i], "neighbor": ids[i], "dist": kth[i], "rank": 0, "leaf": to, "x": at[i, 0], "y": at[i, 1], "z": at[i, 2]})
        return pd.concat([found, asks])

    first = cut(placed.groupBy("leaf").applyInPandas(inside, f"id {kind}, neighbor {kind}, dist double, rank int, leaf int, x double, y double, z double"))

    def outside(asks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        q, ids = asks[list(AXES)].to_numpy(np.float64), asks["id"].to_numpy()
        row, rid, dist = _search(q, ids, asks["dist"].to_numpy(), own[list(AXES)].to_numpy(np.float64), own["id"].to_numpy(), k) if len(q) and len(own) else (np.empty(0, np.int64), ids[:0], np.empty(0))
        return pd.DataFrame({"id": ids[row], "neighbor": rid, "dist": dist})

    asks = first.where("leaf >= 0").select("leaf", "id", "dist", *AXES)
    more = asks.groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInPandas(outside, f"id {kind}, neighbor {kind}, dist double")
    found = first.where("leaf < 0")
    order = Window.partitionBy("id").orderBy("dist", "neighbor")
    rest = found.where("rank = 0").select("id", "neighbor", "dist").union(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    both = found.where("rank > 0").select("id", "neighbor", "dist", "rank").union(rest)
    return both.select(F.col("id").alias(id), "neighbor", "dist", "rank")


#: Edges of a partition while components are contracted, about.
EDGES = 200_000


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, component), component the least node reached.

    Alternating large-star and small-star contraction. Each round is joins and min-aggregates over edges, so no
    component or neighbour list is gathered anywhere; a hub meets its one minimum in a join that Spark may split.
    Every round is cut by a reliable checkpoint. Nulls and self-loops are ignored. Nodes in no edge are not returned.
    Partitions are as many as the edges need, so that few edges do not become many small files in each round.
    Rounds grow with the logarithm of the nodes; should ``max_rounds`` not do, this raises rather than return part.
    """
    mark, parts = None, None
    few = lambda df: df if parts is None else df.coalesce(parts)
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if not now[0] or now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark, parts = now, 1 + now[0] // EDGES
        e = few(e)
        both = few(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = few(few(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = few(large.join(least, "u")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = cut(few(small))
    raise RuntimeError(f"components are not contracted after {max_rounds} rounds")


def voxel_mean(points: DataFrame, size: float, values: tuple[str, ...] = (*AXES, "r", "g", "b"), id: str = "cand_id") -> DataFrame:
    """Mean of ``values`` and count for each voxel floor(p / size), with the least id for first-seen order."""
    keys = [cell(F.col(a), size).alias(f"v{a}") for a in AXES]
    return points.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in values], F.count("*").alias("n"), F.min(id).alias("first_id"))


def voxel_mean_within(points: DataFrame, size: float, most: int, grow: float = 1.5, tries: int = 20, **kw) -> tuple[DataFrame, float]:
    """``voxel_mean`` with the voxel grown until at most ``most`` remain; (result, voxel size)."""
    for _ in range(tries):
        out = voxel_mean(points, size, **kw)
        if out.limit(most + 1).count() <= most:
            return out, size
        size *= grow
    raise RuntimeError(f"more than {most} voxels after {tries} tries")
