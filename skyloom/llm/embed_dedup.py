"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Unit vectors are rounded to int8 with a scale of their own, and the length of what rounding left is kept. For
x = s*p + d and y = t*r + e, |x.y - s*t*p.r| <= |s*p|*|e| + |d|*|y|, so an integer product says of most pairs that they
are surely below or surely above the threshold; only the rest are compared in full precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import components, cut
from skyloom.llm.topk import usable

#: Vectors of a tile; a task compares two tiles.
TILE = 2048
#: Rounding of the double products that the bounds do not cover.
SLACK = 1e-12


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows as floats, scale, length of the rounding error) of unit rows."""
    scale = np.abs(x).max(1) / 127.0
    q = np.rint(x / scale[:, None])
    return q.astype(np.float32 if x.shape[1] <= 1000 else np.float64), scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, mask): blocks of the rows of x against all of y, true at cosine >= threshold. Rows are not zero."""
    x_len, y_len = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    xu, yu = x / x_len[:, None], y / y_len[:, None]
    (p, s, d), (r, t, e) = quantise(xu), quantise(yu)
    for start in range(0, len(x), 256):
        at = slice(start, start + 256)
        about = (p[at] @ r.T).astype(np.float64) * s[at, None] * t[None, :]
        off = (1 + d[at, None]) * e[None, :] + d[at, None] + SLACK
        mask = about - off >= threshold
        i, j = np.nonzero(~mask & (about + off >= threshold))
        for k in range(0, len(i), 1 << 15):
            a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            cosine = np.einsum("ij,ij->i", x[at][a], y[b]) / (x_len[at][a] * y_len[b])
            mask[a, b] = cosine >= threshold
        yield start, mask


def _forest(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(node, label) where a node's label is less than itself: labels join just the components of the edges."""
    label = np.arange(n)
    a = np.concatenate([x for x, _ in edges]) if edges else np.empty(0, np.int64)
    b = np.concatenate([y for _, y in edges]) if edges else np.empty(0, np.int64)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(before, label):
            child = np.nonzero(label != np.arange(n))[0]
            return child, label[child]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE) -> DataFrame:
    """One row per vector: key, n_links, component_id (least key reachable by links), kept (key = component_id).

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine, in doubles, is at
    least ``threshold``. Null, empty and zero vectors and those with a null or non-finite component link with nothing,
    nor do rows with a null key. Rows are vectors of their own, also those that share a key. Equal vectors of a label
    become one vector with a count, so copies are never paired; the rest of a label is cut into tiles, and each pair of
    tiles gives counts of links and a spanning forest, never its pairs. An empty table gives no rows; other columns are
    not read.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), F.col(label).alias("l"))
    sound = F.coalesce(F.col("id").isNotNull() & F.col("l").isNotNull() & usable("v") & F.exists("v", lambda x: x != 0), F.lit(False))
    fit = rows.where(sound)
    # a distinct vector of a label is known by the least key of its copies, and a hash that tells those of one key apart
    distinct = fit.groupBy("l", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    distinct = cut(distinct.select("l", "v", "n", F.size("v").alias("dim"), F.struct(F.col("rep").alias("id"), F.xxhash64("l", "v").alias("h")).alias("node")))
    tiles = distinct.groupBy("l", "dim").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    placed = distinct.join(tiles, ["l", "dim"]).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles").cast("long")).cast("int"))
    dealt = placed.select("l", "dim", "node", "n", "v", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
    dealt = dealt.select("l", "dim", F.col("node.id").alias("id"), F.col("node.h").alias("h"), "n", "v", "t", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n, t = np.stack(pdf["v"].to_list()).astype(np.float64), pdf["n"].to_numpy(), pdf["t"].to_numpy()
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        left = np.arange(len(x)) if same else np.nonzero(t == pdf["i"].iloc[0])[0]
        right = left if same else np.nonzero(t != pdf["i"].iloc[0])[0]
        links, edges = np.zeros(len(x), np.int64), []
        if len(left) and len(right):
            for start, mask in near_pairs(x[left], x[right], threshold):
                own = left[start : start + len(mask)]
                if same:
                    mask[np.arange(len(own)), np.arange(start, start + len(own))] = False
                links[own] += mask @ n[right]
                if not same:
                    links[right] += n[own] @ mask
                a, b = np.nonzero(mask)
                a, b = _forest_of_block(own[a], right[b], len(x))
                edges.append((a, b))
        child, parent = _forest(len(x), edges)
        ids, h = pdf["id"].to_numpy(), pdf["h"].to_numpy()
        some = links > 0
        out = pd.DataFrame({"id": ids[some], "h": h[some], "links": links[some], "id2": None, "h2": None})
        more = pd.DataFrame({"id": ids[child], "h": h[child], "links": 0, "id2": ids[parent], "h2": h[parent]})
        return pd.concat([out, more]).astype({"id2": "Int64", "h2": "Int64"})

    found = cut(dealt.groupBy("l", "dim", "i", "j").applyInPandas(run, "id long, h long, links long, id2 long, h2 long"))
    node = F.struct("id", "h")
    groups = components(found.where("id2 is not null").select(node.alias("a"), F.struct(F.col("id2").alias("id"), F.col("h2").alias("h")).alias("b")))
    counts = found.where("links > 0").groupBy(node.alias("node")).agg(F.sum("links").alias("links"))
    done = distinct.select("l", "v", "n", "node").join(counts, "node", "left").join(groups, "node", "left")
    done = done.select("l", "v", F.col("n").alias("copies"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node")["id"].alias("component"))
    linked = fit.join(done, ["l", "v"]).select("id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.union(alone)
    return both.select(F.col("id").cast(kind).alias(key), "n_links", F.col("component_id").cast(kind).alias("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _forest_of_block(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a block thinned to its spanning forest, so a tile of near copies holds few."""
    return (a, b) if len(a) <= 4 * n else _forest(n, [(a, b)])
