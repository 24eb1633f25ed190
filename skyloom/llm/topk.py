"""Exact top-k by inner product with multi-resolution segment statistics.

For two vectors cut into segments, the product over a segment of m components is at most
m * (mean * mean' + deviation * deviation'), which is a lower bound of their distance. Few long segments give a cheap,
coarse bound, more and shorter ones a finer one; only candidates that the bounds leave are compared in full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one tile of queries and of candidates; a task holds one of each.
QUERY_TILE, CANDIDATE_TILE = 1024, 4096
#: Longest integers that doubles and their products hold exactly.
EXACT = float(2**53)


def usable(vector: str) -> F.Column:
    """A vector that is not null or empty and has only finite components."""
    ok = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ok


def segment_profile(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products are the upper bounds: root of length times mean and deviation, segment by segment."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    root = [np.sqrt(p.shape[1]) for p in parts]
    mean = np.stack([r * p.mean(1) for r, p in zip(root, parts)], 1)
    return np.concatenate([mean, np.stack([r * p.std(1) for r, p in zip(root, parts)], 1)], 1)


def _products(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Exact products of integer rows of b with a."""
    if np.linalg.norm(a) * max(1.0, float(np.linalg.norm(b, axis=1).max(initial=0))) < EXACT:
        return (b @ a).astype(np.int64).tolist()
    top, ints = 2**63 - 1, [int(v) for v in a]
    return [max(-top - 1, min(top, sum(x * int(y) for x, y in zip(ints, row)))) for row in b]


def top_of_tile(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, levels: tuple[int, ...] = (4, 16)) -> list[tuple[int, int, int]]:
    """(query, candidate, product): the k best of ``c`` for each row of ``q``, ties to the smaller id."""
    profiles = [(segment_profile(q, s), segment_profile(c, s)) for s in levels]
    norms = np.linalg.norm(c, axis=1)
    coarse = profiles[0][0] @ profiles[0][1].T
    first = 4 * k + 8
    out = []
    for i, own in enumerate(q_ids):
        slack = 1e-9 * float(np.linalg.norm(q[i])) * norms + 1e-6  # rounding of the bounds
        bound = coarse[i] + slack
        other = c_ids != own
        seed = np.argpartition(-bound, first)[:first] if len(c) > first else np.arange(len(c))
        seed = seed[other[seed]]
        known = sorted({(s, v) for s, v in zip(_products(q[i], c[seed]), c_ids[seed].tolist())}, reverse=True)
        least = known[k - 1][0] if len(known) >= k else -np.inf
        left = np.nonzero(other & (bound >= least))[0]
        for a, b in profiles[1:]:
            left = left[b[left] @ a[i] + slack[left] >= least]
        scores = _products(q[i], c[left])
        best = sorted({(-s, v) for s, v in zip(scores, c_ids[left].tolist())})[:k]
        out += [(int(own), v, -s) for s, v in best]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k best of ``vectors`` but itself.

    Components count as floor(scale * x); the score is the integer inner product, ties go to the smaller id, and fewer
    than k candidates give fewer rows. Rows with a null key or vector, no component or one that is null or not finite
    take no part; vectors of other lengths are not compared. A key with several vectors counts with each of them, all
    under its name; what they give alike counts once. Scores beyond 64 bits are held at their limit. Queries and
    candidates are dealt by key and vector to tiles of about the same size, and every query tile meets every candidate
    tile in one task. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    bigint = lambda df: df.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).withColumn("dim", F.size("v"))
    c, q = bigint(vectors), bigint(queries)
    c_tiles, q_tiles = max(1, -(-c.count() // CANDIDATE_TILE)), max(1, -(-q.count() // QUERY_TILE))
    tile = lambda n, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cs = c.select("dim", every(q_tiles).alias("qt"), tile(c_tiles, 1).alias("ct"), F.lit(False).alias("is_query"), "id", "v")
    qs = q.select("dim", tile(q_tiles, 2).alias("qt"), every(c_tiles).alias("ct"), F.lit(True).alias("is_query"), "id", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf["is_query"].to_numpy()
        if not mine.any() or mine.all():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        x = np.floor(scale * np.stack(pdf["v"].to_list()).astype(np.float64))
        ids = pdf["id"].to_numpy()
        rows = top_of_tile(x[mine], ids[mine], x[~mine], ids[~mine], k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = qs.union(cs).groupBy("dim", "qt", "ct").applyInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
