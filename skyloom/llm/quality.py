"""Quality by nearest-neighbour voting over latent-semantic vectors.

A document is a bag of terms: its words, hashed, trigrams of character classes, and a few measures of repetition.
Truncated SVD of the bags of a bounded labelled sample, weighted by inverse document frequency, gives the latent axes;
the sample's vectors are broadcast, every document is compared with all of them in blocks, and its nearest ones vote by
similarity.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import Shipped, map_rows, map_scored, raw, sample_ids

CLASSES = 16
GRAMS = CLASSES**3
REPEAT_BINS = 32
#: Words go to so many terms by hash.
WORDS = 2048
FEATURES = GRAMS + 3 * REPEAT_BINS + WORDS


def _classes() -> np.ndarray:
    """Class of each byte: letters, capitals, digits, white space, marks by kind; letters beyond ASCII count as letters."""
    c = np.zeros(256, np.uint16)
    for b in range(33, 127):
        c[b] = 8 + b % 8
    c[[ord(x) for x in " "]] = 3
    c[[9, 10, 11, 12, 13]] = 4
    c[[ord(x) for x in ".,;:'\"()-"]] = 5
    c[[ord(x) for x in "!?"]] = 6
    c[[ord(x) for x in "|=<>/\\_"]] = 7
    c[ord("a") : ord("z") + 1] = 0
    c[ord("A") : ord("Z") + 1] = 1
    c[ord("0") : ord("9") + 1] = 2
    return c


_CLASS = _classes()


def features(text: bytes) -> np.ndarray:
    """Square roots of shares: of class trigrams, of hashed words, and one mark each on three scales of repetition."""
    out = np.zeros(FEATURES, np.float32)
    b = np.frombuffer(text, np.uint8)
    c = _CLASS[b[b < 0x80]] if (b >= 0x80).any() else _CLASS[b]
    high = b >= 0xC3  # a lead byte stands for its letter
    if high.any():
        c = np.where(high, 0, _CLASS[np.minimum(b, 127)])[(b < 0x80) | high]
    if len(c) > 2:
        grams = c[:-2].astype(np.int64) * CLASSES**2 + c[1:-1] * CLASSES + c[2:]
        out[:GRAMS] = np.sqrt(np.bincount(grams, minlength=GRAMS) / len(grams))
    words = text.lower().split()
    if words:
        n = len(words)
        terms = np.fromiter(map(zlib.crc32, words), np.int64, n) % WORDS
        out[-WORDS:] = np.sqrt(np.bincount(terms, minlength=WORDS) / n)
        same = sum(map(bytes.__eq__, words, words[1:])) / n
        pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
        for k, share in enumerate((same, len(set(words)) / n / max(0.05, 1 / np.log2(n + 2)), pairs)):
            at = min(REPEAT_BINS - 1, int(share * REPEAT_BINS / (2 if k == 1 else 1)))
            for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25)):
                out[GRAMS + k * REPEAT_BINS + min(REPEAT_BINS - 1, max(0, at + d))] += w
    return out


@dataclass
class Voters:
    axes: np.ndarray  # features x rank, idf included
    vectors: np.ndarray  # labelled documents x rank, unit length
    votes: np.ndarray  # weight of each, its class brought back to its true share
    labels: np.ndarray
    k: int
    sharpness: float

    def score(self, bags: np.ndarray) -> np.ndarray:
        """Share of the similarity-weighted votes that the nearest labelled vectors cast for 1."""
        v = unit(bags @ self.axes)
        sims = v @ self.vectors.T
        k = min(self.k, sims.shape[1])
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        w = np.clip(np.take_along_axis(sims, near, 1), 0, None).astype(np.float64) ** self.sharpness * self.votes[near] + 1e-12
        return np.clip((w * self.labels[near]).sum(1) / w.sum(1), 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _leading(x: np.ndarray, rank: int, spare: int = 16, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors of x as columns, by subspace iteration from a fixed start."""
    q = np.random.default_rng(11).standard_normal((x.shape[1], min(rank + spare, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank]


def fit(bags: np.ndarray, y: np.ndarray, shares: dict[int, float], rank: int, k: int, sharpness: float) -> Voters:
    idf = np.log((1 + len(bags)) / (1 + (bags > 0).sum(0))) + 0.1
    axes = (idf[:, None] * _leading(bags * idf.astype(np.float32), rank)).astype(np.float32)
    weight = np.array([shares.get(int(v), 0) / max(1, (y == v).sum()) for v in y])
    return Voters(axes, unit(bags @ axes), weight / weight.mean(), y.astype(np.float64), k, sharpness)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1200, rank: int = 48, k: int = 15, sharpness: float = 16.0, threshold: float = 0.5, seed: str = "quality", key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: key, score (0 to 1), predicted (1 at ``threshold`` or more).

    Learns from at most ``per_class`` documents of each label among ``labels`` (rows with null id or label are left
    out; of several labels for an id the largest counts; of several rows of an id the least text); votes are weighted
    so that each label has its true share. Without labelled documents every score is 0.5; with one label only, it is that label. Null and empty texts are
    scored as empty texts. Repeated rows and null keys are returned as they are, an empty table gives no rows; other
    columns are not read, but for ``carry``, which returns every row whole in a struct named row. Equally near
    neighbours beyond the last place are left out in the order of the sample.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    ids, sizes = sample_ids(labels, label, key, per_class, seed)
    model = None
    if ids is not None:
        picked = docs.select(key, raw(docs[text]).alias("t")).join(F.broadcast(ids), key).groupBy(key, "y").agg(F.min("t").alias("t")).select("y", "t")

        def bags(b: pa.RecordBatch) -> pa.RecordBatch:
            out = [features(t.as_py()).astype(np.float16).tobytes() for t in b.column(1)]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["y", "bag"])

        rows = map_rows(picked, "y int, bag binary", bags).collect()
        if rows:
            found = sorted((r["y"], bytes(r["bag"])) for r in rows)
            del rows
            x = np.frombuffer(b"".join(b for _, b in found), np.float16).reshape(len(found), FEATURES).astype(np.float32)
            model = fit(x, np.array([y for y, _ in found]), {y: n / sum(sizes.values()) for y, n in sizes.items()}, rank, k, sharpness)
    shipped = Shipped(spark, model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shipped.get()
        if m is None:
            score = np.full(b.num_rows, 0.5)
        else:
            score = np.concatenate([m.score(np.stack([features(t.as_py()) for t in b.column(1).slice(i, 256)])) for i in range(0, b.num_rows, 256)])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[key, "score", "predicted"])

    return map_scored(docs, key, text, carry, f"`{key}` {kind}, score double, predicted int", run)
