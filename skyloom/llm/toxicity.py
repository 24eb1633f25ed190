"""Toxicity by compression distance between two zstandard dictionaries.

One dictionary is trained on ordinary text, the other on the passages of toxic text that ordinary text lacks, behind
the ordinary dictionary. Every window of a text is compressed with both: a window that the toxic dictionary shortens by
enough bytes is a hit, and the calibrated sum of the bytes saved on hits makes a text toxic.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import Shipped, cut, map_rows, map_scored, raw, sample_ids

#: A window is a token; longer ones are cut into pieces of so many bytes, each half over the one before.
WINDOW = 64
#: Windows are repeated up to this length before compression: zstandard stores shorter blocks as they are.
FILL = 40
GRAM = 6

#: Bytes saved that make a hit are chosen below this.
MOST_HIT = 7


def windows(text: bytes) -> list[bytes]:
    words = text.lower().split()
    if max(map(len, words), default=0) > WINDOW:
        return [w[i : i + WINDOW] for w in words for i in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)]
    return words


@dataclass
class Gauge:
    """The two dictionaries, the bytes saved that make a hit, and the bytes saved on hits that make a text toxic."""

    ordinary: bytes
    toxic: bytes
    hit: int = 4
    enough: int = 6
    threshold: float = 0.7
    level: int = 12
    memo: dict = field(default_factory=dict)

    MEMO = 300_000

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "_sizes")} | {"memo": {}}

    def sizes(self):
        if not hasattr(self, "_sizes"):
            self._sizes = []
            for content in (self.ordinary, self.ordinary + self.toxic):
                params = zs.ZstdCompressionParameters.from_level(self.level, source_size=WINDOW, dict_size=len(content), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
                d = zs.ZstdCompressionDict(content or b"\0" * 8, dict_type=zs.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                self._sizes.append(zs.ZstdCompressor(compression_params=params, dict_data=d).compress)
        return self._sizes

    def gain(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves on a window."""
        known = self.memo.get(window)
        if known is None:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            w = b" " + window + b" "
            w *= max(1, -(-FILL // len(w)))
            a, b = self.sizes()
            known = self.memo[window] = len(a(w)) - len(b(w))
        return known

    def score(self, text: bytes) -> tuple[float, int, int]:
        """(score, windows, hits); the score reaches ``threshold`` when hits save ``enough`` bytes."""
        ws = windows(text)
        memo, gain = self.memo, self.gain
        gains = [memo[w] if w in memo else gain(w) for w in ws]
        hits = [g for g in gains if g >= self.hit]
        return self.of(sum(hits), sum(g == self.hit - 1 for g in gains), len(ws)), len(ws), len(hits)

    def of(self, saved: int, near: int, n: int) -> float:
        """Grows with the bytes saved; near misses only order texts with equally many."""
        s = saved + 0.5 * (1 - math.exp(-near / (1 + 0.02 * n)))
        if saved >= self.enough:
            return 1 - (1 - self.threshold) * math.exp(-(s - self.enough) / 10)
        return self.threshold * 0.98 * min(1.0, s / self.enough)


def _grams(w: bytes) -> set[bytes]:
    w = b" " + w + b" "
    return {w[i : i + GRAM] for i in range(len(w) - GRAM + 1)} or {w}


def _train(size: int, samples: list[bytes], k: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    try:
        return zs.train_dictionary(size, samples, k=k, d=6, level=3).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)


def parts(sample: set[tuple[int, int]]) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """The (signature, label) of the sampled texts to train on, two thirds, and of those to set the numbers of bytes on; all of a few texts."""
    texts = sorted(sample)
    few = len(texts) < 30
    return {t for i, t in enumerate(texts) if i % 3 or few}, {t for i, t in enumerate(texts) if not i % 3 or few}


def train(for_training: list[tuple[int, bytes]]) -> Gauge:
    """The dictionaries from (label, windows of a text with counts, pickled)."""
    number = Counter(y for y, _ in for_training)
    least = max(3, 0.008 * number[1])
    # The runs of toxic texts first: only those that are common there need counting in the others.
    seen = {0: Counter(), 1: Counter()}
    for y in (1, 0):
        for v, bag in for_training:
            if v == y:
                runs = set().union(*map(_grams, pickle.loads(bag)))
                seen[y].update(runs if y else runs & seen[1].keys())
        seen[y] = Counter({g: c for g, c in seen[y].items() if not y or c >= least})
    apart = {g for g, c in seen[1].items() if (c + 0.5) / (number[1] + 1) > 10 * (seen[0].get(g, 0) + 0.5) / (number[0] + 1)}
    toxic, ordinary = [], []
    for y, bag in for_training:
        own = pickle.loads(bag)
        if y == 0 and own:
            ordinary.append(b"".join(b" " + w + b" " for w in own))
        elif y == 1 and (x := b"".join((b" " + w + b" ") * n for w, n in own.items() if not apart.isdisjoint(_grams(w)))):
            toxic.append(x)
    common = Counter(w for x in toxic for w in x.split())
    tail = b"".join(b" " + w + b" " for n, w in sorted((n, w) for w, n in common.items()) if n >= least)
    return Gauge(_train(16384, ordinary, 64) if ordinary else b"", (_train(8192, toxic, 24) if toxic else b"") + tail)


def saved(gauge: Gauge, text: bytes) -> list[int]:
    """The bytes saved on all windows of a text that save 1, 2, ... bytes or more."""
    gains = [(g, n) for w, n in Counter(windows(text)).items() if (g := gauge.gain(w)) > 0]
    return [sum(g * n for g, n in gains if g >= hit) for hit in range(1, MOST_HIT)]


def calibrate(gauge: Gauge, held: list[tuple[int, list[int]]], shares: dict[int, float]) -> None:
    """Sets what makes a hit and what is enough, from (label, bytes saved) of texts, by F with more weight on precision (beta squared 0.5)."""
    weight = {y: shares.get(y, 0.5) / max(1, sum(1 for v, _ in held if v == y)) for y in (0, 1)}
    best = None
    for hit in range(1, MOST_HIT):
        sums = [(y, own[hit - 1]) for y, own in held]
        for enough in range(1, 31):
            tp = sum(weight[1] for y, s in sums if y == 1 and s >= enough)
            fp = sum(weight[0] for y, s in sums if y == 0 and s >= enough)
            fn = sum(weight[1] for y, s in sums if y == 1 and s < enough)
            f = 1.5 * tp / (1.5 * tp + fp + 0.5 * fn) if tp else 0.0
            if best is None or f > best[0]:
                best = f, hit, enough
    gauge.hit, gauge.enough = best[1:]


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1500, threshold: float = 0.7, seed: str = "toxicity", key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: key, score (0 to 1), predicted (1 at ``threshold`` or more), windows, hits.

    Learns from at most ``per_class`` documents of each label, each by all its windows; every window of every document is
    scored. Rows of ``labels`` with null id or label are left out; of several labels for
    an id the largest counts, of several rows of an id the least text. Without toxic documents in the sample nothing is
    a hit. Null and empty texts have no window and score 0. Repeated rows and null keys are returned as they are, an
    empty table gives no rows; other columns are not read, but for ``carry``, which returns every row whole in a struct named row.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    ids, sizes = sample_ids(labels, label, key, per_class, seed)
    gauge = Gauge(b"", b"")
    if ids is not None and sizes.get(1):
        picked = docs.select(key, raw(docs[text]).alias("t")).join(F.broadcast(ids), key).groupBy(key, "y").agg(F.min("t").alias("t")).select("y", "t")

        def signed(b: pa.RecordBatch) -> pa.RecordBatch:
            sig = []
            for t in b.column(1):
                ws = windows(t.as_py())
                h = xxhash.xxh64_intdigest
                sig.append(min((h(b" ".join(ws[i : i + 3])) for i in range(max(1, len(ws) - 2))), default=0) >> 1)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(sig, pa.int64()), b.column(1)], names=["y", "sig", "t"])

        # Copies are told by their signature and count once, by the least of their texts.
        sample = cut(map_rows(picked, "y int, sig bigint, t binary", signed).groupBy("y", "sig").agg(F.min("t").alias("t")))
        teach, held = parts({(r["sig"], r["y"]) for r in sample.select("y", "sig").collect()})

        def bags(b: pa.RecordBatch) -> pa.RecordBatch:
            out = [(y, s, pickle.dumps(dict(Counter(windows(t.as_py()))))) for y, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)) if (s, y) in teach]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["y", "sig", "bag"])

        rows = map_rows(sample, "y int, sig bigint, bag binary", bags).collect()
        found = [(y, bag) for _, y, bag in sorted((r["sig"], r["y"], bytes(r["bag"])) for r in rows)]
        del rows
        gauge = train(found)
        del found
        trained = Shipped(spark, gauge)

        def sums(b: pa.RecordBatch) -> pa.RecordBatch:
            out = [(y, saved(trained.get(), t.as_py())) for y, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)) if (s, y) in held]
            return pa.RecordBatch.from_arrays([pa.array([y for y, _ in out], pa.int32()), pa.array([x for _, x in out], pa.list_(pa.int64()))], names=["y", "saved"])

        got = map_rows(sample, "y int, saved array<bigint>", sums).collect()
        calibrate(gauge, [(r["y"], r["saved"]) for r in got], {y: n / sum(sizes.values()) for y, n in sizes.items()})
    gauge.threshold = threshold
    shipped = Shipped(spark, gauge)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        g = shipped.get()
        got = [g.score(t.as_py()) for t in b.column(1)]
        score = np.array([s for s, _, _ in got])
        cols = [b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array([n for _, n, _ in got], pa.int64()), pa.array([h for _, _, h in got], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=[key, "score", "predicted", "windows", "hits"])

    return map_scored(docs, key, text, carry, f"`{key}` {kind}, score double, predicted int, windows bigint, hits bigint", run)
