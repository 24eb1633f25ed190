"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The rows of a source stand in the order of a hash, a random permutation, which is cut into blocks. A source is drawn in
passes over its blocks: as many whole ones as its target holds, then a last one that takes documents by first fit until
no further one fits. The blocks drawn of a source are its quota. A tree halves the output shards again and again; each
half gets its exact share of every source's quota, drawn from the multivariate hypergeometric distribution. A shard draws
the next blocks of each source's permutation, so many as its quotas say, and shuffles its documents by a hash. A
document is taken once for each drawn block that holds it.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import cut

#: All sources have about this many blocks at most together, so the block table on the driver has a bound.
MAX_BLOCKS = 60_000
#: Documents a block has on average until MAX_BLOCKS is reached.
BLOCK_DOCS = 32
#: More sources than this are an error: a row for each reaches the driver and every task.
MAX_SOURCES = 50_000
#: Documents that the search for the end of the last pass reads on the driver at once: of a source, and in all.
FEW, FEW_IN_ALL = 2_000, 2_000_000
WORD = r"[^\x20\x09-\x0D]+"
#: Hashes lie in 0 .. TOP - 1.
TOP = 1 << 63


def targets(sizes: list[tuple[str | None, int]], weights: list[int], most: int = 3) -> dict[str | None, Fraction]:
    """Words to take from each source: its share of all words by weight, at most ``most`` times its size, the excess
    going to the others by weight until none is above. Sources go by code point, null last; weights repeat."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = Fraction(sum(size.values())), set(size), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > most * size[s]}
        if not full:
            return out | {s: share * weight[s] for s in open_}
        for s in full:
            out[s] = Fraction(most * size[s])
            left -= out[s]
        open_ -= full
    return out


def split_quota(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of sources by shard, shape (shards, sources): exact sums, each split multivariate hypergeometric."""
    if shards == 1:
        return quota[None, :]
    half = shards // 2
    total = int(quota.sum())
    take = total * half // shards
    left = rng.multivariate_hypergeometric(quota, take, method="marginals") if len(quota) else quota
    return np.concatenate([split_quota(left, half, rng), split_quota(quota - left, shards - half, rng)])


def _numbered(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """(k, s, size, h): each row with its place in the permutation, the same in every run.

    Rows alike in key, source and text are counted and numbered, which tells them apart: a million copies of a row are a
    count to the shuffle, and a null key is a key like others.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    alike = docs.select(F.col(key).alias("k"), F.col(source).cast("string").alias("s"), size.alias("size"), F.xxhash64(F.col(key), F.col(text), F.lit(seed)).alias("h"))
    alike = alike.groupBy("k", "s", "size", "h").agg(F.count("*").alias("n"))
    runs = alike.withColumn("run", F.explode(F.expr("sequence(0L, (n - 1) div 100000)")))
    each = runs.withColumn("nth", F.explode(F.expr("sequence(run * 100000, least(n, (run + 1) * 100000) - 1)")))
    return each.select("k", "s", "size", F.shiftrightunsigned(F.xxhash64("h", "nth"), 1).alias("h"))


class LastPass:
    """How far the last pass over a source has come: documents below ``at`` are decided.

    ``steps`` are (cap, below): taken are documents of at most ``cap`` words whose hash lies below. Caps fall and hashes
    grow from step to step, so they say what first fit in the order of the hashes takes.
    """

    def __init__(self, left: int):
        self.left, self.cap, self.at, self.to, self.steps = left, left, 0, TOP, []

    def over(self, size: int, h: int) -> None:
        """The next candidate at ``h``: taken, or from here on only those count that still fit."""
        if size <= self.left:
            self.left -= size
        elif size <= self.cap:
            self.steps.append((self.cap, h))
            self.cap = self.left

    def bins(self, width: int, found: list[tuple[int, int, int]]) -> bool:
        """Goes over (bin, words, documents); False at a bin that must be looked into, which is then all of [at, to)."""
        for k, words, n in found:
            start = self.at + k * width
            if words <= self.left:
                self.left -= words
            elif n == 1:
                self.over(words, start)
            else:
                self.at, self.to = start, min(start + width, self.to)
                return False
        self.at, self.to = self.to, TOP
        return True

    def end(self) -> None:
        if self.cap:
            self.steps.append((self.cap, self.at))
        self.cap = 0

    @property
    def open(self) -> bool:
        return self.left > 0 and self.at < TOP


def _last_passes(rows: DataFrame, left: dict[int, int]) -> dict[int, LastPass]:
    """The last pass of each source that still wants words, over ``rows(i, size, h)``.

    A round adds up words by equal ranges of hashes. Ranges that fit are taken whole; the first that does not is looked
    into: by its documents where they are few, else by ranges of its own. Then the rest follows, with only those
    documents counting that still fit. Each round reads sums or a bounded number of documents, whatever the table's size.
    """
    spark = rows.sparkSession
    passes = {i: LastPass(n) for i, n in left.items()}
    while wanted := {i: p for i, p in passes.items() if p.open}:
        bins = max(16, min(1024, MAX_BLOCKS // len(wanted)))
        width = {i: (p.to - p.at) // bins + 1 for i, p in wanted.items()}

        def candidates(of: list[int]) -> DataFrame:
            ask = [(i, passes[i].at, passes[i].to if passes[i].to < TOP else -1, passes[i].cap, width[i]) for i in of]  # a long does not hold TOP
            asked = spark.createDataFrame(ask, "i int, at long, to long, cap long, width long")
            return rows.join(F.broadcast(asked), "i").where("size between 1 and cap and h >= at and (h < to or to < 0)")

        found: dict[int, list[tuple[int, int, int]]] = {i: [] for i in wanted}
        for r in candidates(list(wanted)).groupBy("i", F.expr("(h - at) div width").alias("bin")).agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect():
            found[r["i"]].append((r["bin"], int(r["w"]), r["n"]))
        look = []
        for i, p in wanted.items():
            begin = p.at
            if not p.bins(width[i], sorted(found[i])):
                n = next(n for k, _, n in found[i] if begin + k * width[i] == p.at)
                if n <= min(FEW, FEW_IN_ALL // len(wanted)):
                    look.append(i)
        if look:
            for r in sorted(candidates(look).select("i", "h", "size").collect(), key=lambda r: (r["i"], r["h"], r["size"])):
                passes[r["i"]].over(r["size"], r["h"])
            for i in look:
                passes[i].at, passes[i].to = passes[i].to, TOP
    for p in passes.values():
        p.end()
    return passes


def _taken_last() -> Column:
    """Whether the last pass takes a document: by its source's steps, but for the one exchanged for another."""
    by_steps = (F.col("size") > 0) & F.exists("steps", lambda s: (F.col("size") <= s["cap"]) & ((F.col("h") < s["below"]) | (s["below"] < 0)))
    return F.coalesce((by_steps & (F.col("h") != F.col("gone"))) | (F.col("h") == F.col("came")), F.lit(False))


def _exchanges(rows: DataFrame, passes: dict[int, LastPass]) -> dict[int, tuple[int, int]]:
    """For each source that missed its target the hashes (gone, came) of documents to exchange; -1: none.

    One document more, or one in place of the shortest or the longest taken, if that comes nearer to the target.
    """
    short = {i: p for i, p in passes.items() if p.left > 0}
    if not short:
        return {}
    marked = rows.join(F.broadcast(_steps_table(rows, short, {})), "i").withColumn("taken", _taken_last()).where("size > 0")
    own = F.struct("size", "h")
    ends = {r["i"]: [(0, -1)] + [(x["size"], x["h"]) for x in (r["low"], r["high"]) if x] for r in marked.where("taken").groupBy("i").agg(F.min(own).alias("low"), F.max(own).alias("high")).collect()}
    out_of = {i: (ends.get(i, [(0, -1)]) * 3)[:3] for i in short}
    wants = rows.sparkSession.createDataFrame([(i, *[short[i].left + size for size, _ in out]) for i, out in out_of.items()], "i int, w0 long, w1 long, w2 long")
    free = marked.where("not taken").join(F.broadcast(wants), "i")
    nearest = free.groupBy("i").agg(*[F.min(F.struct(F.abs(F.col("size") - F.col(f"w{k}")).alias("miss"), "size", "h")).alias(f"b{k}") for k in range(3)])
    swaps = {}
    for r in nearest.collect():
        i = r["i"]
        miss, k = min((r[f"b{k}"]["miss"], k) for k in range(3))
        if miss < short[i].left:
            swaps[i] = out_of[i][k][1], r[f"b{k}"]["h"]
    return swaps


def _steps_table(rows: DataFrame, passes: dict[int, LastPass], swaps: dict[int, tuple[int, int]]) -> DataFrame:
    entries = [(i, p.left, [(cap, below if below < TOP else -1) for cap, below in p.steps], *swaps.get(i, (-1, -1))) for i, p in passes.items()]
    return rows.sparkSession.createDataFrame(entries, "i int, left long, steps array<struct<cap: long, below: long>>, gone long, came long")


def deal(blocks: dict[int, tuple[int, list[int], list[int]]], shards: int, seed: int) -> dict[int, tuple[np.ndarray, dict[int, int]]]:
    """Shards of the drawn blocks. ``blocks``: by source the whole passes, its blocks, and those of the last pass.

    Gives by source the shard of each block in each whole pass, shape (passes, blocks), and in the last pass. Quotas
    come from the tree; a shard takes so many next blocks of each source's passes.
    """
    order = sorted(blocks)
    quota = np.array([blocks[i][0] * len(blocks[i][1]) + len(blocks[i][2]) for i in order], np.int64)
    parts = split_quota(quota, shards, np.random.default_rng(seed))
    out = {}
    for j, i in enumerate(order):
        passes, own, last = blocks[i]
        slots = np.repeat(np.arange(shards), parts[:, j])
        cut_at = passes * len(own)
        out[i] = slots[:cut_at].reshape(passes, len(own)), dict(zip(last, slots[cut_at:].tolist()))
    return out


def mix(docs: DataFrame, weights: list[int] | None = None, most: int = 3, shards: int = 16, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: key, source, size, source_size, target, taken, times, block, shards, orders.

    ``size`` counts words; ``shards`` are those of the drawn blocks that hold the document, one for each copy, and
    ``orders`` its places in them; ``times`` is their number (0 to ``most``), ``taken`` = times * size. A source's words
    miss its target by less than the shortest of its documents that first fit leaves. Null and empty texts have size
    0 and go with the whole passes; a null source is a source of its own, last in order; a source without words has
    target 0. Repeated rows are documents of their own, null keys are dealt like others, other columns are not read. An
    empty table gives no rows. More than MAX_SOURCES sources are an error.
    """
    weights = weights or [1, 2, 3]
    spark = docs.sparkSession
    numbered = cut(_numbered(docs, key, text, source, seed))
    totals = [(r["s"], r["n"], int(r["w"])) for r in numbered.groupBy("s").agg(F.count("*").alias("n"), F.sum("size").alias("w")).limit(MAX_SOURCES + 1).collect()]
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    order = sorted(totals, key=lambda t: (t[0] is None, t[0] or ""))
    want = targets([(s, w) for s, _, w in order], weights, most) if order else {}
    per_block = max(BLOCK_DOCS, -(-sum(n for _, n, _ in order) // MAX_BLOCKS))
    whole = {i: int(want[s] // w) if w else 0 for i, (s, _, w) in enumerate(order)}
    dims = [(i, s, w, float(want[s]), TOP // max(1, n // per_block) + 1 if n >= 2 * per_block else TOP - 1) for i, (s, n, w) in enumerate(order)]
    dim = F.broadcast(spark.createDataFrame(dims, "i int, s2 string, source_size long, target double, width long"))
    placed = numbered.join(dim, F.col("s").eqNullSafe(F.col("s2"))).drop("s2").withColumn("block", F.expr("cast(h div width as int)"))
    rows = placed.select("i", "size", "h")
    passes = _last_passes(rows, {i: int(want[s] - whole[i] * w) for i, (s, _, w) in enumerate(order)})
    steps = F.broadcast(_steps_table(rows, passes, _exchanges(rows, passes)).drop("left"))
    decided = placed.join(steps, "i").withColumn("last", _taken_last()).drop("steps", "gone", "came")
    own: dict[int, tuple[int, list[int], list[int]]] = {i: (n, [], []) for i, n in whole.items()}
    for i, b, last in sorted((r["i"], r["block"], r["last"]) for r in decided.groupBy("i", "block").agg(F.max("last").alias("last")).collect()):
        own[i][1].append(b)
        if last:
            own[i][2].append(b)
    plan = [(i, b, at[:, j].tolist(), last.get(b)) for i, (at, last) in deal(own, shards, seed).items() for j, b in enumerate(own[i][1])]
    drawn = decided.join(F.broadcast(spark.createDataFrame(plan, "i int, block int, whole array<int>, part int")), ["i", "block"])
    drawn = drawn.withColumn("shards", F.when(F.col("last"), F.concat("whole", F.array("part"))).otherwise(F.col("whole"))).withColumn("times", F.size("shards"))
    orders = F.transform("shards", lambda x, n: F.xxhash64("h", n, F.lit(seed)))
    return drawn.select(F.col("k").alias(key), F.col("s").alias(source), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times", "block", "shards", orders.alias("orders"))


def copies(mixed: DataFrame) -> DataFrame:
    """One row for each copy that the mix takes: the document's columns, copy (from 0), shard, and order in the shard."""
    each = mixed.select("*", F.posexplode(F.arrays_zip("shards", "orders")).alias("copy", "at"))
    return each.select(*[c for c in mixed.columns if c not in ("shards", "orders")], "copy", F.col("at.shards").alias("shard"), F.col("at.orders").alias("order"))
