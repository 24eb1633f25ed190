"""Prefix trie of conversations: which openings are shared, by how many, and what sharing them saves.

A node is the sequence of the first d turns, known by a hash. Turns are cut down to digests and byte counts at the
scan, so no text is shuffled. Every task first combines its own rows of a node and what it emits is a table of nodes;
such partial tries are merged by the node's hash, in two rounds, the first with a salt, so that a node that all share
costs a merge one row from each task. Counts, smallest members and end lists are merged in the same way.

Prefix hashes are polynomials modulo four primes, whose prefix sums can be taken in pieces: turns are dealt by range of
(conversation, place), so that a conversation that holds a third of all rows lies in many tasks.

The rollup needs no loop over depths. A node belongs to its smallest member, and the nodes of a member are one stretch
at the end of its path. What a subtree sums up is, over its members c, the sum over the nodes of c in it: all that c
owns for members that do not own the top, and the suffix from the top's depth for its owner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.common import cut, join_classes, partitions

#: The primes below 2^31, and a base for each: any values below the prime do.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1181783497, 776531401, 1960180543, 349123763)
#: Places of a conversation whose sums are taken in one window.
STRETCH = 4096
#: Ids that are joined to one text before the end list of a node is hashed, in order.
RUN = 4096
#: Merges of partial tries in the first round.
SALTS = 16

KEY = ("ka", "kb")
_H = [f"h{j}" for j in range(len(PRIMES))]


@F.arrow_udf(T.StructType([T.StructField(f"v{j}", T.LongType()) for j in range(4)]))
def _terms(place: pa.Array, t0: pa.Array, t1: pa.Array, t2: pa.Array, t3: pa.Array) -> pa.Array:
    """What the turn at a place (from 1) adds to the polynomials: its digest times the base to the power place - 1."""
    power, out = place.to_numpy(zero_copy_only=False) - 1, []
    for p, base, t in zip(PRIMES, BASES, (t0, t1, t2, t3), strict=True):
        value, square, left = t.to_numpy(zero_copy_only=False) % p, base, power.copy()
        while left.any():
            value = np.where(left & 1, value * square % p, value)
            square, left = square * square % p, left >> 1
        out.append(pa.array(value, pa.int64()))
    return pa.StructArray.from_arrays(out, names=[f"v{j}" for j in range(4)])


def digests(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, digest, its four parts t0 to t3 below 2^30, and the text's UTF-8 bytes; rows without a conversation go."""
    r, t = (F.coalesce(turns[c], F.lit("")).cast("binary") for c in (role, text))
    d = F.sha2(F.concat(F.concat(F.octet_length(r).cast("string"), F.lit(":")).cast("binary"), r, t), 256)
    part = [F.conv(F.substring("digest", 8 * j + 1, 8), 16, 10).cast("long") / 4 for j in range(4)]
    rows = turns.where(turns[conv].isNotNull()).select(turns[conv].cast("long").alias("conv"), turns[turn].alias("turn"), d.alias("digest"), F.octet_length(t).cast("long").alias("bytes"))
    return rows.select("*", *[(F.floor(x) + 1).cast("long").alias(f"t{j}") for j, x in enumerate(part)])


def ranked(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place in the conversation (from 1) and the hash up to there; and the pieces of conversations.

    Equal turn numbers are ordered by digest. A piece is what lies of a conversation in one range of places.
    """
    spark = turns.sparkSession
    dealt = cut(turns.repartitionByRange(partitions(spark), "conv", "turn", "digest").withColumn("piece", F.spark_partition_id()))
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = dealt.groupBy("conv", "piece").agg(F.count("*").alias("n")).withColumns({"n_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "n_turns": F.sum("n").over(Window.partitionBy("conv"))})
    inside = Window.partitionBy("conv", "piece").orderBy("turn", "digest").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.join(pieces.select("conv", "piece", "n_before"), ["conv", "piece"])
    rows = rows.withColumn("place", F.row_number().over(inside) + F.col("n_before"))
    rows = rows.withColumn("v", _terms("place", "t0", "t1", "t2", "t3"))
    rows = cut(rows.select("conv", "piece", "place", "bytes", *[F.col(f"v.v{j}").alias(f"v{j}") for j in range(4)], *[F.sum(f"v.v{j}").over(inside.orderBy("place")).alias(f"s{j}") for j in range(4)]))
    sums = rows.groupBy("conv", "piece").agg(*[(F.sum(f"v{j}") % p).alias(f"w{j}") for j, p in enumerate(PRIMES)])
    pieces = pieces.join(sums, ["conv", "piece"]).withColumns({f"w{j}": F.coalesce(F.sum(f"w{j}").over(before), F.lit(0)) for j in range(4)})
    pieces = cut(pieces.select("conv", "piece", "n_turns", *[f"w{j}" for j in range(4)]))
    rows = rows.join(pieces, ["conv", "piece"])
    hashes = [((F.col(f"s{j}") + F.col(f"w{j}")) % p).alias(h) for j, (p, h) in enumerate(zip(PRIMES, _H, strict=True))]
    return rows.select("conv", "piece", "place", "bytes", *[f"v{j}" for j in range(4)], *hashes), pieces.select("conv", "piece", "n_turns")


def _key(h: list[Column]) -> list[Column]:
    """A node's hash in two numbers; the root's is zero."""
    return [(h[0] * (1 << 31) + h[1]).alias("ka"), (h[2] * (1 << 31) + h[3]).alias("kb")]


def paths(turns: DataFrame, group: int, heads: int) -> DataFrame:
    """A row for each rebuilt conversation and depth from 0: conv, depth, node hash, parent hash, bytes, whether it ends there.

    Conversation c opens with the first h turns of conversation ``c - c % group``, where h is its CRC-32 modulo
    ``heads``, and goes on with its own turns after its first h.
    """
    rows, pieces = ranked(turns)
    rows = cut(rows)
    opening = F.collect_list(F.struct("place", *_H, "bytes"))
    first = rows.where(F.col("place") < heads).groupBy("conv").agg(F.array_sort(opening).alias("first"))
    convs = pieces.groupBy("conv").agg(F.max("n_turns").alias("n_turns"))
    convs = convs.select("*", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads)).cast("int").alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    convs = convs.join(first.withColumnRenamed("first", "own"), "conv", "left").join(first.select(F.col("conv").alias("base"), F.col("first").alias("opening")), "base", "left")
    convs = convs.withColumn("opening", F.coalesce(F.slice("opening", F.lit(1), F.col("h")), F.array().cast(convs.schema["own"].dataType)))
    convs = convs.withColumn("m", F.size("opening")).withColumn("length", F.col("m") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0)))
    at = lambda array, i, h: F.when(i > 0, F.coalesce(F.try_element_at(array, i)[h], F.lit(0))).otherwise(F.lit(0))
    joints = [at(F.col("opening"), F.col("m"), h).alias(f"from_{h}") for h in _H] + [at(F.col("own"), F.col("h"), h).alias(f"to_{h}") for h in _H]
    convs = cut(convs.select("conv", "h", "m", "length", "opening", *joints))
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), zero.alias("pa"), zero.alias("pb"), zero.alias("bytes"), (F.col("length") == 0).alias("ends"))
    up = [F.coalesce(F.try_element_at("opening", F.col("i"))[h], zero) for h in _H]
    shared = convs.select("conv", "length", "opening", F.posexplode("opening").alias("i", "x")).select("conv", (F.col("i") + 1).cast("long").alias("depth"), *_key([F.col(f"x.{h}") for h in _H]), *[F.when(F.col("i") > 0, c).otherwise(zero).alias(n) for c, n in zip(_key([F.when(F.col("i") > 0, u) for u in up]), ("pa", "pb"), strict=True)], F.col("x.bytes").alias("bytes"), (F.col("i") + 1 == F.col("length")).alias("ends"))
    joined = pieces.select("conv", "piece").join(convs.drop("opening"), "conv")
    own = rows.join(joined, ["conv", "piece"]).where(F.col("place") > F.col("h"))
    shift = F.col("h") - F.col("m")

    def moved(less: bool) -> list[Column]:
        """The hash of the own turns moved to where the opening ends, up to this turn or the one before."""
        out = []
        for j, (p, base, h) in enumerate(zip(PRIMES, BASES, _H, strict=True)):
            back = F.array(*[F.lit(pow(base, -k, p)).cast("long") for k in range(heads)])
            upto = F.col(h) - F.col(f"to_{h}") + 2 * p - (F.col(f"v{j}") if less else 0)
            out.append((F.element_at(back, shift + 1) * (upto % p) + F.col(f"from_{h}")) % p)
        return out

    depth = (F.col("m") + F.col("place") - F.col("h")).cast("long")
    own = own.select("conv", depth.alias("depth"), *_key(moved(False)), *[c.alias(n) for c, n in zip(_key(moved(True)), ("pa", "pb"), strict=True)], "bytes", (depth == F.col("length")).alias("ends"))
    return root.unionByName(shared).unionByName(own)


def merged(rows: DataFrame, keys: list[str], salt: Column, **sums: tuple) -> DataFrame:
    """Partial tables of groups merged by key in two rounds: ``sums`` names how rows are combined and how partials are."""
    part = rows.groupBy(*keys, F.pmod(F.xxhash64(salt), F.lit(SALTS)).alias("salt")).agg(*[one.alias(n) for n, (one, _) in sums.items()])
    return part.groupBy(*keys).agg(*[again(n).alias(n) for n, (_, again) in sums.items()])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (ka, kb, depth, piece, conv) rows to joined runs of at most RUN ids of one node."""
    held: list[int] = []
    node, seq = None, 0
    names = ["ka", "kb", "depth", "piece", "seq", "ids"]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()], strict=True)], names=names)
    for b in batches:
        out = []
        for *key, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != node or len(held) == RUN:
                if held:
                    out.append((*node, seq, ",".join(map(str, held))))
                seq = seq + 1 if key == node else 0
                node, held = key, []
            held.append(conv)
        if out:
            yield made(out)
    if held:
        yield made([(*node, seq, ",".join(map(str, held)))])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs to the SHA-256 of each node's list; only the state of one hash is held."""
    node, state = None, None
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=["ka", "kb", "depth", "ends_sha256"])
    for b in batches:
        out = []
        for *key, ids in zip(*(b.column(c).to_pylist() for c in ("ka", "kb", "depth", "ids")), strict=True):
            if key != node:
                if state:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield made(out)
    if state:
        yield made([(*node, state.hexdigest())])


def end_lists(ends: DataFrame) -> DataFrame:
    """The SHA-256 of the ascending ids that end at each node, comma-joined.

    Ids are dealt by range, joined to runs where they lie, and the runs of a node are hashed in order: a hash of one
    text is a chain, so the runs of a node meet in one task, which holds one of them at a time.
    """
    n = partitions(ends.sparkSession)
    dealt = ends.select("ka", "kb", "depth", "conv").repartitionByRange(n, "ka", "kb", "depth", "conv").sortWithinPartitions("ka", "kb", "depth", "conv")
    runs = dealt.select("ka", "kb", "depth", F.spark_partition_id().alias("piece"), "conv").mapInArrow(_runs, "ka long, kb long, depth long, piece int, seq long, ids string")
    met = runs.repartition(n, "ka", "kb", "depth").sortWithinPartitions("ka", "kb", "depth", "piece", "seq")
    return met.mapInArrow(_chain, "ka long, kb long, depth long, ends_sha256 string")


def trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = 5, heads: int = 9) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (see ``paths``).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; the
    first two name a node. Turns are ordered by number, null first; those that share a number by the SHA-256 of role
    and text. Null role or text is empty; rows without a conversation are left out; a repeated row is a turn of its
    own. Without any conversation there is no root and no row. Texts are read whole, once, and not shuffled. Node
    hashes have 124 bits, so two nodes being taken for one is beyond chance. Other columns are not read.
    """
    key = [*KEY, "depth"]
    rows = cut(paths(digests(turns, conv, turn, role, text), group, heads))
    nodes = merged(rows, key, F.col("conv"), conv_id=(F.min("conv"), F.min), n_convs=(F.count("*"), F.sum), pa=(F.min("pa"), F.min), pb=(F.min("pb"), F.min), bytes=(F.max("bytes"), F.max))
    nodes = cut(nodes)
    kids = nodes.where("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(kids, key, "left").fillna(0, ["n_children"]))
    # What each node adds itself, summed from its depth to the end of its owner's stretch.
    nodes = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes"), "stretch": F.floor(F.col("depth") / STRETCH)})
    both = ("leaves", "saved")
    late = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    stretches = nodes.groupBy("conv_id", "stretch").agg(*[F.sum(c).alias(c) for c in both])
    stretches = stretches.select("conv_id", "stretch", *[F.coalesce(F.sum(c).over(late), F.lit(0)).alias(f"{c}_after") for c in both], *[F.sum(c).over(whole).alias(f"{c}_all") for c in both])
    inside = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    owned = nodes.join(stretches, ["conv_id", "stretch"]).withColumns({f"{c}_own": F.sum(c).over(inside) + F.col(f"{c}_after") - F.col(f"{c}_all") for c in both})
    # What members own, all of it, at each node of their paths.
    last = rows.groupBy("conv", F.floor(F.col("depth") / STRETCH).alias("stretch")).agg(F.count("*").alias("n"))
    owners = last.join(stretches.groupBy(F.col("conv_id").alias("conv")).agg(*[F.max(f"{c}_all").alias(c) for c in both]), "conv").drop("n")
    given = rows.select(*key, "conv", F.floor(F.col("depth") / STRETCH).alias("stretch")).join(owners, ["conv", "stretch"])
    given = merged(given, key, F.col("conv"), **{c: (F.sum(c), F.sum) for c in both})
    nodes = owned.drop(*both).join(given, key).select(*key, "pa", "pb", "conv_id", "n_convs", "n_children", (F.col("leaves_own") + F.col("leaves")).alias("n_leaves"), (F.col("saved_own") + F.col("saved")).alias("saved_tokens"))
    nodes = cut(nodes.join(end_lists(rows.where("ends")), key, "left").fillna(hashlib.sha256(b"").hexdigest(), ["ends_sha256"]))
    parent = F.struct("pa", "pb", (F.col("depth") - 1).alias("depth")).alias("parent")
    parents = nodes.where("n_children > 0").select(F.struct(F.col("ka").alias("pa"), F.col("kb").alias("pb"), "depth").alias("parent"), F.col("n_children").alias("n"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = join_classes(nodes.where("depth > 0").select("*", parent), parents, "parent")
    return reduce(DataFrame.unionByName, [nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*out), below.select(*out)])
