"""SimHash near-duplicates by pigeonhole blocks.

Each distinct fingerprint is keyed by every choice of blocks that two close fingerprints must share. Buckets that are
still large are keyed once more by their open bits, split the same way, so no bucket grows with a group of near
copies. Inside a bucket Hamming distances are verified and a spanning forest of the links is kept; components over
these edges are the groups.

``near_copies`` groups by the Jaccard similarity of the shingles themselves. Links of close fingerprints come first, each
verified on the whole sets. At 0.8 fingerprints differ in about ten bits, too many for blocks that still tell texts
apart, so an exact search follows for the rest: its candidates share one of their first shingles in an order of all
shingles, which no pair that is similar enough can fail to do. Pairs that the fingerprints have joined are not sent on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import Shipped, components, cut, join_classes, map_rows, raw

BITS = 64
#: A shingle that is among the first of more distinct texts than this is not paired in full at once.
LARGE = 64
#: Shingles that go last in the order at most, by how often a sixteenth of the texts has them.
MAX_COMMON = 50_000
#: Classes by hash in which shingles are counted; common shingles are at most the lesser counts, class by class.
CLASSES = 256
#: Greatest count of a class that is told apart; it stands for more, too, and rules nothing out.
MOST = 65_535
#: Bits of the bitmap of the texts that are compared: a text marked by chance is computed in vain, no other harm.
MARKS = 1 << 26


def fingerprint(text: bytes, shingle_words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, A-Z lowered; 0 without words."""
    return _majority(shingles(text, shingle_words, seed))


def _majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; 0 without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 65536)):
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingles(text: bytes, shingle_words: int, seed: int) -> np.ndarray:
    """The XXH64 of each word shingle, repeats included; a shorter text is one shingle."""
    words = text.lower().split()  # splits at the six ASCII white-space bytes only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = min(shingle_words, len(words)) - 1
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], seed) for a, b in zip(starts, ends[last:])], np.uint64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp long): a fingerprint for each row, as the signed form of its 64 bits. Null and empty texts have 0."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t.as_py(), shingle_words, seed) for t in b.column(1)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[key, "fp"])

    return map_rows(docs.select(key, raw(docs[text]).alias("t")), f"`{key}` {docs.schema[key].dataType.simpleString()}, fp bigint", run)


def _split(bits: list[int], blocks: int) -> list[list[int]]:
    return [b.tolist() for b in np.array_split(bits, blocks)]


def _mask(bits: list[int]) -> int:
    """The signed long with these bits set."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _keys(bits: list[int], distance: int, blocks: int) -> list[tuple[list[int], list[int]]]:
    """(shared bits, open bits) of each choice of blocks; two words within ``distance`` agree on one choice at least."""
    parts = _split(bits, blocks)
    choices = combinations(range(len(parts)), len(parts) - distance)
    return [(sum((parts[i] for i in c), []), sum((parts[i] for i in range(len(parts)) if i not in c), [])) for c in choices]


def _keyed(df: DataFrame, choices: list[tuple[str, int]]) -> DataFrame:
    """A row of (fp, choice, value) for each choice of bits."""
    entries = [F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for n, m in choices]
    return df.select("fp", F.explode(F.array(*entries)).alias("k")).select("fp", "k.choice", "k.value")


def _forest(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs within ``distance`` bits; values are distinct."""
    n = len(values)
    label = np.arange(n)
    a_out, b_out = [], []
    for start in range(0, n, 1024):
        block = values[start : start + 1024]
        near = np.bitwise_count(block[:, None] ^ values[None, :]) <= distance
        i, j = np.nonzero(near)
        i += start
        keep = i < j
        a_out.append(i[keep])
        b_out.append(j[keep])
    a, b = np.concatenate(a_out), np.concatenate(b_out)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    child = np.nonzero(label != np.arange(n))[0]
    return values[child], values[label[child]]


def _bucket_edges(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                a, b = _forest(np.array(held, np.int64).view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            for fp, choice, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (choice, value) != key:
                    yield from close()
                    key, held = (choice, value), []
                held.append(fp)
        yield from close()

    return run


def links(fps: DataFrame, distance: int = 2, blocks: int = 4, large: int = 512) -> DataFrame:
    """(a, b): pairs of fingerprints of ``fps(fp)`` within ``distance`` bits whose components are those of all such pairs.

    ``blocks`` must exceed ``distance``. A bucket of more than ``large`` fingerprints is split by its open bits, at
    most twice more: with 4 blocks and distance 2, then 56 bits are shared and a bucket has 256 values at most, so the
    work on any group of near copies is linear in its size. Nothing is dropped: a split bucket goes on in all its parts.
    """
    if not distance < blocks:
        raise ValueError("blocks must exceed distance")
    todo = [(n, shared, left) for n, (shared, left) in enumerate(_keys(list(range(BITS)), distance, blocks))]
    df = _keyed(fps.select("fp").distinct(), [(str(n), _mask(shared)) for n, shared, _ in todo])
    names = {str(n): (shared, left) for n, shared, left in todo}
    small = []
    for depth in range(3):
        sizes = df.groupBy("choice", "value").agg(F.count("*").alias("n")).where("n > 1")
        if depth == 2:
            small.append(df.join(sizes.select("choice", "value"), ["choice", "value"], "left_semi"))
            break
        sizes = cut(sizes)
        small.append(df.join(sizes.where(F.col("n") <= large), ["choice", "value"], "left_semi"))
        hot = sizes.where(F.col("n") > large)
        if hot.isEmpty():
            break
        deeper = {}
        again = []
        for name, (shared, left) in names.items():
            for k, (more, rest) in enumerate(_keys(left, distance, blocks)):
                deeper[f"{name}.{k}"] = (shared + more, rest)
                again.append(F.when(F.col("choice") == name, F.struct(F.lit(f"{name}.{k}").alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(shared + more))).alias("value"))))
        found = df.join(hot, ["choice", "value"], "left_semi")
        df = cut(found.select("fp", F.explode(F.array_compact(F.array(*again))).alias("k")).select("fp", "k.choice", "k.value"))
        names = deeper
    pairs = [x.select("fp", "choice", "value").repartition("choice", "value").sortWithinPartitions("choice", "value").mapInArrow(_bucket_edges(distance), "a bigint, b bigint") for x in small]
    out = pairs[0]
    for x in pairs[1:]:
        out = out.union(x)
    return out


def as_hex(fp: Column) -> Column:
    """The 16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 3, seed: int = 42, distance: int = 2, blocks: int = 4) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id (least key of its group).

    Texts with no words have fingerprint zero and are linked like any others; null counts as empty. Copies share a
    fingerprint and are joined by it, never paired. Repeated keys give repeated rows; a null key is never a
    component_id unless the group has no other. Other columns are not read, so their names cannot clash. An empty table
    gives no rows.
    """
    fps = cut(fingerprints(docs, key, text, shingle_words, seed))
    groups = components(links(fps, distance, blocks)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    least = fps.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n"))
    rooted = least.join(groups, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(heads, "root").select("fp", "n", "component_id")
    return join_classes(fps, classes, "fp").select(key, as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def _reaches(inter: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """Whether sets of n and m with so many in common have this Jaccard similarity."""
    return inter * (100 + percent) >= percent * (n + m)


def _first(n: int, percent: int) -> int:
    """How many of n ordered shingles hold one of any set that is similar enough."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _class_counts(own: np.ndarray) -> np.ndarray:
    """How many of a text's shingles fall into each of CLASSES; common shingles are at most the lesser counts."""
    return np.bincount((own % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES)


def _bucket_pairs(rows: list[tuple], percent: int, stars: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the texts (sid, n, pos, root, own) that have one shingle among their first, at place pos, and may be similar enough.

    With ``stars`` only pairs with the two texts that have the fewest rare shingles; pairs of one root are left out, and
    those whose class counts ``own`` (if not None; the greatest number stands for more) are too far apart.
    """
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    sid, n, pos, root = np.array([r[:4] for r in rows], np.int64).T
    own = None if rows[0][4] is None else np.frombuffer(b"".join(r[4] for r in rows), "<u2").reshape(len(rows), CLASSES)
    for i in range(2 if stars else len(sid) - 1):
        ok = _reaches(1 + np.minimum(n[i] - pos[i] - 1, n[i + 1 :] - pos[i + 1 :] - 1), n[i], n[i + 1 :], percent)
        at = i + 1 + np.flatnonzero(ok & (root[i + 1 :] != root[i]))
        if own is not None:
            for part in np.array_split(at, len(at) // 50_000 + 1):
                least = np.minimum(own[part], own[i])
                fits = _reaches(least.sum(1, dtype=np.int64), n[i], n[part], percent) | (least == MOST).any(1)
                if fits.any():
                    yield np.minimum(sid[part[fits]], sid[i]), np.maximum(sid[part[fits]], sid[i])
        elif len(at):
            yield np.minimum(sid[at], sid[i]), np.maximum(sid[at], sid[i])


def _pairs(tokens: DataFrame, percent: int, again: bool) -> DataFrame:
    """(a, b, token, n, pos) over the buckets of ``tokens(token, sid, n, pos, root, own)``: pairs (a, b), where token is null,
    and the rows (a = sid) of buckets of over LARGE texts. Those give stars only, and all pairs of two roots that may be
    similar when they come ``again``, with their class counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(token: int, held: dict) -> Iterator[list[np.ndarray]]:
            large = len(held) > LARGE and not again
            if len(held) > 1:
                for a, b in _bucket_pairs(list(held.values()), percent, large):
                    yield [a, b, np.full(len(a), -1), np.full(len(a), -1), np.full(len(a), -1)]
            if large:
                sid, n, pos = np.array([r[:3] for r in held.values()], np.int64).T
                yield [sid, sid, np.full(len(sid), token), n, pos]

        def found() -> Iterator[list[np.ndarray]]:
            token, held = None, {}
            for batch in batches:
                for t, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    if t != token:
                        yield from close(token, held)
                        token, held = t, {}
                    held[row[0]] = row
            yield from close(token, held)

        def out(some: list[list[np.ndarray]]) -> pa.RecordBatch:
            a, b, token, n, pos = (np.concatenate(c) for c in zip(*some))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(token, mask=n < 0), pa.array(n), pa.array(pos)], names=["a", "b", "token", "n", "pos"])

        some, count = [], 0
        for x in found():
            some.append(x)
            count += len(x[0])
            if count >= 20_000:
                yield out(some)
                some, count = [], 0
        if some:
            yield out(some)

    by_token = tokens.select("token", "sid", "n", "pos", "root", "own").repartition("token").sortWithinPartitions("token")
    return by_token.mapInArrow(run, "a bigint, b bigint, token bigint, n bigint, pos bigint")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 5, seed: int = 42, percent: int = 80, distance: int = 2, blocks: int = 4) -> DataFrame:
    """One row per document: key, component_id (least key of its group).

    Two texts are linked when the Jaccard similarity of their sets of word shingles is ``percent`` or more. Every such
    pair is linked: SimHash fingerprints of the sets within ``distance`` bits give the first links, an exact prefix filter
    the candidates for all others, and each is verified on the whole sets. Texts of the same set, and those without words, count as copies. Keys are as in ``near_duplicates``, but rows that share a key
    must share their text.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(key, raw(docs[text]).alias("t"))

    def sets(t: bytes) -> tuple[int, np.ndarray]:
        own = np.unique(shingles(t, shingle_words, seed))
        return xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), seed) - (1 << 63), own

    def ids(b: pa.RecordBatch) -> pa.RecordBatch:
        sid, fp, some = [], [], []
        for t in b.column(1):
            i, own = sets(t.as_py())
            sid.append(i)
            fp.append(_majority(own))
            some.append(own[: _first(len(own), percent)].view(np.int64).tolist() if i % 16 == 0 else None)
        fps = pa.array(np.array(fp, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sid, pa.int64()), fps, pa.array(some, pa.list_(pa.int64()))], names=[key, "sid", "fp", "some"])

    hashed = cut(map_rows(source, f"`{key}` {kind}, sid bigint, fp bigint, some array<bigint>", ids))
    # Any order of the shingles gives all pairs; with common ones last, the buckets are small.
    counts = hashed.where("some is not null").select("sid", F.explode("some").alias("token")).distinct().groupBy("token").agg(F.count("*").alias("n"))
    common = Shipped(spark, np.array(sorted(r["token"] for r in counts.where(F.col("n") > LARGE // 16).orderBy(F.desc("n"), "token").limit(MAX_COMMON).collect()), np.int64).view(np.uint64))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # copies within one task need no second row
        late = common.get()
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                out = []
                for t in batch.column(1).slice(start, 200):
                    i, own = sets(t.as_py())
                    if i in done or not len(own):
                        continue
                    done.add(i)
                    n = len(own)
                    last = np.isin(own, late)
                    own = np.concatenate([own[~last], own[last]])[: _first(n, percent)].view(np.int64)
                    out.append((own, np.full(len(own), i), np.full(len(own), n), np.arange(len(own))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["token", "sid", "n", "pos"])

    def asked(pairs: DataFrame, name: str, of: Callable[[np.ndarray], bytes]) -> DataFrame:
        """(sid, name): what ``of`` gives for the set of each text in pairs, and of a few more: a bitmap of their keys goes to all tasks."""
        sids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        keys = hashed.join(sids, "sid").groupBy("sid").agg(F.min(key).alias(key))
        bit = F.pmod(F.xxhash64(key), F.lit(MARKS))
        marks = np.zeros(MARKS // 8, np.uint8)
        rows = keys.select(bit.alias("bit")).groupBy(F.expr("bit div 32768").alias("at")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("m"))
        for r in rows.collect():
            marks[r["at"] * 4096 : r["at"] * 4096 + 4096] = np.frombuffer(r["m"], np.uint8)
        marked = Shipped(spark, marks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, done = marked.get(), set()
            for batch in batches:
                at = batch.column(0).to_numpy()
                rows = np.flatnonzero(m[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                for start in range(0, len(rows), 100):
                    out = {}
                    for j in rows[start : start + 100].tolist():
                        i, own = sets(batch.column(1)[j].as_py())
                        if i not in done:
                            done.add(i)
                            out[i] = of(own)
                    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["sid", name])

        return source.select(bit.alias("bit"), "t").mapInArrow(run, f"sid bigint, {name} binary").dropDuplicates(["sid"])

    def classes(own: np.ndarray) -> bytes:
        return np.minimum(_class_counts(own), MOST).astype("<u2").tobytes()

    def kept(pairs: DataFrame, of: Callable[[np.ndarray], bytes], fits: Callable[[bytes, bytes], bool]) -> DataFrame:
        """The pairs that fit by what ``of`` gives."""

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return b.select([0, 1]).filter(pa.array([bool(fits(x.as_py(), y.as_py())) for x, y in zip(b.column(2), b.column(3))], pa.bool_()))

        own = asked(pairs, "own", of)
        both = pairs.join(own.select(F.col("sid").alias("a"), F.col("own").alias("x")), "a").join(own.select(F.col("sid").alias("b"), F.col("own").alias("y")), "b")
        return cut(map_rows(both.select("a", "b", "x", "y"), "a bigint, b bigint", run))

    def may(x: bytes, y: bytes) -> bool:
        x, y = (np.frombuffer(v, "<u2").astype(np.int64) for v in (x, y))
        least = np.minimum(x, y)
        return (least == MOST).any() or _reaches(least.sum(), x.sum(), y.sum(), percent)

    def similar(x: bytes, y: bytes) -> bool:
        x, y = (np.frombuffer(v, np.uint64) for v in (x, y))
        return _reaches(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar enough."""
        return kept(pairs, lambda own: own.tobytes(), similar)

    # Close fingerprints first: texts of one fingerprint meet its least set, close fingerprints meet by these.
    alike = cut(hashed.select("fp", "sid").distinct())
    heads = alike.groupBy("fp").agg(F.min("sid").alias("head"))
    close = links(heads, distance, blocks)
    ends = close.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    same = alike.join(heads, "fp").where("sid <> head").select(F.col("head").alias("x"), F.col("sid").alias("y"))
    edges = verified(cut(same.union(ends.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()))
    joined = components(edges).select(F.col("node").alias("sid"), F.col("component").alias("root"))

    def apart(pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose texts the fingerprints have not joined."""
        a, b = (joined.select(F.col("sid").alias(c), F.col("root").alias(r)) for c, r in (("a", "x"), ("b", "y")))
        met = pairs.select("a", "b").distinct().join(a, "a", "left").join(b, "b", "left")
        return met.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")

    tokens = source.mapInArrow(first, "token bigint, sid bigint, n bigint, pos bigint")
    found = cut(_pairs(tokens.withColumns({"root": F.col("sid"), "own": F.lit(None).cast("binary")}), percent, False))
    # Sets travel only for pairs whose numbers of shingles by class allow it.
    edges = edges.union(verified(kept(cut(apart(found.where("token is null"))), classes, may)))
    hot = found.where("token is not null").select("token", F.col("a").alias("sid"), "n", "pos")
    if not hot.isEmpty():
        # Many texts of a hot bucket are not alike but for a passage: there the class counts go to the bucket, not to its pairs.
        near = components(edges).select(F.col("node").alias("sid"), F.col("component").alias("root"))
        counts = asked(hot.select(F.col("sid").alias("a"), F.col("sid").alias("b")), "own", classes)
        rest = _pairs(hot.join(near, "sid", "left").join(counts, "sid").withColumn("root", F.coalesce("root", "sid")), percent, True)
        edges = edges.union(verified(cut(rest.select("a", "b").distinct())))
    groups = components(edges).select(F.col("node").alias("sid"), F.col("component").alias("root"))
    least = hashed.groupBy("sid").agg(F.min(key).alias("least"), F.count("*").alias("n"))
    rooted = least.join(groups, "sid", "left").select("sid", "least", "n", F.coalesce("root", "sid").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(heads, "root").select("sid", "n", "component_id")
    return join_classes(hashed.select(key, "sid"), classes, "sid").select(key, "component_id")
