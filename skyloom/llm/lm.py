"""Language-model scores by a weighted backoff automaton.

Words are states of a bigram model. An arc from a state reads a word seen after it in training; every state has a
failure arc to the empty state, whose arcs read single words. Counts of the whole training text are gathered in
shards by hash, never in one place: documents fall into batches, a batch asks for the words and word pairs that its
documents hold, and builds from the answers the part of the automaton that its documents walk through. Few batches ask
the shards themselves. Many ask through hubs: a hub joins what FAN batches ask in one range of hashes and asks on for
them all, if need be through further hubs, so that questions grow with the batches and not with their square.

With c the counts in training, N tokens, V distinct ones, a discount D and a prior weight K:
  single word   P(w) = (c(w) - D) / N, and D * V / N for all unknown words together
  arc           P(w | u) = (c(u w) + K * P(w)) / (c(u) + K)
  failure arc   K / (c(u) + K), then P(w)
which sum to one for each u. A text is walked from left to right, starting behind the end of another text.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import partitions, raw

#: Bytes of text of a batch, about; batches that send to one shard for each shard.
BATCH_BYTES = 8 << 20
BATCHES_OF_SHARD = 8
#: Batches that ask through one hub, and ranges of hashes that hubs share (a power of two); more batches than LAST do so.
FAN, LAST = 64, 512
END = b""  # no word is empty


class Counts:
    """Words and hashes of pairs with their counts, by hash; words of one hash by their bytes."""

    def __init__(self, words: list[bytes], word_hash: np.ndarray, word_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray):
        self.words, self.word_hash, self.word_counts, self.pairs, self.pair_counts = words, word_hash, word_counts, pairs, pair_counts

    def edges(self, fixed: int, parts: int) -> tuple[list[int], list[int]]:
        """Where the words and the pairs of each of ``parts`` ranges begin, and the end. The first ``fixed`` bits of all hashes agree."""
        return tuple(np.searchsorted(_slot(h, fixed, parts), np.arange(parts + 1)).tolist() for h in (self.word_hash, self.pairs))

    def messages(self, path: int, node: int, fixed: int, parts: int) -> pa.Table:
        """A row for each range. END is empty and a leading space keeps it apart from no words."""
        w, q = self.edges(fixed, parts)
        rows = [(path, node, r, b"".join(b" " + x for x in self.words[w[r] : w[r + 1]]), _planes(self.word_counts[w[r] : w[r + 1]]), _planes(self.pairs[q[r] : q[r + 1]]), _planes(self.pair_counts[q[r] : q[r + 1]])) for r in range(parts)]
        return _table(rows, ASKED)


class Merged:
    """The counts of several messages added up, and where those of each message lie among them."""

    def __init__(self, asked: pa.Table):
        index: dict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        own = [np.fromiter(map(index.__getitem__, x.as_py().split(b" ")[1:]), np.int64) for x in asked["words"]]
        names = list(index)
        by_name = sorted(range(len(names)), key=names.__getitem__)
        h = np.fromiter((xxhash.xxh64_intdigest(names[i]) for i in by_name), np.uint64, len(names))
        order = np.array(by_name, np.int64)[np.argsort(h, kind="stable")]
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        self.word_at = [place[ids] for ids in own]
        words = np.zeros(len(names), np.int64)
        for at, n in zip(self.word_at, asked["word_counts"]):
            words[at] += _unplanes(n.as_py()).view(np.int64)  # a message names a word once
        hashes = [_unplanes(x.as_py()) for x in asked["pairs"]]
        pairs, at = np.unique(np.concatenate(hashes), return_inverse=True)
        ends = np.cumsum([0, *map(len, hashes)])
        self.pair_at = [at[a:b] for a, b in zip(ends, ends[1:])]
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, at, np.concatenate([_unplanes(x.as_py()) for x in asked["pair_counts"]]).view(np.int64))
        self.counts = Counts([names[i] for i in order], np.sort(h), words, pairs, counts)

    def answers(self, asked: pa.Table, distinct: int, total: int, words: np.ndarray, pairs: np.ndarray) -> pa.Table:
        """A row for each message, with the counts ``words`` and ``pairs`` of what it asked."""
        who = zip(asked["path"].to_pylist(), asked["node"].to_pylist(), asked["r"].to_pylist(), self.word_at, self.pair_at)
        return _table([(path, node, r, distinct, total, _planes(words[w]), _planes(pairs[q])) for path, node, r, w, q in who], TOLD)


class Batch:
    """The tokens of some documents: local numbers of words, pairs of them, and where each document's tokens lie."""

    def __init__(self, texts: list[bytes], train: np.ndarray):
        index: dict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        end = index[END]
        rows, lengths = [], []
        for t in texts:
            ids = np.fromiter(map(index.__getitem__, t.lower().split()), np.int64)
            rows += [ids, (end,)]
            lengths.append(len(ids) + 1)
        self.words = list(index)
        self.tokens = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[:1] = end  # the token before a text is the end of the last one
        self.before = before
        self.pairs, self.pair = np.unique(before << 32 | self.tokens, return_inverse=True)
        learned = train[self.doc] if len(texts) else np.empty(0, bool)
        self.word_counts = np.bincount(self.tokens[learned], minlength=len(self.words))
        self.pair_counts = np.bincount(self.pair[learned], minlength=len(self.pairs))
        h = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        self.word_hash, self.pair_hash = h, mix(h[self.pairs >> 32], h[self.pairs & 0xFFFFFFFF])

    def asks(self) -> Counts:
        """What the batch has counted, in an order that row order does not change."""
        w = np.array(sorted(range(len(self.words)), key=self.words.__getitem__), np.int64)
        w = w[np.argsort(self.word_hash[w], kind="stable")]
        q = np.argsort(self.pair_hash, kind="stable")
        self.word_order, self.pair_order = w, q
        return Counts([self.words[i] for i in w], self.word_hash[w], self.word_counts[w], self.pair_hash[q], self.pair_counts[q])


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of hashes."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _slot(h: np.ndarray, fixed: int, parts: int) -> np.ndarray:
    """Which of ``parts`` ranges a hash lies in, among those that agree in their first ``fixed`` bits."""
    return (((h << np.uint64(fixed)) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _planes(h: np.ndarray) -> bytes:
    """64-bit numbers byte by byte: upper bytes hardly change in sorted hashes and counts, so shuffles compress them away."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


ASKED = "path long, node long, r int, words binary, word_counts binary, pairs binary, pair_counts binary"
TOLD = "path long, node long, r int, distinct long, total long, word_counts binary, pair_counts binary"


def _table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _batch(docs: pa.Table) -> Batch:
    return Batch(docs["t"].to_pylist(), np.array(docs["train"].to_pylist(), bool))


def ask(docs: pa.Table, parts: int) -> pa.Table:
    """What a batch has counted, and whose counts it needs: a row for each range of hashes."""
    return _batch(docs).asks().messages(0, docs["p"][0].as_py(), 0, parts)


def tell(asked: pa.Table) -> pa.Table:
    """A shard adds up the counts of all who ask, and answers each."""
    m = Merged(asked)
    words, pairs = m.counts.word_counts, m.counts.pair_counts
    return m.answers(asked, int((words > 0).sum()), int(words.sum()), words, pairs)


def ask_on(asked: pa.Table, fixed: int, parts: int) -> pa.Table:
    """A hub asks for all that asked it."""
    return Merged(asked).counts.messages(asked["name"][0].as_py(), asked["hub"][0].as_py(), fixed, parts)


def tell_on(asked: pa.Table, told: pa.Table, fixed: int, parts: int) -> pa.Table:
    """A hub passes the answers that it got on to all that asked it."""
    m = Merged(asked)
    return m.answers(asked, *_gathered(m.counts, told, fixed, parts))


def _gathered(counts: Counts, told: pa.Table, fixed: int, parts: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(distinct, total, counts of the words, of the pairs) from the answers of all ranges."""
    w, q = counts.edges(fixed, parts)
    words, pairs = np.zeros(len(counts.words), np.int64), np.zeros(len(counts.pairs), np.int64)
    distinct = total = got = 0
    for r, d, t, x, y in zip(*(told[c].to_pylist() for c in ("r", "distinct", "total", "word_counts", "pair_counts"))):
        x, y = _unplanes(x).view(np.int64), _unplanes(y).view(np.int64)
        if len(x) != w[r + 1] - w[r] or len(y) != q[r + 1] - q[r]:
            raise RuntimeError("a batch holds other documents than when it asked: its input is not the same when read again")
        words[w[r] : w[r + 1]], pairs[q[r] : q[r + 1]] = x, y
        distinct, total, got = distinct + d, total + t, got + 1
    if got != parts:
        raise RuntimeError(f"{got} answers of {parts}")
    return distinct, total, words, pairs


def answered(asked: DataFrame, nodes: int, fixed: int) -> DataFrame:
    """TOLD for ASKED of so many nodes, over hubs where they are many. A hub's ``name`` is the range of hashes it serves."""
    if nodes <= LAST:
        return asked.groupBy("path", "r").applyInArrow(tell, TOLD)
    hubs = -(-nodes // FAN)
    parts, fixed = parts_of(hubs, 1), fixed + FAN.bit_length() - 1
    to_hub = asked.withColumns({"name": F.col("path") * FAN + F.col("r"), "hub": F.floor(F.col("node") / FAN)})
    on = to_hub.groupBy("name", "hub").applyInArrow(lambda t: ask_on(t, fixed, parts), ASKED)
    told = answered(on, hubs, fixed)
    return to_hub.groupBy("name", "hub").cogroup(told.groupBy("path", "node")).applyInArrow(lambda x, y: tell_on(x, y, fixed, parts), TOLD)


def parts_of(nodes: int, least: int) -> int:
    """Ranges that each of so many nodes asks: shards, or the ranges of the hubs."""
    return max(least, -(-nodes // BATCHES_OF_SHARD)) if nodes <= LAST else FAN


class Automaton:
    """States and weighted arcs for the words of a batch.

    State 0 is the empty history, state 1 + w that of word w. ``arcs`` are (state << 32 | word) in order, with the
    log10 weight of each; ``fail`` is the state that a state falls back to and ``back`` the weight of doing so. After a
    word has been read the state is that of the word.
    """

    def __init__(self, b: Batch, word_totals: np.ndarray, pair_totals: np.ndarray, total: int, distinct: int, discount: float, prior: float):
        single = np.where(word_totals > 0, word_totals - discount, discount * distinct) / max(total, 1)
        single[word_totals == 0] = max(single[word_totals == 0].max(initial=0), 0) or 1.0
        seen = pair_totals > 0
        u, w = b.pairs[seen] >> 32, b.pairs[seen] & 0xFFFFFFFF
        paired = (pair_totals[seen] + prior * single[w]) / (word_totals[u] + prior)
        words = np.arange(len(b.words))
        self.arcs = np.concatenate([words, (u + 1) << 32 | w])
        self.weights = np.log10(np.concatenate([single, paired]))
        self.back = np.concatenate([[0.0], np.log10(prior / (word_totals + prior))])
        self.fail = np.zeros(len(b.words) + 1, np.int64)

    def walk(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The log10 weight of each token, read in the state that the token before it led to.

        All tokens step at once: those whose state has no arc for their word follow its failure arc and try again.
        """
        state, out, todo = before + 1, np.zeros(len(tokens)), np.arange(len(tokens))
        while len(todo):
            wanted = state[todo] << 32 | tokens[todo]
            at = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            found = self.arcs[at] == wanted
            out[todo[found]] += self.weights[at[found]]
            todo = todo[~found]
            out[todo] += self.back[state[todo]]
            state[todo] = self.fail[state[todo]]
        return out


def _score(docs: pa.Table, told: pa.Table, parts: int, discount: float, prior: float) -> list[np.ndarray]:
    b = _batch(docs)
    distinct, total, w, q = _gathered(b.asks(), told, 0, parts)
    words, pairs = np.empty_like(w), np.empty_like(q)
    words[b.word_order], pairs[b.pair_order] = w, q
    known = words[b.tokens]
    base = np.log10((known + 1) / (total + distinct + 1))
    walked = Automaton(b, words, pairs, total, distinct, discount, prior).walk(b.before, b.tokens)
    add = lambda x: np.bincount(b.doc, weights=x, minlength=docs.num_rows)
    return [b.lengths, add(known > 0).astype(np.int64), np.full(docs.num_rows, total, np.int64), add(base), add(walked)]


def score_documents(docs: DataFrame, train: Column, discount: float = 0.5, prior: float = 50.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` says which rows the model learns from (null: it does not). Null and empty texts hold their end alone.
    Without training rows all words are unknown and have probability 1 together. Repeated rows count and are returned
    as often as they come; other columns are not read. An empty table gives no rows. Words are counted exactly; pairs
    by a 64-bit hash. Rows are dealt to batches by their place in the input, whatever they hold, so copies of a row and
    null keys spread like others; the input must read alike when a lost task is run again, as files and checkpoints do,
    and a batch that finds other words than it asked for raises.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    size = (size[0] or 0) + 16 * size[1]
    batches = max(2 * partitions(spark), -(-size // BATCH_BYTES))
    parts = parts_of(batches, partitions(spark))
    p = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches))
    dealt = docs.select(p.alias("p"), F.col(key).alias("k"), F.coalesce(train, F.lit(False)).alias("train"), raw(docs[text]).alias("t"))
    asked = dealt.groupBy("p").applyInArrow(lambda t: ask(t, parts), ASKED)
    told = answered(asked, batches, 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = _score(left, right, parts, discount, prior) if left.num_rows else [[]] * 5
        return pa.table([left["k"], *map(pa.array, cols)], names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return dealt.groupBy("p").cogroup(told.groupBy("node")).applyInArrow(run, f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
