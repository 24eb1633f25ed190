"""Byte-level BPE by backtracking: exact merges in time linear in the text, and decoding.

A greedy longest-match walk proposes tokens; a token is taken only if it may stand beside the token before it, and
otherwise the walk tries its next shorter prefix or steps back. Two tokens may stand side by side when merging their
joined bytes gives just those two tokens; that answer is memoised. A sequence whose neighbours all agree is the one
that the merges produce, so no merge loop runs over the text.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skyloom.llm.common import loaded, map_rows, raw


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Fixed value: the splitting pattern of the public rank files, for which words between single spaces stand alone.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Encodes with ``ranks``, splitting by ``pattern`` first; every byte must be a token of its own."""

    #: Entries that each memo table holds before it starts afresh; tables only save work.
    MEMO = 500_000
    #: Longer pieces are encoded anew each time.
    MEMO_PIECE = 48

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for {len(missing)} of the 256 bytes")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.trie = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.trie.add_word(t.decode("latin-1"), (len(t), i))
        self.trie.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.sizes = {i: len(t) for i, t in self.tokens.items()}
        self.widest = max(self.sizes.values())
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.compatible: dict[int, bool] = {}
        self.by_word = pattern == SPACED
        self.uneven = regex.compile(r" (?:\s|\Z)")
        self.pieces = _Memo(self.MEMO // 5, self.MEMO_PIECE, lambda p: array("I", self.piece(p.encode())).tobytes())
        self.words = _Memo(self.MEMO, self.MEMO_PIECE, lambda w: b"".join(map(self.pieces.__getitem__, self.pattern.findall(" " + w))))

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joins into this one; None if no merges lead to it.

        Its time grows with the square of the token's length, once for each token.
        """
        if token not in self.halves:
            parts = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def beside(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of two tokens gives those two.

        Undoes merges next to the boundary, latest first. While x and y touch, a merge of both must come before the
        merges that take them up: strictly before on the left, where equal ranks go first.
        """
        ranks, tokens = self.ranks, self.tokens
        x, y, x_taken, y_taken = a, b, 1 << 60, 1 << 60
        while True:
            rank = ranks.get(tokens[x] + tokens[y], 1 << 60)
            if rank < x_taken and rank <= y_taken and rank != 1 << 60:
                return False
            left, right = len(tokens[x]) > 1, len(tokens[y]) > 1
            if left and (not right or x > y):
                if (halves := self.split(x)) is None:
                    return False
                x_taken, x = x, halves[1]
            elif right:
                if (halves := self.split(y)) is None:
                    return False
                y_taken, y = y, halves[0]
            else:
                return True

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            t = self.tokens[token]
            self.shorter[token] = next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), None)
        return self.shorter[token]

    def longest(self, piece: bytes, at: int) -> int:
        """The longest token that starts at a byte which no leftmost-longest match starts at."""
        ranks = self.ranks
        return next(ranks[t] for end in range(min(len(piece), at + self.widest), at, -1) if (t := piece[at:end]) in ranks)

    def piece(self, piece: bytes) -> list[int]:
        """The tokens of one match of the pattern."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        longest = {end - size + 1: token for end, (size, token) in self.trie.iter_long(piece.decode("latin-1"))}
        if len(self.compatible) >= self.MEMO:
            self.compatible.clear()
        known, sizes, shorter = self.compatible, self.sizes, self.shorter
        dead = bytearray(n + 1)  # ends that no valid sequence goes on from
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + sizes[token]
            if not dead[end]:
                if not out:
                    fits = True
                elif (fits := known.get(pair := out[-1] << 32 | token)) is None:
                    fits = known[pair] = self.beside(out[-1], token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    at, token = end, longest[end] if end in longest else self.longest(piece, end)
                    continue
            while (less := shorter[token] if token in shorter else self.prefix(token)) is None:
                dead[at] = 1
                token = out.pop()
                at -= sizes[token]
            token = less

    def encode(self, text: str) -> array:
        """The ids of a text as unsigned 32-bit integers.

        With PATTERN's leading optional space, a space before a non-space always starts a match. Where every space
        is such a one, the words between spaces are encoded on their own, from the memo; else the pattern runs over
        the whole text.
        """
        ids = array("I")
        if self.by_word and not self.uneven.search(text):
            first, *rest = text.split(" ")
            ids.frombytes(b"".join(map(self.pieces.__getitem__, self.pattern.findall(first))))
            ids.frombytes(b"".join(map(self.words.__getitem__, rest)))
        else:
            ids.frombytes(b"".join(map(self.pieces.__getitem__, self.pattern.findall(text))))
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Memo(dict):
    """Short strings to the bytes of their ids; starts afresh when full."""

    def __init__(self, size: int, longest: int, make: Callable[[str], bytes]):
        super().__init__()
        self.size, self.longest, self.make = size, longest, make

    def __missing__(self, s: str) -> bytes:
        ids = self.make(s)
        if len(s) <= self.longest:
            if len(self) >= self.size:
                self.clear()
            self[s] = ids
        return ids


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each rank file in each process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """One row per document: key, n_tokens, ids (unless ``keep`` is false), ids_sha256, decoded_sha256.

    ``path`` is where the rank file lies on every machine. Null and empty texts have no ids; repeated rows give
    repeated rows; null keys stay null; other columns of ``docs`` are not read. Texts are never cut, and time is
    linear in their length. An empty table gives no rows. No shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = loaded((path, pattern), lambda: Codec(read_ranks(path), pattern))
        n, ids_out, first, second = [], [], [], []
        for t in b.column(1):
            ids = c.encode(t.as_py().decode("utf-8", "replace"))
            data = ids.tobytes()
            n.append(len(ids))
            ids_out.append(data)
            first.append(hashlib.sha256(data).hexdigest())
            second.append(hashlib.sha256(c.decode(ids)).hexdigest())
        cols = [b.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second)]
        names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep:
            cols.append(pa.array(ids_out, pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep
    return map_rows(docs.select(key, raw(docs[text]).alias("t")), schema, run)
