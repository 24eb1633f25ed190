"""Fill-in-middle: texts cut at two token ranks and put in the order that an infilling model reads.

Tokens are ``[white]*[ink]+`` or a last run of white space, so a token starts where the text does and at every white
byte that follows an ink byte. That is a predicate on two adjacent bytes: each text is decomposed into chunks that
overlap by one byte, boundaries are counted chunk by chunk, prefix sums of the counts route both cut ranks to the
chunks that own them, and only those (two at most) are scanned again for the places. No list of tokens is ever made,
and no row leaves its task: the plan has no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.common import raw

#: Bytes of a chunk; only where the work is cut, never what comes out.
CHUNK = 1 << 16
MARKS = ("<P>", "<S>", "<M>")

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def boundaries(chunk: np.ndarray) -> np.ndarray:
    """Places in a chunk of UTF-8 bytes where a token starts after another one."""
    white = _WHITE[chunk]
    return np.flatnonzero(white[1:] & ~white[:-1]) + 1


def spans(size: int, chunk: int) -> list[tuple[int, int]]:
    """Byte ranges of the chunks of a text: each begins with the last byte of the one before."""
    return [(max(0, start - 1), min(size, start + chunk)) for start in range(0, size, chunk)]


def _bytes(a: pa.Array) -> list[np.ndarray | None]:
    """Views of the values of a binary array."""
    return [None if x is None else np.frombuffer(x, np.uint8) for x in (v.as_buffer() for v in a)]


def _counter(chunk: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def counted(texts: pa.Array) -> pa.Array:
        """Boundaries up to the end of each chunk: prefix sums of the chunks' own counts."""
        return pa.array([np.cumsum([boundaries(t[a:b]).size for a, b in spans(t.size, chunk)], dtype=np.int64) for t in _bytes(texts)], pa.list_(pa.int64()))

    return counted


@F.arrow_udf(T.LongType())
def _place(chunks: pa.Array, ranks: pa.Array) -> pa.Array:
    """The place of the given boundary (from 1) in a chunk; null where there is no chunk."""
    return pa.array([None if c is None else int(boundaries(c)[r - 1]) for c, r in zip(_bytes(chunks), ranks.to_pylist(), strict=True)], pa.int64())


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, plain_percent: int = 50, spm_percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of ``docs``: key, n (tokens), form, prefix_chars, middle_chars, output, restored.

    All draws come from the SHA-256 of ``seed:key``, so reruns agree and equal rows come out equal. ``form`` is plain
    (the text itself) for a draw of ``plain_percent`` or more in a hundred, and always for an empty text or one that
    holds a mark; else spm (suffix first) in ``spm_percent`` of a hundred, or psm. ``restored`` is the text rebuilt from output and form alone.

    A null text counts as empty, a null key draws as an empty one. Texts of white space have one token. Very long texts
    are scanned whole, a chunk at a time. Other columns of ``docs`` are not read, whatever their names.
    """
    d = docs.select(docs[key].alias("key"), raw(docs[text]).alias("bytes"))
    d = d.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256))
    string = F.col("bytes").cast("string")
    marked = F.lit(False)
    for m in MARKS:
        marked |= F.contains(string, F.lit(m))
    draws = [F.conv(F.substring("hash", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    form = F.when((F.octet_length("bytes") == 0) | marked | (draws[2] % 100 >= plain_percent), "plain").when(draws[3] % 100 < spm_percent, "spm").otherwise("psm")
    d = d.select("key", "bytes", draws[0].alias("a"), draws[1].alias("b"), form.alias("form"))
    d = d.withColumn("ends", _counter(chunk)("bytes"))
    n = F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.lit(0)).cast("long")
    a, b = F.pmod("a", n + 1), F.pmod("b", n + 1)
    d = d.select("key", "bytes", "ends", n.alias("n"), "form", F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))
    for cut in ("first", "second"):
        rank = F.col(cut)
        owner = F.when((F.col("form") != "plain") & (rank > 0) & (rank < F.col("n")), F.size(F.filter("ends", lambda e: e < rank)))  # noqa: B023  it is called at once
        d = d.withColumn(f"{cut}_owner", owner)
        owner = F.col(f"{cut}_owner")
        before = F.when(owner > 0, F.element_at("ends", owner)).otherwise(0)
        start = F.when(owner > 0, owner * chunk).when(owner == 0, 1)  # from 1, the byte before included
        d = d.withColumns({f"{cut}_rank": rank - before, f"{cut}_from": start - 1, f"{cut}_chunk": F.col("bytes").substr(start, F.lit(chunk + 1))})
    d = d.withColumns({f"{c}_place": _place(F.col(f"{c}_chunk"), F.col(f"{c}_rank")) for c in ("first", "second")})
    size = F.octet_length("bytes").cast("long")
    place = {c: F.when(F.col(c) == 0, 0).when(F.col(c) == F.col("n"), size).otherwise(F.col(f"{c}_from") + F.col(f"{c}_place")).cast("int") for c in ("first", "second")}
    d = d.select("key", "bytes", "n", "form", place["first"].alias("p"), place["second"].alias("m"))
    piece = lambda start, stop: F.col("bytes").substr(start + 1, stop - start).cast("string")
    p, m = F.col("p"), F.col("m")
    whole = F.col("form") == "plain"
    d = d.select("key", "n", "form", string.alias("text"), *[F.when(~whole, x).alias(name) for name, x in (("prefix", piece(F.lit(0), p)), ("middle", piece(p, m)), ("suffix", piece(m, F.octet_length("bytes"))))])
    order = {"spm": ("suffix", "prefix", "middle"), "psm": ("prefix", "suffix", "middle")}
    mark = dict(zip(("prefix", "suffix", "middle"), MARKS, strict=True))
    output = F.when(whole, F.col("text"))
    for name, parts in order.items():
        output = output.when(F.col("form") == name, F.concat(*[c for part in parts for c in (F.lit(mark[part]), F.col(part))]))
    d = d.select("key", "n", "form", *[F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")], output.alias("output"))
    return restore(d).withColumnRenamed("key", key)


def restore(made: DataFrame) -> DataFrame:
    """``made`` with restored: the text of its output and form. No mark stands in a piece, nor arises where pieces meet marks."""
    parts = made.withColumn("parts", F.when(F.col("form") != "plain", F.split("output", "<[PSM]>")))
    part = lambda i: F.col("parts")[i]
    text = F.when(F.col("form") == "spm", F.concat(part(2), part(3), part(1))).when(F.col("form") == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.col("output"))
    return parts.withColumn("restored", text).drop("parts")
