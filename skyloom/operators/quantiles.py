"""Exact percentiles in bounded memory, by radix selection over the ordered bits of doubles."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.session import cut

#: Rows whose percentiles one aggregate finds at once: its buffer holds each distinct value.
BOUND = 1_000_000
#: Bits that a round decides: a task ranks 2^16 counts of one prefix at most.
BITS = 16
#: Prefixes that are sent to all tasks at most; more meet their rows by key.
SENT = 10_000


def _turned(bits: np.ndarray) -> np.ndarray:
    """The bits of doubles as whole numbers in the order of the doubles, and back."""
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


@F.arrow_udf(T.LongType())
def ordered_bits(v: pa.Array) -> pa.Array:
    x = v.to_numpy(zero_copy_only=False) + 0.0  # one zero
    return pa.array(_turned(np.where(np.isnan(x), np.nan, x).view(np.int64)), pa.int64())


@F.arrow_udf(T.DoubleType())
def from_bits(k: pa.Array) -> pa.Array:
    return pa.array(_turned(k.to_numpy(zero_copy_only=False)).view(np.float64), pa.float64())


def select_ranks(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, value): the value of rank ``rank`` (from 0) among each group's, for ``rows(by, k)`` and ``targets(by, i, rank)``.

    Four rounds count the next sixteen bits behind the prefixes still sought, so ties cost a count and no task holds
    more than the counts of one prefix. Prefixes that are few are broadcast, else they meet the rows by group and prefix.
    """
    upto = lambda shift: F.shiftright("k", shift) if shift < 64 else F.lit(0).cast("long")
    sought = targets.select(*by, "i", "rank", F.lit(0).cast("long").alias("prefix"))
    for shift in range(64 - BITS, -1, -BITS):
        counted = rows.select(*by, upto(shift + BITS).alias("prefix"), upto(shift).alias("next"))
        if shift + BITS < 64:
            wanted = sought.select(*by, "prefix").distinct()
            wanted = F.broadcast(wanted) if wanted.limit(SENT + 1).count() <= SENT else wanted
            counted = counted.join(wanted, [*by, "prefix"], "left_semi")
        hist = counted.groupBy(*by, "prefix", "next").agg(F.count("*").alias("c"))
        below = F.sum("c").over(Window.partitionBy(*by, "prefix").orderBy("next")) - F.col("c")
        met = sought.join(hist.withColumn("below", below), [*by, "prefix"])
        met = met.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("c")))
        sought = cut(met.select(*by, "i", (F.col("rank") - F.col("below")).alias("rank"), F.col("next").alias("prefix")))
    return sought.select(*by, "i", from_bits("prefix").alias("value"))


def quantiles(df: DataFrame, value: str | Column, probs: list[float], by: tuple[str, ...] | list[str] = (), discrete: bool = False) -> DataFrame:
    """(by, p, n): the percentiles of each group as an array, and its number of values.

    With linear interpolation, or if ``discrete`` the least value whose share of the rows reaches the probability. Nulls
    do not count, NaN is the largest; without values ``p`` is null and, but for no groups at all, there is no row. A
    table of at most BOUND rows takes one aggregate, a larger one radix selection. Groups must not be null there.
    """
    v, by = F.col(value) if isinstance(value, str) else value, list(by)
    rows = df.select(*by, v.cast("double").alias("_v")).where("_v is not null")
    if rows.limit(BOUND + 1).count() <= BOUND:
        disc = F.array(*[F.expr(f"percentile_disc({float(p)!r}) WITHIN GROUP (ORDER BY _v)") for p in probs])
        out = rows.groupBy(*by).agg(disc.alias("p") if discrete else F.percentile("_v", list(probs)).alias("p"), F.count("*").alias("n"))
        return out.withColumn("p", F.when(F.col("n") > 0, F.col("p")))
    rows = cut(rows.select(*by, ordered_bits("_v").alias("k")))
    sizes = cut(rows.groupBy(*by).agg(F.count("*").alias("n")))
    at = [F.greatest(F.ceil(F.lit(float(p)) * F.col("n")) - 1, F.lit(0)).cast("double") if discrete else F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = sizes.select(*by, "n", F.posexplode(F.array(*at)).alias("i", "at"))
    ends = F.array(F.floor("at"), F.least(F.floor("at") + 1, F.col("n") - 1))
    targets = ranks.select(*by, "i", F.posexplode(ends).alias("end", "rank")).select(*by, (F.col("i") * 2 + F.col("end")).alias("i"), "rank")
    found = select_ranks(rows, targets, by).select(*by, F.floor(F.col("i") / 2).cast("int").alias("i"), (F.col("i") % 2).alias("end"), "value")
    pairs = found.groupBy(*by, "i").agg(F.max(F.when(F.col("end") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("value"))).alias("b"))
    part = F.col("at") - F.floor("at")
    q = F.when(part > 0, F.col("a") * (1 - part) + F.col("b") * part).otherwise(F.col("a"))
    done = ranks.join(pairs, [*by, "i"]).select(*by, "n", F.struct("i", q.alias("q")).alias("x"))
    return done.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["q"]).alias("p")).select(*by, "p", "n")


def with_quantiles(df: DataFrame, value: str | Column, probs: list[float], by: tuple[str, ...] | list[str] = (), name: str = "p") -> DataFrame:
    """``df`` with the percentiles of its group in a column."""
    q = quantiles(df, value, probs, by).select(*by, F.col("p").alias(name))
    return df.join(q, list(by)) if by else df.join(F.broadcast(q))


def combined(parts: list[DataFrame]) -> DataFrame:
    """One-row tables side by side."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)
