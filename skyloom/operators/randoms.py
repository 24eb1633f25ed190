"""Draws that equal a seeded generator's, made where they are needed: each raster row jumps to its place in the stream."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def seeded_uniform(row: Column, col: Column, width: Column | int, seed: int = 42) -> Column:
    """The draw at (row, col) of ``numpy.random.default_rng(seed).random((rows, width))``, without the rows before it.

    The generator (PCG64) is a linear recurrence, so a row's first state follows from the seed in as many squarings as
    its place has bits; a batch of cells makes each of its rows once. Null where a place is null.
    """

    @F.arrow_udf(T.DoubleType())
    def draws(rows: pa.Array, cols: pa.Array, widths: pa.Array) -> pa.Array:
        r, c, w = (x.to_numpy(zero_copy_only=False) for x in (rows, cols, widths))
        out, sound = np.full(len(r), np.nan), ~(np.isnan(r) | np.isnan(c) | np.isnan(w))
        places = np.stack([r[sound], w[sound]]).astype(np.int64)
        lines, which = np.unique(places, axis=1, return_inverse=True)
        drawn, at = np.empty(places.shape[1]), c[sound].astype(np.int64)
        for k, (line, wide) in enumerate(lines.T.tolist()):
            own = which.ravel() == k
            bits = np.random.PCG64(seed)
            bits.advance(line * wide)
            drawn[own] = np.random.Generator(bits).random(wide)[at[own]]
        out[sound] = drawn
        return pa.array(out, pa.float64(), mask=~sound)

    wide = F.lit(width) if isinstance(width, int) else width
    return draws(row.cast("long"), col.cast("long"), wide.cast("long"))


def jump_sql(seed: int, bits: int) -> list[tuple[int, int]]:
    """Multiplier and increment, modulo 2^128, of 1, 2, 4 … steps of the generator, from its recurrence."""
    state = np.random.PCG64(seed).state["state"]
    one = np.random.PCG64(seed).advance(1).state["state"]["state"]
    # Fixed value of the generator: its multiplier.
    a, c = 0x2360ED051FC65DA44385DF649FCCF645, state["inc"]
    assert (a * state["state"] + c) % 2**128 == one
    out = []
    for _ in range(bits):
        out.append((a, c))
        a, c = a * a % 2**128, (a * c + c) % 2**128
    return out
