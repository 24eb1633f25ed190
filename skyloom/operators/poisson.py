"""Poisson's equation on rasters of any size: blocks with halos, a coarse grid, and rounds until the residual is small.

Unknown cells satisfy ``n x - (sum of the n neighbours there are) = rhs``. A raster is dealt to square blocks that know a
rim of their neighbours' cells. In a round each block gets its rim anew, a coarse grid with a node at each corner of
the blocks carries the smooth part of the error across the raster, and each block solves its own cells with its rim held.
Cells are dealt by groups of blocks. A group that nothing lies around, as a small raster, has no rim to wait for: its
task solves it at once, and only groups with neighbours take part in the rounds.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.session import cut

#: Cells of a block's side, and of the rim that it shares.
BLOCK, RIM = 64, 24
#: Blocks of a group's side.
GROUP = 8
#: Passes over enclosed regions at most, to settle last bits.
SWEEPS = 200


def _matvec(x: np.ndarray, there: np.ndarray, degree: np.ndarray) -> np.ndarray:
    p, out = np.where(there, x, 0.0), degree * x
    out[1:] -= p[:-1]
    out[:-1] -= p[1:]
    out[:, 1:] -= p[:, :-1]
    out[:, :-1] -= p[:, 1:]
    return out


def _degree(there: np.ndarray) -> np.ndarray:
    p = np.pad(there, 1).astype(float)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]


def _conjugate(matvec, b: np.ndarray, x: np.ndarray, scale: np.ndarray, rounds: int, least: float) -> np.ndarray:
    """Conjugate gradients with a diagonal; ``least`` ends them by the largest residual."""
    r = b - matvec(x)
    z = r * scale
    p, rz = z.copy(), float((r * z).sum())
    for _ in range(rounds):
        if rz <= 0 or np.abs(r).max() <= least:
            break
        q = matvec(p)
        bend = float((p * q).sum())
        if not bend > 1e-14 * float((p * p).sum()):  # constant over a region that nothing holds
            break
        step = rz / bend
        x, r = x + step * p, r - step * q
        z = r * scale
        rz, old = float((r * z).sum()), rz
        p = z + rz / old * p
    return x


def _hats(start: int, count: int, nodes: range, block: int) -> np.ndarray:
    """Weights (cell, node): straight lines from a corner of blocks to the next."""
    at = np.arange(start, start + count)[:, None]
    return np.maximum(0.0, 1 - np.abs(at - (np.array(list(nodes)) * block - 0.5)[None]) / block)


class Tiling:
    """What a task does with one block; arrays are of the block with its rim."""

    def __init__(self, block: int, rim: int):
        self.block, self.rim, self.side = block, rim, block + 2 * rim
        self.own = (slice(rim, rim + block),) * 2

    def strips(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(dy, dx, values): what lies in the rim of the neighbour in that direction."""
        own = x[self.own]
        part = {-1: slice(0, self.rim), 0: slice(None), 1: slice(self.block - self.rim, None)}
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    yield dy, dx, own[part[dy], part[dx]]

    def place(self, x: np.ndarray, dy: int, dx: int, values: np.ndarray) -> None:
        """Puts a strip sent in direction (dy, dx): it lies on the opposite side."""
        part = {1: slice(0, self.rim), 0: slice(self.rim, self.rim + self.block), -1: slice(self.rim + self.block, None)}
        x[part[dy], part[dx]] = values

    def residual(self, x: np.ndarray, there: np.ndarray, free: np.ndarray, rhs: np.ndarray) -> np.ndarray:
        return np.where(free, rhs - _matvec(x, there, _degree(there)), 0.0)[self.own]

    def coarse_sums(self, r: np.ndarray, ty: int, tx: int) -> np.ndarray:
        b = self.block
        return _hats(ty * b, b, range(ty, ty + 2), b).T @ r @ _hats(tx * b, b, range(tx, tx + 2), b)

    def coarse_matrix(self, there: np.ndarray, free: np.ndarray, ty: int, tx: int) -> np.ndarray:
        """(9, 9): the equation between the nodes (ty, tx) to (ty + 2, tx + 2), from this block's edges."""
        b, r = self.block, self.rim
        here, open_ = there[r : r + b + 1, r : r + b + 1], free[r : r + b + 1, r : r + b + 1]
        y, x = _hats(ty * b, b + 1, range(ty, ty + 3), b), _hats(tx * b, b + 1, range(tx, tx + 3), b)
        phi = np.einsum("vi,uj->ijvu", y, x).reshape(9, b + 1, b + 1) * open_
        down = (phi[:, 1:, :b] - phi[:, :-1, :b]) * (here[1:, :b] & here[:-1, :b])
        right = (phi[:, :b, 1:] - phi[:, :b, :-1]) * (here[:b, 1:] & here[:b, :-1])
        return sum(np.einsum("kvu,lvu->kl", d, d) for d in (down, right))

    def raised(self, nodes: np.ndarray, ty: int, tx: int) -> np.ndarray:
        """Values of the nodes (ty - 1, tx - 1) to (ty + 2, tx + 2) at all cells."""
        b = self.block
        return _hats(ty * b - self.rim, self.side, range(ty - 1, ty + 3), b) @ nodes @ _hats(tx * b - self.rim, self.side, range(tx - 1, tx + 3), b).T

    def solved(self, x: np.ndarray, there: np.ndarray, free: np.ndarray, rhs: np.ndarray, least: float) -> np.ndarray:
        """The cells that are free, but for the outermost, with all others held."""
        inner = free.copy()
        inner[[0, -1], :] = inner[:, [0, -1]] = False
        degree = _degree(there)
        r = np.where(inner, rhs - _matvec(x, there, degree), 0.0)
        scale = np.where(inner, 1 / np.maximum(degree, 1), 0.0)
        return x + _conjugate(lambda p: np.where(inner, _matvec(p, there, degree), 0.0), r, np.zeros_like(x), scale, 12 * self.side, least)

    def alone(self, x: np.ndarray, there: np.ndarray, free: np.ndarray, rhs: np.ndarray, least: float, rounds: int) -> tuple[np.ndarray, float]:
        """All free cells of a group that nothing lies around, and the largest residual that is left."""
        degree = _degree(there)
        scale = np.where(free, 1 / np.maximum(degree, 1), 0.0)
        left = lambda x: np.where(free, rhs - _matvec(x, there, degree), 0.0)
        before = np.inf
        for _ in range(rounds):  # anew from the true residual, which drifts from the one carried along
            r = left(x)
            most = np.abs(r).max()
            if not least < most < before:
                break
            before = most
            x = x + _conjugate(lambda p: np.where(free, _matvec(p, there, degree), 0.0), r, np.zeros_like(x), scale, max(12 * max(x.shape), int(free.sum())), least / 4)
        x = self.settled(x, there, free, rhs)
        return x, float(np.nan_to_num(np.abs(left(x)), nan=np.inf).max())

    def settled(self, x: np.ndarray, there: np.ndarray, free: np.ndarray, rhs: np.ndarray) -> np.ndarray:
        """Regions of free cells that known ones enclose within the block and its rim, to the last bits.

        Such a region depends on nothing else, so each cell is set to the mean of its neighbours until none changes.
        """
        left = free.copy()  # what the outermost cells do not reach
        left[[0, -1], :] = left[:, [0, -1]] = False
        reached = free & ~left
        while reached.any():
            p = np.pad(reached, 1)
            reached = left & (p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:])
            left &= ~reached
        degree = np.maximum(_degree(there), 1)
        p = np.pad(np.where(there, x, 0.0), 1)
        for _ in range(SWEEPS if left.any() else 0):
            new = p[1:-1, :-2] + p[1:-1, 2:]
            for part in (p[:-2, 1:-1], p[2:, 1:-1], rhs):
                new += part
            new /= degree
            if np.array_equal(new[left], p[1:-1, 1:-1][left]):
                break
            np.copyto(p[1:-1, 1:-1], new, where=left)
        return np.where(left, p[1:-1, 1:-1], x)


def _coarse_solve(blocks: pd.DataFrame) -> dict[tuple[int, int], float]:
    """The nodes of one raster: a number for each corner of its blocks."""
    names: dict[tuple[int, int], int] = {}
    node = lambda y, x: names.setdefault((y, x), len(names))
    rows, cols, vals, at, sums = [], [], [], [], []
    for ty, tx, m, s in zip(blocks["ty"], blocks["tx"], blocks["matrix"], blocks["sums"], strict=True):
        nine = np.array([node(ty + i, tx + j) for i in range(3) for j in range(3)])
        rows.append(np.repeat(nine, 9))
        cols.append(np.tile(nine, 9))
        vals.append(np.frombuffer(m))
        at.append(nine[[0, 1, 3, 4]])
        sums.append(np.frombuffer(s))
    i, j, a = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    n = len(names)
    b = np.bincount(np.concatenate(at), np.concatenate(sums), n)
    diagonal = np.bincount(i[i == j], a[i == j], n)
    scale = np.where(diagonal > 1e-12, 1 / np.maximum(diagonal, 1e-12), 0.0)
    b = np.where(scale > 0, b, 0.0)
    x = _conjugate(lambda p: np.bincount(i, a * p[j], n), b, np.zeros(n), scale, 4 * n + 100, 1e-12 * max(1e-300, float(np.abs(b).max())))
    return {k: float(x[v]) for k, v in names.items()}


def solve(cells: DataFrame, by: str = "raster_id", rhs: str = "rhs", fixed: str = "fixed", block: int = BLOCK, rim: int = RIM, tolerance: float = 1e-9, rounds: int = 100, group: int = GROUP) -> DataFrame:
    """(by, v, u, value): cells with ``fixed`` keep it, the others satisfy the equation to ``tolerance``.

    ``cells(by, v >= 0, u >= 0, rhs, fixed)``: a cell where fixed is null is unknown, a null rhs is zero. Neighbours that
    are not there drop out, so a border without fixed cells is free. The largest residual is at most ``tolerance`` times
    the largest of 1, rhs and fixed; regions that fixed cells enclose within a block and its rim settle to the last bits.
    Should ``rounds`` not do, as where some region has no fixed cell and a rhs that allows no answer, this raises. A task
    holds a group of ``group`` by ``group`` blocks at most, or one number for each block of a raster that has more.
    """
    t = Tiling(block, rim)
    kind = cells.schema[by].dataType.simpleString()
    key = [by, "ty", "tx"]
    rows = cells.select(by, "v", "u", F.coalesce(F.col(rhs), F.lit(0.0)).cast("double").alias("rhs"), F.col(fixed).cast("double").alias("fixed"))
    wide = block * group
    near = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - rim) / wide)), F.floor((F.col(c) + rim) / wide))
    dealt = rows.withColumn("gy", F.explode(near("v"))).withColumn("gx", F.explode(near("u")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        gy, gx = int(pdf["gy"].iloc[0]), int(pdf["gx"].iloc[0])
        i, j = pdf["v"].to_numpy() - gy * wide + rim, pdf["u"].to_numpy() - gx * wide + rim
        h, w = (min(group, int(k.max() - rim) // block + 1) for k in (i, j))  # blocks down to the last cell
        shape = h * block + 2 * rim, w * block + 2 * rim
        x, b, there, free = np.zeros(shape), np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
        given, right = pdf["fixed"].to_numpy(np.float64), pdf["rhs"].to_numpy()
        x[i, j], b[i, j], there[i, j], free[i, j] = np.nan_to_num(given), right, True, np.isnan(given)
        size = max(float(np.abs(c[np.isfinite(c)]).max(initial=1.0)) for c in (given, right))
        inside = (slice(rim, rim + h * block), slice(rim, rim + w * block))
        alone = there[inside].sum() == there.sum()
        most = 0.0
        if alone:
            part = (slice(i.min() - 1, i.max() + 2), slice(j.min() - 1, j.max() + 2))
            x[part], most = t.alone(x[part], there[part], free[part], b[part], tolerance * size, rounds)
        out = []
        for y, z in itertools.product(range(h), range(w)):
            ty, tx = gy * group + y, gx * group + z
            cells = (slice(y * block, y * block + t.side), slice(z * block, z * block + t.side))
            if not there[cells][t.own].any():  # a block beyond the raster
                continue
            if alone:
                row = (x[cells][t.own].tobytes(), None, there[cells][t.own].tobytes(), None, None)
            else:
                row = (*(k[cells].tobytes() for k in (x, b, there, free)), t.coarse_matrix(there[cells], free[cells], ty, tx).tobytes())
            out.append((pdf[by].iloc[0], ty, tx, *row, most, size))
        return pd.DataFrame(out, columns=[*columns, "most", "size"])

    fields = f"{by} {kind}, ty long, tx long, x binary"
    static = f"{fields}, rhs binary, there binary, free binary, matrix binary"
    array = lambda data, kind=np.float64: np.frombuffer(data, kind).reshape(t.side, t.side).copy()
    columns = [*key, "x", "rhs", "there", "free", "matrix"]
    state = cut(dealt.groupBy(by, "gy", "gx").applyInPandas(pack, f"{static}, most double, size double"))
    size, most, waiting = state.agg(F.max("size"), F.max("most"), F.count("free")).first()
    least = tolerance * (size or 1.0)
    if (most or 0.0) > least:
        raise RuntimeError(f"a residual of {most} is left after {rounds} rounds; {least} is asked")
    done = state.where("free IS NULL").select(*columns)
    state = state.where("free IS NOT NULL").select(*columns)

    none = [F.lit(None).cast(k).alias(c) for c, k in (("dy", "int"), ("dx", "int"), ("part", "binary"))]
    empty = [F.lit(None).cast("binary").alias(c) for c in columns[3:]]

    def strips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(r[by], r["ty"] + dy, r["tx"] + dx, dy, dx, s.tobytes()) for r in pdf.to_dict("records") for dy, dx, s in t.strips(array(r["x"]))]
            yield pd.DataFrame(out, columns=[*key, "dy", "dx", "part"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["part"].isna()]
        out = own[columns]
        if own.empty:  # a place beyond the raster
            return out.assign(most=[], sums=[])
        r = own.iloc[0]
        x, there, free = array(r["x"]), array(r["there"], bool), array(r["free"], bool)
        sent = pdf[pdf["part"].notna()]
        for dy, dx, s in zip(sent["dy"].astype(int), sent["dx"].astype(int), sent["part"], strict=True):
            t.place(x, dy, dx, np.frombuffer(s).reshape(tuple(rim if d else block for d in (dy, dx))))
        res = t.residual(x, there, free, array(r["rhs"]))
        return out.assign(x=[x.tobytes()], most=float(np.nan_to_num(np.abs(res), nan=np.inf).max()), sums=[t.coarse_sums(res, int(r["ty"]), int(r["tx"])).tobytes()])

    def coarse(pdf: pd.DataFrame) -> pd.DataFrame:
        value = _coarse_solve(pdf)
        four = lambda ty, tx: np.array([value.get((ty - 1 + i, tx - 1 + j), 0.0) for i in range(4) for j in range(4)]).tobytes()
        return pdf[key].assign(part=[four(ty, tx) for ty, tx in zip(pdf["ty"], pdf["tx"], strict=True)])

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        r, nodes = pdf[pdf["part"].isna()].iloc[0], np.frombuffer(pdf["part"].dropna().iloc[0]).reshape(4, 4)
        x, there, free, b = array(r["x"]), array(r["there"], bool), array(r["free"], bool), array(r["rhs"])
        x += np.where(free, t.raised(nodes, int(r["ty"]), int(r["tx"])), 0.0)
        return pdf[pdf["part"].isna()][columns].assign(x=[t.solved(x, there, free, b, least / 4).tobytes()])

    # Blocks and what is sent to them meet as one table grouped by block: sizes of joins in rounds would be estimated as
    # products of products.
    for turn in range(rounds + 1 if waiting else 0):
        sent = state.mapInPandas(strips, f"{by} {kind}, ty long, tx long, dy int, dx int, part binary").select(*key, *empty, "dy", "dx", "part")
        met = cut(state.select(*columns, *none).union(sent).groupBy(*key).applyInPandas(meet, f"{static}, most double, sums binary"))
        most = met.agg(F.max("most")).first()[0]
        if most <= least:
            done = done.union(met.select(*columns))
            break
        if turn == rounds:
            raise RuntimeError(f"a residual of {most} is left after {rounds} rounds; {least} is asked")
        nodes = met.select(*key, "matrix", "sums").groupBy(by).applyInPandas(coarse, f"{by} {kind}, ty long, tx long, part binary").select(*key, *empty, "part")
        state = cut(met.select(*columns, none[2]).union(nodes).groupBy(*key).applyInPandas(step, static))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                if r["free"] is None:  # solved alone, without a rim
                    x, there = (np.frombuffer(r[c], k).reshape(block, block) for c, k in (("x", np.float64), ("there", bool)))
                else:
                    there = array(r["there"], bool)
                    x, there = t.settled(array(r["x"]), there, array(r["free"], bool), array(r["rhs"]))[t.own], there[t.own]
                i, j = np.nonzero(there)
                yield pd.DataFrame({by: r[by], "v": (i + r["ty"] * block).astype(np.int32), "u": (j + r["tx"] * block).astype(np.int32), "value": x[i, j]})

    return done.mapInPandas(unpack, f"{by} {kind}, v int, u int, value double")


def fill(rasters: DataFrame, by: str, value: str, known: str, **kw) -> DataFrame:
    """Unknown cells by Laplace's equation with the known ones held, not below zero; null values are not known."""
    held = F.when(F.coalesce(F.col(known).cast("double"), F.lit(0.0)) > 0, F.col(value).cast("double"))
    out = solve(rasters.select(by, "v", "u", F.lit(0.0).alias("rhs"), held.alias("fixed")), by, **kw)
    return out.withColumn("value", F.greatest("value", F.lit(0.0)))


def bordered(rasters: DataFrame, by: str, rhs: str, border: str, **kw) -> DataFrame:
    """Cells that lack one of four neighbours take ``border``, the others solve for ``rhs``; not below zero."""
    from skyloom.operators.stencils import along

    edge = F.lit(False)
    for axis in ("v", "u"):
        w = along(axis, (by,))
        edge |= F.coalesce(F.lag(axis).over(w) != F.col(axis) - 1, F.lit(True)) | F.coalesce(F.lead(axis).over(w) != F.col(axis) + 1, F.lit(True))
    cells = rasters.withColumn("_edge", edge).select(by, "v", "u", F.col(rhs).alias("rhs"), F.when(F.col("_edge"), F.col(border)).alias("fixed"))
    return solve(cells, by, **kw).withColumn("value", F.greatest("value", F.lit(0.0)))
