"""Nearness and components without pairs, against all pairs."""

import numpy as np
import pytest

from skyloom.operators import nearness


def table(spark, p, groups=None, ids=None):
    rows = [(int(ids[i]) if ids is not None else i, int(groups[i]) if groups is not None else 0, *map(float, q)) for i, q in enumerate(p)]
    return spark.createDataFrame(rows, "splat_id long, frame_idx int, x double, y double, z double")


def clouds(rng):
    """Even, clustered, flat and gridded points; two dense balls just out of reach of one another, and just within it."""
    ball = rng.normal(size=(150, 3)) * 0.02
    away = lambda gap: np.concatenate([ball - [ball[:, 0].max(), 0, 0], (b := rng.normal(size=(150, 3)) * 0.02) - [b[:, 0].min() - gap, 0, 0]])
    yield rng.uniform(-1, 1, (250, 3)), 0.2
    yield np.concatenate([ball, ball + 0.3, rng.uniform(-1, 1, (60, 3))]), 0.15
    yield np.round(rng.uniform(-1, 1, (250, 3)), 1), 0.1
    yield np.repeat(rng.uniform(0, 1, (40, 3)), 6, axis=0), 0.25
    yield away(0.1001), 0.1
    yield away(0.02), 0.1
    yield np.stack(np.meshgrid(np.arange(18), np.arange(14), [0.0]), -1).reshape(-1, 3) * 0.1 - 1, 0.1


def distances(p, q):
    return np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1))


@pytest.mark.parametrize("k", range(7))
@pytest.mark.parametrize("few", [1, nearness.FEW])
def test_equal_to_all_pairs(spark, monkeypatch, k, few):
    monkeypatch.setattr(nearness, "FEW", few)
    rng = np.random.default_rng(k)
    p, r = list(clouds(rng))[k]
    groups = rng.integers(0, 4, len(p))
    t = table(spark, p, groups)
    near = distances(p, p) <= r
    got = {(x.splat_id, x.frame_idx) for x in nearness.near_groups(t, t, r).collect()}
    assert got == {(i, int(g)) for i in range(len(p)) for g in set(groups[near[i]])}
    label = np.arange(len(p))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(p))])
        if (new == label).all():
            break
        label = new
    rows = nearness.near_components(t, r).collect()
    assert len(rows) == len(p) and {x.node: x.component for x in rows} == dict(enumerate(label.tolist()))


def test_unsound_and_repeated(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0), (2, None, 0.05, 0.0, 0.0), (3, 1, None, 0.0, 0.0), (4, 1, float("nan"), 0.0, 0.0), (5, 1, float("inf"), 0.0, 0.0), (6, 1, 5.0, 0.0, 0.0), (6, 2, 0.1, 0.0, 0.0), (7, 1, 5.05, 0.0, 0.0), (1, 0, 0.0, 0.0, 0.0)]
    t = spark.createDataFrame(rows, "splat_id long, frame_idx int, x double, y double, z double")
    assert {tuple(r) for r in nearness.near_groups(t, t, 0.06).collect()} == {(1, 0), (2, 0), (2, 2), (6, 1), (6, 2), (7, 1)}
    assert {r.node: r.component for r in nearness.near_components(t, 0.06).collect()} == {1: 1, 2: 1, 6: 1, 7: 1}
    none = t.where("false")
    assert nearness.near_any(none, t, 1.0).count() == nearness.near_any(t, none, 1.0).count() == nearness.near_components(none, 1.0).count() == 0


def test_crowded_cells(spark):
    """A hundred thousand points in one cell, which all pairs would make five thousand million."""
    rng = np.random.default_rng(1)
    d = spark.range(100_000).selectExpr("id as splat_id", "0 as frame_idx", "0.04 * rand(1) as x", "0.04 * rand(2) as y", "0.04 * rand(3) as z")
    ring = rng.normal(size=(200, 3))
    ring = table(spark, ring / np.linalg.norm(ring, axis=1)[:, None] * 0.13 + 0.02, ids=np.arange(200_000, 200_200))
    d = d.persist()
    both = d.union(ring)
    parts = nearness.near_components(both, 0.1)
    ids = {r.component for r in parts.where("node < 100000").select("component").distinct().collect()}
    assert ids == {0} and parts.count() == 100_200
    inside = np.array(d.select("x", "y", "z").collect())
    outer = np.array(ring.select("x", "y", "z").collect())
    want = {200_000 + i for i in range(200) if (np.sqrt(((inside - outer[i]) ** 2).sum(1)) <= 0.1).any()}
    got = {r.splat_id for r in nearness.near_any(ring, d, 0.1).collect()}
    assert got == want and 0 < len(want) < 200
    assert nearness.near_any(d, ring, 0.1).count() > 0
    d.unpersist()
