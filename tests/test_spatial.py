import numpy as np
import pytest

from skyloom.operators import spatial


def cloud(spark, p):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "splat_id long, x double, y double, z double")


def brute(p, k):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return {i: [j for j in np.lexsort((np.arange(len(p)), d[i]))[:k]] for i in range(len(p))}


@pytest.mark.parametrize("seed,scale", [(0, (1, 1, 1)), (1, (50, 1, 0.01)), (2, (1, 0, 0))])
def test_knn_equals_brute_force(spark, seed, scale):
    p = np.random.default_rng(seed).normal(size=(1500, 3)) * np.array(scale)
    p[:5] = p[5]  # copies
    want, got = brute(p, 4), {}
    for r in spatial.knn(cloud(spark, p), 4).collect():
        got.setdefault(r.splat_id, {})[r["rank"]] = r.neighbor
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    for i, near in want.items():
        assert np.allclose([d[i, got[i][k + 1]] for k in range(4)], [d[i, j] for j in near])


def test_knn_of_a_dense_cluster_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LEAF", 100)
    monkeypatch.setattr(spatial, "LEAST_LEAF", 100)
    r = np.random.default_rng(5)
    p = np.concatenate([r.normal(size=(500, 3)), r.normal(size=(800, 3)) * 1e-3, np.full((700, 3), 0.25)])
    p = p[r.permutation(len(p))].round(6)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = {}
    for x in spatial.knn(cloud(spark, p), 3).collect():
        got.setdefault(x.splat_id, {})[x["rank"]] = x.neighbor
    for i in range(len(p)):
        assert [got[i][k] for k in (1, 2, 3)] == np.lexsort((np.arange(len(p)), d[i]))[:3].tolist()


def test_knn_of_many_copies(spark):
    from pyspark.sql import functions as F

    p = spark.range(100_000).select(F.col("id").alias("splat_id"), *[F.when(F.col("id") < 99_000, 0.5).otherwise(F.rand(3)).alias(a) for a in "xyz"])
    near = spatial.knn(p, 2).where("splat_id < 99000")
    assert near.count() == 198_000 and near.where("dist > 0").count() == 0
    assert {(r["rank"], r.neighbor) for r in near.where("splat_id > 5").collect()} == {(1, 0), (2, 1)}


def test_knn_with_few_points(spark):
    rows = spatial.knn(cloud(spark, np.array([[0, 0, 0], [1, 0, 0], [5, 0, 0]])), 8).collect()
    assert len(rows) == 6
    assert spatial.knn(cloud(spark, np.array([[0, 0, 0]])), 8).count() == 0


def test_radius_join_is_inclusive_and_crosses_cells(spark):
    c = cloud(spark, np.array([[-0.05, 0, 0], [0.05, 0, 0], [0.0500001, 0.2, 0], [float("nan"), 0, 0]]))
    got = {(r.lid, r.rid) for r in spatial.radius_join(c, c, 0.1).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (0, 1), (1, 0)}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.component for r in spatial.components(e).collect()}
    assert got[2] == 1 and got[3] == 1 and got[9] == 8 and 5 not in got and got[140] == 100


def test_voxels_shrink_to_a_budget(spark):
    p = np.random.default_rng(3).uniform(0, 10, (300, 3))
    d = cloud(spark, p).withColumnRenamed("splat_id", "cand_id")
    out, size = spatial.voxel_mean_within(d, 0.01, 50, values=("x", "y", "z"))
    assert out.count() <= 50 and size > 0.01
