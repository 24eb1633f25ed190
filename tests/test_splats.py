import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.functions import encoding as E
from skyloom.functions import geometry as G
from skyloom.functions import text as T
from skyloom.operators import generators, numeric, poisson, rasters, robust, splats as S, stencils, views
from skyloom.sources import ply
from skyloom.streaming import jobs as J


@pytest.fixture(scope="module")
def some(spark):
    r = np.random.default_rng(0)
    n = 60
    d = pd.DataFrame(r.normal(size=(n, 3)), columns=list("xyz"))
    d.insert(0, "splat_id", range(n))
    for c in ("sx", "sy", "sz"):
        d[c] = r.uniform(0.01, 0.1, n)
    q = r.normal(size=(n, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    d[["qw", "qx", "qy", "qz"]] = q
    for c in "rgb":
        d[c] = r.uniform(size=n)
    d["opacity"] = r.uniform(0.5, 0.99, n)
    return spark.createDataFrame(d)


def test_ply_round_trip(spark, some, tmp_path):
    path = str(tmp_path / "a.ply")
    assert ply.write(some, path) == 60
    i = ply.inspect(spark, path).first()
    assert i.vertices == 60 and i.has_core_fields and i.color_space == "sRGB" and i.fields == ply.STORED
    assert ply.count(spark, path) == 60
    a, b = some.orderBy("splat_id").toPandas(), ply.read(spark, path).orderBy("splat_id").toPandas()
    for c in ("x", "sx", "qw", "r", "opacity"):
        assert np.allclose(a[c], b[c], atol=1e-5)
    with pytest.raises(ValueError):
        ply.write(some.limit(0), path)


def test_reorienting_twice_negates_the_quaternion(some):
    a, b = some.orderBy("splat_id").toPandas(), S.reorient(S.reorient(some)).orderBy("splat_id").toPandas()
    assert np.allclose(a[list("xyz")], b[list("xyz")]) and np.allclose(a[["qw", "qx"]], -b[["qw", "qx"]])


def test_unit_reorientation(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3.0, 1.0, 0.0, 0.0, 0.0)], "x double, y double, z double, qw double, qx double, qy double, qz double")
    r = S.reorient(d).first()
    assert (r.x, r.y, r.z) == (1, -2, -3) and (abs(r.qw), r.qx, abs(r.qy), r.qz) == (0, 1, 0, 0)


def test_decomposition_restores_the_covariance(some):
    from skyloom.plans.scene import with_covariance

    c = with_covariance(some)
    a, b = c.orderBy("splat_id").toPandas(), numeric.decompose(c.select("splat_id", "cxx", "cxy", "cxz", "cyy", "cyz", "czz")).orderBy("splat_id").toPandas()
    m = b[[f"r{i}{j}" for i in range(3) for j in range(3)]].to_numpy().reshape(-1, 3, 3)
    s = b[["s1", "s2", "s3"]].to_numpy()
    back = np.einsum("nij,nj,nkj->nik", m, s**2, m)
    assert np.allclose(back[:, 0, 1], a["cxy"]) and np.allclose(np.linalg.det(m), 1)


def test_grid_directions(spark):
    d = spark.createDataFrame([(90.0, 180.0), (0.0, 180.0), (180.0, 90.0)], "v double, u double")
    g = generators.with_grid(d, F.col("v"), F.col("u"), F.lit(180.0), F.lit(360.0)).toPandas()
    assert np.allclose(g[["rx", "ry", "rz"]].to_numpy()[0], [-1, 0, 0], atol=1e-9)
    assert np.allclose(g["ry"][1], 1) and np.allclose(g["ry"][2], -1)
    a, b, r = (g[[f"{k}{x}" for x in "xyz"]].to_numpy() for k in "abr")
    assert np.allclose((a * b).sum(1), 0) and np.allclose((a * r).sum(1), 0) and np.allclose(np.linalg.norm(a, axis=1), 1)


def test_outlier_is_pruned(spark):
    p = np.random.default_rng(2).uniform(0, 0.1, (60, 3))
    p[0] = 100
    d = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "splat_id long, x double, y double, z double").withColumn("opacity_logit", F.lit(5.0))
    kept = {r.splat_id for r in S.denoise(d, k=8).collect()}
    assert 0 not in kept and len(kept) >= 55
    assert S.prune_outliers(d.limit(5)).count() == 5


@pytest.mark.parametrize("shift,outliers", [(0.3, 0.0), (0.1, 0.2)])
def test_irls_recovers_scale_and_shift(spark, shift, outliers):
    r = np.random.default_rng(42)
    x = r.uniform(0.5, 10, 1000)
    y = 2.5 * x + shift
    y[: int(1000 * outliers)] += r.uniform(5, 20, int(1000 * outliers))
    d = spark.createDataFrame(pd.DataFrame({"k": 0, "x": x, "y": y}))
    f = robust.irls(d, "x", "y", ["k"]).first()
    assert abs(f.scale / 2.5 - 1) < 0.02 and f.converged == (outliers == 0)


def test_stencils_equal_numpy(spark):
    a = np.random.default_rng(1).uniform(1, 9, (7, 9))
    d = spark.createDataFrame([(v, u, float(a[v, u])) for v in range(7) for u in range(9)], "v int, u int, depth double")
    back = lambda df, c: df.toPandas().pivot(index="v", columns="u", values=c).to_numpy()
    g = d.withColumns({"gu": stencils.central_difference(F.col("depth"), "u", "one_sided"), "wu": stencils.central_difference(F.col("depth"), "u")})
    assert np.allclose(back(g, "gu"), np.gradient(a, axis=1))
    assert np.allclose(back(g, "wu"), (np.roll(a, -1, 1) - np.roll(a, 1, 1)) / 2)
    assert np.allclose(back(stencils.integral(d, "depth", "s"), "s"), a.cumsum(0).cumsum(1))
    assert back(stencils.erode(d.withColumn("m", F.lit(True)), "m", "e"), "e").sum() == 5 * 7


def test_uniform_panorama_gives_uniform_views(spark):
    d = spark.range(32 * 64).select((F.col("id") / 64).cast("int").alias("v"), (F.col("id") % 64).cast("int").alias("u"), F.lit(7.0).alias("depth"))
    v = spark.createDataFrame([(0, 30.0, 0.0), (1, 0.0, 90.0)], "view_id int, yaw_deg double, pitch_deg double")
    out = rasters.perspective_view(v, d, "depth", 8, 90.0, 64, 32).toPandas()
    assert len(out) == 128 and np.allclose(out["depth"], 7)


def test_edges_of_directions_and_scale_strings(spark):
    d = spark.createDataFrame([(a,) for a in (0.0, 45.0, 134.9, 135.0, 225.0, 314.9, 315.0, 360.0)], "a double")
    assert [r[0] for r in d.select(T.direction(F.col("a"))).collect()] == ["forward", "right", "right", "backward", "left", "left", "forward", "forward"]
    s = spark.createDataFrame([("none",), ("manual:2.5",), ("reprojection",)], "s string")
    got = [r[0] for r in s.select(T.scale_setting(F.col("s"))).collect()]
    assert got[0] is None and got[1] == 2.5 and math.isnan(got[2])
    with pytest.raises(Exception, match="unknown scale"):
        spark.createDataFrame([("auto",)], "s string").select(T.scale_setting(F.col("s"))).collect()


def test_gap_report_without_views_is_closed(spark):
    m = spark.createDataFrame([], "cam_id int, azimuth double, hole double")
    r = views.gap_report(spark, m).first()
    assert r.average == 0 and r.converged and r.recommended == [] and r.worst == "forward"
    assert views.coverage(m).first()[0] == 1


def test_round_trips_of_encodings(some):
    x = some.select(F.max(F.abs(E.to_linear(E.to_srgb(F.col("r"))) - F.col("r"))), F.max(F.abs(E.sigmoid(E.logit(F.col("opacity"))) - F.col("opacity"))), F.max(F.abs(E.inverse_softplus(E.softplus(F.col("x"))) - F.col("x")))).first()
    assert max(x) < 1e-6


def test_bad_preset(spark):
    with pytest.raises(ValueError):
        generators.trajectories(spark, ("sideways",))


def test_focal_and_look_at(spark):
    z = F.lit(0.0)
    rows, t = G.look_at((z, z, F.lit(-5.0)), (z, z, z))
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate((*rows, *t))], G.focal(512.0, 90.0).alias("f")).first()
    assert np.allclose(list(r)[6:9], [0, 0, 1]) and np.allclose(list(r)[9:12], [0, 0, 5]) and abs(r.f - 256) < 1e-9


def test_poisson_fill_is_harmonic(spark):
    d = pd.DataFrame([(0, v, u, float(u), 0 if 2 <= u <= 6 and 2 <= v <= 6 else 1) for v in range(9) for u in range(9)], columns=["k", "v", "u", "x", "known"])
    out = poisson.fill(spark.createDataFrame(d), "k", "x", "known").toPandas()
    assert np.allclose(out["value"], out["u"], atol=1e-6)


def test_progress_stream(spark, tmp_path):
    (tmp_path / "log.txt").write_text("start\nstep 3/10\nstep 4/10\n")
    q = J.progress_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("progress").start()
    q.processAllAvailable()
    q.stop()
    assert {r.done for r in spark.table("progress").collect()} == {3, 4}
