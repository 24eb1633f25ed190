"""Sources and seams that no query reads: depth arrays, folders of files, converted splats, models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions.text import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from skyloom.operators import models
from skyloom.sources import images, ply, ply_table
from tests.test_splats import some  # noqa: F401  a fixture


def test_depth_arrays(spark, tmp_path):
    a = {n: np.random.default_rng(k).uniform(size=(3 + k, 5)).astype(np.float32) for k, n in enumerate("ab")}
    for n, x in a.items():
        np.save(tmp_path / f"{n}.npy", x)
    got = images.npy_rasters(spark, str(tmp_path)).toPandas()
    assert len(got) == 15 + 20
    for n, x in a.items():
        own = got[got["path"].str.endswith(f"{n}.npy")]
        assert (own["value"].to_numpy() == x[own["v"], own["u"]].astype(float)).all() and len(own) == x.size


def test_files_below_a_folder(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name in ("b.PLY", "a.mp4", "deep/c.ply", "deep/er/d.jpg", "deep/er/ply", "e.plyx"):
        (tmp_path / name).write_bytes(b"x" * len(name))
    found = lambda ext: [(r.path.split(f"{tmp_path.name}/")[1], r.length) for r in images.find_files(spark, str(tmp_path), ext).collect()]
    assert found((".ply",)) == [("b.PLY", 5), ("deep/c.ply", 10)]
    assert found(VIDEO_EXTENSIONS) == [("a.mp4", 5)] and found(IMAGE_EXTENSIONS) == [("deep/er/d.jpg", 13)]


def test_convert(spark, some, tmp_path):  # noqa: F811
    source, plain, turned = (str(tmp_path / f"{n}.ply") for n in ("source", "plain", "turned"))
    ply.write(some, source)
    assert ply.convert(spark, source, plain, reorient=False) == ply.convert(spark, source, turned) == 60
    a, b, c = (ply_table.scan(spark, p, ["splat_id", *ply.CORE]).orderBy("splat_id").toPandas() for p in (source, plain, turned))
    assert a.equals(b)
    assert np.allclose(c["x"], a["x"]) and np.allclose(c["y"], -a["y"]) and np.allclose(c["z"], -a["z"]) and np.allclose(c["opacity"], a["opacity"])
    kept = ply.convert(spark, source, plain, denoise=True)
    assert 0 < kept <= 60


def pixels(spark):
    rows = [(o, v, u, v / 4, u / 4, 0.5, 100.0 + k) for k, o in enumerate("ab") for v in range(2 + k) for u in range(3)]
    return spark.createDataFrame(rows, "origin string, v int, u int, r double, g double, b double, focal_px double")


def test_depth_model(spark):
    out = models.predict_depth(pixels(spark), lambda image: (image.sum(2) * 10, image[..., 0] > 0.2))
    got = {(r.origin, r.v, r.u): (r.depth, r["mask"]) for r in out.collect()}
    assert got == {(o, v, u): (pytest.approx(10 * (v / 4 + u / 4 + 0.5)), v / 4 > 0.2) for k, o in enumerate("ab") for v in range(2 + k) for u in range(3)}
    assert all(r["mask"] for r in models.predict_depth(pixels(spark), lambda image: (image[..., 0], None)).collect())


def test_splat_model(spark):
    def predict(image, focal):
        n = image.shape[0] - 2  # nothing for the first image
        return {c: np.full(n, k + focal) for k, c in enumerate(models.SPLAT_COLUMNS)}

    rows = models.predict_splats(pixels(spark), predict).collect()
    assert [(r.origin, r.splat_id, r.x, r.opacity) for r in rows] == [("b", 0, 101.0, 114.0)]
    with pytest.raises(Exception, match="gives no"):
        models.predict_splats(pixels(spark), lambda image, focal: {"x": np.zeros(1)}).collect()
    assert models.predict_splats(pixels(spark).where(F.lit(False)), predict).count() == 0
