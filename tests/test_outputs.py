import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import text as T
from skyloom.operators import cameras, poisson, pyramids, splats as S, views
from skyloom.sources import images, outputs, ply
from tests.test_splats import some  # noqa: F401  a fixture


def test_harmonics_and_order_in_ply(spark, some, tmp_path):  # noqa: F811
    path = str(tmp_path / "a.ply")
    assert ply.write(some.withColumn("f_rest_0", F.col("x")).withColumn("f_rest_8", F.lit(0.5)), path, sh_degree=3) == 60
    i = ply.inspect(spark, path).first()
    assert i.fields == [*ply.STORED[:9], *[f"f_rest_{k}" for k in range(45)], *ply.STORED[9:]] and i.has_core_fields
    v = ply.elements_of(open(path, "rb").read())["vertex"]
    x = some.orderBy("splat_id").toPandas()["x"]
    assert np.allclose(v["x"], x, atol=1e-6) and np.allclose(v["f_rest_0"], x, atol=1e-6) and (v["f_rest_8"] == 0.5).all() and not v["f_rest_44"].any()


def test_camera_supplement(spark, some, tmp_path):  # noqa: F811
    path = str(tmp_path / "a.ply")
    front = some.withColumn("z", F.abs("z") + 1)
    assert ply.write_with_camera(front, path, 500.0, 480, 640) == 60
    data = open(path, "rb").read()
    found = ply.elements_of(data)
    assert list(found) == ["vertex", *ply.SUPPLEMENT] and found["frame"]["frame"].tolist() == [1, 60] and found["version"]["version"].tolist() == [1, 5, 0]
    z = front.toPandas()["z"]
    assert np.allclose(found["disparity"]["disparity"], np.quantile(1 / z, [0.1, 0.9]), atol=1e-6)
    c = ply.read_camera(data)
    assert (c["width"], c["height"], c["color_space"]) == (640, 480, "sRGB") and np.allclose(c["intrinsic"], [[500, 0, 320], [0, 500, 240], [0, 0, 1]]) and (c["extrinsic"] == np.eye(4)).all()
    linear = ply.read(spark, path).orderBy("splat_id").toPandas()["r"].to_numpy()
    r = front.orderBy("splat_id").toPandas()["r"].to_numpy()
    assert np.allclose(linear, np.where(r <= 0.0031308, 12.92 * r, 1.055 * r ** (1 / 2.4) - 0.055), atol=1e-4)


def test_short_camera_forms():
    head = ply._head([("vertex", 0, [("x", "float")]), ("extrinsic", 12, [("extrinsic", "float")]), ("intrinsic", 4, [("intrinsic", "float")])], [])
    c = ply.read_camera(head + np.arange(12, dtype="<f4").tobytes() + np.array([500, 400, 640, 480], "<f4").tobytes())
    assert c["extrinsic"][2].tolist() == [8, 9, 10, 11] and c["extrinsic"][3].tolist() == [0, 0, 0, 1]
    assert (c["width"], c["height"]) == (640, 480) and c["intrinsic"].tolist() == [[500, 0, 320], [0, 400, 240], [0, 0, 1]]


def test_copy_is_byte_identical(some, tmp_path):  # noqa: F811
    a, b = str(tmp_path / "a.ply"), str(tmp_path / "b.ply")
    ply.write(some, a)
    ply.copy(a, b)
    assert open(a, "rb").read() == open(b, "rb").read()
    bad = tmp_path / "c.ply"
    bad.write_bytes(ply._head([("vertex", 0, [("x", "float")])], []))
    with pytest.raises(KeyError):
        ply.copy(str(bad), b)


def test_colmap_scene(spark, some, tmp_path):  # noqa: F811
    rig = spark.createDataFrame([(k, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, float(k), 0.0, 0.0) for k in range(3)], "cam_id int, r00 double, r01 double, r02 double, r10 double, r11 double, r12 double, r20 double, r21 double, r22 double, tx double, ty double, tz double")
    assert ply.scene_to_colmap(some, rig, str(tmp_path), 512, 90.0, 10) == 3
    c = (tmp_path / "cameras.bin").read_bytes()
    assert struct.unpack("<QiiQQ8d", c) == (1, 1, 4, 512, 512, 256.0, 256.0, 256.0, 256.0, 0.0, 0.0, 0.0, 0.0) or np.allclose(struct.unpack("<8d", c[32:])[:2], 256)
    i = (tmp_path / "images.bin").read_bytes()
    assert struct.unpack("<Q", i[:8]) == (3,) and struct.unpack("<i7di", i[8:72]) == (1, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1) and i[72:88] == b"frame_00000.png\0"
    p = (tmp_path / "points3D.bin").read_bytes()
    assert len(p) == 8 + 10 * 51 and struct.unpack("<d", p[8 + 35 : 8 + 43]) == (1.0,)


def test_raster_files(spark, tmp_path):
    d = spark.createDataFrame([(v, u, float(v * 4 + u)) for v in range(3) for u in range(4)], "v int, u int, depth double")
    assert outputs.write_npy(d, "depth", str(tmp_path / "a.npy")) == (3, 4)
    assert (np.load(tmp_path / "a.npy") == np.arange(12).reshape(3, 4)).all()
    outputs.write_preview(d, "depth", str(tmp_path / "a.png"))
    png = (tmp_path / "a.png").read_bytes()
    at = png.index(b"IDAT")
    rows = np.frombuffer(zlib.decompress(png[at + 4 : at + 4 + struct.unpack(">I", png[at - 4 : at])[0]]), np.uint8).reshape(3, 5)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", png[16:24]) == (4, 3) and rows[0, 1] == 0 and rows[2, 4] == 255


def test_glb(some, tmp_path):  # noqa: F811
    path = tmp_path / "a.glb"
    assert outputs.write_glb(some, str(path)) == 60
    data = path.read_bytes()
    magic, version, size, n, kind = struct.unpack("<IIIII", data[:20])
    scene = json.loads(data[20 : 20 + n])
    assert (magic, version, size, kind) == (0x46546C67, 2, len(data), 0x4E4F534A) and scene["accessors"][0]["count"] == 60 and size == 28 + n + 60 * 16
    at = np.frombuffer(data, "<f4", 180, 28 + n).reshape(60, 3)
    colours = np.frombuffer(data, np.uint8, 240, 28 + n + 720).reshape(60, 4)
    rows = some.orderBy("x", "y", "z").toPandas()
    assert np.allclose(at, rows[["x", "y", "z"]]) and (colours[:, 3] == 255).all()
    assert (colours[:, :3] == np.floor(rows[["r", "g", "b"]].clip(0, 1) * 255).to_numpy()).all()
    assert np.allclose(scene["accessors"][0]["min"], at.min(0)) and np.allclose(scene["accessors"][0]["max"], at.max(0))
    outputs.write_glb(some, str(path), up="z")
    turned = np.frombuffer(path.read_bytes()[-60 * 16 :], "<f4", 180).reshape(60, 3)
    assert np.allclose(turned, np.stack([at[:, 0], at[:, 2], -at[:, 1]], 1))
    with pytest.raises(ValueError):
        outputs.write_glb(some.limit(0), str(path))


def test_raster_files_with_gaps(spark, tmp_path):
    """Missing cells and whole missing rows; rows come in order however they were dealt."""
    d = spark.createDataFrame([(v, u, float(100 * v + u)) for v in range(300) for u in range(5) if v != 7 and (v, u) != (9, 2)], "v int, u int, x double").repartition(7)
    assert outputs.write_npy(d, "x", str(tmp_path / "a.npy")) == (300, 5)
    want = np.arange(300)[:, None] * 100.0 + np.arange(5)
    want[7], want[9, 2] = np.nan, np.nan
    assert np.array_equal(np.load(tmp_path / "a.npy"), want.astype(np.float32), equal_nan=True)
    assert outputs.write_npy(d.where("false"), "x", str(tmp_path / "b.npy")) == (0, 0) and np.load(tmp_path / "b.npy").shape == (0, 0)


def test_sky_modes(spark, some):  # noqa: F811
    sky = spark.createDataFrame([(0, 0, -1, 0.1, 0.2, 0.3)], "v int, u int, splat_id long, r double, g double, b double")
    h, w = F.lit(4.0), F.lit(8.0)
    assert S.with_sky(some, sky, h, w, "skip").count() == 60
    extra = some.withColumn("tag", F.lit("t")).drop("b")
    made = S.with_sky(extra, sky, h, w, "low_opacity").where("splat_id = -1").first()
    assert made.tag is None and "b" not in made and (made.y, made.opacity, made.r) == (150.0, 0.15, 0.1)
    with pytest.raises(ValueError):
        S.with_sky(some, sky, h, w, "blue")


def test_scales():
    with pytest.raises(ValueError):
        views.at_scales(None, 2.0, 1.0, 3)


def test_diagnostics(spark, tmp_path):
    d = spark.createDataFrame([(2, float("nan")), (1, 0.5)], "frame int, loss double")
    outputs.write_diagnostics(str(tmp_path / "a.json"), {"frames": d, "rounds": 3})
    assert json.loads((tmp_path / "a.json").read_text()) == {"frames": [{"frame": 1, "loss": 0.5}, {"frame": 2, "loss": None}], "rounds": 3}


def test_cube_keeps_a_smooth_panorama(spark):
    w, h = 96, 48
    smooth = lambda u, v: 10 + np.sin((v + 0.5) / h * np.pi) * np.cos((u + 0.5) / w * 2 * np.pi) + 0.5 * np.cos((v + 0.5) / h * np.pi)
    d = spark.createDataFrame([(v, u, float(smooth(u, v))) for v in range(h) for u in range(w)], "v int, u int, depth double")
    size = F.lit(float(w)), F.lit(float(h))
    faces = cameras.to_cube(spark, d, "depth", 48, *size)
    back = cameras.from_cube(faces, d.select("v", "u"), "depth", 48, *size).toPandas()
    assert len(back) == w * h and np.abs(back.depth - smooth(back.u, back.v)).max() < 0.02


def test_radial_depth_is_an_error(spark):
    d = spark.createDataFrame([(1, 5.0, 2.0), (1, float("nan"), 2.0)], "f int, a double, b double")
    assert S.assert_z_depth(d, "b", "b", ["f"]).first().ratio < 1.5
    with pytest.raises(Exception, match="radial"):
        S.assert_z_depth(d, "a", "b", ["f"]).collect()


def test_options_overlay():
    assert T.overlaid({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}}, {"d": None, "e": {"f": 1}}) == {"a": {"b": 5, "c": 2}, "e": {"f": 1}}


def test_solvers_equal_plain_numpy(spark):
    r = np.random.default_rng(2)
    a, known = r.uniform(1, 5, (8, 9)), r.uniform(size=(8, 9)) < 0.5
    d = spark.createDataFrame([(0, v, u, float(a[v, u]), int(known[v, u]), float(a[v, u] + 1)) for v in range(8) for u in range(9)], "id int, v int, u int, x double, k int, y double")
    got = poisson.fill(d, "id", "x", "k").toPandas().pivot(index="v", columns="u", values="value").to_numpy()
    want = np.where(known, a, 0.0)  # Gauss-Seidel on the same equations
    for _ in range(4000):
        p = np.pad(want, 1, mode="edge")
        mean = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4
        want = np.where(known, a, mean)
    assert np.allclose(got, want, atol=1e-6)
    fused = pyramids.laplacian_fusion(d, "id", "x", "y", 2, 1).toPandas().pivot(index="v", columns="u", values="value").to_numpy()
    assert np.allclose(fused, a + 1)  # details of x on the level of y = x + 1


def tagged(grey, orientation, focal=None, film=None):
    """A grey PNG with an EXIF block."""
    own = [(0x920A, 5, focal)] * (focal is not None) + [(0xA405, 3, film)] * (film is not None)
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 0x0112, 3, 1, orientation, 0) + struct.pack("<HHII", 0x8769, 4, 1, 38) + struct.pack("<I", 0)
    entries, extra, at = b"", b"", 38 + 2 + 12 * len(own) + 4
    for tag, kind, value in own:
        entries += struct.pack("<HHI", tag, kind, 1) + (struct.pack("<I", at) if kind == 5 else struct.pack("<HH", value, 0))
        extra += struct.pack("<II", int(value * 100), 100) if kind == 5 else b""
    block = head + struct.pack("<H", len(own)) + entries + struct.pack("<I", 0) + extra
    data = outputs.png(grey)
    chunk = struct.pack(">I", len(block)) + b"eXIf" + block + struct.pack(">I", zlib.crc32(b"eXIf" + block))
    return data[:33] + chunk + data[33:]


def test_photographs(spark, tmp_path):
    grey = np.arange(8, dtype=np.uint8).reshape(2, 4) * 20
    for name, data in {"plain": outputs.png(grey), "turned": tagged(grey, 6, focal=4.0), "mirror": tagged(grey, 2, film=28), "broken": b"no image"}.items():
        (tmp_path / f"{name}.png").write_bytes(data)
    got = {r.origin.rsplit("/", 1)[1][:-4]: r for r in images.photographs(spark, str(tmp_path)).collect()}
    assert got["broken"].error and got["broken"].data is None and len(got) == 4
    shown = {k: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)[..., 0] for k, r in got.items() if r.data}
    assert (shown["plain"] == grey).all() and (shown["turned"] == np.rot90(grey, -1)).all() and (shown["mirror"] == grey[:, ::-1]).all()
    assert [got[k].focal_mm for k in ("plain", "turned", "mirror")] == [30.0, 4.0 * 8.4, 28.0]
    assert abs(got["plain"].focal_px - 30 * np.hypot(4, 2) / np.hypot(36, 24)) < 1e-9
    errors = {r.origin.rsplit("/", 1)[1][:-4]: r.error for r in images.panoramas(spark, str(tmp_path)).collect()}
    assert errors["plain"] is None and "panorama" in errors["turned"] and errors["broken"] == "cannot be decoded"
    assert images.pixels(images.panoramas(spark, str(tmp_path))).where("r > 0").count() == 14
    assert images.exif(b"\xff\xd8\xff") == {} == images.exif(b"")
