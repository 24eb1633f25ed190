"""PLY files as tables: byte ranges, headers alone, pruned columns, parts and their commit."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_splats import some  # noqa: F401

from skyloom.sources import ply, ply_table


def plain_file(path, n, extra=(), comment="color_space linearRGB"):
    kind = np.dtype([("x", "<f4"), ("tag", "u1"), ("y", "<f8"), ("n", "<i2")])
    a = np.zeros(n, kind)
    a["x"], a["tag"], a["y"], a["n"] = np.arange(n), np.arange(n) % 250, np.arange(n) / 7, -np.arange(n) % 30000
    lines = ["ply", "format binary_little_endian 1.0", f"comment {comment}", f"element vertex {n}", "property float x", "property uchar tag", "property double y", "property short n", *extra, "end_header"]
    with open(path, "wb") as f:
        f.write(("\n".join(lines) + "\n").encode() + a.tobytes() + np.arange(12, dtype="<f4").tobytes() * bool(extra))
    return a


@pytest.mark.parametrize("split", [1, 97, 4096, 1 << 20])
def test_ranges_cover_each_record_once(spark, tmp_path, split):
    a = plain_file(tmp_path / "a.ply", 300, ["element extrinsic 12", "property float extrinsic"])
    plain_file(tmp_path / "b.ply", 0)
    plain_file(tmp_path / "c.ply", 1)
    d = ply_table.scan(spark, str(tmp_path), split=split) if split > 1 else ply_table.scan(spark, str(tmp_path / "a.ply"), split=64)
    got = d.where(F.col("path").endswith("a.ply")).orderBy("splat_id").toPandas()
    for c in a.dtype.names:
        assert (got[c].to_numpy() == a[c]).all(), c
    assert got["splat_id"].tolist() == list(range(300))
    assert dict(d.dtypes) == {"path": "string", "splat_id": "bigint", "x": "float", "tag": "smallint", "y": "double", "n": "smallint"}
    if split > 1:
        assert d.count() == 301
        assert ply_table.numbered(d).agg(F.countDistinct("splat_id"), F.max("splat_id")).first() == (301, 300)
    e = ply_table.scan(spark, str(tmp_path / "a.ply"), ["extrinsic", "splat_id"], element="extrinsic", split=50)
    assert [r.extrinsic for r in e.orderBy("splat_id").collect()] == list(range(12))


def test_columns_are_pruned_and_missing_ones_raise(spark, tmp_path):
    plain_file(tmp_path / "a.ply", 10)
    d = ply_table.scan(spark, str(tmp_path / "*.ply"), ["y"])
    assert d.columns == ["y"] and d.agg(F.sum("y")).first()[0] == pytest.approx(45 / 7)
    with pytest.raises(KeyError):
        ply_table.scan(spark, str(tmp_path / "a.ply"), ["z"])
    (tmp_path / "b.ply").write_bytes(ply._head([("vertex", 1, [("x", "float")])], []) + b"\0" * 4)
    with pytest.raises(Exception, match="missing columns"):
        ply_table.scan(spark, str(tmp_path), ["y"]).collect()
    with pytest.raises(FileNotFoundError):
        ply_table.scan(spark, str(tmp_path / "none"), ["x"])
    (tmp_path / "cut.ply").write_bytes((tmp_path / "a.ply").read_bytes()[:-3])
    with pytest.raises(Exception, match="ends after"):
        ply_table.scan(spark, str(tmp_path / "cut.ply")).collect()


def test_file_beyond_2_gb_reads_in_many_tasks(spark, tmp_path):
    """A sparse file of wide records; its header alone gives the count."""
    path, wide, n = str(tmp_path / "large.ply"), 1000, 600_000
    names = ["x", *[f"f_rest_{i}" for i in range(wide - 1)]]
    head = ply._head([("vertex", n, [(c, "float") for c in names])], [])
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(len(head) + 4 * wide * n)
        for row in (0, n // 2, n - 1):
            f.seek(len(head) + 4 * wide * row)
            f.write(np.float32(row + 1).tobytes())
    assert os.path.getsize(path) > 2 << 30
    assert ply.count(spark, path) == n
    d = ply_table.scan(spark, path, ["splat_id", "x"], split=256 << 20)
    assert d.rdd.getNumPartitions() >= 9
    assert [tuple(r) for r in d.where("x > 0").orderBy("splat_id").collect()] == [(r, float(np.float32(r + 1))) for r in (0, n // 2, n - 1)]
    assert d.count() == n


def test_headers(spark, tmp_path):
    plain_file(tmp_path / "a.ply", 5)
    plain_file(tmp_path / "b.ply", 7, comment="color_space  ")
    rows = {os.path.basename(r.path): r for r in ply.inspect(spark, str(tmp_path)).collect()}
    assert rows["a.ply"].color_space == "linearRGB" and rows["b.ply"].color_space is None and not rows["a.ply"].has_core_fields
    assert ply.count(spark, str(tmp_path)) == 12
    assert os.path.getsize(tmp_path / "a.ply") > 0 and rows["b.ply"].fields == ["x", "tag", "y", "n"]
    long = tmp_path / "long.ply"
    long.write_bytes(b"ply\nformat binary_little_endian 1.0\n" + b"".join(b"comment %d\n" % i for i in range(3000)) + b"element vertex 1\nproperty float x\nend_header\n" + b"\0" * 4)
    assert ply.count(spark, str(long)) == 1 and ply_table.scan(spark, str(long)).count() == 1


def test_parts_equal_one_file(spark, some, tmp_path):  # noqa: F811
    one, folder = str(tmp_path / "one.ply"), str(tmp_path / "parts")
    ply.write(some, one)
    ply.write_parts(some.repartition(5), folder)
    a, b = ply.read(spark, one).drop("path"), ply_table.numbered(ply.read(spark, folder)).drop("path")
    order = ["splat_id", *[c for c in a.columns if c != "splat_id"]]
    assert a.select(order).orderBy("splat_id").toPandas().equals(b.select(order).orderBy("splat_id").toPandas())
    assert ply.inspect(spark, folder).select("color_space").distinct().collect() == [("sRGB",)]
    ply.write_parts(some.limit(3), folder)  # overwritten
    assert ply.count(spark, folder) == 3
    ply.write_parts(some.limit(2), folder, mode="append")
    assert ply.count(spark, folder) == 5
    ply.write_parts(some.limit(0), folder)
    assert ply.count(spark, folder) == 0 and ply.read(spark, folder).count() == 0
    assert not glob.glob(f"{folder}/_staging*")


def test_failed_write_leaves_the_target(spark, tmp_path):
    folder = str(tmp_path / "kept")
    ply_table.save(spark.range(4).selectExpr("cast(id as float) as x"), folder)
    bad = spark.range(4).selectExpr("cast(if(id = 3, raise_error('stop'), id) as float) as x")
    with pytest.raises(Exception, match="stop"):
        ply_table.save(bad, folder)
    assert ply_table.scan(spark, folder).agg(F.sum("x")).first()[0] == 6 and not glob.glob(f"{folder}/_staging*")
    with pytest.raises(Exception, match="no PLY type"):
        ply_table.save(spark.range(1), folder)
    nulls = spark.sql("select cast(null as float) as x, cast(3 as short) as s, cast(2 as double) as d")
    ply_table.save(nulls, folder)
    assert [tuple(r) for r in ply_table.scan(spark, folder, ["x", "s", "d"]).collect()] == [(0.0, 3, 2.0)]
