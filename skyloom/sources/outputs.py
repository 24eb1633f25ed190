"""Files of results: depth rasters, previews, point clouds, diagnostics. The driver writes each as its parts come in, one partition at a time."""

from __future__ import annotations

import io
import json
import math
import struct
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators.quantiles import quantiles
from skyloom.sources.ply import blocks


def lines(raster: DataFrame, value: str) -> tuple[int, int, Iterator[np.ndarray]]:
    """(height, width, rows from the top) of a raster (v, u, value); cells that are missing are NaN.

    Rows are gathered on the executors and come to the driver one partition of them at a time.
    """
    h, w = raster.agg(F.coalesce(F.max("v") + 1, F.lit(0)), F.coalesce(F.max("u") + 1, F.lit(0))).first()
    cells = raster.groupBy("v").agg(F.collect_list(F.struct("u", F.col(value).cast("double").alias("x"))).alias("cells"))

    def run() -> Iterator[np.ndarray]:
        at = 0
        for r in cells.repartitionByRange("v").sortWithinPartitions("v").toLocalIterator():
            for _ in range(at, r.v):
                yield np.full(w, np.nan)
            line = np.full(w, np.nan)
            line[[c.u for c in r.cells]] = [np.nan if c.x is None else c.x for c in r.cells]
            yield line
            at = r.v + 1

    return h, w, run()


def write_npy(raster: DataFrame, value: str, path: str) -> tuple[int, int]:
    """The raster as 32-bit floats; gives (height, width)."""
    h, w, rows = lines(raster, value)
    with open(path, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (h, w)})
        for row in rows:
            f.write(row.astype("<f4").tobytes())
    return h, w


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(file: BinaryIO, height: int, width: int, rows: Iterable[np.ndarray]) -> None:
    """An 8-bit grey PNG image, row by row."""
    file.write(b"\x89PNG\r\n\x1a\n" + png_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)))
    packer, held = zlib.compressobj(), b""
    for row in rows:
        held += packer.compress(b"\0" + row.astype(np.uint8).tobytes())
        if len(held) > 1 << 16:
            file.write(png_chunk(b"IDAT", held))
            held = b""
    file.write(png_chunk(b"IDAT", held + packer.flush()) + png_chunk(b"IEND", b""))


def png(grey: np.ndarray) -> bytes:
    """An 8-bit grey PNG image of an array."""
    out = io.BytesIO()
    write_png(out, *grey.shape, grey)
    return out.getvalue()


def write_preview(raster: DataFrame, value: str, path: str) -> None:
    """Grey shades of log(1 + value) between its percentiles 1 and 99."""
    d = raster.select("v", "u", F.log1p(value).alias("shade"))
    low, high = quantiles(d, "shade", [0.01, 0.99]).first()["p"]
    h, w, rows = lines(d, "shade")
    with open(path, "wb") as f:
        write_png(f, h, w, (np.floor(np.clip(np.nan_to_num((row - low) / max(high - low, 1e-12)), 0, 1) * 255) for row in rows))


def write_glb(points: DataFrame, path: str, up: str = "y") -> int:
    """A point cloud (x, y, z, r, g, b in [0, 1]) as binary glTF 2.0; gives the number of points. With ``up`` "z" axes are turned."""
    colour = {c: F.floor(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * 255).cast("int") for c in "rgb"}
    d = points.select("x", "y", "z", "r", "g", "b").withColumns(colour | {"a": F.lit(255)})
    d = d.select("*", F.col("z").alias("y_"), (-F.col("y")).alias("z_")) if up == "z" else d.withColumns({"y_": F.col("y"), "z_": F.col("z")})
    axes, every = ["x", "y_", "z_"], ["x", "y", "z", "r", "g", "b"]
    sums = d.agg(F.count("*").alias("n"), *[f(F.col(c).cast("float")).alias(f"{name}{c}") for f, name in ((F.min, "low"), (F.max, "high")) for c in axes]).first()
    n = sums["n"]
    if not n:
        raise ValueError("no points to write")
    sizes = [12 * n, 4 * n]
    scene = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "COLOR_0": 1}, "mode": 0}]}],
        "buffers": [{"byteLength": sum(sizes)}], "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": sizes[0]}, {"buffer": 0, "byteOffset": sizes[0], "byteLength": sizes[1]}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": n, "type": "VEC3", "min": [sums[f"low{c}"] for c in axes], "max": [sums[f"high{c}"] for c in axes]}, {"bufferView": 1, "componentType": 5121, "normalized": True, "count": n, "type": "VEC4"}],
    }
    text = json.dumps(scene).encode()
    text += b" " * (-len(text) % 4)
    with open(path, "wb") as f:
        f.write(struct.pack("<III", 0x46546C67, 2, 28 + len(text) + sum(sizes)) + struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", sum(sizes), 0x004E4942))
        for columns, kind in ((axes, "<f4"), (["r", "g", "b", "a"], "u1")):
            for block in blocks(d, columns, every, kind):
                f.write(block)
    return n


def write_diagnostics(path: str, parts: dict[str, DataFrame | object]) -> dict:
    """A JSON file: tables as lists of rows (bounded ones: a row for each frame or view), other values as they are; NaN as null."""
    plain = lambda x: None if isinstance(x, float) and not math.isfinite(x) else x
    rows = lambda d: [{k: plain(v) for k, v in r.asDict().items()} for r in d.orderBy(*d.columns).collect()]
    out = {k: rows(v) if isinstance(v, DataFrame) else v for k, v in parts.items()}
    Path(path).write_text(json.dumps(out, indent=2, sort_keys=True, default=str))
    return out
