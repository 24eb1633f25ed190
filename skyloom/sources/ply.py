"""PLY and COLMAP files: tables in and out.

Binary little-endian PLY files are read in byte ranges (see ``ply_table``), one row per vertex; columns are found by
name. Here are the formats and the writers of one file, whose records are packed on the executors; a folder of parts is
written by the tasks themselves.
"""

from __future__ import annotations

import re
import shutil
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: property types, and the columns of a splat file in file order.
TYPES = {"char": "<i1", "int8": "<i1", "uchar": "<u1", "uint8": "<u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
STORED = ["x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
CORE = [c for c in STORED if c not in ("nx", "ny", "nz")]
FIELDS = {"x": "x", "y": "y", "z": "z", "r": "f_dc_0", "g": "f_dc_1", "b": "f_dc_2", "opacity": "opacity", "sx": "scale_0", "sy": "scale_1", "sz": "scale_2", "qw": "rot_0", "qx": "rot_1", "qy": "rot_2", "qz": "rot_3"}


def header(data: bytes) -> tuple[list[tuple[str, int, np.dtype]], list[str], int]:
    """(elements with count and record type, comments, length of the header)."""
    m = re.match(rb"ply\r?\n(?:.*\r?\n)*?end_header\r?\n", data)
    if not m:
        raise ValueError("not a PLY file")
    elements: list[tuple[str, int, list]] = []
    comments = []
    for line in m[0].decode("ascii", "replace").splitlines():
        words = line.split()
        if not words:
            continue
        if words[0] == "format" and words[1] != "binary_little_endian":
            raise ValueError(f"unsupported PLY format {words[1]}")
        if words[0] == "comment":
            comments.append(line.partition(" ")[2])
        elif words[0] == "element":
            elements.append((words[1], int(words[2]), []))
        elif words[0] == "property":
            if words[1] == "list":
                raise ValueError("list properties are not supported")
            elements[-1][2].append((words[2], TYPES[words[1]]))
    return [(n, k, np.dtype(t)) for n, k, t in elements], comments, m.end()


def color_space(comments: list[str]) -> str | None:
    """The value of a two-word ``color_space X`` comment."""
    return next((w[1] for c in comments if len(w := c.split()) == 2 and w[0] == "color_space"), None)


def elements_of(data: bytes) -> dict[str, np.ndarray]:
    found, _, at = header(data)
    out = {}
    for name, n, kind in found:
        out[name] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return out


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(path, vertices, fields, elements, has_core_fields, color_space) of each file; only headers are read."""
    from skyloom.sources.ply_table import heads

    core = F.size(F.array_intersect("fields", F.lit(CORE))) == len(CORE)
    words = F.transform("comments", lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "))
    space = F.filter(words, lambda w: (F.size(w) == 2) & (w[0] == "color_space"))
    return heads(spark, path).select("path", "vertices", "fields", "elements", core.alias("has_core_fields"), F.try_element_at(space, F.lit(1))[1].alias("color_space"))


def read_stored(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """Splat files as they are stored: path, splat_id (place in the file) and the core columns; KeyError without one."""
    from skyloom.sources.ply_table import SPLIT, scan

    d = scan(spark, path, ["path", "splat_id", *CORE], split=split or SPLIT)
    return d.select("path", "splat_id", *[F.col(c).cast("double").alias(c) for c in CORE])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Splat files decoded: natural scales, opacity and colours."""
    from skyloom.operators.splats import decoded

    d = read_stored(spark, path)
    return decoded(d.select("path", "splat_id", *[F.col(stored).alias(c) for c, stored in FIELDS.items()]))


def count(spark: SparkSession, path: str) -> int:
    """Vertices of all files by their headers."""
    return int(inspect(spark, path).agg(F.coalesce(F.sum("vertices"), F.lit(0))).first()[0])


def rest_fields(degree: int) -> list[str]:
    """Columns of the spherical-harmonic bands above the first."""
    return [f"f_rest_{i}" for i in range(3 * (degree + 1) ** 2 - 3)]


def blocks(stored: DataFrame, columns: list[str], order: str | list[str] = "splat_id", kind: str = "<f4") -> Iterator[bytes]:
    """The records of a table in order, packed on the executors; the driver sees one partition's bytes at a time."""
    kind = np.dtype([(c, kind) for c in columns])
    names = [c for c in columns if c in stored.columns]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for b in batches:
            a = np.zeros(len(b), kind)
            for c in names:
                a[c] = b[c].to_numpy(np.float64, na_value=0.0)
            out.append(a.tobytes())
        yield pd.DataFrame({"block": [b"".join(out)]})

    order = [order] if isinstance(order, str) else order
    d = stored.repartitionByRange(*order).sortWithinPartitions(*order).select(*names)
    for row in d.mapInPandas(pack, "block binary").toLocalIterator():
        yield bytes(row["block"])


def _head(elements: list[tuple[str, int, list[tuple[str, str]]]], comments: list[str]) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0", *[f"comment {c}" for c in comments]]
    for name, n, fields in elements:
        lines += [f"element {name} {n}", *[f"property {kind} {c}" for c, kind in fields]]
    return ("\n".join([*lines, "end_header"]) + "\n").encode()


def _stored(splats: DataFrame) -> DataFrame:
    return splats.select("splat_id", *[F.col(c).alias(stored) for c, stored in FIELDS.items()], *[c for c in splats.columns if c.startswith("f_rest_")])


def write(splats: DataFrame, path: str, color: str | None = "sRGB", encode: bool = True, sh_degree: int = 0) -> int:
    """One binary PLY file of a splat table in the order of splat_id; ValueError without rows.

    From ``sh_degree`` 1 on the file has the columns f_rest_*, those that the table lacks as zeros; nulls are zeros.
    """
    from skyloom.operators.splats import encoded

    n = splats.count()
    if not n:
        raise ValueError("no splats to write")
    columns = [*STORED[:9], *rest_fields(sh_degree), *STORED[9:]]
    with open(path, "wb") as f:
        f.write(_head([("vertex", n, [(c, "float") for c in columns])], [f"color_space {color}"] if color else []))
        for block in blocks(_stored(encoded(splats) if encode else splats), columns):
            f.write(block)
    return n


def write_parts(splats: DataFrame, folder: str, color: str | None = "sRGB", encode: bool = True, sh_degree: int = 0, mode: str = "overwrite") -> None:
    """A folder of PLY files in the order of splat_id, each written whole by its task; nothing passes through the driver.

    Columns and nulls are as in ``write``. Lost tasks are written again; files count once all tasks are done.
    """
    from skyloom.operators.splats import encoded
    from skyloom.sources.ply_table import ordered, save

    d = _stored(encoded(splats) if encode else splats)
    columns = [*STORED[:9], *rest_fields(sh_degree), *STORED[9:]]
    stored = d.select("splat_id", *[(F.col(c) if c in d.columns else F.lit(0.0)).cast("float").alias(c) for c in columns])
    save(ordered(stored), folder, mode, **({"color_space": color} if color else {}))


#: Fixed values of the format: the supplement's elements with their types, and codes of colour spaces.
SUPPLEMENT = {"extrinsic": "float", "intrinsic": "float", "image_size": "uint", "frame": "int", "disparity": "float", "color_space": "uchar", "version": "uchar"}
COLOR_SPACES = {"sRGB": 0, "linearRGB": 1}


def write_with_camera(splats: DataFrame, path: str, focal: float | tuple[float, float], height: int, width: int) -> int:
    """A PLY file with the camera that predicted the splats: linear colours are stored as sRGB, and the elements of
    SUPPLEMENT follow the vertices (extrinsic 4x4, intrinsic 3x3, image_size, frame, disparity quantiles, version)."""
    from skyloom.functions import encoding as E
    from skyloom.operators.quantiles import quantiles
    from skyloom.operators.splats import encoded

    n = splats.count()
    if not n:
        raise ValueError("no splats to write")
    fx, fy = focal if isinstance(focal, tuple) else (focal, focal)
    disparity = quantiles(splats, 1 / F.col("z"), [0.1, 0.9]).first()["p"]
    values = {
        "extrinsic": np.eye(4).ravel(), "intrinsic": [fx, 0, width / 2, 0, fy, height / 2, 0, 0, 1], "image_size": [width, height], "frame": [1, n],
        "disparity": disparity, "color_space": [COLOR_SPACES["sRGB"]], "version": [1, 5, 0],
    }
    elements = [("vertex", n, [(c, "float") for c in CORE])] + [(name, len(values[name]), [(name, kind)]) for name, kind in SUPPLEMENT.items()]
    stored = _stored(encoded(splats.withColumns({c: E.to_srgb(F.col(c)) for c in "rgb"})))
    with open(path, "wb") as f:
        f.write(_head(elements, []))
        for block in blocks(stored, CORE):
            f.write(block)
        for name, kind in SUPPLEMENT.items():
            f.write(np.asarray(values[name]).astype(TYPES[kind]).tobytes())
    return n


def read_camera(data: bytes) -> dict[str, object]:
    """extrinsic (4x4), intrinsic (3x3), width, height and color_space of a file's supplement.

    Short forms: 12 numbers of an extrinsic lack its last row; 4 of an intrinsic are (f, f, width, height) and stand for
    the image size too. Without an element the identity, None and sRGB hold.
    """
    found = {name: a[a.dtype.names[0]] for name, a in elements_of(data).items() if name != "vertex" and a.dtype.names}
    extrinsic = np.eye(4)
    if "extrinsic" in found:
        e = np.asarray(found["extrinsic"], np.float64)
        extrinsic[: len(e) // 4] = e.reshape(-1, 4)
    intrinsic, size = None, found.get("image_size")
    if "intrinsic" in found:
        k = np.asarray(found["intrinsic"], np.float64)
        if len(k) == 4:
            size = k[2:] if size is None else size
            intrinsic = np.array([[k[0], 0, k[2] / 2], [0, k[1], k[3] / 2], [0, 0, 1.0]])
        else:
            intrinsic = k.reshape(3, 3)
    code = int(found["color_space"][0]) if "color_space" in found else 0
    space = next(n for n, c in COLOR_SPACES.items() if c == code)
    return {"extrinsic": extrinsic, "intrinsic": intrinsic, "width": None if size is None else int(size[0]), "height": None if size is None else int(size[1]), "color_space": space}


def copy(source: str, target: str) -> None:
    """The file as it is; KeyError where it lacks core columns."""
    with open(source, "rb") as f:
        data = f.read(1 << 16)
    found, _, _ = header(data)
    names = next((t.names or () for n, _, t in found if n == "vertex"), ())
    if missing := [c for c in CORE if c not in names]:
        raise KeyError(f"{source}: missing columns {missing}")
    shutil.copyfile(source, target)


#: Fixed values of the COLMAP format: the OPENCV camera model and its number of parameters.
OPENCV, OPENCV_PARAMS = 4, 8


def write_colmap(folder: str, cameras: pd.DataFrame, images: pd.DataFrame, points: pd.DataFrame) -> None:
    """cameras.bin (id, w, h, fx, fy, cx, cy), images.bin (id, qw..qz, tx..tz, camera_id, name), points3D.bin (id, x..z, r..b).

    Cameras are OPENCV ones without distortion, points have error 1 and no track."""
    with open(f"{folder}/cameras.bin", "wb") as f:
        f.write(struct.pack("<Q", len(cameras)))
        for c in cameras.itertuples():
            params = [c.fx, c.fy, c.cx, c.cy] + [0.0] * (OPENCV_PARAMS - 4)
            f.write(struct.pack(f"<iiQQ{OPENCV_PARAMS}d", c.id, OPENCV, c.w, c.h, *params))
    with open(f"{folder}/images.bin", "wb") as f:
        f.write(struct.pack("<Q", len(images)))
        for i in images.itertuples():
            f.write(struct.pack("<i7di", i.id, i.qw, i.qx, i.qy, i.qz, i.tx, i.ty, i.tz, i.camera_id) + i.name.encode() + b"\0" + struct.pack("<Q", 0))
    with open(f"{folder}/points3D.bin", "wb") as f:
        f.write(struct.pack("<Q", len(points)))
        for p in points.itertuples():
            f.write(struct.pack("<Q3d3BdQ", p.id, p.x, p.y, p.z, p.r, p.g, p.b, 1.0, 0))


def seed_points(splats: DataFrame, n: int, seed: int = 0) -> pd.DataFrame:
    """At most ``n`` splats by hash as COLMAP points (id from 1, x, y, z, r, g, b of 0 to 255)."""
    d = splats.orderBy(F.xxhash64("splat_id", F.lit(seed))).limit(n)
    byte = lambda c: F.floor(F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(0.0)) * 255).cast("int").alias(c)
    out = d.select("x", "y", "z", *[byte(c) for c in "rgb"]).toPandas()
    out.insert(0, "id", np.arange(1, len(out) + 1))
    return out


def scene_to_colmap(splats: DataFrame, rig: DataFrame, folder: str, size: int, fov_deg: float, points: int = 100_000) -> int:
    """A COLMAP scene of a splat table: one camera, an image row for each of ``rig(cam_id, rotation r00..r22, tx, ty, tz)``,
    and seed points. Gives the number of images; pixels come from a renderer and are not written."""
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    f = size / (2 * np.tan(np.radians(fov_deg) / 2))
    cameras = pd.DataFrame([(1, size, size, f, f, size / 2, size / 2)], columns=["id", "w", "h", "fx", "fy", "cx", "cy"])
    from skyloom.functions import rotations as R

    q = R.from_matrix([F.col(f"r{i}{j}") for i in range(3) for j in range(3)])
    poses = rig.select(F.col("cam_id"), *[c.alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"))], "tx", "ty", "tz").orderBy("cam_id").toPandas()
    poses = poses.assign(id=np.arange(1, len(poses) + 1), camera_id=1, name=[f"frame_{i:05d}.png" for i in range(len(poses))])
    write_colmap(folder, cameras, poses, seed_points(splats, points))
    return len(poses)


def convert(spark: SparkSession, source: str, target: str, reorient: bool = True, denoise: bool = False) -> int:
    """Stored file to stored file: core columns, turned about x, faint and stray splats dropped."""
    from skyloom.operators import splats as S

    d = read_stored(spark, source).select("splat_id", *[F.col(stored).alias(c) for c, stored in FIELDS.items()])
    if reorient:
        d = S.reorient(d)
    if denoise:
        d = S.denoise(d.withColumn("opacity_logit", F.col("opacity")))
    return write(d, target, encode=False)
