"""Panoramas and raster caches as long tables."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Fixed values of EXIF: the tags that are read, and where a photograph's own directory is.
TAGS = {0x0112: "orientation", 0x920A: "focal", 0xA405: "focal_35mm"}
OWN_DIRECTORY = 0x8769
#: Bytes of each type of a tag's value.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def exif(data: bytes) -> dict[str, float]:
    """TAGS of a JPEG or PNG file; empty without them. What cannot be read counts as not there."""
    at = data.find(b"Exif\0\0", 0, 1 << 17) + 6 if data[:2] == b"\xff\xd8" else data.find(b"eXIf", 0, 1 << 20) + 4
    if at < 6:
        return {}
    t = data[at : at + (1 << 17)]
    order = "<" if t[:2] == b"II" else ">"
    found: dict[str, float] = {}

    def directory(start: int) -> None:
        (n,) = struct.unpack_from(f"{order}H", t, start)
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", t, start + 2 + 12 * k)
            place = start + 10 + 12 * k
            if count * _SIZES.get(kind, 99) > 4:
                (place,) = struct.unpack_from(f"{order}I", t, place)
            if tag == OWN_DIRECTORY:
                directory(struct.unpack_from(f"{order}I", t, place)[0])
            elif tag in TAGS and kind in (3, 4):
                found[TAGS[tag]] = struct.unpack_from(f"{order}{'H' if kind == 3 else 'I'}", t, place)[0]
            elif tag in TAGS and kind == 5:
                above, below = struct.unpack_from(f"{order}II", t, place)
                found[TAGS[tag]] = above / below if below else 0.0

    try:
        directory(struct.unpack_from(f"{order}I", t, 4)[0])
    except struct.error:
        pass
    return found


def focal_mm(tags: dict[str, float], default: float = 30.0) -> float:
    """Focal length on 35 mm film. The plain tag stands in for a missing one, scaled up where it is below 10 mm."""
    film = tags.get("focal_35mm", 0)
    if film >= 1:
        return float(film)
    mm = tags.get("focal", default)
    return mm * 8.4 if mm < 10 else float(mm)


def turned(a: np.ndarray, orientation: int) -> np.ndarray:
    """Rows and columns as the orientation tag means them to be seen; unknown values change nothing."""
    mirrored = {2: a[:, ::-1], 4: a[::-1], 5: a.swapaxes(0, 1), 7: a[::-1, ::-1].swapaxes(0, 1)}
    return mirrored[orientation] if orientation in mirrored else np.rot90(a, {3: 2, 6: -1, 8: 1}.get(orientation, 0))


IMAGE = "origin string, height int, width int, nChannels int, data binary, orientation int, focal_mm double, focal_px double, error string"


def photographs(spark: SparkSession, path: str, auto_rotate: bool = True, mirrored: bool = True, remove_alpha: bool = True) -> DataFrame:
    """IMAGE rows of the files of a folder: decoded, upright, with three channels and the focal length in pixels.

    A file that cannot be decoded is a row with an ``error`` and no data, and does not stop the others. Orientations that
    mirror are ignored without ``mirrored``.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    files = spark.read.format("binaryFile").load(path).select(plain(F.col("path")).alias("origin"), "content")
    seen = spark.read.format("image").load(path).select(plain(F.col("image.origin")).alias("origin"), "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                if r.data is None or not r.height > 0:
                    row = (r.origin, None, None, None, None, None, None, None, "cannot be decoded")
                else:
                    tags = exif(bytes(r.content))
                    a = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.nChannels))
                    a = np.repeat(a, 3, 2) if a.shape[2] == 1 else a[..., :3] if remove_alpha else a
                    turn = int(tags.get("orientation", 1))
                    if auto_rotate and (mirrored or turn in (1, 3, 6, 8)):
                        a = turned(a, turn)
                    h, w, mm = a.shape[0], a.shape[1], focal_mm(tags)
                    row = (r.origin, h, w, a.shape[2], np.ascontiguousarray(a).tobytes(), turn, mm, mm * float(np.hypot(w, h)) / float(np.hypot(36, 24)), None)
                yield pd.DataFrame([row], columns=[f.split()[0] for f in IMAGE.split(", ")])

    return files.join(seen, "origin", "left").select("origin", "content", "height", "width", "nChannels", "data").mapInPandas(run, IMAGE)


def panoramas(spark: SparkSession, path: str, low: float = 1.9, high: float = 2.1, force: bool = False) -> DataFrame:
    """IMAGE rows of upright images whose width is about twice the height; others have an ``error`` but for ``force``."""
    d = photographs(spark, path)
    ratio = F.col("width") / F.col("height")
    flat = F.when(ratio.isNotNull() & ~((ratio > low) & (ratio < high)), F.concat(F.lit("not an equirectangular panorama: "), F.round(ratio, 2).cast("string")))
    return d if force else d.withColumn("error", F.coalesce("error", flat))


def narrow_panoramas(spark: SparkSession, path: str) -> DataFrame:
    """``panoramas`` with the narrower bounds 2 +- 0.05."""
    return panoramas(spark, path, 1.95, 2.05)


def pixels(images: DataFrame) -> DataFrame:
    """(origin, v, u, r, g, b) in [0, 1] of images without an error; stored bytes are in blue, green, red order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                a = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
                c = a[..., 2::-1] if row.nChannels >= 3 else np.repeat(a, 3, 2)
                for v in range(row.height):
                    yield pd.DataFrame({"origin": row.origin, "v": np.int32(v), "u": np.arange(row.width, dtype=np.int32), "r": c[v, :, 0] / 255.0, "g": c[v, :, 1] / 255.0, "b": c[v, :, 2] / 255.0})

    sound = images.where("error is null") if "error" in images.columns else images
    return sound.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "origin string, v int, u int, r double, g double, b double")


def npy_rasters(spark: SparkSession, path: str) -> DataFrame:
    """(path, v, u, value) of two-dimensional .npy files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                a = np.load(io.BytesIO(data), allow_pickle=False)
                for v in range(a.shape[0]):
                    yield pd.DataFrame({"path": p, "v": np.int32(v), "u": np.arange(a.shape[1], dtype=np.int32), "value": a[v].astype(np.float64)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, v int, u int, value double")


def find_files(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path, length) of files below a folder with one of the extensions, sorted by path; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return d.where(F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")).orderBy("path")
