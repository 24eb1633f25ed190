"""Small string and time functions of the job and trajectory tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIRECTIONS = ("forward", "right", "backward", "left")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".tiff")
VIDEO_EXTENSIONS = (".mp4", ".mov")


def direction(azimuth: Column) -> Column:
    """Quarter of an azimuth in degrees: forward from 315 to 45, then right, backward and left."""
    a = F.pmod(azimuth, F.lit(360.0))
    return F.when((a >= 315) | (a < 45), "forward").when(a < 135, "right").when(a < 225, "backward").otherwise("left")


def scale_setting(s: Column) -> Column:
    """``none`` or empty: null; ``manual:x``: x; ``reprojection``: NaN, to be estimated; anything else is an error."""
    t = F.lower(F.trim(s))
    number = F.when(t.startswith("manual:"), F.split_part(t, F.lit(":"), F.lit(2)).try_cast("double"))
    return F.when(t.isNull() | t.isin("", "none"), F.lit(None).cast("double")).when(t == "reprojection", float("nan")).when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("unknown scale setting: "), s)))


def comma_list(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")


def progress(line: Column) -> Column:
    """(done, all) of the first ``a/b`` of a log line; null without one."""
    done, total = (F.regexp_extract(line, r"(\d+)/(\d+)", k) for k in (1, 2))
    return F.when(done != "", F.struct(done.cast("long").alias("done"), total.cast("long").alias("total")))


def run_hash(s: Column) -> Column:
    return F.substring(F.md5(s), 1, 8)


def to_unix_path(path: Column) -> Column:
    r"""``C:\a\b`` as ``/mnt/c/a/b``; other paths only get their slashes turned."""
    drive = F.regexp_extract(path, r"^([A-Za-z]):", 1)
    rest = F.translate(F.regexp_replace(path, r"^[A-Za-z]:", ""), "\\", "/")
    return F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), rest)).otherwise(rest)


def age_seconds(now: Column, then: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 1e6


#: Fixed values of requests: least and greatest number of a field, or the words allowed.
RANGES = {
    "stride": (1, 8), "depth_min": (0.01, None), "depth_max": (None, 1000.0), "outlier_pruning": (0.0, 1.0), "sparse_pruning": (0.0, 1.0), "grazing_angle": (30.0, 90.0),
    "global_scale": (0.1, 10.0), "side_count": (2, 12), "sharp_cap_fov": (90.0, 170.0), "sharp_seam_latitude": (10.0, 60.0),
}
WORDS = {"depth_model": ("dap", "da360"), "generator": ("da360", "dap", "sharp360", "unisharp360", "pager"), "unisharp_format_mode": ("copy", "convert")}


def problems(columns: list[str]) -> Column:
    """The names of a request's fields that are out of range, in the order of its columns; nulls are in order."""
    out = []
    for c in columns:
        low, high = RANGES.get(c, (None, None))
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(c) < low)
        if high is not None:
            bad = bad | (F.col(c) > high)
        if c in WORDS:
            bad = ~F.col(c).isin(*WORDS[c])
        if c in RANGES or c in WORDS:
            out.append(F.when(bad, F.lit(c)))
    if {"depth_min", "depth_max"} <= set(columns):
        out.append(F.when(F.col("depth_min") >= F.col("depth_max"), F.lit("depth_min >= depth_max")))
    return F.array_compact(F.array(*out))


def overlaid(base: dict, *changes: dict) -> dict:
    """Nested options with later ones over earlier ones; a null takes an option away."""
    out = dict(base)
    for change in changes:
        for k, v in change.items():
            if isinstance(v, dict):
                out[k] = overlaid(out.get(k) if isinstance(out.get(k), dict) else {}, v)
            elif v is None:
                out.pop(k, None)
            else:
                out[k] = v
    return out
