"""Storage encodings of splats, colour spaces and activations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.geometry import clamp, lit

#: Fixed values of the splat formats: the constant of the zeroth spherical harmonic, and floors of the logs.
SH_C0 = 0.28209479177387814
SCALE_FLOOR, OPACITY_FLOOR = 1e-7, 1e-6


def encode_scale(s: Column) -> Column:
    return F.ln(F.greatest(s, F.lit(SCALE_FLOOR)))


def logit(p: Column, floor: float = OPACITY_FLOOR) -> Column:
    p = clamp(p, floor, 1 - floor)
    return F.ln(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def rgb_to_sh(c: Column) -> Column:
    return (c - 0.5) / SH_C0


def sh_to_rgb(c: Column) -> Column:
    return clamp(c * SH_C0 + 0.5, 0.0, 1.0)


def to_srgb(c: Column) -> Column:
    """The sRGB curve over linear light."""
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0031308)), F.lit(1 / 2.4)) - 0.055)


def to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((F.greatest(c, F.lit(0.04045)) + 0.055) / 1.055, F.lit(2.4)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def inverse_softplus(x: Column) -> Column:
    return x + F.ln(-F.expm1(-x))


def soft_clamp(x: Column, low: float, high: float) -> Column:
    """Squeezes into (low, high), the identity's slope in the middle."""
    mid, half = (low + high) / 2, (high - low) / 2
    return mid + half * F.tanh((x - mid) / half)


def hard_sigmoid(x: Column) -> Column:
    return clamp(x / 6.0 + 0.5, 0.0, 1.0)


def robust_where(condition: Column, value, safe_of, otherwise) -> Column:
    """``value(x)`` where the condition holds; its argument is guarded inside the branch, so nothing else evaluates it."""
    return F.when(condition, value(F.when(condition, safe_of))).otherwise(lit(otherwise))


def pdf_to_opacity(p: Column, step: float) -> Column:
    """Opacity of a density by an exponent that rises from 1: 0.5 * (1 - (1-p)^e + p^(1/e)), e = 2^step."""
    e = 2.0**step
    return 0.5 * (1.0 - F.pow(1.0 - p, F.lit(e)) + F.pow(p, F.lit(1.0 / e)))


def smoothstep(x: Column) -> Column:
    t = clamp(x, 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def log_blend(a: Column, b: Column, w: Column) -> Column:
    """The weighted geometric mean; both must be positive."""
    return F.exp(w * F.ln(a) + (1.0 - w) * F.ln(b))
