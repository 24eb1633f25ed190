"""Quaternions and rotation matrices as column expressions; quaternions are (w, x, y, z) here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Quat = tuple[Column, Column, Column, Column]


def normalized(q: Quat) -> Quat:
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return tuple(F.when(n > 0, c / n).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i, c in enumerate(q))  # type: ignore[return-value]


def matrix(q: Quat) -> list[Column]:
    """Row-major rotation of a unit quaternion."""
    w, x, y, z = q
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def product(a: Quat, b: Quat) -> Quat:
    """The rotation b followed by a."""
    return (
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def conjugate(q: Quat) -> Quat:
    return q[0], -q[1], -q[2], -q[3]


def from_matrix(m: list[Column]) -> Quat:
    """Shepperd's rule: divide by the largest of the four squared components; w is not negative."""
    trace = m[0] + m[4] + m[8]
    root = lambda t: F.sqrt(F.greatest(t, F.lit(1e-12))) * 2.0
    s0, s1, s2, s3 = root(1 + trace), root(1 + m[0] - m[4] - m[8]), root(1 - m[0] + m[4] - m[8]), root(1 - m[0] - m[4] + m[8])
    cases = [
        (s0 / 4, (m[7] - m[5]) / s0, (m[2] - m[6]) / s0, (m[3] - m[1]) / s0),
        ((m[7] - m[5]) / s1, s1 / 4, (m[1] + m[3]) / s1, (m[2] + m[6]) / s1),
        ((m[2] - m[6]) / s2, (m[1] + m[3]) / s2, s2 / 4, (m[5] + m[7]) / s2),
        ((m[3] - m[1]) / s3, (m[2] + m[6]) / s3, (m[5] + m[7]) / s3, s3 / 4),
    ]
    pick = lambda k: F.when(trace > 0, cases[0][k]).when((m[0] > m[4]) & (m[0] > m[8]), cases[1][k]).when(m[4] > m[8], cases[2][k]).otherwise(cases[3][k])
    q = [pick(k) for k in range(4)]
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    return tuple(c * sign for c in q)  # type: ignore[return-value]


def covariance(q: Quat, s: tuple[Column, Column, Column]) -> dict[str, Column]:
    """The six entries of R * diag(s^2) * R^T."""
    m = matrix(q)
    entry = lambda i, j: sum(m[3 * i + k] * m[3 * j + k] * s[k] * s[k] for k in range(3))
    return {"xx": entry(0, 0), "xy": entry(0, 1), "xz": entry(0, 2), "yy": entry(1, 1), "yz": entry(1, 2), "zz": entry(2, 2)}
