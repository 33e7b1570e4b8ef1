"""Rigid transforms and rotations as column expressions, and their composition on the driver.

A transform T_A_B takes coordinates in B to A. Points are float32, arithmetic is in doubles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(*names: str) -> Vector:
    return tuple(F.col(n).cast("double") for n in names)  # type: ignore[return-value]


def normalised(q: Sequence[Column]) -> tuple[Column, ...]:
    """A quaternion (x, y, z, w) of unit length; NULL where it isn't finite or its length is under 1e-12."""
    n = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    good = (n >= 1e-12) & ~F.isnan(n) & (n < math.inf)
    return tuple(F.when(good, c / n) for c in q)


def rotate(q: Sequence[Column], v: Vector) -> Vector:
    """v rotated by the unit quaternion q."""
    x, y, z, w = q
    a, b, c = v
    return (
        (1 - 2 * (y * y + z * z)) * a + 2 * (x * y - z * w) * b + 2 * (x * z + y * w) * c,
        2 * (x * y + z * w) * a + (1 - 2 * (x * x + z * z)) * b + 2 * (y * z - x * w) * c,
        2 * (x * z - y * w) * a + 2 * (y * z + x * w) * b + (1 - 2 * (x * x + y * y)) * c,
    )


def move(q: Sequence[Column], t: Vector, v: Vector) -> Vector:
    """v by the rigid transform of rotation q and translation t."""
    return tuple(r + s for r, s in zip(rotate(q, v), t, strict=True))  # type: ignore[return-value]


def apply_matrix(m: np.ndarray, v: Vector) -> Vector:
    """v by a constant 4x4 matrix."""
    return tuple(F.lit(float(r[0])) * v[0] + F.lit(float(r[1])) * v[1] + F.lit(float(r[2])) * v[2] + F.lit(float(r[3])) for r in m[:3])  # type: ignore[return-value]


def slerp(a: Sequence[Column], b: Sequence[Column], f: Column) -> tuple[Column, ...]:
    """The rotation at share f of the shorter arc from a to b (unit quaternions)."""
    dot = sum((p * q for p, q in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    cosine = F.least(F.abs(dot), F.lit(1.0))
    theta = F.acos(cosine)
    near = cosine > 1 - 1e-12  # the arc is too short to divide by its sine
    ka = F.when(near, 1 - f).otherwise(F.sin((1 - f) * theta) / F.sin(theta))
    kb = F.when(near, f).otherwise(F.sin(f * theta) / F.sin(theta)) * sign
    return normalised([ka * p + kb * q for p, q in zip(a, b, strict=True)])


def pose_matrix(translation: Sequence[float], quaternion: Sequence[float]) -> np.ndarray:
    """4x4 matrix of one pose; an unusable quaternion is an error."""
    q = np.asarray(quaternion, np.float64)
    n = np.linalg.norm(q)
    if not np.isfinite(q).all() or n < 1e-12:
        raise ValueError("a quaternion must be finite and not zero")
    x, y, z, w = q / n
    out = np.eye(4)
    out[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    out[:3, 3] = translation
    return out


def invert(m: np.ndarray) -> np.ndarray:
    """The inverse of a rigid transform."""
    out = np.eye(4)
    out[:3, :3] = m[:3, :3].T
    out[:3, 3] = -m[:3, :3].T @ m[:3, 3]
    return out


def compose(*transforms: np.ndarray) -> np.ndarray:
    """T_A_B, T_B_C, ... to T_A_Z."""
    out = np.eye(4)
    for m in transforms:
        out = out @ m
    return out
