"""Column helpers for the engine's numeric rules: missing is NULL, comparisons with NULL are false, float32 stays float32."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(*columns: Column) -> Column:
    """True where every value is a number other than NaN and the infinities; false for NULL."""
    out = F.lit(True)
    for c in columns:
        c = c.cast("double")
        out = out & F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), F.lit(False))
    return out


def holds(predicate: Column) -> Column:
    """The predicate, false where it is NULL."""
    return F.coalesce(predicate, F.lit(False))


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)


def f32(value: float) -> Column:
    """A literal rounded to float32, for comparisons with float32 columns."""
    return F.lit(value).cast("float")


def clip(c: Column, low: float, high: float) -> Column:
    """c limited to [low, high]; NaN stays NaN."""
    return F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column, empty: Column | None = None) -> Column:
    """a / b as a double, or empty (NULL if not given) where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(None).cast("double") if empty is None else empty)


def atan2_signed(y: Column, x: Column) -> Column:
    """atan2 by the IEEE rule for a negative zero: -pi where y is -0.0 and x is negative."""
    minus_zero = (y == 0) & (y.cast("double").cast("string") == "-0.0")
    return F.when(minus_zero & (x < 0), F.lit(-math.pi)).otherwise(F.atan2(y, x))


def norm3(x: Column, y: Column, z: Column) -> Column:
    x, y, z = (c.cast("double") for c in (x, y, z))
    return F.sqrt(x * x + y * y + z * z)


def sigmoid(x: Column) -> Column:
    """The logistic function, stable on both sides."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def safe_name(c: Column) -> Column:
    """c with everything but letters, digits, - and _ replaced by _."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def recording_name(path: Column) -> Column:
    """The safe name of a recording file without its suffix."""
    return safe_name(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?i)\.mcap$", ""))
