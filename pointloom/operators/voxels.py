"""Voxel support, moments, normalisers and the way back from voxels to points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import is_finite, norm3

FEATURES = ("log_count", "intensity_mean", "intensity_std", "range_mean", "range_std", "x_mean", "y_mean", "z_mean", "x_std", "y_std", "z_std")
VOXEL = ("vx", "vy", "vz")


def with_voxels(points: DataFrame, size: float, origin: Sequence[float] = (0.0, 0.0, 0.0), columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """points with voxel coordinates floor((c - origin) / size), computed in doubles."""
    if size <= 0:
        raise ValueError("the voxel size must be positive")
    cells = {v: F.floor((F.col(c).cast("double") - F.lit(float(o))) / F.lit(size)).cast("long") for v, c, o in zip(VOXEL, columns, origin, strict=True)}
    return points.withColumns(cells)


def voxel_support(points: DataFrame, size: float, min_frames: int, origin: Sequence[float], frame: str = "frame_index", columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Voxels that points of at least min_frames distinct frames lie in: vx, vy, vz, support and centre (float32)."""
    seen = with_voxels(points, size, origin, columns).groupBy(*VOXEL, frame).agg(F.lit(1).alias("_")).groupBy(*VOXEL).agg(F.count(F.lit(1)).alias("support"))
    centre = {f"c{c}": ((F.col(v) + 0.5) * size + o).cast("float") for c, v, o in zip("xyz", VOXEL, origin, strict=True)}
    return seen.where(F.col("support") >= min_frames).withColumns(centre)


def voxel_features(points: DataFrame, size: float, keys: Sequence[str] = ("frame_index",), labels: bool = True) -> DataFrame:
    """One row a voxel and frame: FEATURES (population moments over all its points) and n_pos, n_neg of labelled ones."""
    rows = with_voxels(points, size).withColumn("_r", norm3(F.col("x"), F.col("y"), F.col("z")))
    n = F.count(F.lit(1))
    both = lambda name, c: [F.avg(c).alias(f"{name}_mean"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"{name}_std")]
    moments = [m for name, c in (("intensity", "intensity"), ("range", "_r"), ("x", "x"), ("y", "y"), ("z", "z")) for m in both(name, F.col(c).cast("double"))]
    extra = [F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg")] if labels else []
    out = rows.groupBy(*keys, *VOXEL).agg(n.alias("n_points"), F.log1p(n.cast("double")).alias("log_count"), *moments, *extra)
    return out.select(*keys, *VOXEL, "n_points", *FEATURES, *(["n_pos", "n_neg"] if labels else []))


def unusable_features(features: DataFrame) -> DataFrame:
    """Voxels with a feature that isn't finite (an error for the caller)."""
    return features.where(~is_finite(*[F.col(c) for c in FEATURES]))


def normaliser(features: DataFrame) -> DataFrame:
    """One row: count, and mean and scale (population; 1 where it is under 1e-6) of each feature. Merges as partial aggregates do."""
    row = features.agg(F.count(F.lit(1)).alias("count"), *[F.avg(c).alias(f"{c}_center") for c in FEATURES], *[F.stddev_pop(c).alias(f"{c}_scale") for c in FEATURES])
    return row.withColumns({f"{c}_scale": F.when(F.col(f"{c}_scale") < 1e-6, 1.0).otherwise(F.col(f"{c}_scale")) for c in FEATURES})


def normalised(features: DataFrame, norm: DataFrame) -> DataFrame:
    """features less centre, by scale, as float32; norm has one row."""
    joined = features.crossJoin(F.broadcast(norm.drop("count")))  # one row
    out: dict[str, Column] = {c: ((F.col(c) - F.col(f"{c}_center")) / F.col(f"{c}_scale")).cast("float") for c in FEATURES}
    return joined.withColumns(out).select(*features.columns)


def scores_to_points(points: DataFrame, scored: DataFrame, size: float, keys: Sequence[str] = ("frame_index",), score: str = "logit") -> DataFrame:
    """points with their voxel's score."""
    return with_voxels(points, size).join(scored.select(*keys, *VOXEL, score), [*keys, *VOXEL])
