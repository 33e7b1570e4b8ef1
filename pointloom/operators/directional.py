"""Directional references: statistics for each angular cell, lookup, range bands and residual labels."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import linear_columns, nearest_rank
from ..functions.staging import staged
from ..functions.semantics import atan2_signed, clip, f32, holds, is_finite, norm3

UNAFFECTED, IMPACTED, EXCLUDED, IGNORED = 0, 1, 254, 255


@dataclass(frozen=True)
class LookupConfig:
    min_returns: int = 3
    max_spread: float = 0.25


@dataclass(frozen=True)
class BandConfig:
    """Range bands [edges[i], edges[i + 1]) and how their thresholds are taken from clean residuals."""

    edges: tuple[float, ...]
    normal_q: float = 0.99
    early_q: float = 0.999
    min_normal: float = 0.02
    min_early: float = 0.05
    min_samples: int = 1000
    max_usable: float = math.inf

    def __post_init__(self) -> None:
        if len(self.edges) < 2 or any(a >= b for a, b in zip(self.edges, self.edges[1:], strict=False)):
            raise ValueError("band edges must increase")
        if not 0 < self.normal_q < self.early_q < 1:
            raise ValueError("0 < normal_q < early_q < 1 must hold")


def azimuth_bins(resolution_deg: float) -> int:
    return math.ceil(2 * math.pi / math.radians(resolution_deg))


def cell_columns(x: Column, y: Column, z: Column, resolution_deg: float, digits: int | None = None) -> tuple[Column, Column]:
    """Range (float) and angular cell (long, -1 where the point is unusable). digits: rounding of angles before binning."""
    step = math.radians(resolution_deg)
    n_az, n_el = azimuth_bins(resolution_deg), math.ceil(math.pi / step)
    x, y, z = (c.cast("double") for c in (x, y, z))
    r = norm3(x, y, z)
    usable = is_finite(x, y, z, r) & (r > 1e-6)
    rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    azimuth = rounded((atan2_signed(y, x) + math.pi) / step)
    elevation = rounded((F.asin(F.greatest(F.least(z / r, F.lit(1.0)), F.lit(-1.0))) + math.pi / 2) / step)
    bounded = lambda c, n: F.greatest(F.least(F.floor(c), F.lit(n - 1).cast("long")), F.lit(0).cast("long"))
    cell = F.when(usable, bounded(elevation, n_el) * F.lit(n_az).cast("long") + bounded(azimuth, n_az)).otherwise(F.lit(-1).cast("long"))
    return r.cast("float"), cell


def with_cells(points: DataFrame, resolution_deg: float, digits: int | None = None) -> DataFrame:
    r, cell = cell_columns(F.col("x"), F.col("y"), F.col("z"), resolution_deg, digits)
    return points.withColumn("range", r).withColumn("cell_id", cell)


def build_reference(points: DataFrame, keys: Sequence[str] = ("cell_id",), value: str = "range", reflectivity: str | None = "reflectivity") -> DataFrame:
    """One row a cell: count, median, MAD and q95 - q05 of value, and the finite reflectivities' median and MAD.

    points has the keys (a negative or NULL cell takes no part). Every statistic is a nearest-rank quantile.
    """
    keys = list(keys)
    usable = points.where(is_finite(F.col(value)) & F.coalesce(F.col(keys[-1]) >= 0, F.lit(False)))
    stats = nearest_rank(usable, keys, value, {f"{value}_median": 0.5, "_lo": 0.05, "_hi": 0.95})
    spread = nearest_rank(usable.join(stats.select(*keys, f"{value}_median"), keys).withColumn("_d", F.abs(F.col(value) - F.col(f"{value}_median"))), keys, "_d", {f"{value}_mad": 0.5})
    out = stats.select(*keys, F.col("n").alias("count"), f"{value}_median", (F.col("_hi") - F.col("_lo")).alias(f"{value}_spread")).join(spread.drop("n"), keys)
    if reflectivity:
        lit = usable.where(is_finite(F.col(reflectivity)))
        medians = nearest_rank(lit, keys, reflectivity, {"reflectivity_median": 0.5}).drop("n")
        mads = nearest_rank(lit.join(medians, keys).withColumn("_d", F.abs(F.col(reflectivity) - F.col("reflectivity_median"))), keys, "_d", {"reflectivity_mad": 0.5}).drop("n")
        out = out.join(medians, keys, "left").join(mads, keys, "left")
    return out


def look_up(points: DataFrame, reference: DataFrame, cfg: LookupConfig = LookupConfig(), keys: Sequence[str] = ("cell_id",), value: str = "range") -> DataFrame:
    """points with expected value, residual (observed - expected), count, spread and whether the reference is usable.

    A left join on the cell; Spark broadcasts the reference while it is small and shuffles both sides beyond.
    """
    own = reference.select(*keys, F.col(f"{value}_median").alias(f"expected_{value}"), F.col("count").alias("reference_count"), F.col(f"{value}_spread").alias("reference_spread"), *[c for c in ("reflectivity_median",) if c in reference.columns])
    joined = points.join(own, list(keys), "left").withColumn("reference_count", F.coalesce("reference_count", F.lit(0)))
    usable = holds((F.col("reference_count") >= cfg.min_returns) & (F.col("reference_spread") <= cfg.max_spread)) & is_finite(F.col(value))
    return joined.withColumn("residual", F.col(value) - F.col(f"expected_{value}")).withColumn("valid_reference", usable)


def band_of(expected: Column, edges: Sequence[float], as_float: bool = True) -> Column:
    """The number of the band that holds expected, or NULL."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        low, high = (f32(e) if as_float else F.lit(float(e)) for e in edges[i : i + 2])
        out = F.when(holds((expected >= low) & (expected < high)), F.lit(i)).otherwise(out)
    return out


def calibrate(looked_up: DataFrame, cfg: BandConfig, value: str = "range", as_float: bool = True) -> DataFrame:
    """One row a band, also for empty ones: n, normal and early thresholds (NULL under min_samples), usable."""
    rows = looked_up.where(F.col("valid_reference") & is_finite(F.col(f"expected_{value}"), F.col("residual"))).withColumn("band", band_of(F.col(f"expected_{value}"), cfg.edges, as_float)).where("band is not null")
    rows = staged(rows.select("band", F.abs("residual").alias("_size"), (-F.col("residual")).alias("_ahead")))
    spread = linear_columns(rows, ["band"], {"_normal": ("_size", cfg.normal_q), "_early": ("_ahead", cfg.early_q)}, written=True)
    stats = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).join(spread, "band")
    bands = rows.sparkSession.range(len(cfg.edges) - 1).select(F.col("id").cast("int").alias("band"))
    enough = F.coalesce(F.col("n") >= cfg.min_samples, F.lit(False))
    out = bands.join(stats, "band", "left").withColumn("normal_threshold", F.when(enough, F.greatest(F.lit(cfg.min_normal), "_normal")))
    out = out.withColumn("early_threshold", F.when(enough, F.greatest(F.lit(cfg.min_early), "_early", "normal_threshold")))
    return out.select("band", F.coalesce("n", F.lit(0)).alias("n"), "normal_threshold", "early_threshold", holds(F.col("early_threshold") <= cfg.max_usable).alias("usable"))


def label_residuals(looked_up: DataFrame, bands: DataFrame, cfg: BandConfig, value: str = "range", as_float: bool = True, storage: str = "float") -> DataFrame:
    """looked_up with band, label (0, 1, 255) and confidence. bands has one row for each of cfg's bands."""
    table = bands.select("band", F.col("normal_threshold").cast(storage).alias("_normal"), F.col("early_threshold").cast(storage).alias("_early"), "usable")
    rows = looked_up.withColumn("band", band_of(F.col(f"expected_{value}"), cfg.edges, as_float)).join(F.broadcast(table), "band", "left")
    residual, early = F.col("residual"), -F.col("residual")
    valid = F.col("valid_reference") & holds(F.col("usable")) & is_finite(residual)
    impacted, normal = valid & holds(early > F.col("_early")), valid & holds(F.abs(residual) <= F.col("_normal"))
    label = F.when(impacted, IMPACTED).when(normal, UNAFFECTED).otherwise(IGNORED)
    confidence = F.when(impacted, clip((early - F.col("_early")) / (2 * F.col("_early")), 0.0, 1.0)).when(normal, clip(1 - F.abs(residual) / F.col("_normal"), 0.0, 1.0)).otherwise(0.0)
    return rows.withColumn("label", label.cast("short")).withColumn("confidence", confidence.cast(storage)).drop("_normal", "_early", "usable")


def mask_invalid(labelled: DataFrame, valid: Column) -> DataFrame:
    """Points whose input isn't valid are ignored with confidence 0."""
    return labelled.withColumn("label", F.when(holds(valid), F.col("label")).otherwise(F.lit(IGNORED)).cast("short")).withColumn("confidence", F.when(holds(valid), F.col("confidence")).otherwise(F.lit(0.0)).cast(labelled.schema["confidence"].dataType))


def clean_control(labelled: DataFrame, condition: str = "clean_control") -> DataFrame:
    """In recordings known to be clean, impacted points are unaffected; ignored ones stay."""
    wrong = (F.col("condition") == condition) & (F.col("label") == IMPACTED)
    return labelled.withColumn("label", F.when(wrong, UNAFFECTED).otherwise(F.col("label")).cast("short"))


def input_valid(minimum: float, maximum: float, *finite: str, value: str = "range") -> Column:
    """Whether all columns are finite and the range lies in [minimum, maximum], as float32."""
    return is_finite(*[F.col(c) for c in finite], F.col(value)) & holds((F.col(value) >= f32(minimum)) & (F.col(value) <= f32(maximum)))


def label_counts(labelled: DataFrame, by: str = "recording", held_out: Column | None = None) -> DataFrame:
    """Points, label counts and percents for each value of by and in total (NULL), and the impacted rate of held-out points."""
    rows = labelled.rollup(by) if by else labelled.groupBy()
    count = lambda c: F.count_if(c)
    n = F.count(F.lit(1))
    aggregates = [n.alias("points")]
    for name, code in (("unaffected", UNAFFECTED), ("impacted", IMPACTED), ("ignored", IGNORED)):
        aggregates.append(count(F.col("label") == code).alias(f"{name}_points"))
        aggregates.append(F.round(100.0 * count(F.col("label") == code) / n, 4).alias(f"{name}_percent"))
    if held_out is not None:
        kept = held_out & (F.col("label") != IGNORED)
        aggregates += [count(held_out).alias("held_out_points"), count(held_out & (F.col("label") == IMPACTED)).alias("held_out_impacted")]
        aggregates.append(F.round(F.try_divide(100.0 * count(held_out & (F.col("label") == IMPACTED)), count(kept)), 4).alias("held_out_percent_of_labelled"))
    return rows.agg(*aggregates)


