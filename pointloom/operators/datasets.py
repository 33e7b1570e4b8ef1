"""The canonical dataset: projections of both source kinds into it, its rules, manifests and checksums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import is_finite
from .directional import EXCLUDED, IGNORED, clean_control

VERSION = "1.0"
POINTS = T.StructType(
    [T.StructField(n, t, False) for n, t in (
        ("schema_version", T.StringType()), ("session_id", T.StringType()), ("source_domain", T.StringType()), ("recording_id", T.StringType()), ("condition", T.StringType()), ("frame_index", T.IntegerType()),
        ("point_index", T.LongType()), ("x", T.FloatType()), ("y", T.FloatType()), ("z", T.FloatType()), ("intensity", T.FloatType()), ("tag", T.ShortType()), ("line", T.ShortType()), ("point_offset_s", T.FloatType()), ("label", T.ShortType()),
    )]
)
FRAMES = T.StructType([T.StructField(n, t, False) for n, t in (("recording_id", T.StringType()), ("frame_index", T.IntegerType()), ("n_points", T.LongType()), ("frame_time_s", T.DoubleType()))])
#: Columns of labelling that a model must not see.
DENIED = ("wx", "wy", "wz", "nearest_distance", "automatic_label", "reason", "region_id", "hard_negative_id", "human_verified", "confidence", "residual", "expected_range", "reflectivity_median")
_META = ("session_id", "recording_id", "condition")


def _canonical(points: DataFrame, extra: dict[str, Column]) -> DataFrame:
    rows = points.withColumns({"schema_version": F.lit(VERSION)} | extra)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in POINTS])


def remapped(label: Column) -> Column:
    """Training labels: excluded points are ignored."""
    return F.when(label == EXCLUDED, F.lit(IGNORED)).otherwise(label).cast("short")


def unify_stationary(points: DataFrame) -> DataFrame:
    """Stationary recordings as canonical points: reflectivity is the intensity, clean controls hold no impacted points."""
    return _canonical(clean_control(points), {"source_domain": F.lit("stationary"), "intensity": F.col("reflectivity")})


def unify_moving(points: DataFrame) -> DataFrame:
    """Moving-sensor exports as canonical points: offsets from ns, excluded points ignored, condition smoke."""
    extra = {"source_domain": F.lit("moving"), "point_offset_s": (F.col("relative_time_ns") * F.lit(1e-9)).cast("float"), "condition": F.lit("smoke"), "label": remapped(F.col("label"))}
    return _canonical(points, extra)


def rebased_frames(frames: DataFrame, time: Column, recording: str = "recording_id") -> DataFrame:
    """frames with frame_time_s counted from the recording's first frame."""
    first = F.min_by("_t", "frame_index").over(Window.partitionBy(recording))
    return frames.withColumn("_t", time).withColumn("frame_time_s", F.col("_t") - first).drop("_t")


def rebased_ns(frames: DataFrame, time_ns: str = "frame_time_ns", recording: str = "recording_id") -> DataFrame:
    """As rebased_frames() of integer ns: the difference is taken in ns."""
    first = F.min_by(time_ns, "frame_index").over(Window.partitionBy(recording))
    return frames.withColumn("frame_time_s", (F.col(time_ns) - first) * F.lit(1e-9))


def relative_ns(points: DataFrame, frames: DataFrame, keys: Sequence[str] = ("recording_id", "frame_index")) -> DataFrame:
    """points with relative_time_ns, their time less their frame's."""
    own = frames.select(*keys, "frame_time_ns")
    return points.join(own, list(keys)).withColumn("relative_time_ns", F.col("point_time_ns") - F.col("frame_time_ns"))


def training_export(points: DataFrame) -> DataFrame:
    """Labelled points without what a model must not see, and with training labels."""
    return points.withColumn("label", remapped(F.col("label"))).drop(*DENIED)


def unify(parts: Sequence[DataFrame]) -> DataFrame:
    """All parts of one schema, one after the other."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schema_problems(df: DataFrame, schema: T.StructType) -> list[str]:
    """What keeps df from having exactly the schema's columns and types."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in schema}
    out = [f"missing column {n}" for n in want if n not in have] + [f"unexpected column {n}" for n in have if n not in want]
    return out + [f"column {n} is {have[n].simpleString()}, not {t.simpleString()}" for n, t in want.items() if n in have and have[n] != t]


def violations(points: DataFrame, frames: DataFrame, recording: str = "recording_id") -> DataFrame:
    """(recording, problem, n): broken rules of canonical points and frames; empty where all hold."""
    checks = {
        "schema version": F.col("schema_version") != VERSION,
        "coordinates, intensity or offset not finite": ~is_finite(*[F.col(c) for c in ("x", "y", "z", "intensity", "point_offset_s")]),
        "label not 0, 1 or 255": ~F.coalesce(F.col("label").isin(0, 1, IGNORED), F.lit(False)),
        "no recording data": F.greatest(*[F.col(c).isNull() for c in _META]),
    }
    flagged = points.groupBy(recording).agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(f"c{i}") for i, c in enumerate(checks.values())])
    stack = ", ".join(f"'{name}', c{i}" for i, name in enumerate(checks))
    found = flagged.selectExpr(recording, f"stack({len(checks)}, {stack}) as (problem, n)").where("n > 0")
    order = Window.partitionBy(recording).orderBy("frame_index")
    timed = frames.withColumn("_before", F.lag("frame_time_s").over(order)).withColumn("_at", F.row_number().over(order) - 1)
    bad = timed.select(recording, F.when(~is_finite(F.col("frame_time_s")), "frame time not finite").when(F.col("frame_time_s") <= F.col("_before"), "frame times don't increase").when(F.col("_at") != F.col("frame_index"), "frames aren't numbered in turn").alias("problem"))
    bad = bad.where("problem is not null").groupBy(recording, "problem").agg(F.count(F.lit(1)).alias("n"))
    counted = points.groupBy(recording, "frame_index").agg(F.count(F.lit(1)).alias("_have"))
    sizes = frames.select(recording, "frame_index", "n_points").join(counted, [recording, "frame_index"], "full")
    wrong = sizes.where(F.coalesce("_have", F.lit(0)) != F.coalesce("n_points", F.lit(-1))).groupBy(recording).agg(F.count(F.lit(1)).alias("n")).select(recording, F.lit("points don't match the frame's count").alias("problem"), "n")
    return found.unionByName(bad).unionByName(wrong)


def manifest(points: DataFrame, frames: DataFrame) -> DataFrame:
    """One row a chunk (domain, session, recording, condition): frames, points and label counts; chunk_index by name."""
    keys = ["source_domain", "session_id", "recording_id", "condition"]
    counted = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), *[F.count_if(F.col("label") == c).alias(k) for k, c in (("unimpacted", 0), ("smoke_impacted", 1), ("ignore", IGNORED))])
    sized = frames.groupBy("recording_id").agg(F.count(F.lit(1)).alias("frames"))
    rows = counted.join(sized, "recording_id", "left").withColumn("frames", F.coalesce("frames", F.lit(0)))
    return rows.withColumn("chunk_index", F.row_number().over(Window.orderBy("source_domain", "session_id", "recording_id")) - 1)  # one row a chunk


def manifest_mismatches(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Chunks whose listed counts or names differ from the actual ones, or that one side lacks."""
    fields = ["session_id", "source_domain", "condition", "frames", "points", "unimpacted", "smoke_impacted", "ignore"]
    right = actual.select("recording_id", F.lit(True).alias("_there"), *[F.col(c).alias(f"_a_{c}") for c in fields])
    joined = listed.select("recording_id", F.lit(True).alias("_listed"), *fields).join(right, "recording_id", "full")
    differ = [F.when(~F.col(c).eqNullSafe(F.col(f"_a_{c}")), F.lit(c)) for c in fields]
    problem = F.when(F.col("_there").isNull(), "no such chunk").when(F.col("_listed").isNull(), "not listed").otherwise(F.concat_ws(",", *differ))
    return joined.select("recording_id", problem.alias("problem")).where("problem <> ''")


def totals_problem(listed: DataFrame, totals: dict[str, int]) -> DataFrame:
    """Totals (frames, points, ...) that aren't the sums of the listed chunks."""
    sums = listed.agg(*[F.sum(k).alias(k) for k in totals])
    rows = sums.selectExpr("stack({}, {}) as (field, listed)".format(len(totals), ", ".join(f"'{k}', {k}" for k in totals)))
    want = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    return rows.withColumn("total", want[F.col("field")]).where("not (listed <=> total)")


def checksums(df: DataFrame, content: str = "content") -> DataFrame:
    """df (of binaryFile) with the SHA-256 of each file."""
    return df.withColumn("sha256", F.sha2(content, 256))
