"""Pose trajectories: as-of joins with interpolation, pairing of raw and undistorted frames, static transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import move, normalised, slerp, vector
from ..functions.semantics import is_finite

#: How much wider the buckets of long intervals are.
COARSE = 4096
POSE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def pose_problems(poses: DataFrame, session: str = "session_id") -> DataFrame:
    """Poses that aren't finite, have a zero quaternion or don't follow in time, and sessions with fewer than two."""
    order = Window.partitionBy(session).orderBy("time_ns")
    rows = poses.withColumn("_before", F.lag("time_ns").over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(session)))
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in POSE[4:]), F.col(POSE[3]) * F.col(POSE[3])))
    problem = F.when(~is_finite(*[F.col(c) for c in POSE]), "not finite").when(norm < 1e-12, "zero quaternion").when(F.col("time_ns") <= F.col("_before"), "times don't increase").when(F.col("_n") < 2, "fewer than two poses")
    return rows.withColumn("problem", problem).where("problem is not null").select(session, "time_ns", "problem")


def at_times(frames: DataFrame, poses: DataFrame, max_gap_ns: int = 250_000_000, session: str = "session_id", bucket_ns: int = 10**9) -> DataFrame:
    """frames with their pose: the pose of their time, or one interpolated between its neighbours (linear and slerp).

    pose_status: exact, between, gap (the neighbours are further apart than max_gap_ns) or outside. Intervals between
    poses are dealt by time buckets, so the as-of join is an equi-join: an interval is copied to each bucket it touches.
    Long intervals are dealt by buckets COARSE times as wide, and frames look in both.
    """
    order = Window.partitionBy(session).orderBy("time_ns")
    unit = dict(zip(POSE[3:], normalised([F.col(c) for c in POSE[3:]]), strict=True))
    own = poses.select(session, "time_ns", *POSE).withColumns(unit)
    nexts = own.select(session, F.col("time_ns").alias("_t0"), *[F.col(c).alias(f"_a_{c}") for c in POSE], F.lead("time_ns").over(order).alias("_t1"), *[F.lead(c).over(order).alias(f"_b_{c}") for c in POSE])
    # The last pose is an interval of its own.
    last = F.coalesce(F.col("_t1") - 1, F.col("_t0"))
    bucket = lambda t, level: F.floor(t / F.lit(bucket_ns * COARSE**level)).cast("long")
    wide = bucket(last, 0) - bucket(F.col("_t0"), 0) > 64
    touched = F.when(wide, F.sequence(bucket(F.col("_t0"), 1), bucket(last, 1))).otherwise(F.when(~wide, F.sequence(bucket(F.col("_t0"), 0), bucket(last, 0))))
    spans = nexts.withColumn("_level", wide.cast("int")).withColumn("_bucket", F.explode(touched))
    looked = frames.withColumn("_at", F.explode(F.array(*[F.struct(F.lit(x).alias("level"), bucket(F.col("time_ns"), x).alias("bucket")) for x in (0, 1)])))
    looked = looked.withColumn("_level", F.col("_at.level")).withColumn("_bucket", F.col("_at.bucket")).drop("_at")
    joined = looked.join(spans, [session, "_level", "_bucket"]).where("time_ns >= _t0 and time_ns <= coalesce(_t1 - 1, _t0)")
    # A frame that no interval holds is outside; it comes back by the left join below.
    keys = [c for c in frames.columns if c in (session, "time_ns", "frame_index")]
    found = joined.drop("_level", "_bucket")
    out = frames.join(found.select(*keys, *[c for c in found.columns if c.startswith("_")]), keys, "left")
    f = F.when(F.col("time_ns") == F.col("_t0"), 0.0).otherwise((F.col("time_ns") - F.col("_t0")) / (F.col("_t1") - F.col("_t0")))
    status = F.when(F.col("_t0").isNull(), "outside").when(F.col("time_ns") == F.col("_t0"), "exact").when(F.col("_t1") - F.col("_t0") > max_gap_ns, "gap").otherwise("between")
    a, b = [F.col(f"_a_{c}") for c in POSE], [F.col(f"_b_{c}") for c in POSE]
    turned = slerp(a[3:], b[3:], F.col("_f"))
    out = out.withColumn("_f", f).withColumn("pose_status", status)
    exact, usable = F.col("pose_status") == "exact", F.col("pose_status").isin("exact", "between")
    values: dict[str, Column] = {}
    for i, c in enumerate(POSE):
        mixed = a[i] + F.col("_f") * (b[i] - a[i]) if i < 3 else turned[i - 3]
        values[c] = F.when(usable, F.when(exact, a[i]).otherwise(mixed))
    return out.withColumns(values).drop(*[c for c in out.columns if c.startswith("_")])


def to_world(points: DataFrame, posed: DataFrame, keys: Sequence[str] = ("session_id", "frame_index"), sensor: str | None = None) -> DataFrame:
    """points with world coordinates wx, wy, wz (float32) by the pose of their frame. Frames without a pose drop out."""
    usable = posed.where(F.col("pose_status").isin("exact", "between")).select(*keys, *POSE)
    joined = points.join(usable, list(keys))
    world = move([F.col(c) for c in POSE[3:]], vector(*POSE[:3]), vector("x", "y", "z"))
    return joined.withColumns({n: c.cast("float") for n, c in zip(("wx", "wy", "wz"), world, strict=True)}).drop(*POSE)


def coverage(frames: DataFrame, poses: DataFrame, session: str = "session_id") -> DataFrame:
    """frames with in_coverage: whether their time lies between the session's first and last pose."""
    ends = poses.groupBy(session).agg(F.min("time_ns").alias("_first"), F.max("time_ns").alias("_last"))
    rows = frames.join(F.broadcast(ends), session, "left")  # one row a session
    return rows.withColumn("in_coverage", F.coalesce((F.col("time_ns") >= F.col("_first")) & (F.col("time_ns") <= F.col("_last")), F.lit(False))).drop("_first", "_last")


def pair_frames(raw: DataFrame, undistorted: DataFrame, keys: Sequence[str] = ("frame_index", "point_index"), same: Sequence[str] = ("intensity", "tag", "line", "time_ns")) -> DataFrame:
    """raw points with the undistorted coordinates ux, uy, uz and mismatch: what keeps a pair from being one point."""
    left = raw.withColumn("_l", F.lit(True))
    right = undistorted.select(*keys, F.lit(True).alias("_r"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("z").alias("uz"), *[F.col(c).alias(f"_u_{c}") for c in same])
    joined = left.join(right, list(keys), "full")
    problem = F.when(F.col("_l").isNull(), "no raw point").when(F.col("_r").isNull(), "no undistorted point")
    for c in same:
        problem = problem.when(~F.col(c).eqNullSafe(F.col(f"_u_{c}")), c)
    return joined.withColumn("mismatch", problem).drop("_l", "_r", *[f"_u_{c}" for c in same])


def static_transform(rows: DataFrame, parent: str, child: str, tolerance: float = 1e-9) -> DataFrame:
    """The transform from child to parent (one row, none if it is missing) with n and spread; spread above the tolerance is an error for the caller."""
    own = rows.where((F.col("parent") == parent) & (F.col("child") == child))
    spreads = [F.max(c) - F.min(c) for c in POSE]
    return own.groupBy("parent", "child").agg(F.count(F.lit(1)).alias("n"), F.greatest(*spreads).alias("spread"), *[F.min_by(c, "seq").alias(c) for c in POSE]).withColumn("consistent", F.col("spread") <= tolerance)


def changing_frames(poses: DataFrame, session: str = "session_id") -> DataFrame:
    """Sessions whose poses name more than one world or body frame (an error for the caller)."""
    named = poses.groupBy(session).agg(F.count_distinct("world_frame").alias("world_frames"), F.count_distinct("body_frame").alias("body_frames"))
    return named.where("world_frames > 1 or body_frames > 1")


def displacement(paired: DataFrame, frame: Sequence[str] = ("frame_index",)) -> DataFrame:
    """How far undistortion moved the points of each frame: points, median and maximum; points that aren't finite don't count."""
    d = [F.col(f"u{c}").cast("double") - F.col(c).cast("double") for c in "xyz"]
    far = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    own = F.when(is_finite(far), far)
    return paired.groupBy(*frame).agg(F.count(F.lit(1)).alias("points"), F.percentile(own, F.lit(0.5)).alias("median_m"), F.max(own).alias("max_m"))
