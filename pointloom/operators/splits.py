"""Chronological, purged splits of frame streams, and what is derived from them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("train", "selection", "calibration", "test")
FRACTIONS = (0.55, 0.15, 0.15, 0.15)


def stream_id(chunks: DataFrame, moving: str = "moving") -> DataFrame:
    """chunks (domain, session, recording, ...) with stream_id: moving chunks chain within a session, others by recording."""
    parts = [F.col("domain"), F.col("session")]
    return chunks.withColumn("stream_id", F.when(F.col("domain") == moving, F.concat_ws("/", *parts)).otherwise(F.concat_ws("/", *parts, "recording")))


def stream_frames(chunks: DataFrame, moving: str = "moving") -> DataFrame:
    """One row a frame of each stream: stream_id, chunk_index, frame (in the chunk) and position (in the stream).

    Chunks of a moving stream go by source start, those without one last; other chunks by index.
    """
    late = F.when(F.col("domain") == moving, F.col("source_start_s").isNull().cast("int")).otherwise(0)
    start = F.when(F.col("domain") == moving, F.coalesce("source_start_s", F.col("chunk_index").cast("double"))).otherwise(F.col("chunk_index").cast("double"))
    before = Window.partitionBy("stream_id").orderBy("_late", "_start", "chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunks.withColumn("_late", late).withColumn("_start", start).withColumn("_base", F.coalesce(F.sum("frames").over(before), F.lit(0)))
    rows = placed.where("frames > 0").select("stream_id", "chunk_index", "_base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames").cast("long") - 1)).alias("frame"))
    return rows.select("stream_id", "chunk_index", "frame", (F.col("_base") + F.col("frame")).alias("position"))


def boundaries(frames: int, fractions: Sequence[float] = FRACTIONS) -> list[int]:
    """Where the roles' partitions end: floors of the summed fractions, the last at frames."""
    total, out = 0.0, []
    for f in fractions[:-1]:
        total += f
        out.append(math.floor(total * frames))
    return [*out, frames]


def assign_roles(frames: DataFrame, fractions: Sequence[float] = FRACTIONS, purge: int = 20, stream: str = "stream_id", position: str = "position") -> DataFrame:
    """frames with role (NULL where purged): partitions by position, `purge` frames dropped on both sides of each border."""
    if len(fractions) != len(ROLES) or any(f <= 0 for f in fractions) or not math.isclose(sum(fractions), 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError("there must be four positive fractions that sum to 1")
    if purge < 0:
        raise ValueError("purge must not be negative")
    n = F.count(F.lit(1)).over(Window.partitionBy(stream))
    sums = [sum(fractions[: i + 1]) for i in range(3)]
    rows = frames.withColumn("_n", n)
    ends = [F.floor(F.lit(s) * F.col("_n")) for s in sums] + [F.col("_n")]
    starts = [F.lit(0), *[e + purge for e in ends[:-1]]]
    stops = [*[e - purge for e in ends[:-1]], ends[-1]]
    role = F.lit(None).cast("string")
    for name, a, b in reversed(list(zip(ROLES, starts, stops, strict=True))):
        role = F.when((F.col(position) >= a) & (F.col(position) < b), F.lit(name)).otherwise(role)
    return rows.withColumn("role", role).drop("_n")


def too_short(frames: DataFrame, fractions: Sequence[float] = FRACTIONS, purge: int = 20, stream: str = "stream_id") -> DataFrame:
    """Streams whose middle partitions have no more than 2 * purge frames."""
    sums = [sum(fractions[: i + 1]) for i in range(3)]
    n = frames.groupBy(stream).agg(F.count(F.lit(1)).alias("frames"))
    edges = [F.floor(F.lit(s) * F.col("frames")) for s in sums]
    return n.where((edges[1] - edges[0] <= 2 * purge) | (edges[2] - edges[1] <= 2 * purge))


def compact_ranges(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct integers as half-open ranges [start, end): one row for each run of consecutive values."""
    own = Window.partitionBy(*keys)
    island = rows.select(*keys, value).distinct().withColumn("_island", F.col(value) - F.row_number().over(own.orderBy(value)))
    return island.groupBy(*keys, "_island").agg(F.min(value).alias("start"), (F.max(value) + 1).alias("end")).drop("_island")


def expand_ranges(ranges: DataFrame, keys: Sequence[str], value: str = "frame") -> DataFrame:
    """The inverse of compact_ranges()."""
    return ranges.where("end > start").select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias(value))


def role_points(points: DataFrame, plan: DataFrame, chunk: str = "chunk_index", frame: str = "frame") -> DataFrame:
    """points with their role: an equi-join on chunk and frame. plan: (role, chunk_index, start, end)."""
    members = expand_ranges(plan, ["role", "chunk_index"]).select("role", F.col("chunk_index").alias(chunk), F.col("frame").alias(frame))
    return points.join(members, [chunk, frame])


def split_summary(points: DataFrame) -> DataFrame:
    """Per role: frames, points and label counts. points: (role, chunk_index, frame, label)."""
    by_frame = points.groupBy("role", "chunk_index", "frame").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == c).alias(k) for k, c in (("unimpacted", 0), ("impacted", 1), ("ignored", 255))])
    return by_frame.groupBy("role").agg(F.count(F.lit(1)).alias("frames"), F.sum("n").alias("points"), *[F.sum(k).alias(k) for k in ("unimpacted", "impacted", "ignored")])


def role_conflicts(plan: DataFrame, chunks: DataFrame) -> DataFrame:
    """What is wrong with a plan: frames in more than one role, and frames beyond their chunk or of unknown chunks."""
    members = expand_ranges(plan, ["role", "chunk_index"])
    twice = members.groupBy("chunk_index", "frame").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_index", "frame", F.lit("more than one role").alias("problem"))
    known = members.join(chunks.select("chunk_index", "frames"), "chunk_index", "left")
    beyond = known.where("frames is null or frame >= frames or frame < 0").select("chunk_index", "frame", F.lit("not in the chunk").alias("problem")).distinct()
    return twice.unionByName(beyond)


def shuffled(frames: DataFrame, seed: int) -> DataFrame:
    """frames in a seeded order: chunks shuffled, then frames within each. The order is a hash of seed and ids."""
    return frames.orderBy(F.xxhash64(F.lit(seed), "chunk_index"), "chunk_index", F.xxhash64(F.lit(seed), "chunk_index", "frame"), "frame")
