"""Frame algebra: layouts, history windows, time chunks, caps, samples, and calibration splits.

Tables: points (recording, frame_index, point_index, ...) and frames (recording, frame_index, n_points, frame_time_s).
Windows are partitioned by recording; a recording has thousands of frames, so its frames fit a task, its points needn't.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import running_total
from ..functions.semantics import is_finite
from ..functions.staging import staged


def frame_layout(points: DataFrame, recording: str = "recording", time: str = "time_s") -> DataFrame:
    """One row a frame from 0 to the last: n_points, frame_time_s (NULL where empty), point_start, point_end."""
    found = points.groupBy(recording, "frame_index").agg(F.count(F.lit(1)).alias("n_points"), F.min(time).alias("frame_time_s"))
    every = found.groupBy(recording).agg(F.max("frame_index").alias("_last")).select(recording, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long"))).alias("frame_index"))
    return offsets(every.join(found, [recording, "frame_index"], "left").withColumn("n_points", F.coalesce("n_points", F.lit(0))), recording)


def offsets(frames: DataFrame, recording: str = "recording") -> DataFrame:
    """frames with the half-open range of their points: point_start, point_end."""
    upto = Window.partitionBy(recording).orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("point_end", F.sum("n_points").over(upto)).withColumn("point_start", F.col("point_end") - F.col("n_points"))


def history_windows(frames: DataFrame, length: int, max_gap_s: float, recording: str = "recording") -> DataFrame:
    """Every frame with a full history of length frames: history_start, target_frame and usable.

    A window isn't usable if a time in it isn't finite, doesn't increase, or follows by more than max_gap_s.
    """
    order = Window.partitionBy(recording).orderBy("frame_index")
    whole, steps = order.rowsBetween(-(length - 1), 0), order.rowsBetween(-(length - 2), 0)
    t = F.col("frame_time_s")
    rows = frames.withColumn("_at", F.row_number().over(order) - 1).withColumn("_bad", (~is_finite(t)).cast("int"))
    rows = rows.withColumn("_step", t - F.lag(t).over(order))
    good = F.max("_bad").over(whole) == 0
    if length > 1:
        good = good & (F.coalesce(F.max("_step").over(steps), F.lit(0.0)) <= max_gap_s) & (F.coalesce(F.min("_step").over(steps), F.lit(1.0)) > 0)
    return rows.withColumn("usable", good).where(F.col("_at") >= length - 1).withColumn("history_start", F.col("_at") - (length - 1)).withColumn("target_frame", F.col("_at")).drop("_at", "_bad", "_step")


def window_manifest(windows: DataFrame, labels: DataFrame, length: int, recording: str = "recording") -> DataFrame:
    """Rows of the window manifest: usable windows with their target's label counts. labels: labelled points."""
    counts = labels.groupBy(recording, "frame_index").agg(*[F.count_if(F.col("label") == code).alias(name) for name, code in (("unaffected_points", 0), ("impacted_points", 1), ("ignore_points", 255))])
    rows = windows.where("usable").join(counts, [recording, "frame_index"], "left").na.fill(0, ["unaffected_points", "impacted_points", "ignore_points"])
    return rows.select(
        recording, F.col("history_start").alias("history_start_frame"), "target_frame", F.lit(length).alias("sequence_length"), F.col("point_start").alias("target_point_start"),
        F.col("point_end").alias("target_point_end"), F.col("frame_time_s").alias("target_time_s"), "unaffected_points", "impacted_points", "ignore_points", F.lit("unassigned").alias("split"),
    )


def stride(df: DataFrame, step: int, index: str = "point_index") -> DataFrame:
    """Every step-th row by index."""
    return df.where(F.pmod(F.col(index), F.lit(max(1, step))) == 0)


def cap_points(frames: DataFrame, most: int | None, order: Sequence[str] = ("recording", "frame_index"), group: Sequence[str] = ()) -> DataFrame:
    """frames with kept and truncated: whole frames are kept while their points, summed in order, stay within most.

    Frames after the first that doesn't fit, or after the sum has reached most, are dropped. group: columns within which
    caps apply (each source by itself).
    """
    if most is None:
        return frames.withColumn("kept", F.lit(True)).withColumn("truncated", F.lit(False))
    if group:
        after = F.sum("n_points").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        rows = frames.withColumn("_after", after)
    else:
        rows = running_total(frames, order, "n_points", "_after")
    rows = rows.withColumn("_before", F.col("_after") - F.col("n_points"))
    rows = rows.withColumn("kept", (F.col("_before") < most) & (F.col("_after") <= most))
    dropped, reached = F.max((~F.col("kept")).cast("int")), F.max(F.when(F.col("kept"), F.col("_after")))
    cut = lambda d, r: (d == 1) | F.coalesce(r >= most, F.lit(False))
    if group:
        own = Window.partitionBy(*group)
        rows = rows.withColumn("truncated", cut(dropped.over(own), reached.over(own)))
    else:
        rows = rows.crossJoin(F.broadcast(rows.agg(cut(dropped, reached).alias("truncated"))))  # one row
    return rows.drop("_after", "_before")


def preview(df: DataFrame, most: int, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """A systematic sample of most rows a group: those at the truncated steps of an even grid from first to last.

    Without a group the whole table is one order, sorted by ranges.
    """
    own = Window.partitionBy(*group) if group else None
    if own is None:
        return _global_preview(df, most, order)
    n = F.count(F.lit(1)).over(own)
    rows = df.withColumn("_at", F.row_number().over(own.orderBy(*order)) - 1).withColumn("_n", n)
    return rows.where(_on_grid(F.col("_at"), F.col("_n"), most)).drop("_at", "_n")


def _on_grid(at: Column, n: Column, most: int) -> Column:
    """Whether at is floor(j * step) for some step of an even grid from 0 to n - 1, or all where n is at most most."""
    if most < 2:
        return at < most
    step = (n - 1) / F.lit(most - 1)
    j = F.ceil(at / step)
    near = [F.floor((j + d) * step) == at for d in (-1, 0, 1)]
    inside = [((j + d) >= 0) & ((j + d) <= most - 2) for d in (-1, 0, 1)]
    hit = (near[0] & inside[0]) | (near[1] & inside[1]) | (near[2] & inside[2])
    return (n <= most) | (at == n - 1) | hit


def _global_preview(df: DataFrame, most: int, order: Sequence[str]) -> DataFrame:
    """Rows of one total order at the grid's places. Places come from the sorted partitions' sizes, once."""
    n = df.count()
    if n <= most:
        return df
    # Numbers that ascend with a sorted table's partitions and within them; the partitions' sizes (one row each) make them gapless.
    numbered = staged(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_m", 33))
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")).select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    at = F.col("_base") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(base), "_part").where(_on_grid(at, F.lit(n), most)).select(*df.columns)


def time_chunks(frames: DataFrame, duration_s: float, start_s: float = 0.0, end_s: float | None = None, time: str = "relative_s") -> DataFrame:
    """frames in [start_s, end_s) with chunk (number of the tumbling window), chunk_start_s and chunk_end_s (the last is clipped)."""
    rows = frames.where(F.col(time) >= start_s)
    if end_s is not None:
        rows = rows.where(F.col(time) < end_s)
    rows = rows.withColumn("chunk", F.floor((F.col(time) - start_s) / duration_s).cast("int"))
    rows = rows.withColumn("chunk_start_s", F.lit(start_s) + F.col("chunk") * duration_s)
    end = F.col("chunk_start_s") + duration_s
    return rows.withColumn("chunk_end_s", end if end_s is None else F.least(end, F.lit(end_s)))


def chunk_bounds(start_s: float, end_s: float, duration_s: float) -> list[tuple[float, float]]:
    """Tumbling windows from start to end; the last may be shorter."""
    if duration_s <= 0 or end_s <= start_s:
        raise ValueError("duration and interval must be positive")
    out, at = [], start_s
    while at < end_s:
        out.append((at, min(end_s, at + duration_s)))
        at += duration_s
    return out


def relative_time(frames: DataFrame, time_ns: str = "time_ns", session: str = "session_id") -> DataFrame:
    """frames with relative_s: seconds since the session's first frame, whatever is filtered later."""
    return frames.withColumn("relative_s", (F.col(time_ns) - F.min(time_ns).over(Window.partitionBy(session))) / F.lit(1e9))


def calibration_split(frames: DataFrame, fraction: float, recording: str = "recording") -> DataFrame:
    """One row a recording: split_time_s, the time of frame max(1, min(F - 1, floor(F * fraction)))."""
    if not 0.2 <= fraction <= 0.8:
        raise ValueError("the fraction must lie in [0.2, 0.8]")
    own = Window.partitionBy(recording)
    rows = frames.withColumn("_at", F.row_number().over(own.orderBy("frame_index")) - 1).withColumn("_n", F.count(F.lit(1)).over(own))
    at = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(F.col("_n") * fraction)))
    return rows.where(F.col("_at") == at).select(recording, F.col("frame_time_s").alias("split_time_s"))


def first_frames(df: DataFrame, most: int, recording: str = "recording") -> DataFrame:
    """Rows of the first `most` frames of each recording."""
    own = df.select(recording, "frame_index").distinct()  # ranks need one row a frame, not the points
    kept = own.withColumn("_f", F.row_number().over(Window.partitionBy(recording).orderBy("frame_index"))).where(F.col("_f") <= most)
    return df.join(kept.drop("_f"), [recording, "frame_index"], "left_semi")


def across_files(points: DataFrame, recording: str, file: str = "recording") -> DataFrame:
    """The points of one recording's files as one recording: files follow by name, frames are numbered through, and time_s
    counts from the recording's first frame (message_time_ns)."""
    per_file = points.groupBy(F.col(file).alias("_file")).agg(F.max("frame_index").alias("_last"), F.min("message_time_ns").alias("_from"))
    before = Window.partitionBy(F.lit(1)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    base = per_file.select("_file", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_base"), F.min("_from").over(Window.partitionBy(F.lit(1))).alias("_origin"))
    rows = points.join(F.broadcast(base), F.col(file) == F.col("_file"))
    rows = rows.withColumn("frame_index", (F.col("frame_index") + F.col("_base")).cast("int")).withColumn("time_s", (F.col("message_time_ns") - F.col("_origin")) * F.lit(1e-9) + F.col("offset_s"))
    return rows.withColumn(file, F.lit(recording)).drop("_file", "_base", "_origin")


def point_offset(points: DataFrame, frames: DataFrame, recording: str = "recording", time: str = "time_s") -> DataFrame:
    """points with point_offset_s: their time less their frame's, as float32."""
    own = frames.select(recording, "frame_index", "frame_time_s")
    return points.join(own, [recording, "frame_index"]).withColumn("point_offset_s", (F.col(time) - F.col("frame_time_s")).cast("float"))
