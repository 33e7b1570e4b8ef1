"""Whole workflows, from points to datasets, splits and scores. Each is a few operators put together."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import apply_matrix, pose_matrix, vector
from ..functions.quantiles import linear_by
from ..functions.staging import staged
from ..models import scorer as models
from ..operators import datasets, directional, frames, metrics, nearest, poses, regions, splits, voxels
from ..sources import register
from ..sources.config import sha256_json, write_json
from ..sources.sinks import file_checksums, predictions, write_dataset, write_ply


@dataclass(frozen=True)
class StationaryConfig:
    """Labelling of stationary recordings against a clean reference."""

    bands: directional.BandConfig
    lookup: directional.LookupConfig = directional.LookupConfig()
    resolution_deg: float = 0.3
    minimum_range: float = 0.1
    maximum_range: float = 100.0
    calibration_fraction: float = 0.5
    sequence_length: int = 5
    max_gap_s: float = 0.25
    held_out_limit_percent: float = 0.2
    least_points: int = 1000


@dataclass
class StationaryResult:
    points: DataFrame
    windows: DataFrame
    summary: DataFrame
    reference: DataFrame
    bands: DataFrame
    warnings: list[str]


def label_stationary(reference: DataFrame, control: DataFrame, recordings: DataFrame, cfg: StationaryConfig) -> StationaryResult:
    """Labels recordings (points with recording, condition, frame_index, point_index, x, y, z, reflectivity, time_s).

    The reference's cells come from one clean recording; thresholds from the control's first part, the rest is held out;
    each part needs cfg.least_points points.
    control is also one of the labelled recordings (condition clean_control).
    """
    for name, part in (("reference", reference), ("control", control)):
        if part.select("recording", "frame_index").distinct().limit(2).count() < 2:
            raise ValueError(f"{name} has fewer than two frames")
    table = directional.build_reference(directional.with_cells(reference, cfg.resolution_deg)).persist()
    layout = frames.frame_layout(control)
    split = frames.calibration_split(layout, cfg.calibration_fraction)
    looked = directional.look_up(directional.with_cells(control, cfg.resolution_deg), table, cfg.lookup).join(F.broadcast(split), "recording")  # one row a recording
    first = F.coalesce(F.col("time_s") < F.col("split_time_s"), F.lit(False))
    sides = control.join(F.broadcast(split), "recording").agg(F.count_if(first).alias("first"), F.count_if(~first).alias("rest")).first()
    if min(sides) < cfg.least_points:
        raise ValueError(f"the control is too short: {sides['first']} points to calibrate and {sides['rest']} held out, not {cfg.least_points} each")
    bands = directional.calibrate(looked.where(first), cfg.bands).persist()
    points = recordings.unionByName(control.withColumn("condition", F.lit("clean_control")), allowMissingColumns=True)
    labelled = directional.label_residuals(directional.look_up(directional.with_cells(points, cfg.resolution_deg), table, cfg.lookup), bands, cfg.bands)
    labelled = directional.mask_invalid(labelled, directional.input_valid(cfg.minimum_range, cfg.maximum_range, "x", "y", "z"))
    layouts = frames.frame_layout(points)
    labelled = frames.point_offset(labelled, layouts)
    windows = frames.window_manifest(frames.history_windows(layouts, cfg.sequence_length, cfg.max_gap_s), labelled, cfg.sequence_length)
    held = F.coalesce(F.col("time_s") >= F.col("split_time_s"), F.lit(False))
    summary = directional.label_counts(labelled.join(F.broadcast(split), "recording", "left"), "recording", held)
    warnings = []
    if not bands.where("usable").take(1):
        warnings.append("no range band is usable")
    rate = summary.where("recording is null").select("held_out_percent_of_labelled").first()
    if rate and rate[0] is not None and rate[0] > cfg.held_out_limit_percent:
        warnings.append(f"{rate[0]} % of the held-out clean points are labelled as impacted")
    return StationaryResult(labelled, windows, summary, table, bands, warnings)


@dataclass(frozen=True)
class MovingConfig:
    """Labelling of moving recordings by distance from a map of stable voxels."""

    rules: regions.DistanceRules
    voxel_size: float = 0.05
    min_frames: int = 3
    minimum_range: float = 0.1
    maximum_range: float = 100.0
    isolation_distance: float = 0.0
    max_gap_ns: int = 250_000_000
    chunk_s: float = 60.0
    start_s: float = 0.0
    end_s: float | None = None
    frame_stride: int = 1
    point_stride: int = 1
    alignment: tuple[tuple[float, ...], ...] | None = None


def checked_trajectory(trajectory: DataFrame) -> DataFrame:
    """trajectory, if every session has two poses or more, in increasing time, finite and of one pair of frames."""
    problems = [r.asDict() for r in poses.pose_problems(trajectory).limit(5).collect()]
    if not problems and {"world_frame", "body_frame"} <= set(trajectory.columns):
        problems = [r.asDict() for r in poses.changing_frames(trajectory).limit(5).collect()]
    if problems:
        raise ValueError(f"not a usable trajectory: {problems}")
    return trajectory


def checked_transform(rows: DataFrame, parent: str, child: str) -> np.ndarray:
    """The static transform from child to parent as a matrix; one that is missing, or that changes, is an error."""
    row = poses.static_transform(rows, parent, child).first()
    if row is None or not row["consistent"]:
        raise ValueError(f"the transform from {child} to {parent} " + ("is missing" if row is None else f"changes by {row['spread']}"))
    return pose_matrix([row[c] for c in poses.POSE[:3]], [row[c] for c in poses.POSE[3:]])


def load_recording(spark: SparkSession, path: str, topic: str | None = None, point_stride: int = 1, max_points: int | None = None) -> tuple[DataFrame, bool]:
    """The points of a recording (all its files, as one), and whether max_points cut it.

    Whole frames are kept while their points stay within max_points; a recording without a complete frame is an error.
    """
    register(spark)
    options = {"stride": str(point_stride)} | ({"topic": topic} if topic else {})
    points = frames.across_files(spark.read.format("lidar_mcap").options(**options).load(path), Path(path.rstrip("/")).name.removesuffix(".mcap"))
    sizes = points.groupBy("recording", "frame_index").agg(F.count(F.lit(1)).alias("n_points"))
    capped = frames.cap_points(sizes, max_points).persist()
    kept, truncated = capped.where("kept"), bool(capped.where("truncated").take(1))
    if not kept.take(1):
        raise ValueError(f"{path} holds no complete frame" + (f" of {max_points} points at most" if max_points is not None else ""))
    return (points if not truncated else points.join(kept.select("recording", "frame_index"), ["recording", "frame_index"], "left_semi")), truncated


def frame_times(points: DataFrame) -> DataFrame:
    """One row a frame: session_id, frame_index, time_ns."""
    return points.select("session_id", "frame_index", F.col("header_time_ns").alias("time_ns")).distinct()


def _posed(points: DataFrame, trajectory: DataFrame, cfg: MovingConfig, times: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """points with world coordinates, and their frames with times and pose status. Frames before the first or after the last
    pose are left out; one in a gap between poses is an error. times: frame_times() of the session, if points are part of it."""
    timed = frames.relative_time(frame_times(points) if times is None else times)
    chosen = timed.where(F.col("relative_s") >= cfg.start_s)
    if cfg.end_s is not None:
        chosen = chosen.where(F.col("relative_s") < cfg.end_s)
    chosen = frames.stride(chosen, cfg.frame_stride, "frame_index")
    posed = staged(poses.at_times(chosen, checked_trajectory(trajectory), cfg.max_gap_ns))  # one row a frame, read by all that follows
    gaps = posed.where("pose_status = 'gap'").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("time_ns").alias("first")).limit(5).collect()
    if gaps:
        raise ValueError(f"frames lie in gaps of the trajectory: {[r.asDict() for r in gaps]}")
    moved = poses.to_world(points.withColumnsRenamed({"x": "sx", "y": "sy", "z": "sz"}).withColumnsRenamed({"ux": "x", "uy": "y", "uz": "z"}), posed)
    if cfg.alignment is not None:
        aligned = apply_matrix(np.array(cfg.alignment), vector("wx", "wy", "wz"))
        moved = moved.withColumns({n: c.cast("float") for n, c in zip(("_1", "_2", "_3"), aligned, strict=True)}).drop("wx", "wy", "wz").withColumnsRenamed({"_1": "wx", "_2": "wy", "_3": "wz"})
    return moved, posed


def reference_map(points: DataFrame, trajectory: DataFrame, cfg: MovingConfig) -> DataFrame:
    """Stable voxels of a clean session inside the crop: vx, vy, vz, support and centre. points: raw with ux, uy, uz."""
    moved, _ = _posed(frames.stride(points, cfg.point_stride), trajectory, cfg)
    inside = moved.where(cfg.rules.crop.holds())
    own = voxels.voxel_support(inside, cfg.voxel_size, cfg.min_frames, cfg.rules.crop.low, columns=("wx", "wy", "wz"))
    return own.withColumnsRenamed({"cx": "x", "cy": "y", "cz": "z"})


def label_moving(points: DataFrame, trajectory: DataFrame, reference: DataFrame, cfg: MovingConfig, times: DataFrame | None = None) -> DataFrame:
    """points with world coordinates, distance to the reference (exact in the covered volume, infinite outside it), labels
    and reasons, and the time chunk of their frame.

    The whole session is one pass; chunks are a column to partition the output by. times: see _posed().
    """
    moved, posed = _posed(points, trajectory, cfg, times)
    moved = moved.withColumn("range", F.sqrt(F.col("sx").cast("double") ** 2 + F.col("sy").cast("double") ** 2 + F.col("sz").cast("double") ** 2).cast("float"))
    moved = moved.withColumn("input_valid", directional.input_valid(cfg.minimum_range, cfg.maximum_range, "sx", "sy", "sz", "x", "y", "z"))
    key = ["session_id", "frame_index", "point_index"]
    alone = nearest.isolated(moved, cfg.isolation_distance, key, key[:2], "input_valid", ("sx", "sy", "sz")).withColumn("isolated", F.lit(True))
    moved = moved.join(alone, key, "left").withColumn("isolated", F.coalesce("isolated", F.lit(False))).withColumn("input_valid", F.col("input_valid") & ~F.col("isolated"))
    covered = moved.where(F.col("input_valid") & cfg.rules.crop.shrunk(cfg.rules.margin).holds())
    reach = max([cfg.rules.structure_max, cfg.rules.smoke_min, *[b.min_distance or 0.0 for b in cfg.rules.confirmed]])
    near = nearest.nearest_exact(covered, reference, reach, key, ("wx", "wy", "wz"))
    moved = moved.join(near.withColumnRenamed("distance", "nearest_distance"), key, "left").withColumn("nearest_distance", F.coalesce("nearest_distance", F.lit(float("inf"))).cast("float"))
    labelled = regions.classify(moved, cfg.rules, isolated="isolated")
    chunks = frames.time_chunks(posed.select("session_id", "frame_index", "relative_s"), cfg.chunk_s, cfg.start_s, cfg.end_s)
    return labelled.join(chunks.select("session_id", "frame_index", "chunk"), ["session_id", "frame_index"])


def chunk_report(labelled: DataFrame) -> DataFrame:
    """One row a session and time chunk of label_moving(): frames, points by label, and quantiles of the exact distances."""
    by = ["session_id", "chunk"]
    codes = (("unaffected", directional.UNAFFECTED), ("impacted", directional.IMPACTED), ("excluded", directional.EXCLUDED), ("ignored", directional.IGNORED))
    counts = labelled.groupBy(*by).agg(F.count_distinct("frame_index").alias("frames"), F.count(F.lit(1)).alias("points"), *[F.count_if(F.col("label") == c).alias(n) for n, c in codes])
    far = linear_by(labelled.where(F.col("nearest_distance") < float("inf")), by, "nearest_distance", {f"distance_p{str(q)[2:]}": q for q in (0.5, 0.9, 0.95, 0.99, 0.999)})
    return counts.join(far, by, "left")


def _content(df: DataFrame) -> list[str]:
    """Number of rows and the sum of their hashes: a mark of a table's content, whatever its order and files."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(20,0)")).alias("sum")).first()
    return [str(row["n"]), str(row["sum"])]


def label_session(path: str, points: DataFrame, trajectory: DataFrame, reference: DataFrame, cfg: MovingConfig, most_chunks: int | None = None) -> dict:
    """label_moving() written chunk by chunk below path, so that a run that stops goes on where it stopped.

    A chunk's points are written to points/chunk=<n>; then commits/<n>.json records what it was made from (a hash of the
    configuration and of the three tables' contents), its counts and its files with their checksums. A chunk with a record is
    not labelled again; what a stopped run left without one is overwritten. Records of other inputs or another configuration
    are an error. manifest.json says "running" and the chunks so far after each one, and "complete" at the end.
    most_chunks: chunks to label in this call; None: all. A chunk's job reads only points between the times of its frames.
    """
    spark, root = points.sparkSession, Path(path)
    tables = {"points": _content(points), "trajectory": _content(trajectory), "reference": _content(reference)}
    inputs = sha256_json({"config": json.loads(json.dumps(asdict(cfg), default=str)), "tables": tables})
    times = staged(frame_times(points))
    placed = frames.time_chunks(frames.relative_time(times), cfg.chunk_s, cfg.start_s, cfg.end_s)
    plan = placed.groupBy("chunk", "chunk_start_s", "chunk_end_s").agg(F.min("time_ns").alias("first"), F.max("time_ns").alias("last")).orderBy("chunk").collect()  # one row a chunk
    done: dict[int, dict] = {}
    for file in sorted((root / "commits").glob("*.json")):
        record = json.loads(file.read_text())
        if record["inputs_sha256"] != inputs:
            raise ValueError(f"{file} records other inputs or another configuration")
        done[record["chunk"]] = record

    def manifest(status: str) -> dict:
        own = [done[c] for c in sorted(done)]
        names = ("frames", "points", "unaffected", "impacted", "excluded", "ignored")
        value = {"status": status, "inputs_sha256": inputs, "tables": tables, "chunks": own, "totals": {k: sum(r[k] for c in own for r in c["sessions"]) for k in names}}
        write_json(root / "manifest.json", value)
        return value

    value = manifest("running")
    for r in [r for r in plan if r["chunk"] not in done][:most_chunks]:
        near = points.where(F.col("header_time_ns").between(r["first"], r["last"]))
        labelled = label_moving(near, trajectory, reference, replace(cfg, start_s=r["chunk_start_s"], end_s=r["chunk_end_s"]), times).drop("chunk")
        place = f"{path}/points/chunk={r['chunk']}"
        labelled.write.mode("overwrite").parquet(place)
        report = chunk_report(spark.read.schema(labelled.schema).parquet(place).withColumn("chunk", F.lit(r["chunk"]))).orderBy("session_id").collect()  # one row a session
        files = [f.asDict() for f in file_checksums(spark, place).orderBy("path").collect()]
        done[r["chunk"]] = {"chunk": r["chunk"], "inputs_sha256": inputs, "start_s": r["chunk_start_s"], "end_s": r["chunk_end_s"], "sessions": [x.asDict() for x in report], "files": files}
        write_json(root / "commits" / f"{r['chunk']}.json", done[r["chunk"]])
        value = manifest("running")
    return value if len(done) < len(plan) else manifest("complete")


def validate_clean(points: DataFrame, trajectory: DataFrame, reference: DataFrame, cfg: MovingConfig) -> DataFrame:
    """False positives of the rules on a clean interval, with exact distances for their quantiles."""
    moved, _ = _posed(points, trajectory, cfg)
    moved = moved.withColumn("range", F.sqrt(F.col("sx").cast("double") ** 2 + F.col("sy").cast("double") ** 2 + F.col("sz").cast("double") ** 2).cast("float"))
    moved = moved.withColumn("input_valid", directional.input_valid(cfg.minimum_range, cfg.maximum_range, "sx", "sy", "sz", "x", "y", "z"))
    key = ["session_id", "frame_index", "point_index"]
    covered = moved.where(F.col("input_valid") & cfg.rules.crop.holds())
    exact = nearest.nearest_exact(covered, reference, cfg.rules.smoke_min, key, columns=("wx", "wy", "wz"))
    joined = moved.join(exact.withColumnRenamed("distance", "nearest_distance"), key, "left").withColumn("nearest_distance", F.col("nearest_distance").cast("float"))
    return regions.clean_validation(joined, cfg.rules, key[:2])


def export_unified(path: str, stationary: DataFrame | None, moving: DataFrame | None) -> dict:
    """The canonical dataset of labelled recordings of both kinds, written with its manifest."""
    parts, times = [], []
    if stationary is not None:
        rows = stationary.withColumnRenamed("recording", "recording_id")
        parts.append(datasets.unify_stationary(rows))
        own = rows.groupBy("recording_id", "frame_index").agg(F.count(F.lit(1)).alias("n_points"), F.min("time_s").alias("_time"))
        times.append(datasets.rebased_frames(own, F.col("_time")).drop("_time"))
    if moving is not None:
        rows = datasets.training_export(moving)
        own = rows.groupBy("recording_id", "frame_index").agg(F.count(F.lit(1)).alias("n_points"), F.min("header_time_ns").alias("frame_time_ns"))
        parts.append(datasets.unify_moving(datasets.relative_ns(rows.withColumnRenamed("time_ns", "point_time_ns"), own)))
        times.append(datasets.rebased_ns(own).drop("frame_time_ns"))
    points = datasets.unify(parts)
    timed = datasets.unify([t.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in datasets.FRAMES]) for t in times])
    return write_dataset(path, points, timed)


def map_preview(path: str, reference: DataFrame, most: int = 200_000) -> dict[str, float]:
    """A PLY preview of a map, and its bounds."""
    sample = frames.preview(reference, most, ["vx", "vy", "vz"])
    write_ply(path, sample, extra=["support"])
    row = reference.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)]).first()
    return row.asDict()


def inspect(points: DataFrame) -> DataFrame:
    """One row a recording: frames, points, ranges, time span, and which fields are ever set."""
    r = F.sqrt(F.col("x").cast("double") ** 2 + F.col("y").cast("double") ** 2 + F.col("z").cast("double") ** 2)
    good = F.when(~F.isnan(r) & (r < float("inf")), r)
    middle = linear_by(points.select("recording", good.alias("_r")), ["recording"], "_r", {"range_median": 0.5})
    out = points.groupBy("recording").agg(
        F.count_distinct("frame_index").alias("frames"), F.count(F.lit(1)).alias("points"), F.min(good).alias("range_min"), F.max(good).alias("range_max"),
        (F.max("time_s") - F.min("time_s")).alias("span_s"), *[F.bool_or(F.col(c) != 0).alias(f"has_{c}") for c in ("reflectivity", "tag", "line")],
    )
    return out.join(middle, "recording", "left")


def split_plan(chunks: DataFrame, path: str | None = None, fractions: Sequence[float] = splits.FRACTIONS, purge: int = 20, domains: Sequence[str] | None = None) -> tuple[DataFrame, dict]:
    """(role, chunk_index, start, end), and the plan as signed JSON. chunks: chunk_index, domain, session, recording, frames, source_start_s."""
    if domains is not None:
        if not domains:
            raise ValueError("domains must not be empty")
        chunks = chunks.where(F.col("domain").isin(*domains))
    placed = splits.stream_frames(splits.stream_id(chunks)).persist()
    if not placed.take(1):
        raise ValueError("no chunk is of these domains")
    short = [r[0] for r in splits.too_short(placed, fractions, purge).select("stream_id").collect()]  # one row a stream
    if short:
        raise ValueError(f"too short for a purge of {purge}: {', '.join(sorted(short))}")
    roles = splits.assign_roles(placed, fractions, purge).withColumn("role", F.coalesce("role", F.lit("excluded")))
    ranges = splits.compact_ranges(roles, ["role", "chunk_index"], "frame")
    rows = ranges.orderBy("role", "chunk_index", "start").collect()  # a few ranges a chunk
    value = {"version": 1, "fractions": dict(zip(splits.ROLES, fractions, strict=True)), "purge_frames_each_side": purge, "ranges": [r.asDict() for r in rows]}
    if domains is not None:
        value["source_domains"] = sorted(domains)
    value["split_sha256"] = sha256_json(value)
    if path:
        write_json(path, value)
    placed.unpersist()
    return ranges.where("role <> 'excluded'"), value


def load_split_plan(chunks: DataFrame, value: Mapping) -> DataFrame:
    """The plan's ranges; a changed plan, overlapping roles or frames beyond their chunk are errors."""
    unsigned = {k: v for k, v in value.items() if k != "split_sha256"}
    if sha256_json(unsigned) != value.get("split_sha256"):
        raise ValueError("the plan's hash is wrong")
    plan = chunks.sparkSession.createDataFrame([(r["role"], r["chunk_index"], r["start"], r["end"]) for r in value["ranges"]], "role string, chunk_index long, start long, end long")
    problems = splits.role_conflicts(plan, chunks).limit(5).collect()
    if problems:
        raise ValueError(f"not a usable plan: {problems}")
    return plan.where("role <> 'excluded'")


def _usable(features: DataFrame) -> DataFrame:
    """features, if all of them are finite."""
    bad = [r.asDict() for r in voxels.unusable_features(features).limit(3).collect()]
    if bad:
        raise ValueError(f"features that aren't finite: {bad}")
    return features


def train_scorer(points: DataFrame, plan: DataFrame, voxel_size: float = 0.1, config: models.TrainConfig = models.TrainConfig(), checkpoint: str | None = None) -> tuple[models.Bundle, list[dict]]:
    """Features of each role's frames, then training. points: chunk_index, frame, x, y, z, intensity, label[, domain]."""
    placed = splits.role_points(points, plan)
    keys = ["role", "chunk_index", "frame", *[c for c in ("domain",) if c in points.columns]]
    features = _usable(voxels.voxel_features(placed, voxel_size, keys).persist())
    parts = {r: features.where(F.col("role") == r) for r in splits.ROLES[:3]}
    out = models.train(parts, voxel_size, config, ("chunk_index", "frame"), "domain" if "domain" in points.columns else None, checkpoint)
    features.unpersist()
    return out


def evaluate_scorer(points: DataFrame, plan: DataFrame, bundle: models.Bundle, role: str = "test", by: str | None = None) -> DataFrame:
    """The report of a role's labelled points, overall and by group; scores stay at voxel level until they are counted."""
    keys = ["role", "chunk_index", "frame", *([by] if by else [])]
    features = voxels.voxel_features(splits.role_points(points, plan.where(F.col("role") == role)), bundle.voxel_size, keys)
    scored = staged(bundle.predict(_usable(features)).where("n_pos + n_neg > 0").select(F.col("probability").cast("double").alias("score"), "n_pos", "n_neg", (F.col(by) if by else F.lit("all")).alias("domain")))
    if metrics.invalid_inputs(scored.withColumn("label", F.lit(0))).take(1):
        raise ValueError("the scorer gave scores that aren't finite")
    return metrics.report(scored, bundle.threshold, "domain", positive=F.col("n_pos"), negative=F.col("n_neg"))


def predict_points(points: DataFrame, bundle: models.Bundle, keys: Sequence[str] = ("recording", "frame_index")) -> DataFrame:
    """points with probability, reliability and predicted label by their voxel's score."""
    features = voxels.voxel_features(points, bundle.voxel_size, list(keys), labels="label" in points.columns)
    scored = voxels.scores_to_points(points, bundle.predict(features), bundle.voxel_size, list(keys), "probability")
    return predictions(scored, bundle.threshold)


def save_summary(path: str | Path, summary: DataFrame) -> None:
    """A small table as JSON."""
    write_json(path, [r.asDict(recursive=True) for r in summary.collect()])
