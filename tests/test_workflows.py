"""Moving sessions against brute force, checked inputs, and recordings of several files."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom import cli
from pointloom.functions.staging import staged
from pointloom.operators import frames, poses, regions
from pointloom.plans import workflows
from pointloom.sources import config, sinks
from tests.test_sources import _mcap, lidar_message

POSE = "session_id string, time_ns long, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
CROP = regions.Box("crop", (-4.0, -4.0, -4.0), (4.0, 4.0, 4.0))
RULES = regions.DistanceRules(CROP, 0.5, 0.3, 0.6)
CFG = workflows.MovingConfig(RULES, voxel_size=0.5, min_frames=2, minimum_range=0.1, chunk_s=0.2)


def _session(spark, seed, n=60, count=6):
    """points of a sensor that moves along x by 0.1 m a frame, and its poses."""
    rng = np.random.default_rng(seed)
    scene = rng.uniform(-5, 5, (n, 3)).astype(np.float32)
    rows = []
    for f in range(count):
        own = scene - np.array([0.1 * f, 0, 0], np.float32) + rng.normal(0, 0.01, scene.shape).astype(np.float32)
        rows += [("s", f, k, int(1e9 + 1e8 * f), *map(float, p), *map(float, p), 1.0, 0, 0) for k, p in enumerate(own)]
    points = spark.createDataFrame(rows, "session_id string, frame_index int, point_index long, header_time_ns long, x float, y float, z float, ux float, uy float, uz float, intensity float, tag int, line int")
    track = [("s", int(1e9 + 5e7 * i), 0.05 * i, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for i in range(-1, 2 * count)]
    return points, spark.createDataFrame(track, POSE)


def test_moving_session(spark, tmp_path):
    clean, track = _session(spark, 1)
    reference = staged(workflows.reference_map(clean, track, CFG))
    voxels = np.array([r[:] for r in reference.select("x", "y", "z").collect()], np.float64)
    assert len(voxels) and reference.where("support < 2").count() == 0
    points, _ = _session(spark, 2)
    odd = points.withColumn("x", F.when((F.col("point_index") == 3) & (F.col("frame_index") == 0), F.lit(float("nan"))).otherwise(F.col("x")))
    out = staged(workflows.label_moving(odd, track, reference, CFG))
    rows = out.collect()
    assert len(rows) == points.count()
    near = 0
    for r in rows:
        w = np.array([r["wx"], r["wy"], r["wz"]])
        assert r["chunk"] == r["frame_index"] // 2 and abs(r["wx"] - (r["x"] + 0.1 * r["frame_index"])) < 1e-4 or r["x"] != r["x"]
        if r["input_valid"] and (np.abs(w) <= 3.5).all():
            want = np.sqrt(((voxels - w) ** 2).sum(axis=1)).min()
            assert r["nearest_distance"] == pytest.approx(want, abs=1e-5)  # also beyond the thresholds
            near += want > 0.6
            assert r["label"] == (1 if r["nearest_distance"] >= np.float32(0.6) else 0 if r["nearest_distance"] <= np.float32(0.3) else 255)
        else:
            assert r["label"] == 255 and r["nearest_distance"] == float("inf")
    assert near > 10 and not [r for r in rows if r["frame_index"] == 0 and r["point_index"] == 3][0]["input_valid"]

    report = {r["chunk"]: r for r in workflows.chunk_report(out).collect()}
    for c in range(3):
        own = [r for r in rows if r["chunk"] == c]
        assert (report[c]["points"], report[c]["impacted"], report[c]["frames"]) == (len(own), sum(r["label"] == 1 for r in own), 2)
        far = [r["nearest_distance"] for r in own if r["nearest_distance"] < float("inf")]
        assert report[c]["distance_p9"] == pytest.approx(np.percentile(far, 90))

    found = workflows.validate_clean(points, track, reference, CFG).first()
    assert found["frames"] == 6 and found["points"] == len(rows) and 0 < found["global_false_positives"] <= found["covered_points"]
    bounds = workflows.map_preview(str(tmp_path / "map.ply"), reference, 20)
    text = (tmp_path / "map.ply").read_text()
    assert "element vertex 20" in text and bounds["min_x"] == pytest.approx(voxels[:, 0].min())


def test_session_is_resumed(spark, tmp_path):
    """A run that stops after a chunk goes on without redoing it, and ends as one that didn't stop."""
    clean, track = _session(spark, 1)
    reference = staged(workflows.reference_map(clean, track, CFG))
    points, _ = _session(spark, 2)
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    want = workflows.label_session(whole, points, track, reference, CFG)
    first = workflows.label_session(parts, points, track, reference, CFG, most_chunks=1)
    assert want["status"] == "complete" and first["status"] == "running" and [c["chunk"] for c in first["chunks"]] == [0]
    # A chunk that was being written when the run stopped has no record.
    left = tmp_path / "parts" / "points" / "chunk=1"
    left.mkdir()
    (left / "part-0.parquet").write_bytes(b"half")
    got = workflows.label_session(parts, points, track, reference, CFG)
    assert got["chunks"][0] == first["chunks"][0]  # the same files
    slim = lambda m: [{k: v for k, v in c.items() if k != "files"} for c in m["chunks"]]
    assert slim(got) == slim(want) and {k: v for k, v in got.items() if k != "chunks"} == {k: v for k, v in want.items() if k != "chunks"}
    assert json.loads((tmp_path / "parts" / "manifest.json").read_text()) == got
    labelled = staged(workflows.label_moving(points, track, reference, CFG))
    columns = ["chunk", "session_id", "frame_index", "point_index", "label", "nearest_distance", "wx", "wy", "wz"]
    for path in (whole, parts):
        assert sorted(map(tuple, spark.read.parquet(f"{path}/points").select(columns).collect())) == sorted(map(tuple, labelled.select(columns).collect()))
    with pytest.raises(ValueError, match="another configuration"):
        workflows.label_session(parts, points, track, reference, replace(CFG, voxel_size=0.4))
    with pytest.raises(ValueError, match="other inputs"):
        workflows.label_session(parts, points.where("point_index > 0"), track, reference, CFG)


def test_trajectories_are_checked(spark):
    points, track = _session(spark, 3, 5)
    reference = spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")
    gap = track.where("time_ns < 1100000000 or time_ns > 1400000000")
    with pytest.raises(ValueError, match="gaps"):
        workflows.label_moving(points, gap, reference, CFG)
    for bad, why in (
        (track.limit(1), "fewer than two"),
        (track.withColumn("qw", F.lit(0.0)), "zero quaternion"),
        (track.withColumn("tx", F.lit(float("nan"))), "not finite"),
        (track.unionByName(track.limit(1)), "increase"),
        (track.withColumns({"world_frame": F.col("time_ns").cast("string"), "body_frame": F.lit("b")}), "world_frames"),
    ):
        with pytest.raises(ValueError, match=why):
            workflows.label_moving(points, bad, reference, CFG)
    rows = spark.createDataFrame([(0, "a", "b", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, "a", "b", 1.5, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (2, "a", "c", 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "seq long, parent string, child string, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    assert workflows.checked_transform(rows, "a", "c")[0, 3] == 2.0
    for child in ("b", "none"):
        with pytest.raises(ValueError):
            workflows.checked_transform(rows, "a", child)


def test_long_gaps_are_few_rows(spark):
    """A gap of years between two poses, and a frame in the middle of it."""
    year = 365 * 86400 * 10**9
    track = spark.createDataFrame([("s", 0, *[0.0] * 6, 1.0), ("s", 10**9, 1.0, *[0.0] * 5, 1.0), ("s", 3 * year, 2.0, *[0.0] * 5, 1.0)], POSE)
    asked = spark.createDataFrame([("s", i, t) for i, t in enumerate((0, 5 * 10**8, 10**9, year, 3 * year, 3 * year + 1, -1))], "session_id string, frame_index int, time_ns long")
    out = {r["frame_index"]: (r["pose_status"], r["tx"]) for r in poses.at_times(asked, track, 2 * 10**9).collect()}
    assert out == {0: ("exact", 0.0), 1: ("between", 0.5), 2: ("exact", 1.0), 3: ("gap", None), 4: ("exact", 2.0), 5: ("outside", None), 6: ("outside", None)}


def test_recording_of_several_files(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "run_0.mcap").write_bytes(_mcap([lidar_message(timebase=10**9), lidar_message(timebase=2 * 10**9)], True))
    (tmp_path / "run" / "run_1.mcap").write_bytes(_mcap([lidar_message(timebase=3 * 10**9)], False))
    points, truncated = workflows.load_recording(spark, str(tmp_path / "run"))
    got = sorted((r["recording"], r["frame_index"], round(r["time_s"], 6)) for r in points.collect())
    assert not truncated and got == [("run", f, float(f) + k * 1e-6) for f in range(3) for k in (1, 2)]
    points, truncated = workflows.load_recording(spark, str(tmp_path / "run"), max_points=5)
    assert truncated and sorted({r["frame_index"] for r in points.collect()}) == [0, 1]
    with pytest.raises(ValueError):
        workflows.load_recording(spark, str(tmp_path / "run"), max_points=1)


def test_dataset_is_verified(spark, tmp_path):
    from pointloom.operators import datasets

    rows = [(datasets.VERSION, "s", "moving", "r 1", "smoke", f, k) for f in range(3) for k in range(4)]
    base = spark.createDataFrame(rows, "schema_version string, session_id string, source_domain string, recording_id string, condition string, frame_index int, point_index long")
    extra = {c: F.lit(0.5) for c in ("x", "y", "z", "intensity", "point_offset_s")} | {c: F.lit(0) for c in ("tag", "line", "label")}
    typed = lambda df, schema: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    points = typed(base.withColumns(extra), datasets.POINTS)
    timed = typed(base.groupBy("recording_id", "frame_index").agg(F.count(F.lit(1)).alias("n_points")).withColumn("frame_time_s", F.col("frame_index") * 0.1), datasets.FRAMES)
    path = tmp_path / "data"
    sinks.write_dataset(str(path), points, timed)
    (row,) = config.read_manifest(spark, str(path / "manifest.json"), datasets.VERSION, verify=True).collect()
    assert (row["points"], row["frames"], row["unimpacted"]) == (12, 3, 12)
    value = json.loads((path / "manifest.json").read_text())
    file = path / value["chunks"][0]["files"][0]["path"]
    (file.parent / f".{file.name}.crc").unlink()
    file.write_bytes(file.read_bytes() + b"x")
    with pytest.raises(ValueError, match="checksum"):
        config.read_manifest(spark, str(path / "manifest.json"), datasets.VERSION, verify=True)
    with pytest.raises(FileExistsError):
        sinks.write_dataset(str(path), points, timed)


def test_frames_and_previews(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).repartition(5)
    got = sorted(r["k"] for r in frames.preview(df, 50, ["k"]).collect())
    assert got == sorted({int(j * 999 / 49) for j in range(49)} | {999})
    assert frames.preview(df, 1, ["k"]).first()["k"] == 0 and frames.preview(df, 2000, ["k"]).count() == 1000


def test_command_line(spark, tmp_path, capsys):
    from tests.test_models import _points

    points = _points(spark)
    points.write.parquet(str(tmp_path / "points.parquet"))
    chunks = spark.createDataFrame([(0, "stationary", "s", "a", 40, None)], "chunk_index long, domain string, session string, recording string, frames long, source_start_s double")
    chunks.write.parquet(str(tmp_path / "chunks.parquet"))
    paths = {n: str(tmp_path / n) for n in ("points.parquet", "chunks.parquet", "plan.json", "bundle.json", "report.json", "out")}
    assert cli.main(["split", paths["chunks.parquet"], paths["plan.json"], "--purge", "1"]) == 0
    common = ["--points", paths["points.parquet"], "--chunks", paths["chunks.parquet"], "--plan", paths["plan.json"]]
    assert cli.main(["train", *common, "--epochs", "1", "--output", paths["bundle.json"]]) == 0
    assert cli.main(["evaluate", *common, "--bundle", paths["bundle.json"], "--output", paths["report.json"]]) == 0
    report = json.loads((tmp_path / "report.json").read_text())
    assert {r["group"] for r in report} == {"overall", "all"} and all(r["points"] == 15 for r in report)
    spark.read.parquet(paths["points.parquet"]).withColumnRenamed("frame", "frame_index").drop("label").write.parquet(str(tmp_path / "new.parquet"))
    assert cli.main(["predict", "--points", str(tmp_path / "new.parquet"), "--bundle", paths["bundle.json"], "--keys", "chunk_index,frame_index", "--output", paths["out"]]) == 0
    out = spark.read.parquet(paths["out"])
    assert out.count() == points.count() and out.where("source_label is not null").count() == 0
    record = json.loads((tmp_path / "bundle.json.provenance.json").read_text())
    assert record["status"] == "complete" and len(record["config_sha256"]) == 64
    assert cli.main(["evaluate", *common, "--bundle", paths["plan.json"], "--output", paths["report.json"]]) == 2
