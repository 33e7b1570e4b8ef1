"""Hand-computed cases of the operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.functions import geometry, semantics
from pointloom.operators import datasets, directional, frames, metrics, nearest, poses, regions, splits, voxels


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def _fan(spark, ranges, recording="r"):
    n = len(ranges)
    angles = np.linspace(-0.01, 0.01, n)
    rows = [(i, float(np.float32(d * math.cos(a))), float(np.float32(d * math.sin(a))), 0.0, 20.0) for i, (d, a) in enumerate(zip(ranges, angles, strict=True))]
    return spark.createDataFrame(rows, "point_id long, x float, y float, z float, reflectivity float")


def _label(spark, reference, query, resolution, min_returns=3, spread=0.25):
    cfg = directional.BandConfig((0.0, 10.0), normal_q=0.95, early_q=0.99, min_normal=0.02, min_early=0.1, min_samples=10)
    table = directional.build_reference(directional.with_cells(_fan(spark, reference), resolution))
    lookup = directional.LookupConfig(min_returns, spread)
    bands = directional.calibrate(directional.look_up(directional.with_cells(_fan(spark, reference), resolution), table, lookup), cfg)
    out = directional.label_residuals(directional.look_up(directional.with_cells(_fan(spark, query), resolution), table, lookup), bands, cfg)
    return [tuple(r) for r in out.orderBy("point_id").select("label", "confidence").collect()]


def test_early_return(spark):
    got = _label(spark, [5.0] * 200, [5.0, 2.0, 5.02], 1.0)
    assert [g[0] for g in got] == [0, 1, 0] and got[1][1] > 0.9


def test_wide_cell_is_ignored(spark):
    cfg = directional.BandConfig((0.0, 10.0), min_samples=10)
    table = directional.build_reference(directional.with_cells(_fan(spark, [2.0, 5.0] * 100), 5.0))
    looked = directional.look_up(directional.with_cells(_fan(spark, [3.0]), 5.0), table)
    bands = spark.createDataFrame([(0, 10, 0.02, 0.1, True)], "band int, n long, normal_threshold double, early_threshold double, usable boolean")
    assert _rows(directional.label_residuals(looked, bands, cfg), "label") == [(255,)]


def test_uncertain_interval(spark):
    got = _label(spark, [5.0] * 300, [5.0, 4.97, 4.8], 1.0)
    assert [g[0] for g in got] == [0, 255, 1]


def test_bad_bands():
    with pytest.raises(ValueError):
        directional.BandConfig((0.0, 0.0))
    with pytest.raises(ValueError):
        directional.BandConfig((0.0, 1.0), normal_q=0.99, early_q=0.9)


def test_signed_zero_and_finite(spark):
    df = spark.sql("select -0.0D y, -1.0D x union all select 0.0D, -1.0D union all select double('NaN'), 1.0D")
    got = [r[0] for r in df.select(semantics.atan2_signed(F.col("y"), F.col("x"))).collect()]
    assert got[0] == -math.pi and got[1] == math.pi
    assert [r[0] for r in df.select(semantics.is_finite(F.col("y"))).collect()] == [True, True, False]


def _poses(spark):
    return spark.createDataFrame([("s", 1_000_000_000, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0), ("s", 1_100_000_000, 2.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "session_id string, time_ns long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")


def test_pose_between(spark):
    frame = spark.createDataFrame([("s", 0, 1_050_000_000), ("s", 1, 1_100_000_000), ("s", 2, 1_200_000_000), ("s", 3, 900_000_000)], "session_id string, frame_index int, time_ns long")
    posed = poses.at_times(frame, _poses(spark))
    assert _rows(posed, "frame_index", "pose_status") == [(0, "between"), (1, "exact"), (2, "outside"), (3, "outside")]
    points = spark.createDataFrame([("s", 0, 1.0, 0.0, 0.0)], "session_id string, frame_index int, x float, y float, z float")
    (got,) = _rows(poses.to_world(points, posed), "wx", "wy", "wz")
    assert np.allclose(got, (1, 1, 0), atol=1e-6)
    gap = poses.at_times(frame.where("frame_index = 0"), _poses(spark), max_gap_ns=50_000_000)
    assert _rows(gap, "pose_status") == [("gap",)]


def test_pose_problems_and_matrices(spark):
    assert poses.pose_problems(_poses(spark)).count() == 0
    assert np.allclose(geometry.pose_matrix((0, 0, 0), (0, 0, 0, 2)), np.eye(4))
    m = geometry.pose_matrix((1, 2, 3), (0.1, 0.2, 0.3, 0.9))
    assert np.allclose(geometry.compose(m, geometry.invert(m)), np.eye(4))
    with pytest.raises(ValueError):
        geometry.pose_matrix((0, 0, 0), (0, 0, 0, 0))


def test_isolation(spark):
    rows = [("r", 0, 0, 0.0, 0.0, 0.0), ("r", 0, 1, 0.1, 0.0, 0.0), ("r", 0, 2, 5.0, 5.0, 5.0), ("r", 1, 0, 0.0, 0.0, 0.0), ("r", 2, 0, 1.0, 1.0, 1.0), ("r", 2, 1, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "recording string, frame_index int, point_index int, x double, y double, z double")
    assert _rows(nearest.isolated(df, 0.5), "frame_index", "point_index") == [(0, 2), (1, 0)]
    assert nearest.isolated(df, 0.0).count() == 0


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(4)
    q, r = rng.normal(size=(60, 3)), np.concatenate([rng.normal(size=(40, 3)), [[50, 50, 50]]])
    frame = lambda a: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(a)], "id int, x double, y double, z double")
    got = dict(_rows(nearest.nearest_exact(frame(q), frame(r), 0.1, ["id"]), "id", "distance"))
    for i, v in enumerate(q):
        assert got[i] == pytest.approx(np.sqrt(((r - v) ** 2).sum(axis=1)).min())
    assert {r["distance"] for r in nearest.nearest_exact(frame(q), frame(r).limit(0), 0.1, ["id"]).collect()} == {None}
    assert nearest.nearest_exact(frame(q).limit(0), frame(r), 0.1, ["id"]).count() == 0


CROP = regions.Box("crop", (0, 0, 0), (10, 10, 2))
PERSON = regions.Box("person", (1.5, 1.5, 0), (2.5, 2.5, 2))
BAND = regions.Box("band", (4.5, 4.5, 0), (5.5, 5.5, 2))
LOW = regions.Box("band", (1.5, 1.5, 0), (2.5, 2.5, 2))


@pytest.mark.parametrize(
    "point, rules, want",
    [
        ((0.1, 5, 1), dict(excluded=(PERSON,), confirmed=(BAND,)), (255, 255, 2, -1, -1, False)),
        ((5, 5, 1), dict(excluded=(PERSON,), confirmed=(BAND,)), (1, 1, 0, -1, -1, True)),
        ((2, 2, 1), dict(excluded=(PERSON,), confirmed=(BAND,)), (254, 1, 4, 0, -1, True)),
        ((7, 7, 1), dict(confirmed=(BAND,)), (255, 1, 5, -1, -1, False)),
        ((7, 7, 1), dict(confirmed=(LOW,), hard_negative=(LOW,), background_reviewed=True), (0, 1, 6, -1, -1, True)),
        ((2, 2, 1), dict(confirmed=(LOW,), hard_negative=(LOW,), background_reviewed=True), (0, 1, 7, -1, 0, True)),
    ],
)
def test_distance_rules(spark, point, rules, want):
    df = spark.createDataFrame([(*map(float, point), 0.4, True)], "wx double, wy double, wz double, nearest_distance float, input_valid boolean")
    got = regions.classify(df, regions.DistanceRules(CROP, 0.5, 0.08, 0.25, **rules))
    assert _rows(got, "label", "automatic_label", "reason", "region_id", "hard_negative_id", "human_verified") == [want]


def test_invalid_ambiguous_and_isolated(spark):
    df = spark.createDataFrame([(1, 5.0, 0.1, True, False), (2, 5.0, 0.4, False, False), (3, 5.0, 0.4, False, True), (4, 5.0, 0.01, True, False), (5, 5.0, None, True, False)], "i int, wx double, nearest_distance float, input_valid boolean, alone boolean").withColumns({"wy": F.lit(5.0), "wz": F.lit(1.0)})
    got = regions.classify(df, regions.DistanceRules(CROP, 0.5, 0.08, 0.25), isolated="alone")
    assert _rows(got, "i", "label", "reason") == [(1, 255, 3), (2, 255, 1), (3, 255, 8), (4, 0, 0), (5, 255, 3)]
    with pytest.raises(ValueError):
        regions.enabled_boxes([{"min_m": [0, 0, 0], "max_m": [0, 1, 1]}])
    assert regions.enabled_boxes([{"enabled": False, "min_m": [0, 0, 0], "max_m": [0, 1, 1]}]) == []


def test_time_chunks():
    got = frames.chunk_bounds(0, 349, 60)
    assert len(got) == 6 and got[-1] == (300, 349)


def test_history_windows(spark):
    rows = [("a", i, 0.1 * i) for i in range(8)] + [("b", i, t) for i, t in enumerate([0.0, 0.1, 0.2, 1.0, 1.1, 1.2, 1.1])]
    df = spark.createDataFrame(rows, "recording string, frame_index int, frame_time_s double")
    got = frames.history_windows(df, 5, 0.25)
    assert got.where("recording = 'a' and usable").count() == 4
    assert got.where("recording = 'b' and usable").count() == 0
    assert frames.history_windows(df, 1, 0.25).where("usable").count() == 15


def test_frame_layout_fills_gaps(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 3.0), ("a", 2, 2.5)], "recording string, frame_index long, time_s double")
    assert _rows(frames.frame_layout(df), "frame_index", "n_points", "frame_time_s", "point_start", "point_end") == [(0, 1, 1.0, 0, 1), (1, 0, None, 1, 1), (2, 2, 2.5, 1, 3)]


def test_cap(spark):
    df = spark.createDataFrame([("a", i, 10) for i in range(5)], "recording string, frame_index int, n_points int")
    assert [r[0] for r in frames.cap_points(df, 30).orderBy("frame_index").select("kept").collect()] == [True] * 3 + [False] * 2
    assert frames.cap_points(df, 50).where("truncated").count() == 5
    assert frames.cap_points(df, 51).where("truncated").count() == 0


def test_preview_matches_grid(spark):
    df = spark.range(1003).withColumnRenamed("id", "i")
    want = sorted(set(np.linspace(0, 1002, 100).astype(int).tolist()))
    assert [r[0] for r in frames.preview(df, 100, ["i"]).orderBy("i").collect()] == want


def test_split_of_forty_frames(spark):
    df = spark.range(40).select(F.lit("s").alias("stream_id"), F.col("id").alias("position"))
    got = splits.assign_roles(df, purge=1)
    assert dict(_rows(got.where("role is not null").groupBy("role").count(), "role", "count")) == {"train": 21, "selection": 4, "calibration": 4, "test": 5}
    assert splits.too_short(df, purge=20).count() == 1
    assert splits.boundaries(3609) == [1984, 2526, 3067, 3609]
    with pytest.raises(ValueError):
        splits.assign_roles(df, (0.5, 0.5, 0.1, 0.1))


def test_plan_round_trip(spark, tmp_path):
    from pointloom.plans import workflows

    chunks = spark.createDataFrame([(0, "stationary", "s", "a", 60, None), (1, "moving", "m", "x", 30, 60.0), (2, "moving", "m", "y", 30, 0.0)], "chunk_index long, domain string, session string, recording string, frames long, source_start_s double")
    plan, value = workflows.split_plan(chunks, str(tmp_path / "plan.json"), purge=1)
    again = workflows.load_split_plan(chunks, value)
    assert _rows(plan, "role", "chunk_index", "start", "end") == _rows(again, "role", "chunk_index", "start", "end")
    assert plan.where("role = 'train' and chunk_index = 2").count() == 1  # the moving chunk that starts first
    with pytest.raises(ValueError):
        workflows.load_split_plan(chunks, value | {"purge_frames_each_side": 2})
    with pytest.raises(ValueError):
        workflows.split_plan(chunks, purge=20)
    bad = spark.createDataFrame([("train", 0, 0, 5), ("test", 0, 4, 6), ("test", 9, 0, 1)], "role string, chunk_index long, start long, end long")
    assert {r["problem"] for r in splits.role_conflicts(bad, chunks).collect()} == {"more than one role", "not in the chunk"}


def _table(spark, rows):
    return metrics.cumulated(metrics.by_score(spark.createDataFrame(rows, "label int, score double")))


def test_metrics(spark):
    perfect = _table(spark, [(0, 0.1), (1, 0.9), (0, 0.2), (1, 0.8)])
    assert metrics.average_precision(perfect).first()[0] == 1 and metrics.roc_auc(perfect).first()[0] == 1
    assert tuple(metrics.best_f1(perfect).first()) == (0.8, 1.0)
    ties = _table(spark, [(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)])
    assert metrics.average_precision(ties).first()[0] == 0.5
    none = _table(spark, [(0, 0.5)])
    assert metrics.average_precision(none).first()[0] is None and metrics.roc_auc(none).first()[0] is None and metrics.roc_curve(none).count() == 0
    bins = metrics.reliability(spark.createDataFrame([(1, 0.3), (0, 1.0)], "label int, score double"))
    assert _rows(bins, "bin", "points") == [(2, 1), (9, 1)]


def test_buckets_of_scores_agree_with_one(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(y), float(s), str(g)) for y, s, g in zip(rng.integers(0, 2, 800), rng.normal(size=800).round(2), rng.integers(0, 2, 800), strict=True)]
    steps = metrics.by_score(spark.createDataFrame(rows, "label int, score double, g string"), by=["g"])
    columns = ("g", "score", "tp", "fp", "positives", "negatives")
    one = _rows(metrics.cumulated(steps, ["g"]), *columns)
    monkeypatch.setattr(metrics, "SMALL", 10)
    monkeypatch.setattr(metrics, "BUCKETS", 16)
    assert _rows(metrics.cumulated(steps, ["g"]), *columns) == one


def test_voxels(spark):
    df = spark.createDataFrame([(0, 0.01, 10.0, 0), (0, 1.01, 30.0, 1), (0, 0.02, 20.0, 255)], "frame_index int, x float, intensity float, label int").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = voxels.voxel_features(df, 0.1)
    assert _rows(got, "vx", "n_points", "intensity_mean", "n_pos", "n_neg") == [(0, 2, 15.0, 0, 1), (10, 1, 30.0, 1, 0)]
    norm = voxels.normaliser(got).first()
    assert norm["y_mean_scale"] == 1.0 and norm["count"] == 2
    assert voxels.unusable_features(got).count() == 0


def test_canonical_dataset(spark, tmp_path):
    from pointloom.plans import workflows
    from pointloom.sources.config import read_manifest

    base = {"tag": F.lit(0), "line": F.lit(1), "x": F.lit(1.0), "y": F.lit(1.0), "z": F.lit(1.0), "session_id": F.lit("s"), "point_index": F.lit(0)}
    still = spark.createDataFrame([("a", 0, 20.0, 12.0, 0), ("a", 1, 20.1, 12.0, 1)], "recording string, frame_index int, time_s double, reflectivity float, label int").withColumns(base | {"condition": F.lit("clean_control"), "point_offset_s": F.lit(0.0)})
    moving = spark.createDataFrame([("m", 0, 1_000_000_000, 1_030_000_000, 34.0, 1), ("m", 1, 1_100_000_000, 1_140_000_000, 34.0, 254)], "recording_id string, frame_index int, header_time_ns long, time_ns long, intensity float, label int").withColumns(base | {"wx": F.lit(0.0)})
    value = workflows.export_unified(str(tmp_path / "out"), still, moving)
    assert value["totals"] == {"frames": 4, "points": 4, "unimpacted": 2, "smoke_impacted": 1, "ignore": 1}
    back = spark.read.parquet(str(tmp_path / "out/points"))
    assert "wx" not in back.columns
    assert [round(r[0], 3) for r in back.where("recording_id = 'm'").orderBy("frame_index").select("point_offset_s").collect()] == [0.03, 0.04]
    times = spark.read.parquet(str(tmp_path / "out/frames"))
    assert [round(r[0], 3) for r in times.orderBy("recording_id", "frame_index").select("frame_time_s").collect()] == [0.0, 0.1, 0.0, 0.1]
    assert read_manifest(spark, str(tmp_path / "out/manifest.json"), "1.0").count() == 2
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        workflows.export_unified(str(tmp_path / "out"), still, moving)
    assert datasets.schema_problems(still, datasets.POINTS)


def test_stationary_workflow(spark):
    from pointloom.plans import workflows

    angles = np.linspace(-0.4, 0.4, 300)

    def recording(name, smoky):
        rows = []
        for f in range(8):
            for i, a in enumerate(angles):
                d = 2.0 if smoky and i % 20 == 0 else 5.0
                rows.append((name, f, i, float(d * math.cos(a)), float(d * math.sin(a)), 0.0, 30.0, 0.1 * f + 0.09 * i / 299))
        return spark.createDataFrame(rows, "recording string, frame_index long, point_index int, x float, y float, z float, reflectivity float, time_s double").withColumns({"tag": F.lit(0), "line": F.lit(0)})

    cfg = workflows.StationaryConfig(directional.BandConfig((0.0, 10.0), normal_q=0.95, early_q=0.99, min_samples=10), directional.LookupConfig(3, 0.25), 1.0)
    out = workflows.label_stationary(recording("ref", False), recording("clean", False), recording("smoke", True).withColumn("condition", F.lit("smoke_test")), cfg)
    assert out.points.where("label = 1 and recording = 'smoke'").count() == 8 * 15
    assert out.windows.count() == 8 and out.windows.agg(F.min("target_frame")).first()[0] == 4
    assert out.warnings == []
    assert {r["recording"] for r in out.summary.collect()} == {"clean", "smoke", None}
    with pytest.raises(ValueError, match="900 points to calibrate and 900 held out"):
        workflows.label_stationary(recording("ref", False), recording("clean", False).where("frame_index < 6"), recording("smoke", True), cfg)


def test_far_queries_meet_few_points(spark):
    """A room of 120,000 wall and floor points: queries far from all of them are answered exactly, with few pairs."""
    rng = np.random.default_rng(11)
    n = 20_000
    sides = [rng.uniform((0, 0, 0), (12, 9, 3), (n, 3)) for _ in range(6)]
    for i, side in enumerate(sides):
        side[:, i // 2] = (0, (12, 9, 3)[i // 2])[i % 2]
    reference = np.concatenate([*sides, sides[0][:500]])  # with copies
    queries = np.concatenate([rng.uniform((2, 2, 1), (10, 7, 2), (150, 3)), rng.normal(0, 300, (40, 3)), reference[:30] + 0.01, [[6, 4.5, 1.5]] * 20])
    want = [float(np.sqrt(((reference - q) ** 2).sum(1)).min()) for q in queries]
    left = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(queries)] + [(900, float("nan"), 0.0, 0.0), (901, None, 0.0, 0.0)], "id int, x double, y double, z double")
    right = spark.createDataFrame(pd.DataFrame(reference, columns=["x", "y", "z"])).repartition(4)
    got = {r["id"]: r["distance"] for r in nearest.nearest_exact(left, right, 0.25, ["id"]).collect()}
    assert len(got) == len(want) + 2 and got[900] is None and got[901] is None
    assert np.allclose([got[i] for i in range(len(want))], want, rtol=1e-12, atol=1e-12)
    points = right.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate("xyz")]).distinct()
    edge, levels = nearest.pyramid(points, 0.25)
    cells = nearest.candidate_cells(left.where("id < 190").select(F.col("id").alias("_q"), *[F.col(c).alias(f"_q{i}") for i, c in enumerate("xyz")]), levels, edge)
    held = points.groupBy(*[c.alias(n) for n, c in zip(nearest._CELL, nearest._cells(["_r0", "_r1", "_r2"], edge), strict=True)]).count()
    pairs = [r[0] for r in cells.join(held, list(nearest._CELL)).groupBy("_q").agg(F.sum("count")).select(F.col("sum(count)")).collect()]
    assert len(pairs) == 190 and max(pairs) < 1500 and sum(pairs) / 190 < 300  # of 120,000


def test_nearest_without_reference(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id int, x double, y double, z double")
    assert nearest.nearest_exact(left, left.limit(0), 0.5, ["id"]).collect()[0]["distance"] is None
    assert nearest.nearest_exact(left.limit(0), left, 0.5, ["id"]).count() == 0
    one = spark.createDataFrame([(1, -7.0, 1e6, 3.0)], "id int, x double, y double, z double")
    assert nearest.nearest_exact(left, one, 0.5, ["id"]).collect()[0]["distance"] == pytest.approx((49 + 1e12 + 9) ** 0.5)


def test_quantiles_by_selection(spark):
    """All quantiles of two columns at once, against numpy: ties, huge and tiny values, both signs, infinities, gaps."""
    from pointloom.functions.quantiles import linear_columns

    rng = np.random.default_rng(12)
    groups = {
        "a": rng.normal(0, 1, 4000), "b": np.repeat([1.5, -2.0, 7.0], 300), "c": 10.0 ** rng.uniform(-300, 300, 3000) * rng.choice([-1, 1], 3000), "d": np.array([3.25]),
        "e": np.nextafter(1.0, 2.0) + np.arange(5000) * 2.0**-52, "f": np.concatenate((np.full(5, np.inf), np.zeros(7), np.full(5, -np.inf))), "g": np.arange(2000) * 5e-324, "h": np.float32(rng.normal(5, 1, 3000)).astype(float),
    }
    rows = [(g, float(v), -float(v) if i % 3 else None) for g, vs in groups.items() for i, v in enumerate(vs)]
    rows += [("a", None, None), ("a", float("nan"), float("nan")), (None, 1.0, 1.0), ("none", None, float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(4)
    qs = (0.0, 0.03, 0.5, 0.999, 1.0)
    wanted = {f"{c}{i}": (c, q) for c in "vw" for i, q in enumerate(qs)}
    got = {r["g"]: r for r in linear_columns(df, ["g"], wanted).collect()}
    assert set(got) == set(groups)
    for g in groups:
        for c, own in (("v", [v for k, v, _ in rows if k == g and v == v]), ("w", [w for k, _, w in rows if k == g and w is not None and w == w])):
            own = sorted(x for x in own if x is not None)
            for i, q in enumerate(qs):
                if not own:
                    assert got[g][f"{c}{i}"] is None
                    continue
                at = (len(own) - 1) * q
                low, high, share = own[math.floor(at)], own[math.ceil(at)], at - math.floor(at)
                want = low * (1 - share) + high * share
                assert got[g][f"{c}{i}"] == want or want != want, (g, c, q)
    whole = linear_columns(df, [], {"m": ("v", 0.5)}).collect()
    assert len(whole) == 1 and whole[0]["m"] == np.median([v for _, v, _ in rows if v is not None and v == v])
    assert linear_columns(df.limit(0), ["g"], wanted).count() == 0 and linear_columns(df.limit(0), [], wanted).collect()[0]["v0"] is None


def test_running_total_over_many_frames(spark):
    from pointloom.functions.scan import running_total

    df = spark.range(0, 300_000, 1, 8).select((F.col("id") % 7).cast("string").alias("recording"), F.col("id").alias("frame_index"), F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(50))).alias("n_points"))
    got = running_total(df, ["recording", "frame_index"], "n_points", "after")
    table = got.toPandas().sort_values(["recording", "frame_index"])
    assert (table.after.to_numpy() == table.n_points.fillna(0).cumsum().to_numpy()).all()
    spread = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 300_000  # no task holds them all
    assert running_total(df.limit(0), ["frame_index"], "n_points", "after").count() == 0
    capped = frames.cap_points(df.na.fill(0), 1_000_000)
    kept = table[table.after <= 1_000_000]
    assert capped.where("kept").count() == len(kept) and capped.where("not truncated").count() == 0


def test_many_boxes(spark):
    """10,000 boxes of sizes from centimetres to the whole scene, by cells; the same as branches for few of them."""
    rng = np.random.default_rng(13)
    low = rng.uniform(-60, 60, (10_000, 3))
    side = 10 ** rng.uniform(-1, 0.5, (10_000, 3))
    boxes = [regions.Box(str(i), tuple(map(float, a)), tuple(map(float, a + b))) for i, (a, b) in enumerate(zip(low, side, strict=True))]
    boxes[5] = regions.Box("all", (-100.0, -100.0, -100.0), (50.0, 100.0, 100.0))
    points = np.concatenate([rng.uniform(-80, 80, (600, 3)), low[:50], (low + side)[50:100]])
    rows = [(i, *map(float, p)) for i, p in enumerate(points)] + [(9000, float("nan"), 0.0, 0.0), (9001, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, wx double, wy double, wz double")
    a, b = np.array([x.low for x in boxes]), np.array([x.high for x in boxes])
    inside = [np.flatnonzero(((a <= p) & (p <= b)).all(axis=1)) for p in points]
    want = {i: int(x[-1]) if len(x) else -1 for i, x in enumerate(inside)} | {9000: -1, 9001: -1}
    got = regions.with_last_region(df, boxes, "region")
    assert got.columns == ["i", "wx", "wy", "wz", "region"] and dict(_rows(got, "i", "region")) == want
    few = boxes[:40]
    assert _rows(regions.with_last_region(df, few, "region"), "i", "region") == _rows(df.withColumn("region", regions.last_region(few)), "i", "region")
    rules = regions.DistanceRules(regions.Box("crop", (-70.0,) * 3, (70.0,) * 3), 0.5, 0.1, 0.25, excluded=tuple(boxes[:90]), hard_negative=tuple(boxes[90:120]))
    full = df.withColumn("nearest_distance", F.lit(0.4).cast("float")).withColumn("input_valid", F.lit(True))
    joined = sorted(map(str, regions.classify(full, rules).collect()))
    before, regions.BRANCHES = regions.BRANCHES, 1000
    try:
        assert sorted(map(str, regions.classify(full, rules).collect())) == joined
    finally:
        regions.BRANCHES = before
