"""The scorer, its calibration, and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.models import scorer as models
from pointloom.operators import directional, frames, metrics
from pointloom.plans import workflows
from pointloom.streaming import labels


def _points(spark):
    rows = [(0, f, k, 1 + 0.2 * k, 0.01 * f, 0.0, 120.0 if k == 1 else 10.0, (0, 1, 255, 0)[k]) for f in range(40) for k in range(4)]
    return spark.createDataFrame(rows, "chunk_index long, frame long, point_index int, x float, y float, z float, intensity float, label int")


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net, x = models.Scorer.fresh(11, (4, 3), 1), rng.normal(size=(6, 11))
    pos, neg = np.array([1, 0, 2, 0, 0, 1.0]), np.array([0, 3, 1, 0, 0, 2.0])
    _, gradients = net.gradients(x, pos, neg, 8.0)
    for value, g in zip(net.values(), gradients, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = value[at]
        value[at] = old + 1e-6
        up = net.gradients(x, pos, neg, 8.0)[0]
        value[at] = old - 1e-6
        down = net.gradients(x, pos, neg, 8.0)[0]
        value[at] = old
        assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-4)
    empty = net.gradients(x, pos * 0, neg * 0, 8.0)[1]
    assert all((g == 0).all() for g in empty)


def test_calibration(spark):
    df = spark.createDataFrame([(float(s), int(s > 0)) for s in (-3, -2, -1, 1, 2, 3)] + [(0.5, 0), (-0.5, 1)], "score double, label int")
    got = models.calibrate(metrics.by_score(df))
    assert got.slope > 0
    base = lambda a, b: sum(np.logaddexp(0, -(a * s + b)) if y else np.logaddexp(0, a * s + b) for s, y in df.collect())
    best = base(got.slope, got.bias)
    assert all(base(got.slope + d, got.bias + e) >= best - 1e-9 for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))
    with pytest.raises(ValueError):
        models.calibrate(metrics.by_score(df.where("label = 1")))


@pytest.mark.parametrize("workers", [1, 3])
def test_epoch_is_the_sequential_loop(spark, workers):
    """Summed gradients of all workers, step by step, against plain loops; one worker takes its frames one by one."""
    rng = np.random.default_rng(2)
    rows = [(c, f, *map(float, np.float32(rng.normal(size=len(models.FEATURES)))), int(rng.integers(0, 3)) * (f != 4), int(rng.integers(0, 5)) * (f != 4)) for c in range(2) for f in range(7) for _ in range(int(rng.integers(1, 6)))]
    columns = ["chunk_index", "frame", *models.FEATURES, "n_pos", "n_neg"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if i < 2 or i > len(columns) - 3 else 'double'}" for i, c in enumerate(columns)))
    config = models.TrainConfig(hidden=(6, 4), workers=workers, batch_frames=2, rate=0.01)
    net, adam = models.Scorer.fresh(len(models.FEATURES), config.hidden, 1), models.AdamW(config.rate, config.decay)
    got, state, loss = models.epoch(df, ["chunk_index", "frame"], 5, config, net, adam)
    parts = [p for p in models.dealt_frames(df, ["chunk_index", "frame"], 5, workers).withColumn("p", F.spark_partition_id()).toPandas().groupby("p")]
    queues = []
    for _, own in parts:
        frames = [own[(own.chunk_index == c) & (own.frame == f)] for c, f in own[["chunk_index", "frame"]].drop_duplicates().itertuples(index=False)]
        queues.append([np.concatenate([x[[*models.FEATURES, "n_pos", "n_neg"]].to_numpy(float) for x in frames[i : i + 2]]) for i in range(0, len(frames), 2)])
    assert sum(map(len, queues)) >= 7 and (workers == 1 or len(queues) > 1)
    losses = []
    while any(queues):
        batches = [q.pop(0) for q in queues if q]
        n = sum(b[:, -2:].sum() for b in batches)
        if n == 0:
            continue
        x = np.concatenate(batches)
        step, gradients = net.gradients(x[:, :-2], x[:, -2], x[:, -1], config.pos_weight)
        adam.update(net.values(), gradients)
        losses.append(step)
    assert state.step == adam.step == len(losses) and loss == pytest.approx(np.mean(losses))
    for a, b in zip([*got.values(), *state.first, *state.second], [*net.values(), *adam.first, *adam.second], strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-12)


def test_train_predict_resume(spark, tmp_path):
    points = _points(spark)
    chunks = spark.createDataFrame([(0, "stationary", "s", "a", 40, None)], "chunk_index long, domain string, session string, recording string, frames long, source_start_s double")
    plan, _ = workflows.split_plan(chunks, purge=1)
    config = models.TrainConfig(epochs=2, hidden=(8,), seed=3, rate=0.02)
    bundle, history = workflows.train_scorer(points, plan, 0.1, config, str(tmp_path / "c.npz"))
    assert [h["epoch"] for h in history] == [1, 2] and history[-1]["selection_ap"] is not None
    bundle.save(str(tmp_path / "b.json"))
    again = models.Bundle.load(str(tmp_path / "b.json"))
    out = workflows.predict_points(points.withColumnRenamed("frame", "frame_index"), again, ["chunk_index", "frame_index"])
    assert out.count() == points.count() and out.where("probability < 0 or probability > 1").count() == 0
    report = workflows.evaluate_scorer(points, plan, again)
    assert {r["group"] for r in report.collect()} == {"overall", "all"} and report.first()["points"] == 5 * 3
    _, more = workflows.train_scorer(points, plan, 0.1, models.TrainConfig(epochs=3, hidden=(8,), seed=3, rate=0.02), str(tmp_path / "c.npz"))
    assert len(more) == 3
    with pytest.raises(ValueError):
        models.load_checkpoint(str(tmp_path / "c.npz"), models.TrainConfig(hidden=(9,)), 0.1)


def test_streams(spark, tmp_path):
    rows = [("a", i, 0.1 * i) for i in range(8)]
    df = spark.createDataFrame(rows, "recording string, frame_index long, frame_time_s double").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = labels.frame_windows_stream(stream, 5, 0.25).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = sorted(tuple(r) for r in spark.table("windows").select("target_frame", "usable").collect())
    want = sorted((r["target_frame"], r["usable"]) for r in frames.history_windows(df, 5, 0.25).collect())
    assert got == want

    points = spark.createDataFrame([("a", 1.0, 2.0, 0.5, "2024-01-01 00:00:01"), ("a", 5.0, 0.0, 0.0, "2024-01-01 00:00:02")], "recording string, x float, y float, z float, t string").withColumn("event_time", F.col("t").cast("timestamp"))
    points.write.parquet(str(tmp_path / "points"))
    static = directional.with_cells(points, 1.0)
    reference = directional.build_reference(static.withColumn("reflectivity", F.lit(1.0).cast("float")))
    cfg = directional.BandConfig((0.0, 10.0), min_samples=1)
    bands = spark.createDataFrame([(0, 10, 0.02, 0.1, True)], "band int, n long, normal_threshold double, early_threshold double, usable boolean")
    labelled = labels.labelled_stream(spark.readStream.schema(points.schema).parquet(str(tmp_path / "points")), reference, bands, 1.0, directional.LookupConfig(1), cfg)
    q = labels.windowed_counts(labelled).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("counts").select("points", "unaffected").first()[:] == (2, 2)
