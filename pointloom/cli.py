"""Command line: python -m pointloom.cli COMMAND ..., over tables and recordings."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .models import scorer as models
from .operators.directional import BandConfig
from .plans import workflows
from .sources.config import load_toml, provenance, write_json


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pointloom")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("inspect", help="what a recording holds")
    one.add_argument("path")
    label = sub.add_parser("label", help="label stationary recordings")
    for name in ("reference", "control", "recordings", "output", "config"):
        label.add_argument(f"--{name}", required=True)
    split = sub.add_parser("split", help="a chronological, purged split of a dataset's chunks")
    split.add_argument("chunks")
    split.add_argument("output")
    split.add_argument("--purge", type=int, default=20)
    split.add_argument("--domain", action="append")
    for name, what in (("train", "train a scorer on a dataset's split"), ("evaluate", "the report of a role's points"), ("predict", "score points")):
        one = sub.add_parser(name, help=what)
        one.add_argument("--points", required=True)
        one.add_argument("--output", required=True)
        if name != "predict":
            one.add_argument("--chunks", required=True)
            one.add_argument("--plan", required=True)
        if name != "train":
            one.add_argument("--bundle", required=True)
        else:
            one.add_argument("--voxel-size", type=float, default=0.1)
            one.add_argument("--epochs", type=int, default=models.TrainConfig().epochs)
            one.add_argument("--checkpoint")
        if name == "evaluate":
            one.add_argument("--role", default="test")
            one.add_argument("--by")
        if name == "predict":
            one.add_argument("--keys", default="recording,frame_index")
    for one in set(sub.choices.values()) - {split}:
        one.add_argument("--topic", help="of a recording's messages; without it, the first one met")
        one.add_argument("--max-points", type=int, help="whole frames of a recording are kept while they stay within it")
    return p


def _model_command(spark: SparkSession, a: argparse.Namespace) -> None:
    points = _recording(spark, a.points, a)
    if a.command == "predict":
        workflows.predict_points(points, models.Bundle.load(a.bundle), a.keys.split(",")).write.parquet(a.output)
        return
    plan = workflows.load_split_plan(spark.read.parquet(a.chunks), json.loads(Path(a.plan).read_text()))
    if a.command == "evaluate":
        workflows.save_summary(a.output, workflows.evaluate_scorer(points, plan, models.Bundle.load(a.bundle), a.role, a.by))
        return
    config = models.TrainConfig(epochs=a.epochs)
    record = f"{a.output}.provenance.json"
    made = provenance({"voxel_size": a.voxel_size, "epochs": a.epochs}, [a.plan])
    write_json(record, made | {"status": "running"})
    bundle, history = workflows.train_scorer(points, plan, a.voxel_size, config, a.checkpoint)
    bundle.save(a.output)
    write_json(record, made | {"status": "complete", "history": history})


def _recording(spark: SparkSession, path: str, a: argparse.Namespace):
    """The points of a table, or of a recording: all its files as one."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    points, truncated = workflows.load_recording(spark, path, a.topic, max_points=a.max_points)
    if truncated:
        print(f"{path}: only the first frames, of {a.max_points} points at most", file=sys.stderr)
    return points


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("pointloom").getOrCreate()
    try:
        if a.command == "inspect":
            workflows.inspect(_recording(spark, a.path, a)).show(truncate=False)
        elif a.command == "label":
            c = load_toml(a.config)
            cfg = workflows.StationaryConfig(BandConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in c["bands"].items()}), **c.get("stationary", {}))
            rows = _recording(spark, a.recordings, a)
            out = workflows.label_stationary(_recording(spark, a.reference, a), _recording(spark, a.control, a), rows if "condition" in rows.columns else rows.withColumn("condition", F.lit("smoke_test")), cfg)
            out.points.write.partitionBy("recording").parquet(f"{a.output}/points")
            out.windows.write.json(f"{a.output}/windows")
            workflows.save_summary(f"{a.output}/summary.json", out.summary)
            print(json.dumps({"warnings": out.warnings}))
        elif a.command == "split":
            workflows.split_plan(spark.read.parquet(a.chunks), a.output, purge=a.purge, domains=a.domain)
        else:
            _model_command(spark, a)
    except (ValueError, KeyError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
