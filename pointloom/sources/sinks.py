"""Sinks: PLY clouds, JSON lines, the canonical dataset with its manifest, and predictions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets
from .config import write_json

#: Colours of labels in previews.
COLOURS = {0: (70, 130, 180), 1: (220, 60, 40), 254: (150, 80, 180), 255: (150, 150, 150)}


def ply_rows(df: DataFrame, columns: Sequence[str] = ("x", "y", "z"), colour: Sequence[Column] | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """One text line a point: coordinates with five decimals, colour and further integers."""
    parts = [F.format_string("%.5f", F.col(c).cast("double")) for c in columns]
    parts += [c.cast("int").cast("string") for c in colour or ()] + [F.col(c).cast("long").cast("string") for c in extra]
    return df.select(F.concat_ws(" ", *parts).alias("value"))


def write_ply(path: str, df: DataFrame, columns: Sequence[str] = ("x", "y", "z"), colour: Sequence[Column] | None = None, extra: Sequence[str] = ()) -> int:
    """An ASCII PLY file of a preview: rows come to the driver one partition at a time. Returns their number."""
    rows = ply_rows(df, columns, colour, extra).persist()
    n = rows.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property float {c}" for c in "xyz"]]
    head += [f"property uchar {c}" for c in ("red", "green", "blue")] if colour else []
    head += [f"property int {c}" for c in extra] + ["end_header"]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="ascii") as f:
        f.write("\n".join(head) + "\n")
        for r in rows.toLocalIterator():
            f.write(r["value"] + "\n")
    rows.unpersist()
    return n


def label_colour(label: Column) -> list[Column]:
    out = []
    for i in range(3):
        c = F.lit(128)
        for code, rgb in COLOURS.items():
            c = F.when(label == code, rgb[i]).otherwise(c)
        out.append(c)
    return out


def support_colour(support: Column, most: int) -> list[Column]:
    """A ramp from blue to red over log(1 + support)."""
    share = F.least(F.log1p(support.cast("double")) / F.log1p(F.lit(float(max(most, 1)))), F.lit(1.0))
    return [F.rint(255 * share), F.lit(80), F.rint(255 * (1 - share))]


def write_json_lines(path: str, df: DataFrame) -> None:
    df.write.mode("errorifexists").json(path)


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the Parquet files below a folder; path: from that folder on."""
    files = datasets.checksums(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path))
    return files.select(F.substring_index("path", f"/{path.rstrip('/').rsplit('/', 1)[-1]}/", -1).alias("path"), "sha256")


def write_dataset(path: str, points: DataFrame, frames: DataFrame) -> dict:
    """The canonical dataset as Parquet by domain, session and recording, with a JSON manifest once all is written.

    The folder must not exist. Broken rules are an error before anything is written. The manifest says "running" until the
    end; then it lists each chunk's files with their checksums.
    """
    problems = datasets.schema_problems(points, datasets.POINTS)
    broken = [] if problems else [r.asDict() for r in datasets.violations(points, frames).limit(20).collect()]
    if problems or broken:
        raise ValueError(f"not a canonical dataset: {problems or broken}")
    if Path(path).exists():
        raise FileExistsError(f"{path} already exists")
    write_json(Path(path) / "manifest.json", {"schema_version": datasets.VERSION, "status": "running"})
    points.write.mode("errorifexists").partitionBy("source_domain", "session_id", "recording_id").parquet(f"{path}/points")
    frames.write.mode("errorifexists").parquet(f"{path}/frames")
    chunks = [r.asDict() for r in datasets.manifest(points, frames).orderBy("chunk_index").collect()]  # one row a recording
    files: dict[str, list[dict]] = {}
    for r in file_checksums(points.sparkSession, f"{path}/points").orderBy("path").collect():  # one row a file
        files.setdefault("points/" + unquote(r["path"].rsplit("/", 1)[0]), []).append({"path": f"points/{r['path']}", "sha256": r["sha256"]})
    labels = ("unimpacted", "smoke_impacted", "ignore")
    place = lambda c: f"points/source_domain={c['source_domain']}/session_id={c['session_id']}/recording_id={c['recording_id']}"
    value = {
        "schema_version": datasets.VERSION,
        "status": "complete",
        "denied_model_inputs": list(datasets.DENIED),
        "chunks": [{k: v for k, v in c.items() if k not in labels} | {"path": place(c), "files": files.get(place(c), []), "labels": {k: c[k] for k in labels}} for c in chunks],
        "totals": {k: sum(c[k] for c in chunks) for k in ("frames", "points", *labels)},
    }
    write_json(Path(path) / "manifest.json", json.loads(json.dumps(value)))
    return value


def predictions(points: DataFrame, threshold: float, probability: str = "probability") -> DataFrame:
    """Scored points as they are kept: probability, reliability (1 - probability), the predicted label and the given one."""
    p = F.col(probability)
    given = F.col("label") if "label" in points.columns else F.lit(None).cast("short")
    return points.select("frame_index", "point_index", "x", "y", "z", p.cast("float").alias("probability"), (1 - p).cast("float").alias("reliability"), (p >= threshold).cast("short").alias("predicted_label"), p.isNotNull().alias("valid"), given.alias("source_label"))
