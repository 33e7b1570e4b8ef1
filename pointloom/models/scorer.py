"""A small multilayer scorer over voxel features.

All points of a voxel share its score, so training and calibration use one row a voxel with its counts of labelled
points as weights. An epoch is one barrier stage: its tasks stream their frames, sum their gradients in every step, and apply
the same update to the same weights, so the driver sees weights and sums only. Inference is an Arrow function.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import sigmoid
from ..operators import metrics
from ..operators.voxels import FEATURES
from ..sources.config import write_json


@dataclass
class Scorer:
    """Linear layers with ReLU between them; the last gives one logit."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]

    @classmethod
    def fresh(cls, inputs: int, hidden: Sequence[int] = (64, 32), seed: int = 0) -> Scorer:
        rng = np.random.default_rng(seed)
        sizes = [inputs, *hidden, 1]
        bound = [1 / np.sqrt(a) for a in sizes[:-1]]
        return cls(
            [rng.uniform(-k, k, (a, b)) for k, a, b in zip(bound, sizes[:-1], sizes[1:], strict=True)],
            [rng.uniform(-k, k, b) for k, b in zip(bound, sizes[1:], strict=True)],
        )

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Activations of every layer; the last are the logits as a column."""
        out = [np.asarray(x, np.float64)]
        for i, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            z = out[-1] @ w + b
            out.append(z if i == len(self.weights) - 1 else np.maximum(z, 0))
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1][:, 0]

    def gradients(self, x: np.ndarray, n_pos: np.ndarray, n_neg: np.ndarray, pos_weight: float) -> tuple[float, list[np.ndarray]]:
        """Mean weighted log loss over labelled points, and its gradients (weights, then biases). Ignored points have none."""
        layers = self.forward(x)
        z = layers[-1][:, 0]
        n = max(float(n_pos.sum() + n_neg.sum()), 1.0)
        loss = float((pos_weight * n_pos * np.logaddexp(0, -z) + n_neg * np.logaddexp(0, z)).sum()) / n
        p = 0.5 * (1 + np.tanh(z / 2))
        d = ((n_neg * p - pos_weight * n_pos * (1 - p)) / n)[:, None]
        dw: list[np.ndarray] = []
        db: list[np.ndarray] = []
        for i in reversed(range(len(self.weights))):
            dw.append(layers[i].T @ d)
            db.append(d.sum(axis=0))
            if i:
                d = (d @ self.weights[i].T) * (layers[i] > 0)
        return loss, [*reversed(dw), *reversed(db)]

    def values(self) -> list[np.ndarray]:
        return [*self.weights, *self.biases]


@dataclass
class AdamW:
    rate: float = 1e-3
    decay: float = 1e-4
    step: int = 0
    first: list[np.ndarray] = field(default_factory=list)
    second: list[np.ndarray] = field(default_factory=list)

    def update(self, values: list[np.ndarray], gradients: list[np.ndarray], clip: float = 1.0) -> None:
        """One step in place; gradients longer than clip (all together) are shortened to it."""
        norm = float(np.sqrt(sum((g * g).sum() for g in gradients)))
        if not np.isfinite(norm):
            raise FloatingPointError("gradients aren't finite")
        scale = min(1.0, clip / (norm + 1e-6))
        if not self.first:
            self.first, self.second = ([np.zeros_like(v) for v in values] for _ in range(2))
        self.step += 1
        for v, g, m, s in zip(values, gradients, self.first, self.second, strict=True):
            g = g * scale
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v *= 1 - self.rate * self.decay
            v -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.999**self.step)) + 1e-8)


@dataclass(frozen=True)
class TrainConfig:
    """A step takes batch_frames frames of each worker; workers: tasks of an epoch at most (all run at once, and every step
    sends each of them all workers' sums, some 30 kB a worker at the default layers)."""

    epochs: int = 30
    patience: int = 5
    rate: float = 1e-3
    decay: float = 1e-4
    pos_weight: float = 8.0
    hidden: tuple[int, ...] = (64, 32)
    seed: int = 0
    batch_frames: int = 1
    max_hours: float = 4.0
    workers: int = 8


def dealt_frames(features: DataFrame, keys: Sequence[str], seed: int, workers: int) -> DataFrame:
    """(keys, features, n_pos, n_neg) with whole frames dealt to so many partitions, there in a seeded order: by the first
    key (chunks), then within it."""
    order = [c for i, k in enumerate(keys) for c in (F.xxhash64(F.lit(seed), *keys[: i + 1]), F.col(k))]
    rows = features.select(*keys, *FEATURES, "n_pos", "n_neg")
    return rows.repartition(workers, F.xxhash64(*keys)).sortWithinPartitions(*order)


def frame_batches(batches: Iterator[pa.RecordBatch], keys: int, batch_frames: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, n_pos, n_neg) of so many frames each. Rows: the frames' keys first, frames together."""
    frame, held, count = None, [], 0
    for batch in batches:
        names = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        values = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(keys, batch.num_columns)], axis=1) if len(batch) else np.zeros((0, 0))
        cuts = [i for i in range(len(names)) if names[i] != (names[i - 1] if i else frame)]
        if len(names) and (not cuts or cuts[0]):
            held.append(values[: cuts[0] if cuts else len(names)])  # more of the frame that the last batch ended with
        for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True):
            count += 1
            if held and count > batch_frames:
                yield _arrays(held)
                held, count = [], 1
            held.append(values[a:b])
        frame = names[-1] if names else frame
    if held:
        yield _arrays(held)


def _arrays(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.concatenate(parts)
    return a[:, :-2], a[:, -2], a[:, -1]


def _flat(values: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in values]) if values else np.zeros(0)


def _shaped(flat: np.ndarray, like: Sequence[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([v.size for v in like])[:-1]
    return [x.reshape(v.shape).copy() for x, v in zip(np.split(flat, cuts), like, strict=True)] if len(flat) else []


def epoch(features: DataFrame, keys: Sequence[str], seed: int, config: TrainConfig, scorer: Scorer, adam: AdamW) -> tuple[Scorer, AdamW, float | None]:
    """The scorer and optimiser after one pass over the frames, and the mean loss of its steps.

    In each step every task gives the gradients of its next frames, weighted by their labelled points, and all tasks meet;
    a task whose frames are used up gives nothing, and the pass ends when none gives any. If a task is lost, the stage
    starts again from the weights that it was given, so the result is the same.
    """
    workers = max(1, min(config.workers, features.sparkSession.sparkContext.defaultParallelism))
    given = (scorer.weights, scorer.biases, adam)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        weights, biases, own = given
        net, steps = Scorer([w.copy() for w in weights], [b.copy() for b in biases]), []
        optimiser = AdamW(own.rate, own.decay, own.step, [m.copy() for m in own.first], [m.copy() for m in own.second])
        mine = frame_batches(batches, len(keys), config.batch_frames)
        while True:
            batch = next(mine, None)
            sums = np.zeros(0)
            if batch is not None:
                x, pos, neg = batch
                n = float(pos.sum() + neg.sum())
                loss, gradients = net.gradients(x, pos, neg, config.pos_weight)
                sums = np.concatenate(([n, n * loss], n * _flat(gradients)))
            met = [np.frombuffer(base64.b64decode(m), np.float64) for m in context.allGather(base64.b64encode(sums.tobytes()).decode())]
            met = [m for m in met if len(m)]
            if not met:
                break
            total = np.sum(met, axis=0)
            if total[0] == 0:
                continue
            if not np.isfinite(total[1]):
                raise FloatingPointError("the loss isn't finite")
            optimiser.update(net.values(), _shaped(total[2:] / total[0], net.values()))
            steps.append(total[1] / total[0])
        if context.partitionId() == 0:
            state = [_flat(net.values()), _flat(optimiser.first), _flat(optimiser.second)]
            columns = [pa.array([s.tolist()], pa.list_(pa.float64())) for s in state]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([optimiser.step], pa.int64()), pa.array([float(np.mean(steps)) if steps else None], pa.float64())], ["v", "m", "s", "step", "loss"])

    row = dealt_frames(features, keys, seed, workers).mapInArrow(run, "v array<double>, m array<double>, s array<double>, step long, loss double", barrier=True).collect()[0]
    like = scorer.values()
    v, m, s = (_shaped(np.array(row[k], np.float64), like) for k in ("v", "m", "s"))
    n = len(scorer.weights)
    return Scorer(v[:n], v[n:]), AdamW(adam.rate, adam.decay, row["step"], m, s), row["loss"]


def score(features: DataFrame, scorer: Scorer) -> DataFrame:
    """features with logit (double)."""
    weights, biases = [w.copy() for w in scorer.weights], [b.copy() for b in scorer.biases]
    schema = T.StructType(list(features.schema.fields)).add("logit", "double")
    at = [features.columns.index(c) for c in FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at], axis=1).astype(np.float64) if len(batch) else np.zeros((0, len(at)))
            for i, (w, b) in enumerate(zip(weights, biases, strict=True)):
                x = x @ w + b
                if i < len(weights) - 1:
                    x = np.maximum(x, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x[:, 0])], schema.names)

    return features.mapInArrow(run, schema)


def labelled_scores(scored: DataFrame, by: Sequence[str] = (), value: str = "logit") -> DataFrame:
    """(by, score, pos, neg): labelled points at each distinct score, from voxel counts."""
    return metrics.by_score(scored.where("n_pos + n_neg > 0"), value, "n_pos", by, F.col("n_pos"), F.col("n_neg"))


@dataclass(frozen=True)
class Calibration:
    slope: float
    bias: float

    def probability(self, logit: str = "logit"):
        return sigmoid(F.col(logit) * self.slope + self.bias)


def calibrate(steps: DataFrame, rounds: int = 60) -> Calibration:
    """Slope (positive) and bias that minimise the mean log loss of sigmoid(slope * score + bias).

    Newton steps with halving; each needs one aggregate over (score, pos, neg), whose sums are all that reaches the driver.
    """
    steps = steps.select(F.col("score").cast("double").alias("s"), F.col("pos").cast("double").alias("p"), F.col("neg").cast("double").alias("n")).persist()
    total = steps.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    if not total["p"] or not total["n"]:
        steps.unpersist()
        raise ValueError("calibration needs both classes")
    weight = total["p"] + total["n"]

    def sums(a: float, b: float) -> tuple:
        z = F.col("s") * a + b
        q = sigmoid(z)
        soft = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
        g, h = (F.col("p") + F.col("n")) * q - F.col("p"), (F.col("p") + F.col("n")) * q * (1 - q)
        s = F.col("s")
        return tuple(x / weight for x in steps.agg(F.sum(F.col("p") * soft(-z) + F.col("n") * soft(z)), F.sum(g * s), F.sum(g), F.sum(h * s * s), F.sum(h * s), F.sum(h)).first())

    a, b = 1.0, 0.0
    now = sums(a, b)
    for _ in range(rounds):
        loss, ga, gb, haa, hab, hbb = now
        if max(abs(ga), abs(gb)) < 1e-10:
            break
        damp = 1e-10 + 1e-9 * (haa + hbb)
        det = (haa + damp) * (hbb + damp) - hab * hab
        da, db = ((hbb + damp) * ga - hab * gb) / det, ((haa + damp) * gb - hab * ga) / det
        size = 1.0
        while size > 1e-8:
            try_a = max(a - size * da, 1e-6)
            following = sums(try_a, b - size * db)
            if following[0] <= loss:
                break
            size /= 2
        else:
            break
        done = loss - following[0] < 1e-14
        a, b, now = try_a, b - size * db, following
        if done:
            break
    steps.unpersist()
    return Calibration(a, b)


@dataclass
class Bundle:
    """All that prediction needs. Saved as one JSON file, moved into place."""

    scorer: Scorer
    centre: dict[str, float]
    scale: dict[str, float]
    calibration: Calibration
    threshold: float
    voxel_size: float

    def save(self, path: str) -> None:
        write_json(path, {"features": list(FEATURES), "weights": [w.tolist() for w in self.scorer.weights], "biases": [b.tolist() for b in self.scorer.biases], "centre": self.centre, "scale": self.scale, "calibration": asdict(self.calibration), "threshold": self.threshold, "voxel_size": self.voxel_size})

    @classmethod
    def load(cls, path: str) -> Bundle:
        v = json.loads(Path(path).read_text())
        if v["features"] != list(FEATURES):
            raise ValueError("the bundle was made for other features")
        return cls(Scorer([np.array(w) for w in v["weights"]], [np.array(b) for b in v["biases"]]), v["centre"], v["scale"], Calibration(**v["calibration"]), v["threshold"], v["voxel_size"])

    def normalised(self, features: DataFrame) -> DataFrame:
        return features.withColumns({c: ((F.col(c) - self.centre[c]) / self.scale[c]).cast("float") for c in FEATURES})

    def predict(self, features: DataFrame) -> DataFrame:
        """features with logit, probability and predicted (probability >= threshold)."""
        out = score(self.normalised(features), self.scorer).withColumn("probability", self.calibration.probability().cast("float"))
        return out.withColumn("predicted", (F.col("probability") >= F.lit(self.threshold)).cast("short"))


def save_checkpoint(path: str, scorer: Scorer, adam: AdamW, history: list[dict], config: TrainConfig, voxel_size: float) -> None:
    state = {f"v{i}": v for i, v in enumerate(scorer.values())} | {f"m{i}": v for i, v in enumerate(adam.first)} | {f"s{i}": v for i, v in enumerate(adam.second)}
    meta = {"step": adam.step, "history": history, "config": asdict(config), "voxel_size": voxel_size, "layers": len(scorer.weights)}
    part = f"{path}.part.npz"
    np.savez(part, meta=np.array(json.dumps(meta)), **state)
    os.replace(part, path)


def load_checkpoint(path: str, config: TrainConfig, voxel_size: float) -> tuple[Scorer, AdamW, list[dict]]:
    """The state to go on from; it must be of the same model and voxel size, and as long as its history."""
    with np.load(path, allow_pickle=False) as z:
        meta = json.loads(str(z["meta"]))
        n = meta["layers"]
        values = [z[f"v{i}"] for i in range(2 * n)]
        adam = AdamW(config.rate, config.decay, meta["step"], [z[f"m{i}"] for i in range(2 * n)], [z[f"s{i}"] for i in range(2 * n)])
    if tuple(meta["config"]["hidden"]) != tuple(config.hidden) or meta["voxel_size"] != voxel_size:
        raise ValueError("the checkpoint is of another model")
    if [h["epoch"] for h in meta["history"]] != list(range(1, len(meta["history"]) + 1)):
        raise ValueError("the checkpoint's history has gaps")
    return Scorer(values[:n], values[n:]), adam, meta["history"]


def train(parts: dict[str, DataFrame], voxel_size: float, config: TrainConfig = TrainConfig(), keys: Sequence[str] = ("recording", "frame_index"), domain: str | None = None, checkpoint: str | None = None) -> tuple[Bundle, list[dict]]:
    """Trains on parts["train"], keeps the epoch with the best average precision on "selection" (the mean over domains),
    calibrates on "calibration" and takes the threshold with the best F1 on "selection". parts: voxel features with counts.
    """
    import time

    from ..operators.voxels import normaliser

    row = normaliser(parts["train"]).first()
    centre, scale = ({c: row[f"{c}_{k}"] for c in FEATURES} for k in ("center", "scale"))
    bundle = Bundle(Scorer.fresh(len(FEATURES), config.hidden, config.seed), centre, scale, Calibration(1.0, 0.0), 0.5, voxel_size)
    adam, history = AdamW(config.rate, config.decay), []
    if checkpoint and os.path.exists(checkpoint):
        bundle.scorer, adam, history = load_checkpoint(checkpoint, config, voxel_size)
    ready = {k: bundle.normalised(v).persist() for k, v in parts.items()}
    group = [domain] if domain else []
    best, kept, since, began = -1.0, replace_values(bundle.scorer), 0, time.time()
    for number in range(len(history) + 1, config.epochs + 1):
        bundle.scorer, adam, loss = epoch(ready["train"], keys, config.seed + number, config, bundle.scorer, adam)
        table = metrics.cumulated(labelled_scores(score(ready["selection"], bundle.scorer), group), group)
        ap = metrics.average_precision(table, group).agg(F.avg("average_precision")).first()[0]
        history.append({"epoch": number, "loss": loss, "selection_ap": ap})
        if ap is not None and ap > best:
            best, kept, since = ap, replace_values(bundle.scorer), 0
        else:
            since += 1
        if checkpoint:
            save_checkpoint(checkpoint, bundle.scorer, adam, history, config, voxel_size)
        if since >= config.patience or time.time() - began > 3600 * config.max_hours:
            break
    bundle.scorer = kept
    bundle.calibration = calibrate(labelled_scores(score(ready["calibration"], kept)))
    selection = score(ready["selection"], kept).withColumn("probability", bundle.calibration.probability())
    bundle.threshold = float(metrics.best_f1(metrics.cumulated(labelled_scores(selection, value="probability"))).first()["threshold"])
    for v in ready.values():
        v.unpersist()
    return bundle, history


def replace_values(scorer: Scorer) -> Scorer:
    """A copy that later steps don't touch."""
    return replace(scorer, weights=[w.copy() for w in scorer.weights], biases=[b.copy() for b in scorer.biases])


def latency(bundle: Bundle, frame: DataFrame, repeats: int = 20) -> dict[str, float]:
    """Milliseconds to score one frame's voxels on the driver: mean, p50, p95, max."""
    import time

    x = np.array([r[:] for r in bundle.normalised(frame).select(*FEATURES).collect()], np.float64)
    took = []
    for _ in range(repeats):
        t = time.perf_counter()
        bundle.scorer.logits(x)
        took.append(1000 * (time.perf_counter() - t))
    return {"mean_ms": float(np.mean(took)), "p50_ms": float(np.percentile(took, 50)), "p95_ms": float(np.percentile(took, 95)), "max_ms": max(took)}
