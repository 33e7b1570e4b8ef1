"""Streams of frames: points labelled against a fixed reference, and windows over time and frames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.directional import BandConfig, LookupConfig, label_residuals, look_up, with_cells


def labelled_stream(points: DataFrame, reference: DataFrame, bands: DataFrame, resolution_deg: float, lookup: LookupConfig, cfg: BandConfig) -> DataFrame:
    """A stream of points joined with the static reference and bands; each point is labelled by itself, without state."""
    return label_residuals(look_up(with_cells(points, resolution_deg), reference, lookup), bands, cfg)


def windowed_counts(labelled: DataFrame, time: str = "event_time", window: str = "60 seconds", lateness: str = "30 seconds", by: str = "recording") -> DataFrame:
    """Label counts of each tumbling window; points later than the watermark are left out."""
    rows = labelled.withWatermark(time, lateness).groupBy(F.window(time, window), by)
    return rows.agg(F.count(F.lit(1)).alias("points"), *[F.count_if(F.col("label") == c).alias(n) for n, c in (("unaffected", 0), ("impacted", 1), ("ignored", 255))])


def frame_windows_stream(frames: DataFrame, length: int, max_gap_s: float, recording: str = "recording") -> DataFrame:
    """History windows of streamed frames (recording, frame_index, frame_time_s), as in batch: the state of a recording is
    its last length frames. Frames of one recording must arrive in order; one that doesn't advance makes windows unusable."""

    def step(key, batches, state) -> Iterator:
        import pandas as pd

        held = [tuple(x) for x in zip(state.get[0], state.get[1], strict=True)] if state.exists else []
        rows = []
        for pdf in batches:
            for index, t in sorted(zip(pdf["frame_index"].tolist(), pdf["frame_time_s"].tolist(), strict=True)):
                held = [*held, (index, t)][-length:]
                if len(held) == length:
                    steps = [b[1] - a[1] for a, b in zip(held, held[1:], strict=False)]
                    good = all(x[1] == x[1] and abs(x[1]) != float("inf") for x in held) and all(0 < s <= max_gap_s for s in steps)
                    rows.append((key[0], held[0][0], index, good))
        state.update(([int(i) for i, _ in held], [float(t) for _, t in held]))
        yield pd.DataFrame(rows, columns=["recording", "history_start", "target_frame", "usable"])

    return frames.groupBy(recording).applyInPandasWithState(step, "recording string, history_start long, target_frame long, usable boolean", "frames array<long>, times array<double>", "append", "NoTimeout")
