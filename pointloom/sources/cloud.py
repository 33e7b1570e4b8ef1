"""Decoder of point-cloud messages whose fields are declared in the message."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Fixed datatype codes of declared fields.
FORMATS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
REQUIRED = ("x", "y", "z", "intensity", "tag", "line", "timestamp")


@dataclass(frozen=True)
class Field:
    name: str
    offset: int
    datatype: int
    count: int = 1


@dataclass(frozen=True)
class Cloud:
    height: int
    width: int
    fields: Sequence[Field]
    big_endian: bool
    point_step: int
    row_step: int
    data: bytes


def _table(cloud: Cloud) -> np.ndarray:
    """The cloud's bytes as one row a point, without what pads its rows."""
    used = cloud.width * cloud.point_step
    if cloud.point_step < 1 or used > cloud.row_step:
        raise ValueError("rows are shorter than their points")
    size = cloud.height * cloud.row_step
    if size > len(cloud.data):
        raise ValueError("the cloud is truncated")
    return np.frombuffer(cloud.data, np.uint8, size).reshape(cloud.height, cloud.row_step)[:, :used].reshape(-1, cloud.point_step)


def _cut(table: np.ndarray, field: Field, order: str) -> np.ndarray:
    """A field's bytes of every point as numbers; a field of several values is a row each."""
    if field.count < 1 or field.datatype not in FORMATS:
        raise ValueError(f"field {field.name} has an unknown type")
    kind = np.dtype(order + FORMATS[field.datatype])
    upto = field.offset + field.count * kind.itemsize
    if not 0 <= field.offset < upto <= table.shape[1]:
        raise ValueError(f"field {field.name} lies outside the point")
    values = np.ascontiguousarray(table[:, field.offset : upto]).view(kind)
    return values if field.count > 1 else values[:, 0]


def decode_cloud(cloud: Cloud) -> dict[str, np.ndarray]:
    """The fields of all points, row by row: each is cut out of the one table of bytes."""
    table, order = _table(cloud), ">" if cloud.big_endian else "<"
    return {f.name: _cut(table, f, order) for f in cloud.fields}


def lidar_columns(points: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The columns of a lidar frame: coordinates, intensity, tag, line, time_ns (rounded half-even) and point_index."""
    missing = [n for n in REQUIRED if n not in points]
    if missing:
        raise ValueError(f"the cloud lacks {', '.join(missing)}")
    if points["timestamp"].ndim != 1 or not np.isfinite(points["timestamp"]).all():
        raise ValueError("a timestamp isn't a finite number")
    out = {c: points[c].astype(np.float32) for c in ("x", "y", "z", "intensity")}
    out |= {c: points[c].astype(np.int16) for c in ("tag", "line")}
    out["time_ns"] = np.rint(points["timestamp"]).astype(np.int64)
    out["point_index"] = np.arange(len(out["time_ns"]), dtype=np.int64)
    return out
