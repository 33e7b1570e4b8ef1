"""Decoder of CDR-encoded lidar messages: header, time base, and a sequence of 20-byte (or packed 19-byte) points.

Layout after the 4-byte encapsulation: int32 s, uint32 ns, string frame id, then (8-byte aligned, counted from the end of
the encapsulation or, in some writers, from its start) uint64 time base, uint32 point count, uint8 lidar id, 3 bytes,
uint32 sequence length; each point: uint32 offset ns, float32 x, y, z, uint8 reflectivity, tag, line and a pad byte that
the last may lack.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MOST_POINTS = 2_000_000
_FIXED = struct.calcsize("QIB3xI")


@dataclass(frozen=True)
class LidarMessage:
    xyz: np.ndarray
    reflectivity: np.ndarray
    tag: np.ndarray
    line: np.ndarray
    offset_s: np.ndarray
    timebase_ns: int
    count: int


def _point_type(order: str, size: int) -> np.dtype:
    names = ["offset", "x", "y", "z", "reflectivity", "tag", "line"]
    return np.dtype({"names": names, "formats": [order + "u4", order + "f4", order + "f4", order + "f4", "u1", "u1", "u1"], "offsets": [0, 4, 8, 12, 16, 17, 18], "itemsize": size})


def decode_lidar_message(data: bytes, stride: int = 1) -> LidarMessage:
    """The message's points, every stride-th of them. A payload that doesn't hold what it announces is an error."""
    if len(data) < 32:
        raise ValueError("the message is too short")
    order = "<" if data[0] == 0 and data[1] in (1, 3) else ">"
    (name,) = struct.unpack_from(order + "I", data, 12)
    end = 16 + name
    if end > len(data):
        raise ValueError("the frame id runs beyond the message")
    short = False
    for base in (4, 0):
        at = end + (base - end) % 8
        if at + _FIXED > len(data):
            continue
        timebase, count = struct.unpack_from(order + "QI", data, at)
        (length,) = struct.unpack_from(order + "I", data, at + 16)
        at += _FIXED
        if length != count or count > MOST_POINTS:
            continue
        room = len(data) - at
        size = 20 if not count or room >= 20 * count - 1 else 19
        if room < 19 * count or (short and not count):
            short = True  # what the other alignment shows as empty is then no message either
            continue
        body = data[at : at + size * count].ljust(size * count, b"\0")
        points = np.frombuffer(body, _point_type(order, size), count)[:: max(1, stride)]
        xyz = np.stack([points[c].astype(np.float32) for c in "xyz"], axis=1) if count else np.zeros((0, 3), np.float32)
        return LidarMessage(xyz, points["reflectivity"].astype(np.float32), points["tag"].copy(), points["line"].copy(), points["offset"] * 1e-9, timebase, count)
    raise ValueError("no point sequence in the message")
