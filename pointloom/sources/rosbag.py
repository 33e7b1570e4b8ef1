"""Reader of ROS 1 bags (version 2.0): point clouds, odometry and static transforms as Spark data sources.

The index at a bag's end names its chunks and how many messages each has of every connection. Partitions are groups of
chunks of about split_bytes that hold messages of the kind and topic, each read by its range, and frame numbers come from
the counts of the chunks before. With start_ns or end_ns (record times) chunks outside are not read. A bag without a usable
index is one partition, read in order, chunk by chunk; transforms, a few messages a session, always are one.
"""

from __future__ import annotations

import bz2
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .cloud import Cloud, Field, decode_cloud, lidar_columns
from .files import Source, grouped, listed

MAGIC = b"#ROSBAG V2.0\n"
_TYPES = {"points": "PointCloud2", "odometry": "Odometry", "transforms": "TFMessage"}
#: Suffixes of a session's files.
SESSION_FILES = {"raw": "*_livox.bag", "undistorted": "*_livox_undist.bag", "odometry": "*_dlio.bag", "transforms": "*_tf_minimal.bag"}
_KINDS = {
    "points": "bag string, topic string, frame_index int, header_time_ns long, frame_id string, point_index long, x float, y float, z float, intensity float, tag short, line short, time_ns long",
    "odometry": "bag string, time_ns long, tx double, ty double, tz double, qx double, qy double, qz double, qw double, world_frame string, body_frame string",
    "transforms": "bag string, seq long, parent string, child string, tx double, ty double, tz double, qx double, qy double, qz double, qw double",
}


def resolve_session(folder: str) -> dict[str, str]:
    """The session's four files; each must be there once."""
    out = {}
    for name, pattern in SESSION_FILES.items():
        found = sorted(Path(folder).expanduser().glob(pattern))
        if len(found) != 1:
            raise FileNotFoundError(f"{folder} must hold one {pattern}, not {len(found)}")
        out[name] = str(found[0].resolve())
    return out


class Cursor:
    """Reads little-endian values without padding, as ROS 1 serialises them."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, kind: str) -> tuple:
        out = struct.unpack_from("<" + kind, self.data, self.at)
        self.at += struct.calcsize("<" + kind)
        return out

    def blob(self) -> bytes:
        (n,) = self.take("I")
        if self.at + n > len(self.data):
            raise ValueError("the message is truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> str:
        return self.blob().decode()

    def header(self) -> tuple[int, str]:
        """Stamp in ns, and frame id."""
        _, s, ns = self.take("III")
        return s * 1_000_000_000 + ns, self.text()


@dataclass(frozen=True)
class BagMessage:
    topic: str
    kind: str
    time_ns: int
    data: bytes


def _header(data: bytes) -> dict[str, bytes]:
    out, c = {}, Cursor(data)
    while c.at < len(data):
        name, _, value = c.blob().partition(b"=")
        out[name.decode()] = value
    return out


def _records(stream: BinaryIO) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """(header, data) of each record; one that was cut off ends them."""

    def blob() -> bytes | None:
        size = stream.read(4)
        if len(size) < 4:
            return None
        (n,) = struct.unpack("<I", size)
        data = stream.read(n)
        return data if len(data) == n else None

    while (head := blob()) is not None and (data := blob()) is not None:
        yield _header(head), data


def _unpacked(head: dict[str, bytes], body: bytes) -> bytes:
    how = head.get("compression", b"none").decode()
    if how == "lz4":
        try:
            import lz4.frame
        except ImportError as e:
            raise RuntimeError("chunks are compressed by lz4, which isn't installed") from e
        return lz4.frame.decompress(body)
    if how == "bz2":
        return bz2.decompress(body)
    if how != "none":
        raise ValueError(f"unknown compression {how}")
    return body


def _connection(head: dict[str, bytes], body: bytes) -> tuple[int, tuple[str, str]]:
    return struct.unpack("<I", head["conn"])[0], (head["topic"].decode(), _header(body).get("type", b"").decode())


def _ns(data: bytes) -> int:
    s, ns = struct.unpack("<II", data)
    return s * 1_000_000_000 + ns


def bag_messages(stream: BinaryIO, topics: dict[int, tuple[str, str]] | None = None) -> Iterator[BagMessage]:
    """The messages of records, in order. topics: (topic, type) by connection, as far as they are known already."""
    known = {} if topics is None else topics
    for head, body in _records(stream):
        op = head["op"][0]
        if op == 7:
            number, known[number] = _connection(head, body)
        elif op == 2:
            topic, kind = known.get(struct.unpack("<I", head["conn"])[0], ("", ""))
            yield BagMessage(topic, kind, _ns(head["time"]), body)
        elif op == 5:
            yield from bag_messages(io.BytesIO(_unpacked(head, body)), known)


def _started(source: Source) -> BinaryIO:
    stream = source.stream()
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a bag of version 2.0")
    return stream


@dataclass(frozen=True)
class Chunk:
    """A chunk's place, its record times, and its messages by connection."""

    at: int
    first_ns: int
    last_ns: int
    counts: dict[int, int]


def index(source: Source) -> tuple[dict[int, tuple[str, str]], list[Chunk]] | None:
    """Connections and chunks, or None if the bag has no index of all its chunks."""
    head, _ = next(_records(io.BytesIO(source.at(len(MAGIC), 8192))), ({}, b""))
    if head.get("op") != b"\x03":
        return None
    (start,), (chunks,) = struct.unpack("<Q", head["index_pos"]), struct.unpack("<I", head["chunk_count"])
    if not start or not chunks:
        return None
    topics, out = {}, []
    for head, body in _records(io.BytesIO(source.at(start, source.size - start))):
        if head["op"] == b"\x07":
            number, topics[number] = _connection(head, body)
        elif head["op"] == b"\x06":
            counts = dict(struct.unpack_from("<II", body, i) for i in range(0, len(body), 8))
            out.append(Chunk(struct.unpack("<Q", head["chunk_pos"])[0], _ns(head["start_time"]), _ns(head["end_time"]), counts))
    return (topics, sorted(out, key=lambda c: c.at)) if len(out) == chunks else None


def chunk_messages(source: Source, at: int, topics: dict[int, tuple[str, str]]) -> Iterator[BagMessage]:
    """The messages of the chunk at a place; only its bytes are read."""
    (n,) = struct.unpack("<I", source.at(at, 4))
    head = source.at(at + 4, n + 4)
    (size,) = struct.unpack("<I", head[n:])
    yield from bag_messages(io.BytesIO(_unpacked(_header(head[:n]), source.at(at + n + 8, size))), dict(topics))


def cloud_message(data: bytes) -> tuple[int, str, dict[str, np.ndarray]]:
    """Stamp, frame id and points of a point-cloud message."""
    c = Cursor(data)
    stamp, frame = c.header()
    height, width, n = c.take("III")
    fields = []
    for _ in range(n):
        name = c.text()
        offset, kind, count = c.take("IBI")
        fields.append(Field(name, offset, kind, count))
    big, step, row = c.take("BII")
    return stamp, frame, decode_cloud(Cloud(height, width, fields, bool(big), step, row, c.blob()))


def odometry_message(data: bytes) -> tuple[int, str, str, tuple[float, ...]]:
    """Stamp, world frame, body frame, and translation and quaternion."""
    c = Cursor(data)
    stamp, world = c.header()
    return stamp, world, c.text(), c.take("7d")


def transform_message(data: bytes) -> Iterator[tuple[str, str, tuple[float, ...]]]:
    """(parent, child, translation and quaternion) of each transform."""
    c = Cursor(data)
    for _ in range(c.take("I")[0]):
        _, parent = c.header()
        child = c.text()
        yield parent, child, c.take("7d")


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.topic = kind, options.get("topic")
        self.files = listed(options["path"], ".bag")
        self.split = int(options.get("split_bytes", 64 << 20))
        self.start, self.end = (int(options[k]) if k in options else None for k in ("start_ns", "end_ns"))

    def _wanted(self, topic: str, kind: str) -> bool:
        return (not self.topic or topic == self.topic) and kind.endswith(_TYPES[self.kind])

    def _plan(self, path: str) -> list[tuple[list[tuple[int, int]] | None, dict]]:
        """(chunks as (number of the first message, place), connections) of each partition; no chunks: the bag in order."""
        with Source(path) as source:
            known, size = index(source), source.size
        if known is None or self.kind == "transforms":
            return [(None, {})]
        topics, chunks = known
        own = {c for c, (topic, kind) in topics.items() if self._wanted(topic, kind)}
        frame, parts = 0, []
        for c, end in zip(chunks, [*[c.at for c in chunks[1:]], size], strict=True):
            n = sum(k for i, k in c.counts.items() if i in own)
            if n and (self.start is None or c.last_ns >= self.start) and (self.end is None or c.first_ns <= self.end):
                parts.append((end - c.at, (frame, c.at)))
            frame += n
        return [(group, topics) for group in grouped(parts, self.split)]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((f, *part)) for f in self.files for part in self._plan(f)]

    def _messages(self, path: str, chunks: list | None, topics: dict) -> Iterator[tuple[int, BagMessage]]:
        own = lambda found: (m for m in found if self._wanted(m.topic, m.kind))
        with Source(path) as source:
            if chunks is None:
                yield from enumerate(own(bag_messages(_started(source))))
            for frame, at in chunks or []:
                yield from enumerate(own(chunk_messages(source, at, topics)), frame)

    def read(self, partition: InputPartition) -> Iterator[tuple | pa.RecordBatch]:
        if partition is None:  # no bag has a message of the kind and topic
            return
        path, chunks, topics = partition.value
        name, seq = Path(path).name, 0
        for frame, m in self._messages(path, chunks, topics):
            if (self.start is not None and m.time_ns < self.start) or (self.end is not None and m.time_ns > self.end):
                continue
            if self.kind == "points":
                stamp, frame_id, points = cloud_message(m.data)
                own = lidar_columns(points)
                n = len(own["time_ns"])
                fixed = [pa.array([v] * n, t) for v, t in ((name, pa.string()), (m.topic, pa.string()), (frame, pa.int32()), (stamp, pa.int64()), (frame_id, pa.string()))]
                order = ["point_index", "x", "y", "z", "intensity", "tag", "line", "time_ns"]
                yield pa.RecordBatch.from_arrays(fixed + [pa.array(own[c]) for c in order], [c.split()[0] for c in _KINDS["points"].split(", ")])
            elif self.kind == "odometry":
                stamp, world, body, pose = odometry_message(m.data)
                yield (name, stamp, *pose, world, body)
            else:
                for parent, child, pose in transform_message(m.data):
                    yield (name, seq, parent, child, *pose)
                    seq += 1


class RosBag(DataSource):
    """spark.read.format("ros_bag").option("kind", "points" | "odometry" | "transforms").option("topic", ...).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "ros_bag"

    def schema(self) -> str:
        return _KINDS[self.options.get("kind", "points")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("kind", "points"), dict(self.options))
