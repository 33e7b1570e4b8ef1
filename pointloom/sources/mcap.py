"""Reader of MCAP recordings of lidar messages, as a Spark data source.

The summary at a file's end names its chunks. Partitions are groups of chunks of about split_bytes that hold messages of
the topic, each read by its range; frame numbers come from the message counts of the chunks before. With start_ns or end_ns
(log times) chunks outside are not read. A file without a usable summary is one partition, read in order, chunk by chunk.

Only what a scan needs of the container: schemas, channels, messages, chunks (plain or zstandard; lz4 if installed), and
the indexes of these.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .cdr import decode_lidar_message
from .files import Source, grouped, listed

MAGIC = b"\x89MCAP0\r\n"
SCHEMA_NAME = "livox_ros_driver2/msg/CustomMsg"
_OPS = {"footer": 2, "schema": 3, "channel": 4, "message": 5, "chunk": 6, "message_index": 7, "chunk_index": 8, "statistics": 11}
COLUMNS = "recording string, topic string, frame_index int, point_index long, x float, y float, z float, reflectivity float, tag short, line short, offset_s double, time_s double, message_time_ns long"


@dataclass(frozen=True)
class Message:
    topic: str
    schema: str
    log_time_ns: int
    publish_time_ns: int
    data: bytes


def resolve(path: str) -> list[str]:
    """Files of a recording: the file itself (also without its suffix), a folder's files, or those with the prefix, by name.

    For a URI: the file, or the folder's files.
    """
    if "://" in path:
        return listed(path, ".mcap")
    asked = Path(path).expanduser()
    tries = [asked] if asked.suffix.lower() == ".mcap" else [asked, asked.with_suffix(".mcap")]
    for t in tries:
        if t.is_file():
            return [str(t.resolve())]
        if t.is_dir() and (inside := sorted(t.glob("*.mcap"))):
            return [str(f.resolve()) for f in inside]
    if asked.parent.is_dir() and (alike := sorted(asked.parent.glob(f"{asked.name}*.mcap"))):
        return [str(f.resolve()) for f in alike]
    raise FileNotFoundError(f"no .mcap file for {path}")


def _string(data: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<I", data, at)
    return data[at + 4 : at + 4 + n].decode(), at + 4 + n


def _records(stream: BinaryIO) -> Iterator[tuple[int, bytes]]:
    while len(head := stream.read(9)) == 9:
        op, n = struct.unpack("<BQ", head)
        body = stream.read(n)
        if len(body) < n:
            return  # a record that was cut off
        yield op, body


def _unpacked(body: bytes) -> bytes:
    (size,) = struct.unpack_from("<Q", body, 16)
    kind, at = _string(body, 28)
    (n,) = struct.unpack_from("<Q", body, at)
    data = body[at + 8 : at + 8 + n]
    if kind == "":
        return data
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if kind == "lz4":
        try:
            import lz4.frame
        except ImportError as e:
            raise RuntimeError("chunks are compressed by lz4, which isn't installed") from e
        return lz4.frame.decompress(data)
    raise ValueError(f"unknown compression {kind}")


def messages(stream: BinaryIO, channels: dict[int, tuple[str, str]] | None = None, schemas: dict[int, str] | None = None) -> Iterator[Message]:
    """The messages of records, in order. channels: (topic, schema) by number, as far as they are known already."""
    known, schemas = {} if channels is None else channels, {} if schemas is None else schemas
    for op, body in _records(stream):
        if op == _OPS["schema"]:
            schemas[struct.unpack_from("<H", body)[0]] = _string(body, 2)[0]
        elif op == _OPS["channel"]:
            number, schema = struct.unpack_from("<HH", body)
            if schema in schemas or number not in known:
                known[number] = (_string(body, 4)[0], schemas.get(schema, ""))
        elif op == _OPS["message"]:
            number, _, log, published = struct.unpack_from("<HIQQ", body)
            topic, schema = known.get(number, ("", ""))
            yield Message(topic, schema, log, published, body[22:])
        elif op == _OPS["chunk"]:
            yield from messages(io.BytesIO(_unpacked(body)), known, schemas)


@dataclass
class Chunk:
    """A chunk's record (place, bytes), its log times, and where the index of each channel's messages is."""

    at: int
    size: int
    first_ns: int
    last_ns: int
    indexes: dict[int, int]
    n: int = 0


@dataclass
class Index:
    channels: dict[int, tuple[str, str]] = field(default_factory=dict)
    chunks: list[Chunk] = field(default_factory=list)
    counts: dict[int, int] | None = None

    def of(self, topic: str | None, schema: str) -> list[int]:
        """Channels of the schema, and of the topic if there is one."""
        return [i for i, (t, s) in self.channels.items() if s == schema and topic in (None, t)]


def _pairs(body: bytes, at: int, kind: str) -> tuple[dict[int, int], int]:
    (n,) = struct.unpack_from("<I", body, at)
    step = struct.calcsize("<" + kind)
    return dict(struct.unpack_from("<" + kind, body, i) for i in range(at + 4, at + 4 + n, step)), at + 4 + n


def index(source: Source) -> Index | None:
    """What the summary says, or None if the file has none that names its chunks."""
    size, tail = source.size, 9 + 20 + len(MAGIC)
    foot = source.at(max(0, size - tail), tail)
    if len(foot) < tail or foot[-len(MAGIC) :] != MAGIC or foot[:9] != struct.pack("<BQ", _OPS["footer"], 20):
        return None
    (start,) = struct.unpack_from("<Q", foot, 9)
    if not start:
        return None
    out, schemas = Index(), {}
    for op, body in _records(io.BytesIO(source.at(start, size - tail - start))):
        if op == _OPS["schema"]:
            schemas[struct.unpack_from("<H", body)[0]] = _string(body, 2)[0]
        elif op == _OPS["channel"]:
            number, schema = struct.unpack_from("<HH", body)
            out.channels[number] = (_string(body, 4)[0], schemas.get(schema, ""))
        elif op == _OPS["chunk_index"]:
            first, last, at, n = struct.unpack_from("<QQQQ", body)
            out.chunks.append(Chunk(at, n, first, last, _pairs(body, 32, "HQ")[0]))
        elif op == _OPS["statistics"]:
            out.counts = _pairs(body, 42, "HQ")[0]
    out.chunks.sort(key=lambda c: c.at)
    return out if out.chunks and out.channels else None


def counted(source: Source, known: Index, channels: list[int]) -> bool:
    """Sets each chunk's number of messages of the channels, from its message indexes (15 bytes each); whether they are
    all that the file has, by its statistics."""
    wanted = [(c, c.indexes[i], i) for c in known.chunks for i in channels if i in c.indexes]
    met = dict.fromkeys(channels, 0)
    for (chunk, _, channel), head in zip(wanted, source.many([(at, 15) for _, at, _ in wanted]), strict=True):
        op, _, number, n = struct.unpack("<BQHI", head)
        if op != _OPS["message_index"] or number != channel:
            return False
        chunk.n += n // 16
        met[channel] += n // 16
    return known.counts is not None and all(known.counts.get(i, 0) == n for i, n in met.items())


def _first_topic(path: str, schema: str) -> str | None:
    """The topic of the file's first lidar message."""
    with Source(path) as source:
        known = index(source)
        for chunk in known.chunks if known else []:
            met = [i for i in known.of(None, schema) if i in chunk.indexes]
            if len({known.channels[i][0] for i in met}) == 1:
                return known.channels[met[0]][0]
            if met:
                return next(m.topic for m in messages(io.BytesIO(source.at(chunk.at, chunk.size)), dict(known.channels)) if m.schema == schema)
    with Source(path) as source:
        return next((m.topic for m in messages(_started(source)) if m.schema == schema), None)


def _started(source: Source) -> BinaryIO:
    stream = source.stream()
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not an MCAP file")
    return stream


def plan(path: str, topic: str, split_bytes: int, start_ns: int | None, end_ns: int | None, schema: str = SCHEMA_NAME) -> list[tuple[list[tuple[int, int, int]] | None, dict]]:
    """(chunks as (number of the first frame, place, bytes), channels) of each partition; no chunks: the file in order."""
    with Source(path) as source:
        known = index(source)
        channels = known.of(topic, schema) if known else []
        if not known or not counted(source, known, channels):
            return [(None, {})]
    frame, parts = 0, []
    for c in known.chunks:
        if c.n and (start_ns is None or c.last_ns >= start_ns) and (end_ns is None or c.first_ns <= end_ns):
            parts.append((c.size, (frame, c.at, c.size)))
        frame += c.n
    return [(group, known.channels) for group in grouped(parts, split_bytes)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.topic, self.stride = resolve(options["path"]), options.get("topic"), int(options.get("stride", 1))
        self.split = int(options.get("split_bytes", 64 << 20))
        self.start, self.end = (int(options[k]) if k in options else None for k in ("start_ns", "end_ns"))

    def partitions(self) -> list[InputPartition]:
        # One topic for all files of a recording: the first one met, in the files' order.
        topic = self.topic or next((t for f in self.files if (t := _first_topic(f, SCHEMA_NAME)) is not None), None)
        return [InputPartition((f, topic, *part)) for f in self.files if topic is not None for part in plan(f, topic, self.split, self.start, self.end)]

    def _messages(self, path: str, chunks: list | None, channels: dict) -> Iterator[tuple[int, Message]]:
        """(frame, message) of the topic's lidar messages."""
        with Source(path) as source:
            if chunks is None:
                yield from enumerate(m for m in messages(_started(source)) if self._wanted(m))
            for frame, at, size in chunks or []:
                yield from enumerate((m for m in messages(io.BytesIO(source.at(at, size)), dict(channels)) if self._wanted(m)), frame)

    def _wanted(self, m: Message) -> bool:
        return m.schema == SCHEMA_NAME and m.topic == self.own

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has a message of the topic
            return
        path, self.own, chunks, channels = partition.value
        name = Path(path).stem
        for index, message in self._messages(path, chunks, channels):
            if (self.start is not None and message.log_time_ns < self.start) or (self.end is not None and message.log_time_ns > self.end):
                continue
            points = decode_lidar_message(message.data, self.stride)
            # The message's time base, or its publish or log time where that is 0.
            time_ns, n = points.timebase_ns or message.publish_time_ns or message.log_time_ns, len(points.xyz)
            columns = [
                pa.array([name] * n), pa.array([message.topic] * n), pa.array([index] * n, pa.int32()), pa.array(range(n), pa.int64()), *(pa.array(points.xyz[:, i], pa.float32()) for i in range(3)),
                pa.array(points.reflectivity, pa.float32()), pa.array(points.tag.astype("i2")), pa.array(points.line.astype("i2")), pa.array(points.offset_s), pa.array(time_ns * 1e-9 + points.offset_s), pa.array([time_ns] * n, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COLUMNS.split(", ")])


class LidarMcap(DataSource):
    """spark.read.format("lidar_mcap").option("topic", ...).option("stride", ...).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "lidar_mcap"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
