"""Decoders, recordings and files, from bytes built here."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.sources import arrays, cloud, config, mcap, register, rosbag, sinks
from pointloom.sources.cdr import decode_lidar_message


def lidar_message(points=((1000, 1, 2, 3, 42, 16, 0), (2000, 4, 5, 6, 84, 32, 1)), timebase=1_000_000_000):
    head = b"\x00\x01\x00\x00" + struct.pack("<iII", 1, 0, 6) + b"livox\0"
    head += b"\0" * (-(len(head) - 4) % 8)
    return head + struct.pack("<QIB3xI", timebase, len(points), 0, len(points)) + b"".join(struct.pack("<IfffBBBx", *p) for p in points)


def test_lidar_message():
    m = decode_lidar_message(lidar_message())
    assert m.xyz.tolist() == [[1, 2, 3], [4, 5, 6]] and m.reflectivity.tolist() == [42, 84] and m.tag.tolist() == [16, 32]
    assert np.allclose(m.offset_s, [1e-6, 2e-6]) and m.timebase_ns == 10**9
    assert len(decode_lidar_message(lidar_message()[:-1]).xyz) == 2  # the last pad byte may be missing
    assert decode_lidar_message(lidar_message(), 2).xyz.tolist() == [[1, 2, 3]]
    assert len(decode_lidar_message(lidar_message(())).xyz) == 0
    for bad in (b"\x00\x01" + b"\0" * 10, lidar_message()[:-8]):
        with pytest.raises(ValueError):
            decode_lidar_message(bad)


def test_cloud_with_row_padding():
    point = struct.Struct("<fB3x")
    rows = [b"".join(point.pack(*p) for p in r) + b"\0" * 4 for r in (((1.5, 3), (2.5, 4)), ((5.5, 7), (6.5, 8)))]
    fields = [cloud.Field("x", 0, 7), cloud.Field("tag", 4, 2)]
    got = cloud.decode_cloud(cloud.Cloud(2, 2, fields, False, 8, 20, b"".join(rows)))
    assert got["x"].tolist() == [1.5, 2.5, 5.5, 6.5] and got["tag"].tolist() == [3, 4, 7, 8]
    with pytest.raises(ValueError):
        cloud.decode_cloud(cloud.Cloud(2, 2, fields, False, 8, 20, b"".join(rows)[:-1]))
    with pytest.raises(ValueError):
        cloud.decode_cloud(cloud.Cloud(1, 1, [cloud.Field("x", 6, 7)], False, 8, 8, b"\0" * 8))
    big = cloud.decode_cloud(cloud.Cloud(1, 1, [cloud.Field("v", 0, 4, 2)], True, 4, 4, b"\x00\x01\x01\x00"))
    assert big["v"].tolist() == [[1, 256]]
    with pytest.raises(ValueError):
        cloud.lidar_columns(got)


def _s(text):
    return struct.pack("<I", len(text)) + text.encode()


def _mcap(messages, compress):
    import zstandard

    def record(op, body):
        return struct.pack("<BQ", op, len(body)) + body

    inner = record(3, struct.pack("<H", 1) + _s(mcap.SCHEMA_NAME) + _s("ros2msg") + struct.pack("<I", 0))
    inner += record(4, struct.pack("<HH", 1, 1) + _s("/lidar") + _s("cdr") + struct.pack("<I", 0))
    for i, m in enumerate(messages):
        inner += record(5, struct.pack("<HIQQ", 1, i, 5, 7) + m)
    if compress:
        packed = zstandard.ZstdCompressor().compress(inner)
        inner = record(6, struct.pack("<QQQI", 0, 0, len(inner), 0) + _s("zstd") + struct.pack("<Q", len(packed)) + packed)
    return mcap.MAGIC + inner + record(15, b"") + mcap.MAGIC


@pytest.mark.parametrize("compress", [False, True])
def test_mcap(spark, tmp_path, compress):
    (tmp_path / "run_0.mcap").write_bytes(_mcap([lidar_message(), lidar_message(timebase=0)], compress))
    (tmp_path / "run_1.mcap").write_bytes(_mcap([lidar_message()], compress))
    register(spark)
    df = spark.read.format("lidar_mcap").option("topic", "/lidar").load(str(tmp_path))
    assert df.count() == 6
    rows = df.where("recording = 'run_0'").orderBy("frame_index", "point_index").collect()
    assert [r["frame_index"] for r in rows] == [0, 0, 1, 1] and rows[2]["message_time_ns"] == 7 and rows[1]["z"] == 6
    assert spark.read.format("lidar_mcap").option("topic", "/other").load(str(tmp_path)).count() == 0
    assert spark.read.format("lidar_mcap").option("stride", "2").load(str(tmp_path / "run_0")).count() == 2
    assert len(mcap.resolve(str(tmp_path / "run"))) == 2
    with pytest.raises(FileNotFoundError):
        mcap.resolve(str(tmp_path / "none"))


def _bag(messages):
    def fields(**f):
        return b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in f.items())

    def record(head, body):
        return struct.pack("<I", len(head)) + head + struct.pack("<I", len(body)) + body

    inner = b""
    for i, (topic, kind, data) in enumerate(messages):
        conn = struct.pack("<I", i)
        inner += record(fields(op=b"\x07", conn=conn, topic=topic.encode()), fields(topic=topic.encode(), type=kind.encode()))
        inner += record(fields(op=b"\x02", conn=conn, time=struct.pack("<II", 1, 5)), data)
    return rosbag.MAGIC + record(fields(op=b"\x05", compression=b"none", size=struct.pack("<I", len(inner))), inner)


def test_ros_bag(spark, tmp_path):
    head = struct.pack("<III", 0, 2, 3) + _s("lidar")
    spec = [("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("intensity", 12, 7), ("tag", 16, 2), ("line", 17, 2), ("timestamp", 18, 8)]
    body = struct.pack("<ffffBBd", 1, 2, 3, 4, 5, 6, 2.5e9)
    message = head + struct.pack("<II", 1, 1) + struct.pack("<I", len(spec)) + b"".join(_s(n) + struct.pack("<IBI", o, t, 1) for n, o, t in spec) + struct.pack("<BII", 0, 26, 26) + struct.pack("<I", 26) + body + b"\1"
    odometry = struct.pack("<III", 0, 2, 3) + _s("map") + _s("body") + struct.pack("<7d", 1, 2, 3, 0, 0, 0, 1) + struct.pack("<36d", *[0] * 36)
    transform = struct.pack("<I", 1) + struct.pack("<III", 0, 0, 0) + _s("base") + _s("lidar") + struct.pack("<7d", 1, 0, 0, 0, 0, 0, 1)
    (tmp_path / "a_livox.bag").write_bytes(_bag([("/p", "sensor_msgs/PointCloud2", message), ("/o", "nav_msgs/Odometry", odometry), ("/tf_static", "tf2_msgs/TFMessage", transform)]))
    register(spark)
    path = str(tmp_path / "a_livox.bag")
    (p,) = spark.read.format("ros_bag").load(path).collect()
    assert (p["header_time_ns"], p["x"], p["tag"], p["time_ns"], p["frame_id"]) == (2_000_000_003, 1.0, 5, 2_500_000_000, "lidar")
    (o,) = spark.read.format("ros_bag").option("kind", "odometry").load(path).collect()
    assert (o["tx"], o["qw"], o["world_frame"], o["body_frame"]) == (1.0, 1.0, "map", "body")
    from pointloom.operators.poses import static_transform

    t = static_transform(spark.read.format("ros_bag").option("kind", "transforms").load(path), "base", "lidar").first()
    assert t["consistent"] and t["tx"] == 1.0
    with pytest.raises(FileNotFoundError):
        rosbag.resolve_session(str(tmp_path))


def test_archives(spark, tmp_path):
    np.savez(tmp_path / "a.npz", xyz=np.ones((3, 3), np.float32), label=np.array([0, 1, 255], np.uint8), session_id=np.array("s"), frame_ptr=np.array([0, 3]))
    register(spark)
    df = spark.read.format("npz").option("length_of", "label").load(str(tmp_path / "a.npz"))
    assert set(df.columns) == {"x", "y", "z", "label", "session_id", "file"} and [r[0] for r in df.select("label").collect()] == [0, 1, 255]
    df.select("x", "label").coalesce(1).write.format("npz").mode("append").save(str(tmp_path / "out"))
    assert len(arrays.table_of(str(next((tmp_path / "out").glob("*.npz"))))) == 3


def test_ply(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 1)], "x double, y double, z double, label int")
    assert sinks.write_ply(str(tmp_path / "a.ply"), df, colour=sinks.label_colour(F.col("label")), extra=["label"]) == 1
    lines = (tmp_path / "a.ply").read_text().splitlines()
    assert "element vertex 1" in lines and lines[-1] == "1.00000 2.00000 3.00000 220 60 40 1"


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text("[a]\nx = 2\n[b]\npath = 'f.txt'\n")
    got = config.load_toml(tmp_path / "c.toml", {"a": {"x": 1, "y": 5}, "b": {"path": ""}}, ["b.path"])
    assert got["a"] == {"x": 2, "y": 5} and got["b"]["path"] == str(tmp_path / "f.txt")
    with pytest.raises(ValueError):
        config.load_toml(tmp_path / "c.toml", {"a": {}})
    with pytest.raises(ValueError):
        config.alignment({"matrix": [0] * 16})
    assert config.alignment({"matrix": [1.0] * 16, "validated": True}).shape == (4, 4)
    record = config.provenance({"k": 1}, [tmp_path / "c.toml"], root=tmp_path)
    assert record["git"] is None and len(record["config_sha256"]) == 64 and record["sources"][0]["sha256"] == config.sha256_file(tmp_path / "c.toml")


def test_formats_are_known_in_other_threads(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def round_trip():
        register(spark)
        spark.range(3).write.format("npz").mode("append").save(str(tmp_path / "archives"))
        return sorted(r["id"] for r in spark.read.format("npz").load(str(tmp_path / "archives")).collect())

    with ThreadPoolExecutor(1) as pool:
        assert pool.submit(round_trip).result() == [0, 1, 2]


def _indexed_mcap(chunks, indexed=True):
    """chunks: lists of (channel, log time, data); channel 1 is /lidar, 2 is /other, 3 is /text (another schema)."""

    def record(op, body):
        return struct.pack("<BQ", op, len(body)) + body

    names = record(3, struct.pack("<H", 1) + _s(mcap.SCHEMA_NAME) + _s("ros2msg") + struct.pack("<I", 0)) + record(3, struct.pack("<H", 2) + _s("std_msgs/String") + _s("ros2msg") + struct.pack("<I", 0))
    for number, schema, topic in ((1, 1, "/lidar"), (2, 1, "/other"), (3, 2, "/text")):
        names += record(4, struct.pack("<HH", number, schema) + _s(topic) + _s("cdr") + struct.pack("<I", 0))
    out, infos, counts = mcap.MAGIC + record(1, _s("") + _s("test")), b"", {}
    for messages in chunks:
        inner, places = names, {}
        for channel, time, data in messages:
            places.setdefault(channel, []).append((time, len(inner)))
            counts[channel] = counts.get(channel, 0) + 1
            inner += record(5, struct.pack("<HIQQ", channel, 0, time, time) + data)
        times = [t for _, t, _ in messages]
        body = record(6, struct.pack("<QQQI", min(times), max(times), len(inner), 0) + _s("") + struct.pack("<Q", len(inner)) + inner)
        at, out, offsets, first = len(out), out + body, b"", len(out) + len(body)
        for channel, own in places.items():
            offsets += struct.pack("<HQ", channel, len(out))
            out += record(7, struct.pack("<HI", channel, 16 * len(own)) + b"".join(struct.pack("<QQ", *o) for o in own))
        infos += record(8, struct.pack("<QQQQ", min(times), max(times), at, len(body)) + struct.pack("<I", len(offsets)) + offsets + struct.pack("<Q", len(out) - first) + _s("") + struct.pack("<QQ", len(inner), len(inner)))
    if not indexed:
        return out + record(15, b"") + mcap.MAGIC
    stats = struct.pack("<QHIIIIQQ", sum(counts.values()), 2, 3, 0, 0, len(chunks), 0, 0) + struct.pack("<I", 10 * len(counts)) + b"".join(struct.pack("<HQ", *c) for c in counts.items())
    out += record(15, struct.pack("<I", 0))
    return out + names + infos + record(11, stats) + record(2, struct.pack("<QQI", len(out), 0, 0)) + mcap.MAGIC


def test_mcap_is_split_by_chunks(spark, tmp_path):
    rng = np.random.default_rng(4)
    chunks, time = [], 0
    for c in range(12):
        messages = []
        for _ in range(int(rng.integers(1, 6))):
            time += 10
            channel = 3 if c == 0 else int(rng.integers(1, 4))
            points = [(i, c, i, time, 9, 1, 2) for i in range(int(rng.integers(0, 40)))]
            messages.append((channel, time, lidar_message(points, timebase=time + 5) if channel < 3 else b"text"))
        chunks.append(messages)
    chunks[1].append((2, time + 1, lidar_message()))
    for name, indexed in (("split", True), ("whole", False)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run_0.mcap").write_bytes(_indexed_mcap(chunks, indexed))
        (tmp_path / name / "run_1.mcap").write_bytes(_indexed_mcap([[(2, 5, lidar_message())], [(1, 6, lidar_message())]], indexed))
    register(spark)

    def read(name, **options):
        return spark.read.format("lidar_mcap").options(**options).load(str(tmp_path / name))

    for options in ({}, {"topic": "/lidar"}, {"topic": "/other"}, {"topic": "/none"}, {"start_ns": "120", "end_ns": "230", "topic": "/lidar"}, {"stride": "3"}):
        want = sorted(map(str, read("whole", **options).collect()))
        assert sorted(map(str, read("split", split_bytes="900", **options).collect())) == want, options
    first = next(ch for m in chunks for ch, _, _ in m if ch < 3)
    assert {r["topic"] for r in read("split").select("topic").distinct().collect()} == {"", "/lidar", "/other"} & {["/lidar", "/other"][first - 1]}  # one topic for all files
    assert read("split", topic="/lidar", split_bytes="900").rdd.getNumPartitions() > 4 >= read("whole", topic="/lidar").rdd.getNumPartitions()
    path = str(tmp_path / "split" / "run_0.mcap")
    whole, some = mcap.plan(path, "/lidar", 1, None, None), mcap.plan(path, "/lidar", 1, 120, 150)
    size = lambda parts: sum(n for group, _ in parts for _, _, n in group)
    assert 0 < size(some) < size(whole) / 2  # a time range reads fewer bytes


def test_bag_is_split_by_chunks(spark, tmp_path):
    def fields(**f):
        return b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in f.items())

    def record(head, body):
        return struct.pack("<I", len(head)) + head + struct.pack("<I", len(body)) + body

    u, t = lambda n: struct.pack("<I", n), lambda ns: struct.pack("<II", ns // 10**9, ns % 10**9)
    spec = [("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("intensity", 12, 7), ("tag", 16, 2), ("line", 17, 2), ("timestamp", 18, 8)]

    def cloud_bytes(x, n):
        body = b"".join(struct.pack("<ffffBBd", x, i, 3, 4, 5, 6, 2.5e9) for i in range(n))
        return struct.pack("<III", 0, 2, 3) + _s("lidar") + struct.pack("<II", 1, n) + u(len(spec)) + b"".join(_s(a) + struct.pack("<IBI", o, k, 1) for a, o, k in spec) + struct.pack("<BII", 0, 26, 26 * n) + u(26 * n) + body + b"\1"

    odometry = struct.pack("<III", 0, 2, 3) + _s("map") + _s("body") + struct.pack("<7d", 1, 2, 3, 0, 0, 0, 1) + struct.pack("<36d", *[0] * 36)
    kinds = {0: ("/p", "sensor_msgs/PointCloud2"), 1: ("/o", "nav_msgs/Odometry"), 2: ("/q", "sensor_msgs/PointCloud2")}
    connections = {c: record(fields(op=b"\x07", conn=u(c), topic=a.encode()), fields(topic=a.encode(), type=k.encode())) for c, (a, k) in kinds.items()}
    rng, time = np.random.default_rng(9), 0
    head = lambda at, n: record(fields(op=b"\x03", index_pos=struct.pack("<Q", at), conn_count=u(3), chunk_count=u(n)), b" " * 4000)
    out, infos = rosbag.MAGIC + head(0, 0), b""
    for c in range(9):
        inner, counts, first = b"".join(connections.values()) if c == 0 else b"", {}, time
        for _ in range(int(rng.integers(1, 6))):
            time += 10
            own = 0 if c == 4 else int(rng.integers(0, 3))
            counts[own] = counts.get(own, 0) + 1
            inner += record(fields(op=b"\x02", conn=u(own), time=t(time)), odometry if own == 1 else cloud_bytes(time, int(rng.integers(0, 30))))
        infos += record(fields(op=b"\x06", ver=u(1), chunk_pos=struct.pack("<Q", len(out)), start_time=t(first + 10), end_time=t(time), count=u(len(counts))), b"".join(u(a) + u(b) for a, b in counts.items()))
        out += record(fields(op=b"\x05", compression=b"none", size=u(len(inner))), inner)
    place = len(out)
    (tmp_path / "split.bag").write_bytes(out[: len(rosbag.MAGIC)] + head(place, 9) + out[len(rosbag.MAGIC) + len(head(0, 0)) :] + b"".join(connections.values()) + infos)
    (tmp_path / "whole.bag").write_bytes(out)
    register(spark)

    def read(name, **options):
        return spark.read.format("ros_bag").options(**options).load(str(tmp_path / f"{name}.bag"))

    for options in ({}, {"topic": "/p"}, {"kind": "odometry"}, {"topic": "/q", "start_ns": "60", "end_ns": "170"}):
        want = sorted(map(str, read("whole", **options).drop("bag").collect()))
        assert want and sorted(map(str, read("split", split_bytes="500", **options).drop("bag").collect())) == want, options
    assert read("split", split_bytes="500").rdd.getNumPartitions() > 3 and read("whole").rdd.getNumPartitions() == 1
