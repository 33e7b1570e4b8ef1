"""Sharding by fixed virtual slots, in DataFrame operations only.

Records are hashed by id into a fixed number of virtual slots; bytes are aggregated for each slot; a versioned map says
which shard holds each slot. Version 1 deals slots in turn; version 2 is version 1 edited to balance bytes: slots move
from shards above the mean to shards below it. The map has as many rows as there are slots, whatever the input, so it is
planned on the driver and broadcast. It is stored as a table (version, slot, shard).

The law kept is `bytes`: shard sizes are near equal. (Slots depend on the id alone, so adding a shard is another edit of
the map; see grown().)

Where ids are null or repeated, an id would tie its rows to one slot, however many they are. Then rows are numbered in the
order of id, checksum and size, and the slot is a hash of all four, so that the law holds for them as well.

Cases: a null or empty text has 16 bytes; null and repeated ids spread over all slots, rows alike in everything included;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import plain_ids, scratch, written


@dataclass(frozen=True)
class ShardConfig:
    shards: int = 40
    slots: int = 16384
    row_bytes: int = 16


def rebalanced(current: list[int], load: list[int], shards: int) -> list[int]:
    """current (slot to shard) edited so that shards' loads are near equal: slots leave shards above the mean, largest
    first where they fit, and go to the least loaded shard. Deterministic."""
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    total = [0] * shards
    for slot, shard in enumerate(current):
        held[shard].append((load[slot], slot))
        total[shard] += load[slot]
    mean = sum(total) / shards
    loose = []
    for shard in range(shards):
        for size, slot in sorted(held[shard], reverse=True):
            if total[shard] <= mean:
                break
            if size and (total[shard] - size >= mean * 0.98 or total[shard] - mean > mean - (total[shard] - size)):
                total[shard] -= size
                loose.append((size, slot))
    out = list(current)
    heap = [(t, s) for s, t in enumerate(total)]
    heapq.heapify(heap)
    for size, slot in sorted(loose, reverse=True):
        t, s = heapq.heappop(heap)
        out[slot] = s
        heapq.heappush(heap, (t + size, s))
    return _refined(out, load, shards)


def _refined(slot_map: list[int], load: list[int], shards: int, rounds: int = 4000) -> list[int]:
    """Single moves from the fullest to the emptiest shard while the difference between them shrinks."""
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(slot_map):
        if load[slot]:
            held[shard].append((load[slot], slot))
    total = [sum(x for x, _ in h) for h in held]
    for _ in range(rounds):
        hi, lo = max(range(shards), key=total.__getitem__), min(range(shards), key=total.__getitem__)
        gap = total[hi] - total[lo]
        best = max((x for x in held[hi] if x[0] < gap), key=lambda x: min(x[0], gap - x[0]), default=None)
        if best is None:
            break
        held[hi].remove(best)
        held[lo].append(best)
        total[hi] -= best[0]
        total[lo] += best[0]
        slot_map[best[1]] = lo
    return slot_map


def grown(slot_map: list[int], load: list[int], shards: int) -> list[int]:
    """slot_map edited for one more shard: slots move only into the new shard, from the fullest ones."""
    out, total = list(slot_map), [0] * shards
    for slot, shard in enumerate(out):
        total[shard] += load[slot]
    target, taken = sum(total) / (shards + 1), 0
    for slot in sorted(range(len(out)), key=lambda x: -load[x]):
        if load[slot] and total[out[slot]] - load[slot] >= target * 0.98 and taken + load[slot] <= target * 1.02:
            total[out[slot]] -= load[slot]
            taken += load[slot]
            out[slot] = shards
    return out


def stored_map(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """The latest version of the map below path, and its slots' shards in order; None if there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    rows = spark.read.schema("version int, slot int, shard int").parquet(path)
    version = rows.agg(F.max("version").alias("v")).first()["v"]
    return None if version is None else (version, [r["shard"] for r in rows.where(F.col("version") == version).orderBy("slot").collect()])  # one row a slot


def store_map(spark: SparkSession, path: str, version: int, slot_map: list[int]) -> None:
    """Adds a version to the map below path; earlier ones stay."""
    rows = [(version, s, x) for s, x in enumerate(slot_map)]
    spark.createDataFrame(rows, "version int, slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def next_map(spark: SparkSession, loads: DataFrame, cfg: ShardConfig, path: str) -> list[int]:
    """The map below path, edited to balance loads and stored as its next version; loads: (virtual_slot, bytes), one row a slot at most."""
    load = [0] * cfg.slots
    for r in loads.collect():  # at most cfg.slots rows
        load[r["virtual_slot"]] = int(r["bytes"])
    found = stored_map(spark, path)
    if found is None:
        found = (1, [s % cfg.shards for s in range(cfg.slots)])
        store_map(spark, path, *found)
    version, current = found
    held = max(current) + 1
    if len(current) != cfg.slots or held > cfg.shards:
        raise ValueError(f"the stored map has {len(current)} slots and {held} shards")
    for shards in range(held, cfg.shards):
        current = grown(current, load, shards)
    edited = rebalanced(current, load, cfg.shards)
    store_map(spark, path, version + 1, edited)
    return edited


def shard(docs: DataFrame, cfg: ShardConfig = ShardConfig(), id_col: str = "doc_id", map_path: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot (place in the shard, gapless from 0), grown_shard, virtual_slot.

    map_path: where the map's versions are kept; without one, the map is made for this call alone and goes with its scratch space.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + cfg.row_bytes).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    known = ["doc_id"]
    if not plain_ids(docs, id_col):
        order = [F.col(c).asc_nulls_first() for c in ("doc_id", "text_crc32", "size")]
        slim = written(slim.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
        known = ["doc_id", "text_crc32", "size", "_row"]
    slim = written(slim.withColumn("virtual_slot", F.pmod(F.xxhash64(*known), F.lit(cfg.slots)).cast("int")))
    loads = slim.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    held = next_map(spark, loads.select("virtual_slot", "bytes"), cfg, map_path or scratch(spark))
    maps = spark.createDataFrame(list(enumerate(held)), "virtual_slot int, shard int")
    # Places: rows of a slot follow those of the shard's earlier slots. One row a slot, so both sides are bounded by cfg.slots.
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = loads.join(F.broadcast(maps), "virtual_slot").withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("virtual_slot", "shard", "base")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return slim.withColumn("_n", F.row_number().over(within) - 1).join(F.broadcast(placed), "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("_n")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
