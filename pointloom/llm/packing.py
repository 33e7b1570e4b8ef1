"""Packing by shortest-pack-first over the length histogram.

Each document's tokens (with a closing id) are cut into pieces: full sequences, then the rest. Only the histogram of
piece lengths reaches the driver: it has max_len entries at most. Lengths are placed longest first, each into the pack
with the most room left that still holds it, on packing patterns with counts, never on single pieces. Patterns become
runs (length, rank from, rank to, first sequence, offset), and pieces find theirs by their rank within their length.

Cases: a null or empty text is the closing id alone; a document of any length is cut into as many pieces as it needs;
repeated rows are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import written
from ._vocab import read_file, shared
from ._words import chunks


@dataclass(frozen=True)
class PackConfig:
    """salts: parts of each length's ranking, so that a common length isn't ranked in one task."""

    max_len: int = 1024
    end_id: int = 0
    salts: int = 128


class ByteBpe:
    """Ids of a byte-level `tokenizers` file, as little-endian 32-bit bytes.

    The file's merges are ranked by their ids, and a rank coder gives the same ids: two tokens side by side that spell a
    merged token are always the two of its merge, since within their span merges went as they would alone. Strings of
    special tokens are those tokens, as by the library's default.
    """

    def __init__(self, data: bytes):
        import tiktoken

        spec = json.loads(data)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)._core_bpe
        self.names = set(self.special)

    def encode(self, text: str | None) -> bytes:
        return bytes(self.core.encode_to_tiktoken_buffer(text, self.names)) if text else b""

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]


def pieces(docs: DataFrame, path: str, cfg: PackConfig = PackConfig(), id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Rows (id_col, start, length, ids_crc32, doc_tokens[, ids]): every document cut into pieces of max_len at most."""
    data = docs.sparkSession.sparkContext.broadcast(read_file(path))  # a vocabulary file, of fixed size
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared("byte_bpe", data.value, ByteBpe)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, 2 << 20):
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, doc in enumerate(coder.encode_all(texts[a:b])):
                    doc += cfg.end_id.to_bytes(4, "little")
                    for at in range(0, len(doc), 4 * cfg.max_len):
                        piece = doc[at : at + 4 * cfg.max_len]
                        row.append(a + i)
                        start.append(at // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(doc) // 4)
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<i4"))
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def pack_patterns(histogram: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, count): lengths packed together, longest first, and how many sequences are packed so."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        free = max_len
        while left > 0:
            while free >= length and not room.get(free):
                free -= 1
            if free < length:
                room[max_len - length].append(((length,), left))
                break
            pattern, count = room[free].pop()
            used = min(count, left)
            if count > used:
                room[free].append((pattern, count - used))
            room[free - length].append((pattern + (length,), used))
            left -= used
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in room.values():
        for pattern, count in packs:
            merged[pattern] += count
    return sorted(merged.items(), reverse=True)


def runs(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank from, rank to, first sequence, offset): where the pieces of each length go, by rank."""
    out, taken, first = [], defaultdict(int), 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            out.append((length, taken[length], taken[length] + count, first, offset))
            taken[length] += count
            offset += length
        first += count
    return out


def pack(cut: DataFrame, cfg: PackConfig = PackConfig(), id_col: str = "doc_id") -> DataFrame:
    """cut (a written table of pieces()) with sequence_id and offset."""
    spark = cut.sparkSession
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(id_col, "start"), F.lit(cfg.salts)).cast("int"))
    counted = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    cells = [(r["length"], r["_salt"], r["n"]) for r in counted.collect()]  # at most max_len * salts rows
    histogram, bases = defaultdict(int), []
    for length, salt, n in sorted(cells):
        bases.append((length, salt, histogram[length]))
        histogram[length] += n
    plan = runs(pack_patterns(histogram, cfg.max_len))
    base = spark.createDataFrame(bases, "length long, _salt int, _base long")
    table = spark.createDataFrame(plan, "length long, _from long, _to long, _first long, offset long")
    within = Window.partitionBy("length", "_salt").orderBy(id_col, "start")
    ranked = salted.withColumn("_n", F.row_number().over(within) - 1).join(F.broadcast(base), ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_n"))
    placed = ranked.join(F.broadcast(table), "length").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(*cut.columns, (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, cfg: PackConfig = PackConfig(), id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Every document's pieces with the sequence and offset that each is packed at."""
    return pack(written(pieces(docs, path, cfg, id_col, with_ids)), cfg, id_col)
