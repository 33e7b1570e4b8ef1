"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Candidates are dealt into blocks of bounded size. A block's index has, for each component, posting segments by quantised
level. A query takes the segments by descending impact (the most that a posting in it can add to a score) and adds to
accumulators. It stops only on proof: with the impacts still open, vectors whose upper bound lies below the k-th lower
bound can't be members. The possible members are rescored exactly, and the blocks' results are merged for each query.

Queries are a stated set and meet all candidates: copies of the queries go to each block, where the index is made once
from the block's candidates (bounded in number) and the queries stream through it in batches. Components are
floor(scale * x) of x as a double.

Cases: vectors that are null, or hold a null or a component that isn't finite, take no part, nor does one with a component
whose scaled value is beyond a long; scores beyond a long are its limits; shorter vectors have zeros at the end; an empty
vector scores 0; ties go to the smaller id; null and repeated ids are rows of their own (see keyed()), and a query isn't
its own candidate; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import keyed, written


@dataclass(frozen=True)
class TopkConfig:
    """levels: equal steps that each component is quantised to; block: candidates of a block (about); rest: share of a block
    that may be rescored once it is proven to hold all members."""

    k: int = 10
    scale: float = 1024.0
    levels: int = 32
    block: int = 16384
    rest: float = 0.1


class ImpactIndex:
    """Posting segments (component, level) of a block of integer vectors."""

    def __init__(self, values: np.ndarray, levels: int):
        self.values = values
        n, dims = values.shape
        segments = []
        for d in range(dims):
            column = values[:, d]
            least, width = column.min(), (column.max() - column.min()) / levels
            level = np.minimum(((column - least) / width).astype(np.int64), levels - 1) if width > 0 else np.zeros(n, np.int64)
            order = np.argsort(level, kind="stable")
            cuts = np.flatnonzero(np.diff(level[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], n], strict=True):
                ids = order[a:b]
                segments.append((d, column[ids].min(), column[ids].max(), ids))
        self.dim = np.array([s[0] for s in segments], np.int64)
        self.low = np.array([s[1] for s in segments], values.dtype)
        self.high = np.array([s[2] for s in segments], values.dtype)
        self.ids = [s[3] for s in segments]

    def search(self, query: np.ndarray, k: int, rest: float) -> np.ndarray:
        """Places of the vectors that may be among the k best; those that are left out can't be."""
        n, dims = self.values.shape
        if n <= max(4 * k, 64) or not dims:
            return np.arange(n)
        q = query[self.dim]
        a, b = q * self.low, q * self.high
        least, most = np.minimum(a, b), np.maximum(a, b)
        floor = np.full(dims, np.inf)
        np.minimum.at(floor, self.dim, least)
        impact = most - floor[self.dim]
        order = np.argsort(-impact, kind="stable")
        # What is still open in each component after each step: the impact of its next segment.
        by_dim = order[np.argsort(self.dim[order], kind="stable")]
        following = np.zeros(len(order))
        same = self.dim[by_dim][1:] == self.dim[by_dim][:-1]
        following[by_dim[:-1][same]] = impact[by_dim[1:][same]]
        top = np.zeros(dims)
        np.maximum.at(top, self.dim, impact)
        open_after = top.sum() - np.cumsum(impact[order] - following[order])
        width = np.zeros(dims)
        upper = np.zeros(n)
        enough, check = max(4 * k, int(rest * n)), max(16, len(order) // 16)
        for step, s in enumerate(order.tolist()):
            upper[self.ids[s]] += impact[s]
            width[self.dim[s]] = max(width[self.dim[s]], most[s] - least[s])
            if step % check == check - 1:
                bound = np.partition(upper, n - k)[n - k] - width.sum()  # the k-th lower bound
                possible = upper + max(open_after[step], 0.0) * (1 + 1e-9) >= bound * (1 - 1e-9) - 1
                if np.count_nonzero(possible) <= enough:
                    return np.flatnonzero(possible)
        bound = np.partition(upper, n - k)[n - k] - width.sum()
        return np.flatnonzero(upper >= bound - 1 - abs(bound) * 1e-9)


def _matrix(column: list[bytes], dims: int) -> np.ndarray:
    """Vectors as rows of dims components, cut or with zeros at the end."""
    out = np.zeros((len(column), dims), np.int64)
    for i, raw in enumerate(column):
        v = np.frombuffer(raw, "<i8")[:dims]
        out[i, : len(v)] = v
    return out


def _scores(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every sum stays below 2**53, in longs below 2**62, else without a bound."""
    most = float(np.abs(values.astype(np.float64)).max(initial=0)) * float(np.abs(query.astype(np.float64)).max(initial=0)) * max(1, len(query))
    if most < 2.0**53:
        return np.rint(values.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return (values * query).sum(axis=1, dtype=np.int64)
    exact = (values.astype(object) * query.astype(object)).sum(axis=1)
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in exact], np.int64)


class Block:
    """One block's candidates (keys in order, ids, vectors) and their index."""

    def __init__(self, keys: list[int], ids: list, vectors: list[bytes], cfg: TopkConfig):
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.cfg, self.keys, self.ids = cfg, np.array(keys, np.int64)[order], [ids[i] for i in order]
        self.values = _matrix([vectors[i] for i in order], max(len(v) // 8 for v in vectors))
        self.index = ImpactIndex(self.values.astype(np.float64), cfg.levels)

    def best(self, key: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the query's k best candidates."""
        places = self.index.search(query.astype(np.float64), self.cfg.k + 1, self.cfg.rest)  # one more: the query's own row may be there
        places = places[self.keys[places] != key]
        scores = _scores(self.values[places], query)
        best = np.lexsort((places, ~scores))[: self.cfg.k]
        return places[best], scores[best]


def searched(rows: DataFrame, cfg: TopkConfig) -> DataFrame:
    """Rows (query_key, query_id, _key, vec_id, score) of each block's best; rows: (_block, _asks, _key, _id, q), dealt and
    sorted by block, candidates (_asks false) first."""
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["query_key", "query_id", "_key", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, block = None, ([], [], []), None
        for batch in batches:
            blocks, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])))) if len(blocks) else []
            for a, b in zip(cuts, [*cuts[1:], len(blocks)], strict=True):
                if blocks[a] != own:
                    own, held, block = blocks[a], ([], [], []), None
                keys, ids, vectors = (batch.column(i).slice(a, b - a).to_pylist() for i in (2, 3, 4))
                if not asks[a]:
                    for to, new in zip(held, (keys, ids, vectors), strict=True):
                        to.extend(new)
                    continue
                if block is None and held[0]:
                    block = Block(*held, cfg)
                out: list[list] = [[], [], [], [], []]
                for key, name, query in zip(keys, ids, _matrix(vectors, block.values.shape[1]) if block else [], strict=bool(block)):
                    places, scores = block.best(key, query)
                    for to, new in zip(out, ([key] * len(places), [name] * len(places), block.keys[places].tolist(), [block.ids[p] for p in places], scores.tolist()), strict=True):
                        to += new
                t = batch.schema.field("_id").type
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(out, (pa.int64(), t, pa.int64(), t, pa.int64()), strict=True)], names)

    return rows.select("_block", "_asks", "_key", "_id", "q").mapInArrow(run, f"query_key long, query_id {kind}, _key long, vec_id {kind}, score long")


def quantised(rows: DataFrame, cfg: TopkConfig) -> DataFrame:
    """(_id, _key, q): q holds floor(scale * x) as little-endian longs; rows that take no part are gone."""
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.floor(cfg.scale * np.asarray(v, np.float64)).astype("<i8").tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["_id", "_key", "q"])

    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = F.col("embedding").cast("array<double>")
    fits = lambda x: F.abs(F.lit(cfg.scale) * x) < 2.0**63
    kept = rows.where(F.col("embedding").isNotNull() & F.forall(vector, good) & F.forall(vector, fits)).select("_id", "_key", vector.alias("v"))
    return kept.mapInArrow(run, f"_id {kind}, _key long, q binary")


def top_k(table: DataFrame, is_query: Column, cfg: TopkConfig = TopkConfig(), id_col: str = "vec_id") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best candidates of each query; is_query is a condition on `_id`."""
    rows = written(quantised(keyed(table, id_col, ("embedding",)), cfg))
    blocks = -(-max(rows.count(), 1) // cfg.block)
    left = rows.select(F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int").alias("_block"), F.lit(False).alias("_asks"), "_key", "_id", "q")
    right = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(True).alias("_asks"), "_key", "_id", "q")
    found = searched(left.unionByName(right).repartition("_block").sortWithinPartitions("_block", "_asks"), cfg)
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "_key")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")
