"""Exact ranked lexical search by MaxScore, shard by shard.

A first pass takes the terms of every whole text once and keeps a forward index: for each document its number of terms and
the occurrences of the terms that the items ask for. Statistics (N, L, df) are aggregates of it. A second pass makes an
inverted index of each shard, a bounded run of a task's documents, and answers all items of the block there by MaxScore:
an item's posting lists are taken by descending upper bound; a list is essential as long as the bounds of the lists still
to come could lift a document that none of the taken lists holds to the k-th best score known. From there on no new document
can qualify; the other, non-essential lists are only probed, for the documents that can still get there, and each probe
drops those that can't. The k-th best score of a task's earlier shards is where its next shard starts. Shards' results meet
in two steps, so that no task gets an item's rows from all tasks at once.

Items are a stated query set and meet all documents in blocks of a bounded size; each block reads the documents again.
Scores are whole numbers, as in the contract: weight floor(1000 ln((2N+2)/(2df+1))), saturated by tf and length.

Cases: a null or empty text has no terms and takes no part, nor does one of separators only; an item without terms, or
without a document above 0, has no rows; equal scores go to the smaller id; null and repeated ids are rows of their own
(see keyed()), on both sides, so a repeated item has its ranks for each of its rows; empty tables give an empty result; very
long texts are read in parts cut between terms; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import batch_rows, keyed, written

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
PART = 1 << 22  # bytes of a text that are taken at once


@dataclass(frozen=True)
class SearchConfig:
    """shard: documents of a shard at most; postings: of a shard, about; block_bytes: texts of an item block, about."""

    k: int = 10
    shard: int = 32_768
    postings: int = 4_000_000
    block_bytes: int = 16 << 20
    merge: int = 64


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in parts of bounded size; only A-Z are lower-cased."""
    at, n = 0, len(text or b"")
    while at < n:
        gap = GAP.search(text, at + PART) if at + PART < n else None  # a part goes on to the end of its last term
        end = gap.start() if gap else n
        yield TERM.findall(text[at:end].lower())
        at = end


def item_terms(items: DataFrame) -> DataFrame:
    """(_key, _id, terms, times) of the items that have terms; items: keyed() rows."""
    kind = items.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(t for part in terms(x) for t in part) for x in batch.column(2).to_pylist()]
            has = pa.array([bool(c) for c in counts])
            names, times = [list(c) for c in counts if c], [list(c.values()) for c in counts if c]
            out = [batch.column(0).filter(has), batch.column(1).filter(has), pa.array(names, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["_key", "_id", "terms", "times"])

    return items.select("_key", "_id", F.col("text").cast("binary")).mapInArrow(run, f"_key long, _id {kind}, terms array<binary>, times array<long>")


def forward(docs: DataFrame, vocabulary) -> DataFrame:
    """(_key, _id, n, terms, tfs) of the documents with terms: n counts them all, the lists hold the vocabulary's numbers.

    vocabulary: a broadcast dictionary from term to number; docs: keyed() rows.
    """
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value.get
        for batch in batches:
            sizes, asked, tfs = [], [], []
            for x in batch.column(2).to_pylist():
                n, met = 0, Counter()
                for part in terms(x):
                    n += len(part)
                    met.update(map(known, part))
                met.pop(None, None)
                sizes.append(n)
                asked.append(list(met))
                tfs.append(list(met.values()))
            has = pa.array([n > 0 for n in sizes], pa.bool_())
            out = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(asked, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["_key", "_id", "n", "terms", "tfs"]).filter(has)

    return docs.select("_key", "_id", F.col("text").cast("binary")).mapInArrow(run, f"_key long, _id {kind}, n long, terms array<int>, tfs array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Posting lists (places ascending, impacts) of a run of documents in the order of their keys."""

    def __init__(self, lengths: np.ndarray, places: np.ndarray, numbers: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        m = 25 + (75 * lengths * n_docs) // n_terms
        order = np.lexsort((places, numbers))
        places, numbers, tfs = places[order], numbers[order], tfs[order]
        impacts = weights[numbers] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[places]))
        cuts = np.flatnonzero(np.diff(numbers, prepend=-1))
        self.size = len(lengths)
        self.lists = {int(numbers[a]): (places[a:b], impacts[a:b], int(impacts[a:b].max())) for a, b in zip(cuts, [*cuts[1:], len(numbers)], strict=True)}
        self.read = self.probed = 0  # postings taken whole, and documents probed, so far

    def search(self, asked: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that may be among the k best; least: a score that k documents are known to have."""
        lists = sorted(((t * self.lists[i][2], t, i) for i, t in asked if i in self.lists), reverse=True)
        open_ = np.concatenate((np.cumsum([x[0] for x in lists][::-1])[::-1], [0])).astype(np.int64)  # bounds from a list on
        total, at = np.zeros(self.size, np.int64), 0
        while at < len(lists) and open_[at] >= max(least, 1):
            _, times, number = lists[at]
            places, impacts, _ = self.lists[number]
            total[places] += times * impacts
            self.read += len(places)
            at += 1
            if at < len(lists) and self.size >= k:
                least = max(least, int(np.partition(total, self.size - k)[self.size - k]))
        found = np.flatnonzero((total > 0) & (total + open_[at] >= least))
        scores = total[found]
        for j in range(at, len(lists)):
            if not len(found):
                break
            _, times, number = lists[j]
            places, impacts, _ = self.lists[number]
            where = np.minimum(np.searchsorted(places, found), len(places) - 1)
            scores = scores + np.where(places[where] == found, times * impacts[where], 0)
            self.probed += len(found)
            if len(found) >= k:
                least = max(least, int(np.partition(scores, len(found) - k)[len(found) - k]))
            stay = scores + open_[j + 1] >= least
            found, scores = found[stay], scores[stay]
        return found, scores


class Best:
    """The k best (score, smaller key first) documents of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * n_items
        self.keys = [np.zeros(0, np.int64)] * n_items
        self.ids: list[list] = [[]] * n_items

    def least(self, item: int) -> int:
        return int(self.scores[item][-1]) if len(self.scores[item]) >= self.k else 0

    def add(self, item: int, scores: np.ndarray, keys: np.ndarray, ids: list) -> None:
        scores, keys, ids = np.concatenate((self.scores[item], scores)), np.concatenate((self.keys[item], keys)), self.ids[item] + ids
        order = np.lexsort((keys, -scores))[: self.k]
        self.scores[item], self.keys[item], self.ids[item] = scores[order], keys[order], [ids[i] for i in order]


def searched(index: DataFrame, asked, cfg: SearchConfig, item_kind: str) -> DataFrame:
    """(_item, item_id, _key, doc_id, score): the best of each task, for each item; index: forward() rows.

    asked: broadcast (items as (key, id, [(number, times)]), weights by number, N, L).
    """
    kind = index.schema["_id"].dataType.simpleString()
    names = ["_item", "item_id", "_key", "doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms, item_type = asked.value
        best, held, n, postings, id_type = Best(len(items), cfg.k), [], 0, 0, None

        def answer() -> None:
            table = pa.Table.from_batches(held).combine_chunks().sort_by("_key")
            keys, ids = table["_key"].to_numpy(), table["_id"]
            lists, tfs = (table[c].combine_chunks() for c in ("terms", "tfs"))
            places = np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy(zero_copy_only=False))
            shard = Shard(table["n"].to_numpy(), places, lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy(), weights, n_docs, n_terms)
            for i, (_, _, wanted) in enumerate(items):
                found, scores = shard.search(wanted, cfg.k, best.least(i))
                top = np.lexsort((found, -scores))[: cfg.k]
                if len(top):
                    best.add(i, scores[top], keys[found[top]], ids.take(pa.array(found[top])).to_pylist())

        for batch in batches:
            id_type = batch.schema.field("_id").type
            for a in range(0, len(batch), 1024):
                piece = batch.slice(a, 1024)
                held.append(piece)
                n, postings = n + len(piece), postings + len(piece.column(3).flatten())
                if n + 1024 > cfg.shard or postings > cfg.postings:
                    answer()
                    held, n, postings = [], 0, 0
        if n:
            answer()
        if id_type is None:
            return
        out = [(key, name, x, y, z) for i, (key, name, _) in enumerate(items) for x, y, z in zip(best.keys[i].tolist(), best.ids[i], best.scores[i].tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = (pa.int64(), item_type, pa.int64(), id_type, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return index.select("_key", "_id", "n", "terms", "tfs").mapInArrow(run, f"_item long, item_id {item_kind}, _key long, doc_id {kind}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, cfg: SearchConfig = SearchConfig(), id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    texts = keyed(docs, id_col)
    wanted = keyed(items, item_col)
    item_kind = wanted.schema["_id"].dataType.simpleString()
    wanted = written(item_terms(wanted))
    size = wanted.agg(F.coalesce(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.length(t) + 8)), F.lit(0))).first()[0]
    blocks = -(-size // cfg.block_bytes)
    kind = texts.schema["_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"_item long, item_id {item_kind}, _key long, doc_id {kind}, score long")
    for b in range(blocks):
        # A block's items are on the driver and on the executors; its size is bounded by block_bytes.
        rows = wanted.where(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == b).orderBy("_key").toArrow()
        vocabulary: dict[bytes, int] = {}
        lists = [[(vocabulary.setdefault(bytes(t), len(vocabulary)), n) for t, n in zip(t_, n_, strict=True)] for t_, n_ in zip(rows["terms"].to_pylist(), rows["times"].to_pylist(), strict=True)]
        given = spark.sparkContext.broadcast(vocabulary)
        with batch_rows(spark):
            index = written(forward(texts, given))
            given.unpersist()
            n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
            if not n_docs:
                continue
            weights = np.zeros(len(vocabulary), np.int64)
            for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
                weights[r["t"]] = weight(n_docs, r["df"])
            asked = spark.sparkContext.broadcast((list(zip(rows["_key"].to_pylist(), rows["_id"].to_pylist(), lists, strict=True)), weights, n_docs, n_terms, rows.schema.field("_id").type))
            found = found.unionByName(written(searched(index, asked, cfg, item_kind)))
            asked.unpersist()
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "_key"))
    part = found.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(cfg.merge)))
    few = part.withColumn("_at", place("_item", "_part")).where(F.col("_at") <= cfg.k)
    best = few.withColumn("rank", place("_item")).where(F.col("rank") <= cfg.k)
    return best.select("item_id", "rank", "doc_id", "score")
