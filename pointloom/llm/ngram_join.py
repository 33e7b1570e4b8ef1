"""N-gram Jaccard self-join with set-relation skipping.

A document is its set of distinct word shingles. Two documents link when 100 * |x n y| >= percent * |x u y|; the result
is each document's component under links. Links are found exactly:

* equal sets are one class, and only one of a class takes part;
* an inverted index holds the prefix of each set under one order of all shingles (levels of a corpus-wide count sketch,
  then hash), so that sets which link share a shingle in both prefixes; shingles of one set alone are dropped;
* index level: a list is blocks of equal size and position. From a block's size and position follows the most that a
  probing set can share with any of its members, so useless blocks are skipped whole;
* answer level: a list's least set is its pivot and is compared first. A set that links to the pivot derives its answers
  from the pivot's: it is in the pivot's component, and what that component already reaches isn't probed again. What is
  left to probe are the pairs of a list whose members lie in different components.

Every pair that is left is compared on the full sets (64-bit hashes of shingles). Parity signatures, a lower bound of
the symmetric difference, only keep hopeless pairs back. No group is gathered in a task and no pairs within a component
are made.

Cases: a null or empty text has no shingles and is a component of its own; a text with fewer words than a shingle is one
shingle; ties and repeated rows link; null and repeated ids are rows of their own (see keyed()); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bitmap import bitmap, member
from ._graph import components
from ._io import batch_rows, bounded, carried, keyed, plain_ids, process_cache, restored, written
from ._words import WordHasher, chunks, grams, mix, small
from .substring import Copies, copies_of, later_copies

BLOCK = 1 << 14


@dataclass(frozen=True)
class JoinConfig:
    """size: words of a shingle; percent: the least Jaccard similarity; sketch_bits: log2 of the count sketch's counters
    (16 MB as levels); bits: log2 of the bitmaps' sizes at most (256 MB; they follow the data up to there); copies: entries of the table of equal sets at most."""

    size: int = 3
    percent: int = 90
    sketch_bits: int = 24
    bits: int = 31
    copies: int = 1 << 16

    def overlap(self, n: Column, m: Column) -> Column:
        """The least overlap of linked sets of n and m shingles."""
        return F.ceil((F.lit(self.percent) * (n + m)) / F.lit(100.0 + self.percent) - F.lit(1e-9))

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1


def _hasher() -> WordHasher:
    return process_cache("lower_words", lambda: WordHasher(lower=True))


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hasher = _hasher()
    for a, b in chunks(texts):
        hashes, bounds = hasher.texts(texts[a:b])
        codes = grams(hashes, size)
        for i in range(b - a):
            low, n = bounds[i], bounds[i + 1] - bounds[i]
            own = codes[low : low + n - size + 1] if n >= size else grams(hashes[low : low + n], int(n)) if n else hashes[:0]
            own = np.sort(own)
            yield own if len(own) < 2 else own[np.concatenate(([True], own[1:] != own[:-1]))]


def _print(s: np.ndarray) -> int:
    return int((mix(s).sum(dtype=np.uint64) if len(s) else np.uint64(0)).astype(np.int64))


def survey(own: DataFrame, cfg: JoinConfig) -> DataFrame:
    """One pass: rows (kind 0) with each document's set size n and fingerprint, and rows (kind 1) of a count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << cfg.sketch_bits, np.uint16)  # of one task; a wrong level costs time only
        empty = lambda n, t: pa.nulls(n, t)
        for batch in small(batches):
            sizes, prints = [], []
            for s in shingle_sets(batch.column(1).to_pylist(), cfg.size):
                sizes.append(len(s))
                prints.append(_print(s))
                np.add.at(counts, (s & np.uint64(len(counts) - 1)).astype(np.int64), 1)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), empty(n, pa.binary())], ["kind", "_key", "n", "print", "counts"])
        parts = [(b, counts[b * BLOCK : (b + 1) * BLOCK]) for b in range(len(counts) // BLOCK)]
        parts = [(b, zlib.compress(c.tobytes(), 1)) for b, c in parts if c.any()]
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.array([p[0] for p in parts], pa.int64()), empty(n, pa.int64()), empty(n, pa.int64()), pa.array([p[1] for p in parts], pa.binary())], ["kind", "_key", "n", "print", "counts"])

    return own.select("_key", "text").mapInArrow(run, "kind int, _key long, n long, print long, counts binary")


def sketch_levels(surveyed: DataFrame, cfg: JoinConfig) -> np.ndarray:
    """The level of each of the sketch's counters: eight for each doubling of the count. Partial sketches are added in
    two rounds; the second gives levels, so a byte for each counter reaches the driver."""

    def add(final: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = sums.setdefault(b, np.zeros(BLOCK, np.uint32))
                    own += np.frombuffer(zlib.decompress(raw), np.uint32 if final else np.uint16)
            if sums:
                out = [np.floor(8 * np.log2(1.0 + c)).clip(0, 255).astype(np.uint8) if final else c for c in sums.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([zlib.compress(c.tobytes(), 1) for c in out], pa.binary())], ["block", "counts"])

        return run

    kind = "block long, counts binary"
    parts = surveyed.where("kind = 1").select(F.col("_key").alias("block"), "counts")
    once = parts.repartition("block", F.pmod(F.xxhash64("counts"), F.lit(4))).mapInArrow(add(False), kind)
    levels = np.zeros(1 << cfg.sketch_bits, np.uint8)
    for r in once.repartition("block").mapInArrow(add(True), kind).toLocalIterator():
        levels[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return levels


def _prefix(s: np.ndarray, levels: np.ndarray, cfg: JoinConfig) -> np.ndarray:
    """The first shingles of a set in the global order."""
    level = levels[(s & np.uint64(len(levels) - 1)).astype(np.int64)]
    return s[np.argsort(level, kind="stable")[: cfg.prefix(len(s))]]


def _signature(s: np.ndarray) -> np.ndarray:
    """256 parities of the set's hashes, as four longs."""
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _wide(s: np.ndarray) -> bytes:
    """Parities of the set's hashes, about one for every two shingles. One of half the size is its halves' sum."""
    bits = 1 << max(8, int(len(s)).bit_length() - 1)
    odd = np.bincount((s >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _differing(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their wide signatures."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = np.bitwise_xor.reduce(x.reshape(-1, n)), np.bitwise_xor.reduce(y.reshape(-1, n))
    return int(np.bitwise_count(x ^ y).sum())


class _Lists:
    """The passes over the texts that make the index; copies and levels are broadcast tables of fixed size."""

    def __init__(self, own: DataFrame, copies: Copies, levels: np.ndarray, cfg: JoinConfig):
        self.own, self.cfg = own.select("_key", "text"), cfg
        self.copies, self.levels = (own.sparkSession.sparkContext.broadcast(x) for x in (copies, levels))

    def _sets(self) -> callable:
        copies, cfg = self.copies, self.cfg

        def run(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            """Key and set of documents that have one, without known later copies."""
            keys = batch.column(0).to_numpy()
            sets = list(shingle_sets(batch.column(1).to_pylist(), cfg.size))
            later = later_copies(copies.value, np.array([_print(s) for s in sets], np.int64), keys)
            return ((int(k), s) for k, s, c in zip(keys, sets, later, strict=True) if len(s) and not c)

        return run

    def tokens(self) -> DataFrame:
        """(token) of every prefix."""
        sets, levels, cfg = self._sets(), self.levels, self.cfg

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                found = [_prefix(s, levels.value, cfg) for _, s in sets(batch)]
                if found:
                    token, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int32))], ["token", "c"])

        return self.own.mapInArrow(run, "token long, c int")

    def postings(self, known: Broadcast) -> DataFrame:
        """(token, _key, n, pos, s0..s3) of the prefix shingles that the bitmap knows."""
        sets, levels, cfg = self._sets(), self.levels, self.cfg

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                token, key, size, pos, sign = [], [], [], [], []
                for k, s in sets(batch):
                    prefix = _prefix(s, levels.value, cfg)
                    at = np.flatnonzero(member(known.value, prefix))
                    if len(at):
                        token.append(prefix[at].view(np.int64))
                        pos.append(at)
                        key.append(np.full(len(at), k))
                        size.append(np.full(len(at), len(s)))
                        sign.append(np.tile(_signature(s), (len(at), 1)))
                if token:
                    signs = np.concatenate(sign)
                    columns = [np.concatenate(token), np.concatenate(key), np.concatenate(size), np.concatenate(pos), *(signs[:, i] for i in range(4))]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["token", "_key", "n", "pos", "s0", "s1", "s2", "s3"])

        return self.own.mapInArrow(run, "token long, _key long, n long, pos long, s0 long, s1 long, s2 long, s3 long")

    def full(self, known: Broadcast) -> DataFrame:
        """(_key, n, wide, tokens): size, wide signature and full set of the documents whose keys the bitmap knows."""
        cfg = self.cfg

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                batch = batch.filter(pa.array(member(known.value, batch.column(0).to_numpy())))
                if len(batch):
                    sets = list(shingle_sets(batch.column(1).to_pylist(), cfg.size))
                    columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([_wide(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_key", "n", "wide", "tokens"])

        return self.own.mapInArrow(run, "_key long, n long, wide binary, tokens array<long>")


def _reachable(cfg: JoinConfig) -> Column:
    """Block skipping: whether sets of sizes n and n2 that share a shingle at pos and pos2 can share enough after it."""
    n, m, need = F.col("n"), F.col("n2"), cfg.overlap(F.col("n"), F.col("n2"))
    return (F.least(n, m) >= need) & (F.least(n - F.col("pos"), m - F.col("pos2")) >= need)


def _similar(cfg: JoinConfig) -> Column:
    """Whether the signatures allow the overlap that a link needs."""
    differ = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(1, 4)), F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))))
    return differ <= F.col("n") + F.col("n2") - 2 * cfg.overlap(F.col("n"), F.col("n2"))


def _other() -> list[Column]:
    return [F.col("_key").alias("key2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(4)]]


def _links(pairs: DataFrame, lists: _Lists, cfg: JoinConfig) -> DataFrame:
    """The pairs (u, v) that link; pairs: a written table. Wide signatures rule most others out, then full sets decide."""
    keys = pairs.select(F.explode(F.array("u", "v")).alias("_key"))
    known = pairs.sparkSession.sparkContext.broadcast(bitmap(keys, "_key", cfg.bits))
    sets = written(lists.full(known))
    percent = cfg.percent

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, a, b = (batch.column(i).to_pylist() for i in range(2, 6))
            most = [p + q - 2 * -(-percent * (p + q) // (100 + percent)) for p, q in zip(n, m, strict=True)]
            keep = [_differing(x, y) <= d for x, y, d in zip(a, b, most, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("_key").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"wide_{k}")) for k in "uv")
    near = left.join(bounded(pairs), "u").join(right, "v").select("u", "v", "n_u", "n_v", "wide_u", "wide_v")
    if pairs.count() <= 100_000:  # a small table needn't start a worker for every shuffle partition
        near = near.coalesce(16)
    near = written(near.mapInArrow(plausible, "u long, v long"))
    left, right = (sets.select(F.col("_key").alias(k), F.col("tokens").alias(f"tokens_{k}")) for k in "uv")
    left, right = (side.join(bounded(near.select(k).distinct()), k, "left_semi") for side, k in ((left, "u"), (right, "v")))
    both = left.join(bounded(near), "u").join(right, "v")
    shared, total = F.size(F.array_intersect("tokens_u", "tokens_v")), F.size("tokens_u") + F.size("tokens_v")
    return both.where(100 * shared >= F.lit(percent) * (total - shared)).select("u", "v")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("_key", "key2").alias("u"), F.greatest("_key", "key2").alias("v")).distinct()


def jaccard_components(docs: DataFrame, cfg: JoinConfig = JoinConfig(), id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, _key, component_key) for every row of docs."""
    with batch_rows(docs.sparkSession):
        return _components(docs, cfg, id_col)


def _components(docs: DataFrame, cfg: JoinConfig, id_col: str) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    plain = plain_ids(docs, id_col)
    own = keyed(docs, id_col, plain=plain)
    surveyed = written(survey(own, cfg))
    sized = surveyed.where("kind = 0").select("_key", "n", "print")
    # Aggregates are written before they are joined: as plain tables, so that a join can be split at a hot key.
    classes = sized.where("n > 0").groupBy("print", "n").agg(F.min("_key").alias("rep"), F.count(F.lit(1)).alias("c"))
    classes = written(classes.where("c > 1"))
    hint = classes.orderBy(F.desc("c"), "print").limit(cfg.copies).collect()
    lists = _Lists(own, copies_of([(r["print"], r["rep"]) for r in hint]), sketch_levels(surveyed, cfg), cfg)

    shared = written(lists.tokens().groupBy("token").agg(F.sum("c").alias("c")).where("c > 1").select("token"))
    posts = written(lists.postings(sc.broadcast(bitmap(shared, "token", cfg.bits))))

    # Pivots first. A list of two is settled by that; longer ones go on without their pivots.
    pivots = posts.groupBy("token").agg(F.min_by(F.struct("_key", "n", "pos", "s0", "s1", "s2", "s3"), "_key").alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
    pivots = written(pivots.select("token", "c", "p.*").select("token", "c", *_other()))
    followed = written(posts.join(pivots, "token").where(F.col("_key") != F.col("key2")))
    star = written(_pairs(followed.where(_reachable(cfg) & _similar(cfg))))
    links = written(_links(star, lists, cfg))
    found = components(links)

    # Then what no pivot's answers settle: members of a list that lie in different components.
    longer = followed.where("c > 2").select(*posts.columns)
    labelled = longer.join(found.withColumnRenamed("u", "_key").withColumnRenamed("v", "comp"), "_key", "left").withColumn("comp", F.coalesce("comp", "_key"))
    parts = labelled.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    open_lists = parts.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", "major")
    mixed = written(labelled.join(written(open_lists), "token"))
    # Blocks first: members of blocks that can't reach the overlap are never met.
    blocks = mixed.groupBy("token", "n", "pos", "comp", "major").agg(F.count(F.lit(1)).alias("c"))
    probed = blocks.select("token", F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("comp").alias("comp2"))
    hits = blocks.where("comp <> major").join(probed, "token").where((F.col("comp") != F.col("comp2")) & ((F.col("comp2") == F.col("major")) | (F.col("comp") < F.col("comp2"))) & _reachable(cfg))
    hits = bounded(written(hits.select("token", "n", "pos", "comp", "n2", "pos2", "comp2")))
    other = mixed.select("token", *_other(), F.col("comp").alias("comp2"))
    rest = mixed.drop("major").join(hits, ["token", "n", "pos", "comp"]).join(other, ["token", "n2", "pos2", "comp2"]).where(_similar(cfg))
    rest = written(_pairs(rest).join(star, ["u", "v"], "left_anti"))
    if rest.take(1):
        more = written(_links(rest, lists, cfg))
        if more.take(1):
            found = components(found.unionByName(more))

    member_of = sized.join(classes.select("print", "n", "rep"), ["print", "n"], "left").withColumn("rep", F.coalesce("rep", "_key"))
    member_of = member_of.join(found.withColumnRenamed("u", "rep"), "rep", "left").select("_key", F.col("n").alias("n_shingles"), F.coalesce("v", "rep").alias("component_key"))
    if plain:
        return member_of.select(F.col("_key").cast(docs.schema[id_col].dataType).alias("doc_id"), "n_shingles", F.col("component_key").cast(docs.schema[id_col].dataType).alias("component_id"), "_key", "component_key")
    names = own.select("_key", F.col("_id").alias("doc_id"))
    firsts = own.select(F.col("_key").alias("component_key"), F.col("_id").alias("component_id"))
    return member_of.join(names, "_key").join(firsts, "component_key").select("doc_id", "n_shingles", "component_id", "_key", "component_key")


def deduplicated(docs: DataFrame, cfg: JoinConfig = JoinConfig(), id_col: str = "doc_id") -> DataFrame:
    """docs with the first row of each component alone, with all its columns."""
    own = carried(docs, id_col)
    firsts = jaccard_components(own.select("_key", "text"), cfg, "_key").where("doc_id = component_id").select(F.col("doc_id").alias("_key"))
    return restored(own.join(firsts, "_key", "left_semi"), docs.columns)
