"""Merkle manifest of a dataset: leaves, subroots by language, one root, and a proof for every row.

Leaves are native expressions over the rows. Rows get their places by one range sort of digests (no text is dealt) and the
sums of the sorted runs. Blocks of 8**levels consecutive leaves are reduced where they lie; their roots make up the top
tree. If that is small, the driver builds it and broadcasts each block's suffix path (the siblings from the block's root to
the root of all); else the blocks' roots are reduced the same way first, and their paths stay a table. Executors go through
each block once more: they extend its leaves' paths by the block's suffix, hash the proofs and fold every row's path.

Cases: null columns are "-" in a leaf; a null language comes first and has a tree of its own; null and repeated ids stay rows
of their own, ordered by their leaves (rows with one leaf are alike); a null id counts as an empty text for the choice of
tampered rows; an empty table gives an empty result; other columns are ignored. Number of rows and of languages are free: a
block holds 8**levels digests, and more than `most` languages are reduced as a distributed tree as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import bounded, written

WIDTH = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "tree long, pos long, before array<string>, after array<string>, subroot string, root string"


@dataclass(frozen=True)
class MerkleConfig:
    """levels: of a block, which has 8**levels leaves; most: nodes that the driver and a broadcast may hold (about 3 kB each)."""

    levels: int = 3
    most: int = 4096


def _h(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(fields: Iterable[Column]) -> Column:
    """Digest of the fields: `-` for null, else bytes, colon, value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def climb(digests: list[str], total: int, levels: int | None = None) -> tuple[list[list[tuple[str, str]]], list[str]]:
    """Each node's siblings (before, after) level by level, and the nodes above. digests: consecutive nodes, from a place
    that is a multiple of 8**levels, of a tree with `total` nodes; without levels, all of them, up to their root."""
    paths: list[list[tuple[str, str]]] = [[] for _ in digests]
    own, above = list(range(len(digests))), digests
    while total > 1 and levels != 0:
        runs = [above[i : i + WIDTH] for i in range(0, len(above), WIDTH)]
        for path, at in zip(paths, own, strict=True):
            run, i = runs[at // WIDTH], at % WIDTH
            path.append(("".join(run[:i]), "".join(run[i + 1 :])))
        own, above = [at // WIDTH for at in own], [_h(*run) for run in runs]
        total, levels = -(-total // WIDTH), None if levels is None else levels - 1
    return paths, above


def fold(digest: str, path: Iterable[tuple[str, str]]) -> str:
    for before, after in path:
        digest = _h(before, digest, after)
    return digest


def placed(rows: DataFrame, tree: str, order: tuple[str, ...]) -> DataFrame:
    """rows with tree (a long, ascending with the old column, null first), n (the tree's rows) and pos (from 0, by order).

    A sort by ranges numbers the rows; what precedes each run of a tree is a sum over runs: one a partition and tree.
    """
    spark = rows.sparkSession
    by = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = written(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_mid", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_run", F.shiftright("_mid", 33))
    runs = written(numbered.groupBy("_run", F.col(tree).alias("_tree")).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_size")))
    own = "partition by _tree"
    runs = runs.selectExpr("_run", "_tree", "_first", f"sum(_size) over ({own} order by _first) - _size as _before", f"sum(_size) over ({own}) as _n", f"min(_first) over ({own}) as _name")
    met = numbered.alias("a").join(bounded(written(runs)).alias("b"), (F.col("a._run") == F.col("b._run")) & F.col(f"a.{tree}").eqNullSafe(F.col("b._tree")))
    return met.select(*[F.col(f"a.{c}") for c in rows.columns if c != tree], F.col("_name").alias("tree"), F.col("_n").alias("n"), (F.col("_before") + F.col("_mid") - F.col("_first")).alias("pos"))


def _block(cfg: MerkleConfig) -> Column:
    return F.shiftright("pos", 3 * cfg.levels)


def reduced(nodes: DataFrame, cfg: MerkleConfig) -> DataFrame:
    """(tree, n, pos, digest) of the blocks' roots: the nodes of the tree some levels up. nodes: (tree, n, pos, digest)."""
    rows = nodes.groupBy("tree", "n", _block(cfg).alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("own"))
    digests, n = F.transform("own", lambda x: x["digest"]), F.col("n")
    rows = rows.select("tree", "n", "pos", digests.alias("own"))
    for _ in range(cfg.levels):
        up = F.transform(F.sequence(F.lit(1), F.size("own"), F.lit(WIDTH)), lambda i: F.sha2(F.array_join(F.slice("own", i, WIDTH), ""), 256))
        rows = rows.select("tree", F.ceil(n / WIDTH).alias("n"), "pos", F.when(n > 1, up).otherwise(F.col("own")).alias("own"))
    return rows.select("tree", "n", "pos", F.col("own")[0].alias("digest"))


def _top(nodes: list[tuple[int, int, str]], root_only: bool) -> dict[tuple[int, int], tuple]:
    """(path, subroot, root) of each node (tree, pos, digest) of the top tree, on the driver."""
    trees: dict[int, list[tuple[int, str]]] = {}
    for tree, pos, digest in sorted(nodes):
        trees.setdefault(tree, []).append((pos, digest))
    low = {t: climb([d for _, d in own], len(own)) for t, own in trees.items()}
    subroots = [above[0] for _, above in low.values()]
    if root_only:
        high, root = [[]], subroots
    else:
        high, root = climb(subroots, len(subroots))
    return {(t, pos): (path + high[i], subroots[i], root[0]) for i, (t, own) in enumerate(trees.items()) for (pos, _), path in zip(own, low[t][0], strict=True)}


def paths(nodes: DataFrame, cfg: MerkleConfig, root_only: bool = False) -> dict | DataFrame:
    """The path from each node (tree, n, pos, digest; a written table) to the root of all, with subroot and root: by (tree,
    pos) if there are few nodes, else as a table. root_only: there is one tree, whose root is the root of all."""
    if nodes.limit(cfg.most + 1).count() <= cfg.most:
        return _top([(r["tree"], r["pos"], r["digest"]) for r in nodes.collect()], root_only)
    if nodes.where("n > 1").take(1):
        blocks = written(reduced(nodes, cfg))
        return written(_by_block(nodes, paths(blocks, cfg, root_only), cfg, _extended, _PATH))
    # Languages beyond what the driver takes: their subroots are the nodes of one tree.
    ranked = written(placed(nodes.select(F.col("tree").alias("_own"), "digest", F.lit(0).alias("_all")), "_all", ("_own",)))
    up = paths(ranked.select("tree", "n", "pos", "digest"), cfg, True)
    if isinstance(up, dict):
        up = nodes.sparkSession.createDataFrame([(t, p, [b for b, _ in path], [a for _, a in path], s, r) for (t, p), (path, s, r) in up.items()], _PATH)
    met = ranked.select("_own", "digest", "tree", "pos").join(up, ["tree", "pos"])
    return written(met.select(F.col("_own").alias("tree"), F.lit(0).cast("long").alias("pos"), "before", "after", F.col("digest").alias("subroot"), "root"))


def _by_block(nodes: DataFrame, suffixes: dict | DataFrame, cfg: MerkleConfig, finish, schema: str) -> DataFrame:
    """finish(a block's rows by place, the block's levels as paths, suffix, subroot, root) of every block."""
    blocks = nodes.withColumn("_block", _block(cfg)).groupBy("tree", "_block")

    def run(table: pa.Table, suffix) -> pa.Table:
        table = table.sort_by("pos")
        own, _ = climb(table["digest"].to_pylist(), table["n"][0].as_py(), cfg.levels)
        return finish(table, own, *suffix)

    if isinstance(suffixes, dict):
        known = nodes.sparkSession.sparkContext.broadcast(suffixes)

        def small(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return run(table, known.value[key[0].as_py(), key[1].as_py()])

        return blocks.applyInArrow(small, schema)

    def large(table: pa.Table, suffix: pa.Table) -> pa.Table:
        r = suffix.to_pylist()[0]
        return run(table, (list(zip(r["before"], r["after"], strict=True)), r["subroot"], r["root"]))

    return blocks.cogroup(suffixes.withColumnRenamed("pos", "_block").groupBy("tree", "_block")).applyInArrow(large, schema)


def _extended(table: pa.Table, own: list, suffix: list, subroot: str, root: str) -> pa.Table:
    whole = [path + suffix for path in own]
    parts = [[[x[i] for x in path] for path in whole] for i in (0, 1)]
    n = len(whole)
    return pa.table({"tree": table["tree"], "pos": table["pos"], "before": pa.array(parts[0], pa.list_(pa.string())), "after": pa.array(parts[1], pa.list_(pa.string())), "subroot": [subroot] * n, "root": [root] * n})


def _proven(table: pa.Table, own: list, suffix: list, subroot: str, root: str) -> pa.Table:
    rest, proofs, folded = "".join(b + a for b, a in suffix), [], []
    for digest, changed, path in zip(table["digest"].to_pylist(), table["changed"].to_pylist(), own, strict=True):
        proofs.append(_h("".join(b + a for b, a in path), rest))
        folded.append(fold(fold(changed or digest, path), suffix))
    n = len(own)
    return pa.table({"_id": table["_id"], "leaf": table["digest"], "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})


def manifest(docs: DataFrame, cfg: MerkleConfig = MerkleConfig(), tampered: Column | None = None, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    tampered: a condition on docs; where it holds, the row is folded as if its text's A-Z had been lower-cased since.
    """
    asked = tampered if tampered is not None else F.lit(False)
    changed = [F.translate(F.col(c), _UPPER, _LOWER) if c == text_col else F.col(c) for c in fields]
    leaves = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), leaf(map(F.col, fields)).alias("digest"), F.when(asked, leaf(changed)).alias("changed"))
    nodes = written(placed(written(leaves), "_lang", ("_id", "digest")))
    kind = nodes.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    blocks = written(reduced(nodes.select("tree", "n", "pos", "digest"), cfg))
    return _by_block(nodes, paths(blocks, cfg), cfg, _proven, schema).withColumnRenamed("_id", id_col)


def every_third(id_col: str = "doc_id") -> Column:
    """Rows whose decimal id has a CRC-32 that 3 divides; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 0
