"""Exact nearest neighbours: equi-joins of grid cells within a radius, and branch and bound over occupied cells beyond it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import is_finite
from ..functions.staging import staged

_CELL = ("_gx", "_gy", "_gz")


def _cells(columns: Sequence[str], edge: float) -> list[Column]:
    return [F.floor(F.col(c).cast("double") / F.lit(edge)).cast("long") for c in columns]


def _around(rows: DataFrame, columns: Sequence[str], edge: float, reach: int = 1) -> DataFrame:
    """rows once for each of the (2 * reach + 1) ** 3 cells around their own."""
    near = lambda c: F.explode(F.array(*[c + F.lit(d).cast("long") for d in range(-reach, reach + 1)]))
    for name, cell in zip(_CELL, _cells(columns, edge), strict=True):
        rows = rows.withColumn(name, near(cell))
    return rows


def _distance(a: Sequence[str], b: Sequence[str]) -> Column:
    d = [F.col(p).cast("double") - F.col(q).cast("double") for p, q in zip(a, b, strict=True)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def nearest_within(queries: DataFrame, reference: DataFrame, radius: float, key: Sequence[str], columns: Sequence[str] = ("x", "y", "z"), reference_columns: Sequence[str] = ("x", "y", "z"), group: Sequence[str] = ()) -> DataFrame:
    """(key, distance) of the queries that have a reference point within radius; distance is that of the nearest.

    group: columns that both sides share and that must be equal (frames, sessions). Minima combine before they are dealt.
    """
    left = _around(queries.select(*key, *[c for c in group if c not in key], *[F.col(c).alias(f"_q{i}") for i, c in enumerate(columns)]), ["_q0", "_q1", "_q2"], radius)
    right = reference.select(*group, *[F.col(c).alias(f"_r{i}") for i, c in enumerate(reference_columns)])
    right = right.withColumns(dict(zip(_CELL, _cells(["_r0", "_r1", "_r2"], radius), strict=True)))
    pairs = left.join(right, [*group, *_CELL]).withColumn("_d", _distance(["_q0", "_q1", "_q2"], ["_r0", "_r1", "_r2"]))
    return pairs.where(F.col("_d") <= radius).groupBy(*key).agg(F.min("_d").alias("distance"))


#: Points of a lowest cell of the pyramid, on average; levels (of doubled edge) that a step goes down; cells of the highest
#: step at most; edges that the lowest cells may have, as parts of the radius.
CROWD, STEP, TOP, _FINER = 4, 2, 256, (4, 16, 64, 256, 1024)


def _parents(levels: int) -> list[Column]:
    return [F.shiftright(c, levels) for c in _CELL]


def _lowest(points: DataFrame, edge: float) -> DataFrame:
    rep = F.min(F.struct("_r0", "_r1", "_r2")).alias("_rep")
    return staged(points.withColumns(dict(zip(_CELL, _cells(["_r0", "_r1", "_r2"], edge), strict=True))).groupBy(*_CELL).agg(rep, F.count(F.lit(1)).alias("_n")))


def pyramid(points: DataFrame, radius: float) -> tuple[float, list[DataFrame]]:
    """The lowest cells' edge, and the occupied cells (_gx, _gy, _gz, _rep: one of their points) from there upwards by STEP
    levels, until at most TOP are left. points: (_r0, _r1, _r2), each once.

    Where cells of the radius hold more than CROWD points on average, the edge is the largest part of it that doesn't, by
    sketches of all parts in one pass. Cells of all levels are aligned, so a cell's number above is its number shifted.
    """
    edge, lowest = radius, _lowest(points, radius)
    cells, n = lowest.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if n and n > CROWD * cells:
        edges = [radius / k for k in _FINER]
        sizes = points.agg(*[F.approx_count_distinct(F.xxhash64(*_cells(["_r0", "_r1", "_r2"], e)), 0.05) for e in edges]).first()
        edge = next((e for e, c in zip(edges, sizes, strict=True) if n <= CROWD * c), edges[-1])
        lowest = _lowest(points, edge)
        cells = lowest.count()
    levels = [lowest.drop("_n")]
    while cells > TOP:
        up = levels[-1].select(*[c.alias(n) for n, c in zip(_CELL, _parents(STEP), strict=True)], "_rep")
        levels.append(staged(up.groupBy(*_CELL).agg(F.min("_rep").alias("_rep"))))
        cells = levels[-1].limit(TOP + 1).count()
    return edge, levels


def candidate_cells(queries: DataFrame, levels: list[DataFrame], edge: float) -> DataFrame:
    """(_q, _q0, _q1, _q2, _most, cell): the lowest cells in which a query's nearest point can be, by branch and bound.

    From the top down, a cell is followed only if its least distance is not above the query's best so far: the least
    distance to a point that represents a cell met on the way (_most). queries: (_q, _q0, _q1, _q2).
    """
    asked = ("_q", "_q0", "_q1", "_q2")
    norm = lambda a, b, c: F.sqrt(a * a + b * b + c * c)
    apart = lambda rep: norm(*[F.col(f"_q{i}") - rep[f"_r{i}"] for i in range(3)])

    def possible(cell: list[Column], level: int) -> Column:
        size = edge * 2**level
        off = [F.greatest(c * size - F.col(f"_q{i}"), F.col(f"_q{i}") - (c + 1) * size, F.lit(0.0)) for i, c in enumerate(cell)]
        slack = 1e-9 * (F.abs("_q0") + F.abs("_q1") + F.abs("_q2") + F.col("_most") + size)  # roundings in cells and distances
        return norm(*off) <= F.col("_most") + slack

    level = STEP * (len(levels) - 1)
    top = levels[-1].agg(F.collect_list(F.struct(*_CELL, "_rep")).alias("_top"))  # one row of TOP cells at most
    first = queries.crossJoin(F.broadcast(top)).withColumn("_most", F.array_min(F.transform("_top", lambda x: apart(x["_rep"]))))
    frontier = first.select(*asked, "_most", F.inline(F.filter("_top", lambda x: possible([x[c] for c in _CELL], level)))).drop("_rep")
    for k in range(len(levels) - 2, -1, -1):
        below = levels[k].select(*_CELL, "_rep", *[c.alias(f"_p{n}") for n, c in zip(_CELL, _parents(STEP), strict=True)])
        above = frontier.select(*asked, "_most", *[F.col(c).alias(f"_p{c}") for c in _CELL])
        here = possible([F.col(c) for c in _CELL], STEP * k)
        met = above.join(below, [f"_p{c}" for c in _CELL]).where(here)  # by the bound from above, before anything is dealt
        met = met.withColumn("_most", F.least("_most", F.min(apart(F.col("_rep"))).over(Window.partitionBy("_q"))))
        frontier = staged(met.where(here).select(*asked, "_most", *_CELL))
    return frontier


def nearest_exact(queries: DataFrame, reference: DataFrame, radius: float, key: Sequence[str], columns: Sequence[str] = ("x", "y", "z"), reference_columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(key, distance) of every query, whatever its distance.

    Most have a neighbour within the radius: one join of grid cells settles them, since all within the radius are compared.
    The rest go down a pyramid of occupied cells and meet only the points of cells that can hold their nearest. The
    distance is NULL for a query with a coordinate that isn't finite, and for all where no reference point is finite.
    """
    finite = lambda names: is_finite(*[F.col(c) for c in names])
    names = lambda cs, to: [F.col(c).cast("double").alias(f"{to}{i}") for i, c in enumerate(cs)]
    own = staged(queries.select(*key, finite(columns).alias("_ok"), *names(columns, "_q"), F.monotonically_increasing_id().alias("_q")))
    known = staged(reference.where(finite(reference_columns)).select(*names(reference_columns, "_r")).distinct())  # copies are no news
    asked, q, r = own.where("_ok").drop("_ok"), ("_q0", "_q1", "_q2"), ("_r0", "_r1", "_r2")
    near = staged(nearest_within(asked, known, radius, ["_q"], q, r))
    far = staged(asked.select("_q", *q).join(near.select("_q"), "_q", "left_anti"))
    if far.take(1):
        edge, levels = pyramid(known, radius)
        cells = candidate_cells(far, levels, edge)
        met = cells.join(known.withColumns(dict(zip(_CELL, _cells(r, edge), strict=True))), list(_CELL))
        near = near.unionByName(met.withColumn("_d", _distance(q, r)).groupBy("_q").agg(F.min("_d").alias("distance")))
    return own.join(near, "_q", "left").select(*key, "distance")


def isolated(points: DataFrame, distance: float, key: Sequence[str] = ("recording", "frame_index", "point_index"), frame: Sequence[str] = ("recording", "frame_index"), valid: str | None = None, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(key) of the valid points without another valid point of their frame within distance; none if distance isn't positive.

    Copies of a point are neighbours of each other. A point knows itself by its key.
    """
    rows = points.where(F.col(valid)) if valid else points
    if distance <= 0:
        return rows.select(*key).limit(0)
    own = [c for c in key if c not in frame]
    # Two points in a cell of this edge are neighbours, whatever lies around, so only points alone in their cell are probed.
    edge = distance / 3**0.5 * (1 - 1e-9)
    celled = rows.withColumns(dict(zip(_CELL, _cells(columns, edge), strict=True)))
    lone = celled.groupBy(*frame, *_CELL).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    alone = celled.join(lone, [*frame, *_CELL], "left_semi")
    left = _around(alone.select(*key, *[F.col(c).alias(f"_q{i}") for i, c in enumerate(columns)]), ["_q0", "_q1", "_q2"], edge, 2)
    right = celled.select(*frame, *_CELL, *[F.col(c).alias(f"_k{i}") for i, c in enumerate(own)], *[F.col(c).alias(f"_r{i}") for i, c in enumerate(columns)])
    same = F.lit(True)
    for i, c in enumerate(own):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    near = left.join(right, [*frame, *_CELL]).where(~same & (_distance(["_q0", "_q1", "_q2"], ["_r0", "_r1", "_r2"]) <= distance))
    return alone.select(*key).join(near.select(*key).distinct(), list(key), "left_anti")
