"""Group quantiles: nearest rank with half-even rounding, and linear interpolation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row a group: keys, n, and for each name the element at rint((n - 1) * q) of the sorted values.

    Sorting spills, and one shuffle on the keys serves all quantiles. NULL values take no part.
    """
    own = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(own.orderBy(value)) - 1).alias("_at"), F.count(F.lit(1)).over(own).alias("_n"))
    picks = [F.max(F.when(F.col("_at") == F.rint((F.col("_n") - 1) * F.lit(q)), F.col(value))).alias(name) for name, q in quantiles.items()]
    return ranked.groupBy(*keys).agg(F.max("_n").alias("n"), *picks)


#: Bins of a pass: by magnitude in the first one (2.5 % apart, both signs), then equal parts of a span.
_SCALE, _SHIFT, _LAST, _PARTS = 40, 746, 65_000, 65_536


def _magnitude(v: Column) -> Column:
    """A bin number that never falls as v rises: logarithms are monotone, and so are products with constants and floor()."""
    size = F.least(F.floor((F.ln(F.abs(v)) + _SHIFT) * _SCALE), F.lit(_LAST)) + 1
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def linear_columns(rows: DataFrame, by: Sequence[str], wanted: Mapping[str, tuple[str, float]], written: bool = False) -> DataFrame:
    """(by, names): exact quantiles (column, q) of large groups, with linear interpolation; NULL and NaN take no part.

    Quantiles are selected, not sorted: a histogram of all columns finds the bin of each wanted rank, and further passes
    split only these bins, until a rank is its bin's least or largest value. Bins carry counts and ends, so they combine
    before they are dealt, and no task holds more than 131,072 bins of a group and column, however large the group. Further
    passes narrow a bin 65,536 times, or to single values if it has no more values than that; five are the most. The counts
    of a split bin must add up to the bin's, else the query fails. Groups without values, or with a NULL key, have no row.
    written: rows is a table that costs little to read, so it isn't staged again.
    """
    keys, columns = [f"_b{i}" for i in range(len(by))], list(dict.fromkeys(c for c, _ in wanted.values()))
    group = [*keys, "_c"]
    slim = rows.select(*[F.col(b).alias(k) for k, b in zip(keys, by, strict=True)], *[(F.col(c).cast("double") + F.lit(0.0)).alias(f"_v{j}") for j, c in enumerate(columns)])
    own = slim.where(" and ".join(f"{k} is not null" for k in keys) or "true")
    own = own if written else staged(own)  # the passes read a slim table
    values = own.select(*keys, F.inline(F.array(*[F.struct(F.lit(j).alias("_c"), F.col(f"_v{j}").alias("_v")) for j in range(len(columns))]))).where("_v is not null and not isnan(_v)")
    ends = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]

    def summed(bins: DataFrame, own: Sequence[str]) -> DataFrame:
        return bins.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*own).orderBy("_bin", "_lo"))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*own)))

    within = (F.col("_upto") - F.col("_n") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))
    asked = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(columns.index(c)).alias("_of"), F.lit(float(q)).alias("_q")) for i, (c, q) in enumerate(wanted.values())])
    at = (F.col("_all") - 1) * F.col("_q")
    two = F.array(*[F.struct(F.lit(k).alias("_end"), f(at).cast("long").alias("_rank"), (at - F.floor(at)).alias("_share")) for k, f in enumerate((F.floor, F.ceil))])
    fields = [*group, "_i", "_end", "_share", "_rank", "_n", "_lo", "_hi"]
    first = summed(values.groupBy(*group, _magnitude(F.col("_v")).alias("_bin")).agg(*ends), group)
    first = first.select("*", F.inline(asked)).where("_of = _c").select("*", F.inline(two)).where(within)
    found = staged(first.withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_n")).select(*fields))
    unsettled = (F.col("_lo") < F.col("_hi")) & (F.col("_rank") > 0) & (F.col("_rank") < F.col("_n") - 1)
    while (left := found.where(unsettled)).take(1):
        spans = left.groupBy(*group).agg(F.collect_set(F.struct("_lo", "_hi", "_n")).alias("_spans"))  # one for each rank at most
        met = values.join(spans, group).withColumn("_span", F.get(F.filter("_spans", lambda s: F.col("_v").between(s["_lo"], s["_hi"])), F.lit(0))).where("_span is not null")
        low, high = F.col("_span._lo"), F.col("_span._hi")
        part, one = F.floor((F.col("_v") - low) / (high - low) * (_PARTS - 1)), F.when(F.col("_span._n") <= _PARTS, F.col("_v"))
        bins = summed(met.groupBy(*group, low.alias("_from"), F.col("_span._n").alias("_was"), part.alias("_bin"), one.alias("_one")).agg(*ends), [*group, "_from"])
        sure = F.assert_true(F.col("_all") == F.col("_was"), F.lit("a quantile's bin doesn't hold what was counted")).isNull()
        further = left.select(*group, "_i", "_end", "_share", "_rank", F.col("_lo").alias("_from")).join(bins.where(sure), [*group, "_from"]).where(within)
        found = staged(found.where(~unsettled).unionByName(further.withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_n")).select(*fields)))
    value = F.when(F.col("_rank") == 0, F.col("_lo")).otherwise(F.col("_hi"))
    pick = lambda i, end, what: F.max(F.when((F.col("_i") == i) & (F.col("_end") == end), what))
    share = lambda i: pick(i, 0, F.col("_share"))
    mixed = [(pick(i, 0, value) * (1 - share(i)) + pick(i, 1, value) * share(i)).alias(name) for i, name in enumerate(wanted)]
    return found.groupBy(*keys).agg(*mixed).select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], *wanted)


def linear_by(rows: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """linear_columns() of one column."""
    return linear_columns(rows, by, {name: (value, q) for name, q in quantiles.items()})


def linear(value: Column, q: float) -> Column:
    """Exact quantile with linear interpolation, of groups that fit a buffer (a frame's points, a count a frame)."""
    return F.percentile(value.cast("double"), F.lit(q))
