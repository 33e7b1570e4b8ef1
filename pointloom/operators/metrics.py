"""Ranking and calibration metrics over (group, score, label[, weight]).

Rows collapse to one for each distinct score first, so ties don't depend on order. What is cumulated then is that
table: scores are dealt by ranges, each range is summed, and its rows start from the sums of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import ratio
from ..functions.staging import staged

BUCKETS = 256
SMALL = 50_000


def by_score(rows: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (), positive: Column | None = None, negative: Column | None = None) -> DataFrame:
    """(by, score, pos, neg): positives and negatives at each distinct score. positive and negative: weights, or 0/1 by label."""
    pos = F.when(F.col(label) == 1, 1).otherwise(0) if positive is None else positive
    neg = F.when(F.col(label) == 1, 0).otherwise(1) if negative is None else negative
    return rows.groupBy(*by, F.col(score).alias("score")).agg(F.sum(pos.cast("long")).alias("pos"), F.sum(neg.cast("long")).alias("neg"))


def _bucket(score: Column, edges: Sequence[float]) -> Column:
    """How many edges lie below the score, by bisection."""

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(score > F.lit(edges[middle]), part(middle + 1, high)).otherwise(part(low, middle))

    return part(0, len(edges))


def cumulated(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """steps with tp, fp (sums over scores at least as high) and positives, negatives (sums over all).

    One task cumulates a group of up to SMALL distinct scores; beyond, scores are dealt by BUCKETS quantiles.
    """
    total = Window.partitionBy(*by, F.lit(1))
    steps = staged(steps)  # its upstream runs once
    known = steps.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(F.col("score").cast("double"), [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("e")).first()
    edges = sorted(set(known["e"])) if known["n"] > SMALL else []
    rows = steps.withColumn("_bucket", _bucket(F.col("score"), edges))
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    if not edges:
        out = rows.withColumns({"tp": F.sum("pos").over(inside), "fp": F.sum("neg").over(inside), "positives": F.sum("pos").over(total), "negatives": F.sum("neg").over(total)})
        return out.drop("_bucket")
    sums = rows.groupBy(*by, "_bucket").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = Window.partitionBy(*by, F.lit(1)).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        *by, "_bucket", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_bp"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_bn"),
        F.sum("_p").over(total).alias("positives"), F.sum("_n").over(total).alias("negatives"),
    )
    out = rows.withColumn("_ip", F.sum("pos").over(inside)).withColumn("_in", F.sum("neg").over(inside)).join(base, [*by, "_bucket"])
    return out.withColumn("tp", F.col("_bp") + F.col("_ip")).withColumn("fp", F.col("_bn") + F.col("_in")).drop("_bucket", "_ip", "_in", "_bp", "_bn")


def average_precision(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision for each group (NULL without positives); table: cumulated()."""
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return table.groupBy(*by).agg(F.when(F.max("positives") > 0, F.sum(step) / F.max("positives")).alias("average_precision"))


def roc_curve(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, step, fpr, tpr) from (0, 0); nothing for a group that lacks a class. step: number of scored points at or above."""
    usable = table.where("positives > 0 and negatives > 0")
    rows = usable.select(*by, (F.col("tp") + F.col("fp")).alias("step"), (F.col("fp") / F.col("negatives")).alias("fpr"), (F.col("tp") / F.col("positives")).alias("tpr"))
    zero = usable.select(*by, F.lit(0).cast("long").alias("step"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).distinct()
    return zero.unionByName(rows)


def roc_auc(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by trapezoids (NULL if a class is missing). Each step's trapezoid needs its own row only."""
    width = F.col("neg") / F.col("negatives")
    height = (2 * F.col("tp") - F.col("pos")) / (2 * F.col("positives"))
    both = (F.max("positives") > 0) & (F.max("negatives") > 0)
    area = F.sum(F.when((F.col("positives") > 0) & (F.col("negatives") > 0), width * height))
    return table.groupBy(*by).agg(F.when(both, area).alias("roc_auc"))


def best_f1(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The score with the best F1, the highest of equals (NULL without positives)."""
    f1 = ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives"), F.lit(0.0))
    best = F.max_by("score", F.struct(f1, F.col("score")))
    return table.groupBy(*by).agg(F.when(F.max("positives") > 0, best).alias("threshold"), F.when(F.max("positives") > 0, F.max(f1)).alias("f1"))


def invalid_inputs(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Rows that metrics can't use: labels other than 0 and 1, scores that aren't finite."""
    return rows.where(~F.col(label).isin(0, 1) | F.col(label).isNull() | F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf")))


def summary(rows: DataFrame, threshold: float, by: Sequence[str] = (), score: str = "score", label: str = "label", positive: Column | None = None, negative: Column | None = None) -> DataFrame:
    """Confusion counts at the threshold and what follows from them, overall (NULL groups) and for each value of by.
    positive and negative: how many points of each kind a row stands for, or one by its label."""
    pos = (F.when(F.col(label) == 1, 1).otherwise(0) if positive is None else positive).cast("long")
    neg = (F.when(F.col(label) == 1, 0).otherwise(1) if negative is None else negative).cast("long")
    s, predicted = F.col(score), F.col(score) >= threshold
    grouped = rows.rollup(*by) if by else rows.groupBy()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = grouped.agg(
        total(pos + neg).alias("points"), total(pos).alias("positives"), (F.sum(pos * F.pow(s - 1, F.lit(2)) + neg * s * s) / F.sum(pos + neg)).alias("brier_score"),
        total(F.when(predicted, pos).otherwise(0)).alias("true_positive"), total(F.when(predicted, neg).otherwise(0)).alias("false_positive"),
        total(F.when(predicted, 0).otherwise(neg)).alias("true_negative"), total(F.when(predicted, 0).otherwise(pos)).alias("false_negative"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("true_positive", "false_positive", "true_negative", "false_negative"))
    zero = F.lit(0.0)
    return counts.select(
        "*", F.lit(threshold).alias("threshold"), ratio(F.col("positives"), F.col("points")).alias("prevalence"), ratio(tp, tp + fp, zero).alias("precision"), ratio(tp, tp + fn, zero).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn, zero).alias("f1"), ratio(fp, fp + tn).alias("false_positive_rate"),
    )


def report(rows: DataFrame, threshold: float, by: str, score: str = "score", label: str = "label", positive: Column | None = None, negative: Column | None = None) -> DataFrame:
    """summary() with average precision and AUC, for "overall" and each value of by; positive, negative: as in summary()."""
    doubled = rows.withColumn("_g", F.explode(F.array(F.lit("overall"), F.col(by).cast("string"))))
    table = cumulated(by_score(doubled, score, label, ["_g"], positive, negative), ["_g"])
    own = summary(doubled, threshold, ["_g"], score, label, positive, negative).where("_g is not null")
    return own.join(average_precision(table, ["_g"]), "_g", "left").join(roc_auc(table, ["_g"]), "_g", "left").withColumnRenamed("_g", "group")


def mean_group_ap(rows: DataFrame, by: str, score: str = "score", label: str = "label") -> DataFrame:
    """The mean of the groups' average precisions, without those that have none."""
    return average_precision(cumulated(by_score(rows, score, label, [by]), [by]), [by]).agg(F.avg("average_precision").alias("mean_average_precision"))


def reliability(rows: DataFrame, bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """For each of equal-width bins that has points: bin, points, mean score and observed rate. A score at an edge (as a
    double, i * 1/bins) is in the bin that begins there; the last bin is closed."""
    step = 1.0 / bins
    edges = [i * step for i in range(1, bins)]
    number = sum((F.when(F.col(score) >= e, 1).otherwise(0) for e in edges[1:]), F.when(F.col(score) >= edges[0], 1).otherwise(0)) if bins > 1 else F.lit(0)
    return rows.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("points"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("observed_rate"))
