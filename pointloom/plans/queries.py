"""Registered queries of the engine's operators over the driver's tables, with the same in DuckDB SQL.

Adapters map the tables to the engine's model: lineitem rows are points (a ship date is a frame), events are clean and
observed returns (a user is a cell), embeddings are a cloud, documents are manifest chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import linear_by, nearest_rank
from ..functions.semantics import safe_name
from ..operators import datasets, directional, frames, metrics, nearest, poses, regions, splits, voxels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# --- adapters -------------------------------------------------------------------------------------------------------

_P = """points as (select l_returnflag recording, l_linestatus stream, dense_rank() over (order by cast(l_shipdate as date)) - 1 frame_index,
 l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity/10 - 2.5 x, l_extendedprice/20000 - 2.5 y, l_tax*10 - 0.4 z, l_discount*1000 intensity, l_linenumber line from lineitem)"""


def _days(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct days (a few thousand) with their rank."""
    from pyspark.sql import Window

    days = _read(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("_day")).distinct()
    return days.withColumn("frame_index", F.dense_rank().over(Window.orderBy("_day")).cast("long") - 1)


def _points(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "lineitem").withColumn("_day", F.to_date("l_shipdate")).join(F.broadcast(_days(spark, sf)), "_day")
    return rows.select(
        F.col("l_returnflag").alias("recording"), F.col("l_linestatus").alias("stream"), "frame_index", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 10 - 2.5).alias("x"),
        (F.col("l_extendedprice") / 20000 - 2.5).alias("y"), (F.col("l_tax") * 10 - 0.4).alias("z"), (F.col("l_discount") * 1000).alias("intensity"), F.col("l_linenumber").alias("line"),
    )


_F = """frames as (select l_returnflag recording, date_diff('day', date '1990-01-01', cast(l_shipdate as date)) frame_index, count(*) n_points,
 cast(date_diff('day', date '1990-01-01', cast(l_shipdate as date)) as double) frame_time_s from lineitem group by all)"""


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01")).cast("long")
    return _read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("recording"), day.alias("frame_index")).agg(F.count(F.lit(1)).alias("n_points")).withColumn("frame_time_s", F.col("frame_index").cast("double"))


_BANDS = directional.BandConfig((0.0, 20.0, 40.0, 1e6), normal_q=0.4, early_q=0.8, min_normal=2.0, min_early=5.0, min_samples=20)
_LOOKUP = directional.LookupConfig(3, 150.0)
_REF = """ev as (select event_id, user_id cell_id, value v from events where value is not null and isfinite(value)),
 ref_rows as (select cell_id, v, row_number() over (partition by cell_id order by v) - 1 i, count(*) over (partition by cell_id) n from ev where event_id % 2 = 0),
 ref as (select cell_id, max(n) n, max(v) filter (where i = round_even((n-1)*cast(0.5 as double), 0)) med, max(v) filter (where i = round_even((n-1)*cast(0.95 as double), 0)) - max(v) filter (where i = round_even((n-1)*cast(0.05 as double), 0)) spread from ref_rows group by cell_id),
 looked as (select e.event_id, e.cell_id, e.v, r.med, e.v - r.med residual, coalesce(r.n, 0) n, r.spread, coalesce(r.n >= 3 and r.spread <= 150, false) valid from ev e left join ref r using (cell_id)),
 bands as (select b.band, count(l.band) n, case when count(l.band) >= 20 then greatest(2.0, quantile_cont(abs(l.residual), 0.4)) end normal, case when count(l.band) >= 20 then greatest(5.0, quantile_cont(-l.residual, 0.8), greatest(2.0, quantile_cont(abs(l.residual), 0.4))) end early
  from (values (0),(1),(2)) b(band) left join (select *, case when med >= 0 and med < 20 then 0 when med >= 20 and med < 40 then 1 when med >= 40 and med < 1e6 then 2 end band from looked where valid and event_id % 4 = 1) l on l.band = b.band group by b.band),
 labelled as (select l.*, b.band, case when valid and -residual > early then 1 when valid and abs(residual) <= normal then 0 else 255 end as label,
  case when valid and -residual > early then least(greatest((-residual - early) / (2*early), 0), 1) when valid and abs(residual) <= normal then least(greatest(1 - abs(residual)/normal, 0), 1) else 0 end confidence
  from looked l left join bands b on b.band = (case when med >= 0 and med < 20 then 0 when med >= 20 and med < 40 then 1 when med >= 40 and med < 1e6 then 2 end) where event_id % 4 = 3)"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select("event_id", "event_type", F.col("user_id").alias("cell_id"), F.col("value").alias("range"), F.col("value").alias("reflectivity"))


def _reference(spark: SparkSession, sf: str) -> DataFrame:
    return directional.build_reference(_events(spark, sf).where("event_id % 2 = 0"), reflectivity=None)


def _looked_up(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.semantics import is_finite

    return directional.look_up(_events(spark, sf).where(is_finite(F.col("range"))), _reference(spark, sf), _LOOKUP)


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    looked = _looked_up(spark, sf)
    bands = directional.calibrate(looked.where("event_id % 4 = 1"), _BANDS, as_float=False)
    return directional.label_residuals(looked.where("event_id % 4 = 3"), bands, _BANDS, as_float=False, storage="double")


_S = "steps as (select round(value, 1) score, count(*) filter (where event_type = 'error') pos, count(*) filter (where event_type <> 'error') neg from events group by 1), cum as (select *, sum(pos) over w tp, sum(neg) over w fp, sum(pos) over () p, sum(neg) over () n from steps window w as (order by score desc rows unbounded preceding))"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select(F.round("value", 1).alias("score"), (F.col("event_type") == "error").cast("int").alias("label"), F.col("event_type").alias("kind"), (F.col("user_id") % 5).cast("string").alias("domain"))


_C = "cloud as (select vec_id, label frame, cast(embedding[1] as double) x, cast(embedding[2] as double) y, cast(embedding[3] as double) z from embeddings)"


def _cloud(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return _read(spark, sf, "embeddings").select("vec_id", F.col("label").alias("frame"), *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")])


_CH = "chunks as (select row_number() over (order by source, lang) - 1 chunk_index, lang, source, count(*) frames, sum(n_chars) points from documents group by source, lang)"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _read(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("frames"), F.sum("n_chars").alias("points"))
    return rows.withColumn("chunk_index", F.row_number().over(Window.orderBy("source", "lang")) - 1)  # one row a source and language


# --- directional references -----------------------------------------------------------------------------------------


@_query(f"""with {_P} select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(cast(sqrt(x*x+y*y+z*z) as float) as double) as point_range,
 cast(least(greatest(floor(round((asin(least(greatest(z/sqrt(x*x+y*y+z*z), -1), 1)) + pi()/2)/radians(0.3), 6)), 0), 599) * 1200 + least(greatest(floor(round((atan2(y + 0.0, x) + pi())/radians(0.3), 6)), 0), 1199) as bigint) cell_id from points""")
def cell_ids(spark, sf):
    return directional.with_cells(_points(spark, sf), 0.3, 6).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("range").cast("double").alias("point_range"), "cell_id")


@_query("with r as (select user_id, value v, row_number() over (partition by user_id order by value) - 1 i, count(*) over (partition by user_id) n from events where value is not null) select user_id, max(n) n, max(v) filter (where i = round_even((n-1)*cast(0.5 as double), 0)) median, max(v) filter (where i = round_even((n-1)*cast(0.95 as double), 0)) high from r group by user_id")
def group_nearest_rank(spark, sf):
    return nearest_rank(_read(spark, sf, "events"), ["user_id"], "value", {"median": 0.5, "high": 0.95})


@_query(f"""with {_REF}, dev as (select e.cell_id, abs(e.v - r.med) d, row_number() over (partition by e.cell_id order by abs(e.v - r.med)) - 1 i, count(*) over (partition by e.cell_id) n from ev e join ref r using (cell_id) where e.event_id % 2 = 0),
 mad as (select cell_id, max(d) filter (where i = round_even((n-1)*cast(0.5 as double), 0)) mad from dev group by cell_id)
 select cell_id, n as "count", round(med, 6) range_median, round(spread, 6) range_spread, round(mad, 6) range_mad, round(med, 6) reflectivity_median, round(mad, 6) reflectivity_mad from ref join mad using (cell_id)""")
def directional_reference(spark, sf):
    out = directional.build_reference(_events(spark, sf).where("event_id % 2 = 0"))
    return out.select("cell_id", "count", *[_r(c).alias(c) for c in ("range_median", "range_spread", "range_mad", "reflectivity_median", "reflectivity_mad")])


@_query(f"with {_REF} select event_id, round(residual, 6) residual, n reference_count, valid valid_reference from looked")
def reference_lookup(spark, sf):
    return _looked_up(spark, sf).select("event_id", _r("residual").alias("residual"), "reference_count", "valid_reference")


@_query(f"with {_REF} select band, n, round(normal, 6) normal_threshold, round(early, 6) early_threshold, early is not null usable from bands")
def band_calibration(spark, sf):
    out = directional.calibrate(_looked_up(spark, sf).where("event_id % 4 = 1"), _BANDS, as_float=False)
    return out.select("band", "n", _r("normal_threshold").alias("normal_threshold"), _r("early_threshold").alias("early_threshold"), "usable")


@_query(f"with {_REF} select event_id, label, round(confidence, 6) confidence from labelled")
def residual_labels(spark, sf):
    return _labelled(spark, sf).select("event_id", F.col("label").cast("int").alias("label"), _r("confidence").alias("confidence"))


@_query(f"""with {_REF}, t as (select l.label, e.event_type from labelled l join events e using (event_id))
 select event_type, count(*) points, count(*) filter (where label=0) unaffected_points, round(100.0*count(*) filter (where label=0)/count(*),4) unaffected_percent, count(*) filter (where label=1) impacted_points, round(100.0*count(*) filter (where label=1)/count(*),4) impacted_percent,
 count(*) filter (where label=255) ignored_points, round(100.0*count(*) filter (where label=255)/count(*),4) ignored_percent from t group by rollup(event_type)""")
def label_counts_rollup(spark, sf):
    return directional.label_counts(_labelled(spark, sf), "event_type")


@_query(f"""with {_REF} select count(*) points, count(*) filter (where event_id % 8 = 3) held_out_points, count(*) filter (where event_id % 8 = 3 and label = 1) held_out_impacted,
 round(100.0 * count(*) filter (where event_id % 8 = 3 and label = 1) / nullif(count(*) filter (where event_id % 8 = 3 and label <> 255), 0), 4) held_out_percent_of_labelled from labelled""")
def held_out_rates(spark, sf):
    out = directional.label_counts(_labelled(spark, sf), "", F.col("event_id") % 8 == 3)
    return out.select("points", "held_out_points", "held_out_impacted", "held_out_percent_of_labelled")


@_query(f"with {_REF} select event_id, case when v between 5 and 60 then label else 255 end as label, case when v between 5 and 60 then round(confidence, 6) else 0 end confidence from labelled")
def masked_labels(spark, sf):
    out = directional.mask_invalid(_labelled(spark, sf), F.col("range").between(5, 60))
    return out.select("event_id", F.col("label").cast("int").alias("label"), _r("confidence").alias("confidence"))


@_query(f"with {_REF} select event_type as condition, count(*) points, count(*) filter (where (case when event_type = 'view' and label = 1 then 0 else label end) = 0) unaffected from labelled join events using (event_id) group by event_type")
def clean_control_policy(spark, sf):
    rows = directional.clean_control(_labelled(spark, sf).withColumn("condition", F.col("event_type")), "view")
    return rows.groupBy("condition").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("label") == 0).alias("unaffected"))


# --- frames and splits ----------------------------------------------------------------------------------------------


@_query(f"""with {_F}, b as (select recording, max(frame_index) last from frames group by recording), every as (select recording, unnest(range(0, last + 1)) frame_index from b),
 f as (select recording, frame_index, coalesce(n_points, 0) n_points, frame_time_s from every left join frames using (recording, frame_index))
 select recording, frame_index, n_points, frame_time_s, cast(sum(n_points) over (partition by recording order by frame_index rows unbounded preceding) as bigint) point_end from f""")
def frame_layout(spark, sf):
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01")).cast("long")
    points = _read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("recording"), day.alias("frame_index"), day.cast("double").alias("time_s"))
    return frames.frame_layout(points).select("recording", "frame_index", "n_points", "frame_time_s", "point_end")


@_query(f"""with {_F}, w as (select *, row_number() over o - 1 pos, frame_time_s - lag(frame_time_s) over o step from frames window o as (partition by recording order by frame_index)),
 v as (select *, max(step) over (partition by recording order by frame_index rows 3 preceding) gap from w)
 select recording, pos target_frame, pos - 4 history_start, gap <= 1 usable from v where pos >= 4""")
def frame_windows(spark, sf):
    return frames.history_windows(_frames(spark, sf), 5, 1.0).select("recording", F.col("target_frame").cast("long").alias("target_frame"), F.col("history_start").cast("long").alias("history_start"), "usable")


@_query(f"with {_F} select recording, cast(floor((frame_time_s - 800) / 60) as integer) chunk, count(*) frames, cast(sum(n_points) as bigint) points, 800 + floor((frame_time_s - 800) / 60) * 60 chunk_start_s, least(800 + floor((frame_time_s - 800) / 60) * 60 + 60, 2222.0) chunk_end_s from frames where frame_time_s >= 800 and frame_time_s < 2222 group by all")
def time_chunks(spark, sf):
    rows = frames.time_chunks(_frames(spark, sf), 60.0, 800.0, 2222.0, "frame_time_s")
    return rows.groupBy("recording", "chunk", "chunk_start_s", "chunk_end_s").agg(F.count(F.lit(1)).alias("frames"), F.sum("n_points").alias("points"))


@_query(f"with {_F}, c as (select *, cast(sum(n_points) over (partition by recording order by frame_index rows unbounded preceding) as bigint) a from frames) select recording, count(*) filter (where a - n_points < 3000 and a <= 3000) kept_frames, bool_or(not (a - n_points < 3000 and a <= 3000)) or bool_or(a = 3000) truncated from c group by recording")
def point_cap(spark, sf):
    rows = frames.cap_points(_frames(spark, sf), 3000, ["frame_index"], ["recording"])
    return rows.groupBy("recording").agg(F.count_if("kept").alias("kept_frames"), F.bool_or("truncated").alias("truncated"))


@_query(f"with {_F} select recording, frame_index, n_points from frames where frame_index % 7 = 0")
def stride_sample(spark, sf):
    return frames.stride(_frames(spark, sf), 7, "frame_index").select("recording", "frame_index", "n_points")


@_query("with o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 i, count(*) over () n from orders), g as (select distinct cast(floor(j * (((select max(n) from o) - 1) / cast(99 as double))) as bigint) i from range(0, 99) t(j)) select o_orderkey from o where n <= 100 or i = n - 1 or i in (select i from g)")
def preview_sample(spark, sf):
    return frames.preview(_read(spark, sf, "orders").select("o_orderkey"), 100, ["o_orderkey"])


@_query(f"""with {_F}, w as (select recording, frame_time_s, row_number() over (partition by recording order by frame_index) - 1 i, count(*) over (partition by recording) n from frames)
 select recording, frame_time_s split_time_s from w where i = greatest(1, least(n - 1, floor(n * 0.6)))""")
def calibration_split(spark, sf):
    return frames.calibration_split(_frames(spark, sf), 0.6)


@_query(f"with {_F}, r as (select *, dense_rank() over (partition by recording order by frame_index) k from frames) select recording, frame_index from r where k <= 25")
def first_frames(spark, sf):
    return frames.first_frames(_frames(spark, sf), 25).select("recording", "frame_index")


_ROLES = f"""{_F}, g as (select recording, frame_index, row_number() over (partition by recording order by frame_index) - 1 i, count(*) over (partition by recording) n from frames),
 e as (select *, floor(cast(0.55 as double)*n) b0, floor((cast(0.55 as double)+cast(0.15 as double))*n) b1, floor((cast(0.55 as double)+cast(0.15 as double)+cast(0.15 as double))*n) b2 from g),
 roles as (select recording, i, case when i < b0 - 20 then 'train' when i >= b0 + 20 and i < b1 - 20 then 'selection' when i >= b1 + 20 and i < b2 - 20 then 'calibration' when i >= b2 + 20 then 'test' end as role from e)"""


def _roles(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    rows = _frames(spark, sf).withColumn("position", F.row_number().over(Window.partitionBy("recording").orderBy("frame_index")) - 1)
    return splits.assign_roles(rows, purge=20, stream="recording")


@_query(f"with {_ROLES} select recording, role, count(*) frames, min(i) first_frame, max(i) last_frame from roles group by all")
def purged_split(spark, sf):
    return _roles(spark, sf).groupBy("recording", "role").agg(F.count(F.lit(1)).alias("frames"), F.min("position").cast("long").alias("first_frame"), F.max("position").cast("long").alias("last_frame"))


@_query("with v as (select distinct event_type, user_id v from events where value > 40), g as (select *, v - row_number() over (partition by event_type order by v) k from v) select event_type, min(v) as start, max(v) + 1 as \"end\" from g group by event_type, k")
def compact_ranges(spark, sf):
    return splits.compact_ranges(_read(spark, sf, "events").where("value > 40").select("event_type", F.col("user_id").alias("v")), ["event_type"], "v")


@_query(f"""with {_ROLES}, d as (select recording, i, role from roles where role is not null), f as (select recording, frame_index, row_number() over (partition by recording order by frame_index) - 1 i from frames),
 p as (select l_returnflag recording, date_diff('day', date '1990-01-01', cast(l_shipdate as date)) frame_index, l_linenumber % 3 k from lineitem)
 select role, count(distinct (recording, i)) frames, count(*) points, count(*) filter (where k = 0) unimpacted, count(*) filter (where k = 1) impacted, count(*) filter (where k = 2) ignored from p join f using (recording, frame_index) join d using (recording, i) group by role""")
def split_summary(spark, sf):
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01")).cast("long")
    label = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(255)), F.col("l_linenumber") % 3 + 1)
    roles = _roles(spark, sf).where("role is not null")
    plan = splits.compact_ranges(roles.withColumnRenamed("recording", "chunk_index"), ["role", "chunk_index"], "position")
    points = _read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("recording"), day.alias("frame_index"), label.alias("label"))
    placed = points.join(_roles(spark, sf).select("recording", "frame_index", F.col("position").alias("frame")), ["recording", "frame_index"]).withColumnRenamed("recording", "chunk_index")
    return splits.split_summary(splits.role_points(placed, plan))


@_query(f"with {_CH}, s as (select lang stream_id, chunk_index, frames, cast(coalesce(sum(frames) over (partition by lang order by chunk_index rows between unbounded preceding and 1 preceding), 0) as bigint) base from chunks) select stream_id, chunk_index, base first_position, base + frames - 1 last_position from s")
def stream_positions(spark, sf):
    rows = _chunks(spark, sf).select("chunk_index", "frames", F.lit("stationary").alias("domain"), F.col("lang").alias("stream_id"), F.lit(None).cast("double").alias("source_start_s"))
    return splits.stream_frames(rows).groupBy("stream_id", "chunk_index").agg(F.min("position").alias("first_position"), F.max("position").alias("last_position"))


# --- metrics --------------------------------------------------------------------------------------------------------


@_query(f"with {_S} select round(sum(pos * tp / cast(tp + fp as double)) / max(p), 6) average_precision from cum")
def average_precision(spark, sf):
    return metrics.average_precision(metrics.cumulated(metrics.by_score(_scored(spark, sf)))).select(_r("average_precision").alias("average_precision"))


@_query(f"with {_S} select cast(tp + fp as bigint) step, round(fp / cast(n as double), 6) fpr, round(tp / cast(p as double), 6) tpr from cum union all select 0, 0, 0")
def roc_curve(spark, sf):
    return metrics.roc_curve(metrics.cumulated(metrics.by_score(_scored(spark, sf)))).select("step", _r("fpr").alias("fpr"), _r("tpr").alias("tpr"))


@_query(f"with {_S} select round(sum(neg / cast(n as double) * (2*tp - pos) / cast(2*p as double)), 6) roc_auc from cum")
def roc_auc(spark, sf):
    return metrics.roc_auc(metrics.cumulated(metrics.by_score(_scored(spark, sf)))).select(_r("roc_auc").alias("roc_auc"))


@_query(f"with {_S}, f as (select score, 2*tp / cast(2*tp + fp + p - tp as double) f1 from cum) select score threshold, round(f1, 6) f1 from f order by f1 desc, score desc limit 1")
def best_f1(spark, sf):
    return metrics.best_f1(metrics.cumulated(metrics.by_score(_scored(spark, sf)))).select("threshold", _r("f1").alias("f1"))


_PROB = "prob as (select least(value / 100, 1) p, (event_type = 'error')::int y, cast(user_id % 5 as varchar) as domain from events)"


def _probabilities(spark, sf) -> DataFrame:
    return _read(spark, sf, "events").select(F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), (F.col("event_type") == "error").cast("int").alias("label"), (F.col("user_id") % 5).cast("string").alias("domain"))


@_query(f"""with {_PROB}, c as (select domain, count(*) points, count(*) filter (where y=1) positives, avg((p-y)*(p-y)) brier, count(*) filter (where p>=0.5 and y=1) tp, count(*) filter (where p>=0.5 and y=0) fp, count(*) filter (where p<0.5 and y=0) tn, count(*) filter (where p<0.5 and y=1) fn from prob group by rollup(domain))
 select domain, points, positives, round(brier, 6) brier_score, tp true_positive, fp false_positive, tn true_negative, fn false_negative, round(coalesce(tp/nullif(cast(tp+fp as double),0),0),6) as "precision", round(coalesce(tp/nullif(cast(tp+fn as double),0),0),6) recall, round(coalesce(2*tp/nullif(cast(2*tp+fp+fn as double),0),0),6) f1, round(fp/nullif(cast(fp+tn as double),0),6) false_positive_rate from c""")
def metric_summary(spark, sf):
    out = metrics.summary(_probabilities(spark, sf), 0.5, ["domain"])
    rounded = ("brier_score", "precision", "recall", "f1", "false_positive_rate")
    return out.select("domain", "points", "positives", "true_positive", "false_positive", "true_negative", "false_negative", *[_r(c).alias(c) for c in rounded])


@_query(f"""with {_PROB}, d as (select *, 'overall' g from prob union all select *, domain from prob), s as (select g, p, count(*) filter (where y=1) pos, count(*) filter (where y=0) neg from d group by g, p),
 c as (select *, sum(pos) over w tp, sum(neg) over w fp, sum(pos) over (partition by g) pp, sum(neg) over (partition by g) nn from s window w as (partition by g order by p desc rows unbounded preceding))
 select g as "group", cast(sum(pos + neg) as bigint) points, round(sum(pos * tp / cast(tp+fp as double)) / max(pp), 6) average_precision, round(sum(neg / cast(nn as double) * (2*tp - pos) / cast(2*pp as double)), 6) roc_auc from c group by g""")
def grouped_report(spark, sf):
    return metrics.report(_probabilities(spark, sf), 0.5, "domain").select("group", "points", _r("average_precision").alias("average_precision"), _r("roc_auc").alias("roc_auc"))


@_query(f"""with {_PROB}, s as (select domain, p, count(*) filter (where y=1) pos, count(*) n from prob group by domain, p), c as (select *, sum(pos) over w tp, sum(n) over w k, sum(pos) over (partition by domain) pp from s window w as (partition by domain order by p desc rows unbounded preceding)),
 a as (select domain, case when max(pp) > 0 then sum(pos * tp / cast(k as double)) / max(pp) end ap from c group by domain) select round(avg(ap), 6) mean_average_precision from a""")
def mean_domain_precision(spark, sf):
    return metrics.mean_group_ap(_probabilities(spark, sf), "domain").select(_r("mean_average_precision").alias("mean_average_precision"))


@_query(f"with {_PROB}, b as (select p, y, (select count(*) from range(1, 10) t(i) where p >= i * cast(0.1 as double)) bin from prob) select cast(bin as integer) bin, count(*) points, round(avg(p), 6) mean_score, round(avg(y), 6) observed_rate from b group by bin")
def reliability_bins(spark, sf):
    return metrics.reliability(_probabilities(spark, sf)).select(F.col("bin").cast("int").alias("bin"), "points", _r("mean_score").alias("mean_score"), _r("observed_rate").alias("observed_rate"))


# --- voxels ---------------------------------------------------------------------------------------------------------

_V = f"{_P}, v as (select *, cast(floor(x / 0.5) as bigint) vx, cast(floor(y / 0.5) as bigint) vy, cast(floor(z / 0.5) as bigint) vz, sqrt(x*x+y*y+z*z) r from points)"
_MOMENTS = ", ".join(f"round(avg({c}), 6) {n}_mean, round(stddev_pop({c}), 6) {n}_std" for n, c in (("intensity", "intensity"), ("range", "r"), ("x", "x"), ("y", "y"), ("z", "z")))


def _features(spark, sf) -> DataFrame:
    return voxels.voxel_features(_points(spark, sf), 0.5, ["recording"], labels=False)


@_query(f"with {_V} select recording, vx, vy, vz, count(*) n_points, round(ln(1 + count(*)), 6) log_count, {_MOMENTS} from v group by recording, vx, vy, vz")
def voxel_features(spark, sf):
    return _features(spark, sf).select("recording", "vx", "vy", "vz", "n_points", *[_r(c).alias(c) for c in voxels.FEATURES])


@_query(f"with {_V}, f as (select recording, vx, vy, vz, ln(1 + count(*)) log_count, avg(intensity) intensity_mean, stddev_pop(z) z_std from v group by recording, vx, vy, vz) select count(*) as \"count\", round(avg(log_count), 6) log_count_center, round(case when stddev_pop(log_count) < 1e-6 then 1 else stddev_pop(log_count) end, 6) log_count_scale, round(avg(intensity_mean), 6) intensity_mean_center, round(stddev_pop(intensity_mean), 6) intensity_mean_scale, round(avg(z_std), 6) z_std_center from f")
def normalizer(spark, sf):
    return voxels.normaliser(_features(spark, sf)).select("count", *[_r(c).alias(c) for c in ("log_count_center", "log_count_scale", "intensity_mean_center", "intensity_mean_scale", "z_std_center")])


@_query(f"with {_V}, f as (select recording, vx, vy, vz, avg(intensity) m from v group by recording, vx, vy, vz), n as (select avg(m) c, stddev_pop(m) s from f) select recording, vx, vy, vz, round(cast((m - c) / s as double), 3) intensity_mean from f, n")
def normalized_features(spark, sf):
    features = _features(spark, sf)
    return voxels.normalised(features, voxels.normaliser(features)).select("recording", "vx", "vy", "vz", F.round(F.col("intensity_mean").cast("double"), 3).alias("intensity_mean"))


@_query(f"with {_V}, s as (select vx, vy, vz, count(distinct frame_index) support from v group by vx, vy, vz) select vx, vy, vz, support, cast((vx + 0.5) * 0.5 as double) cx from s where support >= 3")
def voxel_support(spark, sf):
    out = voxels.voxel_support(_points(spark, sf), 0.5, 3, (0.0, 0.0, 0.0))
    return out.select("vx", "vy", "vz", "support", F.col("cx").cast("double").alias("cx"))


@_query(f"with {_V}, f as (select recording, vx, vy, vz, avg(intensity) logit from v group by recording, vx, vy, vz) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(logit, 6) logit from v join f using (recording, vx, vy, vz)")
def voxel_scores_to_points(spark, sf):
    scored = _features(spark, sf).withColumn("logit", F.col("intensity_mean"))
    return voxels.scores_to_points(_points(spark, sf), scored, 0.5, ["recording"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _r("logit").alias("logit"))


# --- space ----------------------------------------------------------------------------------------------------------

_BOXES = (regions.Box("a", (-0.1, -0.1, -0.1), (0.05, 0.1, 0.1)), regions.Box("b", (0.0, -0.2, -0.2), (0.2, 0.2, 0.2)))
_IN_A, _IN_B = "(x between -0.1 and 0.05 and y between -0.1 and 0.1 and z between -0.1 and 0.1)", "(x between 0.0 and 0.2 and y between -0.2 and 0.2 and z between -0.2 and 0.2)"


def _world(spark, sf) -> DataFrame:
    return _cloud(spark, sf).withColumns({f"w{c}": F.col(c) for c in "xyz"})


@_query(f"with {_C} select vec_id, {_IN_A} in_a, case when {_IN_B} then 1 when {_IN_A} then 0 else -1 end last_region from cloud")
def box_regions(spark, sf):
    return _world(spark, sf).select("vec_id", _BOXES[0].holds().alias("in_a"), regions.last_region(_BOXES).cast("int").alias("last_region"))


_NN = f"{_C}, nn as (select q.vec_id, q.x, q.y, q.z, q.frame, min(sqrt((q.x-r.x)*(q.x-r.x)+(q.y-r.y)*(q.y-r.y)+(q.z-r.z)*(q.z-r.z))) d from cloud q cross join cloud r where q.vec_id % 2 = 1 and r.vec_id % 2 = 0 group by all)"


@_query(f"with {_NN} select vec_id, round(d, 6) distance from nn")
def nearest_reference(spark, sf):
    cloud = _cloud(spark, sf)
    return nearest.nearest_exact(cloud.where("vec_id % 2 = 1"), cloud.where("vec_id % 2 = 0"), 0.05, ["vec_id"]).select("vec_id", _r("distance").alias("distance"))


@_query(f"with {_C} select q.vec_id from cloud q where not exists (select 1 from cloud r where r.frame = q.frame and r.vec_id <> q.vec_id and sqrt((q.x-r.x)*(q.x-r.x)+(q.y-r.y)*(q.y-r.y)+(q.z-r.z)*(q.z-r.z)) <= 0.06)")
def isolated_points(spark, sf):
    return nearest.isolated(_cloud(spark, sf), 0.06, ["frame", "vec_id"], ["frame"]).select("vec_id")


_RULES = regions.DistanceRules(regions.Box("crop", (-0.3, -0.3, -0.3), (0.3, 0.3, 0.3)), 0.05, 0.04, 0.07, (_BOXES[0],), (_BOXES[1],), single=False)
_COV = "(x between -0.25 and 0.25 and y between -0.25 and 0.25 and z between -0.25 and 0.25)"
_CLS = f"""{_NN}, c as (select *, vec_id % 5 <> 0 ok, {_COV} inside, {_IN_A} in_a, {_IN_B} in_b from nn),
 l as (select *, case when not ok or not inside then 255 when d >= 0.07 then 1 when d <= 0.04 then 0 else 255 end automatic,
 case when ok and inside and in_a then 254 when ok and inside and in_b and d >= 0.07 then 1 when ok and inside and not in_b and d >= 0.07 then 255 when not ok or not inside then 255 when d >= 0.07 then 1 when d <= 0.04 then 0 else 255 end as label,
 case when ok and inside and in_a then 4 when ok and inside and in_b and d >= 0.07 then 0 when ok and inside and not in_b and d >= 0.07 then 5 when not ok then 1 when not inside then 2 when d >= 0.07 or d <= 0.04 then 0 else 3 end reason,
 ok and inside and (in_a or (in_b and d >= 0.07)) human from c)"""


def _near(spark, sf) -> DataFrame:
    cloud = _world(spark, sf)
    found = nearest.nearest_exact(cloud.where("vec_id % 2 = 1"), cloud.where("vec_id % 2 = 0"), 0.05, ["vec_id"])
    return cloud.join(found, "vec_id").withColumnRenamed("distance", "nearest_distance").withColumn("input_valid", F.col("vec_id") % 5 != 0)


@_query(f"with {_CLS} select vec_id, label, automatic automatic_label, reason, case when ok and inside and in_a then 0 else -1 end region_id, human human_verified from l")
def distance_labels(spark, sf):
    out = regions.classify(_near(spark, sf), _RULES)
    return out.select("vec_id", *[F.col(c).cast("int").alias(c) for c in ("label", "automatic_label", "reason", "region_id")], "human_verified")


@_query(f"""with {_NN}, f as (select *, vec_id % 5 <> 0 and x between -0.3 and 0.3 and y between -0.3 and 0.3 and z between -0.3 and 0.3 cov, {_IN_B} in_b from nn),
 b as (select frame, count(*) n, count(*) filter (where cov) c, count(*) filter (where cov and d <= 0.04) s, count(*) filter (where cov and d >= 0.07) g, count(*) filter (where cov and in_b and d >= 0.07) e from f group by frame)
 select count(*) frames, cast(sum(n) as bigint) points, cast(sum(c) as bigint) covered_points, cast(sum(s) as bigint) structure_points, cast(sum(g) as bigint) global_false_positives, cast(sum(e) as bigint) effective_false_positives, count(*) filter (where e > 0) frames_with_effective, round(quantile_cont(cast(e as double), 0.9), 6) effective_per_frame_p9, round((select quantile_cont(d, 0.95) from f where cov), 6) distance_p95 from b""")
def clean_validation(spark, sf):
    out = regions.clean_validation(_near(spark, sf), _RULES, ["frame"])
    counts = ("frames", "points", "covered_points", "structure_points", "global_false_positives", "effective_false_positives", "frames_with_effective")
    return out.select(*counts, _r("effective_per_frame_p9").alias("effective_per_frame_p9"), _r("distance_p95").alias("distance_p95"))


# --- poses ----------------------------------------------------------------------------------------------------------

_T = """poses as (select 'all' session_id, epoch_us(ts) * 1000 time_ns, avg(value) tx, avg(user_id) ty from events where event_type = 'click' group by ts), q as (select event_id, epoch_us(ts) * 1000 time_ns from events where event_type = 'view'),
 iv as (select *, lead(time_ns) over (order by time_ns) t1, lead(tx) over (order by time_ns) tx1, lead(ty) over (order by time_ns) ty1 from poses)"""


def _poses(spark, sf) -> tuple[DataFrame, DataFrame]:
    events = _read(spark, sf, "events").withColumn("time_ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    poses_ = events.where("event_type = 'click'").groupBy("time_ns").agg(F.avg("value").alias("tx"), F.avg("user_id").alias("ty")).withColumns({"session_id": F.lit("all"), "tz": F.lit(0.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0), "qw": F.lit(1.0)})
    scans = events.where("event_type = 'view'").select(F.lit("all").alias("session_id"), F.col("event_id").alias("frame_index"), "time_ns")
    return poses_, scans


@_query(f"""with {_T} select q.event_id, case when iv.time_ns is null or (iv.t1 is null and q.time_ns > iv.time_ns) then 'outside' when q.time_ns = iv.time_ns then 'exact' when iv.t1 - iv.time_ns > 3600000000000 then 'gap' else 'between' end pose_status,
 case when iv.time_ns is null or (iv.t1 is null and q.time_ns > iv.time_ns) then null when q.time_ns = iv.time_ns then round(iv.tx, 4) when iv.t1 - iv.time_ns > 3600000000000 then null else round(iv.tx + (q.time_ns - iv.time_ns) / cast(iv.t1 - iv.time_ns as double) * (iv.tx1 - iv.tx), 4) end tx from q asof left join iv on q.time_ns >= iv.time_ns""")
def asof_pose(spark, sf):
    own, scans = _poses(spark, sf)
    out = poses.at_times(scans, own, 3_600_000_000_000, bucket_ns=3_600_000_000_000)
    return out.select(F.col("frame_index").alias("event_id"), "pose_status", _r("tx", 4).alias("tx"))


@_query("""with p as (select o_orderkey, (o_custkey % 90) * pi() / 180 a, (o_custkey % 90 + 60) * pi() / 180 b, (o_orderkey % 10) / cast(10 as double) f from orders)
 select o_orderkey, round(sin((a + f * (b - a)) / 2), 6) qz, round(cos((a + f * (b - a)) / 2), 6) qw from p""")
def slerp_pose(spark, sf):
    from ..functions.geometry import slerp

    rows = _read(spark, sf, "orders").select("o_orderkey", F.radians((F.col("o_custkey") % 90).cast("double")).alias("a"), F.radians((F.col("o_custkey") % 90 + 60).cast("double")).alias("b"), ((F.col("o_orderkey") % 10) / 10).alias("f"))
    about = lambda c: [F.lit(0.0), F.lit(0.0), F.sin(F.col(c) / 2), F.cos(F.col(c) / 2)]
    turned = slerp(about("a"), about("b"), F.col("f"))
    return rows.select("o_orderkey", _r(turned[2]).alias("qz"), _r(turned[3]).alias("qw"))


@_query(f"with {_C} select vec_id, round(-y + 1, 5) wx, round(x + 2, 5) wy, round(z + 3, 5) wz from cloud")
def rigid_transform(spark, sf):
    from ..functions.geometry import move, vector

    half = 0.5**0.5
    world = move([F.lit(0.0), F.lit(0.0), F.lit(half), F.lit(half)], (F.lit(1.0), F.lit(2.0), F.lit(3.0)), vector("x", "y", "z"))
    return _cloud(spark, sf).select("vec_id", *[_r(c, 5).alias(n) for c, n in zip(world, ("wx", "wy", "wz"), strict=True)])


@_query(f"with {_T}, b as (select min(time_ns) a, max(time_ns) z from poses) select event_id, time_ns >= a and time_ns <= z in_coverage from q, b")
def pose_coverage(spark, sf):
    own, scans = _poses(spark, sf)
    return poses.coverage(scans, own).select(F.col("frame_index").alias("event_id"), "in_coverage")


@_query("""select coalesce(a.l_orderkey, b.l_orderkey) frame_index, coalesce(a.l_linenumber, b.l_linenumber) line, coalesce(a.l_partkey, b.l_partkey) point_index, case when a.l_orderkey is null then 'no raw point' when b.l_orderkey is null then 'no undistorted point' when a.l_tax is distinct from b.l_tax then 'tax' end mismatch
 from (select * from lineitem where l_linenumber <> 2) a full join (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_orderkey % 50 = 0 then l_tax + 1 else l_tax end l_tax from lineitem where l_linenumber <> 3) b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber and a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey""")
def pair_frames(spark, sf):
    rows = _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame_index"), F.col("l_partkey").alias("point_index"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"), F.col("l_tax").alias("tax"), *[F.lit(0.0).alias(c) for c in "xyz"])
    changed = rows.where("line <> 3").withColumn("tax", F.when(F.col("frame_index") % 50 == 0, F.col("tax") + 1).otherwise(F.col("tax")))
    return poses.pair_frames(rows.where("line <> 2"), changed, ["frame_index", "point_index", "line", "supplier"], ["tax"]).select("frame_index", "line", "point_index", "mismatch")


# --- datasets -------------------------------------------------------------------------------------------------------


def _canonical(spark, sf) -> DataFrame:
    p = _points(spark, sf)
    base = p.select(
        F.col("recording").alias("recording_id"), F.col("stream").alias("session_id"), "frame_index", F.col("l_orderkey").alias("point_index"), "x", "y", "z", "intensity", "line", F.lit(0).alias("tag"),
        F.when(F.col("stream") == "O", "clean_control").otherwise("smoke_test").alias("condition"), F.element_at(F.array(F.lit(0), F.lit(1), F.lit(254)), F.col("line") % 3 + 1).alias("label"),
    )
    still = datasets.unify_stationary(base.where("session_id = 'O'").withColumn("reflectivity", F.col("intensity") + 1).withColumn("point_offset_s", F.lit(0.5)).withColumn("label", datasets.remapped(F.col("label"))))
    moving = datasets.unify_moving(base.where("session_id <> 'O'").withColumn("relative_time_ns", F.col("line") * 1000000))
    return datasets.unify([still, moving])


_U = f"{_P}, u as (select case when stream = 'O' then 'stationary' else 'moving' end source_domain, recording recording_id, stream session_id, case when stream = 'O' then 'clean_control' else 'smoke' end as condition, case when line % 3 = 0 then 0 when line % 3 = 2 then 255 when stream = 'O' then 0 else 1 end as label, cast(cast(case when stream = 'O' then intensity + 1 else intensity end as float) as double) intensity, case when stream = 'O' then cast(0.5 as double) else cast(cast(line * 1000000 * cast(1e-9 as double) as float) as double) end off from points)"


@_query(f"with {_U} select source_domain, recording_id, condition, count(*) points, count(*) filter (where label=0) unimpacted, count(*) filter (where label=1) impacted, count(*) filter (where label=255) ignored, round(sum(intensity), 2) intensity, round(sum(off), 4) as \"offset\" from u group by all")
def unify_domains(spark, sf):
    rows = _canonical(spark, sf).groupBy("source_domain", "recording_id", "condition")
    count = lambda c: F.count_if(F.col("label") == c)
    return rows.agg(F.count(F.lit(1)).alias("points"), count(0).alias("unimpacted"), count(1).alias("impacted"), count(255).alias("ignored"), F.round(F.sum(F.col("intensity").cast("double")), 2).alias("intensity"), F.round(F.sum(F.col("point_offset_s").cast("double")), 4).alias("offset"))


@_query(f"with {_U}, c as (select source_domain, session_id, recording_id, condition, count(*) points, count(*) filter (where label=0) unimpacted, count(*) filter (where label=1) smoke_impacted, count(*) filter (where label=255) \"ignore\" from u group by all) select *, row_number() over (order by source_domain, session_id, recording_id) - 1 chunk_index from c")
def dataset_manifest(spark, sf):
    points = _canonical(spark, sf)
    none = points.select("recording_id").limit(0)
    out = datasets.manifest(points, none)
    return out.select("source_domain", "session_id", "recording_id", "condition", "points", "unimpacted", "smoke_impacted", "ignore", F.col("chunk_index").cast("long").alias("chunk_index"))


@_query(f"with {_F} select recording recording_id, 'frame times don''t increase' problem, count(*) n from (select recording, frame_index from frames where frame_index % 97 = 0 and frame_index > (select min(f.frame_index) from frames f where f.recording = frames.recording)) group by recording")
def schema_violations(spark, sf):
    from pyspark.sql import Window

    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01")).cast("long")
    order = Window.partitionBy("recording_id").orderBy("day")
    raw = _read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("recording_id"), day.alias("day"))
    days = raw.groupBy("recording_id", "day").agg(F.count(F.lit(1)).alias("n_points")).withColumn("frame_index", F.row_number().over(order) - 1)
    late = (F.col("day") % 97 == 0) & (F.col("frame_index") > 0)
    timed = days.withColumn("frame_time_s", F.when(late, F.lag("day").over(order)).otherwise(F.col("day")).cast("double"))
    zero = {c: F.lit(0.0) for c in ("x", "y", "z", "intensity", "point_offset_s")}
    points = raw.join(days.select("recording_id", "day", "frame_index"), ["recording_id", "day"]).withColumns(zero | {"schema_version": F.lit(datasets.VERSION), "session_id": F.lit("s"), "condition": F.lit("c"), "label": F.lit(0)})
    return datasets.violations(points, timed)


@_query("select o_orderkey, regexp_replace(o_orderpriority || '.' || o_orderstatus, '[^A-Za-z0-9_-]', '_', 'g') as name from orders")
def safe_names(spark, sf):
    return _read(spark, sf, "orders").select("o_orderkey", safe_name(F.concat_ws(".", "o_orderpriority", "o_orderstatus")).alias("name"))


@_query(f"with {_F} select recording, frame_index, frame_time_s - min(frame_time_s) over (partition by recording) frame_time_s from frames")
def rebased_times(spark, sf):
    return datasets.rebased_frames(_frames(spark, sf), F.col("frame_time_s"), "recording").select("recording", "frame_index", "frame_time_s")


# --- checks and summaries -------------------------------------------------------------------------------------------


@_query(f"with {_C} select frame frame_index, count(*) points, round(quantile_cont(sqrt(x*x + 0.25*y*y + z*z*z*z), 0.5), 6) median_m, round(max(sqrt(x*x + 0.25*y*y + z*z*z*z)), 6) max_m from cloud group by frame")
def frame_displacement(spark, sf):
    paired = _cloud(spark, sf).withColumnRenamed("frame", "frame_index").withColumns({"ux": F.col("x") * 2, "uy": F.col("y") * 1.5, "uz": F.col("z") + F.col("z") * F.col("z")})
    return poses.displacement(paired).select("frame_index", "points", _r("median_m").alias("median_m"), _r("max_m").alias("max_m"))


@_query(f"with {_P} select recording, count(distinct frame_index) frames, count(*) points, round(min(sqrt(x*x+y*y+z*z)), 6) range_min, round(quantile_cont(sqrt(x*x+y*y+z*z), 0.5), 6) range_median, round(max(sqrt(x*x+y*y+z*z)), 6) range_max, round(max(frame_index) - min(frame_index), 6)::double span_s, bool_or(intensity <> 0) has_reflectivity from points group by recording")
def inspect_summary(spark, sf):
    from .workflows import inspect

    rows = _points(spark, sf).withColumns({"reflectivity": F.col("intensity"), "tag": F.lit(0), "time_s": F.col("frame_index").cast("double")})
    return inspect(rows).select("recording", "frames", "points", *[_r(c).alias(c) for c in ("range_min", "range_median", "range_max", "span_s")], "has_reflectivity")


@_query("select o_orderkey, sha256(o_orderpriority) sha256 from orders")
def content_checksums(spark, sf):
    rows = _read(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").cast("binary").alias("content"))
    return datasets.checksums(rows).select("o_orderkey", "sha256")


@_query(f"with {_U}, c as (select recording recording_id, count(*) points, case when recording = 'A' then count(*) + 1 else count(*) end listed from (select recording_id recording from u) group by recording) select recording_id, 'points' problem from c where listed <> points")
def manifest_mismatches(spark, sf):
    points = _canonical(spark, sf).withColumns({"session_id": F.lit("s"), "source_domain": F.lit("d"), "condition": F.lit("c")})
    actual = datasets.manifest(points, points.select("recording_id").limit(0))
    wrong = F.col("points") + F.when(F.col("recording_id") == "A", 1).otherwise(0)
    return datasets.manifest_mismatches(actual.withColumn("points", wrong), actual)


@_query("with v as (select event_type role, user_id % 7 chunk_index, value::bigint frame from events), t as (select chunk_index, frame from (select distinct * from v) group by all having count(*) > 1) select chunk_index, frame, 'more than one role' problem from t union all select distinct chunk_index, frame, 'not in the chunk' from v where frame >= 10")
def role_conflicts(spark, sf):
    rows = _read(spark, sf, "events").select(F.col("event_type").alias("role"), (F.col("user_id") % 7).alias("chunk_index"), F.rint("value").cast("long").alias("frame"))
    plan = splits.compact_ranges(rows, ["role", "chunk_index"], "frame")
    chunks = spark.range(7).select(F.col("id").alias("chunk_index"), F.lit(10).cast("long").alias("frames"))
    return splits.role_conflicts(plan, chunks)


@_query("with d as (select distinct user_id % 9 u, event_type e from events) select case when u < 4 then 'moving/' || u else 'still/' || u || '/' || e end stream_id, count(*) chunks from d group by 1")
def stream_ids(spark, sf):
    u = F.col("user_id") % 9
    rows = _read(spark, sf, "events").select(F.when(u < 4, "moving").otherwise("still").alias("domain"), u.cast("string").alias("session"), F.col("event_type").alias("recording")).distinct()
    return splits.stream_id(rows).groupBy("stream_id").agg(F.count(F.lit(1)).alias("chunks"))


@_query("select event_type, round(quantile_cont(value, 0.5), 6) middle, round(quantile_cont(value, 0.999), 6) high from events group by event_type")
def group_quantiles(spark, sf):
    out = linear_by(_read(spark, sf, "events"), ["event_type"], "value", {"middle": 0.5, "high": 0.999})
    return out.select("event_type", _r("middle").alias("middle"), _r("high").alias("high"))


@_query(f"with {_NN} select vec_id, case when vec_id % 10 = 5 then null else round(d, 6) end distance from nn")
def nearest_of_odd_points(spark, sf):
    """Queries and reference points with coordinates that aren't finite."""
    cloud = _cloud(spark, sf)
    asked = cloud.where("vec_id % 2 = 1").withColumn("x", F.when(F.col("vec_id") % 10 == 5, F.lit(float("nan"))).otherwise(F.col("x")))
    known = cloud.where("vec_id % 2 = 0").unionByName(cloud.limit(1).withColumn("z", F.lit(float("inf"))))
    return nearest.nearest_exact(asked, known, 0.01, ["vec_id"]).select("vec_id", _r("distance").alias("distance"))


@_query(f"""with {_CLS} select vec_id % 4 chunk, count(distinct frame) frames, count(*) points, count(*) filter (where label = 0) unaffected, count(*) filter (where label = 1) impacted, count(*) filter (where label = 254) excluded, count(*) filter (where label = 255) ignored,
 round(quantile_cont(d, 0.5), 6) distance_p5, round(quantile_cont(d, 0.99), 6) distance_p99 from l group by vec_id % 4""")
def chunk_distances(spark, sf):
    from .workflows import chunk_report

    rows = regions.classify(_near(spark, sf), _RULES).withColumns({"session_id": F.lit("s"), "chunk": F.col("vec_id") % 4, "frame_index": F.col("frame")})
    out = chunk_report(rows)
    return out.select("chunk", "frames", "points", "unaffected", "impacted", "excluded", "ignored", _r("distance_p5").alias("distance_p5"), _r("distance_p99").alias("distance_p99"))


# --- sources and sinks: written to files and read again -------------------------------------------------------------


@_query("""with p as (select l_returnflag r, l_linenumber % 3 k, date_diff('day', date '1990-01-01', cast(l_shipdate as date)) d from lineitem)
 select r recording_id, 's' session_id, 'moving' source_domain, 'smoke' as condition, count(distinct d) frames, count(*) points, count(*) filter (where k = 0) unimpacted, count(*) filter (where k = 1) smoke_impacted, count(*) filter (where k = 2) "ignore", row_number() over (order by r) - 1 chunk_index from p group by r""")
def dataset_files(spark, sf):
    """The canonical dataset in files, its manifest read with verified checksums."""
    from pyspark.sql import Window

    from ..functions.staging import scratch
    from ..sources.config import read_manifest
    from ..sources.sinks import write_dataset

    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01"))
    raw = _read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("recording_id"), day.alias("day"), "l_linenumber")
    days = raw.groupBy("recording_id", "day").agg(F.count(F.lit(1)).alias("n_points")).withColumn("frame_index", F.row_number().over(Window.partitionBy("recording_id").orderBy("day")) - 1)
    label = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(255)), F.col("l_linenumber") % 3 + 1)
    fixed = {"schema_version": F.lit(datasets.VERSION), "session_id": F.lit("s"), "source_domain": F.lit("moving"), "condition": F.lit("smoke"), "label": label, "line": F.col("l_linenumber"), "tag": F.lit(0), "point_index": F.lit(0)}
    points = raw.join(days, ["recording_id", "day"]).withColumns(fixed | {c: F.lit(0.5) for c in ("x", "y", "z", "intensity", "point_offset_s")})
    timed = days.withColumn("frame_time_s", F.col("day").cast("double"))
    typed = lambda df, schema: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    path = scratch(spark).removeprefix("file:")
    write_dataset(path, typed(points, datasets.POINTS), typed(timed, datasets.FRAMES))
    out = read_manifest(spark, f"{path}/manifest.json", datasets.VERSION, verify=True)
    return out.select("recording_id", "session_id", "source_domain", "condition", "frames", "points", "unimpacted", "smoke_impacted", "ignore", "chunk_index")


@_query("select o_orderkey, o_custkey, o_totalprice from orders")
def archive_files(spark, sf):
    """Array archives written by executors and read again."""
    from ..functions.staging import scratch
    from ..sources import register

    register(spark)
    path = scratch(spark).removeprefix("file:")
    _read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").write.format("npz").mode("append").save(path)
    return spark.read.format("npz").load(path).select("o_orderkey", "o_custkey", "o_totalprice")


@_query("select event_id, to_json({event_id: event_id, user_id: user_id, event_type: event_type}) as line from events")
def json_line_files(spark, sf):
    from ..functions.staging import scratch
    from ..sources.sinks import write_json_lines

    path = scratch(spark)
    write_json_lines(path, _read(spark, sf, "events").select("event_id", "user_id", "event_type"))
    return spark.read.text(path).select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.col("value").alias("line"))


@_query(f"with {_C} select vec_id, printf('%.5f %.5f %.5f', x, y, z) || case when frame = 0 then ' 70 130 180' when frame = 1 then ' 220 60 40' else ' 128 128 128' end || ' ' || frame as line from cloud")
def ply_lines(spark, sf):
    from ..sources.sinks import label_colour, ply_rows

    rows = ply_rows(_cloud(spark, sf), colour=label_colour(F.col("frame")), extra=["frame", "vec_id"])
    return rows.select(F.element_at(F.split("value", " "), -1).cast("long").alias("vec_id"), F.regexp_replace("value", " [0-9]+$", "").alias("line"))


@_query(f"with {_C} select vec_id point_index, frame frame_index, round(least(greatest(x + 0.5, 0), 1), 4) probability, round(1 - least(greatest(x + 0.5, 0), 1), 4) reliability, case when least(greatest(x + 0.5, 0), 1) >= 0.55 then 1 else 0 end predicted_label, true as valid, frame % 2 source_label from cloud")
def prediction_rows(spark, sf):
    from ..sources.sinks import predictions

    rows = _cloud(spark, sf).select(F.col("frame").alias("frame_index"), F.col("vec_id").alias("point_index"), "x", "y", "z", F.least(F.greatest(F.col("x") + 0.5, F.lit(0.0)), F.lit(1.0)).alias("probability"), (F.col("frame") % 2).alias("label"))
    out = predictions(rows, 0.55)
    return out.select("point_index", "frame_index", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("probability", "reliability")], F.col("predicted_label").cast("int").alias("predicted_label"), "valid", "source_label")


@_query("""with p as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag f, l_linenumber - 1 i, epoch_us(l_shipdate) * 1000 t from lineitem), b as (select f, max(i) n, min(t) t from p group by f),
 o as (select f, coalesce(sum(n + 1) over (order by f rows between unbounded preceding and 1 preceding), 0) base, min(t) over () origin from b)
 select l_orderkey, l_partkey, l_suppkey, l_linenumber, 'run' recording, cast(i + base as integer) frame_index, round((t - origin) / 1e9, 3) time_s from p join o using (f)""")
def frames_across_files(spark, sf):
    rows = _read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_returnflag").alias("recording"), (F.col("l_linenumber") - 1).alias("frame_index"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("message_time_ns"), F.lit(0.0).alias("offset_s"))
    return frames.across_files(rows, "run").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "recording", "frame_index", _r("time_s", 3).alias("time_s"))


_LINEAR = " + ".join(f"0.1 * (f.{c} - n.{c}_c) / case when n.{c}_s < 1e-6 then 1 else n.{c}_s end" for c in voxels.FEATURES)
_RAW = ", ".join(f"avg({c}) {n}_mean, stddev_pop({c}) {n}_std" for n, c in (("intensity", "intensity"), ("range", "r"), ("x", "x"), ("y", "y"), ("z", "z")))


@_query(f"""with {_V}, f as (select recording, vx, vy, vz, ln(1 + count(*)) log_count, {_RAW} from v group by recording, vx, vy, vz), n as (select {", ".join(f"avg({c}) {c}_c, stddev_pop({c}) {c}_s" for c in voxels.FEATURES)} from f),
 s as (select f.recording, f.vx, f.vy, f.vz, {_LINEAR} + 0.5 logit from f, n) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(logit, 3) logit from v join s using (recording, vx, vy, vz)""")
def linear_scores(spark, sf):
    """A scorer of one linear layer with fixed weights, applied in Arrow batches to every voxel's points."""
    import numpy as np

    from ..models import scorer

    features = _features(spark, sf)
    fixed = scorer.Scorer([np.full((len(voxels.FEATURES), 1), 0.1)], [np.array([0.5])])
    scored = scorer.score(voxels.normalised(features, voxels.normaliser(features)), fixed)
    return voxels.scores_to_points(_points(spark, sf), scored, 0.5, ["recording"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _r("logit", 3).alias("logit"))


@_query("select count(*) points, count(*) filter (where event_type <> 'error') positives, 0.0::double slope_gradient, 0.0::double bias_gradient from events where value is not null")
def platt_optimum(spark, sf):
    """The log loss's mean gradient at the calibration that was found: zero in both directions."""
    from ..functions.semantics import sigmoid
    from ..models.scorer import calibrate

    rows = _read(spark, sf, "events").where("value is not null").select((F.col("value") / 25).alias("score"), (F.col("event_type") != "error").cast("int").alias("label"))
    found = calibrate(metrics.by_score(rows))
    off = sigmoid(F.lit(found.slope) * F.col("score") + found.bias) - F.col("label")
    # + 0.0: no negative zero.
    return rows.agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("label") == 1).alias("positives"), (F.round(F.avg(off * F.col("score")), 5) + 0.0).alias("slope_gradient"), (F.round(F.avg(off), 5) + 0.0).alias("bias_gradient"))


@_query()
def platt_calibration(spark, sf):
    """Slope and bias on one row; the optimum is tested against its neighbours."""
    from ..models.scorer import calibrate

    found = calibrate(metrics.by_score(_read(spark, sf, "events").select((F.col("value") / 25).alias("score"), (F.col("event_type") != "error").cast("int").alias("label"))))
    return spark.createDataFrame([(round(found.slope, 5), round(found.bias, 5))], "slope double, bias double")


@_query()
def score_points(spark, sf):
    """A fresh scorer's logits on every voxel's points."""
    from ..models import scorer

    features = _features(spark, sf)
    scored = scorer.score(voxels.normalised(features, voxels.normaliser(features)), scorer.Scorer.fresh(len(voxels.FEATURES)))
    return voxels.scores_to_points(_points(spark, sf), scored, 0.5, ["recording"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _r("logit").alias("logit"))
