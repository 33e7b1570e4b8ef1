"""Shared scratch space, written intermediate tables and small per-process caches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, removed when the application ends.

    A machine-local folder is used only where the session names none and runs on this machine alone, as in local tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        base = process_cache("scratch_base", lambda: tempfile.mkdtemp(prefix="pointloom-"))
    path = f"{base.rstrip('/')}/pointloom-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def process_cache(name: str, make: Callable[[], object]):
    """One value for each name in this Python process; it outlives the task that made it."""
    store = sys.modules.setdefault("_pointloom_process", types.ModuleType("_pointloom_process")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df (a few plain columns) as a broadcast side if it has no more than so many rows; beyond, Spark shuffles it."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= rows else df


def plain_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether the ids are distinct integers, so that they can be keys."""
    from pyspark.sql import functions as F

    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return False
    return not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col(id_col).isNull()).take(1)


def orderable(kind) -> bool:
    """Whether rows can be ordered by a column of this type (maps and variants can't be)."""
    name = kind.typeName()
    if name == "array":
        return orderable(kind.elementType)
    return name not in ("map", "variant") and (name != "struct" or all(orderable(f.dataType) for f in kind.fields))


def keyed(docs: DataFrame, id_col: str = "doc_id", columns: tuple[str, ...] = ("text",), plain: bool | None = None) -> DataFrame:
    """columns of docs with `_id` (the id) and `_key`: a long, one for each row, in the order of the ids.

    Ids that are distinct integers are the keys. If an id is null or repeated, rows get ascending numbers by (id, columns),
    nulls first, so that each row is a document of its own; columns that can't be ordered take no part in the order.
    """
    from pyspark.sql import functions as F

    slim = docs.select(F.col(id_col).alias("_id"), *columns)
    if plain if plain is not None else plain_ids(docs, id_col):
        return slim.withColumn("_key", F.col("_id").cast("long"))
    order = [F.col(c).asc_nulls_first() for c in ("_id", *columns) if orderable(slim.schema[c].dataType)]
    # A sort deals by ranges, so numbers that ascend with the partition and within it follow the order.
    return written(slim.orderBy(*order).withColumn("_key", F.monotonically_increasing_id()))


def carried(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """keyed() rows (_id, _key, text, _doc): _doc holds all other columns, whatever their names."""
    from pyspark.sql import functions as F

    others = F.struct(*[docs[c] for c in docs.columns if c != "text"]) if len(docs.columns) > 1 else F.struct(F.lit(1).alias("_none"))
    return keyed(docs.select(docs[id_col].alias("_given"), docs["text"].alias("text"), others.alias("_doc")), "_given", ("text", "_doc"))


def restored(rows: DataFrame, columns: list[str], changed=None, text="text") -> DataFrame:
    """The documents' columns from carried() rows; where changed holds, text is new and n_chars follows it."""
    from pyspark.sql import functions as F

    def column(c: str):
        if c == "text":
            return F.when(changed, F.col(text)).otherwise(F.col("text")).alias("text") if changed is not None else F.col("text")
        own = F.col("_doc").getField(c)
        if c == "n_chars" and changed is not None:
            return F.when(changed, F.length(text).cast(rows.schema["_doc"].dataType[c].dataType)).otherwise(own).alias(c)
        return own.alias(c)

    return rows.select(*[column(c) for c in columns])


@contextmanager
def batch_rows(spark: SparkSession, rows: int = 1000):
    """Arrow batches of so many rows at most for the jobs inside; the session's own setting holds again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
