"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Spans of the fixed patterns (assign, access, hex) are found in every whole text. Beside them, long mixed tokens that no
pattern covers are candidates. The hashes of all found values are aggregated over the corpus by distinct repositories
and distinct owners: a value that many repositories of several owners hold is a widely copied example, one that stays
with few owners looks live. Owner-specific candidates become spans of kind `owned`; base spans always stay, and each
value's verdict is counted for its document.

Cases: a null or empty text has no spans; a null owner is an owner of its own; repeated rows are scanned each by itself
but are one repository if their id is the same; an empty table gives an empty result; other columns are ignored. Finding
spans takes time in proportion to a text's length and hits (running sums are made in blocks); redacted() cuts a text once
for each of its spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import carried, restored, written

#: Fixed patterns of the contract. hex and access carry their least length: matches are maximal runs, so a shorter run is dropped either way.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the method.
TOKEN = r"[A-Za-z0-9+/_-]{24,}"

SPAN = "array<struct<start:int,end:int,rank:int,kind:string,value:string>>"


@dataclass(frozen=True)
class SecretConfig:
    """A value is a widely copied example if at least example_repos repositories and example_owners owners hold it."""

    min_value: int = 6
    example_repos: int = 20
    example_owners: int = 3
    min_digits: int = 4
    min_letters: int = 4


#: Entries of a block of running sums: appending to an array copies it, so arrays are built block by block.
RUN = 128


def running(values: Column) -> Column:
    """The running sums of an array of integers; values: a column of its own."""
    blocks = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda b: F.slice(values, b * RUN + 1, F.lit(RUN))))
    nothing = F.array().cast("array<int>")
    add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
    total = lambda block, at: F.aggregate(block, at, lambda acc, x: acc + x)
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))

    def step(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(acc["at"].alias("at"), nothing.alias("out")), add, lambda x: x["out"])
        return F.struct(total(block, acc["at"]).alias("at"), F.concat(acc["out"], F.array(inner)).alias("out"))

    return F.coalesce(F.aggregate(blocks, init, step, lambda acc: F.flatten(acc["out"])), nothing)


def found(docs: DataFrame, cfg: SecretConfig, keep: list[str]) -> DataFrame:
    """keep columns, base: the fixed patterns' spans in order, extra: candidate spans that no base span touches."""
    kinds = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("owned", TOKEN)]
    each = range(len(kinds))
    text = F.coalesce(F.col("text"), F.lit(""))
    staged = docs.select(*keep, text.alias("_t"), *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_h{k}") for k, (_, p) in enumerate(kinds)])
    # The lengths between hits, and the hits' own: a hit ends at the running sum of both.
    both = lambda k, p: F.zip_with(F.slice(F.split("_t", p, -1), F.lit(1), F.size(f"_h{k}")), f"_h{k}", lambda gap, hit: F.length(gap) + F.length(hit))
    staged = staged.select(
        *keep,
        *[f"_h{k}" for k in each],
        *[F.when(F.size(f"_h{k}") > 0, both(k, p)).alias(f"_g{k}") for k, (_, p) in enumerate(kinds)],
        F.when(F.size("_h0") > 0, F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2))).alias("_v"),
    )
    staged = staged.select(*keep, "_v", *[f"_h{k}" for k in each], *[F.when(F.size(f"_h{k}") > 0, running(F.col(f"_g{k}"))).alias(f"_e{k}") for k in each])

    def spans(k: int, name: str) -> Column:
        values = "_v" if k == 0 else f"_h{k}"

        def one(hit: Column, i: Column) -> Column:
            end = F.get(f"_e{k}", i)
            return F.struct((end - F.length(hit)).alias("start"), end.alias("end"), F.lit(k).alias("rank"), F.lit(name).alias("kind"), F.get(values, i).alias("value"))

        # Columns that the lambda reads are used twice, or Spark would compute them anew for each element.
        return F.when(F.size(values) > 0, F.transform(f"_h{k}", one).cast(SPAN)).otherwise(F.array().cast(SPAN)).alias(f"_s{k}")

    staged = staged.select(*keep, *[spans(k, name) for k, (name, _) in enumerate(kinds)])
    base = F.array_sort(F.concat(F.filter("_s0", lambda s: F.length(s["value"]) >= cfg.min_value), F.col("_s1"), F.col("_s2")))
    mixed = lambda s: (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= cfg.min_digits) & (F.length(F.regexp_replace(s["value"], "[^A-Za-z]", "")) >= cfg.min_letters)
    staged = staged.select(*keep, base.alias("base"), F.filter("_s3", mixed).alias("_c"))
    # A candidate is free if as many base spans start before its end as end by its start. Both counts are running sums
    # over points in order, the candidates' (they don't overlap) among the base spans'.
    point = lambda at, tag: F.struct(at.alias("at"), F.lit(tag).alias("tag"))
    tags = lambda points: F.transform(points, lambda x: x["tag"])
    met = F.when((F.size("base") > 0) & (F.size("_c") > 0), F.lit(True))
    staged = staged.select(
        *keep,
        "base",
        "_c",
        F.when(met, tags(F.array_sort(F.concat(F.transform("base", lambda s: point(s["start"], 1)), F.transform("_c", lambda s: point(s["end"], 0)))))).alias("_p0"),
        F.when(met, tags(F.array_sort(F.concat(F.transform("base", lambda s: point(s["end"], 1)), F.transform("_c", lambda s: point(s["start"], 2)))))).alias("_p1"),
    )
    staged = staged.select(*keep, "base", "_c", "_p0", "_p1", *[F.transform(p, lambda t: F.when(t == 1, 1).otherwise(0)).alias(f"_d{p}") for p in ("_p0", "_p1")])
    staged = staged.select(*keep, "base", "_c", "_p0", "_p1", *[running(F.col(f"_d{p}")).alias(f"_r{p}") for p in ("_p0", "_p1")])
    asked = lambda p: F.filter(f"_r{p}", lambda x, i: F.get(p, i) != 1)
    staged = staged.select(*keep, "base", "_c", *[F.when(F.col("_p0").isNotNull(), asked(p)).alias(f"_n{p[-1]}") for p in ("_p0", "_p1")])
    free = F.filter("_c", lambda s, i: F.get("_n0", i) == F.get("_n1", i))
    return staged.select(*keep, "base", F.when(F.col("_n0").isNotNull(), free).otherwise(F.col("_c")).alias("extra"))


def ownership(values: DataFrame, cfg: SecretConfig) -> DataFrame:
    """(hash, n_repos, n_owners, example) of each value; values: rows (hash, repo, owner). Counts combine before they are dealt."""
    pairs = values.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    out = owners.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))
    return out.withColumn("example", (F.col("n_repos") >= cfg.example_repos) & (F.col("n_owners") >= cfg.example_owners))


def secret_scan(docs: DataFrame, cfg: SecretConfig = SecretConfig(), id_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """Rows (doc_id, _row, spans): every row of docs with its spans (start, end, rank, kind, value, n_repos, n_owners, example)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit("")).alias("owner"), "text")
    staged = written(found(slim, cfg, ["doc_id", "owner"]).withColumn("_row", F.monotonically_increasing_id()))
    each = staged.where((F.size("base") > 0) | (F.size("extra") > 0)).select("_row", "doc_id", "owner", F.explode(F.concat("base", "extra")).alias("s")).withColumn("hash", F.sha2(F.col("s.value"), 256))
    # A plain table, so that the join below can be split at a value that very many documents hold.
    known = written(ownership(each.select("hash", "owner", F.col("doc_id").alias("repo")), cfg))
    judged = each.select("_row", "hash", "s").join(known, "hash").where((F.col("s.rank") < 3) | ~F.col("example"))
    full = F.struct("s.start", "s.end", "s.rank", "s.kind", "s.value", "n_repos", "n_owners", "example")
    gathered = judged.groupBy("_row").agg(F.array_sort(F.collect_list(full)).alias("spans"))
    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,value:string,n_repos:bigint,n_owners:bigint,example:boolean>>")
    return staged.select("doc_id", "_row").join(gathered, "_row", "left").withColumn("spans", F.coalesce("spans", none))


def redacted(docs: DataFrame, cfg: SecretConfig = SecretConfig(), mark: str = "[secret]", id_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """docs with every span's text replaced by mark; overlapping spans are one, and rows without spans are unchanged."""
    own = carried(docs, id_col)
    scan = secret_scan(own.select("_key", "text", F.col("_doc").getField(owner_col).alias("owner")), cfg, "_key", "owner")
    joined = own.join(scan.where(F.size("spans") > 0).select(F.col("doc_id").alias("_key"), "spans"), "_key", "left")
    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", init, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return restored(joined.withColumn("_clean", clean), docs.columns, F.col("spans").isNotNull(), "_clean")


def digest(scan: DataFrame) -> DataFrame:
    """The query's columns from secret_scan()."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return scan.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["example"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["example"])).cast("long").alias("n_example"),
    )
