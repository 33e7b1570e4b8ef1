"""Quality rules with cross-document line frequency, in DataFrame operations only.

Every document gets the base counts of its own text. Beside them, each normalised line is hashed and its distinct
documents are counted for each host. A line is boilerplate where that count reaches the limit; boilerplate is removed,
and a document that keeps too little is rejected. quality_rules() counts; accepted() returns the texts without the lines.

Every row is a document, so 200 copies of a page count 200 times and reject themselves. Where another step settles
copies, `collapse_copies` (off by default) counts documents by a fingerprint, the hash of their words in order: copies
(also with other spacing) then count once, and any other difference makes a document of its own.

Cases: a null or empty text has no words, no lines, and fails the base rules; a null host is a host of its own; repeated
rows are documents of their own; an empty table gives an empty result; other columns are ignored. Lines are told apart by
64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import carried, restored, written

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class QualityConfig:
    """Limits. A line is boilerplate on a host if at least min_docs distinct documents there hold it. A document is
    rejected if boilerplate was removed and less than min_left_share of its words is left. collapse_copies: whether
    documents with the same words in the same order count as one."""

    min_words: int = 10
    max_repeat_percent: int = 20
    min_docs: int = 20
    min_left_share: float = 0.34
    collapse_copies: bool = False


def _covered(ranked: Column) -> Column:
    """Words covered by 5-word windows whose code occurs again; ranked: (code w, position i) in order, as a column of
    its own (inside the lambda an expression would be computed anew for each element)."""
    again = lambda x, k: (F.get(ranked, k - 1)["w"] == x["w"]) | (F.get(ranked, k + 1)["w"] == x["w"])
    places = F.array_sort(F.transform(F.filter(ranked, lambda x, k: F.coalesce(again(x, k), F.lit(False))), lambda x: x["i"]))
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )


def base_counts(docs: DataFrame, cfg: QualityConfig, keep: list[str]) -> DataFrame:
    """keep columns, the base counts of each whole text, its lines and its fingerprint."""
    text = F.coalesce(F.col("text"), F.lit(""))
    staged = docs.select(*keep, text.alias("_text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    staged = staged.select(*keep, "_text", "_words", F.xxhash64("_words").alias("_print"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_codes"), lines.alias("_lines"))
    windows = F.when(F.size("_codes") >= 5, F.transform(F.sequence(F.lit(0), F.size("_codes") - 5), lambda i: F.xxhash64(*[F.get("_codes", i + j) for j in range(5)])))
    staged = staged.select(*keep, "_text", "_words", "_print", "_lines", windows.alias("_windows"))
    ranked = F.array_sort(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    staged = staged.select(*keep, "_text", "_words", "_print", "_lines", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), ranked).alias("_ranked"))
    repeated = F.coalesce(_covered(F.col("_ranked")), F.lit(0).cast("long"))
    staged = staged.select(
        *keep,
        "_lines",
        "_print",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
    )
    return staged.withColumn("base_failed", (F.col("n_words") < cfg.min_words) | (100 * F.col("n_repeat_words") > cfg.max_repeat_percent * F.col("n_words")))


def line_code(line: Column) -> Column:
    """The hash of a line's normal form (lower case, single spaces, digits as 0)."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"[\x20\x09-\x0D]+", " "), r"[0-9]+", "0"))


def line_codes(lines: Column) -> Column:
    """For each line: its code and its words."""
    return F.transform(lines, lambda x: F.struct(line_code(x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words")))


def without_lines(text: Column, codes: Column) -> Column:
    """text without the lines of these codes; other lines, also blank ones, stay as they are."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(codes, line_code(x)))), "\n")


def boilerplate(lines: DataFrame, cfg: QualityConfig) -> DataFrame:
    """(host, line) of boilerplate; lines: rows (host, line, print), one for each document and distinct line. Counts
    combine before they are dealt, so a line that all documents hold costs one row a task."""
    if cfg.collapse_copies:
        lines = lines.groupBy("host", "line", "print").agg(F.count(F.lit(1)).alias("n"))
    return lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= cfg.min_docs).select("host", "line")


def quality_rules(docs: DataFrame, cfg: QualityConfig = QualityConfig(), id_col: str = "doc_id", host_col: str = "source") -> DataFrame:
    """One row for each row of docs (id_col, text, host_col): the base counts, base_failed, n_removed_words and kept."""
    return judged(docs, cfg, id_col, host_col).drop("removed")


def judged(docs: DataFrame, cfg: QualityConfig, id_col: str, host_col: str) -> DataFrame:
    """quality_rules() with `removed`: the codes of a document's boilerplate lines, null if it has none."""
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), host.alias("host"), "text")
    # A row number of its own keeps repeated rows apart.
    counts = base_counts(slim, cfg, ["doc_id", "host"]).withColumn("_row", F.monotonically_increasing_id()).withColumn("_lines", line_codes(F.col("_lines")))
    counts = written(counts)
    lines = counts.select("host", F.col("_print").alias("print"), F.explode(F.array_distinct(F.transform("_lines", lambda x: x["line"]))).alias("line"))
    bad = written(boilerplate(lines, cfg))  # a plain table, so that the join below can be split at a line that very many documents hold
    each = counts.select("_row", "host", F.explode("_lines").alias("x")).select("_row", "host", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    found = each.join(bad, ["host", "line"]).groupBy("_row").agg(F.sum("words").alias("n_removed_words"), F.collect_set("line").alias("removed"))
    out = counts.drop("_lines", "_print", "host").join(found, "_row", "left").drop("_row").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & (left < cfg.min_left_share * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def accepted(docs: DataFrame, cfg: QualityConfig = QualityConfig(), id_col: str = "doc_id", host_col: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; text is without its boilerplate lines."""
    own = carried(docs, id_col)
    verdict = judged(own.select("_key", "text", F.col("_doc").getField(host_col).alias("host")), cfg, "_key", "host")
    verdict = verdict.where(~F.col("kept") | F.col("removed").isNotNull()).select(F.col("doc_id").alias("_key"), "kept", "removed")
    left = own.join(verdict, "_key", "left").where(F.coalesce("kept", F.lit(True)))
    left = left.withColumn("_left", F.when(F.col("removed").isNotNull(), without_lines(F.col("text"), F.col("removed"))))
    return restored(left, docs.columns, F.col("removed").isNotNull(), "_left")
