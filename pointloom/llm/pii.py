"""Personal data by fixed patterns, and information-theoretic sanitisation of what else reveals it.

Emails, IP addresses, card and phone numbers (the protected entities) are found in every whole text. Corpus
co-occurrence then estimates how strongly a term in an entity's documents reveals it. With N documents, a term t and an
entity e in p = n(e) / N of them, q = n(t,e) / n(t) is the entity's share among the term's documents. Only m documents
vouch for q: those with both, where near copies (with one least shingle of five words) count once. The estimate that is
judged is the lower one b = (m q + w p) / (m + w), drawn to p by w documents that speak against the term. A term
discloses an entity if it leaves at most log2(1 / certainty) bits of it open, b >= certainty, and tells at least the share
`threshold` of its information, log2(b / p) >= threshold * log2(1 / p). The first bound is the probability of the entity
given the term and does not loosen as the corpus grows; the second keeps words from being flagged for entities that are
everywhere. At the default weight a term needs three vouching documents.

An entity that is too rare for that has its class to fall back on: the mail domain, the network (three parts of an
address), the card's first six and the phone's first five digits are entities of their own for these estimates. Terms that
disclose an entity or its class are further spans, of kind `term`, at every place in each document that holds it.
sanitised() generalises entities to their kind and removes such terms.

All counts are of whole documents; words that touch a base span are no terms. Entities in exactly the same documents have
the same counts, so they go as one set, told apart by their number of documents and a 64-bit XOR of these documents'
hashes. Terms and sets are not paired by whole documents: a set must hold `certainty` of the term's documents, so it is in
one of any n(t) - ceil(certainty n(t)) + 1 of them, and candidates come from those with the fewest sets. So a directory of
very many entities makes pairs only for terms of which most documents are such directories.

Cases: a null or empty text has no spans; very long texts are searched whole, in time that grows with their length; null
and repeated ids are rows of their own (see keyed()); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bitmap import bitmap, member
from ._io import carried, keyed, process_cache, restored, written
from ._words import WordHasher, chunks, grams, small

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match that begins inside a run of digits would also begin at the run's start, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SPANS = "array<struct<start:int,rank:int,end:int,value:string>>"
_CONTEXT = "array<struct<term:bigint,start:int,end:int>>"
_SHINGLE = 5


@dataclass(frozen=True)
class PiiConfig:
    """prior: documents that speak against a term; certainty, threshold: what a term needs; bits: log2 of the term bitmap's size at most."""

    prior: float = 2.5
    certainty: float = 0.5
    threshold: float = 0.5
    bits: int = 31


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each @ with the run before it, as far as no match has taken it."""
    cursor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            cursor = m.end()
        else:
            cursor = at + 1
        at = text.find("@", max(at + 1, cursor))


def entities(text: str | None) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the base spans, in order."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hasher() -> WordHasher:
    return process_cache("lower_words", lambda: WordHasher(lower=True))


def _terms(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hashes, starts and ends (in characters) of the words that touch no span, and the text's least shingle."""
    data = text.encode()
    starts, ends, hashes = _hasher()(data)
    place = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    starts, ends = place[starts], place[ends]
    free = np.ones(len(starts), bool)
    for s, _, e in spans:
        free[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e, "left")] = False
    least = int(grams(hashes, min(_SHINGLE, len(hashes))).view(np.int64).min())
    return hashes[free].view(np.int64), starts[free], ends[free], least


def found(own: DataFrame, cfg: PiiConfig) -> DataFrame:
    """Rows (_id, _key, base, context, shingle) of keyed documents; the last two are of documents with entities."""
    kind = own.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            base, context, bounds, least = [], [(np.zeros(0, np.int64),) * 3], [0], []
            for text in batch.column(2).to_pylist():
                spans = entities(text)
                base.append([{"start": s, "rank": k, "end": e, "value": text[s:e]} for s, k, e in spans])
                least.append(None)
                if spans:
                    *words, least[-1] = _terms(text, spans)
                    context.append(tuple(words))
                bounds.append(bounds[-1] + (len(context[-1][0]) if spans else 0))
            i32, span = pa.int32(), pa.struct
            term, start, end = (np.concatenate(x) for x in zip(*context, strict=True))
            words = pa.StructArray.from_arrays([pa.array(term), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["term", "start", "end"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(base, pa.list_(span([("start", i32), ("rank", i32), ("end", i32), ("value", pa.string())]))),
                    pa.ListArray.from_arrays(pa.array(bounds, i32), words),
                    pa.array(least, pa.int64()),
                ],
                ["_id", "_key", "base", "context", "shingle"],
            )

    return own.select("_id", "_key", "text").mapInArrow(run, f"_id {kind}, _key long, base {_SPANS}, context {_CONTEXT}, shingle long")


def document_counts(own: DataFrame, terms: DataFrame, cfg: PiiConfig) -> DataFrame:
    """(term, n): documents of the whole corpus that hold the term. terms: a written table; a bitmap of it keeps other words back."""
    known = own.sparkSession.sparkContext.broadcast(bitmap(terms, "term", cfg.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in small(batches):
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                hashes, bounds = hasher.texts(texts[a:b])
                at = np.flatnonzero(member(known.value, hashes))
                pairs = np.unique(np.stack((np.searchsorted(bounds, at, "right").astype(np.uint64), hashes[at])), axis=1)
                term, n = np.unique(pairs[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    counted = own.select("text").mapInArrow(run, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n_term")).join(terms.select("term").distinct(), "term", "left_semi")


def _discloses(n_joint: Column, n_vouching: Column, n_term: Column, n_entity: Column, total: int, cfg: PiiConfig) -> Column:
    p = n_entity / F.lit(float(max(total, 1)))
    b = (n_vouching * n_joint / n_term + cfg.prior * p) / (n_vouching + cfg.prior)
    return (p < 1) & (b >= cfg.certainty) & (F.log2(b / p) >= cfg.threshold * -F.log2(p))


def classes(base: Column) -> Column:
    """The classes of the entities in base spans, as strings that no entity's own name is."""

    def one(x: Column) -> Column:
        digits = F.translate(x["value"], "+ ().-", "")
        name = F.when(x["rank"] == 0, F.lower(F.substring_index(x["value"], "@", -1))).when(x["rank"] == 1, F.substring_index(x["value"], ".", 3))
        return F.concat(x["rank"].cast("string"), F.lit(":"), name.when(x["rank"] == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 5)))

    return F.transform(base, one)


def disclosing(own: DataFrame, staged: DataFrame, cfg: PiiConfig) -> DataFrame:
    """(_key, terms): the terms that reveal an entity of the document, or its class."""
    total, which = own.count(), ["set", "n_entity"]
    holds = staged.where(F.size("base") > 0)
    names = F.concat(F.transform("base", lambda x: F.concat(F.lit("="), x["value"])), classes(F.col("base")))
    held = written(holds.select("_key", F.explode(F.array_distinct(names)).alias("entity")))
    # One document can't vouch for anything, so entities and terms of one are out. Aggregates are written before they are
    # joined, so that Spark can split the rows of a frequent key.
    same = written(held.groupBy("entity").agg(F.bit_xor(F.xxhash64("_key")).alias("set"), F.count(F.lit(1)).alias("n_entity")).where("n_entity > 1"))
    sets = written(held.join(same, "entity").select("_key", *which).distinct())
    by_doc = written(sets.groupBy("_key").agg(F.collect_list(F.struct(*which)).alias("sets"), F.floor(F.log2(F.count(F.lit(1)))).cast("int").alias("size")))
    largest = sets.agg(F.max("n_entity")).first()[0] or 0
    terms = holds.select("_key", "shingle", F.explode(F.array_distinct(F.transform("context", lambda x: x["term"]))).alias("term"))
    met = written(terms.join(by_doc.select("_key", "size"), "_key"))
    # The term's documents by how many sets they have (powers of two), and the power up to which a set that qualifies is met.
    sizes = met.groupBy("term", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.sum("n").alias("n_met"), F.array_sort(F.collect_list(F.struct("size", "n"))).alias("sizes"))
    asked = F.col("n_met") - F.ceil(F.col("n_met") * cfg.certainty) + 1
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("size"))
    step = lambda x, y: F.when(x["n"] >= asked, x).otherwise(F.struct((x["n"] + y["n"]).alias("n"), y["size"].alias("size")))
    light = sizes.where((F.col("n_met") > 1) & (F.col("n_met") * cfg.certainty <= largest)).select("term", "n_met", F.aggregate("sizes", start, step)["size"].alias("upto"))
    few = met.join(written(light), "term").where("size <= upto").select("_key", "term", "n_met").join(by_doc, "_key")
    candidates = few.select("term", "n_met", F.inline(F.filter("sets", lambda x: x["n_entity"] >= F.col("n_met") * cfg.certainty))).distinct()
    pairs = written(met.join(written(candidates), "term").join(sets, ["_key", *which]).select("_key", "shingle", "term", "n_met", *which))
    joint = pairs.groupBy("term", *which).agg(F.count(F.lit(1)).alias("n_joint"), F.count_distinct("shingle").alias("n_vouching"), F.max("n_met").alias("n_met"))
    passes = lambda n: _discloses(F.col("n_joint"), F.col("n_vouching"), F.col(n), F.col("n_entity"), total, cfg)
    joint = written(joint.where(passes("n_met")).drop("n_met"))
    flagged = written(joint.join(document_counts(own, joint, cfg), "term").where(passes("n_term")).select("term", *which))
    return pairs.join(flagged, ["term", *which]).groupBy("_key").agg(F.collect_set("term").alias("terms"))


def find_pii(docs: DataFrame, cfg: PiiConfig = PiiConfig(), id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, _key, base, spans): every row of docs; spans are (start, rank, end) of base spans and terms, in order."""
    return _spans_of(keyed(docs, id_col), cfg)


def _spans_of(own: DataFrame, cfg: PiiConfig) -> DataFrame:
    staged = written(found(own, cfg))
    flagged = disclosing(own, staged, cfg)
    near = staged.where(F.size("base") > 0).select("_key", F.explode("context").alias("x")).select("_key", F.col("x.term").alias("term"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))
    near = near.join(flagged.select("_key", F.explode("terms").alias("term")), ["_key", "term"])
    terms = near.groupBy("_key").agg(F.collect_list(F.struct("start", F.lit(4).alias("rank"), "end")).alias("terms"))
    plain = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
    spans = F.array_sort(F.concat(plain, F.coalesce("terms", F.array().cast("array<struct<start:int,rank:int,end:int>>"))))
    return staged.select("_id", "_key", "base").join(terms, "_key", "left").select(F.col("_id").alias("doc_id"), "_key", "base", spans.alias("spans"))


def sanitised(docs: DataFrame, cfg: PiiConfig = PiiConfig(), id_col: str = "doc_id") -> DataFrame:
    """docs, all its rows and columns, with entities generalised to their kind in brackets and revealing terms removed."""
    own = carried(docs, id_col)
    spans = _spans_of(own.select("_id", "_key", "text"), cfg).where(F.size("spans") > 0).select("_key", "spans")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out, cursor = [], 0
                for s in found:
                    if s["start"] >= cursor:
                        out.append(text[cursor : s["start"]] + ("" if s["rank"] == 4 else f"[{KINDS[s['rank']]}]"))
                    cursor = max(cursor, s["end"])
                texts.append("".join(out) + text[cursor:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_key", "_clean"])

    cleaned = own.select("_key", "text").join(spans, "_key").select("_key", "text", "spans").mapInArrow(clean, "_key long, _clean string")
    return restored(own.join(cleaned, "_key", "left"), docs.columns, F.col("_clean").isNotNull(), "_clean")


def digest(out: DataFrame) -> DataFrame:
    """The query's columns from find_pii()."""
    names = F.array(*[F.lit(k) for k in KINDS])
    label = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(F.array_join(F.transform("base", label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
        F.size(F.filter("spans", lambda s: s["rank"] == 4)).cast("long").alias("n_term"),
    )
