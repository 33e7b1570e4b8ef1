"""Languages of a document as a mixture, by expectation-maximisation over the likelihoods of its words.

Each language has a model of letters given the two before them, counted over all labelled training rows and smoothed by
`smooth` counts a context. A word (a run of letters, cut after 16) is the unit of a mixture: its likelihood in each language
is the product of its letters' and of its end's. A document's proportions maximise the likelihood of its words,
sum_w log sum_l p_l P(w | l), by expectation-maximisation. Which languages it has is chosen by the penalised likelihood:
the likelihood less penalty * ln(1 + words) for each language of the set; sets are nested by proportion, largest first.
The log likelihood is concave in the proportions, so its slope at the best single language bounds what any mixture can gain;
documents whose bound doesn't reach the penalty are settled without an iteration, with the same result.

Counts and texts are worked on as arrays of whole batches. The model is bounded: 2**bits cells for (two letters, next letter),
told apart by a hash, a quarter of that for contexts, and `languages` columns at most (the languages with most training
rows, ties by name; rows of others are not learned from). That bound is the broadcast's.

Cases: a null text, one without letters, and any text where nothing was learned are `und`, score 0; the empty text as well;
ties go to the language that is first by its bytes; null ids count as an empty text for the split; rows are judged one by
one, so repeated rows and ids give repeated answers; very long texts are summed up in parts; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import batch_rows, process_cache
from ._words import chunks

UNKNOWN = "und"
UNIT = 16  # letters of a word that are taken as one


@dataclass(frozen=True)
class LanguageConfig:
    bits: int = 17
    smooth: float = 0.05
    alphabet: int = 64
    penalty: float = 2.0
    languages: int = 64
    mixture: int = 6
    rounds: int = 20


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return process_cache("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def _code(*symbols: np.ndarray) -> np.ndarray:
    h = np.zeros(len(symbols[0]), np.uint64)
    for s in symbols:
        h = (h + s.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def steps(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the letters and word ends of all texts in a row: the cell, the context's cell, whether a unit begins, the text's place."""
    parts = [(t or "").lower() for t in texts]
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    symbols = np.frombuffer((" ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[symbols]
    symbols = np.where(letter, symbols, 0)
    before = lambda a, k: np.concatenate((np.zeros(min(k, len(a)), a.dtype), a[: max(len(a) - k, 0)]))
    one, two = before(symbols, 1), before(symbols, 2)
    after = before(letter, 1)
    at = np.flatnonzero(letter | after)  # each letter, and the place after each word
    two = np.where(one > 0, two, 0)
    context = _code(two[at], one[at])
    cells = _code(context, symbols[at])
    starts = letter & ~after
    first = np.maximum.accumulate(np.where(starts, np.arange(len(letter)), 0))
    begins = letter & ((np.arange(len(letter)) - first) % UNIT == 0)
    mask = lambda h, b: (h >> np.uint64(64 - b)).astype(np.int64)
    return mask(cells, bits), mask(context, bits - 2), begins[at], np.repeat(np.arange(len(parts)), sizes)[at]


def pieces(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(places of texts, pieces): all texts in lists of about limit characters; longer texts in parts cut at spaces."""
    cut: list[tuple[int, str]] = []
    for i, t in enumerate(texts):
        at = 0
        while t and at < len(t):
            end = len(t) if at + limit >= len(t) else max(t.rfind(" ", at + 1, at + limit), t.rfind("\n", at + 1, at + limit))
            end = end if end > 0 else at + limit
            cut.append((i, t[at:end]))
            at = end
    for a, b in chunks([t for _, t in cut], limit):
        yield np.array([i for i, _ in cut[a:b]], np.int64), [t for _, t in cut[a:b]]


def counted(rows: DataFrame, names: list[str], cfg: LanguageConfig) -> DataFrame:
    """(cell, n): how often a language met a cell, by cell * languages + language; contexts' cells follow the others.

    rows: (text, lang). A task adds up its own counts first, so it deals no more rows than there are cells.
    """
    place, width = {n: i for i, n in enumerate(names)}, len(names)
    sizes = [(1 << cfg.bits) * width, (1 << cfg.bits - 2) * width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(n, np.int64) for n in sizes]
        for batch in batches:
            langs = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for own, part in pieces(batch.column(0).to_pylist()):
                cells, contexts, _, which = steps(part, cfg.bits)
                column = langs[own[which]]
                for total, met in zip(totals, (cells, contexts), strict=True):
                    total += np.bincount(met * width + column, minlength=len(total))
        total = np.concatenate(totals)
        met = np.flatnonzero(total)
        for a in range(0, len(met), 1 << 16):
            some = met[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    return rows.select("text", "lang").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


class Model:
    """Log likelihoods of cells and contexts by language; mixtures of texts."""

    def __init__(self, names: list[str], cells: np.ndarray, contexts: np.ndarray, cfg: LanguageConfig):
        self.names, self.cells, self.contexts, self.cfg = names, cells, contexts, cfg

    @classmethod
    def of_counts(cls, names: list[str], cells: np.ndarray, contexts: np.ndarray, cfg: LanguageConfig) -> Model:
        return cls(names, np.log(cells + cfg.smooth).astype(np.float32), np.log(contexts + cfg.smooth * cfg.alphabet).astype(np.float32), cfg)

    def units(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each unit in each language, and the place of its text."""
        found, places = [np.zeros((0, len(self.names)), np.float32)], [np.zeros(0, np.int64)]
        for own, part in pieces(texts):
            cells, contexts, begins, which = steps(part, self.cfg.bits)
            at = np.flatnonzero(begins)
            if len(at):
                found.append(np.add.reduceat(self.cells[cells] - self.contexts[contexts], at, axis=0))
                places.append(own[which[at]])
        return np.concatenate(found), np.concatenate(places)

    def mixtures(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        """Languages and proportions of each text, largest first; none for a text without letters."""
        units, places = self.units(texts)
        out: list[list[tuple[str, float]]] = [[] for _ in texts]
        if not len(units):
            return out
        starts = np.flatnonzero(np.diff(places, prepend=-1))
        sizes = np.diff(starts, append=len(places))
        single = np.add.reduceat(units, starts, axis=0, dtype=np.float64)
        best = single.argmax(axis=1)
        row = np.repeat(np.arange(len(starts)), sizes)
        lead = units[np.arange(len(units)), best[row]]
        slope = np.add.reduceat(np.exp(np.minimum(units - lead[:, None], 80.0)), starts, axis=0, dtype=np.float64) - sizes[:, None]
        cost = self.cfg.penalty * np.log1p(sizes)
        mixed = slope.max(axis=1) > cost
        for i in np.flatnonzero(~mixed):
            out[places[starts[i]]] = [(self.names[best[i]], 1.0)]
        if mixed.any():
            take = mixed[row]
            chosen = self.chosen(units[take].astype(np.float64), sizes[mixed], single[mixed], cost[mixed])
            for i, shares in zip(np.flatnonzero(mixed), chosen, strict=True):
                order = np.argsort(-shares, kind="stable")
                out[places[starts[i]]] = [(self.names[j], float(shares[j])) for j in order if shares[j] > 0]
        return out

    def chosen(self, units: np.ndarray, sizes: np.ndarray, single: np.ndarray, cost: np.ndarray) -> np.ndarray:
        """Proportions (texts x languages) of the language sets with the best penalised likelihood."""
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        row = np.repeat(np.arange(len(sizes)), sizes)
        top = units.max(axis=1)
        share = np.exp(units - top[:, None])
        base = np.add.reduceat(top, starts)

        def fitted(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = allowed / allowed.sum(axis=1, keepdims=True)
            for _ in range(self.cfg.rounds):
                part = share * p[row]
                mix = np.maximum(part.sum(axis=1), 1e-300)
                p = np.add.reduceat(part / mix[:, None], starts, axis=0)
                p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
            mix = np.maximum((share * p[row]).sum(axis=1), 1e-300)
            return p, base + np.add.reduceat(np.log(mix), starts)

        width = len(self.names)
        rank = np.argsort(np.argsort(-fitted(np.ones((len(sizes), width)))[0], axis=1, kind="stable"), axis=1)
        p = (np.arange(width) == single.argmax(axis=1)[:, None]).astype(np.float64)
        value = single.max(axis=1) - cost
        for n in range(2, min(self.cfg.mixture, width) + 1):
            q, likelihood = fitted((rank < n).astype(np.float64))
            better = likelihood - n * cost > value
            p[better], value[better] = q[better], (likelihood - n * cost)[better]
        return p


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose decimal id has a CRC-32 that 5 divides; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, cfg: LanguageConfig = LanguageConfig(), lang_col: str = "lang") -> Model:
    """The model of the labelled rows' languages, from all of their texts."""
    rows = docs.select(F.col("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(cfg.languages)
    names = sorted((r["lang"] for r in known.collect()), key=str.encode)
    cells, contexts = (np.zeros((1 << b) * len(names), np.float32) for b in (cfg.bits, cfg.bits - 2))
    if names:
        with batch_rows(docs.sparkSession):
            table = counted(rows.where(F.col("lang").isin(names)), names, cfg).toArrow()  # the model itself, of bounded size
        at, n = table["cell"].to_numpy(), table["n"].to_numpy()
        low = at < len(cells)
        cells[at[low]], contexts[at[~low] - len(cells)] = n[low], n[~low]
    return Model.of_counts(names, cells.reshape(-1, max(len(names), 1)), contexts.reshape(-1, max(len(names), 1)), cfg)


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score, mixture): the language with the largest proportion, that proportion, and all proportions."""
    kind = docs.schema[id_col].dataType.simpleString()
    given, cfg = docs.sparkSession.sparkContext.broadcast((model.names, model.cells, model.contexts)), model.cfg
    shares = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*given.value, cfg)
        for batch in batches:
            texts, found = batch.column(1).to_pylist(), []
            for a, b in chunks(texts, 1 << 20):
                found += model.mixtures(texts[a:b]) if model.names else [[] for _ in range(a, b)]
            first = [m[0] if m else (UNKNOWN, 0.0) for m in found]
            columns = [pa.array([x for x, _ in first], pa.string()), pa.array([min(y, 1.0) for _, y in first], pa.float64()), pa.array([[{"lang": x, "share": y} for x, y in m] for m in found], shares)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_id", "lang_pred", "score", "mixture"])

    found = docs.select(F.col(id_col).alias("_id"), "text").mapInArrow(run, f"_id {kind}, lang_pred string, score double, mixture array<struct<lang string, share double>>")
    return found.withColumnRenamed("_id", id_col)


def language_ids(docs: DataFrame, cfg: LanguageConfig = LanguageConfig(), id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, mixture) of every row; rows that aren't held out teach the model."""
    model = fit(docs.where(~held_out(id_col)), cfg, lang_col)
    out = predicted(docs, model, id_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "mixture")
