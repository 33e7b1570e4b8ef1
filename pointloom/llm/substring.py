"""Substring deduplication by seed and extend: documents meet on winnowed anchors, matches are extended word by word.

Seeds: of every `window` consecutive words, the k-word gram with the least hash (the leftmost of equals) is the window's
anchor, so equal windows have equal anchors at equal places. Anchors are counted over the corpus; only those that occur
twice go on, each with the words of the windows that it is the anchor of.

Extension: an anchor's occurrences are joined with its first one (least document, then least place), never in pairs, and
the match is extended left and right while words agree. Windows inside the match occur earlier. An occurrence's other
windows can equal only windows that stayed open likewise: there the window itself is the seed, joined with the first of
its kind. Covered windows that run together are the maximal repeats over the length threshold; their words are removed.

Both joins are combined within each batch first (occurrences that the batch's own first one settles are not dealt), and
their other side is a written table of one row a seed, so that a hot seed can be split. Whole copies are known by their
fingerprint and take no part beyond it.

Anchors only propose: words decide across batches, 64-bit word hashes compared place by place within one. Open windows are
told apart by 128-bit hashes, whole copies by 64-bit ones. Cases: a null or empty text has no words; a text of any length
is worked on whole; null and repeated ids are rows of their own (see keyed()); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bitmap import bitmap, member
from ._io import carried, keyed, process_cache, restored, written
from ._words import LONG_WORD, WordHasher, chunks, grams, mix, small


@dataclass(frozen=True)
class SubstringConfig:
    """window: words of a repeat at least; gram: words of an anchor; bits: log2 of the anchor bitmap's size at most (256 MB;
    it follows the anchors' number up to there); copies: entries of the table of whole copies at most (the largest groups), beyond which copies go the common way."""

    window: int = 20
    gram: int = 10
    bits: int = 31
    copies: int = 1 << 16


def _hasher() -> WordHasher:
    return process_cache("words", WordHasher)


def _fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each text's word sequence."""
    place = np.arange(len(hashes), dtype=np.int64) - np.repeat(bounds[:-1], np.diff(bounds))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + mix(place.astype(np.uint64))))))
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


#: (fingerprint, first key) of the largest groups of whole copies, sorted: plain arrays, as broadcasts need.
Copies = tuple[np.ndarray, np.ndarray]


def copies_of(rows: list[tuple[int, int]]) -> Copies:
    rows = sorted(rows)
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def later_copies(copies: Copies, prints: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which documents have a whole copy with a smaller key."""
    known, first = copies
    prints = prints.view(np.int64)
    if not len(known):
        return np.zeros(len(prints), bool)
    at = np.minimum(np.searchsorted(known, prints), len(known) - 1)
    return (known[at] == prints) & (first[at] < keys)


def copy_table(docs: DataFrame, cfg: SubstringConfig) -> Copies:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in small(batches):
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                hashes, bounds = hasher.texts(texts[a:b])
                long = np.diff(bounds) >= cfg.window
                prints = _fingerprints(hashes, bounds)[long].view(np.int64)
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a).filter(pa.array(long)), pa.array(prints)], ["_key", "print"])

    prints = docs.select("_key", "text").mapInArrow(run, "_key long, print long")
    groups = prints.groupBy("print").agg(F.min("_key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return copies_of([(r["print"], r["first"]) for r in groups.orderBy(F.desc("n"), "print").limit(cfg.copies).collect()])


def _anchors(hashes: np.ndarray, bounds: np.ndarray, cfg: SubstringConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, the places of their anchors, and the hash of the gram at each place."""
    codes = grams(hashes, cfg.gram)
    n = len(hashes) - cfg.window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), codes
    best, place = codes[:n].copy(), np.arange(n)
    for j in range(1, cfg.window - cfg.gram + 1):
        better = codes[j : j + n] < best
        best[better] = codes[j : j + n][better]
        place[better] = np.flatnonzero(better) + j
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(text[:n] == text[cfg.window - 1 :])
    return inside, place[inside], codes


@dataclass
class _Part:
    """The documents of a part of a batch: keys, the words of all in a row (bytes and hashes), and each one's bounds."""

    keys: np.ndarray
    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def words(self, first: int, last: int) -> bytes:
        """Words first to last, joined by single spaces; a very long one as its digest behind a tab, which no word holds."""
        text = self.data[self.starts[first] : self.ends[last]]
        parts = text.split()
        if len(text) > LONG_WORD:
            parts = [w if len(w) <= LONG_WORD else b"\t" + xxhash.xxh3_128_hexdigest(w).encode() for w in parts]
        return b" ".join(parts)


def _part(texts: list, keys: np.ndarray, cfg: SubstringConfig, copies: Copies) -> _Part:
    """The texts of a window's words at least that aren't known copies; the others are there without words."""
    parts = [b"" if t is None else t.encode() for t in texts]
    data = b"\n".join(parts)
    starts, ends, hashes = _hasher()(data)
    begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    bounds = np.searchsorted(starts, begins, "left")
    sizes = np.diff(bounds)
    keep = (sizes >= cfg.window) & ~later_copies(copies, _fingerprints(hashes, bounds), keys)
    own = np.repeat(keep, sizes)
    return _Part(keys, data, starts[own], ends[own], hashes[own], np.concatenate(([0], np.cumsum(np.where(keep, sizes, 0)))))


def _agreeing(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, step: int, most: np.ndarray) -> np.ndarray:
    """How many words in a row are equal from places a and b on, in the direction of step, most at most."""
    out, going = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for j in range(int(most.max()) if len(most) else 0):
        x, y = np.where(going & (j < most), a + j * step, 0), np.where(going & (j < most), b + j * step, 0)
        going &= (j < most) & (hashes[x] == hashes[y])
        out += going
    return out


def _settled(part: _Part, place: np.ndarray, first: np.ndarray, n: np.ndarray, pivot: np.ndarray, cfg: SubstringConfig) -> np.ndarray:
    """Which occurrences (anchor's place, first window, number of windows) lie wholly in the match with their pivot.

    A match that is extended from the anchor holds all of an occurrence's windows if it holds the words from the first
    window's start to the last one's end, and the pivot has windows there.
    """
    ahead, behind = place - first, first + n - 1 + cfg.window - place
    room = (ahead <= ahead[pivot]) & (behind <= behind[pivot])
    left = _agreeing(part.hashes, place - 1, place[pivot] - 1, -1, np.where(room, ahead, 0))
    right = _agreeing(part.hashes, place, place[pivot], 1, np.where(room, behind, 0))
    return room & (left == ahead) & (right == behind) & (pivot != np.arange(len(place)))


def matched(words: list[bytes], ahead: int, pivot: list[bytes], pivot_ahead: int, cfg: SubstringConfig) -> tuple[int, int]:
    """(first, end): the windows of words (counted from their start) inside the match with pivot.

    The anchors stand at ahead and pivot_ahead; the match is extended from there both ways. Windows hold the anchor.
    """
    if words[ahead : ahead + cfg.gram] != pivot[pivot_ahead : pivot_ahead + cfg.gram]:
        return 0, 0  # different grams of one hash
    left = 0
    while left < min(ahead, pivot_ahead) and words[ahead - 1 - left] == pivot[pivot_ahead - 1 - left]:
        left += 1
    right = cfg.gram
    while right < min(len(words) - ahead, len(pivot) - pivot_ahead) and words[ahead + right] == pivot[pivot_ahead + right]:
        right += 1
    first = ahead - left
    return first, max(first, ahead + right - cfg.window + 1)


def covered_windows(docs: DataFrame, cfg: SubstringConfig, copies: Copies) -> DataFrame:
    """Rows (_key, start, run): windows start, start+1, ... start+run-1 of the document occur earlier."""
    shared = docs.sparkSession.sparkContext.broadcast(copies)  # cfg.copies entries at most

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[_Part]:
        for batch in small(batches):
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                yield _part(texts[a:b], keys[a:b], cfg, shared.value)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in fresh(batches):
            _, places, codes = _anchors(part.hashes, part.bounds, cfg)
            found, n = np.unique(codes[np.unique(places)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int32))], ["anchor", "n"])

    seeds = docs.select("_key", "text").mapInArrow(seed, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    seeds = written(seeds.select("anchor"))
    known = docs.sparkSession.sparkContext.broadcast(bitmap(seeds, "anchor", cfg.bits))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in fresh(batches):
            starts, places, codes = _anchors(part.hashes, part.bounds, cfg)
            place, at, n = np.unique(places, return_index=True, return_counts=True)  # an anchor's windows are consecutive
            seen = member(known.value, codes[place])
            place, first, n = place[seen], starts[at[seen]], n[seen]
            row = np.searchsorted(part.bounds, first, "right") - 1
            code = codes[place]
            order = np.lexsort((place, part.keys[row], code))
            head = np.concatenate(([True], code[order][1:] != code[order][:-1])) if len(order) else np.zeros(0, bool)
            pivot = np.zeros(len(order), np.int64)
            pivot[order] = order[head][np.cumsum(head) - 1] if len(order) else order
            done = _settled(part, place, first, n, pivot, cfg)
            # What this batch settles needs no words; consecutive windows go on as one run.
            r, s, length = row[done], first[done], n[done]
            fresh_run = np.concatenate(([True], (r[1:] != r[:-1]) | (s[1:] != s[:-1] + length[:-1]))) if len(r) else np.zeros(0, bool)
            runs = np.add.reduceat(length, np.flatnonzero(fresh_run)) if len(r) else length
            r, s, go = r[fresh_run], s[fresh_run], np.flatnonzero(~done)
            words = [part.words(int(f), int(f + k) + cfg.window - 2) for f, k in zip(first[go], n[go], strict=True)]
            out = [
                pa.array(np.concatenate((code[go].view(np.int64), np.zeros(len(r), np.int64)))),
                pa.array(np.concatenate((part.keys[row[go]], part.keys[r]))),
                pa.array(np.concatenate((first[go] - part.bounds[row[go]], s - part.bounds[r])).astype(np.int32)),
                pa.array(np.concatenate((np.zeros(len(go), np.int64), runs)).astype(np.int32)),
                pa.array(np.concatenate((place[go] - first[go], np.zeros(len(r), np.int64))).astype(np.int32)),
                pa.array(words + [None] * len(r), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(out, ["anchor", "_key", "start", "run", "ahead", "words"])

    rows = written(docs.select("_key", "text").mapInArrow(occurrences, "anchor long, _key long, start int, run int, ahead int, words binary"))
    open_ones = rows.where("run = 0").drop("run")
    # An anchor's first occurrence combines before it is dealt, and stands as a plain table: the join can be split at an
    # anchor that very many batches hold. Of one document the first place is meant, so the anchor's place counts.
    where = F.struct("_key", (F.col("start") + F.col("ahead")).alias("place"))
    pivots = open_ones.groupBy("anchor").agg(F.min(F.struct(where.alias("at"), "ahead", "words")).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pivots = written(pivots.select("anchor", F.col("p.at._key").alias("_k"), (F.col("p.at.place") - F.col("p.ahead")).alias("_s"), F.col("p.ahead").alias("_a"), F.col("p.words").alias("_w")))
    pairs = open_ones.join(pivots, "anchor").where("_key <> _k or start <> _s").select("_key", "start", "ahead", "words", "_a", "_w")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            content, keys, at, run = [], [], [], []
            for key, start, ahead, text, pivot_ahead, pivot_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split(b" ")
                n = len(words) - cfg.window + 1
                if text == pivot_text and ahead == pivot_ahead:
                    low, high = 0, n
                else:
                    low, high = matched(words, ahead, pivot_text.split(b" "), pivot_ahead, cfg)
                if high > low:
                    content.append(None)
                    keys.append(key)
                    at.append(start + low)
                    run.append(high - low)
                for i in range(n):
                    if not low <= i < high:
                        content.append(xxhash.xxh3_128_digest(b" ".join(words[i : i + cfg.window])))
                        keys.append(key)
                        at.append(start + i)
                        run.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(content, pa.binary()), pa.array(keys, pa.int64()), pa.array(at, pa.int32()), pa.array(run, pa.int32())], ["content", "_key", "start", "run"])

    matches = written(pairs.mapInArrow(extend, "content binary, _key long, start int, run int"))
    left = matches.where("run = 0")
    kinds = left.groupBy("content").agg(F.min(F.struct("_key", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    kinds = written(kinds.select("content", F.col("first._key").alias("_k"), F.col("first.start").alias("_s")))
    later = left.join(kinds, "content").where("_key <> _k or start <> _s").select("_key", "start", F.lit(1).alias("run"))
    spans = rows.where("run > 0").unionByName(matches.where("run > 0"), allowMissingColumns=True).select("_key", "start", "run")
    return spans.unionByName(later)


def substring_dedup(docs: DataFrame, cfg: SubstringConfig = SubstringConfig(), id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): the kept words of every row of docs, joined by single spaces."""
    return _deduplicated(keyed(docs, id_col), cfg).select(F.col("_id").alias("doc_id"), "n_words", "n_removed", "kept")


def _deduplicated(own: DataFrame, cfg: SubstringConfig) -> DataFrame:
    """Keyed rows with n_words, n_removed and kept in place of their keys."""
    copies = copy_table(own, cfg)
    shared = own.sparkSession.sparkContext.broadcast(copies)
    spans = covered_windows(own, cfg, copies).groupBy("_key").agg(F.collect_list(F.struct("start", "run")).alias("spans"))
    carry = [c for c in own.columns if c != "_key"]
    joined = own.join(spans.withColumnRenamed("_key", "_k"), F.col("_key") == F.col("_k"), "left").select("_key", "text", F.col("spans.start").alias("starts"), F.col("spans.run").alias("runs"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    schema = T.StructType([own.schema[c] for c in carry]).add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in small(batches):
            keys, (texts, starts, runs) = batch.column(0).to_numpy(), (batch.column(i).to_pylist() for i in (1, 2, 3))
            for a, b in chunks(texts):
                hashes, bounds = hasher.texts(texts[a:b])
                whole = later_copies(shared.value, _fingerprints(hashes, bounds), keys[a:b]) & (np.diff(bounds) >= cfg.window)
                n_words, n_removed, kept = [], [], []
                for i in range(a, b):
                    words = texts[i].encode().split() if texts[i] else []
                    n_words.append(len(words))
                    if whole[i - a]:
                        n_removed.append(len(words))
                        kept.append("")
                        continue
                    if starts[i]:
                        edge = np.zeros(len(words) + 1, np.int64)
                        s, r = np.array(starts[i]), np.array(runs[i])
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + r + cfg.window - 1, -1)
                        free = np.cumsum(edge)[:-1] == 0
                        left = [words[j] for j in np.flatnonzero(free)]
                        n_removed.append(len(words) - len(left))
                        words = left
                    else:
                        n_removed.append(0)
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([*(batch.column(4 + i).slice(a, b - a) for i in range(len(carry))), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], schema.names)

    return joined.mapInArrow(cut, schema)


def deduplicated(docs: DataFrame, cfg: SubstringConfig = SubstringConfig(), id_col: str = "doc_id") -> DataFrame:
    """docs without repeated passages: a text that loses words is its kept words joined by single spaces."""
    return restored(_deduplicated(carried(docs, id_col), cfg), docs.columns, F.col("n_removed") > 0, "kept")
