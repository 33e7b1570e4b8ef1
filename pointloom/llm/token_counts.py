"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are emitted.

A text's symbols stand in a doubly linked list; a heap holds the adjacent pairs that the vocabulary can merge. The pair
of the lowest rank (leftmost among equals) is popped again and again, merged, and its new neighbours are pushed. The
count is the initial symbols minus the merges. A character outside the vocabulary counts its UTF-8 bytes, as with byte
fallback. Merging is done on stretches that no merge can leave: those are found from the vocabulary itself.

Cases: a null or empty text has no tokens and no bytes; very long texts are counted whole; repeated rows are counted
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._vocab import Memo, read_file, shared

SPACE = "▁"
_MERGED_TYPES = {1, 4, 5}  # normal, user-defined and unused pieces can result from merges


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        n = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield number, data[at : at + n]
        at += n


def merge_count(symbols: list[str], rank: dict[str, float]) -> int:
    """Merges that byte-pair merging makes on symbols; rank: of each string that a merge may give, lower first."""
    n = len(symbols)
    text, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []
    for i in range(n - 1):
        r = rank.get(text[i] + text[i + 1])
        if r is not None:
            heap.append((r, i, i + 1, len(text[i]) + len(text[i + 1])))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, j, size = heapq.heappop(heap)
        if not text[i] or not text[j] or right[i] != j or len(text[i]) + len(text[j]) != size:
            continue  # one of them has been merged since
        text[i] += text[j]
        text[j] = ""
        merges += 1
        k = right[j]
        right[i] = k
        if k >= 0:
            left[k] = i
            r = rank.get(text[i] + text[k])
            if r is not None:
                heapq.heappush(heap, (r, i, k, len(text[i]) + len(text[k])))
        h = left[i]
        if h >= 0:
            r = rank.get(text[h] + text[i])
            if r is not None:
                heapq.heappush(heap, (r, h, i, len(text[h]) + len(text[i])))
    return merges


class PieceCounter:
    """Token counts of a `sentencepiece` BPE model with identity normalisation, a leading space mark and byte fallback."""

    def __init__(self, data: bytes):
        pieces, norm = [], {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece.get(3, 1)))
            elif number == 3:
                norm = dict(_fields(value))
        if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1):
            raise ValueError("only models with identity normalisation, a dummy prefix and kept spaces are supported")
        if any(t == 4 for _, _, t in pieces) or not any(t == 6 for _, _, t in pieces):
            raise ValueError("only models with byte fallback and without user-defined pieces are supported")
        self.rank = {p: -s for p, s, t in pieces if t in _MERGED_TYPES and len(p) > 1}
        self.single = {p for p, _, t in pieces if t in _MERGED_TYPES and len(p) == 1}
        joined = set("".join(self.rank))
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            self.stretches = re.compile("(?s).+")  # a merge may reach across a space: whole texts
        else:  # a stretch: space marks, then others; characters that no merge takes stand alone
            others = "".join(re.escape(c) for c in sorted(joined - {SPACE}))
            self.stretches = re.compile(f"(?s){SPACE}+[{others}]*|[{others}]+|.")
        self.words = re.compile(" +[^ ]*")
        self.counts = Memo(self._stretch)
        self.chunks = Memo(self._chunk)

    def _stretch(self, s: str) -> int:
        symbols = sum(1 if c in self.single else len(c.encode()) for c in s)
        return symbols - (merge_count(list(s), self.rank) if len(s) > 1 else 0)

    def _chunk(self, chunk: str) -> int:
        counts = self.counts
        return sum([counts[s] for s in self.stretches.findall(chunk.replace(" ", SPACE))])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " ":
            return sum(map(self.chunks.__getitem__, self.words.findall(" " + text)))
        parts = text.split(" ")
        return sum(map(self.chunks.__getitem__, [" " + p for p in parts]))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens) for every row of docs."""
    data = docs.sparkSession.sparkContext.broadcast(read_file(path))  # a vocabulary file, of fixed size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared("piece_counts", data.value, PieceCounter)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_bytes = np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts))
            n_tokens = np.fromiter(map(counter.count, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)], [id_col, "n_bytes", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes long, n_tokens long")
