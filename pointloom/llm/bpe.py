"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens that accepts exactly the sequences that
byte-pair merging gives. It starts as one state with an arc back to itself for every base symbol. Each merge (a, b) is a
gadget: the state that a leads to is forked into a copy that lacks the arc b, a then leads to the copy, and every state
that had the arc a gets an arc for the new token ab, which leads to where b led. Copies are kept as differences (the arc
that was cut, and when), so the whole automaton takes one entry for each merge: it is not written out as a full table of
states and arcs. Whether a state has an arc is found from the differences when the pair is first met, and kept. A word is
encoded by these transitions (state, arc): a state is the last token, one path spells the word, and it is found by taking
the longest arc first and taking arcs back at dead places. Decoding emits the arcs' labels.

Cases: a null or empty text has no tokens; special tokens' strings inside a text are those tokens; very long texts are
worked on whole, batch by batch; repeated rows are encoded each; an empty table gives an empty result; columns other
than those asked for are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._vocab import Memo, read_file, shared
from ._words import chunks

_NEVER = 1 << 60
_LATIN_END = "\u0250"
_LATIN_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Byte to shown character of the byte-level alphabet: printable bytes are themselves, others follow from U+0100.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0Da-z0-9]+")


class MergeAutomaton:
    """The automaton of a list of merges (left, right, merged) over token numbers."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.cut: dict[int, dict[int, int]] = {}
        self.parent: dict[int, int] = {}
        self.arc: dict[int, int] = {}
        self.born: dict[int, int] = {}
        #: Tokens whose merge can't happen, since earlier merges leave no such pair.
        self.dead: set[int] = set()
        for time, (a, b, ab) in enumerate(merges):
            self._gadget(a, b, ab, time)
        self.table = Memo(self._transition, 200_000)

    def _gadget(self, a: int, b: int, ab: int, time: int) -> None:
        if ab in self.born or ab in self.dead:
            raise ValueError("two merges give the same token")
        if a in self.dead or b in self.dead or not self._has(a, b, time - 1):
            self.dead.add(ab)
            return
        self.cut.setdefault(a, {}).setdefault(b, time)
        self.parent[ab], self.arc[ab], self.born[ab] = b, a, time

    def _has(self, state: int, token: int, time: int) -> bool:
        """Whether the state that `state` leads to has the arc `token` after the merges up to time."""
        while True:
            node, limit = state, time
            while True:
                t = self.cut.get(node, {}).get(token, _NEVER)
                if t <= limit:
                    return False
                if node not in self.parent:
                    break
                limit = min(limit, self.born[node] - 1)
                node = self.parent[node]
            if token not in self.arc:
                return True
            time = min(time, self.born[token])
            token = self.arc[token]

    def _transition(self, pair: int) -> bool:
        return self._has(pair >> 32, pair & 0xFFFFFFFF, _NEVER - 1)

    def encode(self, word: str, final: str, vocab: dict[str, int], longest: int) -> list[int]:
        """Token numbers of a word; final marks its end.

        From each place the longest arc that the automaton allows is taken; where no arc leads on, the place is dead and
        the arc before it is taken back. One path is accepted, and no place is left twice, so the work is bounded.
        """
        n, table = len(word), self.table
        tokens: list[int] = []
        begins: list[int] = []
        dead: set[int] = set()
        pos, end = 0, min(n, longest)
        while pos < n:
            token = None
            while end > pos:
                token = vocab.get(word[pos:end] if end < n else word[pos:] + final)
                if token is not None and end not in dead and (not tokens or table[tokens[-1] << 32 | token]):
                    break
                token = None
                end -= 1
            if token is not None:
                tokens.append(token)
                begins.append(pos)
                pos, end = end, min(n, end + longest)
            else:
                dead.add(pos)
                if not tokens:
                    raise ValueError(f"a symbol of {word!r} isn't in the vocabulary")
                tokens.pop()
                pos, end = begins.pop(), pos - 1
        return tokens


class WordBpe:
    """Encoder and decoder of a `tokenizers` file of the word kind (BPE with a mark at word ends)."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.final: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs])
        # What no merge gives is never a token of a text.
        alive = self.automaton.born.keys() - self.automaton.dead
        self.vocab = {s: i for s, i in self.vocab.items() if i in alive or len(s.removesuffix(self.final) or s) == 1}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: s for s, i in (model["vocab"] | self.special).items()}
        self.longest = max(map(len, self.vocab))
        self.has_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_str(data.decode())
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.words = Memo(lambda w: array("i", self.automaton.encode(w, self.final, self.vocab, self.longest)).tobytes(), 150_000)
        self.pieces = Memo(self._chunk, 250_000)

    def _chunk(self, data: bytes) -> bytes:
        """Token numbers (32-bit, native) of a piece of text without ASCII white space."""
        chunk = data.decode()
        if self.has_special and "<|" in chunk:
            parts = self.has_special.split(chunk)
            if len(parts) > 1:
                return b"".join(array("i", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in parts)
        return self._plain(chunk)

    def _plain(self, chunk: str) -> bytes:
        words = self.words
        if chunk.isascii():
            if chunk.isprintable():
                return b"".join([words[w] for w in _ASCII_WORDS.findall(chunk.lower())])
        elif max(chunk) < _LATIN_END:  # no such character composes with another
            return b"".join([words[w.encode().decode("latin-1").translate(_SHOWN)] for w in _LATIN_WORDS.findall(chunk.lower())])
        return b"".join([words[w] for w, _ in self.split(self.normal(chunk))])

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, text.encode().split())) if text else b"", np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.labels.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, ids array<int>, decoded string): every text encoded, and its tokens decoded again."""
    data = docs.sparkSession.sparkContext.broadcast(read_file(path))  # a vocabulary file, of fixed size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared("word_bpe", data.value, WordBpe)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts, 2 << 20):
                ids = [coder.encode(t) for t in texts[a:b]]
                decoded = [coder.decode(x) for x in ids]
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), lists, pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>, decoded string")
