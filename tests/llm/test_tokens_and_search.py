"""Tokenizers against their libraries, top-k against brute force, and the pipeline."""

import os

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pointloom.llm import bpe, token_counts, topk

ODD = ["", " ", "   a      éb  ", "a<|endoftext|>b <|startoftext|>C<|ENDOFTEXT|>", "aaaaaaaaaaaaaaaaaaaaaa", "abababab", "!!!!!!...----", "é İ ǅ Σς ß", "x\x1cy\x85z 　", "<s>a</s> <0x0A> ▁ ▁▁", "don't I'LL '''s", "3½²", "\t\n\x0b\r"]


def _fuzz(n):
    rng = np.random.default_rng(6)
    letters = list("aabbeetthhnnii's'tré́Σς0123   \n\t\xa0　!?.,-_<|>ß中文日本🙂ǅİ\x1c\x85▁²½")
    return ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(n)]


def test_automaton_is_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    coder = bpe.WordBpe(open(path, "rb").read())
    for text in ODD + _fuzz(1500):
        want = library.encode(text, add_special_tokens=False).ids
        got = coder.encode(text)
        assert got.tolist() == want, text
        assert coder.decode(got) == library.decode(want, skip_special_tokens=False)


def test_automaton_of_few_merges():
    """Against plain byte-pair merging, over all short words."""
    from itertools import product

    names = ["a", "b", "a</w>", "b</w>"]
    merges = [("a", "a"), ("b", "a</w>"), ("aa", "b"), ("a", "aa"), ("b", "aa"), ("aab", "a</w>"), ("aa", "aa")]
    for x, y in merges:
        names.append(x + y)
    vocab = {n: i for i, n in enumerate(names)}
    automaton = bpe.MergeAutomaton([(vocab[x], vocab[y], vocab[x + y]) for x, y in merges])
    assert automaton.dead == {vocab["aaa"], vocab["aaba</w>"]}
    alive = {n: i for n, i in vocab.items() if i not in automaton.dead}

    def merged(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        while True:
            best = min(((merges.index((p, q)), i) for i, (p, q) in enumerate(zip(parts, parts[1:], strict=False)) if (p, q) in merges), default=None)
            if best is None:
                return [vocab[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for n in range(1, 9):
        for word in map("".join, product("ab", repeat=n)):
            assert automaton.encode(word, "</w>", alive, 9) == merged(word), word


def test_encode_table(docs, rows, empty, repeated):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = {r["doc_id"]: r for r in bpe.encode(docs, path).collect()}
    for i, t, *_ in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert out[i]["ids"] == want and out[i]["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(empty, path).count() == 0 and bpe.encode(repeated, path).count() == repeated.count()


def test_counts_are_the_library(docs, rows, empty, repeated):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.PieceCounter(open(path, "rb").read())
    for text in ODD + _fuzz(1500):
        assert counter.count(text) == len(library.encode(text)), text
    out = {r["doc_id"]: r for r in token_counts.token_counts(docs, path).collect()}
    for i, t, *_ in rows:
        assert (out[i]["n_tokens"], out[i]["n_bytes"]) == (len(library.encode(t or "")), len((t or "").encode()))
    assert token_counts.token_counts(empty, path).count() == 0 and token_counts.token_counts(repeated, path).count() == repeated.count()


def test_merge_count():
    rank = {"ab": 0, "bc": 1, "abc": 2, "aa": 3}
    assert token_counts.merge_count(list("abc"), rank) == 2
    assert token_counts.merge_count(list("aaaa"), rank) == 2
    assert token_counts.merge_count([], rank) == 0


# --- top-k ----------------------------------------------------------------------------------------------------------


def brute_top(items, k=10):
    rows = [(i, np.floor(1024 * np.array(v, np.float64)).astype(object)) for i, v in items if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in rows), default=0)
    pad = [np.array([*map(int, v), *[0] * (dims - len(v))], object) for _, v in rows]
    out = []
    for a, (i, _) in enumerate(rows):
        if i % 100:
            continue
        scores = sorted((-int(pad[a] @ pad[b]), j) for b, (j, _) in enumerate(rows) if b != a)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [40, 16384])
def test_top_k(spark, block):
    rng = np.random.default_rng(7)
    items = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(301)] + [(1000 + i, [0.5] * 6) for i in range(60)]
    items += [(400, None), (401, [None, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (500, [1.0, 2.0]), (600, [])]
    df = spark.createDataFrame(items, "vec_id long, embedding array<float>").repartition(3)
    cfg = topk.TopkConfig(block=block)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("_id") % 100 == 0, cfg).collect())
    assert got == brute_top(items)


def test_index_prunes_and_proves():
    rng = np.random.default_rng(8)
    values = np.floor(1024 * rng.normal(size=(5000, 32)))
    index = topk.ImpactIndex(values, 32)
    for q in values[:20]:
        places = index.search(q, 11, 0.1)
        best = np.argsort(-(values @ q), kind="stable")[:11]
        assert set(best) <= set(places.tolist()) and len(places) < 2500
    same = topk.ImpactIndex(np.ones((200, 3)), 8)
    assert len(same.search(np.array([1.0, -2.0, 0.0]), 5, 0.1)) == 200


def test_top_k_of_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.col("_id") % 100 == 0).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (None, [2.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>").withColumn("_key", F.lit(1))
    got = [tuple(r) for r in topk.top_k(twice, F.col("_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert len(got) == 6 and [g[2] for g in got if g[1] == 1] == [None, None] and got[0][3] == 2048 * 1024
    huge = spark.createDataFrame([(0, [1e6, 1.0]), (1, [1e5 + 1, 0.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    assert [r["score"] for r in topk.top_k(huge, F.col("_id") % 100 == 0).orderBy("rank").collect()] == [1024**2 * 10**6 * (10**5 + 1), 3 * 1024 * 1024]
    far = spark.createDataFrame([(0, [1e300, 1.0]), (100, [1e15, 1e15]), (1, [9e15, -9e15]), (2, [8e15, 8e15]), (3, [2.0, 1.0]), (4, [-8e15, -8e15])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(far, F.col("_id") % 100 == 0).orderBy("rank").collect()]  # 0 takes no part
    assert got == [(100, 1, 2, 2**63 - 1), (100, 2, 3, 2**63 - 1), (100, 3, 1, 0), (100, 4, 4, -(2**63))]


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline
    from tests.llm.test_text_operators import brute_components, brute_quality, brute_substring

    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "secret scans", "packing"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = now.columns, []
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.written(stage(spark, now, str(tmp_path)))
        seen.append(now)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert now.columns == columns
    texts = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    start = [(i, t) for i, t in sorted((r["doc_id"], r["text"]) for r in docs.collect()) if not brute_quality(t)[-1]]
    assert texts(seen[0]) == start
    firsts = [i for i, _, c in brute_components(start, 5, 80) if i == c]
    assert [i for i, _ in texts(seen[1])] == firsts
    want = {i: (k if removed else t) for (i, _, removed, k), t in zip(brute_substring(texts(seen[1])), [t for _, t in texts(seen[1])], strict=True)}
    assert dict(texts(seen[2])) == want
    assert all("04dbebab" not in t for _, t in texts(seen[3])) and seen[3].count() == seen[2].count()
    assert all(r["n_chars"] == len(r["text"]) for r in seen[3].collect())
    assert seen[4].select("doc_id").distinct().count() == seen[3].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are missing")
def test_registered_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are missing")
def test_registered_digests(spark):
    """The digest columns of the tokenizers' queries against their libraries, over the whole table."""
    import hashlib

    import sentencepiece
    from tokenizers import Tokenizer

    from pointloom.llm.queries import QUERIES

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in texts.items():
        ids = word.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op7_bpe_automaton"](spark, SF).collect()} == want
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (len(t.encode()), n := len(piece.encode(t)), n > 4096) for i, t in texts.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op10_token_counts"](spark, SF).collect()} == want
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = QUERIES["op8_packing"](spark, SF).toPandas()
    assert dict(out.groupby("doc_id").length.sum()) == {i: len(byte.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert {c: str(t) for c, t in out.dtypes.items() if c != "doc_id"} == {c: "int64" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
