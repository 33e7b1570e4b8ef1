"""Ranked search, language mixtures and the Merkle manifest against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import language, lexical, merkle

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- ranked search --------------------------------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    """(item, rank, doc, score) over (id, text) pairs; ties to the smaller id."""
    held = [(i, Counter(WORD.findall((t or "").translate(UP)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(WORD.findall((text or "").translate(UP))), []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def words(rng, n, vocabulary=400):
    return " ".join(f"t{int(v)}" for v in np.minimum(rng.zipf(1.3, n), vocabulary))


@pytest.mark.parametrize("cfg", [lexical.SearchConfig(), lexical.SearchConfig(shard=1025, postings=300, block_bytes=2000, merge=2)])
def test_search_is_brute_force(spark, cfg):
    rng = np.random.default_rng(3)
    docs = [(i, words(rng, int(rng.integers(0, 60)))) for i in range(2300)] + [(5000 + i, "t1 t2 t399") for i in range(30)]
    docs += [(6000, None), (6001, ""), (6002, " .,; "), (6003, "É é 中文 ǅ t9 T9"), (6004, words(rng, 20000))]
    items = [(i, words(rng, int(rng.integers(1, 12)))) for i in range(40)] + [(90, None), (91, "unknownterm"), (92, "t399"), (93, "é 中文 t9 t9"), (94, " ")]
    got = lexical.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), cfg)
    assert sorted(tuple(r) for r in got.collect()) == brute_search(docs, items)


def test_search_of_odd_tables(spark, docs, rows, clashing, empty, repeated):
    items = spark.createDataFrame([(1, "Mail two WORDS"), (1, "mail two words"), (None, "licence notice work")], "item_id long, text string")
    plain = sorted(map(str, lexical.ranked_search(docs, items).collect()))
    assert plain == sorted(map(str, lexical.ranked_search(clashing, items.withColumn("rank", F.lit(3))).collect()))
    assert lexical.ranked_search(empty, items).count() == 0 and lexical.ranked_search(docs, items.limit(0)).count() == 0
    want = brute_search([(i, r[1]) for i, r in enumerate(rows)], [(0, "mail two words")])
    got = [r for r in lexical.ranked_search(docs, items).collect() if r["item_id"] == 1]
    assert sorted((r["rank"], r["doc_id"], r["score"]) for r in got) == sorted(2 * [x[1:] for x in want])  # each of the two rows has its ranks
    assert lexical.ranked_search(repeated, items).where("doc_id is null").count() == 1  # the null id whose text has the words


def test_terms_are_cut_between_parts(monkeypatch):
    monkeypatch.setattr(lexical, "PART", 7)
    for text in ("ab cdefghijklmnop q", "abcdefgh", "", "É" * 9 + " x", "a b c d e f g h i j k"):
        data = text.encode()
        assert [t for part in lexical.terms(data) for t in part] == lexical.TERM.findall(data.lower())


def test_maxscore_leaves_postings_out():
    """Common terms aren't read whole once no new document can qualify, and documents that can't are not probed."""
    rng = np.random.default_rng(5)
    n = 20000
    places = np.concatenate((np.arange(n), np.arange(n), rng.choice(n, 40, False), rng.choice(n, 60, False)))
    numbers = np.repeat([0, 1, 2, 3], [n, n, 40, 60])
    order = np.lexsort((numbers, places))
    weights = np.array([lexical.weight(n, d) for d in (n, n, 40, 60)], np.int64)
    lengths = np.full(n, 30)
    shard = lexical.Shard(lengths, places[order], numbers[order], np.ones(len(places), np.int64), weights, n, 30 * n)
    found, scores = shard.search([(0, 1), (1, 1), (2, 1), (3, 1)], 10, 0)
    assert shard.read + shard.probed < 400 < 2 * n
    whole = np.zeros(n, np.int64)
    for i in range(4):
        whole[shard.lists[i][0]] += shard.lists[i][1]
    best = np.lexsort((np.arange(n), -whole))[:10]
    mine = np.lexsort((found, -scores))[:10]
    assert found[mine].tolist() == best.tolist() and scores[mine].tolist() == whole[best].tolist()


# --- languages ------------------------------------------------------------------------------------------------------


def brute_steps(text):
    """(two letters before, letter) for letters and word ends, with the units that they belong to."""
    out, unit, a, b, run = [], -1, "", "", 0
    for c in text.lower() + " ":
        if c.isalpha():
            if run % language.UNIT == 0:
                unit += 1
            out.append((a, b, c, unit))
            a, b, run = b, c, run + 1
        else:
            if run:
                out.append((a, b, "", unit))
            a, b, run = "", "", 0
    return out


def sample(n=240):
    rng = np.random.default_rng(8)
    roots = {"xa": ["bal", "ora", "kit", "mun"], "xb": ["sche", "rth", "ung", "pfo"], "xc": ["été", "çou", "ñal", "ûri"]}

    def text(lang, m):
        return " ".join("".join(rng.choice(roots[lang], int(rng.integers(1, 4)))) for _ in range(m))

    out = []
    for i in range(n):
        lang = ["xa", "xb", "xc"][i % 3]
        out.append((i, text(lang, int(rng.integers(3, 60))), lang))
    mixed = [(1000 + i, text("xa", 60) + "\n" + text("xc", 20), None) for i in range(6)]
    return out, mixed


@pytest.fixture(scope="module")
def taught(spark):
    rows, mixed = sample()
    odd = [(2000, None, "xa"), (2001, "", "xb"), (2002, "12 34 !?", "xc"), (None, "balora kit", None), (None, "balora kit", "xa"), (2003, "x" * 3000, "xa"), (2003, "scherth ung", "xb")]
    return spark.createDataFrame(rows + mixed + odd, "doc_id long, text string, lang string").repartition(3)


def test_counts_are_brute_force(spark, taught):
    cfg = language.LanguageConfig()
    rows = [r for r in taught.collect() if r["text"] is not None and r["lang"] is not None]
    model = language.fit(taught, cfg)
    assert model.names == ["xa", "xb", "xc"]
    met, around = Counter(), Counter()
    for r in rows:
        for a, b, c, _ in brute_steps(r["text"]):
            met[r["lang"], a, b, c] += 1
            around[r["lang"], a, b] += 1
    cells = np.exp(model.cells.astype(np.float64)) - cfg.smooth
    assert round(cells.sum()) == sum(met.values())
    for text in ("balora kit", "ététété schou"):
        units, _ = model.units([text])
        want = {}
        for a, b, c, unit in brute_steps(text):
            for j, lang in enumerate(model.names):
                p = (met[lang, a, b, c] + cfg.smooth) / (around[lang, a, b] + cfg.smooth * cfg.alphabet)
                want[unit, j] = want.get((unit, j), 0) + math.log(p)
        assert np.allclose(units, [[want[u, j] for j in range(3)] for u in range(len(units))], rtol=1e-3, atol=1e-3)


def brute_mixture(units, cfg):
    """Best nested set by penalised likelihood, with plain expectation-maximisation for every text."""
    n, width = units.shape
    cost = cfg.penalty * math.log1p(n)

    def em(allowed):
        p = np.array(allowed, float) / sum(allowed)
        top = units.max(axis=1)
        share = np.exp(units - top[:, None])
        for _ in range(cfg.rounds):
            part = share * p
            p = (part / np.maximum(part.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
            p /= p.sum()
        return p, top.sum() + np.log(np.maximum((share * p).sum(axis=1), 1e-300)).sum()

    rank = np.argsort(np.argsort(-em([1] * width)[0], kind="stable"))
    best, at = units.sum(axis=0).max() - cost, int(units.sum(axis=0).argmax())
    p = np.eye(width)[at]
    for m in range(2, width + 1):
        q, value = em((rank < m).astype(int))
        if value - m * cost > best:
            best, p = value - m * cost, q
    return p


def test_mixtures_are_brute_force(spark, taught):
    model = language.fit(taught)
    texts = [r["text"] for r in taught.collect()]
    for text, got in zip(texts, model.mixtures(texts), strict=True):
        units, _ = model.units([text])
        if not len(units):
            assert got == [] and not any(c.isalpha() for c in text or "")
            continue
        want = brute_mixture(units.astype(np.float64), model.cfg)
        shares = dict(got)
        assert np.allclose([shares.get(n, 0.0) for n in model.names], want, atol=1e-6), text


def test_language_ids(spark, taught, empty):
    out = language.language_ids(taught).collect()
    assert len(out) == taught.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(text.encode()) % 5 == 0) and 0 <= r["score"] <= 1
    assert all(by[i][0]["lang_pred"] == ["xa", "xb", "xc"][i % 3] for i in range(240))
    for i in range(1000, 1006):
        shares = {m["lang"]: m["share"] for m in by[i][0]["mixture"]}
        assert set(shares) == {"xa", "xc"} and abs(shares["xa"] - 0.75) < 0.1 and by[i][0]["lang_pred"] == "xa"
    assert all(by[i][0]["lang_pred"] == "und" and by[i][0]["score"] == 0 for i in (2000, 2001, 2002))
    assert len(by[2003]) == 2 and len(by[None]) == 2
    assert language.language_ids(empty).count() == 0
    unlabelled = taught.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.language_ids(unlabelled).collect()} == {"und"}
    names = taught.withColumns({c: F.lit(1) for c in ("_id", "score", "mixture", "held_out", "cell", "n")})
    assert sorted(map(str, language.language_ids(names).collect())) == sorted(map(str, out))


def test_long_texts_in_parts():
    text = "ab cd\nef " * 50 + "z" * 90
    for limit in (7, 16, 1000):
        cut = [p for _, part in language.pieces([None, "", text, "x"], limit) for p in part]
        assert "".join(cut) == text + "x" and max(map(len, cut)) <= max(limit, 1)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.language_ids(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 100 and right >= 0.98 * n


# --- manifest -------------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, lower=False):
    text = row["text"].translate(UP) if lower and row["text"] is not None else row["text"]
    parts = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified), by the contract."""

    def tree(nodes):
        """Root, and each node's runs' (before, after)."""
        paths, own = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
            for p, at in zip(paths, own, strict=True):
                p.append((runs[at // 8][: at % 8], runs[at // 8][at % 8 + 1 :]))
            own, nodes = [at // 8 for at in own], [h(*r) for r in runs]
        return nodes[0], paths

    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r)))
        trees[lang] = (own, *tree([brute_leaf(r) for r in own]))
    root, high = tree([trees[lang][1] for lang in langs])
    out = []
    for lang, up in zip(langs, high, strict=True):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths, strict=True):
            whole = path + up
            text = "" if r["doc_id"] is None else str(r["doc_id"])
            d = brute_leaf(r, zlib.crc32(text.encode()) % 3 == 0)
            for before, after in whole:
                d = h(*before, d, *after)
            out.append((r["doc_id"], brute_leaf(r), subroot, root, h(*[x for b, a in whole for x in b + a]), d, d == root))
    return sorted(out, key=str)


def given(n, langs=4):
    rng = np.random.default_rng(n + langs)
    out = []
    for i in range(n):
        k = int(rng.integers(0, langs))
        out.append({"doc_id": i, "text": [None, "", f"Some Text {i}", "lower é 中"][i % 4], "lang": None if k == 0 else f"l{k}", "source": None if i % 7 == 0 else "Src", "n_chars": None if i % 5 == 0 else i})
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize(("n", "langs", "cfg"), [(1, 1, merkle.MerkleConfig()), (700, 3, merkle.MerkleConfig()), (75, 2, merkle.MerkleConfig(1, 1000)), (160, 3, merkle.MerkleConfig(1, 4)), (120, 40, merkle.MerkleConfig(1, 4))])
def test_manifest_is_brute_force(spark, n, langs, cfg):
    rows = given(n, langs)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3)
    got = merkle.manifest(df, cfg, merkle.every_third())
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(rows)


def test_manifest_of_odd_tables(spark):
    rows = given(30)
    rows += [rows[2], rows[2], {**rows[2], "text": "other"}, {**rows[3], "doc_id": None}, {**rows[3], "doc_id": None, "text": "B"}, {k: None for k in rows[0]}, {**rows[1], "text": "Long " * 40000}]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA).repartition(2)
    want = brute_manifest(rows)
    assert sorted((tuple(r) for r in merkle.manifest(df, tampered=merkle.every_third()).collect()), key=str) == want
    names = df.withColumns({c: F.lit(5) for c in ("_id", "_lang", "leaf", "digest", "tree", "n", "pos", "root", "changed", "_mid", "_run")})
    assert sorted((tuple(r) for r in merkle.manifest(names, tampered=merkle.every_third()).collect()), key=str) == want
    assert merkle.manifest(df.limit(0)).count() == 0
    assert merkle.manifest(df).where("not verified").count() == 0  # nothing tampered with
