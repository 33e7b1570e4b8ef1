"""Operators on documents against brute force on a small corpus, and on odd tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import ngram_join, packing, pii, quality, secrets, sharding, substring
from pointloom.llm._words import WordHasher, grams

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").encode())


def test_word_hashes():
    texts = ["a b", None, "", " \x0b a b  " + "y" * 300 + " y" * 5, "q" * 400_000 + " end " + "r s " * 100_000]
    hashes, bounds = WordHasher().texts(texts)
    seen = {}
    for i, t in enumerate(texts):
        own = words(t)
        assert bounds[i + 1] - bounds[i] == len(own)
        for w, h in zip(own, hashes[bounds[i] : bounds[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(grams(hashes[:2], 3)) == 0


# --- n-gram Jaccard join --------------------------------------------------------------------------------------------


def brute_components(items, size=3, percent=90):
    sets = []
    for _, t in items:
        w = words((t or "").encode().lower().decode() if t is None else "".join(c.lower() if c.isascii() else c for c in t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(items[i][0], len(sets[i]), items[find(i)][0]) for i in range(len(items))]


@pytest.mark.parametrize("cfg", [ngram_join.JoinConfig(), ngram_join.JoinConfig(size=5, percent=80)])
def test_components(docs, rows, cfg):
    got = sorted(tuple(r)[:3] for r in ngram_join.jaccard_components(docs, cfg).collect())
    assert got == sorted(brute_components([(r[0], r[1]) for r in rows], cfg.size, cfg.percent))


def test_components_of_random_families(spark):
    rng = np.random.default_rng(5)
    items = []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(int(rng.integers(30, 200)))]
        for _ in range(int(rng.integers(2, 9))):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 5))):
                w[at] = f"m{rng.integers(1000)}"
            if rng.random() < 0.3:
                w = w[int(rng.integers(0, 8)) :]
            items.append((len(items), " ".join(w)))
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r)[:3] for r in ngram_join.jaccard_components(df).collect())
    assert got == brute_components(items)


def test_components_of_odd_tables(empty, repeated, clashing):
    assert ngram_join.jaccard_components(empty).count() == 0
    out = ngram_join.jaccard_components(repeated).collect()
    assert len(out) == repeated.count()
    assert Counter(r["component_id"] for r in out if r["doc_id"] == 0) == {0: 3}
    kept = ngram_join.deduplicated(clashing)
    assert kept.columns == clashing.columns and kept.where("doc_id in (1, 8)").count() == 0


# --- substring dedup ------------------------------------------------------------------------------------------------


def brute_substring(items, window=20):
    seen, out = set(), []
    for i, t in items:
        w = words(t)
        covered = [False] * len(w)
        for at in range(len(w) - window + 1):
            g = tuple(w[at : at + window])
            if g in seen:
                covered[at : at + window] = [True] * window
            seen.add(g)
        out.append((i, len(w), sum(covered), b" ".join(x for x, c in zip(w, covered, strict=True) if not c).decode()))
    return out


def test_substring(docs, rows):
    got = sorted(tuple(r) for r in substring.substring_dedup(docs).collect())
    assert got == brute_substring([(r[0], r[1]) for r in rows])


def test_substring_of_odd_tables(empty, repeated, clashing):
    assert substring.substring_dedup(empty).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in repeated.collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    got = sorted((str(r[0]), *r[1:]) for r in (tuple(x) for x in substring.substring_dedup(repeated).collect()))
    assert got == sorted((str(r[0]), *r[1:]) for r in brute_substring(order))
    out = substring.deduplicated(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    assert out.where("doc_id = 9").first()["text"].startswith("this work")


def test_substring_variants(spark):
    """Few different words and short windows: an anchor's occurrences stand in many different surroundings."""
    rng = np.random.default_rng(4)
    for seed, cfg in enumerate((substring.SubstringConfig(window=6, gram=3), substring.SubstringConfig(window=5, gram=1, copies=0))):
        stock = [" ".join(f"w{j}" for j in rng.integers(0, 6, 40)) for _ in range(6)]
        items = []
        for i in range(120):
            own = [f"w{j}" for j in rng.integers(0, 9, int(rng.integers(0, 30)))]
            piece = stock[int(rng.integers(0, 6))].split()[int(rng.integers(0, 20)) :]
            items.append((i, " ".join(own + piece + (["long" * 90 + str(i % 2)] + own[:9] if i % 3 else []))))
        table = spark.createDataFrame(items, "doc_id long, text string").repartition(7 + seed)
        got = sorted(tuple(r) for r in substring.substring_dedup(table, cfg).collect())
        assert got == brute_substring(items, cfg.window)


def test_extension():
    """A match is extended both ways while words agree, and no further than both sides have words."""
    cfg = substring.SubstringConfig(window=4, gram=2)
    def windows(a, ahead, b, pivot_ahead):
        low, high = substring.matched(a.encode().split(), ahead, b.encode().split(), pivot_ahead, cfg)
        return list(range(low, high))
    assert windows("a b X Y c d", 2, "a b X Y c d", 2) == [0, 1, 2]
    assert windows("q b X Y c d", 2, "a b X Y c d", 2) == [1, 2]
    assert windows("a b X Y c q", 2, "b X Y c d", 1) == [1]
    assert windows("q b X Y q d", 2, "a b X Y c d", 2) == []
    assert windows("a b X Z c d", 2, "a b X Y c d", 2) == []


# --- personal data --------------------------------------------------------------------------------------------------


def brute_pii(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) < 256 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_pii_base(docs, rows):
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")
    rng = np.random.default_rng(1)
    for _ in range(4000):
        t = "".join(rng.choice(list("ab1.2-_@+ 345("), int(rng.integers(0, 40))))
        assert pii.entities(t) == brute_pii(t)
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(docs)).collect()}
    for i, t, *_ in rows:
        want = brute_pii(t)
        assert got[i]["base_sha256"] == sha(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want))
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[1] == k for x in want) for k in range(4)]
    assert [got[12][f"n_{k}"] for k in pii.KINDS[:4]] == [2, 1, 1, 1]


def test_pii_terms(spark, empty, repeated, clashing):
    items = [(i, f"some text{i} about it{i}, zanzibarite lives{i} at zan@ex{i // 6}.org in{i} town number {i}") for i in range(6)] + [(i, f"plain text {i} about town and it in some way at number") for i in range(6, 60)]
    df = spark.createDataFrame(items, "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_pii(df)).collect()}
    at = items[0][1].index("zanzibarite")
    assert f"term:{at}:{at + 11}" in out[0] and "email:" in out[0] and out[30] == ""
    town = items[0][1].index("town")
    assert f"term:{town}:" not in out[0]  # it is everywhere
    clean = pii.sanitised(df).where("doc_id = 0").first()["text"]
    assert "zanzibarite" not in clean and "[email]" in clean and "zan@" not in clean
    assert pii.find_pii(empty).count() == 0 and pii.find_pii(repeated).count() == repeated.count()
    clean = pii.sanitised(clashing.withColumn("_i", F.lit(1)))
    assert clean.columns == [*clashing.columns, "_i"] and clean.where("doc_id = 12").first()["text"].startswith("mail [email] and [email]")
    again = spark.createDataFrame([(0, "town at +44 (017) 555-7713 number")], "doc_id long, text string")
    twice = df.where("doc_id = 0 or doc_id > 5").unionByName(again).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    texts = [r["text"] for r in pii.sanitised(twice).where("doc_id = 0").collect()]
    assert sorted(texts, key=len)[0] == "town at [phone] number" and len(texts) == 2 and "[email]" in max(texts, key=len) and pii.sanitised(empty).count() == 0


def test_unorderable_columns_and_repeated_ids(spark, repeated):
    """Every operator that carries columns, with a map column, repeated and null ids."""
    odd = repeated.withColumn("m", F.create_map(F.lit("a"), F.lit(1))).withColumn("s", F.struct(F.create_map(F.lit("b"), F.lit(2)).alias("x")))
    for make in (quality.accepted, ngram_join.deduplicated, substring.deduplicated, secrets.redacted, pii.sanitised):
        out = make(odd)
        rows = out.collect()
        assert out.columns == odd.columns and rows and all(r["m"] == {"a": 1} and r["s"]["x"] == {"b": 2} for r in rows)


def test_pii_terms_need_evidence(spark):
    """One document, or copies of one, vouch for nothing; three do; a class vouches for its rare entities."""
    plain = [(i, f"plain text about the usual things of it in a so or lives at by and number {i % 50}") for i in range(100, 2000)]
    items = [(0, "mail bob@example.com zanzibarish typoo filler text")]
    items += [(i, "a copied letter of copywordia that many people hold, from joe@copy.net to all of them") for i in range(1, 8)]
    items += [(10 + i, f"the tripletta of story{i} lives at three@ex.org and place{i * 7} in town{i * 5}") for i in range(3)]
    items += [(20 + i, f"note{i} by quadrupla at four@ey.org of some{i} kind{i}" if i < 3 else f"plain quadrupla and others{i}") for i in range(8)]
    items += [(40 + i, f"story{i * 3} of classica and user{i}@rare.org or thing{i * 11} so on{i}") for i in range(4)]
    table = spark.createDataFrame(items + plain, "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.digest(pii.find_pii(table)).collect()}
    place = lambda i, w: f"term:{dict(items)[i].index(w)}:{dict(items)[i].index(w) + len(w)}"
    assert all(out[i]["n_term"] == 0 for i in (0, *range(1, 8), *range(20, 28), *(i for i, _ in plain)))
    assert all(place(10 + i, "tripletta") in out[10 + i]["spans"] and out[10 + i]["n_term"] == 1 for i in range(3))
    assert all(place(40 + i, "classica") in out[40 + i]["spans"] and out[40 + i]["n_term"] == 1 for i in range(4))  # every user is in one document


def test_pii_rule_is_stable():
    """What a term needs hardly depends on the size of the corpus."""
    cfg = pii.PiiConfig()

    def needs(total):
        for n in range(1, 50):
            p = 3 / total
            b = (3 * min(3, n) / n + cfg.prior * p) / (3 + cfg.prior)
            if b < cfg.certainty:
                return n
        return None

    assert {needs(10**k) for k in (3, 6, 9, 12)} == {4}


def test_pii_directory(spark):
    """A directory of 20,000 addresses, each also in two other documents, doesn't pair them with its 20,000 words."""
    lines = [f"name{i} u{i}@d{i % 7000}.org" for i in range(20000)]
    items = [(0, "\n".join(lines))]
    items += [(1 + k, "\n".join(lines[a : a + 40])) for k, a in enumerate([*range(0, 20000, 40), *range(20, 19980, 40)])]
    table = spark.createDataFrame(items, "doc_id long, text string").repartition(4)
    out = {r["doc_id"]: r["n_term"] for r in pii.digest(pii.find_pii(table)).collect()}
    assert len(out) == len(items) and out[0] > 10000  # a name and its address go together


def brute_terms(items, cfg=pii.PiiConfig()):
    """The term spans of each document, by plain counting of documents."""
    spans = {i: brute_pii(t) for i, t in items}
    terms = {i: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if not any(m.start() < b and m.end() > a for a, _, b in spans[i])] for i, t in items}
    every = {i: {w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)} for i, t in items}
    held = {i: {t[a:b] for a, _, b in spans[i]} for i, t in items}
    flagged = {i: set() for i, _ in items}
    kinds = {i: {f"{k}:" + (t[a:b].split("@")[-1].lower() if k == 0 else t[a:b].rsplit(".", 1)[0] if k == 1 else re.sub("[^0-9]", "", t[a:b])[: 6 if k == 2 else 5]) for a, k, b in spans[i]} for i, t in items}
    held = {i: {"=" + x for x in held[i]} | kinds[i] for i in held}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for i, t in items}
    least = {i: min((" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))), key=lambda g: int(grams(WordHasher(True)(g.encode())[2], min(5, g.count(" ") + 1)).view(np.int64)[0])) for i, w in words.items() if held[i]}
    for e in set().union(*held.values()):
        own = [i for i in held if e in held[i]]
        p = len(own) / len(items)
        for w in {x[2] for i in own for x in terms[i]}:
            both = [i for i in own if any(x[2] == w for x in terms[i])]
            m = len({least[i] for i in both})
            b = (m * len(both) / sum(w in x for x in every.values()) + cfg.prior * p) / (m + cfg.prior)
            if p < 1 and b >= cfg.certainty and np.log2(b / p) >= cfg.threshold * -np.log2(p):
                for i in own:
                    flagged[i].add(w)
    return {i: [(a, b) for a, b, w in terms[i] if w in flagged[i]] for i, _ in items}


def test_pii_terms_of_whole_documents(spark):
    """Terms on other lines, far from the entity and repeated, against brute force."""
    rng = np.random.default_rng(8)
    plain = [(i, " ".join(f"w{x}é" for x in rng.integers(0, 40, 25))) for i in range(100, 500)]
    far = lambda i: " ".join(f"w{k * (i + 3) % 40}é" for k in range(30))
    items = [(i, f"Zanzibarite lives here in house{i}\n{far(i)}\nzan@ex.org\n{far(i)} ZANZIBARITE\tagain zanzibarite") for i in range(4)]
    items += [(10 + i, f"rare{i // 4} person{i}\n{far(i)} u{i % 3}@ex.org {far(i)} rare{i // 4} and 10.0.0.{i % 2} team{i % 3}") for i in range(9)]
    want = brute_terms(items + plain)
    out = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(items + plain, "doc_id long, text string")).collect()}
    assert {i: [(s["start"], s["end"]) for s in x if s["rank"] == 4] for i, x in out.items()} == want
    assert all([t[a:b].lower() for a, b in want[i]].count("zanzibarite") == 3 for i, t in items[:4])
    clean = pii.sanitised(spark.createDataFrame(items + plain, "doc_id long, text string")).where("doc_id = 0").first()["text"]
    assert "zanzibarite" not in clean.lower() and "[email]" in clean


# --- secrets --------------------------------------------------------------------------------------------------------


def brute_secrets(t):
    t, out = t or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_base(spark, docs, rows):
    rng = np.random.default_rng(2)
    parts = ["token", "SECRET", "=", ":", " ", "'", '"', "abc", "0123456789abcdef01234567", "AKIA", "ABCDEFGHIJKLMNOP", "é", "🙂", "\n", "api_key", "x/+_.-="]
    items = [(i, "".join(rng.choice(parts, int(rng.integers(0, 14))))) for i in range(400)] + [(1000 + r[0], r[1]) for r in rows]
    df = spark.createDataFrame([(i, t, "s") for i, t in items], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.secret_scan(df)).collect()}
    for i, t in items:
        want = brute_secrets(t)
        assert got[i]["base_sha256"] == sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)), t
        assert [got[i][k] for k in ("n_assign", "n_access", "n_hex")] == [sum(x[1] == k for x in want) for k in range(3)]
        assert set(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want) <= set(got[i]["spans"].split(",") if got[i]["spans"] else [])


def test_secret_ownership(spark, empty, repeated, clashing):
    copied, own = "Zx91Qw82Er73Ty64Ui55Op46As37", "Bq11Qw22Er33Ty44Ui55Op66As77"
    items = [(i, f"see {copied} here", f"s{i % 4}") for i in range(24)] + [(100, f"use {own} now", "s0")]
    df = spark.createDataFrame(items, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.secret_scan(df)).collect()}
    assert got[0] == "" and got[100] == f"owned:4:{4 + len(own)}"
    assert secrets.secret_scan(empty).count() == 0 and secrets.secret_scan(repeated).count() == repeated.count()
    clean = secrets.redacted(clashing)
    assert clean.columns == clashing.columns
    text = clean.where("doc_id = 13").first()["text"]
    assert "04dbebab" not in text and "AKIA" not in text and "hunter22" not in text and text.count("[secret]") == 3 and "secret:abc" in text


def brute_owned(items, cfg=secrets.SecretConfig()):
    """All spans of rows (id, text, owner), by plain counting of repositories and owners."""
    each = []
    for i, t, o in items:
        base = [(a, k, b, t[a:b]) for a, k, b in brute_secrets(t)]
        base = [(a, k, b, re.search(r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", v)[1] if k == 0 else v) for a, k, b, v in base]
        extra = [(m.start(), 3, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_-]{24,}", t or "")]
        extra = [x for x in extra if len(re.findall("[0-9]", x[3])) >= cfg.min_digits and len(re.findall("[A-Za-z]", x[3])) >= cfg.min_letters and not any(a < x[2] and x[0] < b for a, _, b, _ in base)]
        each.append((i, o, base + extra))
    repos, owners = {}, {}
    for i, o, found in each:
        for x in found:
            repos.setdefault(x[3], set()).add((o, i))
            owners.setdefault(x[3], set()).add(o)
    example = {v for v in repos if len(repos[v]) >= cfg.example_repos and len(owners[v]) >= cfg.example_owners}
    return sorted((i, sorted((a, k, b, v in example) for a, k, b, v in found if k < 3 or v not in example)) for i, o, found in each)


def test_secret_spans_are_brute_force(spark):
    """The method's own spans on random texts that share values over repositories and owners."""
    rng = np.random.default_rng(12)
    values = ["".join(rng.choice(list("abcdefXYZ0123456789"), int(rng.integers(20, 40)))) for _ in range(30)] + ["".join(rng.choice(list("0123456789abcdef"), 26)) for _ in range(20)]
    glue = [" ", "\n", " token=", " secret : '", "'", " é ", "-", "/", " AKIA", " password="]
    text = lambda: "".join(str(rng.choice(values)) + str(rng.choice(glue)) if rng.random() < 0.7 else str(rng.choice(glue)) for _ in range(int(rng.integers(0, 9))))
    items = [(i, text(), [None, "", "a", "b", "c"][int(rng.integers(0, 5))]) for i in range(250)] + [(900, None, "a")]
    cfg = secrets.SecretConfig(example_repos=12, example_owners=3)
    df = spark.createDataFrame(items, "doc_id long, text string, source string").repartition(3)
    got = sorted((r["doc_id"], sorted((s["start"], s["rank"], s["end"], s["example"]) for s in r["spans"])) for r in secrets.secret_scan(df, cfg).collect())
    assert got == brute_owned(items, cfg)
    assert {(x[1], x[3]) for _, xs in got for x in xs} >= {(0, True), (0, False), (2, False), (3, False)}


def test_secrets_of_a_very_long_text(spark):
    """Thousands of hits of each kind in one text: spans are found in time that grows with the text."""
    t = " ".join(f"token=abc{i:06d} x{i:030d}Yyyy deadbeefdeadbeefdead{i:08x}" for i in range(6000))
    df = spark.createDataFrame([(1, t, "s")], "doc_id long, text string, source string")
    r = secrets.digest(secrets.secret_scan(df)).first()
    want = brute_secrets(t)
    assert r["n_assign"] == 6000 and r["n_hex"] == sum(k == 2 for _, k, _ in want) >= 6000 and r["base_sha256"] == sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want))


# --- sharding -------------------------------------------------------------------------------------------------------


def test_sharding(spark, docs, rows, empty, repeated):
    rng = np.random.default_rng(3)
    items = [(i, "x" * int(rng.integers(0, 900))) for i in range(3000)] + [(9000, None), (9001, "é")]
    df = spark.createDataFrame(items, "doc_id long, text string")
    out = sharding.shard(df).toPandas()
    sizes = {i: len((t or "").encode()) + 16 for i, t in items}
    assert dict(zip(out.doc_id, out["size"], strict=True)) == sizes
    assert all(zlib.crc32((dict(items)[i] or "").encode()) == c for i, c in zip(out.doc_id, out.text_crc32, strict=True))
    loads = out.groupby("shard")["size"].sum()
    assert set(loads.index) == set(range(40)) and loads.max() - loads.min() < 0.02 * loads.mean()
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert out.grown_shard.isna().all() and set(out.law) == {"bytes"}
    assert sharding.shard(empty).count() == 0
    twice = sharding.shard(repeated).toPandas()
    assert len(twice) == repeated.count() and all(sorted(o.slot) == list(range(len(o))) for _, o in twice.groupby("shard"))


def test_sharding_of_null_and_repeated_ids(spark):
    """The law holds where one id, or none, is on all rows, and where all rows are alike."""
    rng = np.random.default_rng(5)
    for rows in ([(None, "x" * int(rng.integers(0, 200))) for _ in range(4000)], [(7, "same")] * 3000 + [(i, "y" * (i % 90)) for i in range(3000)], [(None, None)] * 4000):
        out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas()
        loads = out.groupby("shard")["size"].sum()
        assert len(out) == len(rows) and len(loads) == 40 and loads.max() - loads.min() < 0.03 * loads.mean()
        assert all(sorted(own.slot) == list(range(len(own))) for _, own in out.groupby("shard"))
        assert out.virtual_slot.value_counts().max() < 40


def test_stored_map(spark, tmp_path):
    """A kept map is edited from version to version; one more shard takes rows mostly into itself."""
    path = str(tmp_path / "map")
    rng = np.random.default_rng(4)
    items = [(i, "x" * int(rng.integers(0, 900))) for i in range(4000)]
    make = lambda n, shards: sharding.shard(spark.createDataFrame(items[:n], "doc_id long, text string"), sharding.ShardConfig(shards=shards, slots=1024), map_path=path).toPandas()
    first, again, more, wider = make(3000, 8), make(3000, 8), make(4000, 8), make(4000, 9)
    rows = spark.read.parquet(path)
    assert sorted(r[0] for r in rows.groupBy("version").count().collect()) == [1, 2, 3, 4, 5] and rows.count() == 5 * 1024
    place = lambda t: dict(zip(t.doc_id, t.shard, strict=True))
    same = lambda a, b: np.mean([place(b)[i] == s for i, s in place(a).items()])
    assert same(first, again) > 0.99 and same(first, more) > 0.9
    moved = [(a, b) for i, a in place(more).items() if (b := place(wider)[i]) != a]
    assert sum(b == 8 for _, b in moved) > 0.8 * len(moved) and 0.08 < len(moved) / 4000 < 0.16
    for t in (first, more, wider):
        loads = t.groupby("shard")["size"].sum()
        assert loads.max() - loads.min() < 0.01 * loads.mean()
    assert sharding.stored_map(spark, path)[0] == 5 and sharding.stored_map(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        make(100, 3)


def test_operators_of_clashing_columns(clashing, docs):
    """Columns with names that the operators use inside are ignored."""
    import public_tokenizers

    from pointloom.llm import bpe, token_counts

    word, piece, byte = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"))
    for make in (sharding.shard, lambda d: bpe.encode(d, word), lambda d: token_counts.token_counts(d, piece), lambda d: packing.pack_documents(d, byte), quality.quality_rules, lambda d: pii.digest(pii.find_pii(d)), lambda d: secrets.digest(secrets.secret_scan(d))):
        rows = lambda df: sorted(map(str, make(df).collect()))
        assert rows(clashing) == rows(docs)


def test_slot_maps():
    rng = np.random.default_rng(3)
    load = rng.integers(0, 1000, 512).tolist()
    first = [s % 8 for s in range(512)]
    second = sharding.rebalanced(first, load, 8)
    total = np.bincount(second, load, 8)
    assert total.max() - total.min() < 0.002 * total.mean()
    more = sharding.grown(second, load, 8)
    assert all(a == b or b == 8 for a, b in zip(second, more, strict=True))
    total = np.bincount(more, load, 9)
    assert total.max() < 1.1 * total.mean()


# --- quality --------------------------------------------------------------------------------------------------------


def brute_quality(t):
    t = t or ""
    w = [x.decode() for x in words(t)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if words(x)]
    out = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    return (*out, out[0] < 10 or 100 * out[4] > 20 * out[0])


def test_quality_base(spark, docs, rows):
    rng = np.random.default_rng(4)
    items = [(r[0], r[1]) for r in rows] + [(100 + i, "".join(rng.choice(["a ", "b ", "c\n", "d", "#", "\t"], int(rng.integers(0, 80))))) for i in range(150)]
    df = spark.createDataFrame([(i, t, "s") for i, t in items], "doc_id long, text string, source string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in quality.quality_rules(df).collect()}
    for i, t in items:
        assert got[i] == brute_quality(t), t


def test_line_frequency(spark, empty, repeated, clashing):
    line = "subscribe to our letter and read more of it each single day now"
    letters = str.maketrans("0123456789", "klmnopqrst")
    body = lambda i: " ".join(f"{chr(97 + j % 26)}{chr(97 + j // 26)}{str(i).translate(letters)}" for j in range(30))
    items = [(i, f"{body(i)}\n{line}", "h") for i in range(40)] + [(100, f"{line}\nten", "h"), (101, f"{line}\nten", "other")]
    copies = [(200 + i, f"{body('c')}\n{body('d')}", "h") for i in range(60)]
    df = spark.createDataFrame(items + copies, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    assert not any(out[200 + i]["kept"] for i in range(60)) and out[200]["n_removed_words"] == out[200]["n_words"]  # every row is a document
    out = {r["doc_id"]: r for r in quality.quality_rules(df, quality.QualityConfig(collapse_copies=True)).collect()}
    assert out[0]["kept"] and out[0]["n_removed_words"] == 13
    assert not out[100]["kept"] and not out[100]["base_failed"]  # depleted
    assert out[101]["kept"]  # on its host the line is rare
    assert out[200]["kept"] and out[200]["n_removed_words"] == 0  # copies say nothing against their lines
    assert quality.quality_rules(empty).count() == 0 and quality.quality_rules(repeated).count() == repeated.count()
    kept = quality.accepted(clashing)
    assert kept.columns == clashing.columns and kept.where("doc_id in (4, 5, 6, 7, 11)").count() == 0 and kept.where("doc_id in (0, 9, 10)").count() == 3


def test_line_frequency_counts_documents(spark):
    """Several shared lines a page, pages that differ in digits only, and copies that outnumber a line's other holders."""
    letters = str.maketrans("0123456789", "klmnopqrst")
    name = lambda i: str(i).translate(letters)
    shared = [" ".join(f"t{name(k)}x{chr(97 + j)}" for j in range(10)) for k in range(10)]
    footer = "all rights to this page are held by its owners for good"
    pages = [(i, "\n".join([*shared, f"own {name(i)} line", f"and {name(i)} more"]), "many") for i in range(30)]
    mixed = [(100 + i, f"story {name(i)} tells what no other one has told before in so many words\n{footer}", "mixed") for i in range(25)]
    copies = [(200 + i, f"one page that was put up again and again by a machine that ran\n{footer}", "mixed") for i in range(100)]
    filled = [(400 + i, f"entry {i} of the table of entries\nwas seen {i * 7} times by all who looked at it", "filled") for i in range(30)]
    template = [(1000 + i, "three lines that all pages of this host hold\nand nothing else but these\nthey are the whole page", "template") for i in range(200)]
    df = spark.createDataFrame(pages + mixed + copies + filled + template, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    assert not any(out[1000 + i]["kept"] for i in range(200)) and not out[1000]["base_failed"]
    assert {(r["n_removed_words"], r["kept"]) for i, r in out.items() if 100 <= i < 200} == {(len(footer.split()), True)}
    assert not any(out[200 + i]["kept"] for i in range(100))
    assert quality.accepted(df).where("doc_id >= 200").count() == 0
    out = {r["doc_id"]: r for r in quality.quality_rules(df, quality.QualityConfig(collapse_copies=True)).collect()}
    assert out[1000]["kept"]
    assert {(out[i]["n_removed_words"], out[i]["kept"]) for i in range(30)} == {(100, False)}
    assert {(r["n_removed_words"], r["kept"]) for i, r in out.items() if 100 <= i < 400} == {(len(footer.split()), True)}
    assert {(out[i]["n_removed_words"], out[i]["kept"]) for i in range(400, 430)} == {(17, False)}


def brute_line_rule(items, cfg):
    """(n_removed_words, kept) of rows (id, text, host), by plain counting."""
    normal = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower().strip(" ")))
    lines = [Counter() for _ in items]
    for own, (_, t, _) in zip(lines, items, strict=True):
        for x in (t or "").split("\n"):
            if words(x):
                own[normal(x)] += len(words(x))
    held = {}
    for at, (own, (_, t, h)) in enumerate(zip(lines, items, strict=True)):
        for x in own:
            held.setdefault((h, x), set()).add(tuple(words(t)) if cfg.collapse_copies else at)
    out = []
    for own, (_, t, h) in zip(lines, items, strict=True):
        removed, n = sum(k for x, k in own.items() if len(held[h, x]) >= cfg.min_docs), len(words(t))
        out.append((removed, not brute_quality(t)[-1] and not (removed and n - removed < cfg.min_left_share * n)))
    return out


@pytest.mark.parametrize("collapse", [False, True])
def test_line_rule_is_brute_force(spark, collapse):
    """The whole rule on random pages of few lines, with copies, null and empty hosts and repeated rows."""
    rng = np.random.default_rng(11)
    pool = [" ".join(rng.choice([chr(97 + i) + chr(97 + j) for i in range(26) for j in range(26)], int(rng.integers(1, 14)))) for _ in range(60)]
    pool += ["Page 1 of 20", "page  7 of 3", " \t ", "", "Page 9 of 9\t"]
    items = [(i, "\n".join(rng.choice(pool, int(rng.integers(0, 9)))), [None, "", "h1", "h2"][int(rng.integers(0, 4))]) for i in range(400)]
    items += [items[k] for k in rng.integers(0, 400, 120)] + [(900, None, "h1"), (901, None, None)]
    cfg = quality.QualityConfig(min_docs=9, collapse_copies=collapse)
    df = spark.createDataFrame(items, "doc_id long, text string, source string").repartition(3)
    got = sorted((r["doc_id"], r["n_removed_words"], r["kept"]) for r in quality.quality_rules(df, cfg).collect())
    assert got == sorted((i, *x) for (i, _, _), x in zip(items, brute_line_rule(items, cfg), strict=True))
    assert len({x[1:] for x in got}) > 20


def test_boilerplate_lines_go(spark):
    """accepted() against brute force: lines of 20 documents of a host are taken out of the texts it returns."""
    rng = np.random.default_rng(9)
    words_ = lambda n: " ".join(rng.choice([chr(97 + i) + chr(97 + j) for i in range(26) for j in range(26)], n))
    shared = ["Read  more of our page {} today and each day", "terms and privacy of it", " all rights {} reserved\t"]
    items = []
    for i in range(90):
        parts = [words_(12), words_(int(rng.integers(1, 12))), "", " \t"] + [x.format(i) for x in shared if rng.random() < 0.6]
        items.append((i, "\n".join(str(x) for x in rng.permutation(parts)), f"h{i % 2}", 0))
    normal = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower().strip(" ")))
    held = Counter((h, x) for _, t, h, _ in items for x in {normal(x) for x in t.split("\n") if words(x)})
    want = {}
    for i, t, h, _ in items:
        left = "\n".join(x for x in t.split("\n") if not words(x) or held[h, normal(x)] < 20)
        if not brute_quality(t)[-1] and (left == t or len(words(left)) >= 0.34 * len(words(t))):
            want[i] = (left, len(left) if left != t else 0)
    df = spark.createDataFrame(items, "doc_id long, text string, source string, n_chars long").repartition(3)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in quality.accepted(df).collect()} == want
    assert 0 < sum(n > 0 for _, n in want.values())


# --- packing --------------------------------------------------------------------------------------------------------


def test_patterns():
    rng = np.random.default_rng(5)
    histogram = Counter(rng.integers(1, 65, 500).tolist()) | Counter({64: 1000})
    patterns = packing.pack_patterns(histogram, 64)
    placed = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 64
        for length in pattern:
            placed[length] += count
    assert placed == Counter({k: v for k, v in histogram.items() if v})
    used, total = sum(k * v for k, v in histogram.items()), 64 * sum(c for _, c in patterns)
    assert used > 0.97 * total
    assert packing.pack_patterns({}, 64) == []


def test_packing(spark, docs, rows, empty, repeated):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    out = packing.pack_documents(docs, path, with_ids=True).toPandas()
    for i, t, *_ in rows:
        own = out[out.doc_id == i].sort_values("start")
        ids = [x for piece in own.ids for x in piece]
        assert ids == library.encode(t or "", add_special_tokens=False).ids + [0]
        assert list(own.start) == [0, *np.cumsum(own.length)[:-1]] and set(own.doc_tokens) == {len(ids)}
        assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(own.ids, own.ids_crc32, strict=True))
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 1024
    assert packing.pack_documents(empty, path).count() == 0
    twice = packing.pack_documents(repeated, path).toPandas()
    assert twice.groupby("sequence_id").length.sum().max() <= 1024 and len(twice[(twice.doc_id == 0) & (twice.start == 0)]) == 3
