"""Registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, lexical, merkle, ngram_join, packing, pii, quality, secrets, sharding, substring, token_counts, topk
from ._io import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


ORACLES["op1_ngram_jaccard_join"] = r"""with recursive
 d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
 s as (select distinct doc_id, array_to_string(w[i:i+2], ' ') g from d, unnest(case when len(w) >= 3 then range(1, len(w) - 1) when len(w) > 0 then [1] else cast([] as bigint[]) end) t(i)),
 n as (select doc_id, count(*) n from s group by doc_id),
 p as (select a.doc_id a, b.doc_id b, count(*) common from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
 l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 90 * (x.n + y.n - common)),
 r as (select doc_id, doc_id m from documents union select l.b, r.m from r join l on l.a = r.doc_id)
 select r.doc_id, coalesce(max(n.n), 0) n_shingles, min(r.m) component_id from r left join n on n.doc_id = r.doc_id group by r.doc_id"""
ORACLES["op2_exact_top_k"] = """with
 v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) q from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id query_id, b.vec_id, cast(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) as bigint) score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
 k as (select *, row_number() over (partition by query_id order by score desc, vec_id) r from s)
 select query_id, cast(r as integer) as rank, vec_id, score from k where r <= 10"""
ORACLES["op4_substring_dedup"] = r"""with
 d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
 g as (select doc_id, i, array_to_string(w[i:i+19], ' ') g from d, unnest(range(1, len(w) - 18)) t(i)),
 k as (select doc_id, i, row_number() over (partition by g order by doc_id, i) r from g),
 c as (select distinct doc_id, i + j i from k, range(0, 20) t(j) where r > 1),
 e as (select doc_id, i, w[i] word from d, unnest(range(1, len(w) + 1)) t(i)),
 m as (select e.doc_id, count(*) n_words, count(c.i) n_removed, string_agg(case when c.i is null then word end, ' ' order by e.i) kept from e left join c on c.doc_id = e.doc_id and c.i = e.i group by e.doc_id)
 select d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join m using (doc_id)"""

ORACLES["op5_secret_scan"] = r"""with
 d as (select doc_id, source, coalesce(text, '') t from documents),
 h as (select doc_id, source, 0 "rank", 'assign' kind, regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') h, regexp_split_to_array(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') g, regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) v from d
  union all select doc_id, source, 1 "rank", 'access' kind, regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}') h, regexp_split_to_array(t, 'AKIA[A-Z0-9]{16,}') g, regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}') v from d
  union all select doc_id, source, 2 "rank", 'hex' kind, regexp_extract_all(t, '[0-9a-f]{24,}') h, regexp_split_to_array(t, '[0-9a-f]{24,}') g, regexp_extract_all(t, '[0-9a-f]{24,}') v from d
  union all select doc_id, source, 3 "rank", 'owned' kind, regexp_extract_all(t, '[A-Za-z0-9+/_-]{24,}') h, regexp_split_to_array(t, '[A-Za-z0-9+/_-]{24,}') g, regexp_extract_all(t, '[A-Za-z0-9+/_-]{24,}') v from d),
 s as (select doc_id, source, "rank", kind, v[i] val, length(h[i]) n, cast(sum(length(g[i]) + length(h[i])) over (partition by doc_id, "rank" order by i) as bigint) e from h, unnest(range(1, len(h) + 1)) u(i)),
 c as (select doc_id, source, "rank", kind, val, e - n b, e from s where "rank" <> 0 or length(val) >= 6),
 f as (select * from c where "rank" < 3 or (length(regexp_replace(val, '[^0-9]', '', 'g')) >= 4 and length(regexp_replace(val, '[^A-Za-z]', '', 'g')) >= 4 and not exists (select 1 from c x where x.doc_id = c.doc_id and x."rank" < 3 and x.b < c.e and c.b < x.e))),
 o as (select val, count(distinct (coalesce('=' || source, ''), doc_id)) >= 20 and count(distinct coalesce('=' || source, '')) >= 3 example from f group by val),
 j as (select f.*, example, kind || ':' || b || ':' || e label from f join o using (val) where "rank" < 3 or not example),
 a as (select doc_id, count(*) filter ("rank" = 0) n_assign, count(*) filter ("rank" = 1) n_access, count(*) filter ("rank" = 2) n_hex, string_agg(label, ',' order by b, "rank") filter ("rank" < 3) base, string_agg(label, ',' order by b, "rank") spans, count(*) filter (not example) n_live, count(*) filter (example) n_example from j group by doc_id)
 select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example from d left join a using (doc_id)"""
ORACLES["op9_quality_rules"] = r"""with
 d as (select doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from documents),
 g as (select doc_id, i, array_to_string(w[i:i+4], ' ') g from d, unnest(range(1, len(w) - 3)) t(i)),
 r as (select doc_id, i, count(*) over (partition by doc_id, g) c from g),
 c as (select doc_id, count(distinct i + j) n from r, range(0, 5) t(j) where c > 1 group by doc_id),
 x as (select doc_id, source, regexp_replace(regexp_replace(lower(trim(line, ' ')), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g') line, cast(sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) as bigint) words from d, unnest(l) t(line) group by all),
 b as (select source, line from x group by all having count(*) >= 20),
 m as (select x.doc_id, cast(sum(words) as bigint) words from x join b on x.line = b.line and x.source is not distinct from b.source group by x.doc_id),
 o as (select d.doc_id, len(w) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(c.n, 0) n_repeat_words, coalesce(m.words, 0) n_removed_words
  from d left join c on c.doc_id = d.doc_id left join m on m.doc_id = d.doc_id)
 select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed, not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not (n_removed_words > 0 and n_words - n_removed_words < cast(0.34 as double) * n_words) kept from o"""

ORACLES["op11_ranked_search"] = r"""with
 d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
 i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from benchmark),
 c as (select count(*) n, cast(sum(len(w)) as bigint) l from d where len(w) > 0),
 p as (select doc_id, term, count(*) tf from d, unnest(w) t(term) group by all),
 q as (select item_id, term, count(*) times from i, unnest(w) t(term) group by all),
 f as (select term, cast(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) as bigint) weight from p, c where term in (select term from q) group by term, n),
 m as (select doc_id, 100 - 75 + (75 * len(w) * n) // l m from d, c where len(w) > 0),
 s as (select item_id, doc_id, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) score from q join p using (term) join f using (term) join m using (doc_id) group by all),
 r as (select *, row_number() over (partition by item_id order by score desc, doc_id) "rank" from s where score > 0)
 select item_id, cast("rank" as integer) "rank", doc_id, score from r where "rank" <= 10"""


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _merkle_sql() -> str:
    # Levels as one CTE each: eight in a language (8**8 rows), four above.
    part = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    whole = lambda text: " || ".join(map(part, ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)))
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ord(k[i]))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295)"
    ctes = [
        "k as (select *, coalesce(cast(doc_id as varchar), '') k from documents)",
        f"a as (select doc_id, lang, sha256({whole('text')}) leaf, case when {crc} % 3 = 0 then sha256({whole(_LOWERED)}) end changed from k)",
        "g as (select *, dense_rank() over (order by lang nulls first) - 1 tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by lang) n from a)",
        "t0 as (select tree, pos, n, leaf h from g)",
    ]
    levels = 12
    for i in range(1, levels + 1):
        # After the eighth level each language is one node: they become the nodes of one tree.
        below = f"t{i - 1}" if i != 9 else "(select 0 tree, tree pos, count(*) over () n, h from t8)"
        ctes.append(f"s{i} as (select *, pos // 8 run, coalesce(string_agg(h, '' order by pos) over (partition by tree, pos // 8 order by pos rows between unbounded preceding and 1 preceding), '') b, coalesce(string_agg(h, '' order by pos) over (partition by tree, pos // 8 order by pos rows between 1 following and unbounded following), '') e from {below} _)")
        ctes.append(f"t{i} as (select tree, run pos, (n + 7) // 8 n, case when n > 1 then sha256(string_agg(h, '' order by pos)) else max(h) end h from s{i} group by tree, run, n)")
    joins, at, tree, proof, folded = "", "g.pos", "g.tree", "''", "coalesce(g.changed, g.leaf)"
    for i in range(1, levels + 1):
        if i == 9:
            at, tree = "g.tree", "0"
        joins += f" join s{i} on s{i}.tree = {tree} and s{i}.pos = {at} // {8 ** ((i - 1) % 8)}"
        proof += f" || case when s{i}.n > 1 then s{i}.b || s{i}.e else '' end"
    ctes.append(f"j0 as (select g.doc_id, g.leaf, t8.h subroot, t{levels}.h root, sha256({proof}) proof_sha256, {folded} f, " + ", ".join(f"case when s{i}.n > 1 then s{i}.b end b{i}, s{i}.e e{i}" for i in range(1, levels + 1)) + f" from g{joins} join t8 on t8.tree = g.tree, t{levels})")
    for i in range(1, levels + 1):
        ctes.append(f"j{i} as (select * replace (case when b{i} is null then f else sha256(b{i} || f || e{i}) end as f) from j{i - 1})")
    return "with\n " + ",\n ".join(ctes) + f"\n select doc_id, leaf, subroot, root, proof_sha256, f folded_root, f = root verified from j{levels}"


ORACLES["op13_merkle_manifest"] = _merkle_sql()


@_query
def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@_query
def op2_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0)


@_query
def op3_pii(spark, sf_dir):
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


@_query
def op4_substring_dedup(spark, sf_dir):
    out = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op5_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.secret_scan(table(spark, sf_dir, "documents")))


@_query
def op6_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@_query
def op7_bpe_automaton(spark, sf_dir):
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op8_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op9_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"))


@_query
def op10_token_counts(spark, sf_dir):
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@_query
def op11_ranked_search(spark, sf_dir):
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op12_language_id(spark, sf_dir):
    return language.language_ids(table(spark, sf_dir, "documents")).drop("mixture")


@_query
def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=merkle.every_third())
