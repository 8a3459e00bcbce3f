"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import collocations, exact_dedup, html_text, langid, lm, mixing, ngram_join, packing, repeats, secrets, topk, variants, warc
from strandmill.llm.common import bound_batches
from strandmill.llm.oracles import COLLOCATIONS_SQL, REPEATS_SQL, VARIANTS_SQL


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_read(spark, sf_dir, "pages"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_read(spark, sf_dir, "documents"), owner="source", repositories=("lang",))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(_read(spark, sf_dir, "documents"), n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_read(spark, sf_dir, "documents"), folds=5)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_read(spark, sf_dir, "documents"), folds=10)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(_read(spark, sf_dir, "pages"), min_bytes=0)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.dealt_counts(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(_read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(_read(spark, sf_dir, "documents"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"), length=200, keep_first=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_top_k, op2_main_text, op3_secrets, op4_ngram_join, op5_language, op6_exact_dedup, op7_packing, op8_lm_score, op9_warc, op10_mixing, op11_variants, op12_collocations, op13_repeats)}


EXACT_DEDUP_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.n) AS text_sha256
FROM t JOIN g ON t.n = g.n
"""

TOP_K_SQL = """
WITH c AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
v AS (SELECT vec_id, i, cast(floor(256 * cast(x AS double)) AS bigint) AS x FROM c),
s AS (SELECT q.vec_id AS query_id, p.vec_id, sum(q.x * p.x) AS score FROM v q JOIN v p ON q.i = p.i AND q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, p.vec_id),
r AS (SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank, vec_id, cast(score AS bigint) AS score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def _secrets_sql() -> str:
    kinds = []
    for k, (kind, pattern, group, least) in enumerate((*secrets.BASE, secrets.WIDE)):
        p = pattern.replace("'", "''")
        kinds.append(f"SELECT doc_id, owner, repo, '{kind}' AS kind, {k} AS k, {least} AS least, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {group})) AS v, unnest(list_slice(string_split_regex(text, '{p}'), 1, len(regexp_extract_all(text, '{p}')))) AS g, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM d WHERE regexp_matches(text, '{p}')")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('s' || source, '-') AS owner, coalesce('s' || source, '-') || '|' || coalesce('l' || lang, '-') AS repo FROM documents),
f AS ({" UNION ALL ".join(kinds)}),
e AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM f),
s AS (SELECT doc_id, owner, repo, kind, k, stop - length(m) AS start, stop, sha256(v) AS hash FROM e WHERE length(v) >= least AND (kind <> 'live' OR (len(list_filter(string_split_regex(v, '[/_-]'), lambda x: length(x) >= {secrets.RUN} AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]'))) > 0 AND round(-list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: (length(v) - length(replace(v, c, ''))) / length(v)::double * log2((length(v) - length(replace(v, c, ''))) / length(v)::double))), 6) >= {secrets.ENTROPY}))),
t AS (SELECT * FROM s WHERE kind <> 'live' OR NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = s.doc_id AND b.kind <> 'live' AND b.start < s.stop AND s.start < b.stop)),
o AS (SELECT hash, count(DISTINCT owner) <= 1 AND count(DISTINCT repo) <= 2 AND count(*) <= 20 AS few FROM t GROUP BY hash),
j AS (SELECT t.*, o.few AS live, t.kind || ':' || cast(cast(t.start AS bigint) AS varchar) || ':' || cast(cast(t.stop AS bigint) AS varchar) AS span FROM t JOIN o ON o.hash = t.hash WHERE t.kind <> 'live' OR o.few),
a AS (SELECT doc_id, count(CASE WHEN kind = 'assign' THEN 1 END) AS n_assign, count(CASE WHEN kind = 'access' THEN 1 END) AS n_access, count(CASE WHEN kind = 'hex' THEN 1 END) AS n_hex, string_agg(CASE WHEN kind <> 'live' THEN span END, ',' ORDER BY start, k) AS base, string_agg(span, ',' ORDER BY start, k) AS spans, count(CASE WHEN live THEN 1 END) AS n_live_looking, count(CASE WHEN NOT live THEN 1 END) AS n_copied FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live_looking, 0) AS n_live_looking, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""


#: The contract's sets, all pairs that share a shingle, and the transitive closure of the links.
NGRAM_JOIN_SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)])) END AS g FROM t),
c AS (SELECT min(rid) AS cid, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
m AS (SELECT s.rid, c.cid FROM s JOIN c ON c.g = s.g),
u AS (SELECT cid, n, unnest(g) AS x FROM c),
r AS (SELECT x, count(*) AS k FROM u GROUP BY x),
o AS (SELECT u.cid, u.n, u.x, row_number() OVER (PARTITION BY u.cid ORDER BY r.k, u.x) AS pos FROM u JOIN r ON r.x = u.x),
p AS (SELECT * FROM o WHERE pos <= n - (90 * n + 99) // 100 + 1),
q AS (SELECT DISTINCT a.cid AS a, b.cid AS b FROM p a JOIN p b ON a.x = b.x AND a.cid < b.cid AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
l AS (SELECT q.a, q.b FROM q JOIN c x ON x.cid = q.a JOIN c y ON y.cid = q.b WHERE 100 * len(list_intersect(x.g, y.g)) >= 90 * (x.n + y.n - len(list_intersect(x.g, y.g)))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
h(a, b) AS (SELECT cid, cid FROM c UNION SELECT h.a, e.b FROM h JOIN e ON e.a = h.b),
k AS (SELECT h.a AS cid, min(s.doc_id) AS component_id FROM h JOIN m ON m.cid = h.b JOIN s ON s.rid = m.rid GROUP BY h.a)
SELECT s.doc_id, cast(len(s.g) AS bigint) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id FROM s LEFT JOIN m ON m.rid = s.rid LEFT JOIN k ON k.cid = m.cid
"""

#: Base 32 of the 40 hexadecimal digits: the five bits from place 5 * i lie in the digits 5 * i // 4 and the next.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, html FROM p),
x AS (SELECT page_id, n, html, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((((instr('0123456789abcdef', substr(h, 5 * i // 4 + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h || '0', 5 * i // 4 + 2, 1)) - 1) >> (3 - i % 4)) & 31 AS int) + 1, 1) for i in range(0, 32)], '') AS digest FROM d),
g AS (SELECT html, max(page_id) AS answer FROM p GROUP BY html)
SELECT x.page_id, cast(x.n AS bigint) AS payload_bytes, x.digest AS payload_digest, CASE WHEN x.page_id = g.answer THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN x.page_id <> g.answer THEN g.answer END AS refers_to
FROM x JOIN g ON g.html = x.html
"""

#: Capped sources are the first ones by limit over weight; each rank is tried as the first one that isn't capped. Draws follow the hashed order.
MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS bigint) AS size, cast('0x' || substr(md5('mix' || chr(31) || coalesce(source, chr(0)) || chr(31) || coalesce(cast(doc_id AS varchar), chr(0))), 1, 15) AS bigint) AS key FROM documents),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, cast((r - 1) % 3 + 1 AS double) AS weight, 3.0::double * source_size AS lim FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY lim / weight, r) AS k, coalesce(sum(lim) OVER (ORDER BY lim / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(weight) OVER (ORDER BY lim / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(source_size) OVER () AS total FROM w),
c AS (SELECT k, greatest(0.0::double, cast(total AS double) - held) / free AS rate FROM o WHERE greatest(0.0::double, cast(total AS double) - held) / free * weight <= lim ORDER BY k LIMIT 1),
t AS (SELECT o.source, o.source_size, CASE WHEN c.k IS NULL OR o.k < c.k THEN o.lim ELSE c.rate * o.weight END AS target FROM o LEFT JOIN c ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN cast(floor(target / source_size) AS bigint) ELSE 0 END AS passes FROM t),
i AS (SELECT source, key, doc_id, sum(size) AS size FROM d GROUP BY source, key, doc_id),
m AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST) - size / 2 AS mid FROM i),
x AS (SELECT m.source, m.key, m.doc_id, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.passes + CASE WHEN p.target - p.passes * p.source_size > 0 AND m.mid <= p.target - p.passes * p.source_size THEN 1 ELSE 0 END ELSE 0 END AS times FROM m JOIN p ON p.source IS NOT DISTINCT FROM m.source)
SELECT d.doc_id, d.size, x.source_size, x.target, cast(d.size * x.times AS bigint) AS taken, cast(x.times AS bigint) AS times
FROM d JOIN x ON x.source IS NOT DISTINCT FROM d.source AND x.key = d.key AND x.doc_id IS NOT DISTINCT FROM d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k": TOP_K_SQL, "op3_secrets": _secrets_sql(), "op4_ngram_join": NGRAM_JOIN_SQL, "op6_exact_dedup": EXACT_DEDUP_SQL, "op9_warc": WARC_SQL, "op10_mixing": MIXING_SQL, "op11_variants": VARIANTS_SQL, "op12_collocations": COLLOCATIONS_SQL, "op13_repeats": REPEATS_SQL}
