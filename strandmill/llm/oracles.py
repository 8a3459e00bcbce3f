"""SQL of the word, phrase and passage queries."""

from __future__ import annotations

#: crc32 byte by byte from its table; near words are those that share a word with one letter left out, at one place or with the word itself.
VARIANTS_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::bigint) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(cast(doc_id AS varchar), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run FROM documents),
own AS (SELECT d, run, count(*) AS k, hex(d || ':' || run) AS x FROM runs GROUP BY d, run),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(x) // 2), lambda i: cast('0x' || substr(x, cast(2 * i + 1 AS int), 2) AS bigint))), lambda c, b: xor(c >> 8, t[cast((xor(c, b) & 255) + 1 AS int)])), 4294967295::bigint) AS h FROM own, tab),
typed AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, cast(h % length(run) AS int)) || substr(run, cast(h % length(run) + 2 AS int)) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, cast(sum(k) AS bigint) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
less AS (SELECT word, n, i, substr(word, 1, cast(i - 1 AS int)) || substr(word, cast(i + 1 AS int)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m, any_value(n) AS n FROM near GROUP BY word),
forms AS (SELECT word, n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM best),
walk(word, here, steps) AS (SELECT word, form, 1 FROM forms WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form, w.steps + 1 FROM walk w JOIN forms f ON f.word = w.here WHERE f.form IS NOT NULL),
roots AS (SELECT word, last(here ORDER BY steps) AS root FROM walk GROUP BY word)
SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(f.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN forms f ON f.word = w.word LEFT JOIN roots r ON r.word = w.word
"""

#: Every length is counted by itself; products are 128-bit integers.
COLLOCATIONS_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
rows AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS p FROM rows, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
f AS (SELECT lang, k, p, count(*) AS n FROM grams GROUP BY lang, k, p),
totals AS (SELECT lang, cast(sum(n) AS bigint) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, p, n AS a, string_split(p, ' ') AS w FROM f WHERE k >= 2 AND n >= 100),
cuts AS (SELECT lang, k, p, a, c, array_to_string(w[1:c], ' ') AS l, array_to_string(w[c + 1:k], ' ') AS r FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
scored AS (SELECT c.lang, c.p, c.a, c.c, x.n AS l, y.n AS r, t.n, cast(1000::hugeint * c.a * t.n // (x.n::hugeint * y.n) AS bigint) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.l JOIN f y ON y.lang = c.lang AND y.p = c.r JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM cand x WHERE x.lang = b.lang AND x.k > len(string_split(b.p, ' ')) AND 100 * x.a >= 100 * b.a AND contains(' ' || x.p || ' ', ' ' || b.p || ' '))),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000
"""

#: Windows as hexadecimal digits, read from parts that hold 512 of them; bytes that no repeated window covers are put together again.
REPEATS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(coalesce(text, '')) AS x FROM documents),
c AS (SELECT rid, o, substr(x, cast(2 * o + 1 AS int), 1422) AS y FROM (SELECT rid, x, unnest(range(0, length(x) // 2 - 199, 512)) AS o FROM d WHERE length(x) >= 400)),
s AS (SELECT rid, o + i AS i, md5(substr(y, cast(2 * i + 1 AS int), 400)) AS h FROM (SELECT rid, o, y, unnest(range(0, length(y) // 2 - 199)) AS i FROM c)),
g AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
m AS (SELECT s.rid, s.i, s.i > coalesce(lag(s.i) OVER (PARTITION BY s.rid ORDER BY s.i) + 200, -1) AS fresh FROM s JOIN g ON g.h = s.h),
b AS (SELECT rid, i, sum(fresh::int) OVER (PARTITION BY rid ORDER BY i) AS run FROM m),
spans AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS z FROM b GROUP BY rid, run),
gaps AS (SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS a, a AS z, z - a AS gone, z AS next FROM spans),
k AS (SELECT gaps.rid, string_agg(substr(x, cast(2 * a + 1 AS int), cast(2 * (z - a) AS int)), '' ORDER BY a) || substr(any_value(x), cast(2 * max(next) + 1 AS int)) AS kept, cast(sum(gone) AS bigint) AS n_removed, count(*) AS n_spans FROM gaps JOIN d ON d.rid = gaps.rid GROUP BY gaps.rid)
SELECT d.doc_id, length(d.x) // 2 AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.kept, d.x))) AS kept_sha256
FROM d LEFT JOIN k ON k.rid = d.rid
"""
