"""The queries that SQL can express, written for DuckDB and independently of the operators."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OCTET = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
PII = f"""
WITH k(kind, ord, p, words) AS (VALUES
 ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', ''), ('ip', 2, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)', ''),
 ('card', 3, '[0-9]([\\x20-]?[0-9])+', ''), ('phone', 4, '\\+[0-9][\\x20().0-9-]+[0-9]', ''),
 ('iban', 5, '[A-Z]{{2}}[0-9]{{2}}([A-Z0-9]{{11,30}}|( [A-Z0-9]{{4}}){{2,7}}( [A-Z0-9]{{1,3}})?)', ''),
 ('ssn', 6, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}', '(?i)(ssn|social security|soc\\. sec)'),
 ('localphone', 7, '\\(?[0-9]{{3}}\\)?[ .-][0-9]{{3}}[.-][0-9]{{4}}', '(?i)(phone|mobile|call|fax|whatsapp|tel[.:]|telef)'),
 ('secret', 8, '[A-Za-z0-9_-]{{20,}}', '(?i)(token|secret|passw|api[ _-]?key|access[ _-]?key|private[ _-]?key)')),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, kind, ord, words, regexp_extract_all(t, p) AS ms, regexp_split_to_array(t, p) AS gs FROM d, k),
x AS (SELECT doc_id, kind, ord, words, ms[i] AS m, gs[i] AS gap,
  list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)),
y AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits, reverse(regexp_replace(m, '[^0-9]', '', 'g')) AS back, replace(m, ' ', '') AS code, right(gap, 40) AS before FROM x),
z AS (SELECT doc_id, kind, ord, s::INT AS s, (s + length(m))::INT AS e FROM y WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN regexp_full_match(m, '{OCTET}(\\.{OCTET}){{3}}')
  WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(back) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN substr(back, i, 1)::INT ELSE substr(translate(back, '0123456789', '0246813579'), i, 1)::INT END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  WHEN 'iban' THEN length(code) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(substr(code, 5) || substr(code, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ord(c) - 55 ELSE c::INT END),
    lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END, 0) = 1
  WHEN 'secret' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND regexp_matches(before, words)
  WHEN 'ssn' THEN NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') AND regexp_matches(before, words)
  ELSE NOT regexp_matches(before, '\\+[0-9 ().-]*$') AND regexp_matches(before, words) END)
SELECT d.doc_id, count(CASE WHEN kind = 'email' THEN 1 END) AS n_email, count(CASE WHEN kind = 'ip' THEN 1 END) AS n_ip, count(CASE WHEN kind = 'card' THEN 1 END) AS n_card,
 count(CASE WHEN kind = 'phone' THEN 1 END) AS n_phone, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) FILTER (WHERE ord <= 4), '')) AS base_sha256,
 coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s), '') AS spans
FROM d LEFT JOIN z ON d.doc_id = z.doc_id GROUP BY d.doc_id"""

#: Rows are documents: those of one doc_id are counted each, as the operator does.
LINES = f"""
WITH l AS (SELECT row, doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT row, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
s AS (SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT row) >= 5),
j AS (SELECT l.*, keep IS NOT NULL AND doc_id < keep AS gone FROM l LEFT JOIN s USING (k))
SELECT doc_id, count(*) AS n_lines, count(CASE WHEN gone THEN 1 END) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY row, doc_id"""

DECONTAM = f"""
WITH b AS (SELECT DISTINCT item_id, {LOW_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS win FROM (SELECT *, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {LOW_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS v FROM hit) GROUP BY 1),
dp AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS t FROM d), cnt AS (SELECT t, count(*) AS c FROM dp GROUP BY 1),
bp AS (SELECT item_id, w, p, coalesce(c, 0) AS c FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM b) LEFT JOIN cnt USING (t)),
bc AS (SELECT item_id, w, list(c ORDER BY p) AS cs FROM bp GROUP BY 1, 2),
two AS (SELECT item_id, w, list_sort(list_transform(range(i, i + n), lambda p: {{'c': cs[p], 'p': p}})) AS s FROM (SELECT *, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bc)),
anchor AS (SELECT DISTINCT item_id, w[s[1].p] AS t1, s[1].p AS p1, w[s[least(2, len(s))].p] AS t2, s[least(2, len(s))].p AS p2 FROM two WHERE s[1].c > 0),
nr AS (SELECT x.doc_id, count(DISTINCT item_id) AS n_near FROM anchor JOIN dp x ON x.t = t1 JOIN dp y ON y.t = t2 AND y.doc_id = x.doc_id WHERE abs((x.q - p1) - (y.q - p2)) <= 10 GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nr USING (doc_id)"""

RULES = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
t AS (SELECT doc_id, i, w[i:i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM t) WHERE c > 1) GROUP BY 1),
m AS (SELECT d.doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l) AS n_lines,
  (len(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_symbols * 10 > n_words * 2 OR word_chars < 2 * n_words OR word_chars > 15 * n_words
 OR (n_dup_lines >= 4 AND n_dup_lines * 10 > n_lines * 3) OR length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(regexp_replace(t, '[^a-z]', '', 'g')) OR length(regexp_replace(t, '[^!]', '', 'g')) * 10 > n_words) AS kept FROM f"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {LOW_WORDS} AS w FROM documents),
c AS (SELECT w, min(doc_id) AS copy_id FROM d GROUP BY w),
s AS (SELECT DISTINCT copy_id, w[i:i + 4] AS sh FROM (SELECT copy_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM c WHERE len(w) > 0)),
n AS (SELECT copy_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.copy_id AS a, y.copy_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.copy_id <> y.copy_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON a = na.copy_id JOIN n nb ON b = nb.copy_id WHERE 9 * k >= 4 * (na.n + nb.n)),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
g AS (SELECT a, min(least(a, b)) AS low FROM reach GROUP BY 1), deg AS (SELECT a, count(*) AS k FROM e GROUP BY 1)
SELECT doc_id, coalesce(low, copy_id) AS class_id, copy_id, coalesce(k, 0) AS n_links FROM d JOIN c USING (w) LEFT JOIN g ON copy_id = g.a LEFT JOIN deg ON copy_id = deg.a"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages), q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS low FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id <> low THEN low END AS refers_to FROM q"""

URLS = f"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, rest, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host FROM u),
v AS (SELECT page_id, url, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h),
r(rh, rp, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT v.*, rh || rp AS rule, says, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k FROM v LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
g AS (SELECT *, list_filter(string_split(regexp_extract(path, '^.*/'), '/'), lambda x: x <> '') AS dirs,
  list_filter(list_transform(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: regexp_extract(x, '^[^=]*')), lambda x: x <> '') AS names FROM f WHERE k = 1),
e AS (SELECT *, list_sort(list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host=' || x), list_transform(dirs, lambda x: 'dir=' || translate(x, '{UPPER}', '{LOWER}')),
  list_transform(names, lambda x: 'query=' || translate(x, '{UPPER}', '{LOWER}')), ['depth=' || len(dirs)]))) AS toks FROM g),
total AS (SELECT count(*) AS n FROM e WHERE says IS NOT NULL),
parts AS (SELECT says, toks, 0 AS last, []::VARCHAR[] AS ante FROM e WHERE says IS NOT NULL UNION ALL SELECT says, toks, i, list_append(ante, toks[i]) FROM (SELECT *, unnest(range(last + 1, len(toks) + 1)) AS i FROM parts)),
sets AS (SELECT ante, says FROM parts WHERE len(ante) > 0),
mined AS (SELECT ante, verdict, k, k / c::DOUBLE AS conf, k / n::DOUBLE AS sup FROM (SELECT ante, count(*) AS c FROM sets GROUP BY 1) JOIN (SELECT ante, says AS verdict, count(*) AS k FROM sets GROUP BY 1, 2) USING (ante), total
  WHERE k >= ceil(0.002 * n) AND k / c::DOUBLE >= 0.9),
best AS (SELECT e.page_id, arg_min(verdict, {{'a': -round(conf, 9), 'b': -round(sup, 9), 'c': len(ante), 'd': verdict}}) AS said FROM e JOIN mined ON list_has_all(toks, ante) WHERE says IS NULL GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(says, said, 'allow') AS verdict FROM e LEFT JOIN best USING (page_id)"""


#: Texts with the same shingles are one class, or all pairs of a group of copies would be made.
MINMAX = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS sh FROM d WHERE len(w) > 0),
c AS (SELECT sh, min(doc_id) AS low, len(sh) AS n FROM s GROUP BY sh),
x AS (SELECT low, n, unnest(sh) AS h FROM c),
p AS (SELECT a.low AS a, b.low AS b, a.n + b.n AS n, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.low <> b.low GROUP BY 1, 2, 3),
e AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (n - k)),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
g AS (SELECT a, min(least(a, b)) AS root FROM reach GROUP BY 1),
o AS (SELECT s.doc_id, len(s.sh) AS n, coalesce(root, low) AS root FROM s JOIN c USING (sh) LEFT JOIN g ON low = g.a)
SELECT d.doc_id, coalesce(o.n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN o USING (doc_id)"""

#: The checksum byte by byte, from a table that the polynomial gives; near words by the word without one code point.
SPELLING = f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents) GROUP BY 1, 2),
b AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END)) AS bs FROM r),
h AS (SELECT run, k, xor(list_reduce(list_concat([4294967295], bs), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, tab),
v AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
one AS (SELECT a.word, b.word AS other FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word UNION SELECT x.word, v.word FROM x JOIN v ON cut = v.word UNION SELECT v.word, x.word FROM x JOIN v ON cut = v.word),
f AS (SELECT one.word, count(*) AS n_near, max(o.n) AS top, min(other) FILTER (WHERE o.n = t.top) AS best FROM one JOIN v o ON other = o.word JOIN (SELECT one.word, max(n) AS top FROM one JOIN v ON other = v.word GROUP BY 1) t ON t.word = one.word GROUP BY 1),
w AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN best END AS form, CASE WHEN top >= 5 * v.n THEN top END AS form_n FROM v LEFT JOIN f USING (word)),
walk AS (SELECT word, word AS at_, form AS next_ FROM w UNION ALL SELECT walk.word, w.word, w.form FROM walk JOIN w ON next_ = w.word)
SELECT w.word, form, at_ AS root, n, n_near, form_n FROM w JOIN walk ON walk.word = w.word AND next_ IS NULL"""

NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
