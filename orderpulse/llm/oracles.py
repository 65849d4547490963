"""DuckDB SQL of the queries that SQL can express, written from their rules."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIXING = f"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS m, len({_WORDS}) AS size FROM documents),
s AS (
  SELECT source, sum(size) AS source_size,
         [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 3 * source_size AS stop, row_number() OVER by_ratio AS pos,
         (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (by_ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         (SELECT sum(w) FROM s) - coalesce(sum(w) OVER (by_ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS width
  FROM s WINDOW by_ratio AS (ORDER BY 3 * source_size::DOUBLE / w, source)),
f AS (SELECT rest, width, pos FROM o WHERE stop * width >= rest * w ORDER BY pos LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN pos < (SELECT pos FROM f) THEN stop::DOUBLE
              ELSE (SELECT rest FROM f)::DOUBLE * w / (SELECT width FROM f) END AS target FROM o),
p AS (
  SELECT doc_id, size, source_size, target,
         floor(target + 0.5) AS budget, floor(floor(target + 0.5) / source_size) AS rounds,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, m)), doc_id, m
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (rounds * size + greatest(0, least(size, budget - rounds * source_size - before)))::BIGINT AS taken FROM p
"""

LINE_QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT r, i, words[i:i + 4] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
twice AS (SELECT r, w FROM win GROUP BY r, w HAVING count(*) > 1),
rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (r, w)) GROUP BY r),
line AS (SELECT r, source, doc_id, t, x, lower(trim(x, ' ')) AS l FROM (SELECT r, source, doc_id, t, unnest(lines) AS x FROM d)),
host AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
often AS (
  SELECT line.source, l, min(doc_id) AS first FROM line GROUP BY line.source, l
  HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > 0.01::DOUBLE * (SELECT texts FROM host WHERE host.source IS NOT DISTINCT FROM line.source)),
loss AS (
  SELECT r, sum(length(x)) AS all_chars,
         sum(CASE WHEN o.l IS NOT NULL AND coalesce(o.first <> line.doc_id, true) THEN length(x) ELSE 0 END) AS gone
  FROM line LEFT JOIN often o ON o.l = line.l AND o.source IS NOT DISTINCT FROM line.source GROUP BY r),
m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         coalesce(all_chars, 0) AS line_chars, coalesce(gone, 0) AS removed_chars
  FROM d LEFT JOIN rep USING (r) LEFT JOIN loss USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (removed_chars > 0 AND line_chars - removed_chars < 0.2::DOUBLE * line_chars) AS kept,
       line_chars::BIGINT AS line_chars, removed_chars::BIGINT AS removed_chars FROM v
"""

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, w[i:i + 3] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS other FROM both_ways UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
comp AS (SELECT id, min(other) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id)::BIGINT AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.id = d.doc_id
"""

_HEAD = ("'WARC/1.0' || {nl} || 'WARC-Type: response' || {nl} || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || {nl} || "
         "'WARC-Target-URI: ' || coalesce(url, '') || {nl} || 'Content-Length: ' || strlen(body) || {nl} || {nl}").format(nl="chr(13) || chr(10)")

WARC_FIXITY = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body,
         CASE WHEN page_id % 89 = 5 AND length(coalesce(html, '')) > 0 THEN '~' || substring(html, 2) ELSE coalesce(html, '') END AS stored,
         row_number() OVER (ORDER BY page_id NULLS FIRST, coalesce(url, ''), sha256(coalesce(html, ''))) - 1 AS place FROM pages),
q AS (
  SELECT page_id, place // 4096 AS f, place % 4096 AS i, {_HEAD} || body || chr(13) || chr(10) || chr(13) || chr(10) AS a,
         {_HEAD} || stored || chr(13) || chr(10) || chr(13) || chr(10) AS b FROM p),
r AS (
  SELECT page_id, f, i, strlen(a) AS length, sha256(a) AS digest, sha256(a) = sha256(b) AS same,
         coalesce(sum(strlen(a)) OVER (PARTITION BY f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM q),
l0 AS (SELECT f, i, sha256(o::BIGINT || ':' || length || ':' || digest) AS h FROM r),
l1 AS (SELECT f, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l0 GROUP BY f, i // 16),
l2 AS (SELECT f, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l1 GROUP BY f, i // 16),
l3 AS (SELECT f, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l2 GROUP BY f)
SELECT page_id, f::BIGINT AS warc_file, i::BIGINT AS record, o::BIGINT AS "offset", length::BIGINT AS length, digest, h AS root,
       CASE WHEN same THEN 'intact' ELSE 'corrupt' END AS state FROM r JOIN l3 USING (f)
"""

_CODE = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_CODE.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, LOWERED AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS all_c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(all_c) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(n.n, 0) + 5 * v.v) AS p,
         1 + (1000000000::HUGEINT * (all_c + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(sum(abs(a.p - b.p)), 0) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN f a ON a.lang = g.lang AND a.source = g.source
  LEFT JOIN f b ON b.lang = g.lang AND b.source = h.source AND b.term = a.term
  GROUP BY g.lang, g.source, h.source),
terms AS (
  SELECT lang, source, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank
  FROM f WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value::BIGINT, rank FROM terms WHERE rank <= 50
""".replace("LOWERED", _LOWER)

MERKLE_MANIFEST = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
           lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)),
             lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc,
         {_LEAF.format(text="replace(text, chr(10), '')")} AS other FROM documents),
p AS (
  SELECT doc_id, source, leaf, CASE WHEN xor(crc, 4294967295::BIGINT) % 2 = 0 THEN other ELSE leaf END AS now,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n FROM d),
lv AS (
  SELECT source, 0 AS l, i AS j, n, leaf AS h FROM p
  UNION ALL
  SELECT source, l + 1, j // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY j)) FROM lv WHERE n > 1 GROUP BY source, l, j // 3, n),
subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM lv WHERE n = 1),
tv AS (
  SELECT 0 AS l, k AS j, n, subroot AS h FROM subs
  UNION ALL
  SELECT l + 1, j // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY j)) FROM tv WHERE n > 1 GROUP BY l, j // 3, n),
depth AS (SELECT source, max(l) AS depth FROM lv GROUP BY source),
way AS (   -- the nodes of every run on a document's way up, its own included
  SELECT p.source, p.i, lv.l AS step, lv.j, p.i // (3 ** lv.l)::BIGINT AS own, lv.h
  FROM p JOIN lv ON lv.source IS NOT DISTINCT FROM p.source AND lv.n > 1 AND lv.j // 3 = p.i // (3 ** (lv.l + 1))::BIGINT
  UNION ALL
  SELECT p.source, p.i, depth + tv.l, tv.j, k // (3 ** tv.l)::BIGINT, tv.h
  FROM p JOIN subs ON subs.source IS NOT DISTINCT FROM p.source JOIN depth ON depth.source IS NOT DISTINCT FROM p.source
  JOIN tv ON tv.n > 1 AND tv.j // 3 = k // (3 ** (tv.l + 1))::BIGINT),
runs AS (
  SELECT source, i, step, coalesce(string_agg(h, '' ORDER BY j) FILTER (j < own), '') AS lefts, coalesce(string_agg(h, '' ORDER BY j) FILTER (j > own), '') AS rights
  FROM way GROUP BY source, i, step),
proofs AS (SELECT source, i, string_agg(lefts || rights, '' ORDER BY step) AS proof, max(step) + 1 AS steps FROM runs GROUP BY source, i),
fold AS (
  SELECT source, i, 0 AS step, now AS h FROM p
  UNION ALL
  SELECT fold.source, fold.i, fold.step + 1, sha256(lefts || h || rights)
  FROM fold JOIN runs ON runs.source IS NOT DISTINCT FROM fold.source AND runs.i = fold.i AND runs.step = fold.step)
SELECT doc_id, leaf, subroot, (SELECT h FROM tv WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
       fold.h AS folded_root, fold.h = (SELECT h FROM tv WHERE n = 1) AS verified
FROM p JOIN subs ON subs.source IS NOT DISTINCT FROM p.source
LEFT JOIN proofs ON proofs.source IS NOT DISTINCT FROM p.source AND proofs.i = p.i
JOIN fold ON fold.source IS NOT DISTINCT FROM p.source AND fold.i = p.i AND fold.step = coalesce(steps, 0)
"""

ORACLES: dict[str, str] = {
    "op3_mixing": MIXING, "op5_line_quality": LINE_QUALITY, "op8_exact_dedup": EXACT_DEDUP,
    "op9_near_dedup": NEAR_DEDUP, "op10_warc_fixity": WARC_FIXITY, "op11_source_divergence": DIVERGENCE,
    "op12_merkle_manifest": MERKLE_MANIFEST,
}
