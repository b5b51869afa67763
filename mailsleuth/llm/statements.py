"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from .license_scan import TEMPLATES

LOWER = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
HOST = LOWER.format(c=r"regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")

URL_FILTER = f"""
WITH u AS (
  SELECT page_id, {HOST} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '://[^/?#]*[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS q
  FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canon FROM u),
l AS (SELECT DISTINCT canon FROM c WHERE contains(host, 'spam') AND canon IS NOT NULL),
r AS (SELECT c.*, l.canon IS NOT NULL AS listed,
  CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c LEFT JOIN l ON c.canon = l.canon)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), '') AS ident
  FROM {documents}),
s0 AS (SELECT skey, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM d GROUP BY skey),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s0),
s2 AS (SELECT *, CAST(2 * source_size AS DOUBLE) / weight AS ratio FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY ratio, (source IS NULL), source) AS place,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY ratio, (source IS NULL), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER (ORDER BY ratio, (source IS NULL), source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s2),
lv AS (SELECT level, place FROM s3 WHERE level <= ratio ORDER BY place LIMIT 1),
s AS (SELECT skey, source_size, docs, CASE WHEN place < coalesce((SELECT place FROM lv), 2147483647) THEN CAST(2 * source_size AS DOUBLE) ELSE (SELECT level FROM lv) * weight END AS target FROM s3),
e AS (SELECT d.*, s.source_size, s.target, CAST(('0x' || substr(md5('mix:shard:' || ident), 1, 8)) AS BIGINT) % CAST((s.docs + 1023) // 1024 AS BIGINT) AS shard, md5('mix:turn:' || ident) AS turn
      FROM d JOIN s ON d.skey = s.skey),
h0 AS (SELECT skey, shard, (CAST(sum(size) AS BIGINT) + 63) // 64 AS blocks, min(source_size) AS source_size, min(target) AS target FROM e GROUP BY skey, shard),
h AS (SELECT *, lpad(CAST(shard AS VARCHAR), 12, '0') || ':' || skey AS unit, CASE WHEN source_size > 0 THEN target / source_size * blocks ELSE 0.0 END AS votes FROM h0),
g0 AS (SELECT skey, CASE WHEN min(source_size) > 0 THEN min(target) / min(source_size) * sum(blocks) ELSE 0.0 END AS votes, sum(blocks) * 2 AS most FROM h GROUP BY skey),
total AS (SELECT CAST(round(sum(votes)) AS BIGINT) AS n FROM g0),
g1 AS (SELECT skey, votes, most, unnest(range(0, CAST(most AS BIGINT))) AS k FROM g0),
g2 AS (SELECT skey, row_number() OVER (ORDER BY votes / (k * 2 + 1) DESC, skey, k) AS place FROM g1),
g AS (SELECT skey, count(*) AS n FROM g2 WHERE place <= (SELECT n FROM total) GROUP BY skey),
h1 AS (SELECT skey, shard, unit, votes, unnest(range(0, CAST(2 * blocks AS BIGINT))) AS k FROM h),
h2 AS (SELECT skey, unit, row_number() OVER (PARTITION BY skey ORDER BY votes / (k * 2 + 1) DESC, unit, k) AS place FROM h1),
h3 AS (SELECT unit, count(*) AS quota FROM h2 JOIN g ON h2.skey = g.skey WHERE place <= g.n GROUP BY unit),
q AS (SELECT h.skey, h.shard, greatest(h.blocks, 1) AS n, coalesce(h3.quota, 0) AS quota, CAST(('0x' || substr(md5('mix:start:' || h.unit), 1, 8)) AS BIGINT) % greatest(h.blocks, 1) AS start FROM h LEFT JOIN h3 ON h.unit = h3.unit),
p AS (SELECT e.doc_id, e.size, e.source_size, e.target, q.n, q.quota // q.n AS rounds, q.quota % q.n AS more, q.start,
        CAST(sum(size) OVER (PARTITION BY e.skey, e.shard ORDER BY turn, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS b
      FROM e JOIN q ON e.skey = q.skey AND e.shard = q.shard),
t AS (SELECT *, b - size AS a FROM p)
SELECT doc_id, size, source_size, target, CAST(
  (rounds * b + 64 * (((b // 64) * more + start) // n) + (b % 64) * (((b // 64 + 1) * more + start) // n - ((b // 64) * more + start) // n))
  - (rounds * a + 64 * (((a // 64) * more + start) // n) + (a % 64) * (((a // 64 + 1) * more + start) // n - ((a // 64) * more + start) // n)) AS BIGINT) AS taken
FROM t
"""

_HEX = "CAST(('0x' || substr(sha, {at}, 5)) AS BIGINT)"
_BASE32 = " || ".join("substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({v} // {d}) % 32 AS BIGINT) + 1, 1)".format(v=_HEX.format(at=5 * i + 1), d=32 ** j) for i in range(8) for j in (3, 2, 1, 0))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT body, min(page_id) AS first_id FROM p GROUP BY body)
SELECT p.page_id, CAST(octet_length(encode(p.body)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN p.page_id IS NOT DISTINCT FROM f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p JOIN f ON p.body = f.body
"""

LEAKS = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {WORDS.format(c="coalesce(text, '')")} AS w FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format(c="coalesce(text, '')")} AS w FROM {{documents}}),
g AS (SELECT r, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
      FROM (SELECT d.r, d.w, s.size, unnest(range(1, greatest(len(d.w) - s.size, -1) + 2)) AS i FROM d, (SELECT DISTINCT size FROM w) s)),
h AS (SELECT g.r, g.i, g.size, w.item_id FROM g JOIN w ON g.size = w.size AND g.win = w.win),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN t ON d.r = t.r
"""

_TEMPLATES = ", ".join(f"('{label}', list_distinct(string_split('{text}', ' ')))" for label, text in TEMPLATES)
LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, {WORDS.format(c="coalesce(text, '')")} AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
b AS (SELECT r, i - 1 AS i, CASE WHEN w[i] = 'cc' AND w[i + 1] = 'by' THEN 'cc-by' WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl'
        WHEN w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved' THEN 'reserved' END AS label FROM p),
base AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi FROM b WHERE label IS NOT NULL GROUP BY r),
t AS (SELECT * FROM (VALUES {_TEMPLATES}) AS t(label, words)),
l AS (SELECT r, {WORDS.format(c="line")} AS w FROM (SELECT r, unnest(lines) AS line FROM d)),
m AS (SELECT l.r, t.label, CAST(len(list_distinct(list_intersect(t.words, l.w))) AS DOUBLE) / len(t.words) AS score FROM l, t),
k AS (SELECT r, label, max(score) AS score FROM m WHERE score >= 0.8 GROUP BY r, label),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT r, label FROM b WHERE label IS NOT NULL) GROUP BY r),
al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b WHERE label IS NOT NULL UNION SELECT r, label FROM k) GROUP BY r),
s AS (SELECT r, max(score) AS score FROM k GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, base.lo AS first_word, base.hi AS last_word,
  coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels, coalesce(s.score, 0.0) AS score
FROM d LEFT JOIN base ON d.r = base.r LEFT JOIN bl ON d.r = bl.r LEFT JOIN al ON d.r = al.r LEFT JOIN s ON d.r = s.r
"""

_RUNS = r"regexp_extract_all(" + LOWER.format(c="coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
NEAR = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_RUNS} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 3), ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS same FROM s GROUP BY r),
u AS (SELECT min(r) AS u, same, min(n) AS n FROM n GROUP BY same),
us AS (SELECT u.u, s.x FROM u JOIN s ON u.u = s.r),
p AS (SELECT a.u AS a, b.u AS b, count(*) AS common FROM us a JOIN us b ON a.x = b.x AND a.u < b.u GROUP BY a.u, b.u),
l AS (SELECT p.a, p.b FROM p JOIN u x ON p.a = x.u JOIN u y ON p.b = y.u WHERE 100 * p.common >= 80 * (x.n + y.n - p.common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l UNION ALL SELECT u, u FROM u),
t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
c AS (SELECT t.a AS u, min(d.doc_id) AS component_id FROM t JOIN u ON t.b = u.u JOIN n ON u.same = n.same JOIN d ON n.r = d.r GROUP BY t.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CASE WHEN n.r IS NULL THEN d.doc_id ELSE c.component_id END AS component_id,
  d.doc_id IS NOT DISTINCT FROM CASE WHEN n.r IS NULL THEN d.doc_id ELSE c.component_id END AS kept
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN u ON n.same = u.same LEFT JOIN c ON u.u = c.u
"""

_SQUARES = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _cluster_rounds(rounds: int) -> str:
    """The assignments a0, a1, ... and the centroids c1, c2, ... that follow from them."""
    out = []
    for i in range(rounds + 1):
        out.append(f"a{i} AS (SELECT k.r, c.c, CAST({_SQUARES} AS BIGINT) AS d FROM k, c{i} c QUALIFY row_number() OVER (PARTITION BY k.r ORDER BY d, c.c) = 1)")
        if i < rounds:
            out.append(f"""e{i} AS (SELECT a.c, unnest(range(1, 65)) AS i, unnest(k.v) AS x FROM k JOIN a{i} a ON k.r = a.r),
s{i} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e{i} GROUP BY c, i),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON c.c = m.c)""")
    return ",\n".join(out)


CLUSTERS = f"""
WITH f AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM f),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM k QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) <= 8),
{_cluster_rounds(10)}
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM k JOIN a10 a ON k.r = a.r JOIN c10 c ON a.c = c.c
"""

_WORDS13 = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, {_WORDS13} AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
        CASE WHEN len(w.w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w.w)) < 65 * len(w.w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN w.doc_id > w.first_id THEN 'E' ELSE '' END AS failed
      FROM w LEFT JOIN m ON w.doc_id = m.doc_id),
c AS (SELECT part, good, toxic, failed, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
p AS (SELECT c.*, o.filter_order, coalesce(list_min([instr(o.filter_order, x) FOR x IN string_split(c.failed, '') IF x <> '']), 9) AS out_at FROM c, o),
r AS (SELECT p.part, s.filter_order, s.step, s.filter_order[s.step] AS letter, sum(CASE WHEN out_at > s.step THEN n ELSE 0 END) AS kept, sum(CASE WHEN out_at = s.step THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN out_at < s.step AND contains(failed, s.filter_order[s.step]) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = s.filter_order[s.step] THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN out_at = s.step THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN out_at = s.step THEN n * toxic ELSE 0 END) AS toxic_lost
      FROM p JOIN s ON p.filter_order = s.filter_order GROUP BY p.part, s.filter_order, s.step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""

STATEMENTS = {"op7_license_scan": LICENSES, "op4_decontaminate": LEAKS.format(documents="documents"), "op6_url_filter": URL_FILTER, "op8_source_mix": MIX.format(documents="documents"), "op9_warc_archive": WARC,
              "op11_near_dedup": NEAR, "op12_centroid_clusters": CLUSTERS, "op13_filter_audit": AUDIT}
