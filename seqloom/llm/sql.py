"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
s AS (SELECT r, unnest(generate_series(1, len(w) - 2)) AS p, w FROM w WHERE len(w) >= 3),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, w[p], w[p + 1], w[p + 2]) AS n FROM s),
u AS (SELECT r, count(DISTINCT q) AS n_repeat_words
      FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY r),
c AS (SELECT w.r, doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN u ON w.r = u.r),
f AS (SELECT *, (n_words < 50)::INT AS f1, (100 * n_repeat_words > 50 * n_words)::INT AS f2,
        (10 * n_symbols > word_chars)::INT AS f3, (3 * n_dup_lines > n_lines)::INT AS f4 FROM c),
rules AS (SELECT host, k, n, f FROM (
        SELECT host, count(*) AS n, sum(f1) AS s1, sum(f2) AS s2, sum(f3) AS s3, sum(f4) AS s4 FROM f GROUP BY host)
      CROSS JOIN LATERAL (VALUES (1, s1), (2, s2), (3, s3), (4, s4)) AS v(k, f)),
m AS (SELECT k, sum(f) / sum(n) AS m, sum(n) AS n, count(*) AS h FROM rules GROUP BY k),
v AS (SELECT m.k, any_value(m.m) AS m,
        (sum(rules.n * pow(rules.f / rules.n - m.m, 2)) - any_value(m.m * (1 - m.m) * (m.h - 1))) / any_value(m.n) AS b
      FROM rules JOIN m ON rules.k = m.k GROUP BY m.k),
prior AS (SELECT k, m, CASE WHEN b > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / b - 1)) ELSE 1000.0 END AS s FROM v),
verdict AS (SELECT host, bool_or((f + m * s) / (n + s) > 0.8) AS host_rejected,
        bool_or(rules.k = 3 AND (f + m * s) / (n + s) > m * 1.05) AS against3, bool_or(rules.k = 4 AND (f + m * s) / (n + s) > m * 1.05) AS against4
      FROM rules JOIN prior ON rules.k = prior.k GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 + f2 > 0 AS base_failed, host_rejected,
       f3 > 0 AND against3 OR f4 > 0 AND against4 AS rule_rejected,
       f1 + f2 = 0 AND NOT host_rejected AND NOT (f3 > 0 AND against3 OR f4 > 0 AND against4) AS kept
FROM f JOIN verdict ON f.host IS NOT DISTINCT FROM verdict.host
"""


OP8 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 11))::BIGINT AS drawn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, greatest(1, ceil(count(*) / 4096.0))::BIGINT AS shards,
        (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
-- the level x of the water: sum of least(3 size, x weight) is all words
lv AS (SELECT max(x) AS x FROM (
        SELECT ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3 * i.source_size) FROM s i WHERE i.source_size / i.weight < o.source_size / o.weight), 0))
               / (SELECT sum(i.weight) FROM s i WHERE i.source_size / i.weight >= o.source_size / o.weight) AS x, 3 * o.source_size / o.weight AS r FROM s o)
      WHERE x <= r),
t AS (SELECT s.*, least(3.0 * source_size, x * weight) AS target FROM s CROSS JOIN lv),
b AS (SELECT greatest(1, sum(source_size)::BIGINT // greatest(4096 * count(*), 256 * sum(shards))::BIGINT)::BIGINT AS block,
        sum(target) AS words FROM t),
sq AS (SELECT source, weight, target / (2 * k + 1) AS q, k FROM t, b, unnest(generate_series(0, (3 * source_size // block)::BIGINT - 1)) AS g(k)),
sr AS (SELECT source, row_number() OVER (ORDER BY q DESC, weight, source NULLS LAST, k) AS n FROM sq),
sb AS (SELECT source, count(*) AS blocks FROM sr, b WHERE n <= round(words / block) GROUP BY source),
p AS (SELECT d.*, drawn % shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
h AS (SELECT source, shard, sum(size)::BIGINT AS shard_size FROM p GROUP BY source, shard),
hq AS (SELECT source, shard, shard_size / (2 * k + 1) AS q, k FROM h, b, unnest(generate_series(0, (3 * shard_size // block)::BIGINT - 1)) AS g(k)),
hr AS (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard, k) AS n FROM hq),
hb AS (SELECT hr.source, shard, count(*) AS quota FROM hr JOIN sb ON hr.source IS NOT DISTINCT FROM sb.source WHERE n <= blocks GROUP BY ALL),
r AS (SELECT h.source, h.shard, shard_size, coalesce(quota, 0) * block AS words,
        block * (('0x' || substr(md5('42:start:' || coalesce(h.source, 'null') || ':' || h.shard), 1, 11))::BIGINT
          % greatest(1, ceil(shard_size / block))::BIGINT) AS start
      FROM h CROSS JOIN b LEFT JOIN hb ON h.source IS NOT DISTINCT FROM hb.source AND h.shard = hb.shard),
w AS (SELECT p.*, sum(size) OVER (PARTITION BY source, shard ORDER BY drawn, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS a FROM p)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE
    ((start + words) // shard_size * size + least(greatest((start + words) % shard_size - a, 0), size))
    - (start // shard_size * size + least(greatest(start % shard_size - a, 0), size)) END::BIGINT AS taken
FROM w JOIN r ON w.source IS NOT DISTINCT FROM r.source AND w.shard = r.shard JOIN t ON w.source IS NOT DISTINCT FROM t.source
"""


OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, h, strlen(h)::BIGINT AS n, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n < 1000 OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5, "op8_mixing": OP8, "op9_warc": OP9, "op10_quality_rules": OP10}
