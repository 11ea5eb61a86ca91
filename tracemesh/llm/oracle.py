r"""SQL for the queries of this subpackage that SQL can express, in DuckDB's dialect.

The others are tested in ``tests/llm``: op1, op5 and op7 fit models, op3 needs XXH64 and reachability, op6, op8 and op13 need the tokenizers,
op12 needs a rolling hash.
"""

from __future__ import annotations

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE: dict[str, str] = {}

ORACLE["op2_mixing"] = rf"""
WITH docs AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS source_key, {_WORDS}::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS hash
  FROM documents
), sources AS (
  SELECT source_key, sum(size)::BIGINT AS source_size FROM docs GROUP BY source_key
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source_key) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS most FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY most::DOUBLE / weight, source_key)
), targets AS (
  SELECT source_key, source_size, least(weight * (SELECT max(level) FROM levels), most::DOUBLE) AS target FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target,
    row_number() OVER (PARTITION BY source_key ORDER BY size DESC, substr(hash, 1, 3), hash, doc_id) AS place,
    ('0x' || substr(md5('mix-1:' || source_key), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate
  FROM docs JOIN targets USING (source_key)
)
SELECT doc_id, size, source_size, target, ((floor(u + rate * place) - floor(u + rate * (place - 1))) * size)::BIGINT AS taken FROM placed
"""

ORACLE["op4_exact_dedup"] = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
groups AS (SELECT text, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM docs GROUP BY text)
SELECT doc_id, keep_id, group_size,
  doc_id IS NOT DISTINCT FROM keep_id AND row_number() OVER (PARTITION BY text, doc_id) = 1 AS kept, sha256(text) AS text_sha256
FROM docs JOIN groups USING (text)
"""

_HOST = r"lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"

ORACLE["op10_url_lists"] = f"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetch_day, string_split({_HOST}, '.') AS labels FROM pages
), named AS (
  SELECT page_id, fetch_day, unnest(list_distinct(list_concat(['url:' || url], CASE WHEN labels <> [''] THEN
    list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: 'host:' || array_to_string(labels[i:], '.')) ELSE [] END))) AS key
  FROM captures WHERE url IS NOT NULL
), hosts AS (
  SELECT key, ('0x' || substr(md5(key), 1, 4))::INT AS h FROM (SELECT DISTINCT 'host:' || {_HOST} AS key FROM pages)
), urls AS (
  SELECT key, ('0x' || substr(md5(key), 1, 4))::INT AS h FROM (SELECT DISTINCT 'url:' || url AS key FROM pages)
), entries AS (
  SELECT key, 'hosts' AS list, DATE '2024-01-01' + ((h // 16) % 180)::INT AS day, true AS listed FROM hosts WHERE h % 4 = 0
  UNION ALL SELECT key, 'hosts', DATE '2024-01-01' + ((h // 16) % 180 + 60)::INT, false FROM hosts WHERE h % 8 = 0
  UNION ALL SELECT key, 'hosts', DATE '2024-01-01' + ((h // 16) % 180 + 120)::INT, true FROM hosts WHERE h % 16 = 0
  UNION ALL SELECT key, 'urls', DATE '2024-01-01' + ((h // 32) % 366)::INT, true FROM urls WHERE h % 32 = 0
), last AS (
  SELECT n.page_id, n.key, e.list, max(e.day) AS day FROM named n JOIN entries e ON n.key = e.key AND e.day <= n.fetch_day GROUP BY ALL
), held AS (
  SELECT l.page_id, l.key, l.day FROM last l JOIN entries e ON l.key = e.key AND l.list = e.list AND l.day = e.day WHERE e.listed
)
SELECT c.page_id, any_value(c.fetch_day) AS fetch_day, count(h.key)::BIGINT AS n_lists, min(h.key) AS matched_key, min(h.day) AS listed_since
FROM captures c LEFT JOIN held h ON c.page_id = h.page_id GROUP BY c.page_id
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op11_collocations"] = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), spelled AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (
  SELECT lang, unnest([{{'x': w[i], 'y': w[i + 1], 'z': w[i + 2]}} for i in range(1, len(w) + 1)], recursive := true) FROM spelled
), f1 AS MATERIALIZED (
  SELECT lang, x, count(*)::HUGEINT AS a FROM starts GROUP BY ALL
), f2 AS MATERIALIZED (
  SELECT lang, x, y, count(*)::HUGEINT AS a FROM starts WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), f3 AS MATERIALIZED (
  SELECT lang, x, y, z, count(*)::HUGEINT AS a FROM starts WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f1 GROUP BY lang
), cuts AS (
  SELECT c.lang, c.x || ' ' || c.y AS phrase, 1 AS j, c.a, l.a AS l, r.a AS r
  FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f1 r ON r.lang = c.lang AND r.x = c.y
  UNION ALL
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, 1, c.a, l.a, r.a
  FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f2 r ON r.lang = c.lang AND r.x = c.y AND r.y = c.z
  UNION ALL
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, 2, c.a, l.a, r.a
  FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.x = c.x AND l.y = c.y JOIN f1 r ON r.lang = c.lang AND r.x = c.z
), scored AS (
  SELECT *, (1000000::HUGEINT * a * a) // (l * r) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY (1000000::HUGEINT * a * a) // (l * r), j) = 1
), covered AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, x || ' ' || y AS phrase, a FROM f3 UNION ALL SELECT lang, y || ' ' || z, a FROM f3
  ) GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN covered c ON s.lang = c.lang AND s.phrase = c.phrase WHERE c.longer IS NULL OR 100 * c.longer < 50 * s.a
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
