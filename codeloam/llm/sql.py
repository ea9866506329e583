"""DuckDB statements that give the rows of the queries in SQL."""

SQL: dict[str, str] = {}

_WINDOWS = """
WITH t AS (SELECT DISTINCT file_id, coalesce(full_content, content_preview, '') AS x FROM detailed_files),
p AS (SELECT file_id, unnest(range(1, length(x) - 298)) AS i, x FROM t WHERE length(x) >= 300),
w AS (SELECT file_id, i, md5(substr(x, i, 300)) AS h FROM p)"""

SQL["p2_found"] = _WINDOWS + """
SELECT DISTINCT a.file_id AS file_id_a, b.file_id AS file_id_b
FROM (SELECT DISTINCT file_id, h FROM w) a JOIN (SELECT DISTINCT file_id, h FROM w) b ON a.h = b.h AND a.file_id < b.file_id"""

SQL["p2_shared"] = _WINDOWS + """,
s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT file_id) > 1),
c AS (SELECT file_id, least(300, coalesce(lead(i) OVER (PARTITION BY file_id ORDER BY i) - i, 300)) AS n FROM w SEMI JOIN s USING (h)),
k AS (SELECT file_id, sum(n) AS n FROM c GROUP BY file_id)
SELECT t.file_id, CAST(length(t.x) AS BIGINT) AS n_chars, CAST(coalesce(k.n, 0) AS BIGINT) AS shared_chars FROM t LEFT JOIN k USING (file_id)"""

SQL["p2_classes"] = _WINDOWS + """,
m AS (SELECT file_id, min(file_id) OVER (PARTITION BY md5(x)) AS class_id, count(*) OVER (PARTITION BY md5(x)) AS copies FROM t WHERE length(x) >= 300),
v AS (SELECT DISTINCT class_id, h FROM w JOIN m USING (file_id)),
k AS (SELECT a.class_id, count(DISTINCT b.class_id) AS links FROM v a JOIN v b ON a.h = b.h AND a.class_id <> b.class_id GROUP BY a.class_id)
SELECT file_id, class_id, copies, coalesce(links, 0) AS links FROM m LEFT JOIN k USING (class_id)"""

SQL["p7_found"] = """
WITH RECURSIVE t AS (
  SELECT DISTINCT file_id, full_content AS x FROM detailed_files
  WHERE extension IN ('.py', '.js', '.ts', '.java', '.go', '.c') AND length(full_content) > 4000),
cut AS (
  SELECT file_id, x, 0 AS s, CAST(NULL AS BIGINT) AS e FROM t
  UNION ALL
  SELECT file_id, x, e - 200, e FROM (
    SELECT file_id, x, s, s + 2000 + CASE
      WHEN regexp_matches(z, '\n\n') THEN length(regexp_extract(z, '(?s)^.*\n\n')) - 1
      WHEN regexp_matches(z, '(?s)^.+\n') THEN length(regexp_extract(z, '(?s)^.+\n')) - 1
      WHEN regexp_matches(z, '(?s)^.+ ') THEN length(regexp_extract(z, '(?s)^.+ ')) - 1
      ELSE 2000 END AS e
    FROM (SELECT file_id, x, s, substr(x, s + 2000, 2001) AS z FROM cut WHERE length(x) - s > 4000)) q)
SELECT file_id, CAST(s AS INTEGER) AS start_char,
  CAST(CASE WHEN length(x) - s <= 4000 THEN length(x) ELSE 200 + lead(s) OVER (PARTITION BY file_id ORDER BY s) END AS INTEGER) AS end_char
FROM cut"""

SQL["p9_found"] = """
WITH w AS (
  SELECT 0 AS side, doc_id AS id, list_transform(regexp_extract_all(text, '[\\pL\\pN]+'), lambda x: lower(x)) AS ws FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 1, item_id, list_transform(regexp_extract_all(text, '[\\pL\\pN]+'), lambda x: lower(x)) FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT side, id, ws, unnest(range(1, len(ws) - 10)) AS i FROM w WHERE len(ws) >= 12),
g AS (SELECT DISTINCT side, id, array_to_string(ws[i : i + 11], ' ') AS g FROM p)
SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM g a JOIN g b ON a.g = b.g WHERE a.side = 0 AND b.side = 1"""
