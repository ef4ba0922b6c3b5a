"""Queries of the rules over whole documents, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import documents
from docloom.plans.base import add

add("diffuse_background", ("gate_metrics",), documents.diffuse_background, """
SELECT id, round(candidates / greatest(1, fields), 4) AS share, fields > 5 AND candidates > 3 AND 100 * candidates >= 65 * fields AND scored > 5 AND round(mean * 1000) >= 900 AND round(coalesce(p25, 0) * 1000) >= 820
  AND round(low_tokens * 1000) <= 100 AND round(low_chars * 1000) <= 100 AND low_under_glare = 0 AS suppressed FROM gate_metrics""")
add("streak_fallback", ("gate_metrics",), documents.streak_fallback, """,
d AS (SELECT id, round(glare * 1000) IN (15, 16, 17, 18, 19, 20, 21, 22, 23) AND streaks > 1 AND round(streak_ratio * 1000) >= 2 AND candidates > 1 AND round(overlap * 100) >= 8 AS detected FROM gate_metrics)
SELECT id, detected, CASE WHEN detected THEN 'multiple_streaks_crossing_text' END AS basis FROM d""")
add("document_gate", ("image_reports",), documents.document_gate, """,
g AS (SELECT group_id, count(*) FILTER (error <> '') AS e, coalesce(string_agg(side_label || ':' || code, ',' ORDER BY position) FILTER (code <> ''), '') AS i FROM image_reports GROUP BY 1)
SELECT group_id, CASE WHEN e > 0 THEN 'check failed' WHEN i <> '' THEN 'rejected' ELSE 'accepted' END AS verdict, CASE WHEN e > 0 THEN '' ELSE i END AS issues FROM g""")
add("order_identity_pages", ("card_pages",), documents.order_identity_pages, """,
k AS (SELECT c.group_id, page_pos, CASE WHEN m > 2 AND side <> 'back' THEN 2 ELSE 0 END + CASE WHEN starts_with(name, '方向') THEN 1 ELSE 0 END AS key FROM card_pages c JOIN (SELECT group_id, count(*) AS m FROM card_pages GROUP BY 1) g ON g.group_id = c.group_id)
SELECT a.group_id, a.page_pos, count(b.page_pos) AS place FROM k a LEFT JOIN k b ON a.group_id = b.group_id AND (b.key < a.key OR b.key = a.key AND b.page_pos < a.page_pos) GROUP BY 1, 2""")
add("merge_references", ("file_refs",), documents.merge_references, """,
r AS (SELECT group_id, material, name FROM file_refs QUALIFY row_number() OVER (PARTITION BY group_id, material, name ORDER BY position) = 1),
a AS (SELECT group_id, list(name ORDER BY position) AS l, list(material || '/' || name ORDER BY position) AS m FROM file_refs GROUP BY 1)
SELECT group_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]), ',') AS names,
  array_to_string(list_transform(list_filter(range(1, len(m) + 1), lambda i: list_position(m, m[i]) = i), lambda i: m[i]), ',') AS refs FROM a""")
add("adjacent_single", ("single_claims", "claim_pages"), documents.adjacent_single, """,
h AS (SELECT c.group_id, field, value, t.token_index, coalesce(t.score, 0) AS s FROM single_claims c JOIN claim_tokens t ON t.group_id = c.group_id AND upper(t.text) = value
  JOIN claim_tokens l ON l.group_id = c.group_id AND contains(upper(l.text), upper(field)) AND l.token_index BETWEEN t.token_index - 3 AND t.token_index - 1)
SELECT DISTINCT group_id, field, value, token_index, round(CAST(nullif(s, 0) AS DOUBLE), 6) AS confidence FROM h QUALIFY rank() OVER (PARTITION BY group_id, field, value ORDER BY s DESC, token_index DESC) = 1""", told=("single_claims", "claim_tokens"))
_SUB = "(length({a}) < length({b}) AND regexp_full_match({b}, '.*' || array_to_string(string_split({a}, ''), '.*') || '.*'))"
add("consensus_address", ("readings",), lambda r: documents.consensus_address(r.select("id", "current", F.split("listed", r"\|").alias("candidates"))), f""",
r AS (SELECT id, current, string_split(listed, '|') AS l, list_distinct(string_split(listed, '|')) AS d FROM readings),
b AS (SELECT id, x FROM (SELECT id, d, unnest(d) AS x FROM r WHERE len(d) > 1) WHERE len(list_filter(d, lambda y: y = x OR ({_SUB.format(a="x", b="y")} AND left(x, 8) = left(y, 8) AND right(x, 3) = right(y, 3)))) = len(d)),
u AS (SELECT id, min(x) AS x FROM b GROUP BY 1 HAVING count(*) = 1),
o AS (SELECT id, d[1] AS x FROM r WHERE len(d) = 1 AND (len(l) > 1 AND current = '' OR current = d[1] OR len(l) > 1 AND {_SUB.format(a="d[1]", b="current")} AND right(d[1], 4) = right(current, 4) OR regexp_matches(current, '号[0-9]{{2,4}}$') AND regexp_replace(current, '[0-9]{{2,4}}$', '') = d[1]))
SELECT r.id, coalesce(u.x, o.x, r.current) AS address FROM r LEFT JOIN u ON u.id = r.id LEFT JOIN o ON o.id = r.id""")
add("coordinates_to_table", ("spotted_boxes",), lambda s: s.select("id", documents.coordinates_to_table(F.col("raw")).alias("rendered")), """,
v AS (SELECT id, id % 30 AS d, c_name AS t1, c_mktsegment AS t2, c_name || '\\|' || id AS t3 FROM spotted_boxes JOIN customer ON c_custkey = id)
SELECT id, '| 字段 | 内容 |' || chr(10) || '| --- | --- |' || chr(10) || CASE WHEN id % 5 = 0 THEN '| 文字 | ' || t1 || ' |' || chr(10) || '| 文字 | ' || t2 || ' |'
  WHEN d <= 9 THEN '| ' || t2 || ' | ' || t1 || ' |' || chr(10) || '| ' || t3 || ' | [无法识别] |' || chr(10) || '| 文字 | loose |'
  WHEN d <= 14 THEN '| ' || t2 || ' | ' || t1 || ' |' || chr(10) || '| 文字 | ' || t3 || ' |' || chr(10) || '| 文字 | loose |'
  ELSE '| 文字 | ' || t1 || ' |' || chr(10) || '| 文字 | ' || t2 || ' |' || chr(10) || '| 文字 | ' || t3 || ' |' || chr(10) || '| 文字 | loose |' END AS rendered FROM v""")
