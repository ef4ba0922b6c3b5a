"""Queries of the reconciliation of two sources, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import fusion, idpages
from docloom.plans.base import ORACLES, QUERIES, add, rounded
from docloom.plans.repairs import _KEY
from docloom.sources import fusion_frames  # noqa: F401  (defines the frames)
from docloom.sources.frames import frame, with_frames

LABELS = [("name", "Name"), ("plate", "Plate No."), ("plate_number", "Plate No."), ("vin", "VIN"), ("class", "Class"), ("total", "Total"), ("curb", "Curb")]
_VALUES = "(VALUES " + ", ".join(f"('{f}', '{a.upper().replace(' ', '').replace('.', '')}')" for f, a in LABELS) + ") a(field, alias)"


def _labels(spark):
    return spark.createDataFrame(LABELS, "field string, alias string")


def _keys(values):
    return values.select("case_id", "record_id", "record_pos", F.when(F.col("field").isin("vin", "plate", "plate_number"), F.col("value")).alias("key"))


#: Evidence of (record_id, field, value, k) of {c} near labels, over the pages (record_id, group_id) of {ev}: as {x}_page. The
#: values of these frames are equal to a window, differ in one place, or are of no use, so similarity is that of places.
NEAR = f""",
t AS MATERIALIZED (SELECT *, {_KEY.format(x="text")} AS key, greatest(1, bottom - top) AS h FROM fusion_tokens),
l AS (SELECT group_id, field, token_index AS li, score AS ls, "left" AS ll, top AS lo, "right" AS lr, bottom AS lb, h, key <> alias AS inline FROM t JOIN {_VALUES} ON starts_with(key, alias)),
near AS MATERIALIZED (SELECT l.group_id, l.field, li, ls, token_index, key, score FROM l JOIN t ON l.group_id = t.group_id AND (token_index <> li OR inline) AND (token_index = li OR key NOT IN (SELECT alias FROM {_VALUES}))
  WHERE token_index = li OR (abs((top + bottom) / 2 - (lo + lb) / 2) <= 1.1 * greatest(l.h, t.h) AND "right" >= ll - 2 * l.h AND "left" <= lr + 30 * l.h)
    OR (top >= lo - 0.5 * l.h AND top - lb <= 6 * l.h AND "right" >= ll - 3 * l.h AND "left" <= lr + 18 * l.h) OR token_index - li BETWEEN -3 AND 6),
w AS MATERIALIZED (SELECT group_id, field, li, ls, string_agg(key, '' ORDER BY token_index) AS stream FROM near GROUP BY 1, 2, 3, 4),
span AS (SELECT *, coalesce(sum(length(key)) OVER (PARTITION BY group_id, field, li ORDER BY token_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start FROM near)"""
_DIFFER = "len(list_filter(range(1, length(k) + 1), lambda i: substring(stream, CAST(pos AS BIGINT) + i - 1, 1) <> k[i]))"
SEEN = f""",
{{x}}_tried AS (SELECT c.*, w.group_id, li, ls, stream, pos, {_DIFFER} AS d FROM {{c}} c JOIN {{ev}} e ON e.record_id = c.record_id JOIN w ON w.group_id = e.group_id AND w.field = c.field, unnest(range(1, length(stream) - length(k) + 2)) AS x(pos) WHERE length(k) > 1),
{{x}}_hit AS (SELECT record_id, field, value, k, group_id, li, ls, substring(stream, CAST(pos AS BIGINT), length(k)) AS found, pos, d FROM {{x}}_tried WHERE d <= 1 AND (d = 0 OR length(k) >= 7) QUALIFY row_number() OVER (PARTITION BY record_id, field, value, group_id, li ORDER BY d, pos) = 1),
{{x}}_many AS (SELECT h.record_id, h.field, value, k, h.group_id, h.li, h.ls, found, 1 - d / length(k) AS sim, min(score) AS conf FROM {{x}}_hit h JOIN span s ON s.group_id = h.group_id AND s.field = h.field AND s.li = h.li AND s.start < pos + length(k) AND s.start + length(key) > pos GROUP BY ALL),
{{x}}_one AS (SELECT c.record_id, c.field, value, k, n.group_id, li, ls, k AS found, 1.0 AS sim, max(score) AS conf FROM {{c}} c JOIN {{ev}} e ON e.record_id = c.record_id JOIN near n ON n.group_id = e.group_id AND n.field = c.field AND length(k) = 1 AND n.key = k GROUP BY ALL),
{{x}}_page AS (SELECT *, count(DISTINCT found) OVER (PARTITION BY record_id, field, value, group_id) AS nf FROM (SELECT * FROM {{x}}_many UNION ALL SELECT * FROM {{x}}_one) QUALIFY row_number() OVER (PARTITION BY record_id, field, value, group_id ORDER BY sim DESC, coalesce(conf, 0) DESC, coalesce(ls, 0) DESC, found DESC) = 1)"""

# --- which pages speak for which record --------------------------------------------------------

#: {v} are the values, {ev} the result; plain nested loops within a case.
SPOKEN = """,
{ev}_r AS (SELECT DISTINCT case_id, record_id, record_pos FROM {v}),
{ev}_n AS (SELECT r.case_id, r.n, p.n AS m FROM (SELECT case_id, count(*) AS n FROM {ev}_r GROUP BY 1) r JOIN (SELECT case_id, count(*) AS n FROM fusion_pages GROUP BY 1) p USING (case_id)),
{ev}_s AS (SELECT group_id, string_agg(replace(text, ' ', ''), '' ORDER BY token_index) AS s FROM fusion_tokens GROUP BY 1),
{ev}_k AS (SELECT DISTINCT v.record_id, p.group_id FROM {v} v JOIN {ev}_n n ON n.case_id = v.case_id AND n.n > 1 JOIN fusion_pages p ON p.case_id = v.case_id JOIN {ev}_s s ON s.group_id = p.group_id
  WHERE v.field IN ('vin', 'plate', 'plate_number') AND replace(value, ' ', '') <> '' AND contains(s, replace(value, ' ', ''))),
{ev} AS (SELECT record_id, group_id, 'only record' AS basis FROM {ev}_r JOIN {ev}_n USING (case_id) JOIN fusion_pages USING (case_id) WHERE n = 1 UNION ALL SELECT *, 'key' FROM {ev}_k
  UNION ALL SELECT r.record_id, p.group_id, 'position' FROM {ev}_r r JOIN {ev}_n n ON n.case_id = r.case_id AND n > 1 AND n = m JOIN fusion_pages p ON p.case_id = r.case_id AND page_pos = record_pos WHERE record_id NOT IN (SELECT record_id FROM {ev}_k))"""
add("restrict_evidence", ("fusion_values", "fusion_pages", "fusion_tokens"), lambda v, p, t: fusion.restrict_evidence(_keys(v), p, t), SPOKEN.format(v="fusion_values", ev="ev") + " SELECT * FROM ev")


# --- comparison without labels ------------------------------------------------------------------

def _fulltext(values, pages, tokens):
    """Plates and vehicle numbers against the pages that may speak for the record."""
    claims = values.where(F.col("field").isin("plate", "vin", "name")).select("record_id", "field", "value")
    return fusion.compare_fulltext(claims, fusion.restrict_evidence(_keys(values), pages, tokens), tokens).drop("n_candidates")


add("compare_fulltext", ("fusion_values", "fusion_pages", "fusion_tokens"), _fulltext, SPOKEN.format(v="fusion_values", ev="ev") + f""",
c AS (SELECT DISTINCT record_id, field, value, {_KEY.format(x="value")} AS k FROM fusion_values WHERE field IN ('plate', 'vin', 'name') AND {_KEY.format(x="value")} <> ''),
tk AS (SELECT group_id, token_index, score, {_KEY.format(x="text")} AS key FROM fusion_tokens),
st AS (SELECT group_id, string_agg(key, '' ORDER BY token_index) AS stream FROM tk GROUP BY 1),
sp AS (SELECT *, coalesce(sum(length(key)) OVER (PARTITION BY group_id ORDER BY token_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start FROM tk),
tried AS (SELECT c.*, e.group_id, substring(stream, CAST(pos AS BIGINT), length(k)) AS found, pos, {_DIFFER} AS d FROM c JOIN ev e USING (record_id) JOIN st USING (group_id), unnest(range(1, length(stream) - length(k) + 2)) AS x(pos)),
hit AS (SELECT * FROM tried WHERE d <= CASE WHEN field = 'name' THEN 2 ELSE 1 END QUALIFY row_number() OVER (PARTITION BY record_id, field, value, group_id ORDER BY d, pos) = 1),
many AS (SELECT h.record_id, h.field, h.value, h.k, h.group_id, found, 1 - d / length(k) AS sim, avg(score) AS conf FROM hit h JOIN sp s ON s.group_id = h.group_id AND s.start < pos + length(k) AND s.start + length(key) > pos GROUP BY ALL),
best AS (SELECT * FROM many QUALIFY row_number() OVER (PARTITION BY record_id, field, value ORDER BY found = k DESC, sim DESC, coalesce(round(conf, 6), 0) DESC, group_id) = 1)
SELECT c.record_id, c.field, c.value, CASE WHEN found IS NULL THEN 'no evidence' WHEN found = c.k THEN 'consistent' ELSE 'conflict' END AS status, found, round(sim, 6) AS similarity, round(CAST(conf AS DOUBLE), 6) AS confidence, group_id
FROM c LEFT JOIN best b ON b.record_id = c.record_id AND b.field = c.field AND b.value = c.value""")

# --- supplements and the whole reconciliation ----------------------------------------------------

_VALID = "CASE kind WHEN 'plate' THEN regexp_full_match({x}, '京[A-Z][A-Z0-9]{{5,6}}') WHEN 'vin' THEN regexp_full_match({x}, '[0-9A-HJ-NPR-Z]{{17}}') WHEN 'class' THEN regexp_full_match({x}, '(A[1-3]|B[12]|C[1-6])[DEF]?|[DEFMNP]') WHEN 'mass' THEN regexp_full_match({x}, '[0-9]{{5}}KG') ELSE false END"
#: Blank fields of {v} in cases with one record, and the candidates that are taken, as s_taken.
SUPPLEMENT = f""",
s_alone AS (SELECT case_id FROM {{v}} GROUP BY 1 HAVING count(DISTINCT record_id) = 1),
s_c AS (SELECT v.record_id, v.field, v.kind, c.value, {_KEY.format(x="c.value")} AS k FROM {{v}} v JOIN s_alone USING (case_id) JOIN fusion_candidates c ON c.record_id = v.record_id AND c.field = v.field WHERE coalesce({_KEY.format(x="v.value")}, '') = ''),
s_ev AS (SELECT DISTINCT record_id, group_id, page_pos FROM {{v}} JOIN fusion_pages USING (case_id)){SEEN.format(x="s", c="s_c", ev="s_ev")},
s_best AS (SELECT p.*, kind FROM s_page p JOIN s_ev e ON e.record_id = p.record_id AND e.group_id = p.group_id JOIN s_c c ON c.record_id = p.record_id AND c.field = p.field WHERE found = p.k
  QUALIFY row_number() OVER (PARTITION BY p.record_id, p.field ORDER BY nf = 1 DESC, coalesce(conf, 0) DESC, coalesce(ls, 0) DESC, page_pos) = 1),
s_taken AS (SELECT record_id, field, value, group_id, conf AS confidence, ls AS label_score FROM s_best WHERE nf = 1 AND conf >= 0.97 AND ls >= 0.95 AND (kind NOT IN ('plate', 'vin', 'class', 'mass') OR {_VALID.format(x="k")}))"""
_FRAMES = ("fusion_values", "fusion_candidates", "fusion_pages", "fusion_tokens")
add("supplement_missing", _FRAMES, lambda v, c, p, t: fusion.supplement_missing(v, c, p, t, _labels(v.sparkSession)), NEAR + SUPPLEMENT.replace("{v}", "fusion_values") + " SELECT record_id, field, value, group_id, round(CAST(confidence AS DOUBLE), 6) AS confidence, round(CAST(label_score AS DOUBLE), 6) AS label_score FROM s_taken")


def _reconciled(spark, sf_dir):
    f = {name: frame(spark, sf_dir, name, customer="c_custkey") for name in ("fusion_values", "fusion_types", "fusion_candidates", "fusion_pages", "fusion_token_pages")}
    return fusion.reconcile_pages(f["fusion_values"], f["fusion_types"], f["fusion_candidates"], f["fusion_pages"], f["fusion_token_pages"], _labels(spark))


_STEPS = NEAR + f""",
v0 AS (SELECT * FROM fusion_values),
ty AS (SELECT v.record_id, v.field, coalesce(late, own, '') AS value, CASE WHEN late IS NOT NULL THEN 'latest page' ELSE 'first record' END AS detail FROM v0 v LEFT JOIN (SELECT case_id, arg_max(detected, page_pos) AS late FROM fusion_types WHERE detected <> '' GROUP BY 1) USING (case_id)
  LEFT JOIN (SELECT case_id, arg_min(value, record_pos) AS own FROM v0 WHERE field = 'type' AND value <> '' GROUP BY 1) USING (case_id) WHERE field = 'type'),
v1 AS MATERIALIZED (SELECT v.* REPLACE (coalesce(c.value, v.value) AS value) FROM v0 v LEFT JOIN ty c ON c.record_id = v.record_id AND c.field = v.field){SUPPLEMENT.replace('{v}', 'v1')},
v2 AS MATERIALIZED (SELECT v.* REPLACE (coalesce(c.value, v.value) AS value) FROM v1 v LEFT JOIN s_taken c ON c.record_id = v.record_id AND c.field = v.field){SPOKEN.format(v="v2", ev="ev")},
m_c AS (SELECT record_id, field, kind, value, {_KEY.format(x="value")} AS k FROM v2 WHERE field <> 'type' AND {_KEY.format(x="value")} <> '' AND NOT (field = 'plate_number' AND record_id IN (SELECT record_id FROM v2 WHERE field = 'plate' AND coalesce(value, '') <> ''))){SEEN.format(x="m", c="m_c", ev="ev")},
m_best AS (SELECT * FROM m_page QUALIFY row_number() OVER (PARTITION BY record_id, field ORDER BY found = k DESC, sim DESC, coalesce(conf, 0) DESC, group_id) = 1),
cf AS (SELECT b.*, kind, CASE WHEN kind NOT IN ('plate', 'vin', 'class', 'mass') THEN 'not overridable' WHEN nf > 1 THEN 'several candidates' WHEN coalesce(ls, 0) < 0.95 THEN 'label score'
  WHEN coalesce(conf, 0) < CASE WHEN {_VALID.format(x="b.k")} THEN 0.985 ELSE 0.97 END THEN 'value score' WHEN NOT {_VALID.format(x="found")} THEN 'format' ELSE '' END AS r0 FROM m_best b JOIN m_c c ON c.record_id = b.record_id AND c.field = b.field WHERE found <> b.k),
kg AS (SELECT record_id, max(TRY_CAST(regexp_extract(value, '[0-9]+', 0) AS INT)) FILTER (field = 'total') AS t, max(TRY_CAST(regexp_extract(value, '[0-9]+', 0) AS INT)) FILTER (field = 'curb') AS u FROM v2 GROUP BY 1),
tt AS (SELECT kg.record_id, u, CASE WHEN r0 = '' AND coalesce(CAST(found[:5] AS INT) >= u, true) THEN CAST(found[:5] AS INT) ELSE t END AS t FROM kg LEFT JOIN cf ON cf.record_id = kg.record_id AND field = 'total'),
dec AS (SELECT cf.*, CASE WHEN r0 <> '' THEN r0 WHEN field = 'total' AND CAST(found[:5] AS INT) < u OR field = 'curb' AND CAST(found[:5] AS INT) > tt.t THEN 'order of the record' ELSE 'other source' END AS reason FROM cf JOIN tt USING (record_id)),
ch AS (SELECT record_id, field, found AS value, 'conflict' AS detail FROM dec WHERE reason = 'other source' UNION ALL SELECT record_id, CASE field WHEN 'plate' THEN 'plate_number' ELSE 'plate' END, found, 'twin' FROM dec WHERE reason = 'other source' AND field IN ('plate', 'plate_number')),
v3 AS (SELECT v.* REPLACE (coalesce(c.value, v.value) AS value) FROM v2 v LEFT JOIN ch c ON c.record_id = v.record_id AND c.field = v.field),
cn AS (SELECT case_id, bool_or(contains(x, '中国')) AS seen FROM (SELECT case_id, text AS x FROM fusion_types UNION ALL SELECT case_id, coalesce(value, '') FROM v0) GROUP BY 1),
na AS (SELECT v.record_id, v.field, '中国' AS value, CASE WHEN v.value IN ('CHN', '中国') THEN 'value' WHEN coalesce(v.value, '') = '' AND seen THEN 'text' WHEN coalesce(v.value, '') = '' AND a.value <> 'Main street 3' THEN 'address' ELSE '' END AS detail FROM v3 v JOIN cn USING (case_id) JOIN v3 a ON a.record_id = v.record_id AND a.field = 'address' WHERE v.field = 'nationality'),
v4 AS (SELECT v.* REPLACE (coalesce(c.value, v.value) AS value) FROM v3 v LEFT JOIN na c ON c.record_id = v.record_id AND c.field = v.field AND detail <> '')"""
_ALL = with_frames("fusion_values", "fusion_types", "fusion_candidates", "fusion_pages", "fusion_tokens") + _STEPS
QUERIES["reconcile_sources"] = lambda spark, sf_dir: _reconciled(spark, sf_dir)[0].select("record_id", "field", "value")
ORACLES["reconcile_sources"] = _ALL + " SELECT record_id, field, value FROM v4"
QUERIES["reconcile_audit"] = lambda spark, sf_dir: _reconciled(spark, sf_dir)[1]
ORACLES["reconcile_audit"] = _ALL + """,
lg AS (SELECT ty.*, v.value AS old, 'document type' AS rule FROM ty JOIN v0 v USING (record_id, field) UNION ALL SELECT s.record_id, s.field, s.value, 'page ' || s.group_id, v.value, 'supplement' FROM s_taken s JOIN v1 v USING (record_id, field)
  UNION ALL SELECT c.*, v.value, 'other source' FROM ch c JOIN v2 v USING (record_id, field) UNION ALL SELECT na.*, v.value, 'nationality' FROM na JOIN v3 v USING (record_id, field) WHERE detail <> '')
SELECT record_id, field, coalesce(old, '') AS old, value AS new, rule, detail FROM lg WHERE value <> coalesce(old, '')"""
QUERIES["settle_conflicts"] = lambda spark, sf_dir: rounded(_reconciled(spark, sf_dir)[2])
ORACLES["settle_conflicts"] = _ALL + """
SELECT d.record_id, d.field, d.value, found, round(sim, 6) AS similarity, round(CAST(conf AS DOUBLE), 6) AS confidence, round(CAST(ls AS DOUBLE), 6) AS label_score, nf = 1 AS is_unique, group_id, reason, reason = 'other source' AS changed FROM dec d"""

# --- pages of several holders ---------------------------------------------------------------------

add("attach_id_pages", ("holder_pages",), idpages.attach_id_pages, """,
p AS (SELECT * REPLACE (trim(name) AS name, coalesce(address, '') AS address) FROM holder_pages),
k AS (SELECT group_id, count(DISTINCT nullif(number, '')) AS ids, count(DISTINCT nullif(name, '')) AS names, min(nullif(number, '')) AS one, min(nullif(name, '')) AS called FROM p GROUP BY 1),
nm AS (SELECT group_id, name, min(number) AS number FROM p WHERE number <> '' AND name <> '' GROUP BY 1, 2 HAVING count(DISTINCT number) = 1),
att AS (SELECT p.group_id, page_pos, side_index, CASE WHEN p.number <> '' THEN p.number ELSE nm.number END AS holder, CASE WHEN p.number <> '' THEN 'number' ELSE 'name' END AS basis
  FROM p JOIN k ON k.group_id = p.group_id AND ids > 1 LEFT JOIN nm ON nm.group_id = p.group_id AND nm.name = p.name WHERE p.number <> '' OR nm.number IS NOT NULL)
SELECT p.group_id, page_pos, coalesce(one, called, '') AS holder, CASE WHEN ids = 1 THEN 'only number' ELSE 'only name' END AS basis FROM p JOIN k USING (group_id) WHERE ids = 1 OR ids = 0 AND names <= 1
UNION ALL SELECT p.group_id, page_pos, name, 'name group' FROM p JOIN k USING (group_id) WHERE ids = 0 AND names > 1 AND name <> '' UNION ALL SELECT group_id, page_pos, holder, basis FROM att
UNION ALL SELECT DISTINCT p.group_id, p.page_pos, att.holder, 'side' FROM p JOIN att ON att.group_id = p.group_id AND att.side_index = p.side_index WHERE side = 'back' AND NOT EXISTS (FROM att x WHERE x.group_id = p.group_id AND x.page_pos = p.page_pos AND x.holder = att.holder)""")
