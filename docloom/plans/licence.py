"""Queries of the licence fields, and their DuckDB oracles: plain rules over every label and every token of an image."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import licence
from docloom.plans.base import add
from docloom.runtime import materialize
from docloom.sources import licence_frames  # noqa: F401  (defines the frames)


def _values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") {names}"


def _without(text: str, words: list[str]) -> str:
    for word in sorted(words, key=lambda x: -len(x)):
        text = f"replace({text}, '{word}', '')"
    return text


_HAN = "length(regexp_replace({x}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g'))"
_K = "regexp_replace(upper(coalesce(text, '')), '[^0-9A-Z\\x{4e00}-\\x{9fff}]', '', 'g')"
_NO = lambda x, words: " AND ".join(f"NOT contains({x}, '{w}')" for w in words)
_PLATE = "CASE WHEN strpos('{p}', left({{x}}, 1)) > 0 AND regexp_full_match(substring({{x}}, 2), '[A-Z][A-HJ-NP-Z0-9]{{{{5,6}}}}') THEN 0 WHEN {{x}} <> '' AND strpos('{p}', left({{x}}, 1)) > 0 AND regexp_full_match(substring({{x}}, 2), '[A-Z0-9]{{{{2,7}}}}') THEN 1 END".format(p=licence.PROVINCES)


def _form(x: str, raw: str) -> str:
    """Whether {x} has the form of a driver's ``field``."""
    date = f"regexp_full_match({x}, '\\d{{8}}') OR regexp_full_match(trim({raw}), '\\d{{4}}\\D+\\d{{1,2}}\\D+\\d{{1,2}}')"
    han = _HAN.format(x=x)
    return f"""coalesce(CASE field WHEN 'certificate_number' THEN regexp_full_match({x}, '\\d{{14,17}}[0-9X]') WHEN 'name' THEN {han} BETWEEN 2 AND 6 AND {_NO(x, licence.NOT_NAMES)} WHEN 'sex' THEN {x} IN ('男', '女')
      WHEN 'nationality' THEN {x} IN ('中', '中国', 'CHN', '中CHN', '中国CHN') WHEN 'address' THEN {han} >= 3 AND {_NO(x, licence.NOT_ADDRESSES)} WHEN 'birth_date' THEN {date} WHEN 'first_issue_date' THEN {date}
      WHEN 'vehicle_class' THEN regexp_full_match({x}, '[ABC]\\d[A-Z]?|[DEFMNP]') WHEN 'valid_period' THEN {x} = '长期' OR len(regexp_extract_all({raw}, '\\d')) >= 6 WHEN 'archive_number' THEN regexp_full_match({x}, '\\d{{8,16}}') END, false)"""


#: Labels and their lines: nearest first, over all pairs of a label and a token of an image.
_LINES = """,
l AS (SELECT group_id, token_index, k, score, "left", top, "right", bottom, field, alias FROM u JOIN a ON contains(k, alias) QUALIFY row_number() OVER (PARTITION BY group_id, token_index ORDER BY length(alias) DESC, pos) = 1),
f AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM a WHERE contains(k, alias))),
p AS (SELECT l.group_id, l.field, l.token_index AS li, f.token_index, f.k, f.text, f.score, f."left", f.top, f."right", f.bottom, l."right" - l."left" >= l.bottom - l.top AS flat,
  greatest(0, greatest(l.top, f.top) - least(l.bottom, f.bottom)) AS gy, greatest(0, greatest(l."left", f."left") - least(l."right", f."right")) AS gx,
  least(l.bottom - l.top, f.bottom - f.top) AS sy, least(l."right" - l."left", f."right" - f."left") AS sx FROM l JOIN f ON l.group_id = f.group_id),
n AS (SELECT * FROM p WHERE CASE WHEN flat THEN gy <= 1.5 * greatest(1, sy) ELSE gx <= 1.5 * greatest(1, sx) END AND {fits}
  QUALIFY row_number() OVER (PARTITION BY group_id, field, li ORDER BY {order} CASE WHEN flat THEN 3 * gy + gx ELSE 3 * gx + gy END, token_index) = 1)"""
_BOX = '"left", top, "right", bottom'

DRIVER = f""",
a AS (SELECT * FROM {_values([(f, x, i) for i, (f, x) in enumerate(licence.LABELS['driver'])], 'a(field, alias, pos)')}),
u AS MATERIALIZED (SELECT * FROM (SELECT *, {_K} AS k FROM driver_tokens) WHERE k <> '' AND (regexp_matches(k, '{'|'.join(licence.MARKERS['driver'])}') OR regexp_full_match(k, '\\d{{10,18}}') OR regexp_matches(k, '\\d{{8}}')
  OR regexp_full_match(k, '[ABC]\\d[A-Z]?|[DEFMNP]') OR k IN ('男', '女', '中国', '中国CHN') OR coalesce(score, 0) >= 0.8 AND {_HAN.format(x='k')} > 0))""" + _LINES.format(fits=_form("k", "text"), order="") + f""",
r AS (SELECT *, substring(k, strpos(k, alias) + length(alias)) AS rest FROM l),
v1 AS (SELECT group_id, field, 'inline' AS basis, token_index, rest AS value, score, {_BOX} FROM r WHERE rest <> '' AND {_form('rest', 'rest')} UNION ALL SELECT DISTINCT group_id, field, 'near', token_index, k, score, {_BOX} FROM n),
i AS (SELECT group_id, CASE WHEN regexp_full_match(k, '\\d{{14,17}}[0-9X]') THEN 'certificate_number' WHEN regexp_full_match(k, '\\d{{10,13}}[0-9X]') THEN 'archive_number' WHEN regexp_full_match(k, '[ABC]\\d[A-Z]?|[DEFMNP]') THEN 'vehicle_class' END AS field, 'inferred' AS basis, token_index, k, score, {_BOX} FROM f),
v2 AS (SELECT * FROM v1 UNION ALL SELECT * FROM i WHERE field IS NOT NULL AND (group_id, field, token_index) NOT IN (SELECT (group_id, field, token_index) FROM v1) AND (field <> 'certificate_number' OR group_id NOT IN (SELECT group_id FROM v1 WHERE field = 'certificate_number'))),
w AS (SELECT group_id, field, 'fallback' AS basis, token_index, k, score, {_BOX} FROM (SELECT *, 'address' AS field FROM f) WHERE {_form('k', 'text')} AND group_id NOT IN (SELECT group_id FROM v2 WHERE field = 'address') QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY length(k) DESC, token_index) = 1),
assigned AS MATERIALIZED (SELECT * FROM v2 UNION ALL SELECT * FROM w UNION ALL SELECT group_id, field, 'label', token_index, alias, score, {_BOX} FROM l)"""

_ASCII = [x for _, x in licence.LABELS["vehicle"] if x.isascii()]
_CJK = [x for _, x in licence.LABELS["vehicle"] if not x.isascii()]
_FREE = f"""{_without('k', licence.PRINTED)} <> '' AND NOT ({' OR '.join(f"contains('{x}', k)" for x in _CJK)}) AND NOT (length(k) > 1 AND ({' OR '.join(f"starts_with('{x}', k)" for x in _ASCII)}))
  AND (field <> 'address' OR length(k) > 1) AND (field <> 'plate_number' OR {_PLATE.format(x='k')} IS NOT NULL)"""
_OWN = " ".join(f"WHEN '{f}' THEN {_without('tail', [x for g, x in licence.LABELS['vehicle'] if g == f])}" for f in licence.ACTIONABLE["vehicle"])
VEHICLE = f""",
a AS (SELECT * FROM {_values([(f, x, i) for i, (f, x) in enumerate(licence.LABELS['vehicle'])], 'a(field, alias, pos)')}),
u AS MATERIALIZED (SELECT * FROM (SELECT *, {_K} AS k FROM vehicle_tokens) WHERE k <> '' AND (regexp_matches(k, '{'|'.join(licence.MARKERS['vehicle'])}') OR regexp_full_match(k, '[A-HJ-NPR-Z0-9]{{12,18}}') OR regexp_full_match(k, '[\\x{{4e00}}-\\x{{9fff}}][A-Z][A-Z0-9]{{4,7}}')
  OR regexp_matches(k, '\\d{{8}}') OR regexp_matches(k, '\\d(KG|人)$') OR regexp_matches(k, '\\d{{3,5}}X\\d{{3,5}}X\\d{{3,5}}') OR coalesce(score, 0) >= 0.8 AND {_HAN.format(x='k')} > 0))""" + _LINES.format(fits=_FREE, order=f"CASE WHEN field = 'plate_number' THEN {_PLATE.format(x='k')} ELSE 0 END,") + f""",
r AS (SELECT *, CASE field {_OWN} END AS rest FROM (SELECT *, substring(k, strpos(k, alias) + length(alias)) AS tail FROM l)),
v1 AS (SELECT group_id, field, 'inline' AS basis, token_index, rest AS value, score, {_BOX} FROM r WHERE {_without('rest', licence.PRINTED)} <> '' UNION ALL SELECT DISTINCT group_id, field, 'near', token_index, k, score, {_BOX} FROM n),
assigned AS MATERIALIZED (SELECT * FROM v1 UNION ALL SELECT group_id, 'plate_number', 'inferred', token_index, k, score, {_BOX} FROM f WHERE {_PLATE.format(x='k')} = 0 AND (group_id, token_index) NOT IN (SELECT (group_id, token_index) FROM v1 WHERE field = 'plate_number')
  UNION ALL SELECT group_id, field, 'label', token_index, alias, score, {_BOX} FROM l)"""

_SHOW = 'SELECT group_id, field, basis, token_index, value, round(score, 6) AS score, "left", top, "right", bottom FROM assigned'
add("assign_driver_fields", ("driver_tokens",), lambda t: licence.assign_fields(t, "driver"), f"{DRIVER} {_SHOW}")
add("assign_vehicle_fields", ("vehicle_tokens",), lambda t: licence.assign_fields(t, "vehicle"), f"{VEHICLE} {_SHOW}")

#: Regions of the assigned fields; text heights are the shorter side.
_DATES = "len(regexp_extract_all(value, '\\d{4}\\D?\\d{1,2}\\D?\\d{1,2}'))"
_COUNT = "length(regexp_replace({x}, '\\D', '', 'g'))"
DRIVER_REGIONS = f""",
b AS (SELECT *, basis = 'label' AS l, basis <> 'label' AND (field = 'address' AND length(value) < 5 OR field = 'valid_period' AND value <> '长期' AND {_DATES} < 2) AS short,
  field = 'valid_period' AND regexp_matches(value, '[至到]') AND {_COUNT.format(x="regexp_extract(value, '^([^至到]*)', 1)")} < 8 AND {_COUNT.format(x="regexp_extract(value, '[至到](.*)$', 1)")} >= 8 AS ends,
  basis <> 'label' AND coalesce(score, 0) >= 0.98 AND (field = 'address' AND length(value) > 7 OR field = 'valid_period' AND {_COUNT.format(x='value')} > 15 OR field = 'certificate_number' AND regexp_full_match(value, '\\d{{14,17}}[0-9X]')) AS readable
  FROM assigned x WHERE basis <> 'label' OR NOT EXISTS (SELECT 1 FROM assigned y WHERE y.group_id = x.group_id AND y.field = x.field AND y.basis <> 'label')),
z AS (SELECT *, greatest(1, "right" - "left") >= greatest(1, bottom - top) AS flat, 8 * least(greatest(1, "right" - "left"), greatest(1, bottom - top)) AS far FROM b),
regions AS MATERIALIZED (SELECT group_id, field, token_index, 'here' AS side, {_BOX}, CASE WHEN l OR short THEN 1.5 ELSE 0.5 END AS padding, readable FROM z
  UNION ALL SELECT group_id, field, token_index, 'after', CASE WHEN flat THEN "right" ELSE "left" END, CASE WHEN flat THEN top ELSE bottom END, CASE WHEN flat THEN "right" + far ELSE "right" END, CASE WHEN flat THEN bottom ELSE bottom + far END, 0.5, readable FROM z WHERE short AND NOT ends
  UNION ALL SELECT group_id, field, token_index, 'before', CASE WHEN flat THEN "left" - far ELSE "left" END, CASE WHEN flat THEN top ELSE top - far END, CASE WHEN flat THEN "left" ELSE "right" END, CASE WHEN flat THEN bottom ELSE top END, 0.5, readable FROM z WHERE short AND ends)"""
VEHICLE_REGIONS = f""",
regions AS MATERIALIZED (SELECT group_id, field, token_index, 'here' AS side, {_BOX}, 1.5 AS padding, false AS readable FROM assigned x
  WHERE basis <> 'label' OR NOT EXISTS (SELECT 1 FROM assigned y WHERE y.group_id = x.group_id AND y.field = x.field AND y.basis <> 'label'))"""
_SHOW_REGIONS = 'SELECT group_id, field, token_index, side, "left", top, "right", bottom, CAST(padding AS DOUBLE) AS padding, readable FROM regions'
add("driver_regions", ("driver_tokens",), lambda t: licence.field_regions(licence.assign_fields(t, "driver"), "driver"), f"{DRIVER}{DRIVER_REGIONS} {_SHOW_REGIONS}")
add("vehicle_regions", ("vehicle_tokens",), lambda t: licence.field_regions(licence.assign_fields(t, "vehicle"), "vehicle"), f"{VEHICLE}{VEHICLE_REGIONS} {_SHOW_REGIONS}")

#: Measures by image, token and kind of field, as thousandths; every 17th region has none.
_M = "(group_id * {a} + token_index * {b} + length(field) * {c} + length(side)) % {m}"
_MEASURES = {"overlap": _M.format(a=7, b=11, c=3, m=120), "contiguous": _M.format(a=5, b=13, c=2, m=110), "texture": "150 + " + _M.format(a=3, b=7, c=5, m=60), "texture_contiguous": "70 + " + _M.format(a=11, b=3, c=7, m=20), "brighter": "1000 * (5 + " + _M.format(a=13, b=5, c=11, m=20) + ")"}
_FLAGS = {"linked": _M.format(a=2, b=3, c=1, m=3) + " = 0", "solid": _M.format(a=3, b=1, c=2, m=2) + " = 0"}
_MEASURED = f"SELECT group_id, field, token_index, side, {', '.join(f'CAST({e} AS DOUBLE) / 1000 AS {n}' for n, e in _MEASURES.items())}, {', '.join(f'{e} AS {n}' for n, e in _FLAGS.items())} FROM {{regions}} WHERE (group_id + token_index) % 17 <> 0"


def _covered(tokens, profile):
    regions = materialize(licence.field_regions(licence.assign_fields(tokens, profile), profile))
    keys = regions.select("group_id", "field", "token_index", "side")
    measures = keys.where((F.col("group_id") + F.col("token_index")) % 17 != 0).select(
        "*", *[(F.expr(e).cast("double") / 1000).alias(n) for n, e in _MEASURES.items()], *[F.expr(e).alias(n) for n, e in _FLAGS.items()]
    )
    return licence.covered_fields(regions, measures, profile)


_SEEN = """,
m AS (SELECT r.*, overlap, contiguous, texture, texture_contiguous, linked, brighter, solid FROM regions r LEFT JOIN (""" + _MEASURED.format(regions="regions") + """) q ON q.group_id = r.group_id AND q.field = r.field AND q.token_index = r.token_index AND q.side = r.side),
g AS (SELECT group_id, field, count(overlap) AS n_boxes, count(*) FILTER ({high}) > 0 AS highlight, count(*) FILTER ({wash}) > 0 AS washout, count(*) FILTER (readable) > 0 AS readable FROM m GROUP BY 1, 2)
SELECT *, field IN ({fields}) AND (highlight OR washout AND NOT readable) AS covered FROM g"""
add("driver_field_glare", ("driver_tokens",), lambda t: _covered(t, "driver"), DRIVER + DRIVER_REGIONS + _SEEN.format(
    high="overlap >= 0.08 AND contiguous >= 0.03 AND solid", fields="'certificate_number', 'address', 'valid_period'",
    wash="texture >= 0.18 AND texture_contiguous >= 0.08 AND (overlap >= 0.001 AND linked OR overlap >= 0.03 AND contiguous >= 0.015 AND brighter >= 15)"))
add("vehicle_field_glare", ("vehicle_tokens",), lambda t: _covered(t, "vehicle"), VEHICLE + VEHICLE_REGIONS + _SEEN.format(
    high="overlap >= 0.08 AND contiguous >= 0.08 AND solid", fields="'plate_number', 'owner', 'address', 'vin', 'engine_number'",
    wash="overlap >= 0.01 AND contiguous >= 0.003 AND texture >= 0.18 AND texture_contiguous >= 0.08 AND linked"))
