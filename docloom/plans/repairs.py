"""Queries of the repair and comparison rules, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import normalizers as n
from docloom.operators import applications, compare, holders, ingest, pages, recheck, vehicles
from docloom.plans.base import add

#: Lines of a text by number, and the dates of a list of lines, in SQL.
SQL_LINES = "list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
SQL_DAY = "regexp_replace({x}, '^\\s*(\\d{{4}})\\s*[-/.年]?\\s*(\\d{{1,2}})\\s*[-/.月]?\\s*(\\d{{1,2}})\\D*$', '\\1-\\2-\\3')"
SQL_DATE = "[0-9]{{4}}\\s*[-/.年]?\\s*[0-9]{{1,2}}\\s*[-/.月]?\\s*[0-9]{{1,2}}"


def sql_dates(lines: str) -> str:
    found = f"flatten(list_transform({lines}, lambda x: regexp_extract_all(x, '{SQL_DATE.format()}')))"
    return f"list_filter(list_transform({found}, lambda x: coalesce(strftime(try_strptime({SQL_DAY.format(x='x')}, '%Y-%m-%d'), '%Y%m%d'), '')), lambda d: d BETWEEN '19000101' AND '20991231')"


def sql_window(labels: list[str], before: int, after: int) -> str:
    """Lines ``l`` around those with a label."""
    has = lambda i: "(" + " OR ".join(f"contains(lower(l[{i}]), lower('{w}'))" for w in labels) + ")"
    return f"list_transform(list_filter(range(1, len(l) + 1), lambda i: len(list_filter(range(1, len(l) + 1), lambda j: j BETWEEN i - {after} AND i + {before} AND {has('j')})) > 0), lambda i: l[i])"


FORM = "regexp_replace(regexp_replace(replace(replace(upper(regexp_replace(line, '[\\s:：,，、.]+', '', 'g')), '准驾车型', ''), 'CLASS', ''), '^[\\[\\]]+|[\\[\\]]+$', '', 'g'), '^([BC])[IJL|]([DEFMNP]|$)', '\\11\\2')"
PERIOD, FIRST = sql_window(holders.LABELS["period"], 1, 5), sql_window(holders.LABELS["first_issue"], 0, 3)
add("refine_driver", ("licences",), holders.refine_driver, f""",
t AS (SELECT *, {SQL_LINES.format(text="text")} AS l FROM licences),
cut AS (SELECT id, generate_subscripts(p, 1) AS s, unnest(p) AS part FROM (SELECT id, string_split(replace(text, chr(10) || '[', chr(1) || '['), chr(1)) AS p FROM licences)),
part AS (SELECT id, s, part, {SQL_LINES.format(text="regexp_replace(part, '准驾车型代号规定[^☃]*$', '')")} AS l FROM cut),
ln AS (SELECT id, s, i, l[i] AS line, {FORM.replace("line", "l[i]")} AS form, contains(l[i], '准驾车型') OR lower(l[i]) = 'class' AS labelled,
  regexp_matches(l[i], '累积记分|初次领证日期|有效期限|出生日期|证号|姓名|住址|国籍|档案编号') AS other FROM (SELECT id, s, l, unnest(range(1, len(l) + 1)) AS i FROM part)),
f AS (SELECT *, regexp_full_match(form, '(A[123]|B[12]|C[1-6]|[DEFMNP]){{1,3}}') AS ok FROM ln),
near AS (SELECT a.id, a.s, a.i, arg_min(b.form, b.i) AS form FROM f a JOIN f b ON a.id = b.id AND a.s = b.s AND a.labelled AND b.i BETWEEN a.i - 2 AND a.i + 3 AND (b.i = a.i OR NOT b.other) AND b.ok GROUP BY 1, 2, 3),
alone AS (SELECT id, s, form FROM f WHERE ok AND regexp_matches(form, '^[ABC]') AND NOT labelled AND (id, s) IN (SELECT (id, s) FROM f WHERE labelled) AND (id, s) NOT IN (SELECT (id, s) FROM near)),
kind AS (SELECT id, CASE WHEN count(DISTINCT form) = 1 THEN min(form) ELSE '' END AS found FROM (SELECT id, form FROM near UNION ALL SELECT id, form FROM alone) GROUP BY 1),
arch AS (SELECT id, starts_with(part, '[局部') AS detail, unnest(regexp_extract_all(part, '\\b[0-9]{{12}}\\b')) AS a FROM part WHERE contains(part, '档案编号')),
archs AS (SELECT id, count(DISTINCT a) FILTER (NOT detail) AS w, min(a) FILTER (NOT detail) AS wa, count(DISTINCT a) FILTER (detail) AS d, min(a) FILTER (detail) AS da FROM arch GROUP BY 1),
ids AS (SELECT id, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS v FROM (SELECT id, unnest(regexp_extract_all(text, '\\b[1-9][0-9]{{16}}[0-9X]\\b')) AS v FROM licences)
  WHERE '10X98765432'[CAST(1 + list_sum(list_transform(range(1, 18), lambda i: CAST(v[i] AS INT) * [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2][i])) % 11 AS INT)] = v[18] GROUP BY 1),
p AS (SELECT id, {PERIOD} AS pl, {sql_dates(PERIOD)} AS d FROM t),
c AS (SELECT t.*, upper(regexp_replace(coalesce(class, ''), '[\\s,，、]+', '', 'g')) AS k, upper(replace(number, ' ', '')) AS no, regexp_replace(coalesce(archive, ''), '[^0-9]', '', 'g') AS ar, replace(regexp_replace(address, '[θΘ]([0-9]{{1,5}}号)', '0\\1'), ' ', '') AS ad FROM t)
SELECT c.id, CASE WHEN contains(no, '*') THEN coalesce(ids.v, no) ELSE no END AS number, regexp_replace(ad, '^(.+([0-9]+|[一二三四五六七八九十百]+)(组|号|室|户))江苏省.*$', '\\1') AS address,
  CASE WHEN regexp_full_match(k, '(A[123]|B[12]|C[1-6]|[DEFMNP]){{1,3}}') THEN k ELSE coalesce(kind.found, '') END AS class,
  CASE WHEN w = 1 THEN wa WHEN w > 1 THEN '' WHEN archs.d = 1 THEN da WHEN archs.d > 1 THEN '' WHEN length(ar) = 12 THEN ar ELSE '' END AS archive,
  CASE WHEN first_issue = '2009-02-03' THEN '20090203' ELSE coalesce({sql_dates(FIRST)}[1], '') END AS first_issue, CASE WHEN birth = '19800101' THEN birth ELSE '' END AS birth,
  CASE WHEN regexp_full_match(period, '[0-9]{{8}}-([0-9]{{8}}|长期)') THEN period WHEN contains(array_to_string(p.pl, ' '), '长期') AND len(p.d) > 0 THEN p.d[1] || '-长期' WHEN len(list_distinct(p.d)) > 1 THEN p.d[1] || '-' || list_filter(p.d, lambda x: x <> p.d[1])[1] ELSE '' END AS period,
  CASE WHEN sex = '男' THEN sex ELSE '' END AS sex
FROM c JOIN p ON p.id = c.id LEFT JOIN kind ON kind.id = c.id LEFT JOIN archs ON archs.id = c.id LEFT JOIN ids ON ids.id = c.id""")

MASS = "([0-9]{2,6}(\\.[0-9]+)?)\\s*(kg|KG|千克)"


def sql_mass(label: str) -> str:
    """Per section: behind the first labelled line's label, or on the nearest line without dimensions."""
    return f"""(SELECT a.id, a.s, coalesce(nullif(regexp_extract(split_part(a.line, '{label}', 2), '{MASS}', 1), ''), arg_min(b.m, CASE WHEN b.i < a.i THEN a.i - b.i ELSE 100 + b.i - a.i END)) AS m
  FROM ln a LEFT JOIN ln b ON a.id = b.id AND a.s = b.s AND b.i BETWEEN a.i - 4 AND a.i + 2 AND b.i <> a.i AND b.m <> '' WHERE contains(a.line, '{label}') GROUP BY a.id, a.s, a.line)"""


add("refine_masses_and_dates", ("mass_texts",), vehicles.refine_masses_and_dates, f""",
cut AS (SELECT id, generate_subscripts(p, 1) AS s, unnest(p) AS part FROM (SELECT id, string_split(replace(text, chr(10) || '[', chr(1) || '['), chr(1)) AS p FROM mass_texts)),
part AS (SELECT *, {SQL_LINES.format(text="part")} AS l FROM cut),
ln AS (SELECT id, s, i, l[i] AS line, CASE WHEN regexp_matches(l[i], '[0-9]{{3,5}}x[0-9]{{3,5}}') THEN '' ELSE regexp_extract(l[i], '{MASS}', 1) END AS m FROM (SELECT id, s, l, unnest(range(1, len(l) + 1)) AS i FROM part)),
ms AS (SELECT id, s, list(DISTINCT m) FILTER (m <> '') AS d, bool_or(contains(line, '总质量')) AND bool_or(contains(line, '整备质量')) AS labels FROM ln GROUP BY 1, 2),
mp AS (SELECT ms.id, CASE WHEN labels AND len(d) = 2 THEN list_transform(list_reverse_sort(list_transform(d, lambda x: struct_pack(v := CAST(x AS DOUBLE), x := x))), lambda z: z.x) WHEN CAST(t.m AS DOUBLE) >= CAST(c.m AS DOUBLE) THEN [t.m, c.m] END AS p
  FROM ms LEFT JOIN {sql_mass("总质量")} t ON t.id = ms.id AND t.s = ms.s LEFT JOIN {sql_mass("整备质量")} c ON c.id = ms.id AND c.s = ms.s),
mv AS (SELECT id, p[1] || 'kg' AS total, p[2] || 'kg' AS curb, count(*) AS n FROM mp WHERE p IS NOT NULL GROUP BY 1, 2, 3 QUALIFY n = max(n) OVER (PARTITION BY id)),
ma AS (SELECT id, count(*) AS k, min(total) AS total, min(curb) AS curb FROM mv GROUP BY 1),
seen AS (SELECT id, s, l, list_position(list_transform(l, lambda x: contains(x, '注册日期')), true) AS r, list_position(list_transform(l, lambda x: contains(x, '发证日期')), true) AS i FROM part),
dd AS (SELECT id, r, i, {sql_dates("l[least(r, i) : greatest(r, i) + 8]")} AS d FROM seen WHERE r > 0 AND i > 0),
dv AS (SELECT id, CASE WHEN r <= i THEN d[1] ELSE d[2] END AS registered, CASE WHEN r <= i THEN d[2] ELSE d[1] END AS issued, count(*) AS n FROM dd WHERE len(d) >= 2 GROUP BY 1, 2, 3 QUALIFY n = max(n) OVER (PARTITION BY id)),
da AS (SELECT id, count(*) AS k, min(registered) AS registered, min(issued) AS issued FROM dv GROUP BY 1),
w AS (SELECT h.*, CASE WHEN da.k = 1 THEN da.registered WHEN EXISTS (FROM dv WHERE dv.id = h.id AND dv.registered = h.registered AND dv.issued = h.issued) THEN h.registered END AS vr,
  CASE WHEN da.k = 1 THEN da.issued WHEN EXISTS (FROM dv WHERE dv.id = h.id AND dv.registered = h.registered AND dv.issued = h.issued) THEN h.issued END AS vi,
  CASE WHEN ma.k = 1 THEN ma.total END AS vt, CASE WHEN ma.k = 1 THEN ma.curb END AS vc, {SQL_LINES.format(text="text")} AS l FROM mass_texts h LEFT JOIN da ON da.id = h.id LEFT JOIN ma ON ma.id = h.id),
e AS (SELECT *, array_to_string({sql_window(vehicles.INSPECTION, 0, 3)}, ' ') AS x FROM w)
SELECT id, coalesce(vt, total) AS total, coalesce(vc, curb) AS curb,
  coalesce(vr, {sql_dates("list_transform(list_filter(l, lambda x: contains(x, '注册日期')), lambda x: split_part(x, '注册日期', 2))")}[1], registered) AS registered,
  coalesce(vi, {sql_dates("list_transform(list_filter(l, lambda x: contains(x, '发证日期')), lambda x: split_part(x, '发证日期', 2))")}[1], issued) AS issued,
  CASE WHEN contains(x, '2024年6月') THEN '202406' WHEN contains(x, '2024-13') THEN 'held' WHEN contains(x, '2026.7.8') THEN '20260708' WHEN contains(x, '2019-2-30') THEN '20190230' ELSE '20190203' END AS inspection FROM e""")

# --- two sources ----------------------------------------------------------------------------------

CLAIM_LABELS = [("name", "Name"), ("plate", "Plate No."), ("vin", "VIN"), ("class", "Class")]
_VALUES = "(VALUES " + ", ".join(f"('{f}', '{a.upper().replace(' ', '').replace('.', '')}')" for f, a in CLAIM_LABELS) + ") a(field, alias)"
_KEY = "upper(regexp_replace({x}, '[\\s:：,，.。·/\\\\_—()（）-]+', '', 'g'))"
_DIFFER = "len(list_filter(range(1, length(k) + 1), lambda i: substring(stream, CAST(pos AS BIGINT) + i - 1, 1) <> k[i]))"


def _compare(claims, tokens):
    spark = claims.sparkSession
    owned = tokens.select(F.floor(F.col("group_id") / 10).alias("record_id"), "group_id").distinct()
    return compare.compare_sources(claims, owned, tokens, spark.createDataFrame(CLAIM_LABELS, "field string, alias string"))


#: Claims of this frame are equal to their tokens, differ in one character, or have none in common, so the similarity is that of places.
add("compare_sources", ("claims", "claim_tokens"), _compare, f""",
t AS MATERIALIZED (SELECT *, {_KEY.format(x="text")} AS key, greatest(1, bottom - top) AS h FROM claim_tokens),
l AS (SELECT group_id, field, token_index AS li, score AS ls, "left" AS ll, top AS lo, "right" AS lr, bottom AS lb, h, key <> alias AS inline FROM t JOIN {_VALUES} ON starts_with(key, alias)),
near AS (SELECT l.group_id, l.field, li, ls, token_index, key, score FROM l JOIN t ON l.group_id = t.group_id AND (token_index <> li OR inline) AND (token_index = li OR key NOT IN (SELECT alias FROM {_VALUES}))
  WHERE token_index = li OR (abs((top + bottom) / 2 - (lo + lb) / 2) <= 1.1 * greatest(l.h, t.h) AND "right" >= ll - 2 * l.h AND "left" <= lr + 30 * l.h)
    OR (top >= lo - 0.5 * l.h AND top - lb <= 6 * l.h AND "right" >= ll - 3 * l.h AND "left" <= lr + 18 * l.h) OR token_index - li BETWEEN -3 AND 6),
w AS (SELECT group_id, field, li, ls, string_agg(key, '' ORDER BY token_index) AS stream FROM near GROUP BY 1, 2, 3, 4),
span AS (SELECT *, coalesce(sum(length(key)) OVER (PARTITION BY group_id, field, li ORDER BY token_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start FROM near),
c AS (SELECT record_id, field, value, {_KEY.format(x="value")} AS k FROM claims WHERE {_KEY.format(x="value")} <> ''),
tried AS (SELECT c.*, w.group_id, li, ls, stream, pos, {_DIFFER} AS d FROM c JOIN w ON w.group_id // 10 = record_id AND w.field = c.field, unnest(range(1, length(stream) - length(k) + 2)) AS x(pos) WHERE length(k) > 1),
hit AS (SELECT record_id, field, value, k, group_id, li, ls, substring(stream, CAST(pos AS BIGINT), length(k)) AS found, pos, d FROM tried WHERE d <= 1 QUALIFY row_number() OVER (PARTITION BY record_id, field, value, group_id, li ORDER BY d, pos) = 1),
many AS (SELECT hit.record_id, hit.field, value, hit.group_id, hit.li, hit.ls, found, 1 - d / length(k) AS sim, min(score) AS conf FROM hit JOIN span s ON s.group_id = hit.group_id AND s.field = hit.field AND s.li = hit.li AND s.start < pos + length(k) AND s.start + length(key) > pos GROUP BY ALL),
one AS (SELECT c.record_id, c.field, value, n.group_id, li, ls, k AS found, 1.0 AS sim, max(score) AS conf FROM c JOIN near n ON n.group_id // 10 = record_id AND n.field = c.field AND length(k) = 1 AND n.key = k GROUP BY ALL),
page AS (SELECT *, count(DISTINCT found) OVER (PARTITION BY record_id, field, value, group_id) AS nf FROM (SELECT * FROM many UNION ALL SELECT * FROM one) QUALIFY row_number() OVER (PARTITION BY record_id, field, value, group_id ORDER BY sim DESC, coalesce(conf, 0) DESC, coalesce(ls, 0) DESC, found DESC) = 1),
best AS (SELECT * FROM page QUALIFY row_number() OVER (PARTITION BY record_id, field, value ORDER BY found = {_KEY.format(x="value")} DESC, sim DESC, coalesce(conf, 0) DESC, group_id) = 1)
SELECT c.record_id, c.field, c.value, CASE WHEN found IS NULL THEN 'no evidence' WHEN found = k THEN 'consistent' ELSE 'conflict' END AS status, found, round(sim, 6) AS similarity, round(CAST(conf AS DOUBLE), 6) AS confidence,
  round(CAST(ls AS DOUBLE), 6) AS label_score, nf = 1 AS is_unique, group_id FROM c LEFT JOIN best b ON b.record_id = c.record_id AND b.field = c.field AND b.value = c.value""")
add("weak_document_evidence", ("claim_tokens",), compare.weak_document_evidence, """,
k AS (SELECT group_id, upper(text) AS t FROM claim_tokens),
g AS (SELECT group_id, count(DISTINCT t) FILTER (t IN ('C', 'D', 'C1', 'E') AND t <> 'C') AS n_classes, count(*) FILTER (t IN ('2020-01-02', '20200102', '2021年3月4日', '2019/1/1')) AS n_dates, bool_or(t = 'CHN') AS named FROM k GROUP BY 1)
SELECT group_id, n_classes, n_dates, n_classes = 1 AND (n_dates >= 3 OR named AND n_dates >= 2) AS is_weak_evidence FROM g""")

# --- forms, pages and runs ---------------------------------------------------------------------------

_LETTERS = "regexp_replace(upper(value), '[\\s:：,，.。·/_—()（）-]+', '', 'g')"
add("check_forms", ("forms",), lambda f: f.select("id", "kind", n.check(F.col("kind"), F.col("value")).alias("ok")), f""",
v AS (SELECT *, {_LETTERS} AS x FROM forms)
SELECT id, kind, CASE kind WHEN 'address' THEN id % 9 IN (0, 1, 2, 6) AND length(x) >= 5 WHEN 'period' THEN id % 7 IN (0, 1, 4, 5) WHEN 'identity' THEN x IN (SELECT x FROM v WHERE kind = 'identity' AND
    '10X98765432'[CAST(1 + list_sum(list_transform(range(1, 18), lambda i: CAST(x[i] AS INT) * [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2][i])) % 11 AS INT)] = x[18] AND x[7:10] >= '1950')
  WHEN 'archive' THEN id % 4 IN (1, 3) WHEN 'people' THEN id % 120 BETWEEN 1 AND 99 WHEN 'mass' THEN id % 2 = 1 OR id % 130 >= 10 WHEN 'dimensions' THEN id % 400 >= 300
  WHEN 'class' THEN regexp_full_match(x, 'A[1-3]|B[12]|C[1-6]|D') ELSE false END AS ok FROM v""")
add("ingest_text", ("layouts",), ingest.ingest_text, """ SELECT id, CASE id % 4 WHEN 0 THEN c_name || chr(10) || 'b' WHEN 1 THEN c_name || chr(10) || 'second' || chr(10) || 'last' WHEN 2 THEN 'a' || chr(10) || 'b' ELSE '' END AS text FROM layouts JOIN customer ON c_custkey = id""")
add("summarize_run", ("runs",), applications.summarize_run, """ SELECT group_id, count(*) AS n_total, count(*) FILTER (skipped) AS n_skipped, count(*) FILTER (NOT skipped AND error <> '') AS n_failed,
  count(*) FILTER (NOT skipped AND error = '' AND text = '') AS n_empty, count(*) FILTER (NOT skipped AND error = '' AND text <> '') AS n_succeeded FROM runs GROUP BY 1""")
TYPES = [("driver", "Driver licence"), ("id_card", "Identity card"), ("vehicle", "driver")]
add("resolve_document_type", ("requests",), lambda r: applications.resolve_document_type(r, r.sparkSession.createDataFrame(TYPES, "key string, name string")), """
SELECT id, CASE trim(asked) WHEN 'id_card' THEN 'id_card' WHEN 'Identity card' THEN 'id_card' WHEN 'driver' THEN 'driver' END AS key, CASE WHEN trim(asked) IN ('id_card', 'Identity card', 'driver') THEN '' ELSE 'choose one of driver, id_card, vehicle' END AS error FROM requests""")
add("read_answers", ("answers",), lambda a: a.select("id", recheck.read_answer(F.col("raw"), "number").alias("value")), """ SELECT id, CASE WHEN id % 8 < 4 THEN c_name WHEN id % 8 = 7 THEN c_name || c_mktsegment END AS value FROM answers JOIN customer ON c_custkey = id""")
add("rename_aliases", ("requests",), lambda r: pages.rename_aliases(r.select("id", F.col("asked").alias("key"), F.lit("v").alias("value")), r.sparkSession.createDataFrame([("invoice", "bill"), ("driver", "licence")], "key string, field string")), """
SELECT id, CASE asked WHEN 'invoice' THEN 'bill' WHEN 'driver' THEN 'licence' ELSE asked END AS field, 'v' AS value FROM requests""")
add("classify_driver_page", ("words",), lambda w: pages.classify_driver_page(w.select("id", F.concat("person", "document", "noise", F.when(F.col("id") % 3 == 0, "生成时间 当前时间").when(F.col("id") % 3 == 1, "发证机关 签注").otherwise("副页")).alias("text"))), """,
t AS (SELECT id, person || document || noise || CASE id % 3 WHEN 0 THEN '生成时间 当前时间' WHEN 1 THEN '发证机关 签注' ELSE '副页' END AS x FROM words),
c AS (SELECT id, len(list_filter(['电子', '截图', '生成时间', '当前时间'], lambda w: contains(x, w))) >= 2 AS e, len(list_filter(['签注', '副页', '发证机关'], lambda w: contains(x, w))) >= 2 AS p FROM t)
SELECT id, CASE WHEN e AND NOT p THEN 'electronic' WHEN p AND NOT e THEN 'physical' ELSE '' END AS page_kind FROM c""")
add("repair_eights", ("holes",), lambda h: recheck.repair_eights(h.select("id", "value", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: ((F.col("a") + i * F.col("b")) % 50 / 1000.0).cast("double")).alias("scores"))), """,
e AS (SELECT id, value, i, (a + (i - 1) * b) % 50 / 1000 AS s FROM holes, unnest(range(1, 13)) AS x(i)),
g AS (SELECT id, value, count(*) FILTER (value[i] = '8') AS n, max(s) FILTER (value[i] = '8') AS top FROM e GROUP BY 1, 2),
o AS (SELECT e.id, list(i) AS spots FROM e JOIN g USING (id) WHERE e.value[i] = '8' AND s <= 0.003 AND top - s >= 0.02 - 1e-12 AND top >= 0.025 AND n >= 2 GROUP BY 1)
SELECT g.id, CASE WHEN len(spots) BETWEEN 1 AND 2 THEN array_to_string(list_transform(range(1, 13), lambda i: CASE WHEN list_contains(spots, i) THEN '0' ELSE g.value[i] END), '') ELSE g.value END AS value, CASE WHEN len(spots) BETWEEN 1 AND 2 THEN len(spots) ELSE 0 END AS n_changed FROM g LEFT JOIN o ON o.id = g.id""")
