"""Queries of identity addresses and labelled texts, and their DuckDB oracles: plain joins of labels and lines, one pattern a field."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import holders, identity
from docloom.plans.base import ORACLES, add
from docloom.plans.catalogue import SQL_WALK, _step
from docloom.plans.repairs import SQL_LINES, sql_dates, sql_window
from docloom.runtime import spread
from docloom.sources import identity_frames  # noqa: F401  (defines the frames)
from docloom.sources.frames import with_frames

SHORT = [("ASIA", "As")]
_HAN = "[\\x{4e00}-\\x{9fff}]"


def _regions(kind: str) -> str:
    """Tables up to ``{kind}(id, s, i, v)``: each label's line joined with the lines below it in its section."""
    labels, after, least, ends = identity.REGIONS[kind]
    k, card, flags = kind[0], kind == "identity", "" if kind == "identity" else "i"
    said = "regexp_replace(b.x, '\\s', '', 'g')" if card else "lower(b.x)"
    ended = " OR ".join([f"contains({said}, '{w if card else w.lower()}')" for w in ends] + ([f"NOT regexp_matches(b.x, '{_HAN}')"] if card else []))
    head = f"regexp_replace(a.x, '^({'|'.join(labels)})\\s*[:：]?\\s*', '', '{flags}')"
    first = head if card else f"CASE WHEN lower({head}) = 'address' THEN '' ELSE {head} END"
    return f""",
{k}_part AS (SELECT id, s, {SQL_LINES.format(text="u")} AS l FROM (SELECT id, unnest(p) AS u, generate_subscripts(p, 1) AS s FROM (SELECT id, string_split(replace(text, chr(10) || '[图片', chr(1) || '[图片'), chr(1)) AS p FROM card_texts))),
{k}_ln AS (SELECT id, s, i, l[i] AS x, regexp_matches(l[i], '^({"|".join(labels)})', '{flags}') AS labelled FROM (SELECT id, s, l, unnest(range(1, len(l) + 1)) AS i FROM {k}_part)),
{k}_b AS (SELECT a.id, a.s, a.i, b.i AS j, b.x, lower(b.x) = 'address' AS skip, {ended} AS ended FROM {k}_ln a JOIN {k}_ln b ON a.id = b.id AND a.s = b.s AND a.labelled AND b.i BETWEEN a.i + 1 AND a.i + {after}),
{k}_cut AS (SELECT id, s, i, coalesce(min(j) FILTER (ended AND NOT skip), 1000) AS e FROM {k}_b GROUP BY 1, 2, 3),
{k}_below AS (SELECT id, s, i, string_agg(x, '' ORDER BY j) AS t FROM {k}_b JOIN {k}_cut USING (id, s, i) WHERE j < e AND NOT skip GROUP BY 1, 2, 3),
{kind} AS (SELECT * FROM (SELECT a.id, a.s, a.i, regexp_replace({first} || coalesce(t, ''), '\\s', '', 'g') AS v FROM {k}_ln a LEFT JOIN {k}_below USING (id, s, i) WHERE a.labelled)
  WHERE length(regexp_replace(v, '[^' || substring('{_HAN}', 2), '', 'g')) >= {least})"""


_WHOLE = "(SELECT id, min(v) AS v FROM ({source}) WHERE v <> '' AND NOT regexp_matches(v, '[*＊]') GROUP BY 1 HAVING count(DISTINCT v) = 1)"
_LAID = "SELECT id, regexp_replace(l[i + 1], '\\s', '', 'g') AS v FROM (SELECT id, l, unnest(range(1, len(l))) AS i FROM (SELECT id, {lines} AS l FROM card_texts)) WHERE l[i] = '{mark}'".format(lines=SQL_LINES.format(text="text"), mark=identity.LAID_OUT)


def _walk(source: str) -> str:
    """The walk down the hierarchy over ``source(id, address)``."""
    return SQL_WALK.format(
        one=_step("one", f"SELECT id, address, '' AS done FROM {source}", "SELECT form AS name FROM forms", "true", ", b.found AS p"),
        two=_step("two", "SELECT one.id, address, done, province FROM one JOIN forms ON form = p", "SELECT province, prefecture AS name FROM divisions", "n.province = s.province", ", s.province, b.found AS prefecture"),
        city=_step("city", "SELECT id, address, done FROM one WHERE p IS NULL", "SELECT prefecture AS name FROM divisions", "true", ", b.found AS prefecture"),
        three=_step("three", "SELECT * FROM two WHERE prefecture IS NOT NULL", "SELECT province, prefecture, county AS name FROM divisions", "n.province = s.province AND n.prefecture = s.prefecture", ""),
        skipped=_step("skipped", "SELECT * FROM two WHERE prefecture IS NULL", "SELECT province, county AS name FROM divisions", "n.province = s.province", ""),
        county=_step("county", "SELECT * FROM city WHERE prefecture IS NOT NULL", "SELECT prefecture, county AS name FROM divisions", "n.prefecture = s.prefecture", ""),
        alone=_step("alone", "SELECT * FROM city WHERE prefecture IS NULL", "SELECT county AS name FROM divisions", "true", ""),
    ).lstrip(",").strip()


_listed = lambda kind: F.array_join(identity.region_addresses(F.col("text"), kind), "|").alias(kind)
add("region_addresses", ("card_texts",), lambda c: spread(c, "id").select("id", _listed("identity"), _listed("licence")), f"""{_regions("identity")}{_regions("licence")},
a AS (SELECT id, string_agg(v, '|' ORDER BY s, i) AS v FROM identity GROUP BY 1), f AS (SELECT id, v, min(s * 1000 + i) AS o FROM licence GROUP BY 1, 2), b AS (SELECT id, string_agg(v, '|' ORDER BY o) AS v FROM f GROUP BY 1)
SELECT c.id, coalesce(a.v, '') AS identity, coalesce(b.v, '') AS licence FROM card_texts c LEFT JOIN a ON a.id = c.id LEFT JOIN b ON b.id = c.id""")
add("prefer_addresses", ("card_texts",), lambda c: spread(c, "id").select("id", identity.prefer_whole(F.col("address"), F.col("text")).alias("whole"), identity.prefer_laid_out(F.col("address"), F.col("text")).alias("address")), f"""{_regions("licence")},
w AS (SELECT c.id, address AS held, regexp_replace(address, '\\s', '', 'g') AS x, CASE WHEN regexp_matches(address, '[*＊]') THEN coalesce(v, address) ELSE address END AS whole FROM card_texts c LEFT JOIN {_WHOLE.format(source="SELECT id, v FROM licence")} k ON k.id = c.id)
SELECT w.id, whole, CASE WHEN v IS NULL THEN whole WHEN x = '' OR regexp_matches(x, '[*＊]') OR regexp_full_match(v, '.*' || array_to_string(string_split(x, ''), '.*') || '.*') THEN v ELSE x END AS address
FROM w LEFT JOIN {_WHOLE.format(source=_LAID)} l ON l.id = w.id""")


def _agreed(readings: str) -> str:
    """The consensus rule's own oracle over other readings; a number may follow each of the ends here."""
    rule = ORACLES["consensus_address"][len(with_frames("readings")):].replace("号[0-9]", "[村屯组号室户][0-9]").replace("current = d[1]", "regexp_replace(current, '\\s', '', 'g') = d[1]")
    return f"(WITH readings AS ({readings}){rule})"


_NUMBERS = """SELECT id, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS v FROM (SELECT id, unnest(regexp_extract_all(upper(text), '\\b[1-9][0-9]{{16}}[0-9X]\\b')) AS v FROM {source})
  WHERE '10X98765432'[CAST(1 + list_sum(list_transform(range(1, 18), lambda i: CAST(v[i] AS INT) * [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2][i])) % 11 AS INT)] = v[18] GROUP BY 1"""
add("refine_identity", ("card_texts", "divisions"), lambda c, d: identity.refine_identity(c, d, SHORT), f"""{_regions("identity")},
agreed AS {_agreed("SELECT c.id, min(address) AS current, coalesce(string_agg(v, '|' ORDER BY s, i), '') AS listed FROM card_texts c LEFT JOIN identity y ON y.id = c.id GROUP BY 1")},
numbers AS ({_NUMBERS.format(source="card_texts")}),
walked AS (WITH {_walk("agreed")})
SELECT c.id, CASE WHEN v IS NULL THEN birth ELSE substring(v, 7, 8) END AS birth, corrected AS address FROM card_texts c JOIN walked w ON w.id = c.id LEFT JOIN numbers n ON n.id = c.id""")

_DIGITS = "CASE WHEN length(regexp_replace({v}, '\\D', '', 'g')) = 8 THEN regexp_replace({v}, '\\D', '', 'g') ELSE '' END"
_BARE = "regexp_replace({v}, '\\s', '', 'g')"
#: How each normalizer writes the values of this frame.
_WRITTEN = {
    "date_digits": _DIGITS, "date_yyyymmdd": _DIGITS, "compact": "regexp_replace({v}, '[\\s_]+', '', 'g')", "compact_whitespace": _BARE, "compact_upper": f"upper({_BARE})", "identity_number": f"upper({_BARE})", "mass_kg": _BARE, "people": _BARE,
    "driving_class": "upper(regexp_replace({v}, '[\\s,，、]+', '', 'g'))", "date_range": "regexp_replace({v}, '^(\\d{{4}})-(\\d{{2}})-(\\d{{2}}).*(\\d{{4}})-(\\d{{2}})-(\\d{{2}})$', '\\1\\2\\3-\\4\\5\\6')",
    "id_card_valid_period": "replace({v}, '.', '')",
}


def _read(profile: str) -> str:
    """One SELECT of a profile's columns, a pattern a field."""
    fields = identity.PROFILES[profile]
    own = "|".join(label for label, _, _ in fields.values())
    stops = "|".join([own, *identity.MORE_STOPS[profile]])
    value = lambda labels, ends: f"trim(regexp_extract(text, '(?:{'|'.join(labels)})\\s*[:：]?\\s*([^\\n]+?)(?:\\s+(?:{ends})|\\n|$)', 1, 'i'), ' ：:，,。')"
    columns = []
    for field, (label, labels, rule) in fields.items():
        v = f"coalesce(nullif({value(labels, stops)}, ''), {value([label], own)})" if labels else value([label], own)
        columns.append(_WRITTEN.get(rule, "{v}").format(v=v) + f" AS {field}")
    return f"SELECT id, text, {', '.join(columns)} FROM labelled_texts WHERE profile = '{profile}'"


def _long(source: str, profile: str, fields: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT id, '{profile}' AS profile, '{f}' AS field, {f} AS value FROM {source}" for f in fields)


def _read_all(texts):
    parts = [identity._melted(identity.read_labels(texts.where(F.col("profile") == p), p), p, list(fields)) for p, fields in identity.PROFILES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_TABLES = ",\n".join(f"{p} AS ({_read(p)})" for p in identity.PROFILES)
add("read_labels", ("labelled_texts",), _read_all, f",\n{_TABLES}\n" + " UNION ALL ".join(_long(p, p, list(fields)) for p, fields in identity.PROFILES.items()))

#: The repair of licences by its own oracle, over the columns read here; the texts have no laid-out or hidden address.
_DRIVER_RULE = ORACLES["refine_driver"][len(with_frames("licences")):]
_REPAIRED = ["number", "class", "archive", "first_issue", "birth", "period", "sex"]
_dated = lambda c: f"CASE WHEN length(v.{c}) = 8 THEN v.{c} ELSE coalesce({sql_dates(sql_window(holders.LABELS[c], 0, 3))}[1], '') END AS {c}"
_rest = lambda profile, gone: [f for f in identity.PROFILES[profile] if f not in gone]
add("fields_from_text", ("labelled_texts", "divisions"), lambda t, d: identity.fields_from_text(t, d, SHORT), f""",
{_TABLES},
fixed AS (WITH licences AS (SELECT * FROM driver){_DRIVER_RULE}),
d_walk AS (WITH {_walk("fixed")}), i_walk AS (WITH {_walk("identity")}),
numbers AS ({_NUMBERS.format(source="identity")}),
lined AS (SELECT id, birth, first_issue, {SQL_LINES.format(text="text")} AS l FROM driver),
d AS (SELECT f.* EXCLUDE (address, birth, first_issue), corrected AS address, {_dated("birth")}, {_dated("first_issue")} FROM fixed f JOIN d_walk w ON w.id = f.id JOIN lined v ON v.id = f.id),
i AS (SELECT y.* EXCLUDE (address, birth, document_type), corrected AS address, coalesce(substring(v, 7, 8), birth) AS birth, CASE WHEN contains(regexp_replace(text, '\\s', '', 'g'), '居民身份证') THEN '第二代身份证' ELSE document_type END AS document_type
  FROM identity y JOIN i_walk w ON w.id = y.id LEFT JOIN numbers n ON n.id = y.id)
{_long("d", "driver", [*_REPAIRED, "address"])} UNION ALL {_long("driver", "driver", _rest("driver", [*_REPAIRED, "address"]))}
UNION ALL {_long("i", "identity", list(identity.PROFILES["identity"]))} UNION ALL {_long("vehicle", "vehicle", list(identity.PROFILES["vehicle"]))} UNION ALL SELECT id, 'vehicle', 'fuel', '' FROM vehicle""")
