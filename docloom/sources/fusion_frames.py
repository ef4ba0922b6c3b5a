"""Input frames of the reconciliation: cases of one or three records, their pages, tokens and second readings."""

from __future__ import annotations

from docloom.sources.frames import FRAMES, define

_CASE = "CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 ELSE CAST(floor(c_custkey / 6) AS BIGINT) * 10 + 1 END"
_PLACE = "CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE CAST(floor((c_custkey % 6) / 2) AS BIGINT) END"
_FIELDS = " UNION ALL ".join(
    f"SELECT {i} AS field_pos, '{field}' AS field, '{kind}' AS kind"
    for i, (field, kind) in enumerate([("name", "name"), ("plate", "plate"), ("plate_number", "plate"), ("vin", "vin"), ("class", "class"), ("total", "mass"), ("curb", "mass"), ("nationality", ""), ("type", ""), ("address", "text")])
)

define("fusion_values", f"""
        SELECT {_CASE} AS case_id, c_custkey AS record_id, {_PLACE} AS record_pos, f.field AS field, f.field_pos AS field_pos, f.kind AS kind,
               CASE f.field WHEN 'name' THEN CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '§') WHEN 2 THEN ' ' ELSE NULL END
                 WHEN 'plate' THEN CASE c_custkey % 5 WHEN 0 THEN concat('京A', lpad(CAST(c_custkey AS STRING), 6, '7')) WHEN 1 THEN concat('京B', lpad(CAST(c_custkey AS STRING), 6, '7')) WHEN 2 THEN concat('京*', lpad(CAST(c_custkey AS STRING), 6, '7')) ELSE '' END
                 WHEN 'plate_number' THEN CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('京C', lpad(CAST(c_custkey AS STRING), 6, '7')) END
                 WHEN 'vin' THEN CASE WHEN c_custkey % 7 < 4 THEN concat('LSV', lpad(CAST(c_custkey AS STRING), 14, '1')) ELSE concat('LSW', lpad(CAST(c_custkey AS STRING), 14, '1')) END
                 WHEN 'class' THEN CASE WHEN c_custkey % 8 = 0 THEN '' WHEN c_custkey % 9 = 0 THEN 'Q' ELSE 'D' END
                 WHEN 'total' THEN CASE c_custkey % 3 WHEN 0 THEN '11900kg' WHEN 1 THEN '12500kg' ELSE '' END
                 WHEN 'curb' THEN CASE c_custkey % 5 WHEN 0 THEN '11800kg' WHEN 1 THEN '' WHEN 2 THEN '11700公斤' ELSE '11100kg' END
                 WHEN 'nationality' THEN CASE c_custkey % 5 WHEN 0 THEN 'CHN' WHEN 1 THEN '' WHEN 2 THEN 'Elsewhere' WHEN 3 THEN '中国' ELSE NULL END
                 WHEN 'type' THEN CASE c_custkey % 4 WHEN 1 THEN 'paper' ELSE '' END
                 ELSE CASE c_custkey % 6 WHEN 0 THEN '广东省中山市1号' WHEN 4 THEN '深圳市南山区2号' ELSE 'Main street 3' END END AS value
        FROM {{customer}} CROSS JOIN ({_FIELDS}) AS f""")  # fmt: skip
define("fusion_pages", f"""
        SELECT {_CASE} AS case_id, c_custkey * 10 + p AS group_id, CASE WHEN c_custkey % 2 = 0 THEN p ELSE {_PLACE} + 3 * p END AS page_pos
        FROM {{customer}} CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1) AS pp
        WHERE p = 0 OR c_custkey % 2 = 0 OR CAST(floor(c_custkey / 6) AS BIGINT) % 4 = 3""")
define("fusion_types", f"""
        SELECT {_CASE} AS case_id, {_PLACE} + 3 * p AS page_pos, CASE (c_custkey * 7 + p) % 5 WHEN 0 THEN 'electronic' WHEN 1 THEN 'physical' ELSE '' END AS detected,
               CASE WHEN c_custkey % 11 = 0 THEN concat('国籍 中国 ', c_mktsegment) ELSE c_mktsegment END AS text
        FROM {{customer}} CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1) AS pp""")
define("fusion_tokens", FRAMES["claim_tokens"] + """
        UNION ALL
        SELECT c_custkey * 10 + p AS group_id, CAST(i AS BIGINT) AS token_index, CASE i WHEN 11 THEN 'Total' WHEN 12 THEN '11500kg' WHEN 13 THEN 'Curb' ELSE CASE WHEN c_custkey % 4 = 0 THEN '12200kg' ELSE '11400kg' END END AS text,
               CASE WHEN (c_custkey + i) % 37 = 0 THEN NULL ELSE 0.95 + ((c_custkey * 7 + i * 13 + p * 5) % 50) / 1000.0 END AS score,
               CAST(120 * (i % 2) AS DOUBLE) AS left, CAST(60 * CAST(floor(i / 2) AS BIGINT) AS DOUBLE) AS top, CAST(120 * (i % 2) + 100 AS DOUBLE) AS right, CAST(60 * CAST(floor(i / 2) AS BIGINT) + 20 + p AS DOUBLE) AS bottom
        FROM {customer} CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1) AS pp CROSS JOIN (SELECT 11 AS i UNION ALL SELECT 12 UNION ALL SELECT 13 UNION ALL SELECT 14) AS ii""")
#: The frame ``fusion_tokens`` with a page's tokens as one array, built in the row of the customer; oracles read ``fusion_tokens``.
_TOKENS = [part.split("FROM {customer}")[0] for part in FRAMES["fusion_tokens"].split("AS token_index,")[1:]]
define("fusion_token_pages", "SELECT c_custkey * 10 + p AS group_id, concat(" + ", ".join(f"transform(sequence({span}), i -> struct(CAST(i AS BIGINT) AS token_index, {token}))" for span, token in zip(("0, 10", "11, 14"), _TOKENS, strict=True)) + ") AS tokens FROM {customer} CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1) AS pp")
define("fusion_candidates", """
        SELECT c_custkey AS record_id, f.field AS field,
               CASE f.field WHEN 'name' THEN c_name WHEN 'plate' THEN concat('京A', lpad(CAST(c_custkey AS STRING), 6, '7')) WHEN 'plate_number' THEN concat('京A', lpad(CAST(c_custkey AS STRING), 6, '7'))
                 WHEN 'class' THEN CASE c_custkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'D' ELSE 'C1' END WHEN 'total' THEN '11500 KG' ELSE '11400kg' END AS value
        FROM {customer} CROSS JOIN (SELECT 'name' AS field UNION ALL SELECT 'plate' UNION ALL SELECT 'plate_number' UNION ALL SELECT 'class' UNION ALL SELECT 'total' UNION ALL SELECT 'curb') AS f""")
define("holder_pages", """
        SELECT o_custkey AS group_id, o_orderkey AS page_pos, CASE WHEN o_orderkey % 3 = 0 THEN 'back' ELSE 'front' END AS side, CAST(o_orderkey % 4 AS STRING) AS side_index,
               CASE WHEN o_custkey % 7 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN '' ELSE concat(CAST(o_custkey AS STRING), 'N', CAST(o_orderkey % (1 + o_custkey % 3) AS STRING)) END AS number,
               CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 8 = 0 THEN ' ' ELSE concat('name', CAST(CAST(floor(o_orderkey / 2) AS BIGINT) % (1 + o_custkey % 4) AS STRING)) END AS name,
               CASE WHEN o_orderkey % 16 = 8 THEN 'street' END AS address
        FROM {orders}""")
