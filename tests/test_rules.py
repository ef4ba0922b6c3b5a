"""Rule tables: made-up inputs and what the rules make of them."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docloom.functions import normalizers as n
from docloom.functions import similarity
from docloom.operators import evidence, ingest, pages, places, recheck, reconcile, survivors

RULES = [
    ("text", " a b ", "a b"), ("space", "a 　 b\t\nc", "a b c"), ("compact", " a_b  c ", "abc"), ("compact_upper", "a b", "AB"), ("date_yyyymmdd", "2020年1月2日", "20200102"), ("date_yyyymmdd", "2020-13-40", "20201340"),
    ("date_yyyymmdd", "20-1-2", ""), ("date_yyyy_mm_dd", "2020.1.2", "2020-01-02"), ("date_digits", "2020年01月02日", "20200102"), ("date_digits", "2020年1月2日", ""), ("date_range", "2020.01.02-2030.01.02", "20200102-20300102"),
    ("date_range", "20200102 至 长期", "20200102-长期"), ("date_range", "20200102-", ""), ("date_range", "长期", ""), ("id_card_valid_period", "2020 .1", "2020.1"), ("duration", " 6 年", "6年"), ("duration", "长期", "长期"), ("duration", "six", ""),
    ("gender", "男", "男"), ("gender", "M", ""), ("ethnicity", "汉族", "汉"), ("ethnicity", "穿青", "穿青人"), ("ethnicity", "火星", ""), ("identity_number", "11010519491231002x", "11010519491231002X"), ("identity_number", "110105194912310021", ""),
    ("identity_number", "110105194913310020", ""), ("driving_class", "c1、 d", "C1D"), ("nationality", "中国/chn", "中国"), ("nationality", "A B", "AB"), ("driver_document_type", "电子驾驶证", "电子驾驶证"), ("driver_document_type", "other", ""),
    ("inspection_date", "2030年6月", "203006"), ("inspection_date", "2030.6.1", "20300601"), ("mass_kg", "1,730 千克", "1730kg"), ("mass_kg", "1730t", ""), ("people", "5 人", "5人"), ("people", "five", ""), ("dimensions_mm", "47.62x1860*1590.0", "4762×1860×1590mm"),
    ("dimensions_mm", "1 2", ""), ("vehicle_license_type", "行驶证副页", "中国行驶证副页"), ("number", "1,998 ml", "1998"), ("number", "x9", ""), ("dimensions_slash", "1 x 2 x 3.5", "1/2/3.5"), ("domestic_imported", "国产/进口", "进口"), ("money", "￥：1,200.50元", "1200.50"),
    ("money", "-3.999", ""), ("money", "rmb 5", "5"), ("numeric", "1.5吨", "1.5"), ("percent", "13", "13%"), ("percent", "x%", ""), ("invoice_type", "机动车 发票", "机动车销售统一发票"), ("business_term", "2020-1-1至2030-1-1", "20200101至20300101"),
    ("business_term", "2020-1-1", ""), ("premium_list", "1；\n2元", "1；；2"), ("premium_list", "1;x", ""), ("stamp_yes_no", "红 章", "是"), ("stamp_yes_no", "maybe", ""), ("measurement", "-80 km/h", "-80"), ("money", "UNKNOWN", ""), ("text", None, ""), ("text", "未识别", ""),
]

FORMS = [
    ("plate", "京a·12345", True), ("plate", "京12345", False), ("vin", "LSVAA1234567890AB", True), ("vin", "LSVAA1234567890IO", False), ("engine", "ab12", True), ("engine", "20200101", False), ("identity", "01010519491231002X", False),
    ("licence", "1234567890****1", True), ("archive", "20200101", False), ("archive", "12345678", True), ("date", "2020年02月30日", False), ("class", "c1d", True), ("class", "x", False), ("mass", "1730 kg", True), ("mass", "9kg", False), ("people", "0人", False),
    ("dimensions", "4490×1860x1590mm", True), ("dimensions", "44901×1860×1590", False), ("other", "x", False), ("vin", None, False),
]


def test_normalizers(spark):
    rows = spark.createDataFrame([(i, r, v) for i, (r, v, _) in enumerate(RULES)], "i int, rule string, value string")
    got = {r.i: r.out for r in rows.select("i", n.normalize(F.col("rule"), F.col("value")).alias("out")).collect()}
    assert [(RULES[i][:2], got[i]) for i in range(len(RULES))] == [(r[:2], r[2]) for r in RULES]
    assert set(n.NORMALIZERS) == {r for r, _, _ in RULES} | {"compact_whitespace"}


def test_unknown_normalizer_fails(spark):
    with pytest.raises(Exception, match="unknown normalizer"):
        spark.range(1).select(n.normalize(F.lit("nothing"), F.lit("x"))).collect()


def test_checks(spark):
    rows = spark.createDataFrame([(i, f, v) for i, (f, v, _) in enumerate(FORMS)], "i int, field string, value string")
    got = {r.i: r.ok for r in rows.select("i", n.check(F.col("field"), F.col("value")).alias("ok")).collect()}
    assert [(FORMS[i][:2], got[i]) for i in range(len(FORMS))] == [(f[:2], f[2]) for f in FORMS]


def test_similarity(spark):
    words = ["", "a", "abcd", "abxcd", "street 12", "12 street", "aaaa", "aa", "北京市朝阳区1号", "北京市朝阳区11号"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    out = pairs.select("a", "b", similarity.ratio(F.col("a"), F.col("b")).alias("r"), similarity.could_reach(F.col("a"), F.col("b"), 0.72).alias("may"), similarity.is_subsequence(F.col("a"), F.col("b")).alias("sub"), similarity.common_prefix(F.col("a"), F.col("b")).alias("p"))
    for r in out.collect():
        want = SequenceMatcher(None, r.a, r.b, autojunk=False).ratio()
        assert r.r == pytest.approx(want)
        assert r.may or want < 0.72
        rest = iter(r.b)
        assert r.sub == all(c in rest for c in r.a), (r.a, r.b)
        assert r.p == next((i for i, (x, y) in enumerate(zip(r.a, r.b, strict=False)) if x != y), min(len(r.a), len(r.b))), (r.a, r.b)


def test_json_candidates(spark):
    cases = ['{"a":1}', '  [{"a":1}] ', '```json\n{"a":1}\n```', 'see {"a":1} there', '{"a":"cut', '{"a":1', "none", '{"a":1} {"b"', "", '{"records":[{"a":1},2]}']
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, raw string")
    got = {r.id: r.json for r in ingest.parse_responses(rows).collect()}
    assert got == {0: '{"a":1}', 1: '[{"a":1}]', 2: '{"a":1}', 3: '{"a":1}', 4: '{"a":"cut"}', 5: "", 6: "", 7: '{"a":1}', 8: "", 9: '{"records":[{"a":1},2]}'}
    records = sorted((r.id, r.record) for r in ingest.response_records(rows.where("id IN (1, 6, 9)")).collect())
    assert records == [(1, '{"a":1}'), (6, ""), (9, '{"a":1}')]


def test_votes_do_not_depend_on_partitions(spark):
    votes = spark.createDataFrame([(1, "size", v, i) for i, v in enumerate(["a*", "ab", "ba", "a*", "ba", "ab", "c"])], "group_id int, field string, value string, position int")
    for k in (1, 7):
        assert [r.value for r in survivors.vote_values(votes.repartition(k)).collect()] == ["ab"]


def test_places_and_masks(spark):
    d = spark.createDataFrame([("江东省", "中山市", "西区"), ("江东省", "中天市", "东区"), ("河内省", "平山市", "北区")], "province string, prefecture string, county string")
    a = spark.createDataFrame([(1, "江东省中山市西区5号"), (2, "江口省中山市西区5号"), (3, "江东省中口市西区"), (4, "河内省平口市北区"), (5, "别处"), (6, ""), (7, "江X省中山市西区5号"), (8, "江东省口区1号"), (9, "平山市口区"), (10, "北口"), (11, "内东省西区"), (12, "河北省平山市北区")], "id int, address string")
    got = {r.id: r.corrected for r in places.correct_divisions(a, d).collect()}
    assert got == {1: "江东省中山市西区5号", 2: "江东省中山市西区5号", 3: "江东省中口市西区", 4: "河内省平山市北区", 5: "别处", 6: "", 7: "江X省中山市西区5号", 8: "江东省口区1号", 9: "平山市北区", 10: "北区", 11: "江东省西区", 12: "河内省平山市北区"}
    fixed = spark.range(1).select(F.array(*[places.repair_numbers(F.lit(x)) for x in ("BO路1O号l2 - 3号Z室", "[5]号1-z-3栋", "12-3-4号", "BIG号", "（l）号丨6户")]).alias("x")).collect()[0].x
    assert fixed == ["BO路10号l2-3号Z室", "151号123栋", "12-3-4号", "BIG号", "111号16户"]
    masks = spark.createDataFrame([("12*4", "1234"), ("12*4", "1235"), ("1234", "123")], "a string, b string")
    assert [r.m for r in masks.select(survivors.masked_equal(F.col("a"), F.col("b")).alias("m")).collect()] == [True, False, False]


def test_arbitration_order_and_audit(spark):
    rows = [
        (1, "plate", "京A12345", "京B12345", "label-spatial", True, 0.96, 0.99), (2, "plate", "京A12345", "京B12345", "label-spatial", True, 0.96, 0.98), (3, "plate", "bad", "京B12345", "label-spatial", True, 0.96, 0.98),
        (4, "plate", "京A12345", "bad", "label-spatial", True, 0.96, 0.99), (5, "plate", "京A12345", "京B12345", "text", True, 0.96, 0.99), (6, "plate", "京A12345", None, "text", True, None, None), (7, "name", "x", "y", "label-spatial", True, 0.96, 0.99),
    ]
    c = spark.createDataFrame(rows, "id int, field string, current_value string, other_value string, association string, association_unique boolean, label_confidence double, value_confidence double")
    out = reconcile.arbitrate(c)
    assert {r.id: r.reason for r in out.collect()} == {1: "other source", 2: "value score", 3: "other source", 4: "format", 5: "no label nearby", 6: "consistent", 7: "not overridable"}
    assert sum(r.n_changed for r in reconcile.audit_log(out).where("reason = '(all)'").collect()) == out.where("changed").count()


def test_alias_and_page_kind(spark):
    fields = spark.createDataFrame([(1, "VIN", "x"), (1, "other", "y")], "id int, key string, value string")
    aliases = spark.createDataFrame([("VIN", "vin")], "key string, field string")
    assert sorted(r.field for r in pages.rename_aliases(fields, aliases).collect()) == ["other", "vin"]
    texts = spark.createDataFrame([(1, "电子 生成时间"), (2, "副页 签注"), (3, "电子 生成时间 副页 签注"), (4, "")], "id int, text string")
    assert {r.id: r.page_kind for r in pages.classify_driver_page(texts).collect()} == {1: "electronic", 2: "physical", 3: "", 4: ""}


def test_evidence_windows(spark):
    words = ["Plate", "京A1", "2345", "expires", "2030", "-01-02", "nothing", "abc"]
    tokens = spark.createDataFrame([(1, i, w, 0.9 if i % 2 else None) for i, w in enumerate(words)], "group_id int, token_index int, text string, score double")
    wanted = ["京A12345", "京A12545", "20300102", "20310102", "zzzz", "abd", "a"]
    targets = spark.createDataFrame([(1, w) for w in wanted], "group_id int, target string")
    got = {r.target: (r.found, r.similarity, r.owners) for r in evidence.search_evidence(tokens, targets).collect()}
    stream = "".join(words).replace("-", "").upper()
    for w in wanted:
        cut = [stream[i : i + len(w)] for i in range(len(stream) - len(w) + 1)]
        score, _, found = max((SequenceMatcher(None, w.upper(), c, autojunk=False).ratio(), -i, c) for i, c in enumerate(cut))
        differ = sum(a != b for a, b in zip(w.upper(), found, strict=True))
        accepted = len(w) >= 2 and score >= (0.8 if len(w) >= 8 else 0.84) and differ <= (3 if len(w) >= 12 else 2 if len(w) >= 5 else 1)
        assert (w in got) == accepted, w
        if accepted:
            assert got[w][:2] == (found, round(score, 6))
    assert got["京A12345"][2] == "1,2"


def test_third_readings(spark):
    cases = [('{"证号": "12"}', "12"), ("| 证号 | 34 |", "34"), ("识别结果为：证号：56\n证号 56", "56"), ("<b>证号</b>：`77`", "77"), ("图片中的文字是: A: b", "A: b"), ("(1,2)(3,4)78", "78"), ("无法识别", None), ("", None), ("x" * 161, None)]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "id int, raw string")
    got = {r.id: r.v for r in rows.select("id", recheck.read_answer(F.col("raw"), "证号").alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_eights(spark):
    flat = [0.01] * 12
    rows = [
        (1, "880000000000", [0.03, 0.001] + flat[2:]), (2, "880000000000", [0.02, 0.001] + flat[2:]), (3, "888800000000", [0.03, 0.001, 0.001, 0.001] + flat[4:]), (4, "800000000000", [0.03] + flat[1:]), (5, "88", [0.03, 0.001]), (6, None, None),
    ]
    got = {r.id: (r.value, r.n_changed) for r in recheck.repair_eights(spark.createDataFrame(rows, "id int, value string, scores array<double>")).collect()}
    assert got == {1: ("800000000000", 1), 2: ("880000000000", 0), 3: ("888800000000", 0), 4: ("800000000000", 0), 5: ("88", 0), 6: (None, 0)}


def test_turned_and_scaled_boxes(spark):
    boxes = spark.createDataFrame([(0, 10.0, 20.0, 30.0, 60.0), (90, 10.0, 20.0, 30.0, 60.0), (180, 10.0, 20.0, 30.0, 60.0), (270, 10.0, 20.0, 30.0, 60.0), (45, None, None, None, None)], "angle int, left double, top double, right double, bottom double")
    args = (F.col("angle"), F.lit(200.0), F.lit(100.0))
    plain = [tuple(r)[1:] for r in ingest.restore_coordinates(boxes, *args).collect()]
    assert plain == [(10, 20, 30, 60), (140, 10, 180, 30), (170, 40, 190, 80), (20, 70, 60, 90), (None,) * 4]
    scaled = [tuple(r)[1:] for r in ingest.restore_coordinates(boxes, *args, F.lit(400.0), F.lit(50.0)).collect()]
    assert scaled == [tuple(v and v * (2, 0.5)[i % 2] for i, v in enumerate(b)) for b in plain]
    raw = spark.createDataFrame([(None,), ("",), ("{",), ('{"result": null}',), ('{"result": {"ocrResults": [{"prunedResult": {"doc_preprocessor_res": {"angle": -180}}}]}}',)], "payload string")
    assert [r[0] for r in raw.select(ingest.page_angle(F.col("payload"))).collect()] == [0, 0, 0, 0, 180]
