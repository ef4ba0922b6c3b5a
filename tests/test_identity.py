"""Addresses and fields from a document's lines: written cases, nulls, blanks and empty tables."""

from pyspark.sql import functions as F

from docloom.operators import identity

NONE = ("id long, province string, prefecture string, county string", [])


def _column(spark, rows, make):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, current string, text string")
    return [r[0] for r in frame.select("id", make(F.col("current"), F.col("text")).alias("v")).orderBy("id").select("v").collect()]


def test_regions(spark):
    texts = [
        "住址 甲省乙市\n丙路 丁号\n221\n住址不要",  # a bare number ends it; five characters at least
        "住址\naddress\n甲省乙市丙\n公民 身份号码 1\n丁",  # the stop word may be spaced
        "住址\n甲省乙市丙\n[图片 2]\n丁号\n住址：甲省乙市丙",  # not beyond the section; given twice
        "ADDRESS Address\n甲省乙市\nsex 男\n丁", "住址\n一\n二\n三\n四\n五\n六\n七", None, "", "住址", "前住址 甲省乙市丙丁",
    ]
    rows = [(None, t) for t in texts]
    assert _column(spark, rows, lambda _, t: identity.region_addresses(t, "identity")) == [
        ["甲省乙市丙路丁号"], ["甲省乙市丙"], ["甲省乙市丙", "甲省乙市丙"], [], ["一二三四五六"], [], [], [], [],
    ]
    # Address on a line of its own is a label as well
    assert _column(spark, rows, lambda _, t: identity.region_addresses(t, "licence")) == [
        ["甲省乙市丙路丁号221住址不要"], ["甲省乙市丙公民身份号码1", "甲省乙市丙公民身份号码1丁"], ["甲省乙市丙"], ["甲省乙市"], [], [], [], [], [],
    ]


def test_whole_addresses(spark):
    one, two = "住址 甲省乙市丙路\n", "[图片 2]\n住址 甲省乙市丁路\n"
    rows = [("甲省**", one), ("甲省＊", one + two), ("甲 省", one), (None, one), ("甲省**", "住址 甲省乙市丙*\n" + two), ("**", None)]
    assert _column(spark, rows, identity.prefer_whole) == ["甲省乙市丙路", "甲省＊", "甲 省", "", "甲省乙市丁路", "**"]
    laid = identity.LAID_OUT + "\n\n 甲省 乙市丙路\n"
    rows = [("", laid), ("甲省丙路", laid), ("甲省丁路 ", laid), ("甲*", laid), ("甲*", identity.LAID_OUT + "\n戊*\n" + one), ("甲*", laid + laid.replace("甲", "乙") + one), (None, None), ("甲", identity.LAID_OUT)]
    assert _column(spark, rows, identity.prefer_laid_out) == ["甲省乙市丙路", "甲省乙市丙路", "甲省丁路", "甲省乙市丙路", "甲省乙市丙路", "甲省乙市丙路", "", "甲"]


def test_values_after_labels(spark):
    after = lambda labels, stops: lambda _, t: identity.value_after(t, labels, stops)
    texts = ["Name: 王 五 性别 男", "姓名\n\n李，\nx", "姓名", "姓名：", "无", None, "姓名 性别 男", "NAME：a.b (c) 性别"]
    assert _column(spark, [(None, t) for t in texts], after(["姓名", "Name"], ["姓名", "性别"])) == ["王 五", "李", "", "", "", "", "性别 男", "a.b (c)"]
    assert _column(spark, [(None, "出生日期 1990")], after(["出生", "出生日期"], ["x"])) == ["日期 1990"]  # labels in the order of trial


def test_repairs_of_nulls_and_empty_tables(spark):
    divisions = spark.createDataFrame([("甲省", "乙市", "丙县")], "province string, prefecture string, county string")
    cards = spark.createDataFrame([(1, None, None, None, "x"), (2, "住址 甲省乙市丙县丁村\n公民身份号码 11010519491231002x\n住址 甲省乙市丙县丁村", "", "1", "x"), (3, "", "甲省己市丙县", None, "x")], "id long, text string, address string, birth string, source string")
    assert sorted(map(tuple, identity.refine_identity(cards, divisions).collect())) == [(1, "", ""), (2, "19491231", "甲省乙市丙县丁村"), (3, "", "甲省乙市丙县")]
    assert identity.refine_identity(cards.limit(0), divisions).count() == 0
    assert identity.refine_identity(cards, divisions.limit(0)).count() == 3
    texts = spark.createDataFrame([(1, "driver", None), (2, "identity", ""), (3, "vehicle", "x"), (4, None, "姓名 x"), (5, "driver", "姓名 王五\n住址 甲省乙市丙悬1号")], "id long, profile string, text string")
    found = {(r.id, r.field): r.value for r in identity.fields_from_text(texts, divisions).collect()}
    assert {i for i, _ in found} == {1, 2, 3, 5} and None not in found.values()
    assert found[5, "name"] == "王五" and found[5, "address"] == "甲省乙市丙县1号" and found[1, "address"] == ""
    assert identity.fields_from_text(texts.limit(0), divisions).count() == 0
