"""Division names and addresses of any length."""

from docloom.operators import places


def test_long_names_and_addresses(spark):
    long, tail = "甲" * 30 + "省", "路" * 12_000
    d = spark.createDataFrame([(long, "中山市", "西区"), ("江东省", "中天市", "东区")], "province string, prefecture string, county string")
    a = spark.createDataFrame([(1, "口" + long[1:] + "中山市西区5号"), (2, "江口省中天市东区" + tail)], "id int, address string")
    got = {r.id: r.corrected for r in places.correct_divisions(a, d).collect()}
    assert got == {1: long + "中山市西区5号", 2: "江东省中天市东区" + tail}
    assert places.correct_divisions(a, d.limit(0)).where("changed").count() == 0
