"""Rules over whole documents: nulls, blanks and empty tables."""

from pyspark.sql import functions as F

from docloom.operators import documents


def test_nulls_and_empty_tables(spark):
    gate = spark.createDataFrame([(1, 0, "a", None, None), (1, 1, "b", "", ""), (2, 0, None, "x", None)], "group_id long, position long, side_label string, code string, error string")
    assert sorted(map(tuple, documents.document_gate(gate).collect())) == [(1, "accepted", ""), (2, "rejected", "x")]
    assert documents.document_gate(gate.limit(0)).count() == 0
    read = spark.createDataFrame([(1, None, None), (2, "x", []), (3, None, ["甲路1号", "甲路1号"])], "id long, current string, candidates array<string>")
    assert sorted(map(tuple, documents.consensus_address(read).collect())) == [(1, ""), (2, "x"), (3, "甲路1号")]
    raw = spark.createDataFrame([(1, None), (2, ""), (3, "[]"), (4, "[{")], "id long, raw string")
    tables = {r[0]: r[1] for r in raw.select("id", documents.coordinates_to_table(F.col("raw"))).collect()}
    assert tables[1] == tables[2] == documents.TABLE_HEAD and None not in tables.values()
