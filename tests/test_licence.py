"""Fields of a licence: written cases, nulls, ties and empty tables."""

from docloom.operators import licence

TOKENS = "group_id long, token_index long, text string, score double, left double, top double, right double, bottom double, field string"


def _tokens(spark, rows):
    return spark.createDataFrame([(g, i, t, s, *(map(float, b) if b else (None,) * 4), "clash") for g, i, t, s, b in rows], TOKENS)


def _found(frame):
    return sorted((r.group_id, r.field, r.basis, r.token_index, r.value) for r in frame.collect())


def test_driver_values(spark):
    rows = [
        (1, 0, "证号", 0.9, (0, 0, 80, 20)), (1, 1, "440000199001020011", 0.9, (100, 0, 300, 20)), (1, 2, "440000199001020011", 0.9, (900, 900, 999, 920)),  # the strip under the portrait
        (1, 3, "住址", 0.9, (0, 100, 80, 120)), (1, 4, "甲乙丙路", 0.9, (100, 90, 200, 110)), (1, 5, "丁戊己路", 0.9, (100, 110, 200, 130)),  # as near as the other: the earlier one
        (1, 6, "NATIONALITY", 0.9, (0, 200, 80, 220)), (1, 7, "chn", 0.99, (100, 200, 200, 220)),  # NAME is no label within it; plain Latin text isn't useful
        (2, 0, "440000199001020011", None, (0, 0, 300, 20)), (2, 1, "乙市丙区", 0.9, (0, 40, 99, 60)), (2, 2, "乙市丙区丁路", 0.9, (0, 80, 99, 99)), (2, 3, "丙市公安局某某大队", 0.9, (0, 120, 99, 140)),
        (3, 0, "有效期限", 0.9, (0, 0, 20, 80)), (3, 1, "20200101", 0.9, (0, 100, 20, 200)), (3, 2, "20300101", 0.9, (100, 0, 120, 80)),  # reads downwards
        (4, 0, None, None, None), (4, 1, "", 0.9, (0, 0, 9, 9)), (4, 2, "住址", None, None), (4, 3, "x", 0.9, (0, 0, 9, 9)),
    ]
    assert _found(licence.assign_fields(_tokens(spark, rows), "driver")) == sorted([
        (1, "certificate_number", "label", 0, "证号"), (1, "certificate_number", "near", 1, "440000199001020011"), (1, "address", "label", 3, "住址"), (1, "address", "near", 4, "甲乙丙路"),
        (1, "nationality", "label", 6, "NATIONALITY"),
        (2, "certificate_number", "inferred", 0, "440000199001020011"), (2, "address", "fallback", 2, "乙市丙区丁路"),
        (3, "valid_period", "label", 0, "有效期限"), (3, "valid_period", "near", 1, "20200101"), (4, "address", "label", 2, "住址"),
    ])


def test_vehicle_values(spark):
    rows = [
        (1, 0, "号牌号码", 0.9, (0, 0, 80, 20)), (1, 1, "粤A12", 0.9, (90, 0, 120, 20)), (1, 2, "粤A12345", 0.9, (400, 0, 500, 20)),  # the whole plate before the nearer, cut one
        (1, 3, "京B77777", 0.9, (0, 900, 99, 920)), (1, 4, "所有人", 0.9, (0, 100, 80, 120)), (1, 5, "所有", 0.9, (90, 100, 99, 120)), (1, 6, "张三", 0.9, (200, 100, 250, 120)),
        (2, 0, "所有人李四", 0.9, (0, 0, 80, 20)), (2, 1, "发动机号码 Engine No.", 0.9, (0, 100, 80, 120)),
    ]
    assert _found(licence.assign_fields(_tokens(spark, rows), "vehicle")) == sorted([
        (1, "plate_number", "label", 0, "号牌号码"), (1, "plate_number", "near", 2, "粤A12345"), (1, "plate_number", "inferred", 3, "京B77777"), (1, "owner", "label", 4, "所有人"), (1, "owner", "near", 6, "张三"),
        (2, "owner", "label", 0, "所有人"), (2, "owner", "inline", 0, "李四"), (2, "engine_number", "label", 1, "ENGINENO"),
    ])


def test_regions(spark):
    rows = [(1, "address", "near", 0, "广东", 0.99, 10.0, 20.0, 50.0, 30.0), (1, "valid_period", "near", 1, "2020至20260101", 0.99, 100.0, 0.0, 110.0, 40.0), (1, "name", "label", 2, "姓名", 0.99, 0.0, 0.0, 9.0, 9.0),
            (2, "name", "label", 0, "姓名", 0.99, 0.0, 0.0, 9.0, 9.0), (2, "address", "near", 1, "广东省中山市一号", None, None, None, None, None), (2, "name", "near", 3, "王五", 1.0, 0.0, 0.0, 9.0, 9.0)]
    assigned = spark.createDataFrame(rows, "group_id long, field string, basis string, token_index long, value string, score double, left double, top double, right double, bottom double")
    got = {(r.group_id, r.field, r.token_index, r.side): (r.left, r.top, r.right, r.bottom, r.padding, r.readable) for r in licence.field_regions(assigned, "driver").collect()}
    assert got[1, "address", 0, "after"] == (50, 20, 130, 30, 0.5, False) and got[1, "address", 0, "here"][4] == 1.5
    assert got[1, "valid_period", 1, "before"] == (100, -80, 110, 0, 0.5, False)  # upright: the missing start lies above
    assert got[1, "name", 2, "here"][4] == 1.5 and (2, "name", 0, "here") not in got and got[2, "address", 1, "here"] == (None, None, None, None, 0.5, False)
    assert len(got) == 7


def test_glare_needs_one_box(spark):
    regions = spark.createDataFrame([(1, "address", 0, "here", False), (1, "address", 1, "here", False), (2, "address", 0, "here", True), (3, "name", 0, "here", False), (4, "address", 9, "here", False)], "group_id long, field string, token_index long, side string, readable boolean")
    kind = "group_id long, field string, token_index long, side string, overlap double, contiguous double, texture double, texture_contiguous double, linked boolean, brighter double, solid boolean, readable boolean"
    measures = spark.createDataFrame([
        (1, "address", 0, "here", 0.5, 0.01, 0.0, 0.0, False, 0.0, True, True), (1, "address", 1, "here", 0.01, 0.5, 0.0, 0.0, False, 0.0, True, True),  # jointly past both limits, but no box is
        (2, "address", 0, "here", 0.01, 0.0, 0.5, 0.5, True, 0.0, False, True), (3, "name", 0, "here", 0.5, 0.5, 0.5, 0.5, True, 99.0, True, True),
    ], kind).drop("readable")
    got = {r.group_id: (r.n_boxes, r.highlight, r.washout, r.covered) for r in licence.covered_fields(regions, measures, "driver").collect()}
    assert got == {1: (2, False, False, False), 2: (1, False, True, False), 3: (1, True, True, False), 4: (0, False, False, False)}


def test_empty_tables(spark):
    for profile in ("driver", "vehicle"):
        assigned = licence.assign_fields(_tokens(spark, []), profile)
        assert assigned.count() == 0 and licence.field_regions(assigned, profile).count() == 0
