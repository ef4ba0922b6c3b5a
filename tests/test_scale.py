"""Work a row and tasks a query: what an expression repeats, and what it leaves to one task."""

import pytest

from docloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    return catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["refine_driver", "refine_vehicle"])
def test_texts_are_split_once_for_all_windows(spark, name):
    plan = plan_of(spark, name)
    assert plan.count("split(") <= 12
    assert "RepartitionByExpression" in plan


def test_walk_broadcasts_names_and_no_addresses(spark):
    plan = plan_of(spark, "correct_divisions")
    assert plan.count("strategy=merge") >= 4
    assert plan.count("strategy=broadcast") >= 4


@pytest.mark.parametrize(("name", "splits"), [("read_labels", 300), ("region_addresses", 8), ("prefer_addresses", 12)])
def test_labels_are_read_once_a_field(spark, name, splits):
    plan = plan_of(spark, name)
    assert plan.count("split(") <= splits
    assert "RepartitionByExpression" in plan


def test_masses_are_spread(spark):
    assert "RepartitionByExpression" in plan_of(spark, "refine_masses_and_dates")


@pytest.mark.parametrize("name", ["assign_driver_fields", "assign_vehicle_fields"])
def test_labels_of_images_are_never_broadcast(spark, name):
    assert "strategy=merge" in plan_of(spark, name)


def test_seeds_shuffle_no_positions_of_pages(spark):
    from docloom.operators import evidence

    wanted = spark.createDataFrame([(1, "t", "ABCDEFGHIJ")], "group_id long, target string, key string")
    pages = spark.createDataFrame([(1, "XXABCDEFGHIJYABCXEFGHIJAAA")], "group_id long, stream string")
    found = evidence.seeded_windows(wanted, pages)
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()
    windows = {r.start: r.window for r in found.collect()}
    assert {3: "ABCDEFGHIJ", 14: "ABCXEFGHIJ"}.items() <= windows.items() and min(windows) >= 1 and max(windows) <= 17


def test_records_are_normalised_where_they_stand(spark):
    plan = plan_of(spark, "normalize_fields")
    assert "Aggregate" not in plan and "Join" not in plan


def test_pages_are_searched_where_they_stand(spark):
    plan = plan_of(spark, "search_evidence")
    assert "Aggregate" not in plan and "Join" not in plan and "Repartition" not in plan
    assert plan.count("ArrowEvalPython") == 1  # each page's windows are scored once


def test_search_of_pages_is_the_search_of_tokens(spark):
    """The nearest of all windows, scored without a bound; pages without tokens, targets or texts give no row."""
    from difflib import SequenceMatcher

    from docloom.operators import evidence

    rows, wanted = [], []
    for i in range(40):
        words = [f"{'AB7'[j % 3]}{(i * 31 + j * j) % 97}{'xyz'[(i + j) % 3]}" for j in range(9)]
        torn = "".join(words[3:5])
        torn = torn[: i % 4] + "#" + torn[i % 4 + (i % 3 > 0) :]
        rows.append((i, [(j, w if j != 7 else None, None if j % 5 == 4 else j / 10) for j, w in enumerate(words)], [torn, torn, "".join(words[2:4]), "x", None]))
        wanted.append((i, torn))
    rows += [(100, [], ["AB"]), (101, None, ["AB"]), (102, [(0, "AB", 1.0)], None), (103, [(0, None, None)], ["AB"])]
    pages = spark.createDataFrame(rows, "group_id long, tokens array<struct<token_index: long, text: string, score: double>>, targets array<string>")
    got = {tuple(r) for r in evidence.search_pages(pages).collect()}
    tokens = pages.selectExpr("group_id", "inline(tokens)")
    assert got == {tuple(r) for r in evidence.search_evidence(tokens, pages.selectExpr("group_id", "explode(targets) AS target")).collect()}
    found = {r[:2]: r[2:] for r in got}
    hits = 0
    for i, torn in wanted:
        stream, key = "".join((t or "").upper() for _, t, _ in rows[i][1]), torn.upper()
        windows = [stream[s : s + len(key)] for s in range(len(stream) - len(key) + 1)]
        ratio, start = max((SequenceMatcher(None, key, w, autojunk=False).ratio(), -s) for s, w in enumerate(windows))
        near = ratio >= (0.80 if len(key) >= 8 else 0.84) and sum(a != b for a, b in zip(key, windows[-start], strict=True)) <= (3 if len(key) >= 12 else 2 if len(key) >= 5 else 1)
        assert found.get((i, torn), (None,))[0] == (windows[-start] if near else None)
        hits += near
    assert hits > 10


TOKENS = "group_id long, token_index long, text string, score double, left double, top double, right double, bottom double"


def scattered_pages(spark):
    """Pages of labels, values near and far, torn values and tokens without text; and the rows that ask for them."""
    words = ["Plate", "京A1234", "5", "Plate No.", None, "VIN: LSV1111111", "11100007", "D", "class", "C", "class D", "京B12345", "far"]
    rows, claims = [], []
    for g in range(24):
        for i in range(14):
            w = words[(g * 5 + i * (1 + g % 6)) % 13]
            x, y = 130.0 * ((i * 7 + g) % 4), 45.0 * ((i * 3 + g) % 9)
            rows.append((g, i, w, None if (g + i) % 7 == 0 else (g * 13 + i * 29) % 100 / 100, x, y, x + 90 + i, y + 18 + g % 5))
        claims += [(g, f, v) for f, v in [("plate", "京A12345"), ("plate", "京C12345"), ("vin", "LSV111111111100007"), ("vin", "LSW1111111111100008"), ("class", "D"), ("class", "C"), ("class", " "), ("other", "far")]]
    labels = [("plate", "Plate"), ("plate", "Plate No."), ("vin", "VIN"), ("class", "class"), ("class", "")]
    return spark.createDataFrame(claims, "group_id long, field string, value string"), spark.createDataFrame(rows, TOKENS), spark.createDataFrame(labels, "field string, alias string")


def test_labelled_search_equals_all_windows(spark):
    from collections import defaultdict
    from difflib import SequenceMatcher

    from docloom.operators import compare, tokens as t

    claims, tokens, labels = scattered_pages(spark)
    key = lambda x: "".join(c for c in (x or "").upper() if c not in " .:-")
    read = {(r.group_id, r.token_index): r for r in tokens.collect()}
    near = defaultdict(list)
    for r in t.associate_labels(t.pages_of(tokens), labels).collect():
        near[r.group_id, r.field, r.label_index, r.label_score].append(r.value_index)
    want = {}
    for c in claims.collect():
        hits, k = [], key(c.value)
        for (g, field, _, score), of in near.items():
            if (g, field) != (c.group_id, c.field) or not k:
                continue
            owned = [(ch, read[g, i].score) for i in sorted(of) for ch in key(read[g, i].text)]
            if len(k) == 1:
                scores = [read[g, i].score for i in of if key(read[g, i].text) == k]
                hits += [(1.0, max((s for s in scores if s is not None), default=None), score, k)] if scores else []
                continue
            cut = [(SequenceMatcher(None, k, "".join(x for x, _ in owned[s : s + len(k)]), autojunk=False).ratio(), -s) for s in range(len(owned) - len(k) + 1)]
            ratio, s = max(cut, default=(0, 0))
            found = "".join(x for x, _ in owned[-s : -s + len(k)])
            if ratio >= (0.80 if len(k) >= 8 else 0.84) and sum(a != b for a, b in zip(k, found, strict=True)) <= (3 if len(k) >= 12 else 2 if len(k) >= 5 else 1):
                scores = [x for _, x in owned[-s : -s + len(k)] if x is not None]
                hits.append((round(ratio, 6), min(scores, default=None), score, found))
        if hits:
            best = max(hits, key=lambda h: (h[0], h[1] or 0.0, h[2] or 0.0, h[3]))
            want[c.group_id, c.field, c.value] = (best[3], best[0], best[1], best[2], len({h[3] for h in hits}) == 1)
    got = {tuple(r[:3]): tuple(r[3:]) for r in compare.labelled_evidence(claims, tokens, labels).select("group_id", "field", "value", "found", "similarity", "confidence", "label_score", "is_unique").collect()}
    assert len(want) > 40 and {len(v[0]) for v in want.values()} >= {1, 7, 18}
    assert got == want


def test_labelled_search_shuffles_claims_pages_and_hits(spark):
    from docloom.operators import compare, tokens as t

    claims, tokens, labels = scattered_pages(spark)
    pages = compare.keyed_pages(t.pages_of(tokens))
    plan = compare.search_labelled(claims, pages, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # labels of a page; what is near them stays an array
    assert plan.count("ArrowEvalPython") == 1
    assert "RepartitionByExpression [group_id" in plan


def test_only_addresses_meet_what_is_alike(spark):
    from docloom.operators import fusion

    conflicts = spark.createDataFrame([(1, "plate", 0, "plate", "京A12345", "京B12345", 1.0, 1.0, True), (2, "x", 0, None, "a", "b", 1.0, 1.0, True)], "record_id long, field string, field_pos int, kind string, value string, found string, confidence double, label_score double, is_unique boolean")
    out = fusion.settle_conflicts(conflicts, conflicts)
    assert {r.record_id for r in out.collect() if r.changed} == {1}
    plan = out._jdf.queryExecution().analyzed().toString()
    joined = plan[plan.index("Join LeftOuter, ((a#") :] if "Join LeftOuter, ((a#" in plan else plan
    assert "= address), false)" in joined


def test_token_pages_of_fusion_hold_its_tokens(spark):
    from pyspark.sql import functions as F

    from docloom.sources.frames import frame

    pages, rows = frame(spark, FOLDER, "fusion_token_pages", customer="c_custkey"), frame(spark, FOLDER, "fusion_tokens")
    flat = pages.select("group_id", F.inline("tokens")).select(*[F.col(c).cast(kind) for c, kind in rows.dtypes])
    assert flat.count() == rows.count() and flat.exceptAll(rows).count() == 0
    assert pages.groupBy("group_id").count().where("count > 1").count() == 0
