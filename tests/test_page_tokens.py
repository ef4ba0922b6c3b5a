"""Pages as rows with an array of tokens: the same as rows of tokens, and no shuffle."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import documents, gate, recheck, tokens
from docloom.plans import catalogue
from docloom.sources.frames import FRAMES, frame

FOLDER = "/root/testdata/sf0.001"
TOKEN = "group_id long, token_index long, text string, score double, left double, top double, right double, bottom double"


def plan_of(spark, name):
    return catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def token(group, index, text="word", score=0.5, box=(0, 0, 40, 20)):
    return (group, index, text, score, *map(float, box))


def same_rows(a, b):
    return a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_pages_hold_the_rows_of_tokens(spark):
    pages, rows = frame(spark, FOLDER, "token_pages"), frame(spark, FOLDER, "tokens")
    assert same_rows(pages.select("group_id", F.inline("tokens")), rows)
    assert pages.groupBy("group_id").count().where("count > 1").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "a  b\n\nc"), (5, " ".join(["w"] * 40 + [""] * 40 + ["x"]))], "doc_id long, text string")
    pages, rows = (spark.sql(FRAMES[f], documents=odd) for f in ("token_pages", "tokens"))
    assert same_rows(pages.select("group_id", F.inline("tokens")), rows)
    assert sorted(r.group_id for r in pages.collect()) == [400000, 500000, 500002]


@pytest.mark.parametrize("name", ["token_metrics", "text_quality"])
def test_metrics_shuffle_nothing(spark, name):
    assert "Exchange" not in plan_of(spark, name)


def test_reasons_of_odd_pages(spark):
    rows = [token(1, 0), token(1, 1), *[token(2, i, box=(0, 0, 7, 20)) for i in range(3)], *[token(3, i, box=(0, 0, 13, 20)) for i in range(3)], *[token(4, i, score=0.6) for i in range(3)], *[token(5, i, score=s) for i, s in enumerate((0.2, 0.2, 0.9, 0.9, 0.9))], *[token(6, i, score=0.9) for i in range(3)]]
    reasons = {r.group_id: r.reason for r in gate.text_quality(tokens.token_metrics(tokens.pages_of(spark.createDataFrame(rows, TOKEN)))).collect()}
    assert reasons == {1: "no_text", 2: "too_small", 3: "low_resolution", 4: "unreadable", 5: "partly_unreadable", 6: "fine"}


def test_reasons_of_metrics_at_a_limit(spark):
    """Sums that end a bit below 0.45 and 0.25, and what is 0.5 to six places only; the oracle rounds before it judges."""
    pages = {1: [(0.006, 7), (0.674, 2), (0.83, 7)], 2: [(0.076, 1), (0.308, 1), (0.9, 9), (0.9, 9)], 3: [(0.6, 999_999), (0.9, 999_999), (0.9, 1)], 4: [(0.006, 7), (0.673, 2), (0.83, 7)], 5: [(0.075, 1), (0.308, 1), (0.9, 9), (0.9, 9)]}
    rows = [token(g, i, "w" * size, score) for g, page in pages.items() for i, (score, size) in enumerate(page)]
    metrics = tokens.token_metrics(tokens.pages_of(spark.createDataFrame(rows, TOKEN)))
    raw = {r.group_id: r for r in metrics.collect()}
    assert raw[1].mean_score < 0.45 and raw[2].lower_quartile < 0.25 and raw[3].low_characters < 0.5
    assert {r.group_id: r.reason for r in gate.text_quality(metrics).collect()} == {1: "fine", 2: "fine", 3: "unreadable", 4: "unreadable", 5: "partly_unreadable"}


def test_metrics_of_odd_pages(spark):
    rows = [
        token(1, 0, "ab", 0.2), token(1, 1, "abcd", 0.8, (470, 0, 600, 20)), token(1, 2, "x", None, (0, 0, 6, 20)), token(1, 3, "x", 7.0), token(1, 4, "gone", 0.1, (480, 0, 500, 20)),
        token(2, 0, "gone", 0.9, (0, 0, 1, 20)), token(3, 0, "a", None), token(4, 0, None, 0.3), (5, 0, "a", 0.4, None, 0.0, 9.0, 20.0), (6, 0, "a", 0.4, 0.0, 0.0, None, 20.0),
    ]
    pages = tokens.pages_of(spark.createDataFrame(rows, TOKEN))
    got = {r[0]: tuple(round(x, 6) for x in r[1:]) for r in tokens.token_metrics(pages).collect()}
    assert got == {1: (4, 0.6, 0.35, 0.5, 0.333333, 15.0), 3: (1, 0, 0, 0, 0, 20), 4: (1, 0, 0.3, 1, 0, 20), 5: (1, 0.4, 0.4, 1, 1, 9)}
    assert tokens.token_metrics(pages.limit(0)).count() == 0


def test_rows_shuffle_nothing(spark):
    assert "Exchange" not in plan_of(spark, "cluster_rows")


def test_rows_follow_the_running_mean(spark):
    rows = [token(1, i, box=(0, y, 9, y + h)) for i, (y, h) in enumerate([(0, 20), (11, 20), (19, 20), (60, 40), (80, 20), (300, 2)])]
    rows += [token(2, 5, box=(50, 0, 60, 10)), token(2, 1, box=(0, 0, 9, 10)), token(3, 0)]
    got = recheck.cluster_rows(tokens.pages_of(spark.createDataFrame(rows, TOKEN)))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 1), (1, 5, 2), (2, 1, 0), (2, 5, 0), (3, 0, 0)]
    long = spark.range(30_000).select(F.lit(1).cast("long").alias("group_id"), F.col("id").alias("token_index"), F.lit("w").alias("text"), F.lit(0.5).alias("score"), F.lit(0.0).alias("left"), (F.col("id") * 20.0).alias("top"), F.lit(9.0).alias("right"), (F.col("id") * 20.0 + 10).alias("bottom"))
    assert recheck.cluster_rows(tokens.pages_of(long)).where("row = token_index").count() == 30_000


def test_labels_shuffle_no_page(spark):
    plan = plan_of(spark, "associate_labels")
    assert "hashpartitioning(group_id" not in plan and "SortMergeJoin" not in plan


def test_labels_of_one_field_with_aliases_that_begin_alike(spark):
    rows = [token(1, 0, "Name"), token(1, 1, "Named: Li"), token(1, 2, "Li"), token(2, 0, "N"), token(2, 9, "far", box=(0, 5000, 9, 5010))]
    labels = spark.createDataFrame([("name", "na"), ("name", "Name"), ("name", "name"), ("other", "named"), ("other", "")], "field string, alias string")
    got = tokens.associate_labels(tokens.pages_of(spark.createDataFrame(rows, TOKEN)), labels)
    assert sorted(map(tuple, got.drop("label_score").collect())) == [(1, "name", 0, 0), (1, "name", 0, 1), (1, "name", 0, 2), (1, "name", 1, 1), (1, "name", 1, 2), (1, "other", 1, 1), (1, "other", 1, 2)]
    assert got.where("label_score = 0.5").count() == 7


def test_claim_pages_hold_the_rows_of_claim_tokens(spark):
    assert same_rows(frame(spark, FOLDER, "claim_pages").select("group_id", F.inline("tokens")), frame(spark, FOLDER, "claim_tokens"))


def test_single_values_sort_no_window_of_tokens(spark):
    plan = plan_of(spark, "adjacent_single")
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") <= 3


def test_single_values_next_to_their_label(spark):
    rows = [token(1, 0, "C", 0.9), token(1, 1, "Class:"), token(1, 4, "c", 0.7), token(1, 5, "C", 0.9), token(2, 0, "my class"), token(2, 1, "C", 0.4), token(2, 2, "C", 0.4), token(3, 0, "class"), token(3, 1, "C", None), token(4, 0, None), token(4, 1, "C")]
    pages = tokens.pages_of(spark.createDataFrame(rows, TOKEN)).unionByName(spark.createDataFrame([(5, []), (6, None)], f"group_id long, tokens array<struct<{TOKEN.removeprefix('group_id long, ').replace(' ', ':').replace(',:', ',')}>>"))
    claims = spark.createDataFrame([(g, f, v) for g in range(1, 7) for f, v in (("class", "C"), ("class", "c"), ("class", "CC"), ("", "C"), (None, "C"), ("class", None))] + [(2, "class", "C")], "group_id long, field string, value string")
    got = sorted(map(tuple, documents.adjacent_single(claims, pages).collect()))
    assert got == [(g, "class", v, i, s) for g, i, s in ((1, 4, 0.7), (2, 2, 0.4), (3, 1, None)) for v in ("C", "c")]
