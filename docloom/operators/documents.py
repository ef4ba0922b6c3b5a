"""Rules over whole documents: gates, page order, references, addresses by consensus, tables of coordinates.

Arrays hold what one document has (its pages, its lines); everything else is
aggregates, windows and equi-joins by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import normalizers as n
from docloom.functions.similarity import common_prefix, is_subsequence

#: Words and marks of the rendered table, and the mark of a turned copy's name. Fixed values.
TEXT_CELL, UNREADABLE, TABLE_HEAD, COPY = "文字", "[无法识别]", "| 字段 | 内容 |\n| --- | --- |", "方向校正_"
SPOTS = "array<struct<text string, box array<double>, bbox array<double>>>"


def diffuse_background(metrics: DataFrame) -> DataFrame:
    """Whether a bright mask over most fields is a bright page: many candidates, and all text well readable.

    ``metrics(id, fields, candidates, scored, mean, p25, low_tokens, low_chars, low_under_glare)``;
    a null metric counts as 0. A suppressed page has no triggered fields.
    """
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = of("candidates") / F.greatest(of("fields"), F.lit(1))
    widespread = (of("fields") >= 6) & (of("candidates") >= 4) & (share >= 0.65)
    readable = (of("scored") >= 6) & (of("mean") >= 0.90) & (of("p25") >= 0.82) & (of("low_tokens") <= 0.10) & (of("low_chars") <= 0.10) & (of("low_under_glare") == 0)
    return metrics.select("id", F.round(share, 4).alias("share"), (widespread & readable).alias("suppressed"))


def streak_fallback(metrics: DataFrame) -> DataFrame:
    """Two streaks or more across fields, within a narrow range of glare: ``metrics(id, glare, streaks, streak_ratio, candidates, overlap)``; null counts as 0."""
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    found = of("glare").between(0.015, 0.023) & (of("streaks") >= 2) & (of("streak_ratio") >= 0.002) & (of("candidates") >= 2) & (of("overlap") >= 0.08)
    return metrics.select("id", found.alias("detected"), F.when(found, "multiple_streaks_crossing_text").alias("basis"))


def document_gate(reports: DataFrame) -> DataFrame:
    """One verdict per document from its images' ``reports(group_id, position, side_label, code, error)``.

    An error of any image fails the check as a whole; else any code rejects the
    document, with the issues of all sides in order of position. Null and ''
    are no code and no error.
    """
    failed = F.bool_or(F.coalesce(F.col("error") != "", F.lit(False)))
    issue = F.when(F.col("code") != "", F.struct("position", F.concat_ws(":", "side_label", "code").alias("text")))
    out = reports.groupBy("group_id").agg(failed.alias("failed"), F.array_sort(F.collect_list(issue)).alias("issues"))
    verdict = F.when(F.col("failed"), "check failed").when(F.size("issues") > 0, "rejected").otherwise("accepted")
    return out.select("group_id", verdict.alias("verdict"), F.when(F.col("failed"), "").otherwise(F.array_join(F.transform("issues", lambda x: x["text"]), ",")).alias("issues"))


def order_identity_pages(pages: DataFrame) -> DataFrame:
    """``pages(group_id, page_pos, side, name)`` with their place from 0: of more than two, backs first; turned copies last; then by position."""
    group = Window.partitionBy("group_id")
    late = (F.count("*").over(group) > 2) & ~F.coalesce(F.col("side") == "back", F.lit(False))
    sized = pages.withColumns({"late": late, "copied": F.coalesce(F.startswith("name", F.lit(COPY)), F.lit(False))})
    place = F.row_number().over(group.orderBy("late", "copied", "page_pos", "name")) - 1
    return sized.select("group_id", "page_pos", place.cast("long").alias("place"))


def merge_references(references: DataFrame) -> DataFrame:
    """Per document its file names, and its (material, name) references, each once and in the order first seen.

    ``references(group_id, position, material, name)``. Repeats are folded before
    they meet in their document.
    """
    refs = references.groupBy("group_id", "material", "name").agg(F.min("position").alias("first"))
    ref = F.struct("first", F.concat_ws("/", "material", "name").alias("text"))
    names = refs.groupBy("group_id", "name").agg(F.min("first").alias("first"), F.collect_list(ref).alias("refs"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["text"]), ",")
    return names.groupBy("group_id").agg(joined(F.collect_list(F.struct("first", F.col("name").alias("text")))).alias("names"), joined(F.flatten(F.collect_list("refs"))).alias("refs"))


def adjacent_single(values: DataFrame, pages: DataFrame) -> DataFrame:
    """Evidence for one-character values: an equal token at most three tokens after one that holds the field's label.

    ``values(group_id, field, value)``, ``pages(group_id, tokens)`` with tokens in
    order of their index. The highest score wins (null counts as 0), then the last
    token; values without evidence, longer ones and blank labels give no row. Only
    tokens of one character leave their page, with the three before them, and meet
    the values that ask for them.
    """
    keyed = pages.select("group_id", "tokens", F.transform("tokens", lambda t: n.compact_key(t["text"])).alias("key")).select("group_id", "key", F.arrays_zip("tokens", "key").alias("z"))
    short = F.filter(F.slice(F.sequence(F.lit(0), F.size("key")), F.lit(2), F.size("key")), lambda i: F.length(F.element_at("key", i)) == 1)

    def spot(i: Column) -> Column:
        token = F.element_at("z", i)["tokens"]
        before = F.filter(F.slice("z", F.greatest(i - 3, F.lit(1)), F.least(i - 1, F.lit(3))), lambda b: b["tokens"]["token_index"] >= token["token_index"] - 3)
        return F.struct(token["token_index"].alias("token_index"), F.coalesce(token["score"], F.lit(0.0)).alias("score"), F.element_at("key", i).alias("key"), F.transform(before, lambda b: b["key"]).alias("before"))

    spots = keyed.select("group_id", F.inline(F.transform(short, spot)))
    asked = values.select("group_id", "field", "value", n.compact_key(F.col("field")).alias("label"), n.compact_key(F.col("value")).alias("key")).where("label <> '' AND length(key) = 1")
    near = asked.join(spots, ["group_id", "key"]).where(F.exists("before", lambda b: F.contains(b, F.col("label"))))
    best = near.groupBy("group_id", "key", "field", "value").agg(F.max(F.struct("score", "token_index")).alias("b"))
    return best.select("group_id", "field", "value", "b.token_index", F.nullif("b.score", F.lit(0.0)).alias("confidence"))


def _common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


#: Ends of an address that a lost door number may follow. Fixed values.
BEFORE_NUMBERS = "村屯组号室户"


def consensus_address(addresses: DataFrame) -> DataFrame:
    """``addresses(id, current, candidates)``: the address that a document's candidate readings agree on, else the current one.

    Of several readings, the only one that all others merely add characters to
    (8 equal ones before and 3 after). One reading wins over a blank if read twice,
    over a current value with characters inserted before its last 4 if read twice,
    and over one with 2 to 4 digits behind the door. Null is ''.
    """
    own, distinct = F.col("own"), F.col("distinct")
    inside = lambda a, b: (F.length(a) < F.length(b)) & is_subsequence(a, b)
    base = lambda: F.filter(distinct, lambda a: F.forall(distinct, lambda b: (a == b) | (inside(a, b) & (common_prefix(a, b) >= 8) & (_common_suffix(a, b) >= 3))))
    only, twice = F.try_element_at(distinct, F.lit(1)), F.size("candidates") >= 2
    tail = F.substring(own, F.length(only) + 1, F.length(own))
    numbered = F.startswith(own, only) & tail.rlike("^[0-9]{2,4}$") & F.substring(only, -1, 1).isin(*BEFORE_NUMBERS)
    single = F.when((twice & (own == "")) | (own == only) | (twice & inside(only, own) & (_common_suffix(only, own) >= 4)) | numbered, only)
    found = F.when(F.size(distinct) > 1, n.once(base(), lambda b: F.when(F.size(b) == 1, b[0]))).when(F.size(distinct) == 1, single)
    read = addresses.withColumns({"own": n.compact(F.coalesce("current", F.lit(""))), "distinct": F.array_distinct("candidates")})
    return read.select("id", F.coalesce(found, "current", F.lit("")).alias("address"))


def coordinates_to_table(raw: Column) -> Column:
    """A coordinate answer as a two-column table: visual rows from top to bottom, their cells paired from left to right.

    A row of one cell is text, an odd last cell has an unreadable partner, texts
    without a box follow. An answer that is no list gives its lines. A row starts
    where a centre is further from the row's mean than max(12, 0.7 of its height).
    """
    escaped = lambda x: F.replace(F.replace(n.trim(x), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    line = lambda a, b: F.concat(F.lit("| "), a, F.lit(" | "), b, F.lit(" |"))
    alone = lambda x: line(F.lit(TEXT_CELL), x)
    said = F.filter(F.from_json(F.when(F.trim(raw).startswith("["), raw), SPOTS), lambda s: n.trim(F.coalesce(s["text"], F.lit(""))) != "")
    boxed = lambda s: F.coalesce(s["box"], s["bbox"])
    placed = F.filter(said, lambda s: F.coalesce(F.size(boxed(s)), F.lit(0)) >= 4)
    spots = F.array_sort(F.transform(placed, lambda s: F.struct(((boxed(s)[1] + boxed(s)[3]) / 2).alias("y"), boxed(s)[0].alias("x"), F.greatest(F.lit(1.0), boxed(s)[3] - boxed(s)[1]).alias("h"), escaped(s["text"]).alias("t"))))
    start = F.expr("named_struct('row', 0, 'sum', 0D, 'n', 0, 'h', 0D, 'out', CAST(array() AS array<struct<row: int, x: double, t: string>>))")

    def step(s: Column, p: Column) -> Column:
        new = (s["n"] > 0) & (F.abs(p["y"] - s["sum"] / s["n"]) > F.greatest(F.lit(12.0), 0.7 * s["h"]))
        row = s["row"] + new.cast("int")
        return F.struct(
            row.alias("row"), F.when(new, p["y"]).otherwise(s["sum"] + p["y"]).alias("sum"), F.when(new, 1).otherwise(s["n"] + 1).alias("n"),
            F.when(new, p["h"]).otherwise(F.greatest(s["h"], p["h"])).alias("h"), F.concat(s["out"], F.array(F.struct(row.alias("row"), p["x"].alias("x"), p["t"].alias("t")))).alias("out"),
        )

    cells = F.array_sort(F.aggregate(spots, start, step)["out"])
    of_row = lambda r: F.transform(F.filter(cells, lambda c: c["row"] == r), lambda c: c["t"])

    def render(row: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(row), F.lit(2)), lambda i: line(F.element_at(row, i), F.coalesce(F.try_element_at(row, i + 1), F.lit(UNREADABLE))))
        return F.when(F.size(row) == 1, F.array(alone(row[0]))).otherwise(pairs)

    rows = F.flatten(F.transform(F.array_distinct(F.transform(cells, lambda c: c["row"])), lambda r: render(of_row(r))))
    loose = F.transform(F.filter(said, lambda s: F.coalesce(F.size(boxed(s)), F.lit(0)) < 4), lambda s: alone(escaped(s["text"])))
    lines = F.transform(F.filter(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: n.trim(x) != ""), lambda x: alone(escaped(x)))
    return F.array_join(F.concat(F.array(F.lit(TABLE_HEAD)), F.when(said.isNull(), lines).otherwise(F.concat(rows, loose))), "\n")
