"""OCR tokens: clipping, metrics, bands, and joins of labels with values.

Frame: ``tokens(group_id, token_index, text, score, left, top, right, bottom)``, one page
per group. All spatial joins have the page as their equal key; ranges are a
residual condition, so work is bounded by a page's own tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.normalizers import compact_key
from docloom.runtime import ship

LOW_SCORE = 0.65
METRICS = {"n_tokens": "long", "mean_score": "double", "lower_quartile": "double", "low_tokens": "double", "low_characters": "double", "median_side": "double"}


def clip_tokens(tokens: DataFrame, width: float = 480, height: float = 400) -> DataFrame:
    """Boxes clipped to the page; those under 2 pixels a side are dropped; scores outside 0..1 become null."""
    edge = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(most)))
    clipped = tokens.withColumns({"left": edge("left", width), "right": edge("right", width), "top": edge("top", height), "bottom": edge("bottom", height)})
    clipped = clipped.withColumn("score", F.when(F.col("score").between(0, 1), F.col("score")))
    return clipped.where("right - left >= 2 AND bottom - top >= 2")


def pages_of(tokens: DataFrame) -> DataFrame:
    """(group_id, tokens): rows of tokens gathered into one row per page, an array by token index."""
    token = F.struct("token_index", "text", "score", "left", "top", "right", "bottom")
    return tokens.groupBy("group_id").agg(F.sort_array(F.collect_list(token)).alias("tokens"))


def _percentile(values, page, counts, share: float):
    """What F.percentile gives for the values of each page; ``page`` numbers them, ``counts`` says how many each page has."""
    ordered = np.append(values[np.lexsort((values, page))], 0.0)
    at = np.maximum(counts - 1, 0) * share
    first, low = np.cumsum(counts) - counts, np.floor(at).astype(int)
    a, b = ordered[first + low], ordered[first + np.ceil(at).astype(int)]
    return np.where(a == b, a, (low + 1 - at) * a + (at - low) * b)


def _measure(batches):
    """Metrics of the pages in Arrow batches of (group_id, tokens)."""
    for batch in batches:
        lists, n = batch.column("tokens"), batch.num_rows
        flat, page = lists.flatten(), np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        of = lambda c: pc.struct_field(flat, c)
        within = lambda c, most: np.fmin(np.fmax(of(c).to_numpy(zero_copy_only=False).astype(float), 0.0), most)
        side = np.minimum(within("right", 480.0) - within("left", 480.0), within("bottom", 400.0) - within("top", 400.0))
        score, size = of("score").to_numpy(zero_copy_only=False).astype(float), pc.fill_null(pc.utf8_length(of("text")), 0).to_numpy()
        kept = side >= 2
        scored = kept & (score >= 0) & (score <= 1)
        low = scored & (score < LOW_SCORE)
        count = lambda rows: np.bincount(page[rows], minlength=n)
        total = lambda rows, x: np.bincount(page[rows], x[rows], n)
        share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
        n_tokens, n_scored, weight = count(kept), count(scored), total(scored, size)
        quartile = np.where(n_scored > 0, _percentile(score[scored], page[scored], n_scored, 0.25), 0.0)
        metrics = [n_tokens, share(total(scored, score * size), weight), quartile, share(count(low), n_scored), share(total(low, size), weight), _percentile(side[kept], page[kept], n_tokens, 0.5)]
        yield pa.RecordBatch.from_arrays([batch.column("group_id"), *map(pa.array, metrics)], names=["group_id", *METRICS]).filter(pa.array(n_tokens > 0))


def token_metrics(pages: DataFrame) -> DataFrame:
    """Per page: length-weighted mean score, lower quartile, shares of low scores, median height.

    ``pages(group_id, tokens)`` as ``pages_of`` gives them. Tokens are clipped as by
    ``clip_tokens``; a page that keeps none gives no row. Each page is measured where
    it stands, so nothing is shuffled.
    """
    ship(pages.sparkSession)
    schema = ", ".join([f"group_id {pages.schema['group_id'].dataType.simpleString()}", *[f"{c} {kind}" for c, kind in METRICS.items()]])
    return pages.select("group_id", "tokens").mapInArrow(_measure, schema)


def anchor_bands(tokens: DataFrame, anchors: tuple[str, ...] = ("the", "de", "der", "la"), margin: float = 1.5) -> DataFrame:
    """The vertical band around a page's anchor tokens, and how many tokens have their centre in it."""
    is_anchor = F.lower("text").isin(*anchors)
    band = tokens.where(is_anchor).groupBy("group_id").agg(F.min("top").alias("first"), F.max("bottom").alias("last"), (F.percentile(F.col("bottom") - F.col("top"), F.lit(0.5)) * margin).alias("m"), F.count("*").alias("n_anchors"))
    band = band.select("group_id", (F.col("first") - F.col("m")).alias("band_top"), (F.col("last") + F.col("m")).alias("band_bottom"), "n_anchors")
    centre = (F.col("top") + F.col("bottom")) / 2
    inside = tokens.join(band, "group_id").where(centre.between(F.col("band_top"), F.col("band_bottom")))
    counted = inside.groupBy("group_id").agg(F.count("*").alias("n_inside"))
    return band.join(counted, "group_id", "left").fillna(0, ["n_inside"])


def detect_side(tokens: DataFrame, front: tuple[str, ...] = ("of", "la", "und"), back: tuple[str, ...] = ("and", "les", "mit")) -> DataFrame:
    """Front, back, both or unknown by which markers are more."""
    word = F.lower("text")
    n = tokens.groupBy("group_id").agg(F.count_if(word.isin(*front)).alias("n_front"), F.count_if(word.isin(*back)).alias("n_back"))
    side = F.when((F.col("n_front") == 0) & (F.col("n_back") == 0), "unknown").when(F.col("n_front") > F.col("n_back"), "front").when(F.col("n_front") < F.col("n_back"), "back").otherwise("both")
    return n.withColumn("side", side)


def _labelled(tokens: DataFrame, is_label: Column) -> tuple[DataFrame, DataFrame]:
    columns = ["token_index", "text", "score", "left", "top", "right", "bottom"]
    label = tokens.where(is_label).select("group_id", *[F.col(c).alias(f"l_{c}") for c in columns])
    return label, tokens.where(~is_label)


def is_near(label: Column | dict[str, Column], value: Column | dict[str, Column]) -> Column:
    """Whether a token may be a value of another one, which is a label: on its row, below it, or among its neighbours in order; as ``associate_labels`` says."""
    h = F.greatest(label["bottom"] - label["top"], F.lit(1.0))
    across = lambda before, after: (value["right"] >= label["left"] - before * h) & (value["left"] <= label["right"] + after * h)
    centres = F.abs(value["top"] + value["bottom"] - label["top"] - label["bottom"]) / 2
    row = (centres <= 1.1 * F.greatest(h, value["bottom"] - value["top"])) & across(2, 30)
    below = (value["top"] >= label["top"] - h / 2) & (value["top"] - label["bottom"] <= 6 * h) & across(3, 18)
    return (value["token_index"] - label["token_index"]).between(-3, 6) | row | below


def associate_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(group_id, field, label_index, value_index, label_score): tokens near the labels of ``labels(field, alias)``.

    A token that begins with an alias is a label of its field; what follows the
    alias in it is a value of its own. A value is near on the label's row (centres
    1.1 of the larger height apart at most, from 2 label heights left to 30 right),
    or below it (6 heights down, from 3 left to 18 right), or 3 tokens before to 6
    after it. Tokens that are just an alias are never values. ``pages(group_id,
    tokens)`` as ``pages_of`` gives them: labels meet values in their page's row, so
    nothing is shuffled. Labels are a small table.
    """
    words = labels.select("field", compact_key(F.col("alias")).alias("alias")).where("alias <> ''").distinct()
    begun = words.select(F.col("field").alias("f"), F.col("alias").alias("shorter"))
    # of a field's aliases, one at most begins a token and goes on from no other
    least = words.join(F.broadcast(begun), (F.col("f") == F.col("field")) & F.startswith("alias", "shorter") & (F.col("alias") != F.col("shorter")), "left_anti")
    page = pages.select("group_id", "tokens", F.transform("tokens", lambda t: compact_key(t["text"])).alias("key"))
    keyed = F.arrays_zip("tokens", "key")  # exploded as an expression: of a column Spark would first filter by size, and compute all pages again for that
    found = page.select("*", F.explode(keyed).alias("l")).join(F.broadcast(least), F.startswith("l.key", "alias"))
    near = found.select("group_id", "field", "l", (F.col("l.key") != F.col("alias")).alias("inline"), F.explode(keyed).alias("v"))
    near = near.select("group_id", "field", "inline", *[F.col(f"l.tokens.{c}").alias(f"l_{c}") for c in ("token_index", "score", "left", "top", "right", "bottom")], "v.tokens.*", "v.key")
    box = ["token_index", "left", "top", "right", "bottom"]
    step = F.col("token_index") - F.col("l_token_index")
    by_place = is_near({c: F.col(f"l_{c}") for c in box}, {c: F.col(c) for c in box})
    near = near.where(((step == 0) & F.col("inline")) | ((step != 0) & by_place))
    bare = F.broadcast(words.select(F.col("alias").alias("bare")).distinct())
    near = near.join(bare, (F.col("key") == F.col("bare")) & (F.col("token_index") != F.col("l_token_index")), "left_anti")
    return near.select("group_id", "field", F.col("l_token_index").alias("label_index"), F.col("token_index").alias("value_index"), F.col("l_score").alias("label_score"))


def nearest_on_line(tokens: DataFrame, is_label: Column, fits: Column) -> DataFrame:
    """For each label the nearest fitting token on its line: 3 x vertical gap + horizontal gap, earliest on ties."""
    label, value = _labelled(tokens, is_label)
    dy = F.abs(F.col("top") - F.col("l_top"))
    dx = F.greatest(F.col("left") - F.col("l_right"), F.lit(0.0))
    pairs = label.join(value.where(fits), "group_id").where((dy <= F.col("l_bottom") - F.col("l_top")) & (F.col("left") >= F.col("l_left")))
    ranked = pairs.withColumn("distance", 3 * dy + dx).groupBy("group_id", "l_token_index").agg(F.min(F.struct("distance", "token_index", "text")).alias("best"))
    return ranked.select("group_id", F.col("l_token_index").alias("label_index"), F.col("best.token_index").alias("value_index"), F.col("best.text").alias("value"), F.col("best.distance").alias("distance"))


def class_after_label(tokens: DataFrame, is_label: Column, fits: Column, reach: int = 6) -> DataFrame:
    """For each label the nearest fitting token among the next ``reach``; the higher score, then the earlier, on ties."""
    label, value = _labelled(tokens, is_label)
    gap = F.col("token_index") - F.col("l_token_index")
    pairs = label.join(value.where(fits), "group_id").where(gap.between(1, reach))
    best = F.min(F.struct(gap.alias("gap"), (-F.coalesce("score", F.lit(-1.0))).alias("s"), "token_index"))
    return pairs.groupBy("group_id", "l_token_index").agg(best.alias("b")).select("group_id", F.col("l_token_index").alias("label_index"), F.col("b.token_index").alias("value_index"))


def search_short(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Per (group_id, target) of 2 to 4 characters: the token of equal length that differs in exactly one.

    The highest score wins, then the latest token.
    """
    short = targets.where(F.length("target").between(2, 4)).withColumn("size", F.length("target"))
    sized = tokens.withColumn("size", F.length("text"))
    near = short.join(sized, ["group_id", "size"]).where(F.levenshtein("target", "text") == 1)
    differ = F.aggregate(F.zip_with(F.split("target", ""), F.split("text", ""), lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, v: a + v)
    best = near.where(differ == 1).groupBy("group_id", "target").agg(F.max(F.struct(F.coalesce("score", F.lit(-1.0)).alias("s"), "token_index", "text")).alias("b"))
    return best.select("group_id", "target", F.col("b.text").alias("found"), F.col("b.token_index").alias("token_index"))


def line_windows(lines: DataFrame, is_label: Column, before: int = 1, after: int = 2) -> DataFrame:
    """Lines from ``before`` to ``after`` around each label line, within its section; blank and repeated lines once.

    ``lines(group_id, section, line_no, line)``.
    """
    label = lines.where(is_label).select("group_id", "section", F.col("line_no").alias("at"))
    near = label.join(lines.where(F.trim("line") != ""), ["group_id", "section"]).where(F.col("line_no").between(F.col("at") - before, F.col("at") + after))
    first = near.groupBy("group_id", "section", "at", "line").agg(F.min("line_no").alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return first.groupBy("group_id", "section", "at").agg(joined.alias("window"), F.count("*").alias("n_lines"))


def split_sections(lines: DataFrame, is_header: Column) -> DataFrame:
    """``lines(group_id, line_no, line)`` with the number of headers up to each line as its section."""
    w = Window.partitionBy("group_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.sum(is_header.cast("long")).over(w))
