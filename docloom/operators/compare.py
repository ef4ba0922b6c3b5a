"""Two sources compared field by field: a value of one against the tokens near its label in the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import normalizers as n
from docloom.operators import evidence, tokens as t
from docloom.runtime import spread_out


def same_value(field: Column, a: Column, b: Column, periods: tuple[str, ...] = ("period",)) -> Column:
    """Equal without separators and case; periods of two readable dates by these dates."""
    x, y = n.range_key(a), n.range_key(b)
    return F.when(field.isin(*periods) & (x != "") & (y != ""), x == y).otherwise(n.compact_key(a) == n.compact_key(b))


def keyed_pages(pages: DataFrame) -> DataFrame:
    """``pages(group_id, tokens)`` as ``tokens.pages_of`` gives them, with compact keys for texts, and ``stream``, the page's text without white space."""
    kept = lambda x: [x[c].alias(c) for c in ("score", "left", "top", "right", "bottom")]
    keyed = F.transform("tokens", lambda x: F.struct(x["token_index"].alias("token_index"), evidence.compact_text(x["text"]).alias("key"), *kept(x)))
    stream = n.compact(F.array_join(F.transform("tokens", lambda x: F.coalesce(x["text"], F.lit(""))), ""))
    return pages.select("group_id", keyed.alias("tokens"), stream.alias("stream"))


def fields_of(labels: DataFrame) -> DataFrame:
    """(field, aliases, bare) of ``labels(field, alias)``, a small table: a field's aliases, without those that begin with another, and those of all fields."""
    words = labels.select("field", n.compact_key(F.col("alias")).alias("alias")).where("alias <> ''").distinct()
    named = words.groupBy("field").agg(F.collect_set("alias").alias("a"))
    least = F.filter("a", lambda x: ~F.exists("a", lambda y: (x != y) & F.startswith(x, y)))
    return named.select("field", least.alias("aliases")).crossJoin(F.broadcast(words.agg(F.collect_set("alias").alias("bare"))))


def search_labelled(claims: DataFrame, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``claims`` (group_id, field, value and what else they have) with the best evidence near a label of the field on their page, if there is any.

    ``pages`` as ``keyed_pages`` gives them: a claim meets its page once, and what is
    near the labels (as in ``tokens.associate_labels``) is found and searched in
    that row. The tokens near a label are a text of their own; a single character
    needs a token of its own, of the best score. The confidence is that of the weakest token.
    The best has the highest similarity, then confidence, then label score;
    ``is_unique``: all labels gave one text. Blank values have none.
    """
    given = claims.columns
    fields = fields_of(labels)
    asked = claims.where(n.compact_key(F.col("value")) != "").join(F.broadcast(fields.select("field")), "field", "left_semi")
    met = spread_out(asked, "group_id").join(pages.select("group_id", "tokens"), "group_id").join(F.broadcast(fields), "field").withColumn("key", n.compact_key(F.col("value")))
    begins = lambda a, x: F.startswith(x["key"], a)
    marks = F.filter("tokens", lambda x: F.exists("aliases", lambda a: begins(a, x)))
    marked = met.select(*given, "key", "tokens", "aliases", "bare", F.explode(marks).alias("l"))
    label, alias = F.col("l"), F.get(F.filter("aliases", lambda a: begins(a, F.col("l"))), 0)
    marked = marked.withColumn("inline", F.col("l.key") != alias)

    def is_near(v: Column) -> Column:
        step = v["token_index"] - label["token_index"]
        by_place = t.is_near(label, v) & ~F.array_contains("bare", v["key"])
        return F.when(step == 0, F.col("inline")).otherwise(by_place)

    near = F.transform(F.filter("tokens", is_near), lambda v: F.struct(v["token_index"].alias("token_index"), v["key"].alias("key"), v["score"].alias("score")))
    near = marked.select(*given, "key", F.col("l.score").alias("label_score"), near.alias("near"))
    same = F.array_max(F.transform(F.filter("near", lambda v: v["key"] == F.col("key")), lambda v: F.struct(v["score"], v["token_index"].alias("token_index"))))
    alone = F.filter(F.array(same), lambda v: v.isNotNull())
    alone = F.transform(alone, lambda v: F.struct(v["token_index"].alias("token_index"), F.col("key").alias("key"), v["score"].alias("score")))
    near = near.select(*given, "key", "label_score", F.when(F.length("key") == 1, alone).otherwise(F.col("near")).alias("near"))
    rows = near.select(*given, "key", "label_score", evidence.joined_keys(F.col("near")).alias("stream"), evidence.key_parts(F.col("near")).alias("parts"))
    hits = evidence.search_rows(rows, 1).select(*given, "label_score", "found", "similarity", F.col("weakest").alias("confidence"))
    rank = F.struct("similarity", F.coalesce("confidence", F.lit(0.0)).alias("c"), F.coalesce("label_score", F.lit(0.0)).alias("l"), "found", "confidence", "label_score")
    best = hits.groupBy(*given).agg(F.max(rank).alias("b"), (F.min("found") == F.max("found")).alias("is_unique"))
    return best.select(*given, *[F.col(f"b.{c}").alias(c) for c in ("found", "similarity", "confidence", "label_score")], "is_unique")


def labelled_evidence(claims: DataFrame, tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Per (group_id, field, value) of ``claims`` its best evidence near a label of the field, as in ``search_labelled``."""
    wanted = claims.select("group_id", "field", "value").distinct()
    return search_labelled(wanted, keyed_pages(t.pages_of(tokens)), labels)


def best_on_pages(claims: DataFrame, spoken: DataFrame, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``claims`` (record_id, field, value and what else they have) with ``b``, the best evidence on the pages ``spoken(record_id, group_id)``.

    Of several pages the best is the one that agrees, then the most similar, then
    the surest, then the first.
    """
    given = claims.columns
    asked = claims.join(F.broadcast(labels.select("field").distinct()), "field", "left_semi").select(given)
    seen = search_labelled(asked.join(spoken.select("record_id", "group_id"), "record_id"), pages, labels)
    agrees = F.coalesce(same_value(F.col("field"), F.col("value"), F.col("found")), F.lit(False))
    rank = F.struct(agrees.alias("agrees"), "similarity", F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("group_id")).alias("first"), "found", "confidence", "label_score", "is_unique")
    return seen.groupBy(*given).agg(F.max(rank).alias("b"))


def evidence_columns() -> list[Column]:
    """What the best evidence says of a claim."""
    return [*[F.col(f"b.{c}").alias(c) for c in ("found", "similarity", "confidence", "label_score", "is_unique")], (-F.col("b.first")).alias("group_id")]


def compare_sources(claims: DataFrame, pages: DataFrame, tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """``claims(record_id, field, value)`` against the tokens of the record's pages: consistent, conflict, or no evidence.

    ``pages(record_id, group_id)``. The evidence is that of ``best_on_pages``. Blank
    values are left out.
    """
    wanted = claims.where(n.compact_key(F.col("value")) != "").select("record_id", "field", "value").distinct()
    best = best_on_pages(wanted, pages, keyed_pages(t.pages_of(tokens)), labels)
    out = wanted.join(best, ["record_id", "field", "value"], "left")
    status = F.when(F.col("b").isNull(), "no evidence").when(F.col("b.agrees"), "consistent").otherwise("conflict")
    return out.select("record_id", "field", "value", status.alias("status"), *evidence_columns())


def weak_document_evidence(tokens: DataFrame, classes: str = "(?:A[123]|B[12]|C[1-6]|[DEFMNP])") -> DataFrame:
    """Pages that may be a licence without a label: just one driving class, and two dates beside a nationality, or three dates.

    (group_id, n_classes, n_dates, is_weak_evidence), one row for each page.
    """
    text = F.upper(n.compact(F.col("text")))
    dated = text.rlike(r"^(?:19|20)\d{2}[-/.年]?\d{1,2}[-/.月]?\d{1,2}日?$")
    out = tokens.groupBy("group_id").agg(F.count_distinct(F.when(text.rlike(f"^{classes}$"), text)).alias("n_classes"), F.count_if(dated).alias("n_dates"), F.bool_or(text.isin("中国", "CHN", "国籍")).alias("named"))
    return out.select("group_id", "n_classes", "n_dates", ((F.col("n_classes") == 1) & (F.col("n_dates") >= F.when(F.col("named"), 2).otherwise(3))).alias("is_weak_evidence"))
