"""Records of one source put right by another: which pages speak for a record, what is missing, which conflicts are settled.

A case has records (long form: one row a field) and pages of tokens. Rules work one
behind another on sets of changes; each reads the values that its forerunner
left, and each change gives one row of the audit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import normalizers as n
from docloom.functions import similarity
from docloom.operators import compare, evidence, places, recheck
from docloom.operators import tokens as t
from docloom.runtime import materialize

#: Fields whose value the other source may replace, by their kind of check.
OVERRIDABLE = ["address", "identity", "licence", "date", "issue", "period", "class", "archive", "plate", "vin", "engine", "mass", "people", "dimensions"]
GRAM = 4

# --- which pages speak for which record --------------------------------------------------


def page_streams(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """(case_id, group_id, stream): the compact texts of each page's tokens, in order."""
    read = tokens.select("group_id", "token_index", n.compact(F.coalesce("text", F.lit(""))).alias("text")).join(pages.select("case_id", "group_id"), "group_id")
    listed = F.array_sort(F.collect_list(F.struct("token_index", "text")))
    return read.groupBy("case_id", "group_id").agg(F.array_join(F.transform(listed, lambda t: t["text"]), "").alias("stream"))


def pieces(text: Column, size: int) -> Column:
    """The distinct substrings of ``size`` characters."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def contained_keys(keys: DataFrame, streams: DataFrame) -> DataFrame:
    """(case_id, key, group_id): which streams of a case hold which of its keys as they stand.

    An inverted index lists the pages of each piece of GRAM characters (of one, for
    shorter keys). A key is looked up by that of its pieces which is on the fewest
    pages of the case; the pages found are then searched. A key with a piece on no
    page is on none.
    """
    listed = F.explode(F.concat(pieces(F.col("stream"), GRAM), pieces(F.col("stream"), 1)))
    index = streams.select("case_id", "group_id", listed.alias("piece"))
    wanted = keys.select("case_id", "key").where("key <> ''").distinct()
    asked = wanted.select("case_id", "key", F.explode(F.when(F.length("key") >= GRAM, pieces(F.col("key"), GRAM)).otherwise(pieces(F.col("key"), 1))).alias("piece"))
    index = materialize(index.join(asked.select("case_id", "piece").distinct(), ["case_id", "piece"], "left_semi"))
    pages_of = index.groupBy("case_id", "piece").agg(F.count("*").alias("n"))
    rarest = asked.join(pages_of, ["case_id", "piece"], "left").groupBy("case_id", "key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r"))
    near = rarest.where("r.n > 0").select("case_id", "key", F.col("r.piece").alias("piece")).join(index, ["case_id", "piece"])
    return near.join(streams, ["case_id", "group_id"]).where(F.contains("stream", F.col("key"))).select("case_id", "key", "group_id")


def restrict_evidence(keys: DataFrame, pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """(record_id, group_id, basis): the pages that may speak for each record.

    ``keys(case_id, record_id, record_pos, key)``: every record at least once, blank
    keys included; ``pages(case_id, group_id, page_pos)``; both positions count
    from 0. The only record of a case has all its pages. Of several, each has the
    pages that hold one of its keys; a record without any has the page at its own
    position, if there are as many pages as records; else none.
    """
    return _restrict(keys, pages, lambda wanted: page_streams(tokens, wanted))


def _restrict(keys: DataFrame, pages: DataFrame, streams_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As ``restrict_evidence``; ``streams_of`` gives pages their ``stream``."""
    records = keys.select("case_id", "record_id", "record_pos").distinct()
    sizes = records.groupBy("case_id").agg(F.count("*").alias("n_records")).join(pages.groupBy("case_id").agg(F.count("*").alias("n_pages")), "case_id")
    records = materialize(records.join(sizes, "case_id"))  # read by each of the ways
    only = records.where("n_records = 1").join(pages, "case_id").select("record_id", "group_id", F.lit("only record").alias("basis"))
    several = records.where("n_records > 1").select("case_id").distinct()
    compacted = keys.select("case_id", "record_id", n.compact(F.coalesce("key", F.lit(""))).alias("key")).where("key <> ''").join(several, "case_id", "left_semi")
    found = contained_keys(compacted, streams_of(pages.join(several, "case_id", "left_semi")))
    keyed = materialize(compacted.join(found, ["case_id", "key"]).select("record_id", "group_id", F.lit("key").alias("basis")).distinct())
    rest = records.where("n_records > 1 AND n_records = n_pages").join(keyed, "record_id", "left_anti")
    placed = rest.join(pages, (rest["case_id"] == pages["case_id"]) & (F.col("record_pos") == F.col("page_pos"))).select("record_id", "group_id", F.lit("position").alias("basis"))
    return only.unionByName(keyed).unionByName(placed)


# --- comparison without labels ---------------------------------------------------------------


def compare_fulltext(claims: DataFrame, pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """``claims(record_id, field, value)`` against all tokens of the record's pages, labels or not.

    The best page agrees, or is the most similar, the surest, the first, in this
    order. ``n_candidates`` windows were scored for the claim on all its pages; the
    exhaustive way would score every window. Blank values are left out; values of
    one character have no evidence.
    """
    wanted = claims.where(n.compact_key(F.col("value")) != "").select("record_id", "field", "value").distinct()
    placed = materialize(wanted.join(pages.select("record_id", "group_id"), "record_id"))
    targets = placed.select("group_id", F.col("value").alias("target")).distinct()
    seen = evidence.search_evidence(tokens, targets).select("group_id", F.col("target").alias("value"), "found", "similarity", "confidence")
    keyed = targets.select("group_id", "target", n.compact_key(F.col("target")).alias("key")).where(F.length("key") >= 2)
    streams = materialize(evidence.token_stream(tokens).select("group_id", "stream"))
    tried = evidence.seeded_windows(keyed.join(streams, "group_id").where(~F.contains("stream", F.col("key"))).select("group_id", "target", "key"), streams)
    tried = tried.groupBy("group_id", F.col("target").alias("value")).agg(F.count("*").alias("n"))
    each = placed.join(seen, ["group_id", "value"], "left").join(tried, ["group_id", "value"], "left")
    agrees = F.coalesce(compare.same_value(F.col("field"), F.col("value"), F.col("found")), F.lit(False))
    rank = F.struct(agrees.alias("agrees"), "similarity", F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("group_id")).alias("first"), "found", "confidence")
    best = each.groupBy("record_id", "field", "value").agg(F.max(F.when(F.col("found").isNotNull(), rank)).alias("b"), F.sum(F.coalesce("n", F.lit(0))).alias("n_candidates"))
    out = wanted.join(best, ["record_id", "field", "value"], "left")
    status = F.when(F.col("b").isNull(), "no evidence").when(F.col("b.agrees"), "consistent").otherwise("conflict")
    return out.select("record_id", "field", "value", status.alias("status"), F.col("b.found").alias("found"), F.col("b.similarity").alias("similarity"), F.col("b.confidence").alias("confidence"), (-F.col("b.first")).alias("group_id"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


# --- rules on sets of changes ------------------------------------------------------------------

KEEP = ["case_id", "record_id", "record_pos", "field", "field_pos", "kind", "value"]


def supplement_missing(values: DataFrame, candidates: DataFrame, pages: DataFrame, tokens: DataFrame, labels: DataFrame, least: float = 0.97) -> DataFrame:
    """Blank fields that the other source fills: (record_id, field, value, group_id, confidence, label_score).

    ``candidates(record_id, field, value)`` are that source's readings. Only cases with
    one record take part. A candidate needs equal evidence near the field's label
    on one of the pages ``(case_id, group_id, page_pos)``; of several, one that is
    unique on its page comes first, then the surest, then the surest label, then the
    first page. It is taken if it is unique, its score is ``least`` or more, its
    label's 0.95 or more, and, where its kind may be overridden, it has the form.
    """
    alone = values.groupBy("case_id").agg(F.min("record_id").alias("record_id"), F.max("record_id").alias("last")).where("record_id = last").select("case_id")
    blank = values.where(_is_blank()).join(alone, "case_id", "left_semi")
    return _supplements(blank, candidates, pages, compare.keyed_pages(t.pages_of(tokens)), labels, least).drop("old")


def _is_blank() -> Column:
    return n.compact_key(F.coalesce("value", F.lit(""))) == ""


def _supplements(blank: DataFrame, candidates: DataFrame, pages: DataFrame, read: DataFrame, labels: DataFrame, least: float = 0.97) -> DataFrame:
    """As ``supplement_missing``, for the fields ``blank`` of cases with one record, with their ``old`` value; ``read`` are keyed pages."""
    held = blank.join(F.broadcast(labels.select("field").distinct()), "field", "left_semi").select("case_id", "record_id", "field", "kind", F.coalesce("value", F.lit("")).alias("old"))
    asked = held.join(candidates.where(n.compact_key(F.col("value")) != "").select("record_id", "field", "value"), ["record_id", "field"])
    placed = asked.join(pages.select("case_id", "group_id", "page_pos"), "case_id").drop("case_id")
    seen = compare.search_labelled(placed, read, labels)
    equal = seen.where(compare.same_value(F.col("field"), F.col("value"), F.col("found")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rank = F.struct("is_unique", zero("confidence").alias("c"), zero("label_score").alias("l"), (-F.col("page_pos")).alias("first"), "group_id", "confidence", "label_score")
    best = equal.groupBy("record_id", "field", "kind", "old", "value").agg(F.max(rank).alias("b"))
    sound = F.col("b.is_unique") & (zero("b.confidence") >= least) & (zero("b.label_score") >= 0.95) & (~F.col("kind").isin(OVERRIDABLE) | n.check(F.col("kind"), F.col("value")))
    return best.where(sound).select("record_id", "field", "value", "b.group_id", "b.confidence", "b.label_score", "old")


#: Pairs of kinds that a record must hold in order: the first is no less (masses) or no later (days) than the second.
ORDERED = {"total": "curb", "registered": "issued"}


def settle_conflicts(conflicts: DataFrame, values: DataFrame) -> DataFrame:
    """Which conflicts the other source wins: ``conflicts`` with ``reason`` and ``changed``.

    ``conflicts(record_id, field, field_pos, kind, value, found, confidence, label_score,
    is_unique)``. The first rule that applies decides, as in ``reconcile.arbitrate``; an
    address must also be similar and name the same divisions, unless its score is
    0.995. Last, the record must still be in order (ORDERED): its conflicts are
    taken by the position of their field, and each sees what those before changed.
    """
    least = F.when(n.check(F.col("kind"), F.col("value")), 0.985).otherwise(0.97)
    score = F.coalesce("confidence", F.lit(0.0))
    is_address = F.coalesce(F.col("kind") == "address", F.lit(False))
    addresses = conflicts.where(is_address).withColumns({"a": n.compact(F.col("value")), "b": n.compact(F.col("found"))})
    alike = similarity.distinct_ratios(addresses.select("a", "b").distinct(), "a", "b", 0.90)
    none = {"a": F.lit(None).cast("string"), "b": F.lit(None).cast("string"), "ratio": F.lit(None).cast("double")}
    judged = addresses.join(alike, ["a", "b"], "left").unionByName(conflicts.where(~is_address).withColumns(none))  # what has no address to compare joins nothing
    here, there = places.administrative_prefix(F.col("a")), places.administrative_prefix(F.col("b"))
    reason = (
        F.when(~F.col("kind").isin(OVERRIDABLE), "not overridable").when(~F.col("is_unique"), "several candidates").when(F.coalesce("label_score", F.lit(0.0)) < 0.95, "label score")
        .when(score < least, "value score").when(~n.check(F.col("kind"), F.col("found")), "format").when((F.col("kind") == "address") & (F.coalesce("ratio", F.lit(0.0)) < 0.90), "another address")
        .when((F.col("kind") == "address") & (here != "") & (there != "") & (here != there) & (score < 0.995), "other divisions").otherwise("")
    )
    judged = judged.withColumn("reason", reason).drop("a", "b", "ratio")
    names = [*ORDERED, *ORDERED.values()]
    open_ones = judged.where(F.col("field").isin(names) & (F.col("reason") == "")).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("field_pos", "field", "found"))).alias("steps"))
    held = values.where(F.col("field").isin(names)).groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.coalesce("value", F.lit("")).alias("value")))).alias("state"))
    number = lambda x: F.regexp_extract(x, r"\d+(?:\.\d+)?", 0).try_cast("double")
    day = lambda x: F.regexp_replace(x, r"\D", "")

    def in_order(state: Column, field: Column) -> Column:
        total, curb, registered, issued = (F.coalesce(state[c], F.lit("")) for c in ("total", "curb", "registered", "issued"))
        masses = F.coalesce(number(total) >= number(curb), F.lit(True))
        days = (F.length(day(registered)) != 8) | (F.length(day(issued)) != 8) | (day(registered) <= day(issued))
        return F.when(field.isin("total", "curb"), masses).otherwise(days)

    def step(s: Column, x: Column) -> Column:
        proposed = F.map_zip_with(s["state"], F.create_map(x["field"], x["found"]), lambda k, old, new: F.coalesce(new, old))
        good = in_order(proposed, x["field"])
        return F.struct(F.when(good, proposed).otherwise(s["state"]).alias("state"), F.when(good, s["refused"]).otherwise(F.concat(s["refused"], F.array(x["field"]))).alias("refused"))

    start = F.struct("state", F.array().cast("array<string>").alias("refused"))
    refused = open_ones.join(held, "record_id").select("record_id", F.explode(F.aggregate("steps", start, step)["refused"]).alias("field"), F.lit(True).alias("disordered"))
    out = judged.join(refused, ["record_id", "field"], "left")
    reason = F.when(F.col("reason") != "", F.col("reason")).when(F.col("disordered"), "order of the record").otherwise("other source")
    return out.withColumn("reason", reason).withColumn("changed", F.col("reason") == "other source").drop("disordered")


AUDIT = ["record_id", "field", "old", "new", "rule", "detail"]


def _audit(changes: DataFrame, rule: str) -> DataFrame:
    """The audit of a rule: one row for each value that is another one now; ``changes`` have the old and the new one."""
    return changes.withColumn("old", F.coalesce("old", F.lit(""))).where("new <> old").withColumn("rule", F.lit(rule)).select(AUDIT)


def reconcile_sources(values: DataFrame, page_types: DataFrame, candidates: DataFrame, pages: DataFrame, tokens: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("vin", "plate", "plate_number"), twins: tuple[str, str] = ("plate", "plate_number")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(final values, audit, conflicts) of all cases.

    ``values(case_id, record_id, record_pos, field, field_pos, kind, value)``;
    ``page_types(case_id, page_pos, detected, text)``; ``candidates``, ``pages``, ``tokens``
    and ``labels`` as above. In this order, each rule on what the one before left:

    1. document type: the type of the latest page that has one, else that of the
       first record that has one, for every record of the case (field ``type``);
    2. supplements: blank fields of cases with one record;
    3. conflicts: each value but the type against the pages that may speak for its
       record; the second twin is left out where the first has a value, and a changed
       twin changes the other;
    4. nationality: the country's names become one, blanks follow texts or address.
    """
    return reconcile_pages(values, page_types, candidates, pages, t.pages_of(tokens), labels, keys, twins)


def reconcile_pages(values: DataFrame, page_types: DataFrame, candidates: DataFrame, pages: DataFrame, token_pages: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("vin", "plate", "plate_number"), twins: tuple[str, str] = ("plate", "plate_number")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``reconcile_sources``, of ``token_pages(group_id, tokens)`` as ``tokens.pages_of`` gives them.

    What a rule asks of a case (its types, whether it has one record, whether it
    names the country) is joined to its values once. A rule that concerns a few fields
    joins only these; the others pass by.
    """
    read = materialize(compare.keyed_pages(token_pages))  # read by supplements, keys and conflicts
    named = lambda text: F.contains(text, F.lit("中国")) | F.contains(text, F.lit("中华人民共和国"))
    of_pages = page_types.groupBy("case_id").agg(F.max(F.when(F.col("detected") != "", F.struct("page_pos", "detected"))).alias("late"), F.bool_or(named(F.coalesce("text", F.lit("")))).alias("on_page"))
    own = F.when((F.col("field") == "type") & (F.col("value") != ""), F.struct("record_pos", "value"))
    of_values = values.groupBy("case_id").agg(F.min(own).alias("own"), F.bool_or(named(F.coalesce("value", F.lit("")))).alias("in_value"), (F.min("record_id") == F.max("record_id")).alias("alone"))
    cases = of_values.join(of_pages, "case_id", "left")
    facts = cases.select("case_id", "alone", F.col("late.detected").alias("late"), F.col("own.value").alias("own"), (F.coalesce("on_page", F.lit(False)) | F.col("in_value")).alias("seen"))
    is_type = F.coalesce(F.col("field") == "type", F.lit(False))
    start = values.select(KEEP).join(facts, "case_id", "left").withColumn("old", F.col("value"))
    start = start.withColumn("detail", F.when(is_type, F.when(F.col("late").isNotNull(), "latest page").otherwise("first record")))
    start = start.withColumns({"value": F.when(is_type, F.coalesce("late", "own", F.lit(""))).otherwise(F.col("value")), "alone": F.coalesce("alone", F.lit(False))})
    state = materialize(start.select(*KEEP, "alone", "seen", "old", "detail"))
    log = [_audit(state.where(F.col("detail").isNotNull()).withColumn("new", F.col("value")), "document type")]
    state = state.drop("old", "detail")

    is_open = _is_blank() & F.col("alone")
    filled = _supplements(state.where(is_open), candidates, pages, read, labels)
    filled = materialize(filled.select("record_id", "field", F.col("value").alias("new"), F.concat_ws(" ", F.lit("page"), F.col("group_id").cast("string")).alias("detail"), "old"))
    log.append(_audit(filled, "supplement"))
    taken = state.where(is_open).join(filled.select("record_id", "field", "new"), ["record_id", "field"], "left").withColumn("value", F.coalesce("new", "value")).drop("new")
    state = materialize(state.where(~is_open).unionByName(taken))

    marks = state.withColumn("key", F.when(F.col("field").isin(*keys), F.col("value"))).select("case_id", "record_id", "record_pos", "key")
    spoken = materialize(_restrict(marks, pages, lambda wanted: wanted.select("case_id", "group_id").join(read.select("group_id", "stream"), "group_id")))
    first = state.where((F.col("field") == twins[0]) & (n.compact(F.col("value")) != "")).select("record_id").distinct()
    claims = state.where((F.col("field") != "type") & ~_is_blank()).select("record_id", "field", "field_pos", "kind", "value")
    claims = claims.where(F.col("field") != twins[1]).unionByName(claims.where(F.col("field") == twins[1]).join(first, "record_id", "left_anti"))
    best = compare.best_on_pages(claims, spoken, read, labels).where(~F.col("b.agrees"))
    conflicts = materialize(best.select("record_id", "field", "field_pos", "kind", "value", *compare.evidence_columns()))  # read by every branch of the rules
    conflicts = settle_conflicts(conflicts, state)
    conflicts = materialize(conflicts.select("record_id", "field", "value", "found", "similarity", "confidence", "label_score", "is_unique", "group_id", "reason", "changed"))
    won = conflicts.where("changed").select("record_id", "field", F.col("found").alias("new"), F.lit("conflict").alias("detail"))
    other = won.where(F.col("field").isin(*twins)).withColumn("field", F.when(F.col("field") == twins[0], twins[1]).otherwise(twins[0])).withColumn("detail", F.lit("twin"))
    may_change = F.coalesce(F.col("kind").isin(OVERRIDABLE) | F.col("field").isin(*twins), F.lit(False))
    changed = state.where(may_change).withColumnRenamed("value", "old").join(won.unionByName(other), ["record_id", "field"], "left")
    log.append(_audit(changed, "other source"))
    state = state.where(~may_change).unionByName(changed.withColumn("value", F.coalesce("new", "old")).drop("old", "new", "detail"))

    address = state.where("field = 'address'").groupBy("record_id").agg(F.max("value").alias("address"))
    people = state.where("field = 'nationality'").join(address, "record_id", "left")
    people = people.withColumn("detail", recheck.nationality_source(F.col("value"), F.coalesce("address", F.lit("")), F.col("seen"))).withColumnRenamed("value", "old")
    people = people.withColumn("new", F.when(F.col("detail") != "", F.lit("中国")))
    log.append(_audit(people, "nationality"))
    rest = state.where(F.coalesce(F.col("field") != "nationality", F.lit(True)))
    return rest.select(KEEP).unionByName(people.withColumn("value", F.coalesce("new", "old")).select(KEEP)), reduce(DataFrame.unionByName, log), conflicts
