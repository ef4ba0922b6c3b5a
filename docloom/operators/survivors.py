"""Survivorship: votes, merges, masked keys, linked people.

All rankings end in a unique position, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import similarity

SIMILAR_ADDRESS = 0.72


def stars(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit("*"), F.lit("")))


def vote_values(votes: DataFrame, prefer_long: tuple[str, ...] = ("size",)) -> DataFrame:
    """Per (group_id, field): most occurrences, then fewest ``*``, then longest (some fields), then earliest.

    Two levels of grouping, so partial counts are made before the shuffle.
    """
    counted = votes.where("value <> ''").groupBy("group_id", "field", "value").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    length = F.when(F.col("field").isin(*prefer_long), F.length("value")).otherwise(0)
    best = F.max_by("value", F.struct(F.col("n"), -stars(F.col("value")), length, -F.col("first")))
    return counted.groupBy("group_id", "field").agg(best.alias("value"))


def vote_pairs(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Per group the most frequent (total, curb) pair of ``pairs``; on a tie the pair that the record holds, if it leads, else none.

    ``held(group_id, total, curb)``: one row for each record.
    """
    counted = pairs.groupBy("group_id", "total", "curb").agg(F.count("*").alias("n"))
    most = counted.groupBy("group_id").agg(F.max("n").alias("n"))
    mine = held.select("group_id", "total", "curb", F.lit(True).alias("mine"))
    leaders = counted.join(most, ["group_id", "n"]).join(mine, ["group_id", "total", "curb"], "left")
    pair = F.struct("total", "curb")
    chosen = leaders.groupBy("group_id").agg(F.count("*").alias("n_leaders"), F.min(pair).alias("only"), F.min(F.when(F.col("mine"), pair)).alias("kept"))
    best = F.when(F.col("n_leaders") == 1, F.col("only")).otherwise(F.col("kept"))
    return chosen.select("group_id", *[F.coalesce(best[c], F.lit("")).alias(c) for c in ("total", "curb")], "n_leaders")


def merge_longest(values: DataFrame) -> DataFrame:
    """Per group the longest value, the earliest on ties, and how many were merged."""
    best = F.max_by("value", F.struct(F.length("value"), -F.col("position")))
    return values.groupBy("group_id").agg(best.alias("value"), F.count("*").alias("n_merged"))


def unique_or_blank(values: DataFrame) -> DataFrame:
    """The only distinct unmasked value of a group, else ''. Values of full images go before others.

    Distinct values are bounded by minimum and maximum, which are equal only if
    there is one; so no set of a group's values is ever gathered.
    """
    clean = F.when((F.col("value") != "") & ~F.contains(F.col("value"), F.lit("*")), F.col("value"))
    full, part = F.when(F.col("is_full_image"), clean), F.when(~F.col("is_full_image"), clean)
    edges = values.groupBy("group_id").agg(*[f(c).alias(n) for c, a in ((clean, "any"), (full, "full"), (part, "part")) for f, n in ((F.min, f"{a}_lo"), (F.max, f"{a}_hi"))])
    one = lambda a: F.when(F.col(f"{a}_lo") == F.col(f"{a}_hi"), F.col(f"{a}_lo")).otherwise("")
    prefer = F.when(F.col("full_lo").isNotNull(), one("full")).otherwise(one("part"))
    return edges.select("group_id", one("any").alias("only_value"), prefer.alias("preferred_value"), (F.col("full_lo") != F.col("full_hi")).alias("conflict")).fillna({"conflict": False, "only_value": "", "preferred_value": ""})


def masked_equal(a: Column, b: Column) -> Column:
    """Equal length, and equal at every position where neither side is masked."""
    same = F.forall(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) | (x == "*") | (y == "*")), lambda z: z)
    return (F.length(a) == F.length(b)) & same


def match_masked_keys(records: DataFrame) -> DataFrame:
    """Distinct keys of a group where one masked key agrees with another and they share a name.

    The join is on group and name, so only keys of one name are compared; it is
    made on distinct keys, whose number per name is small against rows.
    """
    keys = records.where("number <> ''").select("group_id", "name", "number").distinct()
    a, b = keys.withColumnRenamed("number", "masked"), keys.withColumnRenamed("number", "key")
    pairs = a.where(F.contains("masked", F.lit("*"))).join(b, ["group_id", "name"]).where("masked <> key")
    return pairs.where(masked_equal(F.col("masked"), F.col("key"))).select("group_id", "masked", "key").distinct()


def cluster_keys(records: DataFrame) -> DataFrame:
    """Greedy clusters in order of first occurrence: a key joins the first cluster that has a key it matches.

    A fold over each (group, name), whose distinct keys are few; canonical is the
    key with fewest ``*``, then the earliest.
    """
    keys = records.where("number <> ''").groupBy("group_id", "name", "number").agg(F.min("position").alias("first"))
    ordered = keys.groupBy("group_id", "name").agg(F.array_sort(F.collect_list(F.struct("first", "number"))).alias("keys"))

    def step(clusters: Column, key: Column) -> Column:
        hits = lambda c: F.exists(c, lambda m: (m == key["number"]) | ((F.contains(m, F.lit("*")) | F.contains(key["number"], F.lit("*"))) & masked_equal(m, key["number"])))
        at = F.array_position(F.transform(clusters, hits), True)
        return F.when(at > 0, F.transform(clusters, lambda c, i: F.when(i == at - 1, F.concat(c, F.array(key["number"]))).otherwise(c))).otherwise(F.concat(clusters, F.array(F.array(key["number"]))))

    folded = ordered.select("group_id", "name", F.aggregate("keys", F.expr("CAST(array() AS array<array<string>>)"), step).alias("clusters"))
    each = folded.select("group_id", "name", F.explode("clusters").alias("c"))
    best = F.array_sort(F.transform("c", lambda k, i: F.struct(stars(k).alias("s"), i.alias("i"), k.alias("k"))))[0]["k"]
    return each.select("group_id", "name", best.alias("canonical"), F.size("c").cast("long").alias("n_keys"))


def clean_key(number: Column) -> Column:
    return F.upper(F.regexp_replace(number, r"(?U)\s+", ""))


def link_people(documents: DataFrame) -> DataFrame:
    """Identity cards and licences of an application linked by number.

    Returns every document with instance_id (its rank in the application), and a
    person number: cards first, by first occurrence, then licences without a card.
    Blank numbers are never linked.
    """
    numbered = documents.withColumns({
        "key": F.when(clean_key(F.col("number")) == "", F.concat(F.lit("#"), F.col("position").cast("string"))).otherwise(clean_key(F.col("number"))),
        "instance": F.row_number().over(Window.partitionBy("application_no").orderBy("position")),
    })
    people = numbered.groupBy("application_no", "key").agg(F.min(F.when(F.col("document_type") == "id_card", F.col("position"))).alias("card"), F.min("position").alias("first"))
    order = Window.partitionBy("application_no").orderBy(F.col("card").isNull(), F.coalesce("card", "first"))
    people = people.select("application_no", "key", F.row_number().over(order).alias("person"))
    joined = numbered.join(people, ["application_no", "key"])
    return joined.select("application_no", "position", F.concat_ws("-", "document_type", F.col("instance").cast("string")).alias("instance_id"), F.concat(F.lit("person-"), F.col("person").cast("string")).alias("person_id"))


def cross_check(documents: DataFrame) -> DataFrame:
    """Earliest card and earliest licence of each linked number: a row for the number, and one for the addresses if both have one.

    Addresses are compared without white space and separators: equal ones are
    consistent, those of a similarity of SIMILAR_ADDRESS similar, others different.
    """
    keyed = documents.withColumn("key", clean_key(F.col("number"))).where("key <> ''")
    first = keyed.groupBy("application_no", "key", "document_type").agg(F.min_by("address", "position").alias("address"))
    plain = F.regexp_replace("address", r"(?U)[\s,，。;；、]", "")
    card, licence = (first.where(F.col("document_type") == t).select("application_no", F.col("key").alias("number"), plain.alias(n)) for t, n in (("id_card", "card_address"), ("driver_license", "licence_address")))
    both = card.join(licence, ["application_no", "number"])
    rated = similarity.distinct_ratios(both.where("card_address <> '' AND licence_address <> ''"), "card_address", "licence_address", SIMILAR_ADDRESS)
    status = F.when(F.col("card_address") == F.col("licence_address"), "consistent").when(F.col("ratio") >= SIMILAR_ADDRESS, "similar").otherwise("different")
    numbers = both.select("application_no", "number", F.lit("number").alias("checked"), F.lit("consistent").alias("status"))
    rows = numbers.unionByName(rated.select("application_no", "number", F.lit("address").alias("checked"), status.alias("status")))
    return rows.withColumn("severity", F.when(F.col("status") == "different", "warning").otherwise("info"))
