"""Pages of identity documents of several holders, each attached to its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_id_pages(pages: DataFrame) -> DataFrame:
    """(group_id, page_pos, holder, basis): whose each page is; pages that can't be told apart are left out.

    ``pages(group_id, page_pos, side, side_index, number, name, address)``; a page with
    one of the last three is a front. Nulls and blanks count as none. By groups:

    - one number: all pages are its holder's ('only number');
    - several: fronts with a number are that holder's ('number'); of the others,
      those whose name stands with just one of the numbers ('name'); then backs,
      by the side index of the fronts so attached ('side'), which may be several
      holders';
    - no number, one name at most: all pages are one holder's ('only name');
    - no number, several names: fronts with a name are that name's ('name group').

    Each tier takes what those before left. Names and sides are reduced to distinct
    rows before they meet, so a large group is dealt by name and side.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    rows = pages.select("group_id", "page_pos", blank("side").alias("side"), blank("side_index").alias("side_index"), blank("number").alias("number"), blank("name").alias("name"), blank("address").alias("address"))
    front = (F.col("number") != "") | (F.col("name") != "") | (F.col("address") != "")
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    kinds = rows.groupBy("group_id").agg(F.min(given("number")).alias("first"), F.max(given("number")).alias("last"), F.min(given("name")).alias("one"), F.max(given("name")).alias("other"))
    state = F.when(F.col("first") < F.col("last"), "several").when(F.col("first").isNotNull(), "only number").when(F.col("one") < F.col("other"), "name group").otherwise("only name")
    kinds = kinds.select("group_id", state.alias("state"), F.coalesce("first", "one", F.lit("")).alias("holder"))
    rows = rows.join(kinds, "group_id")
    out = ["group_id", "page_pos", "holder", "basis"]

    whole = rows.where(F.col("state").isin("only number", "only name")).withColumn("basis", F.col("state"))
    by_name = rows.where((F.col("state") == "name group") & (F.col("name") != "")).withColumns({"holder": F.col("name"), "basis": F.lit("name group")})
    fronts = rows.where((F.col("state") == "several") & front)
    numbered = fronts.where("number <> ''").withColumns({"holder": F.col("number"), "basis": F.lit("number")})
    names = numbered.where("name <> ''").groupBy("group_id", "name").agg(F.min("number").alias("only"), F.max("number").alias("last")).where("only = last").select("group_id", "name", "only")
    named = fronts.where("number = ''").join(names, ["group_id", "name"]).withColumns({"holder": F.col("only"), "basis": F.lit("name")})
    attached = numbered.select(*out, "side_index").unionByName(named.select(*out, "side_index"))
    sides = attached.select("group_id", "side_index", "holder").distinct()
    backs = rows.where((F.col("state") == "several") & (F.col("side") == "back")).drop("holder").join(sides, ["group_id", "side_index"]).withColumn("basis", F.lit("side"))
    backs = backs.select(out).join(attached.select("group_id", "page_pos", "holder"), ["group_id", "page_pos", "holder"], "left_anti")
    return whole.select(out).unionByName(by_name.select(out)).unionByName(attached.select(out)).unionByName(backs.select(out))
