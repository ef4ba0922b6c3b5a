"""Pages of multi-page documents: cleaning their fields and merging them to one record per holder.

Frame: ``pages(group_id, page_pos, number, name, plate_a, plate_b, kind, archive, nationality)``;
'' is missing. A blank key never joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import normalizers as n
from docloom.operators.survivors import stars

#: Printed labels that are sometimes read as values. Fixed values.
LABEL_VALUES = "姓名 性别 国籍 住址 出生日期 初次领证日期 准驾车型 证号 档案编号 档案号码 有效期限 类型".split()
FIELDS = ["number", "name", "plate_a", "plate_b", "kind", "archive", "nationality"]


def _not_a_label(x: Column) -> Column:
    return F.when(n.compact(x).isin(LABEL_VALUES), "").otherwise(x)


def sanitize_records(pages: DataFrame) -> DataFrame:
    """Values that are labels are cleared; keys and archive numbers without their form too, and foreign nationalities."""
    out = pages.withColumns({c: _not_a_label(F.col(c)) for c in FIELDS})
    number, archive = F.upper(n.compact(F.col("number"))), F.upper(n.compact(F.col("archive")))
    good = number.rlike("^[0-9A-Z*]{15,20}$") & (F.length(F.regexp_replace(number, "[^0-9]", "")) >= 6)
    return out.withColumns({
        "number": F.when(good, number).otherwise(""),
        "archive": F.when(archive.rlike("^[0-9*]{12}$"), archive).otherwise(""),
        "nationality": F.when(F.col("nationality") == "中国", "中国").otherwise(""),
    })


def drop_blank_records(pages: DataFrame) -> DataFrame:
    """Pages with at least one value."""
    return pages.where(F.exists(F.array(*FIELDS), lambda v: v != ""))


def sync_aliases(pages: DataFrame) -> DataFrame:
    """A valid plate is copied to both plate fields, the first one's before the second one's."""
    ok = lambda c: n.check(F.lit("plate"), F.col(c))
    plate = F.when(ok("plate_a"), F.col("plate_a")).when(ok("plate_b"), F.col("plate_b"))
    return pages.withColumns({"plate_a": F.coalesce(plate, "plate_a"), "plate_b": F.coalesce(plate, "plate_b")})


def page_kind(is_front: Column, is_back: Column) -> Column:
    return F.when(is_front & is_back, "both").when(is_front, "front").when(is_back, "back").otherwise("")


def merge_pages(pages: DataFrame) -> DataFrame:
    """One record per holder: (group_id, number, name, archive, kind, n_pages).

    Pages meet by number. A page without one joins the number whose name it shares,
    if that is one number; with one number or none in the group all pages are one
    record; other pages are left out. Per field the most frequent value wins, then
    the fewest ``*``, then the earliest. Votes are counted before they are ranked.
    """
    keyed = pages.where("number <> ''").select("group_id", "name", "number").distinct()
    groups = keyed.groupBy("group_id").agg(F.countDistinct("number").alias("n_numbers"), F.min("number").alias("only"))
    owners = keyed.where("name <> ''").groupBy("group_id", "name").agg(F.min("number").alias("owner"), F.countDistinct("number").alias("n_owners"))
    placed = pages.join(groups, "group_id", "left").join(owners, ["group_id", "name"], "left")
    key = F.when(F.coalesce("n_numbers", F.lit(0)) <= 1, F.coalesce("only", F.lit(""))).when(F.col("number") != "", F.col("number")).when(F.col("n_owners") == 1, F.col("owner"))
    placed = placed.withColumn("key", key).where("key IS NOT NULL")
    votes = placed.select("group_id", "key", "page_pos", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in ("name", "archive")])).alias("x")).where("x.v <> ''")
    counted = votes.groupBy("group_id", "key", "x.f", "x.v").agg(F.count("*").alias("k"), F.min("page_pos").alias("first"))
    best = lambda f: F.coalesce(F.max_by(F.when(F.col("f") == f, F.col("v")), F.when(F.col("f") == f, F.struct(F.col("k"), -stars(F.col("v")), -F.col("first")))), F.lit(""))
    values = counted.groupBy("group_id", "key").agg(best("name").alias("name"), best("archive").alias("archive"))
    front = F.contains("kind", F.lit("正本")) | (F.contains("kind", F.lit("行驶证")) & ~F.contains("kind", F.lit("副页")))
    back = F.contains("kind", F.lit("副页")) | (F.col("archive") != "")
    sides = placed.groupBy("group_id", "key").agg(page_kind(F.bool_or(front), F.bool_or(back)).alias("kind"), F.count("*").alias("n_pages"))
    joined = sides.join(values, ["group_id", "key"], "left").fillna("", ["name", "archive"])
    return joined.select("group_id", F.col("key").alias("number"), "name", "archive", "kind", "n_pages")


def rename_aliases(fields: DataFrame, aliases: DataFrame) -> DataFrame:
    """``fields(id, key, value)`` with keys renamed by ``aliases(key, field)``, a small table that Spark broadcasts by its size."""
    return fields.join(aliases, "key", "left").select("id", F.coalesce("field", "key").alias("field"), "value")


def classify_driver_page(texts: DataFrame) -> DataFrame:
    """Electronic, physical, or '' where both or neither have two markers: ``texts(id, text)``."""
    count = lambda words: sum((F.contains("text", F.lit(w)).cast("int") for w in words), F.lit(0))
    electronic, physical = count(["电子", "截图", "生成时间", "当前时间"]) >= 2, count(["签注", "副页", "发证机关"]) >= 2
    return texts.select("id", F.when(electronic & ~physical, "electronic").when(physical & ~electronic, "physical").otherwise("").alias("page_kind"))
