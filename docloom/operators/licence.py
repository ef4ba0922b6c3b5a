"""Fields of a licence from the tokens of its image: labels, values, regions, glare over a field.

Frame: ``tokens(group_id, token_index, text, score, left, top, right, bottom)``, one image per
group. A label meets only values of its own kind on its own image, so the joins have
(image, field) as their equal key. Null and blank texts are no labels and no values; an
image without labels or values has no row; scores and boxes may be null, and a value
without a box is on no line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.normalizers import once
from docloom.runtime import materialize, spread

# Printed labels of the fields that are assigned, in order.
LABELS = {
    "driver": [
        ("certificate_number", "证号"), ("name", "姓名"), ("name", "NAME"), ("sex", "性别"), ("sex", "SEX"), ("nationality", "国籍"), ("nationality", "NATIONALITY"),
        ("address", "住址"), ("address", "ADDRESS"), ("birth_date", "出生日期"), ("birth_date", "DATEOFBIRTH"), ("first_issue_date", "初次领证日期"),
        ("first_issue_date", "DATEOFFIRSTISSUE"), ("vehicle_class", "准驾车型"), ("vehicle_class", "CLASS"), ("valid_period", "有效期限"), ("valid_period", "VALIDPERIOD"), ("archive_number", "档案编号"),
    ],
    "vehicle": [
        ("plate_number", "号牌号码"), ("plate_number", "PLATENUMBER"), ("plate_number", "PLATENO"), ("plate_number", "PLANO"), ("owner", "所有人"), ("owner", "OWNER"), ("address", "住址"), ("address", "ADDRESS"),
        ("vin", "车辆识别代号"), ("vin", "车辆识别代码"), ("vin", "VEHICLEIDENTIFICATIONNUMBER"), ("vin", "VIN"), ("engine_number", "发动机号码"), ("engine_number", "发动机号"), ("engine_number", "ENGINENO"),
    ],
}
# Words that make a token evidence of a field.
MARKERS = {
    "driver": ["证号", "姓名", "性别", "国籍", "住址", "出生日期", "初次领证日期", "准驾车型", "有效期限", "档案编号", "记录", "有效起始日期", "NAME", "SEX", "NATIONALITY", "ADDRESS", "DATEOFBIRTH", "DATEOFFIRSTISSUE", "CLASS", "VALIDPERIOD"],
    "vehicle": ["号牌号码", "车辆类型", "所有人", "住址", "使用性质", "品牌型号", "车辆识别代号", "发动机号码", "注册日期", "发证日期", "档案编号", "档案号码", "总质量", "核定载人数", "核定载质量", "强制报废期止", "检验有效期", "准牵引总质量", "整备质量", "外廓尺寸", "检验记录",
                "PLATENO", "VEHICLETYPE", "OWNER", "ADDRESS", "USECHARACTER", "MODEL", "VEHICLEIDENTIFICATIONNUMBER", "VIN", "ENGINENO", "REGISTERDATE", "ISSUEDATE"],
}
# Everything printed on a vehicle licence.
PRINTED = [
    "号牌号码", "车辆类型", "所有人", "住址", "使用性质", "品牌型号", "车辆识别代号", "车辆识别代码", "发动机号码", "发动机号", "注册日期", "发证日期", "档案编号", "档案号码", "核定载人数", "总质量", "核定载质量", "整备质量", "准牵引总质量", "外廓尺寸", "检验记录", "强制报废期止", "检验有效期", "备注",
    "PLATENUMBER", "PLATENO", "PLANO", "VEHICLETYPE", "OWNER", "ADDRESS", "USECHARACTER", "MODEL", "VEHICLEIDENTIFICATIONNUMBER", "VIN", "ENGINENO", "REGISTERDATE", "ISSUEDATE", "FILENO", "APPROVEDPASSENGERS", "CAPACITY", "TOTALMASS", "CURBWEIGHT", "RATEDLOAD", "OVERALLDIMENSION", "TRACTIONMASS", "REMARKS", "INSPECTIONRECORD", "VALIDUNTIL",
]
# Text that is no name, no address, and first characters of plates.
NOT_NAMES = ["姓名", "记录", "证号", "档案", "公安", "警察"]
NOT_ADDRESSES = ["中华人民共和国", "机动车驾驶证", "驾驶证副页", "公安局", "警察支队", "出生日期", "初次领证", "有效期限", "有效起始", "年月日", "记录"]
PROVINCES = "京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领学警港澳"
# Typed values by form, and thresholds of glare over a field.
CLASS_FORM = "[ABC][0-9][A-Z]?|[DEFMNP]"
NUMBER_FORM = "[0-9]{14,17}[0-9X]"
USEFUL_FORMS = {
    "driver": ["[0-9]{10,18}", ".*[0-9]{8}.*", CLASS_FORM, "男|女|中国|中国CHN"],
    "vehicle": ["[A-HJ-NPR-Z0-9]{12,18}", "[一-鿿][A-Z][A-Z0-9]{4,7}", ".*[0-9]{8}.*", ".*[0-9](KG|人)", ".*[0-9]{3,5}X[0-9]{3,5}X[0-9]{3,5}.*"],
}
LIMITS = {
    "driver": {"highlight": 0.08, "contiguous": 0.03, "evidence": 0.001, "evidence_contiguous": 0.0},
    "vehicle": {"highlight": 0.08, "contiguous": 0.08, "evidence": 0.01, "evidence_contiguous": 0.003},
}
TEXTURE, TEXTURE_CONTIGUOUS, BRIGHTER, READABLE = 0.18, 0.08, 15.0, 0.98
ACTIONABLE = {"driver": ["certificate_number", "address", "valid_period"], "vehicle": ["plate_number", "owner", "address", "vin", "engine_number"]}
NARROW, WIDE, REACH = 0.5, 1.5, 8.0

BOX = ["left", "top", "right", "bottom"]


def licence_key(text: Column) -> Column:
    """Digits, Latin capitals and Han characters of a text; null gives an empty key."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^0-9A-Z一-鿿]", "")


def _whole(x: Column, form: str) -> Column:
    return F.rlike(x, F.lit(f"^(?:{form})$"))


def _any(x: Column, words: list[str]) -> Column:
    return F.rlike(x, F.lit("|".join(words)))


def _han(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^一-鿿]", ""))


def _digits(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^0-9]", ""))


def useful_tokens(tokens: DataFrame, profile: str) -> DataFrame:
    """Tokens that can be evidence of a field: a marker, a typed value, or Han text read with 0.8 or more."""
    return _useful(tokens.withColumn("key", licence_key(F.col("text"))), profile).drop("key")


def _useful(keyed: DataFrame, profile: str) -> DataFrame:
    key = F.col("key")
    known = "|".join([*MARKERS[profile], *(f"^(?:{form})$" for form in USEFUL_FORMS[profile])])
    return keyed.where(F.rlike(key, F.lit(known)) | (F.coalesce(F.col("score") >= 0.8, F.lit(False)) & F.rlike(key, F.lit("[一-鿿]"))))


def label_of(key: Column, profile: str) -> Column:
    """struct(field, alias) of the longest label within ``key``, the first listed on ties; null without one."""
    longest = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(a).alias("alias")) for f, a in sorted(LABELS[profile], key=lambda x: -len(x[1]))])
    return F.try_element_at(F.filter(longest, lambda x: F.contains(key, x["alias"])), F.lit(1))


def _fits_driver(key: Column, raw: Column) -> dict[str, Column]:
    """Whether a text can be the value of a field, by its form."""
    raw = F.coalesce(raw, F.lit(""))
    date = _whole(key, "[0-9]{8}") | F.rlike(F.trim(raw), F.lit("^[0-9]{4}[^0-9]+[0-9]{1,2}[^0-9]+[0-9]{1,2}$"))
    return {
        "certificate_number": _whole(key, NUMBER_FORM),
        "name": _han(key).between(2, 6) & ~_any(key, NOT_NAMES),
        "sex": key.isin("男", "女"),
        "nationality": key.isin("中", "中国", "CHN", "中CHN", "中国CHN"),
        "address": (_han(key) >= 3) & ~_any(key, NOT_ADDRESSES),
        "birth_date": date,
        "first_issue_date": date,
        "vehicle_class": _whole(key, CLASS_FORM),
        "valid_period": (key == "长期") | (_digits(raw) >= 6),
        "archive_number": _whole(key, "[0-9]{8,16}"),
    }


def plate_priority(key: Column) -> Column:
    """0 for a well-formed plate, 1 for a damaged one, null for others."""
    return F.when(_whole(key, f"[{PROVINCES}][A-Z][A-HJ-NP-Z0-9]{{5,6}}"), 0).when(_whole(key, f"[{PROVINCES}][A-Z0-9]{{2,7}}"), 1)


def _only_printed(key: Column) -> Column:
    """Whether nothing is left of a key once all printed labels, longest first, are taken out."""
    longest = F.array(*[F.lit(x) for x in sorted(PRINTED, key=lambda x: -len(x))])
    return F.aggregate(longest, key, lambda rest, label: F.replace(rest, label, F.lit(""))) == ""


def _free_vehicle(key: Column) -> Column:
    """Whether a text is no label or part of one: it may be a value then, as glare spoils forms."""
    aliases = [a for _, a in LABELS["vehicle"]]
    han, latin = [a for a in aliases if not a.isascii()], [a for a in aliases if a.isascii()]
    part = reduce(lambda a, b: a | b, [(key != a) & F.contains(F.lit(a), key) for a in han])
    clipped = _whole(key, "[A-Z]{2,}") & reduce(lambda a, b: a | b, [F.startswith(F.lit(a), key) for a in latin])
    return (key != "") & ~part & ~clipped & ~_only_printed(key)


def _remainder(key: Column, label: Column, profile: str) -> Column:
    """What follows a label in its own token; a vehicle's other names of the same field are taken out."""
    rest = F.substr(key, F.instr(key, label["alias"]) + F.length(label["alias"]))
    if profile == "driver":
        return rest
    names = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(a).alias("alias")) for f, a in sorted(LABELS[profile], key=lambda x: -len(x[1]))])
    return F.aggregate(F.filter(names, lambda x: x["field"] == label["field"]), rest, lambda left, x: F.replace(left, x["alias"], F.lit("")))


def _kinds(key: Column, raw: Column, profile: str) -> Column:
    """The fields that a text can be a value of; a vehicle's plate needs its form."""
    if profile == "driver":
        return F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in _fits_driver(key, raw).items()]))
    plate, long = F.when(plate_priority(key).isNotNull(), F.lit("plate_number")), F.when(F.length(key) >= 2, F.lit("address"))
    fields = F.array_compact(F.array(plate, F.lit("owner"), long, F.lit("vin"), F.lit("engine_number")))
    return F.when(_free_vehicle(key), fields).otherwise(F.array().cast("array<string>"))


def _judged(tokens: DataFrame, profile: str) -> DataFrame:
    """Useful tokens with their label, what follows it, the fields they fit, and the field their form alone tells.

    Written once, since five ways of assignment read it; tokens are spread by image first.
    """
    keyed = _useful(spread(tokens, "group_id").withColumn("key", licence_key(F.col("text"))), profile).withColumn("label", label_of(F.col("key"), profile))
    keyed = keyed.withColumn("rest", F.when(F.col("label").isNotNull(), _remainder(F.col("key"), F.col("label"), profile)))
    key, free = F.col("key"), F.col("label").isNull()
    if profile == "driver":
        follows = F.array_contains(_kinds(F.col("rest"), F.col("rest"), profile), F.col("label.field"))
        number = _whole(key, "[0-9]{10,17}[0-9X]")
        told = F.when(number, F.when(F.length(key) >= 15, "certificate_number").otherwise("archive_number")).when(_whole(key, CLASS_FORM), "vehicle_class")
    else:
        follows = ~_only_printed(F.col("rest"))
        told = F.when(plate_priority(key) == 0, "plate_number")
    inline = F.when((F.col("rest") != "") & follows, F.col("rest"))
    return materialize(keyed.select(
        "group_id", "token_index", "key", "score", *BOX, F.col("label.field").alias("field"), F.col("label.alias").alias("alias"), inline.alias("inline"),
        F.when(free, _kinds(key, F.col("text"), profile)).alias("kinds"), F.when(free, told).alias("told"),
    ))


def assign_fields(tokens: DataFrame, profile: str) -> DataFrame:
    """Labels and values of an image: (group_id, field, basis, token_index, value, score, left, top, right, bottom).

    ``basis``: ``label``; ``inline`` for what follows a label in its token and fits; ``near`` for
    the fitting token without a label nearest to a label on its line (3 x the gap across the
    line + the gap along it, the earlier token on ties; well-formed plates before damaged
    ones; a taller than wide label reads downwards); ``inferred`` for a value whose form alone
    tells its field; ``fallback`` for the longest address-like token where an address has
    no other value. Inferred certificate numbers go where a label has one. A
    token is a value of a field once, by the first of these bases.
    """
    judged = _judged(tokens, profile)
    labels = judged.where("alias IS NOT NULL")
    out = ["group_id", "field", "rank", "token_index", "value", "score", *BOX]
    inline = labels.where("inline IS NOT NULL").select("group_id", "field", F.lit(1).alias("rank"), "token_index", F.col("inline").alias("value"), "score", *BOX)
    typed = judged.drop("field").withColumn("field", F.explode("kinds")).withColumnRenamed("key", "value")
    h, w = F.col("bottom") - F.col("top"), F.col("right") - F.col("left")
    lh, lw = F.col("l_bottom") - F.col("l_top"), F.col("l_right") - F.col("l_left")
    gap = lambda a, b: F.greatest(F.lit(0.0), F.greatest(F.col(f"l_{a}"), F.col(a)) - F.least(F.col(f"l_{b}"), F.col(b)))
    flat = lw >= lh
    across, along = F.when(flat, gap("top", "bottom")).otherwise(gap("left", "right")), F.when(flat, gap("left", "right")).otherwise(gap("top", "bottom"))
    thin = F.greatest(F.lit(1.0), F.when(flat, F.least(lh, h)).otherwise(F.least(lw, w)))
    order = F.when(F.col("field") == "plate_number", plate_priority(F.col("value"))).otherwise(0)
    at = labels.select("group_id", "field", F.col("token_index").alias("l_index"), *[F.col(c).alias(f"l_{c}") for c in BOX])
    boxed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & F.col(f"l_{c}").isNotNull() for c in BOX])
    pairs = at.join(typed.hint("merge"), ["group_id", "field"]).where(boxed & (across <= 1.5 * thin))
    best = pairs.groupBy("group_id", "field", "l_index").agg(F.min_by(F.struct("token_index", "value", "score", *BOX), F.struct(order, 3 * across + along, "token_index")).alias("b"))
    near = best.select("group_id", "field", F.lit(2).alias("rank"), "b.*").select(out)

    inferred = judged.where("told IS NOT NULL").select("group_id", F.col("told").alias("field"), F.lit(3).alias("rank"), "token_index", F.col("key").alias("value"), "score", *BOX)
    found = inline.unionByName(near).unionByName(inferred)
    if profile == "driver":
        longest = typed.where("field = 'address'").groupBy("group_id", "field").agg(F.min_by(F.struct("token_index", "value", "score", *BOX), F.struct(-F.length("value"), "token_index")).alias("b"))
        found = found.unionByName(longest.select("group_id", "field", F.lit(4).alias("rank"), "b.*").select(out))
    once = found.groupBy("group_id", "field", "token_index").agg(F.min_by(F.struct("rank", "value", "score", *BOX), "rank").alias("b")).select("group_id", "field", "token_index", "b.*")
    first = F.min("rank").over(Window.partitionBy("group_id", "field"))
    spare = ((F.col("field") == "certificate_number") & (F.col("rank") == 3)) | (F.col("rank") == 4)
    kept = once.withColumn("first", first).where(~spare | (F.col("rank") == F.col("first"))).select(out)
    rows = kept.unionByName(labels.select("group_id", "field", F.lit(0).alias("rank"), "token_index", F.col("alias").alias("value"), "score", *BOX))
    basis = F.element_at(F.array(*[F.lit(b) for b in ("label", "inline", "near", "inferred", "fallback")]), F.col("rank") + 1)
    return rows.select("group_id", "field", basis.alias("basis"), "token_index", "value", "score", *BOX)


def _open_period(value: Column) -> Column:
    """Whether a period of validity lacks a date."""
    return (value != "长期") & (F.regexp_count(value, F.lit("[0-9]{4}[^0-9]?[0-9]{1,2}[^0-9]?[0-9]{1,2}")) < 2)


def field_regions(assigned: DataFrame, profile: str) -> DataFrame:
    """Where each field is to be looked at: (group_id, field, token_index, side, left, top, right, bottom, padding, readable).

    Boxes of values, or of labels where a field has no value (``side`` is ``here``). For
    drivers, an address of at most four characters and a period that lacks a date also
    have the region next to them, eight text heights long: ``after`` the text, or ``before`` it
    where only the end of a period is whole. ``padding`` is in text heights, wide where a
    value is missing or cut; ``readable``: a whole value read with 0.98 or more.
    """
    value, field = F.col("value"), F.col("field")
    is_label = F.col("basis") == "label"
    valued = F.max(F.when(is_label, 0).otherwise(1)).over(Window.partitionBy("group_id", "field"))
    boxes = assigned.withColumn("valued", valued).where(~is_label | (F.col("valued") == 0))
    if profile != "driver":
        return boxes.select("group_id", "field", "token_index", F.lit("here").alias("side"), *BOX, F.lit(WIDE).alias("padding"), F.lit(False).alias("readable"))
    short = ~is_label & (((field == "address") & (F.length(value) <= 4)) | ((field == "valid_period") & _open_period(value)))
    parts = F.split(value, "[至到]", 2)
    ends = (field == "valid_period") & (F.size(parts) == 2) & (_digits(parts[0]) < 8) & (_digits(F.try_element_at(parts, F.lit(2))) >= 8)
    whole = ((field == "address") & (F.length(value) >= 8)) | ((field == "valid_period") & (_digits(value) >= 16)) | ((field == "certificate_number") & _whole(value, NUMBER_FORM))
    readable = ~is_label & F.coalesce(F.col("score") >= READABLE, F.lit(False)) & whole
    marked = boxes.withColumns({"short": short, "readable": readable, "sides": F.when(short, F.array(F.lit("here"), F.when(ends, "before").otherwise("after"))).otherwise(F.array(F.lit("here"))), "cut": is_label | short})
    placed = marked.withColumn("side", F.explode("sides"))
    h, w = F.greatest(F.lit(1.0), F.col("bottom") - F.col("top")), F.greatest(F.lit(1.0), F.col("right") - F.col("left"))
    flat = w >= h
    after, before = F.col("side") == "after", F.col("side") == "before"
    edges = {
        "left": F.when(flat & after, F.col("right")).when(flat & before, F.col("left") - REACH * h).otherwise(F.col("left")),
        "right": F.when(flat & after, F.col("right") + REACH * h).when(flat & before, F.col("left")).otherwise(F.col("right")),
        "top": F.when(~flat & after, F.col("bottom")).when(~flat & before, F.col("top") - REACH * w).otherwise(F.col("top")),
        "bottom": F.when(~flat & after, F.col("bottom") + REACH * w).when(~flat & before, F.col("top")).otherwise(F.col("bottom")),
    }
    padding = F.when((F.col("side") == "here") & F.col("cut"), WIDE).otherwise(NARROW)
    return placed.select("group_id", "field", "token_index", "side", *[c.alias(n) for n, c in edges.items()], padding.alias("padding"), "readable")


def covered_fields(regions: DataFrame, measures: DataFrame, profile: str) -> DataFrame:
    """Fields under glare: (group_id, field, n_boxes, highlight, washout, readable, covered).

    ``measures(group_id, field, token_index, side, overlap, contiguous, texture, texture_contiguous, linked,
    brighter, solid)`` has a row per measured region; regions without one have no effect, and
    nulls pass no test. All conditions of a test must hold on one box. A washout of a driver's
    field counts unless a value of it is readable; scores have no say for vehicles. Only the
    fields that matter can be ``covered``.
    """
    m = LIMITS[profile]
    faded = (F.col("texture") >= TEXTURE) & (F.col("texture_contiguous") >= TEXTURE_CONTIGUOUS)
    highlight = (F.col("overlap") >= m["highlight"]) & (F.col("contiguous") >= m["contiguous"]) & F.col("solid")
    washout = (F.col("overlap") >= m["evidence"]) & (F.col("contiguous") >= m["evidence_contiguous"]) & faded & F.col("linked")
    if profile == "driver":
        washout = washout | ((F.col("overlap") >= 0.03) & (F.col("contiguous") >= 0.015) & faded & (F.col("brighter") >= BRIGHTER))
    seen = regions.select("group_id", "field", "token_index", "side", "readable").join(measures, ["group_id", "field", "token_index", "side"], "left")
    any_box = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    out = seen.groupBy("group_id", "field").agg(F.count("overlap").alias("n_boxes"), any_box(highlight).alias("highlight"), any_box(washout).alias("washout"), any_box(F.col("readable")).alias("readable"))
    return out.withColumn("covered", F.col("field").isin(*ACTIONABLE[profile]) & (F.col("highlight") | (F.col("washout") & ~F.col("readable"))))
