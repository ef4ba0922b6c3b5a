"""Addresses and fields from the lines of a document: label regions, whole addresses for hidden ones, labelled text by profile.

What concerns one document is an array expression in its row, without a shuffle.
Only the repair against the hierarchy of divisions joins (see ``places``), and
profiles are rows of one frame, filtered and put together again.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import normalizers as n
from docloom.functions.similarity import is_subsequence
from docloom.operators import documents, holders, places, refine
from docloom.runtime import materialize, spread

#: Hidden characters, and the mark above an address that a layout step wrote. Fixed values.
HIDDEN = "[*＊]"
LAID_OUT = "[驾驶证版式归一化/住址]"

#: By kind of region: labels, lines that may follow, Chinese characters needed, and words that end it. Fixed values.
REGIONS = {
    "identity": (["住址"], 6, 5, "公民身份号码 公民身份证号码 身份号码 签发机关 有效期限 中华人民共和国 居民身份证 中国CHINA 中国/CHN".split()),
    "licence": (
        ["住址", "Address"], 3, 4,
        "姓名,Name,性别,Sex,国籍,Nationality,出生日期,Date of Birth,准驾车型,Class,发证机关,记录,证号,所有人,Owner,使用性质,Use Character,品牌型号,Model,"
        "车辆识别代号,Vehicle Identification Number,发动机号码,Engine No,注册日期,Register Date,发证日期,Issue Date".split(","),
    ),
}
HAN = "[一-鿿]"


def _nothing(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _until(lines: Column, ends: Column) -> Column:
    """The lines before the first one that ends them."""
    return n.once(F.array_position(ends, F.lit(True)).cast("int"), lambda at: F.when(at > 0, F.slice(lines, F.lit(1), at - 1)).otherwise(lines))


def region_addresses(text: Column, kind: str) -> Column:
    """Addresses behind the labels of an ``identity`` card or a ``licence``, without white space, in order; null gives none.

    An address is the rest of the label's line and the lines after it, up to a word
    that ends it; lines that only say Address don't count. A card's also ends at a
    line without Chinese characters and is given as often as it is read; a
    licence's is given once. Regions don't reach beyond their image's section.
    """
    labels, after, least, ends = REGIONS[kind]
    card = kind == "identity"
    head = ("(?U)" if card else "(?iU)") + rf"^(?:{'|'.join(labels)})\s*[:：]?\s*"
    english = lambda x: F.lower(n.compact(x) if card else x) == "address"

    def last(x: Column) -> Column:
        said = n.compact(x) if card else F.lower(x)
        word = n.once(said, lambda v: reduce(Column.__or__, [F.contains(v, F.lit(w if card else w.lower())) for w in ends]))
        return ~english(x) & (word | ~x.rlike(HAN) if card else word)

    def address(lines: Column, line: Column, i: Column) -> Column:
        rest = F.regexp_replace(line, head, "")
        first = rest if card else F.when(english(rest), "").otherwise(rest)
        kept = F.filter(n.once(F.slice(lines, i + 2, F.lit(after)), lambda below: _until(below, F.transform(below, last))), lambda x: ~english(x))
        return n.compact(F.concat(first, F.array_join(kept, "")))

    def of_section(section: Column) -> Column:
        found = n.once(refine.lines_of(section), lambda lines: F.transform(lines, lambda x, i: F.when(x.rlike(head), address(lines, x, i))))
        return F.filter(found, lambda a: F.length(F.regexp_replace(a, "[^一-鿿]", "")) >= least)

    cut = r"(?m)(?=^\[(?:图片|局部复识别)\s)" if card else "(?i)" + holders.SECTION
    found = F.flatten(F.transform(F.split(_nothing(text), cut), of_section))
    return found if card else F.array_distinct(found)


def only_whole(values: Column) -> Column:
    """The only distinct value without hidden characters, or ''."""
    whole = F.array_distinct(F.filter(F.transform(values, n.trim), lambda v: (v != "") & ~v.rlike(HIDDEN)))
    return n.once(whole, lambda w: F.when(F.size(w) == 1, w[0]).otherwise(""))


def prefer_whole(current: Column, text: Column) -> Column:
    """An address with hidden characters gives way to the only whole one of the text's regions; null is ''."""
    held = _nothing(current)
    return F.when(held.rlike(HIDDEN), refine._or(only_whole(region_addresses(text, "licence")), held)).otherwise(held)


def laid_out(text: Column) -> Column:
    """Addresses on the lines below the mark LAID_OUT, without white space, each once."""
    lines = F.filter(F.split(_nothing(text), "\n"), lambda x: n.trim(x) != "")
    below = lambda lines: F.transform(lines, lambda x, i: F.when(F.startswith(x, F.lit(LAID_OUT)) & (n.trim(x) == LAID_OUT), n.compact(F.get(lines, i + 1))))
    return F.array_distinct(F.filter(n.once(lines, below), lambda x: x.isNotNull()))


def prefer_laid_out(current: Column, text: Column) -> Column:
    """The only whole laid-out address if the held one is blank, hidden in part or misses characters of it.

    An address that contradicts it stays, without white space; with none laid out, see ``prefer_whole``.
    """
    agrees = lambda held, found: (held == "") | held.rlike(HIDDEN) | is_subsequence(held, found)
    chosen = lambda held, found: F.when(agrees(held, found), found).otherwise(held)
    either = lambda found: F.when(found == "", prefer_whole(current, text)).otherwise(n.once(n.compact(_nothing(current)), lambda held: chosen(held, found)))
    return n.once(only_whole(laid_out(text)), either)


def refine_identity(cards: DataFrame, divisions: DataFrame, short_forms: list[tuple[str, str]] = places.SHORT_FORMS) -> DataFrame:
    """``cards(id, text, address, birth)``: the address that the card's readings agree on, by the hierarchy; birth from its only valid number.

    ``id`` is unique. A card without a valid number, or with several, keeps its
    date; null is ''. Columns beyond these are left out.
    """
    read = spread(cards, "id").select("id", F.col("address").alias("current"), region_addresses(F.col("text"), "identity").alias("candidates"))
    agreed = materialize(documents.consensus_address(read))  # the walk reads it twice
    corrected = places.correct_divisions(agreed, divisions, short_forms).select("id", F.col("corrected").alias("address"))
    number = holders.identity_in(_nothing(F.col("text")))
    born = cards.select("id", n.once(number, lambda v: F.when(v != "", F.substring(v, 7, 8)).otherwise(_nothing(F.col("birth")))).alias("birth"))
    return born.join(corrected.hint("merge"), "id")


def repair_driver(licences: DataFrame, divisions: DataFrame, short_forms: list[tuple[str, str]] = places.SHORT_FORMS) -> DataFrame:
    """Driver fields repaired by their text (``holders.refine_driver``), from the whole or laid-out address, which the hierarchy corrects last.

    ``id`` is unique.
    """
    whole = licences.withColumn("address", prefer_laid_out(F.col("address"), F.col("text")))
    fixed = materialize(holders.refine_driver(whole))
    corrected = places.correct_divisions(fixed.select("id", "address"), divisions, short_forms).select("id", F.col("corrected").alias("address"))
    return fixed.drop("address").join(corrected.hint("merge"), "id")


def value_after(text: Column, labels: list[str], stops: list[str]) -> Column:
    """What stands behind the first of some labels, on its line or the next: up to a stop label after white space, or the line's end; else ''."""
    any_of = lambda words: "(?:" + "|".join(map(re.escape, words)) + ")"
    rest = F.try_element_at(F.split(text, "(?iU)" + any_of(labels), 2), F.lit(2))
    line = F.split(F.regexp_replace(rest, r"(?U)^\s*[:：]?\s*", ""), "\n", 2)[0]
    return _nothing(F.btrim(F.split(line, r"(?iU)\s+" + any_of(stops), 2)[0], F.lit(" ：:，,。")))


#: By profile and field: the label in print, further labels in order of trial, and the normalizer. Fixed values.
PROFILES = {
    "driver": {
        "name": ("姓名", ["姓名", "Name"], "compact"), "sex": ("性别", ["性别", "Sex"], "gender"), "nationality": ("国籍", ["国籍", "Nationality"], "nationality"),
        "address": ("住址", ["住址", "Address"], "compact"), "birth": ("出生日期", ["出生日期", "Date of Birth"], "date_digits"),
        "first_issue": ("初次领证日期", ["初次领证日期", "Date of First Issue"], "date_digits"), "class": ("准驾车型", ["准驾车型", "Class"], "driving_class"),
        "period": ("有效期限", [], "date_range"), "number": ("证号", ["证号", "Certificate No", "Document No"], "compact_upper"),
        "archive": ("档案编号", ["档案编号", "档案号码", "File Number"], "compact"), "document_type": ("证件类型", [], "driver_document_type"),
    },
    "identity": {
        "name": ("姓名", ["姓名", "Name"], "compact_whitespace"), "number": ("身份证号", ["公民身份号码", "公民身份证号码", "身份证号"], "identity_number"),
        "birth": ("出生日期", ["出生", "出生日期"], "date_digits"), "sex": ("性别", ["性别", "Sex"], "gender"), "ethnicity": ("民族", ["民族"], "ethnicity"),
        "address": ("住址", ["住址", "Address"], "compact_whitespace"), "authority": ("签发机关", ["签发机关", "签发机"], "compact_whitespace"),
        "period": ("有效期", ["有效期限", "有效期"], "id_card_valid_period"), "document_type": ("证件类型", [], "text"),
    },
    "vehicle": {
        "owner": ("所有人", [], "compact"), "plate": ("号牌号码", [], "compact_upper"), "vehicle_type": ("车辆类型", [], "compact"), "address": ("住址", [], "space"), "use_nature": ("使用性质", [], "compact"),
        "model": ("品牌型号", [], "compact"), "vin": ("车辆识别代号", [], "compact_upper"), "engine": ("发动机号码", [], "compact_upper"), "registered": ("注册日期", [], "date_yyyymmdd"),
        "issued": ("发证日期", [], "date_yyyymmdd"), "archive": ("档案号码", [], "compact_upper"), "people": ("核定载人数", [], "people"), "dimensions": ("外廓尺寸", [], "dimensions_mm"),
        "total": ("总质量", [], "mass_kg"), "load": ("核定载质量", [], "mass_kg"), "curb": ("整备质量", [], "mass_kg"), "towing": ("准牵引总质量", [], "mass_kg"), "plate_number": ("车牌号码", [], "compact_upper"),
        "scrap": ("强制报废期止", [], "date_yyyymmdd"), "inspection": ("检验有效期", [], "inspection_date"), "inspections": ("检验记录", [], "space"), "document_type": ("证件类型", [], "vehicle_license_type"),
    },
}
#: Words that end a value behind a further label, besides a profile's own. Fixed values.
MORE_STOPS = {
    "driver": ["Address", "Class", "Date of Birth", "Date of First Issue", "Valid Period", "记录"],
    "identity": ["公民身份号码", "签发机关", "有效期限", "Address"],
    "vehicle": [],
}
#: A full date in print, and labels of the period's line. Fixed values.
PRINTED_DATE = r"\d{4}\s*[-/.年]\s*\d{1,2}\s*[-/.月]\s*\d{1,2}日?"
PERIOD_LINES = ["有效期限", "Valid Period"]


def read_labels(texts: DataFrame, profile: str) -> DataFrame:
    """``texts(id, text)`` to one normalized column a field of the profile, with the text; what no label gives is ''.

    A driver's period is the first two dates on lines with its label, if there are two.
    """
    fields, text = PROFILES[profile], _nothing(F.col("text"))
    own = [label for label, _, _ in fields.values()]
    stops = own + MORE_STOPS[profile]

    def value(field: str, label: str, labels: list[str]) -> Column:
        plain = value_after(text, [label], own)
        if profile == "driver" and field == "period":
            lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(PERIOD_LINES[0])) | F.contains(x, F.lit(PERIOD_LINES[1])))
            dates = F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(PRINTED_DATE), F.lit(0))
            return n.once(dates, lambda d: F.when(F.size(d) >= 2, F.concat(F.get(d, F.lit(0)), F.lit("-"), F.get(d, F.lit(1)))).otherwise(plain))
        return refine._or(value_after(text, labels, stops), plain) if labels else plain

    return spread(texts, "id").select("id", F.col("text"), *[n.apply(rule, value(field, label, labels)).alias(field) for field, (label, labels, rule) in fields.items()])


def _melted(wide: DataFrame, profile: str, fields: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    return wide.select("id", F.lit(profile).alias("profile"), pairs.alias("p")).select("id", "profile", "p.field", "p.value")


def fields_from_text(texts: DataFrame, divisions: DataFrame, short_forms: list[tuple[str, str]] = places.SHORT_FORMS) -> DataFrame:
    """``texts(id, profile, text)`` to ``(id, profile, field, value)``: labelled text read by its profile, then repaired by it.

    ``id`` is unique; texts of other profiles give no row. A card that says so is an
    identity card of the second generation.
    """
    of = lambda profile: materialize(read_labels(texts.where(F.col("profile") == profile), profile))  # noqa: E731  (read by repair and rest)
    driver, identity, vehicle = of("driver"), of("identity"), of("vehicle")
    repaired = repair_driver(driver, divisions, short_forms)
    cards = refine_identity(identity, divisions, short_forms)
    kind = F.when(F.contains(n.compact(_nothing(F.col("text"))), F.lit("居民身份证")), "第二代身份证").otherwise(F.col("document_type"))
    rest = identity.withColumn("document_type", kind)
    cars = refine.refine_vehicle(vehicle.withColumn("fuel", F.lit("")).withColumn("text", _nothing(F.col("text"))))
    changed = lambda frame: [c for c in frame.columns if c != "id"]
    kept = lambda profile, frame: [c for c in PROFILES[profile] if c not in frame.columns]
    parts = [
        _melted(repaired, "driver", changed(repaired)), _melted(driver, "driver", kept("driver", repaired)),
        _melted(cards, "identity", changed(cards)), _melted(rest, "identity", kept("identity", cards)),
        _melted(cars, "vehicle", changed(cars)), _melted(vehicle, "vehicle", kept("vehicle", cars)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
