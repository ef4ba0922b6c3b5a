"""Place names: correction against a hierarchy, repair of door numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.runtime import materialize


def _halves(x: Column, n: Column) -> Column:
    """Both halves of a text of n characters, numbered: one of them is equal if one character differs."""
    half = F.floor(n / 2).cast("int")
    return F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring(x, F.lit(1), half).alias("half")), F.struct(F.lit(1).alias("side"), F.substring(x, half + 1, n - half).alias("half"))))


#: Characters that stand for a hidden one, names that are no place, and short forms of provinces. Fixed values.
MASKS = "*＊×Xx"
NO_PLACE = ["市辖区", "县", "省直辖县级行政区划"]
SHORT_FORMS = [("内蒙古自治区", "内蒙古"), ("广西壮族自治区", "广西"), ("西藏自治区", "西藏"), ("宁夏回族自治区", "宁夏"), ("新疆维吾尔自治区", "新疆"), ("香港特别行政区", "香港"), ("澳门特别行政区", "澳门")]


def _level(addresses: DataFrame, names: DataFrame, keys: list[str], name: str, lengths: list[int]) -> DataFrame:
    """Match one level of the hierarchy at each row's current position: ``name`` as it is written there.

    ``names(*keys, name)`` are the names that may stand there. An exact longest
    prefix wins; else the only name of equal length at Hamming distance 1, unless
    a hidden character is in its place; else nothing is taken and the position
    stays. Prefixes of each length meet names of that length by equal halves, so
    the join is on keys; ``lengths`` are those of the names. The names, a country's
    at most, are broadcast; what has a row for each address never is, though its
    compressed files look small.
    """
    sized = names.where(~F.col(name).isin(NO_PLACE)).select(*keys, name).distinct().withColumn("n", F.length(name)).where("n > 0")
    sized = sized.select("*", _halves(F.col(name), F.col("n")).alias("h")).select(*keys, name, "n", "h.side", "h.half")
    cut = addresses.select("id", *keys, "address", "pos", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("n"))
    cut = cut.withColumn("here", F.substring("address", F.col("pos"), F.col("n"))).where(F.length("here") == F.col("n"))
    cut = cut.select("*", _halves(F.col("here"), F.col("n")).alias("h")).select("id", *keys, "here", "n", "h.side", "h.half")
    joined = cut.join(F.broadcast(sized), [*keys, "n", "side", "half"])
    exact = F.col("here") == F.col(name)
    differ = F.aggregate(F.zip_with(F.split("here", ""), F.split(name, ""), lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, v: a + v) == 1
    differ = differ & ~F.col("here").rlike(f"[{MASKS}]".replace("*", "\\*"))
    best = joined.groupBy("id").agg(
        F.max_by(F.when(exact, F.col(name)), F.when(exact, F.col("n"))).alias("exact"),
        F.min(F.when(differ, F.col(name))).alias("near"),
        F.max(F.when(differ, F.col(name))).alias("near_too"),
    )
    chosen = F.coalesce("exact", F.when(F.col("near") == F.col("near_too"), F.col("near")))
    out = addresses.drop(name).join(best.select("id", chosen.alias(name)).hint("merge"), "id", "left")
    return out.withColumn("pos", F.col("pos") + F.coalesce(F.length(name), F.lit(0)))


def correct_divisions(addresses: DataFrame, divisions: DataFrame, short_forms: list[tuple[str, str]] = SHORT_FORMS) -> DataFrame:
    """``addresses(id, address)`` with names repaired by ``divisions(province, prefecture, county)``.

    Walks province (or its short form), prefecture, county. A prefecture may be
    missing: then the county is sought in the whole province. So may the province:
    then prefectures of all provinces are tried, and failing these, all counties.
    Of names that differ in one character the only one is taken, or none. ``id``
    is unique; a null address stays null.
    """
    spark = divisions.sparkSession
    forms = spark.createDataFrame(short_forms or [("", "")], "province string, form string")
    provinces = divisions.select("province").distinct()
    named = provinces.withColumn("form", F.col("province")).unionByName(provinces.join(forms, "province"))
    start = addresses.select("id", "address", F.lit(1).alias("pos"))
    sizes = lambda frame, c: F.array_sort(F.collect_set(F.when(F.length(c) > 0, F.length(c))))
    of_prefecture, of_county = divisions.select(sizes(divisions, "prefecture"), sizes(divisions, "county")).first()  # a few numbers
    of_form = named.select(sizes(named, "form")).first()[0]
    one = _level(start, named.select(F.col("form").alias("p")), [], "p", of_form).join(F.broadcast(named.withColumnRenamed("form", "p")), "p", "left")
    one = materialize(one)  # each step is read by two branches
    inside, outside = one.where("p IS NOT NULL"), one.where("p IS NULL").drop("province")
    two = _level(inside, divisions, ["province"], "prefecture", of_prefecture).select("id", "address", "province", "pos", "p", "prefecture")
    two = materialize(two)
    three = _level(two.where("prefecture IS NOT NULL"), divisions, ["province", "prefecture"], "county", of_county)
    skipped = _level(two.where("prefecture IS NULL"), divisions, ["province"], "county", of_county)
    city = _level(outside, divisions, [], "prefecture", of_prefecture).select("id", "address", F.lit("").alias("p"), "pos", "prefecture")
    city = materialize(city)
    county = _level(city.where("prefecture IS NOT NULL"), divisions, ["prefecture"], "county", of_county)
    alone = _level(city.where("prefecture IS NULL"), divisions, [], "county", of_county)
    columns = ["id", "address", "p", "prefecture", "county", "pos"]
    walked = three.select(columns).unionByName(skipped.select(columns)).unionByName(county.select(columns)).unionByName(alone.select(columns))
    written = F.concat(*[F.coalesce(c, F.lit("")) for c in ("p", "prefecture", "county")], F.substring(F.col("address"), F.col("pos"), F.length("address")))
    return walked.select("id", written.alias("corrected"), F.coalesce(written != F.col("address"), F.lit(False)).alias("changed"))


#: Characters that are read for digits, the digits, units that numbers stand before, and marks between digits. Fixed values.
LOOKALIKES, DIGITS = "OoIl|丨ZzSsBbGg", "00111122558866"
UNITS = "号 栋 幢 单元 楼 室 组 户".split()
OPENING, CLOSING, BETWEEN = "[［【〔(（", "]］】〕)）", "-－—/／·•"


def _any(characters: str) -> str:
    """A character class of literal characters."""
    return "[" + "".join("\\" + c if c in "[]-|" else c for c in characters) + "]"


def repair_numbers(address: Column) -> Column:
    """Door numbers as they were: white space goes; brackets around a number before 号 are ones; three single digits with marks between are one number.

    Then characters that look like digits become digits in each token before a
    unit, if the token has a digit at all. Null stays null.
    """
    one = _any("0123456789" + LOOKALIKES)
    unit = "(?=" + "|".join(UNITS) + ")"
    x = F.regexp_replace(address, r"(?U)\s+", "")
    x = F.regexp_replace(x, f"{_any(OPENING)}({one}+){_any(CLOSING)}(?=号)", "1$11")
    x = F.regexp_replace(x, f"(?<!{one})" + _any(BETWEEN).join([f"({one})"] * 3) + unit, "$1$2$3")
    token = f"{one}+{unit}"
    gaps, tokens = F.split(x, token, -1), F.regexp_extract_all(x, F.lit(token), F.lit(0))
    repaired = F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.translate(t, LOOKALIKES, DIGITS)).otherwise(t))
    return F.array_join(F.zip_with(gaps, repaired, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")


def administrative_prefix(address: Column) -> Column:
    """The part up to the last division suffix, or ''."""
    return F.regexp_extract(address, "^(.*(?:自治区|自治州|地区|省|市|盟|县|区|旗))", 1)
