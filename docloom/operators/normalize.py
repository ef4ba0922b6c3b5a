"""Normalisation of records: a rule table applied to fields in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import normalizers as n
from docloom.runtime import spread


def normalize_columns(frame: DataFrame, rules: dict[str, tuple[str, str]], keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Result column to (normalizer, source column); one pass, no shuffle."""
    return frame.select(*keep, *[n.apply(rule, F.col(source)).alias(name) for name, (rule, source) in rules.items()])


def normalize_fields(records: DataFrame, profile: DataFrame, columns: list[str]) -> DataFrame:
    """Wide ``records`` to normalised fields, as ``profile(field, source, normalizer)`` says.

    The profile, a small rule table with a row a field, is read by the driver; each
    record, spread by id, is then normalised where it stands, in one pass. ``id``
    is unique; a field whose source is none of ``columns`` is ''.
    """
    rules = sorted((r.field, r.normalizer, r.source) for r in profile.select("field", "normalizer", "source").collect())
    value = lambda rule, source: n.apply(rule, F.col(source)) if source in columns else F.lit("")
    return spread(records, "id").select("id", *[F.coalesce(value(rule, source), F.lit("")).alias(field) for field, rule, source in rules])


def check_identity(people: DataFrame) -> DataFrame:
    """``people(id, body, corrupted, spaced)``: completed by the check character, perhaps damaged, then normalised and validated."""
    digits = F.transform(F.split("body", ""), lambda c: c.cast("int"))
    total = F.aggregate(F.zip_with(digits, F.array(*[F.lit(w) for w in n.ID_WEIGHTS]), lambda d, w: d * w), F.lit(0), lambda a, v: a + v)
    check = F.substring(F.lit(n.ID_CHECKS), (total % 11 + 1).cast("int"), F.lit(1))
    check = F.when(F.col("corrupted"), F.when(check == "1", "2").otherwise("1")).otherwise(F.lower(check))
    number = F.concat("body", check)
    number = F.when(F.col("spaced"), F.concat(F.lit(" "), F.substring(number, 1, 6), F.lit(" "), F.substring(number, 7, 12))).otherwise(number)
    return people.select("id", n.apply("identity_number", number).alias("number"), n.check(F.lit("identity"), F.upper(n.compact(number))).alias("valid_1950"))
