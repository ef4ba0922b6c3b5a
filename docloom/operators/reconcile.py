"""Two sources reconciled field by field, and joins that depend on time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import normalizers as n

OVERRIDABLE = ["plate", "vin", "issue", "mass"]


def arbitrate(comparisons: DataFrame) -> DataFrame:
    """Which value each compared field keeps, and the first rule that decided.

    The other source wins only if its field may be overridden, it was found by its
    printed label in one place, both label and value scores are high (higher if the
    current value is valid), and its value has the field's form.
    """
    other = F.col("other_value")
    needed = F.when(n.check(F.col("field"), F.col("current_value")), 0.985).otherwise(0.97)
    reason = (
        F.when(other.isNull() | (n.compact_key(other) == n.compact_key(F.col("current_value"))), "consistent")
        .when(~F.col("field").isin(OVERRIDABLE), "not overridable")
        .when(F.col("association") != "label-spatial", "no label nearby")
        .when(~F.col("association_unique"), "several candidates")
        .when(F.coalesce("label_confidence", F.lit(0.0)) < 0.95, "label score")
        .when(F.coalesce("value_confidence", F.lit(0.0)) < needed, "value score")
        .when(~n.check(F.col("field"), other), "format")
        .otherwise("other source")
    )
    out = comparisons.withColumn("reason", reason)
    changed = F.col("reason") == "other source"
    return out.select("id", "field", F.when(changed, other).otherwise(F.col("current_value")).alias("value"), "reason", changed.alias("changed"))


def update_is_valid(records: DataFrame) -> DataFrame:
    """``records(id, total, curb, registered, issued)``: total mass is at least curb mass, registration isn't after issue."""
    number = lambda c: F.regexp_extract(c, r"\d+(?:\.\d+)?", 0).try_cast("double")
    day = lambda c: F.regexp_replace(c, r"\D", "")
    mass = F.coalesce(number("total") >= number("curb"), F.lit(True))
    dated = (F.length(day("registered")) == 8) & (F.length(day("issued")) == 8)
    return records.select("id", mass.alias("mass_ok"), (~dated | (day("registered") <= day("issued"))).alias("dates_ok"))


def audit_log(decisions: DataFrame) -> DataFrame:
    """Decisions counted by field and reason, with all fields as one row more (reason '(all)')."""
    rolled = decisions.groupBy("field", "reason").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"))
    total = decisions.groupBy("field").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed")).withColumn("reason", F.lit("(all)"))
    return rolled.unionByName(total)


def first_of(branches: DataFrame, source: str) -> DataFrame:
    """The first answer of a source per group and day."""
    w = Window.partitionBy("group_id", "day").orderBy("finished_at", "id")
    return branches.where(F.col("source") == source).withColumn("rank", F.row_number().over(w)).where("rank = 1").select("group_id", "day", "finished_at", "error")


def cutoff_join(branches: DataFrame, main: str = "view", other: str = "click") -> DataFrame:
    """The main source's answer of a group and day, and what became of the other one.

    The other counts only if it was there no later than the main one.
    """
    a, b = first_of(branches, main), first_of(branches, other)
    b = b.select("group_id", "day", F.col("finished_at").alias("other_at"), F.col("error").alias("other_error"))
    joined = a.join(b, ["group_id", "day"], "left")
    status = F.when(F.col("other_at").isNull(), "missing").when(F.col("other_at") > F.col("finished_at"), "discarded").when(F.col("other_error") != "", "failed").otherwise("completed")
    return joined.select("group_id", "day", "finished_at", status.alias("status"))
