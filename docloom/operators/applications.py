"""Whole applications: files, people and checks joined to one row, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import files as f
from docloom.operators import survivors


def process_applications(files: DataFrame, documents: DataFrame) -> DataFrame:
    """The summary of each application with its people, documents and address checks."""
    people = survivors.link_people(documents).groupBy("application_no").agg(F.countDistinct("person_id").alias("n_people"), F.count("*").alias("n_documents"))
    checks = survivors.cross_check(documents).groupBy("application_no").agg(F.count("*").alias("n_checks"), F.count_if(F.col("status") == "different").alias("n_different"))
    out = f.application_summary(files).join(people, "application_no", "left").join(checks, "application_no", "left")
    return out.fillna(0, ["n_people", "n_documents", "n_checks", "n_different"])


def summarize_run(results: DataFrame) -> DataFrame:
    """``results(group_id, error, text, skipped)`` to counts by group: all, skipped, failed, empty, and the rest."""
    failed, empty = F.col("error") != "", F.col("text") == ""
    ran = ~F.col("skipped")
    return results.groupBy("group_id").agg(
        F.count("*").alias("n_total"), F.count_if(F.col("skipped")).alias("n_skipped"), F.count_if(ran & failed).alias("n_failed"),
        F.count_if(ran & ~failed & empty).alias("n_empty"), F.count_if(ran & ~failed & ~empty).alias("n_succeeded"),
    )


def resolve_document_type(requests: DataFrame, types: DataFrame) -> DataFrame:
    """``requests(id, asked)`` with the key of ``types(key, name)`` that they ask for by key or name; others with the list of choices.

    The table of types is small; if a name is another type's key, the key goes first.
    """
    choices = types.agg(F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("choices"))
    by = types.select(F.col("key").alias("asked"), "key", F.lit(0).alias("rank")).unionByName(types.select(F.col("name").alias("asked"), "key", F.lit(1).alias("rank")))
    by = by.groupBy("asked").agg(F.min_by("key", "rank").alias("key"))
    found = requests.withColumn("asked", F.trim("asked")).join(by, "asked", "left").join(F.broadcast(choices))
    return found.select("id", "key", F.when(F.col("key").isNull(), F.concat(F.lit("choose one of "), "choices")).otherwise("").alias("error"))


def write_report(applications: DataFrame, path: str) -> None:
    """One JSON object per application, in folders by status."""
    applications.write.mode("overwrite").partitionBy("status").json(path)
