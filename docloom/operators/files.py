"""Files of applications: deduplication, pairing of sides, summaries.

Frames: ``files(application_no, material, name, digest, file_id)``. Order within an
application is by lower-case name, then name, then file_id, so every rank is total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ["back", "driver", "front"]


def _by_name() -> list[Column]:
    return [F.lower("name"), F.col("name"), F.col("file_id")]


def dedupe_files(files: DataFrame) -> DataFrame:
    """The first file of each content digest within an application's material."""
    w = Window.partitionBy("application_no", "material", "digest").orderBy(*_by_name())
    return files.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def count_duplicates(files: DataFrame) -> DataFrame:
    """Files beyond the first of their digest, by application and material."""
    return files.groupBy("application_no", "material").agg((F.count("*") - F.countDistinct("digest")).cast("long").alias("n_duplicates"))


def batch_token(name: Column) -> Column:
    """The second ``_`` part of a stem of three parts or more, if it is all digits; else null."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    token = F.when(F.size(parts) >= 3, parts[1])
    return F.when(token.rlike("^[0-9]+$"), token)


def pair_sides(files: DataFrame) -> DataFrame:
    """Fronts paired with backs: by batch token (high), then by position (medium), else left alone.

    The k-th front of a token meets the k-th back of it; what is left over meets by
    rank in the application. All steps are equi-joins on the application.
    """
    sides = files.where(F.col("material").isin("front", "back")).withColumn("token", batch_token(F.col("name")))
    ranked = sides.withColumn("k", F.row_number().over(Window.partitionBy("application_no", "material", "token").orderBy(*_by_name())))
    front, back = (ranked.where(F.col("material") == m).select("application_no", "token", "k", F.col("file_id").alias(f"{m}_id"), F.col("name").alias(f"{m}_name")) for m in ("front", "back"))
    high = front.where("token IS NOT NULL").join(back.where("token IS NOT NULL"), ["application_no", "token", "k"])
    rest = {}
    for side, other in ((front, "front"), (back, "back")):
        left = side.join(high.select(f"{other}_id"), f"{other}_id", "left_anti")
        order = Window.partitionBy("application_no").orderBy(F.lower(f"{other}_name"), f"{other}_name", f"{other}_id")
        rest[other] = left.select("application_no", f"{other}_id", f"{other}_name", F.row_number().over(order).alias("k"))
    low = rest["front"].join(rest["back"], ["application_no", "k"], "full_outer")
    kind = F.when(F.col("front_id").isNull(), "unpaired_back").when(F.col("back_id").isNull(), "unpaired_front").otherwise("medium")
    columns = ["application_no", "front_name", "back_name", "confidence"]
    return high.withColumn("confidence", F.lit("high")).select(columns).unionByName(low.withColumn("confidence", kind).select(columns))


def missing_documents(files: DataFrame) -> DataFrame:
    """Required materials that an application lacks; the required list is part of the plan."""
    held = files.groupBy("application_no").agg(F.collect_set("material").alias("held"))
    lacks = F.array_except(F.array(*[F.lit(m) for m in REQUIRED]), F.col("held"))
    return held.select("application_no", F.array_join(F.array_sort(lacks), ",").alias("missing"))


def application_summary(files: DataFrame) -> DataFrame:
    """One row per application: files, kept files, pairs by confidence, missing materials, status."""
    kept = dedupe_files(files)
    pairs = pair_sides(kept).groupBy("application_no").agg(*[F.count_if(F.col("confidence") == c).alias(f"n_{c}") for c in ("high", "medium", "unpaired_front", "unpaired_back")])
    counts = files.groupBy("application_no").agg(F.count("*").alias("n_files"))
    unique = kept.groupBy("application_no").agg(F.count("*").alias("n_kept"))
    out = counts.join(unique, "application_no").join(pairs, "application_no", "left").join(missing_documents(files), "application_no")
    zero = {c: 0 for c in ("n_high", "n_medium", "n_unpaired_front", "n_unpaired_back")}
    return out.fillna(zero).withColumns({"n_duplicates": F.col("n_files") - F.col("n_kept"), "status": F.when(F.col("missing") == "", "completed").otherwise("partial")})


def scan_rollup(files: DataFrame) -> DataFrame:
    """Applications and files by material, and in all (material '(all)')."""
    rolled = files.rollup("material").agg(F.countDistinct("application_no").alias("n_applications"), F.count("*").alias("n_files"), F.count_if(F.col("name").endswith("0.jpg")).alias("n_round"))
    return rolled.select(F.coalesce("material", F.lit("(all)")).alias("material"), "n_applications", "n_files", "n_round")


def list_images(files: DataFrame) -> DataFrame:
    """Image names per application and required material, in order; materials without a file are there too."""
    every = files.select("application_no").distinct().select("application_no", F.explode(F.array(*[F.lit(m) for m in REQUIRED])).alias("material"))
    named = files.groupBy("application_no", "material").agg(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("l"), "name"))).alias("n"))
    return every.join(named, ["application_no", "material"], "left").select("application_no", "material", F.coalesce(F.array_join(F.transform("n", lambda x: x["name"]), ","), F.lit("")).alias("names"))


def page_fanout(items: DataFrame, most: int = 100) -> DataFrame:
    """One row per page of ``items(id, page_count)``; none or more than ``most`` pages give a reject row with page null."""
    good = F.col("page_count").between(1, most)
    pages = F.when(good, F.sequence(F.lit(1), F.greatest("page_count", F.lit(1)))).otherwise(F.array(F.lit(None).cast("int")))
    return items.select("id", F.explode(pages).alias("page"), (~good).alias("rejected")).withColumn("page", F.col("page").cast("long"))
