"""Files of applications from a folder tree ``root/{application_no}/{material_code}/file``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Material codes and supported file types. Fixed values.
MATERIALS = {"DG12": "id_front", "DG13": "id_back", "DG14": "driver_license", "Z002": "vehicle_license"}
SUFFIXES = ["jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff", "pdf"]


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(application_no, material, name, length, digest) of supported files that lie directly in a material folder.

    Nested files, other types, and artefacts of earlier runs (``.page-N.oriented.``,
    ``.page-N.document-crop.``) are skipped. Contents are hashed where they are read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root), r"^[a-z]+:/+|/+$|^/+", "")
    inner = F.regexp_replace("path", r"^[a-z]+:/+", "")
    parts = F.split(F.substring(inner, F.length(base) + 2, F.lit(10_000)), "/")
    out = found.select(F.when(F.size(parts) == 3, parts).alias("p"), "length", F.sha2("content", 256).alias("digest")).where("p IS NOT NULL")
    code = F.element_at(F.create_map(*[F.lit(x) for kv in MATERIALS.items() for x in kv]), F.col("p")[1])
    named = out.select(F.col("p")[0].alias("application_no"), code.alias("material"), F.col("p")[2].alias("name"), "length", "digest").where("material IS NOT NULL")
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    return named.where(suffix.isin(SUFFIXES) & ~F.col("name").rlike(r"\.page-[0-9]+\.(?:oriented|document-crop)\."))


def known_applications(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): application numbers of 1 to 32 digits, and all others."""
    good = F.col("application_no").rlike(r"^[0-9]{1,32}$")
    return files.where(good), files.where(~good)
