"""Structured Streaming forms of three operators, each run to the end of what is there.

State and output lie in the cluster's shared folder, so a lost executor only
repeats its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import ingest
from docloom.runtime import shared_dir


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table of one file as a file stream; the schema is read once, and local times become instants."""
    known = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(known).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in known if f.dataType.typeName() == "timestamp_ntz"})


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all that is available, then read the result as a table."""
    spark = stream.sparkSession
    folder = shared_dir(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def dedupe_stream(files: DataFrame, late: str = "30 days") -> DataFrame:
    """The first arrival of each (application_no, material, digest) while its event time is within ``late``."""
    return files.withWatermark("added_at", late).dropDuplicatesWithinWatermark(["application_no", "material", "digest"])


def cutoff_stream_join(main: DataFrame, other: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Each main answer with the other source's answer of its key, if that came first and within ``within``.

    Both have (group_id, finished_at); a main row without such an answer comes out
    alone once the watermark has passed it.
    """
    a = main.withWatermark("finished_at", late).select("group_id", "finished_at")
    b = other.select(F.col("group_id").alias("other_group"), F.col("finished_at").alias("other_at")).withWatermark("other_at", late)
    on = (F.col("group_id") == F.col("other_group")) & (F.col("other_at") <= F.col("finished_at")) & (F.col("other_at") >= F.col("finished_at") - F.expr(f"INTERVAL {within}"))
    return a.join(b, on, "leftOuter").select("group_id", "finished_at", "other_at")


def normalize_stream(responses: DataFrame) -> DataFrame:
    """Stateless: responses parsed as they arrive."""
    return ingest.parse_responses(responses)
