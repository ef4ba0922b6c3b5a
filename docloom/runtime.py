"""Session-level helpers that every job may need: shared storage and code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}

#: Bounds on what one Arrow batch holds, so texts of any length fit a Python worker.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's ``spark.checkpoint.dir``.

    The setting is read from the session. Only where it is unset in a local session
    is one made, because then driver and executors are one process; on a cluster
    that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all of {master} shares")
        base = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame, at: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: what was computed survives the loss of any executor.
    """
    spark = df.sparkSession
    path = at or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` shuffled by key before costly work on each row, so that its tasks are not those of a few small files."""
    return df.repartition(*keys)


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """As ``spread``, into all of the session's shuffle partitions: for work that bytes don't show, which adaptive execution would leave to a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that don't share the driver's path; bound Arrow batches where the session doesn't."""
    for key, value in _BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="docloom-zip-"), "docloom.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED[sc.applicationId] = out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; read by Spark only, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
