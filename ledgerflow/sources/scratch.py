"""A folder that the driver and all executors share, for tables between two steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; it is deleted when the session's JVM ends."""
    sc = spark.sparkContext
    if not (base := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ledger-shared-"))  # one machine, and nobody has named a folder
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/ledger-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written below spark.checkpoint.dir and read back: its lineage ends there, and a lost executor loses nothing.

    A path names a place of the caller's own, who deletes it; what lies there is replaced.
    """
    spark, schema = df.sparkSession, df.schema
    df.write.mode("overwrite" if path else "errorifexists").parquet(path := path or scratch(spark))
    return spark.read.schema(schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
