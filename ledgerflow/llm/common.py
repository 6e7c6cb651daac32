"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a Java / RE2 / Python regular expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the one that the driver and all executors share (spark.checkpoint.dir)."""
    sc = spark.sparkContext
    if not (base := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="llm-shared-"))  # one machine, and nobody has named a folder
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark, schema, path = df.sparkSession, df.schema, shared_dir(df.sparkSession)
    df.write.parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._stored_at = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Between large steps: Spark keeps a job's shuffle files until a garbage collection on the driver finds them unused."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settled(df: DataFrame, *columns: Column) -> DataFrame:
    """df with the named columns added, each computed once a row whatever a caller filters or selects later.

    They pass through the explode of an array of one. Spark moves no filter below it and merges no expression across it; a filter
    moved below an array would make that array anew for every element that a lambda looks at.
    """
    at = "_settled"
    names = [c._jc.toString().rsplit(" AS ", 1)[1].strip("`") for c in columns]
    df = df.select("*", F.explode_outer(F.array(F.struct(*columns))).alias(at))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != at], *[F.col(f"{at}.{n}").alias(n) for n in names])


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with its columns named c0, c1, ... and their real names, so that an operator's own names cannot clash with them."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), docs.columns


def words_of(text):
    """Words of a text column (null: none), by built-in functions; an empty array where there is none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
