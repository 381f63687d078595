"""Helpers shared by the corpus operators: table access, staging and row keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Only where everything runs on one machine may it be unset, and is a fresh one then."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="edgeloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


#: While this is set, Spark deletes a query's shuffle files when the query ends; a staged table is never computed again, so none of them is missed.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors, has a known size, and frees the shuffles behind it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """The rows where condition is true, for conditions on computed columns: a plain filter would be pushed below them and compute each of their parts again for every mention."""
    return df.withColumn("_keep", F.explode(F.when(condition, F.array(F.lit(1))).otherwise(F.expr("cast(array() as array<int>)")))).drop("_keep")


def text_key(text: Column) -> Column:
    """A 128-bit fingerprint of a text as two longs in a struct; null and '' differ."""
    return F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text, F.coalesce(F.length(text), F.lit(-1))).alias("b"))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Steps that run inside have this SQL setting."""
    held = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, held)


def arrow_rows(spark: SparkSession, rows: int):
    """Steps that run inside hand at most so many rows to Python at a time, for rows that hold whole sets or texts; Spark's own limit of 64 MB a batch holds besides."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
