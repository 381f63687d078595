"""Materialising steps of a loop as tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where everything runs on one machine may it be unset, and is a fresh folder then."""
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
    """Write df and read it back: the plan that follows starts from a table, whatever happens to executors, and the shuffles behind it are freed."""
    conf = df.sparkSession.conf
    path, held = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}", conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, held)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Pile:
    """What the rounds of a loop give, as one table. Every 8 tables of a size class are written as one of the next, so a
    plan over n rounds reads 7 log n tables and a row is written again log n times (to the base of 8).
    """

    def __init__(self, first: DataFrame):
        self.classes: list[list[DataFrame]] = []
        self.add(first)

    def add(self, df: DataFrame, k: int = 0) -> None:
        """The table added last is only written again when another comes, so a loop may still read it by itself."""
        if k == len(self.classes):
            self.classes.append([])
        if len(self.classes[k]) == 8:
            whole = staged(reduce(DataFrame.unionByName, self.classes[k]))
            drop_staged(*self.classes[k])
            self.classes[k] = []
            self.add(whole, k + 1)
        self.classes[k].append(df)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [df for tables in self.classes for df in tables])
