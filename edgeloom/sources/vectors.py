"""Embeddings as raw float32 rows, as word2vec text, and as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_raw(vectors: DataFrame, path: str) -> None:
    """Little-endian float32 rows in the order of ids, streamed through the driver to one local file; large results belong in Parquet."""
    with open(path, "wb") as out:
        for row in vectors.select("id", "vec").orderBy("id").toLocalIterator():
            out.write(np.asarray(row["vec"], "<f4").tobytes())


def read_raw(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(id, vec): ids are places in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_py(), "<f4").astype(float)
                offsets = pa.array(np.arange(0, len(x) + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(x) // dim), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(x))], names=["id", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, vec array<double>")


def read_word2vec(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec) of lines 'id x1 .. xd'; a first line of two numbers is a header."""
    fields = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(fields.alias("f")).where(F.size("f") > 2)
    return rows.select(F.col("f")[0].cast("long").alias("id"), F.expr("transform(slice(f, 2, size(f) - 1), x -> cast(x as double))").alias("vec"))
