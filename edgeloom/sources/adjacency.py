"""Adjacency text files: a header, n, m, n offsets, m targets and, if weighted, m whole weights, one token a line or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import indexed, scan
from ..staging import staged

HEADERS = {"AdjacencyGraph": False, "WeightedAdjacencyGraph": True}


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """(idx, v): all tokens in file order, numbered within each split and shifted by the splits before."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    words = text.select("file", "start", "line", F.posexplode(F.filter(F.split("value", r"\s+"), lambda w: w != "")).alias("pos", "v"))
    return indexed(staged(words), "file", "start", "line", "pos").select("idx", "v")


def read_adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices): edges (src, dst[, w]). Raises if the header or the number of tokens is wrong.

    A target's source is the last vertex that begins at or before it: a running maximum over the targets, no range join.
    """
    tokens = staged(_tokens(spark, path))
    head = {r["idx"]: r["v"] for r in tokens.where("idx < 3").collect()}
    if head.get(0) not in HEADERS:
        raise ValueError(f"unknown header {head.get(0)!r}")
    weighted, n, m = HEADERS[head[0]], int(head[1]), int(head[2])
    total = tokens.agg(F.max("idx")).first()[0] + 1
    if total != 3 + n + m * (2 if weighted else 1):
        raise ValueError(f"{total} tokens; {3 + n + m * (2 if weighted else 1)} expected")
    numbers = tokens.where("idx >= 3").select((F.col("idx") - 3).alias("idx"), F.col("v").cast("long").alias("v"))
    begins = numbers.where(F.col("idx") < n).groupBy(F.col("v").alias("_at")).agg(F.max("idx").alias("_src"))
    targets = numbers.where((F.col("idx") >= n) & (F.col("idx") < n + m)).select((F.col("idx") - n).alias("idx"), F.col("v").alias("dst"))
    marks = targets.join(begins, F.col("idx") == F.col("_at"), "left").select("idx", F.coalesce("_src", F.lit(-1)).alias("v"))
    source = scan(marks, "max", inclusive=True).select(F.col("idx").alias("_i"), F.col("s").alias("src"))
    edges = targets.join(source, F.col("idx") == F.col("_i"))
    if weighted:
        w = numbers.where(F.col("idx") >= n + m).select((F.col("idx") - n - m).alias("_k"), F.col("v").alias("w"))
        edges = edges.join(w, F.col("idx") == F.col("_k")).select("src", "dst", "w")
    else:
        edges = edges.select("src", "dst")
    return edges, spark.range(n)


def write_adjacency(edges: DataFrame, n: int, path: str) -> None:
    """A folder of text parts that read in order; vertices are 0 .. n - 1, a column w makes it weighted."""
    spark = edges.sparkSession
    weighted, m = "w" in edges.columns, edges.count()
    degree = spark.range(n).join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("d")), F.col("id") == F.col("src"), "left")
    offsets = scan(degree.select(F.col("id").alias("idx"), F.coalesce("d", F.lit(0)).alias("v")), "sum").select("idx", F.col("s").alias("v"))
    order = indexed(edges, "src", "dst")
    rows = [spark.createDataFrame([(-3, "WeightedAdjacencyGraph" if weighted else "AdjacencyGraph"), (-2, str(n)), (-1, str(m))], "idx long, v string"), offsets, order.select((F.col("idx") + n).alias("idx"), F.col("dst").alias("v"))]
    rows += [order.select((F.col("idx") + n + m).alias("idx"), F.col("w").alias("v"))] if weighted else []
    every = None
    for r in rows:
        r = r.select("idx", F.col("v").cast("string").alias("v"))
        every = r if every is None else every.unionByName(r)
    every.orderBy("idx").select("v").write.text(path)


def csr_window(edges: DataFrame) -> DataFrame:
    """(src, neighbours): sorted adjacency arrays, for graphs whose hubs fit in a row."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


