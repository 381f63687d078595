"""Edge lists, id maps and labels as text, and how they become graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import apply_idmap, relabel, symmetrize


def read_edge_list(spark: SparkSession, path: str, sep: str = "\t", make_symmetric: bool = False, dense_ids: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(edges, idmap or None): the first two columns of text lines, '#' lines left out, loops dropped, repeats collapsed."""
    lines = spark.read.csv(path, sep=sep, comment="#", inferSchema=False, header=False)
    first, second = lines.columns[:2]
    edges = lines.select(F.col(first).cast("long").alias("src"), F.col(second).cast("long").alias("dst")).where("src <> dst").distinct()
    edges = symmetrize(edges) if make_symmetric else edges
    return relabel(edges) if dense_ids else (edges, None)


def write_edge_list(edges: DataFrame, path: str, sep: str = "\t") -> None:
    edges.select("src", "dst").write.csv(path, sep=sep)


def read_json_idmap(spark: SparkSession, path: str) -> DataFrame:
    """(old_id, new_id) of a JSON list whose places are the new ids."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<bigint>").alias("ids"))
    return whole.select(F.posexplode("ids").alias("new_id", "old_id")).select("old_id", F.col("new_id").cast("long").alias("new_id"))


def read_labels(spark: SparkSession, path: str, idmap: DataFrame | None = None) -> DataFrame:
    """(id, label) of tab-separated pairs, renamed by idmap."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="id long, label long")
    if idmap is None:
        return raw
    pairs = apply_idmap(raw.select(F.col("id").alias("src"), F.col("id").alias("dst"), "label"), idmap)
    return pairs.select(F.col("src").alias("id"), "label")


def link_prediction_split(edges: DataFrame, ratio: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(held-out arcs, the rest): an undirected edge's two arcs fall on one side."""
    from ..functions.random import uniform

    marked = edges.withColumn("_u", uniform(seed, F.least("src", "dst"), F.greatest("src", "dst")))
    return marked.where(F.col("_u") < ratio).drop("_u"), marked.where(F.col("_u") >= ratio).drop("_u")
