"""From raw documents to pieces: quality rules, line dedup, near duplicates, benchmark leaks, segmentation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import decontam, jaccard, lines, pieces, quality
from edgeloom.llm.common import keep_where, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host does, go; columns and rows that stay are unchanged.

    Null and empty texts have no words and go. A null source has no host verdict. Repeated rows share their fate, ids
    play no part, an empty table stays empty.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows lose their later occurrences; n_chars follows, and a document with nothing left goes.

    The occurrence of the least doc_id is the first (null before all, ties by a fingerprint of the text, then by place);
    rows that repeat id and text are one document. Null texts and those of fewer lines stay as they are.
    """
    cut = keep_where(lines.drop_repeated_lines(docs), F.expr("_n_removed = 0 or _n_removed < _n_lines"))
    return cut.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 on five-word shingles the least id stays.

    Texts of fewer words are compared whole. Rows that repeat id and text stay once; other texts that share an id are
    kept apart. Rows without an id or without words stay all.
    """
    return jaccard.keep_one(docs, size=5, num=80, den=100)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that holds a test item go; others stay unchanged, those that share an id with one too.

    Null and empty texts hold none; with an empty benchmark all stay.
    """
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, its other best segmentations, and whether decoding gives it back; one row for each row.

    Null and empty texts have no pieces. Columns named like the new ones are replaced.
    """
    return pieces.encode(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("segmentation", segmentation),
]

#: No SQL searches a piece lattice or joins by similarity; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
