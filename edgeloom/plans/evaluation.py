"""Multi-label evaluation: splits by hash, one-vs-rest logistic regression, top labels per row, micro and macro F1."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import uniform
from ..staging import drop_staged, staged
from .linalg import _matrix, _sum_small, _tall, times_small


def split(ids: DataFrame, train_share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    marked = ids.withColumn("_u", uniform(seed, "id"))
    return marked.where(F.col("_u") < train_share).drop("_u"), marked.where(F.col("_u") >= train_share).drop("_u")


def top_labels(scores: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, label): for each row its n best labels; of equal scores the greater label is better."""
    n = counts.select(F.col("id").alias("_c"), "n")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), F.col("label").desc()))
    return scores.withColumn("_p", place).join(n, F.col("id") == F.col("_c")).where("_p <= n").select("id", "label")


def f1(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(micro, macro) of distinct (id, label) pairs; a label without a score counts 0."""
    a = truth.select("id", "label").distinct()
    b = predicted.select(F.col("id").alias("_i"), F.col("label").alias("_l")).distinct()
    both = a.join(b, (F.col("id") == F.col("_i")) & (F.col("label") == F.col("_l")), "full").select(F.coalesce("label", "_l").alias("label"), F.col("id").isNotNull().alias("t"), F.col("_i").isNotNull().alias("p"))
    per = both.groupBy("label").agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t")).alias("fp"), F.count_if(~F.col("p")).alias("fn"))
    score = lambda tp, fp, fn: F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    c = F.col
    return per.agg(score(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro"), F.avg(score(c("tp"), c("fp"), c("fn"))).alias("macro"))


def _summed(rows: DataFrame, width: int, part: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of part(x, rows) over all rows (vec, ...), x being the vectors with a 1 behind; one matrix a task, combined before the driver gets one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                m = part(np.hstack([_matrix(b), np.ones((b.num_rows, 1))]), b)
                total = m if total is None else total + m
        if total is not None:
            yield _tall(pa.array(range(len(total)), pa.int64()), total).rename_columns(["k", "vec"])

    return _sum_small(rows.mapInArrow(run, "k long, vec array<double>"), width)


def predict_scores(embedding: DataFrame, labels: DataFrame, train: DataFrame, c: float = 1.0, rounds: int = 200, tol: float = 1e-5) -> DataFrame:
    """(id, label, score) of the rows not in train, for each label by the logistic regression with the least c * loss + |w|^2 / 2 (the bias is a weight).

    All labels learn together, a pass over the rows a round: the Hessian is never above c / 4 X'X + I, the same for every
    label, so accelerated steps by that bound need no line search. The driver and each task hold (width + 1) x labels
    weights. No rows or no labels to learn from give no scores.
    """
    spark = embedding.sparkSession
    names = labels.where("label is not null").select("label").distinct().orderBy("label").collect()
    places = spark.createDataFrame([(k, r["label"]) for k, r in enumerate(names)], f"k int, label {labels.schema['label'].dataType.simpleString()}")
    known = labels.select("id", F.col("label").alias("_l")).join(F.broadcast(places), F.col("_l") == F.col("label"))
    marks = known.groupBy(F.col("id").alias("_m")).agg(F.collect_set("k").alias("marks"))
    some = embedding.join(train.select(F.col("id").alias("_t")).distinct(), F.col("id") == F.col("_t"), "left_semi")
    learn = staged(some.join(marks, F.col("id") == F.col("_m"), "left").select("vec", F.coalesce("marks", F.expr("cast(array() as array<int>)")).alias("marks")))
    first = learn.first()
    if not names or first is None:
        return embedding.limit(0).crossJoin(places.limit(0)).select("id", "label", F.lit(0.0).alias("score"))
    width = len(first["vec"]) + 1
    gram = _summed(learn.select("vec"), width, lambda x, _: x.T @ x)
    bound = np.linalg.inv(c / 4 * gram + np.eye(width))

    def misses(w: np.ndarray) -> Callable[[np.ndarray, pa.RecordBatch], np.ndarray]:
        def part(x: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            own = b.column("marks")
            p[np.repeat(np.arange(len(x)), own.value_lengths().to_numpy(zero_copy_only=False)), own.flatten().to_numpy(zero_copy_only=False)] -= 1
            return x.T @ p

        return part

    w = ahead = np.zeros((width, len(names)))
    pace = 1.0
    for _ in range(rounds):
        slope = c * _summed(learn, width, misses(ahead)) + ahead
        step = ahead - bound @ slope
        pace = 1.0 if np.sum(slope * (step - w)) > 0 else pace
        further = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = step + (pace - 1) / further * (step - w)
        moved, w, pace = np.abs(step - w).max(), step, further
        if moved <= tol * max(1.0, np.abs(w).max()):
            break
    drop_staged(learn)
    test = embedding.join(train.select(F.col("id").alias("_t")), F.col("id") == F.col("_t"), "left_anti")
    odds = times_small(test.select("id", F.concat("vec", F.array(F.lit(1.0))).alias("vec")), w).select("id", F.posexplode("vec").alias("_k", "_z"))
    return odds.join(F.broadcast(places), F.col("_k") == F.col("k")).select("id", "label", (1 / (1 + F.exp(-F.col("_z")))).alias("score"))


def evaluate(embedding: DataFrame, labels: DataFrame, train_share: float, seed: int = 1, c: float = 1.0) -> DataFrame:
    """(micro, macro) of one split: as many labels are predicted for a row as it has."""
    have = embedding.join(labels.select(F.col("id").alias("_l")).distinct(), F.col("id") == F.col("_l"), "left_semi")
    train, test = split(have.select("id"), train_share, seed)
    scores = predict_scores(have, labels, train, c)
    truth = labels.join(test.select(F.col("id").alias("_t")), F.col("id") == F.col("_t"), "left_semi").select("id", "label").distinct()
    return f1(truth, top_labels(scores, truth.groupBy("id").agg(F.count(F.lit(1)).alias("n"))))


def evaluate_splits(embedding: DataFrame, labels: DataFrame, train_share: float, splits: int = 10, seed: int = 1, c: float = 1.0) -> DataFrame:
    """(train_share, splits, micro, macro, micro_std, macro_std): means and deviations in per cent over independent splits."""
    runs = np.array([tuple(evaluate(embedding, labels, train_share, seed + k, c).first()) for k in range(splits)], dtype=float) * 100
    mean, std = runs.mean(0), runs.std(0)
    row = (float(train_share), splits, *map(float, mean), *map(float, std))
    return embedding.sparkSession.createDataFrame([row], "train_share double, splits int, micro double, macro double, micro_std double, macro_std double")
