"""Sparse matrices as (row, col, v), tall dense ones as (id, vec): products, orthogonal bases, randomised SVD."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import uniform
from ..staging import staged

TALL = "id long, vec array<double>"


def spmv(m: DataFrame, x: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(row, v): m times x (id, v); with rows (id), empty rows are 0."""
    xs = x.select(F.col("id").alias("_id"), F.col("v").alias("_x"))
    y = m.join(xs, F.col("col") == F.col("_id")).groupBy("row").agg(F.sum(F.col("v") * F.col("_x")).alias("v"))
    if rows is None:
        return y
    return rows.select("id").join(y, F.col("id") == F.col("row"), "left").select(F.col("id").alias("row"), F.coalesce("v", F.lit(0.0)).alias("v"))


def spmm_sparse(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, v): the product of two sparse matrices."""
    right = b.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("v").alias("_v"))
    return a.join(right, F.col("col") == F.col("_r")).groupBy("row", F.col("_c").alias("col")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))


def spmm(m: DataFrame, x: DataFrame, rows: DataFrame | None = None, width: int | None = None) -> DataFrame:
    """(id, vec): m times a tall matrix; sums of vectors combine before the shuffle. With rows and width, empty rows are 0."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    xs = x.select(F.col("id").alias("_id"), F.col("vec").alias("_x"))
    terms = m.join(xs, F.col("col") == F.col("_id")).select("row", array_to_vector(F.expr("transform(_x, a -> a * v)")).alias("_t"))
    y = terms.groupBy(F.col("row").alias("id")).agg(vector_to_array(Summarizer.sum(F.col("_t"))).alias("vec"))
    if rows is None:
        return y
    y = y.select(F.col("id").alias("_y"), "vec")
    return rows.select("id").join(y, F.col("id") == F.col("_y"), "left").select("id", F.coalesce("vec", F.array_repeat(F.lit(0.0), width)).alias("vec"))


def _matrix(batch: pa.RecordBatch, name: str = "vec") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _tall(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)[: len(ids) + 1])
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).reshape(-1)))], names=["id", "vec"])


def times_small(x: DataFrame, small: np.ndarray) -> DataFrame:
    """A tall matrix times a small one, which is broadcast: rank by rank doubles."""
    held = x.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b.column(0)):
                yield _tall(b.column(0), _matrix(b) @ held.value)

    return x.select("id", "vec").mapInArrow(run, TALL)


def _sum_small(df: DataFrame, width: int) -> np.ndarray:
    """Sum of small matrices given as rows (k, vec), each partition's own already summed."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = df.groupBy("k").agg(vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec")).collect()
    out = np.zeros((width, len(rows[0]["vec"]) if rows else width))
    for r in rows:
        out[r["k"]] = r["vec"]
    return out


def inner(z: DataFrame, b: DataFrame, width: int) -> np.ndarray:
    """Z transposed times B, both tall, on the driver: width by width."""
    both = z.select("id", "vec").join(b.select(F.col("id").alias("_b"), F.col("vec").alias("vec2")), F.col("id") == F.col("_b")).select("vec", "vec2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in batches:
            if len(x.column(0)):
                part = _matrix(x).T @ _matrix(x, "vec2")
                total = part if total is None else total + part
        if total is not None:
            yield _tall(pa.array(range(len(total)), pa.int64()), total).rename_columns(["k", "vec"])

    return _sum_small(both.mapInArrow(run, "k long, vec array<double>"), width)


def orthonormal(x: DataFrame, width: int, fan_in: int = 64) -> DataFrame:
    """An orthonormal basis of the columns of a tall matrix by TSQR: R of every partition, R of stacks of fan_in R, and X times the last one's inverse.

    Columns that depend on others, as when there are fewer rows than columns, become zero.
    """
    names = "part long, vec array<double>"

    def triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, width))
        for b in batches:
            if len(b.column(0)):
                r = np.linalg.qr(np.vstack([r, _matrix(b)]), mode="r")
        if len(r):
            yield _tall(pa.array([TaskContext.get().partitionId()] * len(r), pa.int64()), r).rename_columns(["part", "vec"])

    def stack(key: tuple, t: pa.Table) -> pa.Table:
        r = np.linalg.qr(np.array(t.column("vec").to_pylist()).reshape(-1, width), mode="r")
        return pa.Table.from_batches([_tall(pa.array([key[0].as_py()] * len(r), pa.int64()), r).rename_columns(["part", "vec"])])

    r = staged(x.select("id", "vec").mapInArrow(triangles, names))
    while r.select("part").distinct().count() > fan_in:
        r = staged(r.select(F.expr(f"part div {fan_in}").alias("part"), "vec").groupBy("part").applyInArrow(stack, names))
    rows = np.array([v[0] for v in r.select("vec").collect()]).reshape(-1, width)
    if not len(rows):
        return x
    _, s, vt = np.linalg.svd(np.linalg.qr(rows, mode="r"), full_matrices=False)
    keep = s > (s[0] if len(s) else 0) * 1e-12
    back = np.zeros((width, width))
    back[:, : keep.sum()] = vt[keep].T / s[keep]
    return times_small(x, back)


def gaussian(ids: DataFrame, width: int, seed: int) -> DataFrame:
    """N(0, 1) rows fixed by (seed, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b.column(0)):
                yield _tall(b.column(0), np.stack([np.random.default_rng([seed, i]).standard_normal(width) for i in b.column(0).to_pylist()]))

    return ids.select(F.col("id").cast("long")).mapInArrow(run, TALL)


def sparse_projection(ids: DataFrame, width: int, seed: int, s: float) -> DataFrame:
    """Rows whose cells are +-sqrt(s) with probability 1 / (2 s) each and else 0, fixed by (seed, id, column)."""
    cell = f"transform(sequence(0, {width - 1}), k -> xxhash64({seed}, id, k))"
    value = f"case when shiftrightunsigned(h, 11) * {2.0**-53!r}D < {1 / s!r}D then case when h % 2 = 0 then {math.sqrt(s)!r}D else -{math.sqrt(s)!r}D end else 0.0D end"
    return ids.select("id", F.expr(f"transform({cell}, h -> {value})").alias("vec"))


def randomized_svd(m: DataFrame, ids: DataFrame, rank: int, seed: int = 777, sparse: float | None = None, project_only: bool = False) -> tuple[DataFrame, np.ndarray | None]:
    """(U as a tall matrix, singular values) of a symmetric sparse matrix, by two products with it; project_only gives the projection and None."""
    start = gaussian(ids, rank, seed) if sparse is None else sparse_projection(ids, rank, seed, sparse)
    y = staged(spmm(m, start, ids, rank))
    if project_only:
        return y, None
    y = staged(orthonormal(y, rank))
    b = staged(spmm(m, y, ids, rank))
    p = np.random.default_rng(seed).standard_normal((rank, rank))
    z = staged(orthonormal(times_small(b, p), rank))
    u, s, _ = np.linalg.svd(inner(z, b, rank))
    return times_small(z, u), s


def sigma_scale(u: DataFrame, s: np.ndarray | None, dim: int, normalize: bool = False) -> DataFrame:
    """The first dim columns of U times the roots of the singular values; without them, U's own."""
    scale = np.zeros((len(s) if s is not None else dim, dim))
    np.fill_diagonal(scale, np.sqrt(s[:dim]) if s is not None else 1.0)
    out = times_small(u, scale) if s is not None else u.select("id", F.slice("vec", 1, dim).alias("vec"))
    return l2_normalize(out) if normalize else out


def l2_normalize(x: DataFrame, least: float = 1e-5) -> DataFrame:
    """Rows of length 1; those no longer than least stay."""
    norm = "sqrt(aggregate(vec, 0.0D, (s, a) -> s + a * a))"
    return x.select("id", F.expr(f"case when {norm} > {least} then transform(vec, a -> a / {norm}) else vec end").alias("vec"))


def combine(parts: list[tuple[float, DataFrame]]) -> DataFrame:
    """A weighted sum of tall matrices with the same ids."""
    first, *rest = parts
    out = first[1].select("id", F.expr(f"transform(vec, a -> a * {first[0]!r}D)").alias("vec"))
    for weight, x in rest:
        x = x.select(F.col("id").alias("_o"), F.col("vec").alias("_v"))
        out = out.join(x, F.col("id") == F.col("_o")).select("id", F.expr(f"zip_with(vec, _v, (a, b) -> a + b * {weight!r}D)").alias("vec"))
    return out


def dense_embedding(x: DataFrame, dim: int) -> DataFrame:
    """U times the roots of the singular values of a tall matrix, rows normalised, from the eigenvectors of its Gram matrix."""
    values, vectors = np.linalg.eigh(inner(x, x, dim))
    order = np.argsort(-values)
    sigma = np.sqrt(np.maximum(values[order], 0))
    back = vectors[:, order] * np.where(sigma > 1e-12, 1 / np.sqrt(np.maximum(sigma, 1e-300)), 0.0)
    return l2_normalize(times_small(x, back))


def bessel_i(order: int, x: float) -> float:
    """The modified Bessel function of the first kind, by its series."""
    term, total, k = (x / 2) ** order / math.factorial(order), 0.0, 0
    while term > 1e-18 * max(total, 1e-300) and k < 500:
        total += term
        k += 1
        term *= (x / 2) ** 2 / (k * (k + order))
    return total


__all__ = ["bessel_i", "combine", "dense_embedding", "gaussian", "inner", "l2_normalize", "orthonormal", "randomized_svd", "sigma_scale", "sparse_projection", "spmm", "spmm_sparse", "spmv", "times_small", "uniform"]
