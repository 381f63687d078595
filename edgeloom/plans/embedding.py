"""Network embedding: random-walk matrices, sampled or exact, their logarithms, factorisation and spectral smoothing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import below, uniform
from ..operators.graph import degrees, vertices
from ..staging import drop_staged, staged
from .linalg import bessel_i, combine, dense_embedding, l2_normalize, randomized_svd, sigma_scale, spmm, spmm_sparse, spmv

__all__ = ["downsample_probability", "embed", "inverse_degree_log_matrix", "l2_normalize", "modulated_laplacian", "sampled_walk_matrix", "spectral_propagation", "spmm", "spmm_sparse", "spmv", "trunc_log", "walk_matrix"]


def _with_degrees(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    a, b = (d.select(F.col("id").alias(f"_{x}"), F.col("degree").cast("double").alias(f"d_{x}")) for x in ("src", "dst"))
    return edges.join(a, F.col("src") == F.col("_src")).join(b, F.col("dst") == F.col("_dst")).drop("_src", "_dst")


def inverse_degree_log_matrix(edges: DataFrame) -> DataFrame:
    """(row, col, v) on the arcs: ln(1 / d_row) less the log share of col's noise, the 3/4 power of its neighbours' inverse degrees."""
    base = staged(edges.select("src", "dst"))
    d = degrees(base).select(F.col("id").alias("_src"), F.col("degree").cast("double").alias("d_src"))
    e = staged(base.join(d, F.col("src") == F.col("_src")).drop("_src"))
    drop_staged(base)
    noise = staged(e.groupBy(F.col("dst").alias("_j")).agg(F.pow(F.sum(1 / F.col("d_src")), F.lit(0.75)).alias("noise")))
    total = noise.agg(F.sum("noise")).first()[0] or 1.0
    return e.join(noise, F.col("dst") == F.col("_j")).select(F.col("src").alias("row"), F.col("dst").alias("col"), (F.ln(1 / F.col("d_src")) - F.ln(F.col("noise") / total)).alias("v"))


def walk_matrix(edges: DataFrame, length: int, negative: float = 1.0) -> DataFrame:
    """(row, col, v): m / (negative * length) times the sum over r of P^r / degree of col, exactly, by sparse products."""
    edges = staged(edges.select("src", "dst"))
    d = degrees(edges)
    step = edges.join(d, F.col("src") == F.col("id")).select(F.col("src").alias("row"), F.col("dst").alias("col"), (F.lit(1.0) / F.col("degree")).alias("v"))
    power = total = step
    for _ in range(length - 1):
        power = staged(spmm_sparse(power, step))
        total = total.unionByName(power)
    m = edges.count()
    out = total.groupBy("row", "col").agg(F.sum("v").alias("s")).join(d, F.col("col") == F.col("id"))
    return out.select("row", "col", (F.col("s") / F.col("degree") * m / float(negative * length)).alias("v"))


def trunc_log(matrix: DataFrame) -> DataFrame:
    """Natural logarithms, kept where positive."""
    return matrix.where("v > 1").withColumn("v", F.ln("v"))


def downsample_probability(edges: DataFrame, factor: float = 1.0) -> DataFrame:
    """(src, dst, p): the chance that an arc's draw is kept, (1 / d_src + 1 / d_dst) * ln n * factor, at most 1."""
    edges = staged(edges.select("src", "dst"))
    n = vertices(edges).count()
    return _with_degrees(edges).select("src", "dst", F.least(F.lit(1.0), (1 / F.col("d_src") + 1 / F.col("d_dst")) * (math.log(max(n, 1)) * factor)).alias("p"))


def _neighbours(edges: DataFrame) -> DataFrame:
    """(src, rank, dst, dst_degree): one row an arc, so a hub's neighbours are as many rows and never one array."""
    d = degrees(edges).select(F.col("id").alias("_d"), F.col("degree").alias("dst_degree"))
    ranked = edges.select("src", "dst", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("long").alias("rank"))
    return staged(ranked.join(d, F.col("dst") == F.col("_d")).drop("_d"))


def sampled_pairs(edges: DataFrame, walk_length: int, sample_ratio: float, seed: int, downsample: bool = True, weights: list[float] | None = None) -> DataFrame:
    """(x, z, w) with x <= z: ends of sampled paths and their summed weights.

    Every arc gets walk_length * n * ln n * sample_ratio / m draws (the fraction by a coin); a draw survives with the
    arc's probability and then weighs its inverse; it picks a length r and a place k, and walks k - 1 steps from one end
    and r - k from the other. A step joins on (vertex, neighbour's rank), which spreads hubs. All choices are hashes of
    (seed, arc, draw, step).
    """
    n, m = vertices(edges).count(), edges.count()
    expected = walk_length * n * math.log(max(n, 1)) * sample_ratio / max(m, 1)
    whole, part = int(expected), expected - int(expected)
    arcs = downsample_probability(edges) if downsample else edges.select("src", "dst", F.lit(1.0).alias("p"))
    d = degrees(edges)
    a, b = (d.select(F.col("id").alias(f"_{x}"), F.col("degree").alias(f"deg_{x}")) for x in "xz")
    count = F.lit(whole) + F.when(uniform(seed, "src", "dst") < part, 1).otherwise(0)
    draws = arcs.join(a, F.col("src") == F.col("_x")).join(b, F.col("dst") == F.col("_z")).drop("_x", "_z").where(count > 0).withColumn("draw", F.explode(F.sequence(F.lit(1), count)))
    draws = draws.where(uniform(seed + 1, "src", "dst", "draw") < F.col("p"))
    if weights is None:
        r = below(F.lit(walk_length), seed + 2, "src", "dst", "draw") + 1
    else:
        if len(weights) != walk_length:
            raise ValueError(f"{len(weights)} weights for lengths up to {walk_length}")
        u, total, upto, r = uniform(seed + 2, "src", "dst", "draw"), sum(weights), 0.0, F.lit(walk_length)
        for k in range(walk_length - 1, 0, -1):
            upto = sum(weights[:k]) / total
            r = F.when(u < upto, F.lit(k)).otherwise(r)
    draws = draws.withColumn("r", r.cast("long"))
    draws = draws.withColumn("left_x", below(F.col("r"), seed + 3, "src", "dst", "draw")).withColumn("left_z", F.col("r") - 1 - F.col("left_x"))
    walk = draws.select("src", "dst", "draw", (1 / F.col("p")).alias("w"), F.col("src").alias("x"), F.col("dst").alias("z"), "deg_x", "deg_z", "left_x", "left_z")
    hops = _neighbours(edges).select(F.col("src").alias("_s"), F.col("rank").alias("_r"), F.col("dst").alias("_t"), F.col("dst_degree").alias("_dd"))
    for step in range(walk_length - 1):
        for side, salt in (("x", 10), ("z", 1000)):
            pick = F.when(F.col(f"left_{side}") > step, below(F.col(f"deg_{side}"), seed + salt + step, "src", "dst", "draw"))
            walk = walk.withColumn("_pick", pick).join(hops, (F.col(side) == F.col("_s")) & (F.col("_pick") == F.col("_r")), "left")
            walk = walk.withColumn(side, F.coalesce("_t", side)).withColumn(f"deg_{side}", F.coalesce("_dd", f"deg_{side}")).drop("_pick", "_s", "_r", "_t", "_dd")
        if step % 2:
            walk = staged(walk)
    return walk.groupBy(F.least("x", "z").alias("x"), F.greatest("x", "z").alias("z")).agg(F.sum("w").alias("w"))


def sampled_walk_matrix(edges: DataFrame, walk_length: int = 10, sample_ratio: float = 1.0, negative: float = 1.0, seed: int = 1, downsample: bool = True) -> DataFrame:
    """(row, col, v): an unbiased estimate of walk_matrix, both triangles. No draws give an empty matrix."""
    pairs = staged(sampled_pairs(edges, walk_length, sample_ratio, seed, downsample))
    m, total = edges.count(), pairs.agg(F.sum("w")).first()[0]
    d = degrees(edges)
    a, b = (d.select(F.col("id").alias(f"_{x}"), F.col("degree").alias(f"d{x}")) for x in "xz")
    scale = m * m / total / 2 / negative if total else 0.0
    v = F.when(F.col("x") == F.col("z"), 2 * F.col("w")).otherwise(F.col("w")) * scale / F.col("dx") / F.col("dz")
    half = pairs.join(a, F.col("x") == F.col("_x")).join(b, F.col("z") == F.col("_z")).select(F.col("x").alias("row"), F.col("z").alias("col"), v.alias("v"))
    return half.unionByName(half.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), "v"))


def embed(edges: DataFrame, walk_length: int = 10, rank: int = 256, dim: int = 128, sample_ratio: float = 1.0, negative: float = 1.0, seed: int = 1, downsample: bool = True, normalize: bool = False, sparse: float | None = None, project_only: bool = False, method: str = "walks") -> DataFrame:
    """(id, vec): factors of the truncated log of the sampled walk matrix, or with method 'arcs' of the inverse-degree log matrix."""
    ids = vertices(edges)
    if method == "arcs":
        matrix, normalize = inverse_degree_log_matrix(edges), True
    else:
        matrix = trunc_log(sampled_walk_matrix(edges, walk_length, sample_ratio, negative, seed, downsample))
    u, s = randomized_svd(staged(matrix), ids, rank, sparse=sparse, project_only=project_only)
    return sigma_scale(u, s, dim, normalize)


def modulated_laplacian(edges: DataFrame, vtx: DataFrame, mu: float = 0.2) -> DataFrame:
    """(row, col, v): with d a degree plus 1, 1 - mu - 1 / d on the diagonal and -1 / d on arcs."""
    d = degrees(edges, vtx).select("id", (F.lit(1.0) / (F.col("degree") + 1)).alias("share"))
    off = edges.join(d, F.col("src") == F.col("id")).select(F.col("src").alias("row"), F.col("dst").alias("col"), (-F.col("share")).alias("v"))
    return off.unionByName(d.select(F.col("id").alias("row"), F.col("id").alias("col"), (1 - F.lit(mu) - F.col("share")).alias("v")))


def spectral_propagation(edges: DataFrame, emb: DataFrame, order: int = 10, mu: float = 0.2, s: float = 0.5) -> DataFrame:
    """(id, vec): emb smoothed by a Chebyshev filter of the modulated Laplacian, passed once over (A + I), and factored anew."""
    ids = emb.select("id")
    dim = len(emb.first()["vec"])
    lap = staged(modulated_laplacian(edges, ids, mu))
    twice = lambda x: spmm(lap, staged(spmm(lap, x, ids, dim)), ids, dim)
    emb = staged(emb)
    if order > 1:
        low, high = emb, staged(combine([(0.5, twice(emb)), (-1.0, emb)]))
        parts = [(bessel_i(0, s), low), (-2 * bessel_i(1, s), high)]
        for i in range(2, order):
            low, high = high, staged(combine([(1.0, twice(high)), (-2.0, high), (-1.0, low)]))
            parts.append(((-1) ** i * 2 * bessel_i(i, s), high))
        smooth = staged(combine([(1.0, emb), *((-w, x) for w, x in parts)]))
    else:
        smooth = emb
    loops = ids.select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("v"))
    near = edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("v")).unionByName(loops)
    return dense_embedding(staged(spmm(near, smooth, ids, dim)), dim)
