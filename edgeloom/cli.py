"""python -m edgeloom.cli EDGES OUT: embed the graph of an edge list or adjacency file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.embedding import embed, spectral_propagation
from .sources.adjacency import read_adjacency
from .sources.edges import read_edge_list


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("edges")
    p.add_argument("out", help="Parquet folder for (id, vec)")
    p.add_argument("--adjacency", action="store_true", help="EDGES is an adjacency text file")
    p.add_argument("--method", choices=("walks", "arcs"), default="walks")
    for name, kind, default in (("walklen", int, 10), ("rank", int, 256), ("dim", int, 128), ("order", int, 10), ("negative", float, 1.0), ("sample_ratio", float, 1.0), ("seed", int, 1)):
        p.add_argument(f"--{name}", type=kind, default=default)
    for name in ("sample", "normalize", "random_project_only", "sparse_project", "propagate"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--sparse_project_s", type=float, default=100.0)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("edgeloom").getOrCreate()
    edges = read_adjacency(spark, a.edges)[0] if a.adjacency else read_edge_list(spark, a.edges, make_symmetric=True)[0]
    out = embed(edges, a.walklen, a.rank, a.dim, a.sample_ratio, a.negative, a.seed, a.sample, a.normalize, a.sparse_project_s if a.sparse_project else None, a.random_project_only, a.method)
    (spectral_propagation(edges, out, a.order) if a.propagate else out).write.parquet(a.out)


if __name__ == "__main__":
    main()
