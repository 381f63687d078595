"""Sources and sinks, weighted and directed graphs, dense steps, and properties that stand for results SQL can't repeat."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashes, random
from .operators import graph as g
from .operators import sequence as q
from .plans import linalg as la
from .queries import G1, G6, SEQ, amounts, part_supplier, parts, parts_together, query, t
from .sources import adjacency, compressed, edges as edge_files, vectors
from .staging import shared_dir


def _path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/file-{uuid.uuid4().hex}"


def _trade(spark: SparkSession, sf: str) -> DataFrame:
    """Directed and weighted: parts to their suppliers by orders, on one set of ids."""
    return t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count(F.lit(1)).alias("w"))


TRADE = "e as (select l_partkey as src, l_suppkey as dst, count(*) as w from lineitem group by 1, 2)"
EMB = "y as (select vec_id, unnest(range(1, len(embedding) + 1)) as k, unnest(embedding)::double as v from embeddings)"


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def _cells(x: DataFrame, digits: int = 5) -> DataFrame:
    return x.select(F.col("id").alias("vec_id"), F.posexplode("vec").alias("k", "v")).select("vec_id", (F.col("k") + 1).cast("long").alias("k"), (F.round("v", digits) + F.lit(0.0)).alias("v"))


@query(f"with {G6} select src, dst from e")
def adjacency_file(spark, sf):
    """A symmetric graph written as adjacency text and read again."""
    e, path = parts_together(spark, sf), _path(spark)
    adjacency.write_adjacency(e, e.agg(F.max("src")).first()[0] + 1, path)
    return adjacency.read_adjacency(spark, path)[0]


@query(f"with {TRADE} select src, dst, w from e")
def weighted_adjacency_file(spark, sf):
    """A directed and weighted graph written as adjacency text and read again."""
    e, path = _trade(spark, sf), _path(spark)
    adjacency.write_adjacency(e, e.agg(F.greatest(F.max("src"), F.max("dst"))).first()[0] + 1, path)
    return adjacency.read_adjacency(spark, path)[0]


@query(f"with {G6} select src, dst from e")
def compressed_file(spark, sf):
    """A symmetric graph in the plain byte code."""
    e, path = parts_together(spark, sf), _path(spark)
    compressed.write_compressed(e, e.agg(F.max("src")).first()[0] + 1, path)
    return compressed.read_compressed(spark, path)


@query(f"with {TRADE} select src, dst, w from e")
def weighted_compressed_file(spark, sf):
    """A directed and weighted graph in counted runs."""
    e, path = _trade(spark, sf), _path(spark)
    compressed.write_compressed(e, e.agg(F.greatest(F.max("src"), F.max("dst"))).first()[0] + 1, path, "counted", "int")
    return compressed.read_compressed(spark, path, "counted", "int")


@query(f"with {TRADE} select src, dst from e")
def incoming_compressed_file(spark, sf):
    """The arcs that come in, of a directed graph in runs."""
    e, path = _trade(spark, sf), _path(spark)
    compressed.write_compressed(e, e.agg(F.greatest(F.max("src"), F.max("dst"))).first()[0] + 1, path, "blocks", directed=True)
    return compressed.read_compressed(spark, path, "blocks", incoming=True)


@query(f"with {TRADE}, u as (select src, dst from e where src <> dst) select src, dst from u union select dst, src from u")
def edge_list_file(spark, sf):
    path = _path(spark)
    edge_files.write_edge_list(t(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), path)
    return edge_files.read_edge_list(spark, path, make_symmetric=True)[0]


@query("select doc_id as id, quality as label from labels where quality is not null")
def label_file(spark, sf):
    path = _path(spark)
    t(spark, sf, "labels").where("quality is not null").select("doc_id", "quality").write.csv(path, sep="\t")
    return edge_files.read_labels(spark, path).select("id", F.col("label").cast(t(spark, sf, "labels").schema["quality"].dataType).alias("label"))


@query(f"with {EMB} select vec_id, k, round(v, 5) + 0e0 as v from y")
def vector_text_file(spark, sf):
    path = _path(spark)
    _vectors(spark, sf).select(F.concat_ws(" ", F.col("id").cast("string"), F.transform("vec", lambda x: x.cast("string")))).write.text(path)
    return _cells(vectors.read_word2vec(spark, path))


@query(f"with {TRADE} select src, dst, w from e where not exists (select 1 from e x where x.src = e.dst and x.dst = e.src)")
def directed_asymmetric_arcs(spark, sf):
    return g.asymmetric_arcs(_trade(spark, sf))


@query(f"with {TRADE} select dst as src, src as dst, w from e")
def weighted_transpose(spark, sf):
    return g.transpose(_trade(spark, sf))


@query(f"with {TRADE} select src, dst, w from e where w > 1 and (src + dst) % 2 = 0")
def weighted_edge_filter(spark, sf):
    return g.filter_edges(_trade(spark, sf), (F.col("w") > 1) & ((F.col("src") + F.col("dst")) % 2 == 0))


@query(f"with {TRADE} select p_partkey as id, coalesce(sum(w), 0)::bigint as v from part left join e on dst = p_partkey where p_partkey % 3 = 0 group by 1")
def edge_reduce_dense(spark, sf):
    return g.edge_map_reduce_dense(_trade(spark, sf), parts(spark, sf), F.col("id") % 3 == 0, F.col("w"), 0)


@query(f"with {G6}, n as (select src, dst, row_number() over (partition by src order by dst) as n from e) select src, dst from n where n = 3")
def third_neighbour(spark, sf):
    return g.ith_neighbour(parts_together(spark, sf), 2)


@query(f"with {G6} select src, list_sort(list(dst)) as neighbours from e group by 1")
def csr_rows(spark, sf):
    return adjacency.csr_window(parts_together(spark, sf))


@query(f"with {G1}, h as (select src from (select src, count(*) as n from e group by 1) order by n desc, src limit 2) select dst as id from e where src in (select src from h) group by 1 having count(*) = 2")
def hubs_intersect(spark, sf):
    """What the two vertices of the most neighbours have in common."""
    e = part_supplier(spark, sf)
    a, b = (r["id"] for r in g.degrees(e).orderBy(F.desc("degree"), "id").limit(2).collect())
    near = lambda v: e.where(F.col("src") == v).select(F.col("dst").alias("id"))
    return near(a).intersect(near(b))


CC = f"with recursive {G6}, v as (select p_partkey as id from part), cc(id, component) using key (id) as (select distinct id, id from v union (select distinct on (u.id) u.id, x.component from recurring.cc u join e on e.src = u.id join cc x on x.id = e.dst where x.component < u.component order by u.id, x.component))"


@query(CC + " select id, component from cc")
def connected_components_whole(spark, sf):
    return g.components(parts_together(spark, sf), parts(spark, sf))


@query(CC + " select count(*) - count(distinct component) as arcs, 0 as foreign_arcs, count(distinct component) as components from cc")
def spanning_forest_properties(spark, sf):
    """A forest has as many edges as vertices less components, all of the graph, and the graph's components."""
    e = parts_together(spark, sf)
    f = g.spanning_forest(e, parts(spark, sf)).select("src", "dst")
    both = f.unionByName(g.transpose(f)).distinct()
    foreign = both.join(e.select(F.col("src").alias("_s"), F.col("dst").alias("_d")), (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_anti")
    return f.agg(F.count(F.lit(1)).alias("arcs")).crossJoin(foreign.agg(F.count(F.lit(1)).cast("int").alias("foreign_arcs"))).crossJoin(g.components(both, parts(spark, sf)).agg(F.countDistinct("component").alias("components")))


@query(f"with {G6} select 0 as shared_ends, 0 as missed from (select 1)")
def matching_properties(spark, sf):
    """No vertex is in two matched edges, and no edge could be added."""
    e = parts_together(spark, sf)
    m = g.maximal_matching(e)
    ends = m.select(F.col("src").alias("v")).unionByName(m.select(F.col("dst").alias("v"))).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    used = ends.select(F.col("v").alias("_v"))
    missed = e.join(used, F.col("src") == F.col("_v"), "left_anti").join(used, F.col("dst") == F.col("_v"), "left_anti")
    return ends.where("n > 1").agg(F.count(F.lit(1)).cast("int").alias("shared_ends")).crossJoin(missed.agg(F.count(F.lit(1)).cast("int").alias("missed")))


@query(f"with {G6} select count(*) as arcs, 0 as torn from e")
def split_properties(spark, sf):
    """Held-out arcs and the rest are the graph, and both arcs of an edge are on one side."""
    held, rest = g_split(parts_together(spark, sf))
    torn = held.join(rest.select(F.col("dst").alias("_s"), F.col("src").alias("_d")), (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_semi")
    return held.unionByName(rest).agg(F.count(F.lit(1)).alias("arcs")).crossJoin(torn.agg(F.count(F.lit(1)).cast("int").alias("torn")))


def g_split(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return edge_files.link_prediction_split(edges, 0.2, 7)


@query(f"with {SEQ} select count(*) as n, count(*) as places, sum(v)::bigint as total, sum(v * v)::bigint as squares from s")
def shuffle_properties(spark, sf):
    """A shuffle is a permutation: places 0 .. n - 1 once each, the same values."""
    s = q.shuffle(amounts(spark, sf), 3)
    return s.agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("idx") + F.min("idx") + F.max("idx") + 1 - F.count(F.lit(1))).alias("places"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"))


@query(f"with {SEQ} select (idx * 7 + 3) % (select count(*) from s) as idx, v from s")
def scatter(spark, sf):
    """Places are a permutation as 7 doesn't divide the length of any of the tables."""
    a = amounts(spark, sf)
    n = a.count()
    return q.scatter(a, spark.range(n).select(F.col("id").alias("idx"), ((F.col("id") * 7 + 3) % n).alias("v")))


@query(f"with {SEQ}, w as (select idx, v from s where idx in (100, 101)), m as (select max(a.idx) as idx from s a join s b on b.idx = a.idx + 1 where a.v = (select v from w where idx = 100) and b.v = (select v from w where idx = 101)) select coalesce(idx, (select count(*) from s)) as idx from m")
def find_end(spark, sf):
    a = amounts(spark, sf)
    needle = [r["v"] for r in a.where("idx in (100, 101)").orderBy("idx").collect()]
    return q.search(a, needle, last=True)


@query(f"with {SEQ} select min(case when v > w then false else true end) as sorted from (select v, lead(v) over (order by idx) as w from s)")
def is_sorted(spark, sf):
    return q.is_sorted(amounts(spark, sf))


@query(f"with {SEQ}, p as (select idx as q, v + 1 as v from s where idx % 97 = 0) select q, (select count(*) from s where s.v < p.v) as at from p")
def lower_bound(spark, sf):
    a = amounts(spark, sf)
    return q.lower_bound(a, a.where("idx % 97 = 0").select(F.col("idx").alias("q"), (F.col("v") + 1).alias("v")))


@query(f"with {SEQ} select min(idx) as idx, v from s group by v")
def remove_duplicates_ordered(spark, sf):
    return q.remove_duplicates_ordered(amounts(spark, sf))


@query("select event_type, count(*) as n from events group by 1 having count(*) >= 0.1 * (select count(*) from events)")
def heavy_hitters(spark, sf):
    return q.heavy_hitters(t(spark, sf, "events"), "event_type", 0.1)


@query("with a as (select l_partkey as key, count(*) as v from lineitem where l_quantity < 20 group by 1), b as (select l_partkey as key, count(*) as v from lineitem where l_quantity >= 40 group by 1) select coalesce(a.key, b.key) as key, case when a.key is null then b.v when b.key is null then a.v else a.v * 1000 + b.v end as v from a full join b on a.key = b.key")
def upsert_with_function(spark, sf):
    n = lambda test: t(spark, sf, "lineitem").where(test).groupBy(F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).alias("v"))
    return q.upsert(n("l_quantity < 20"), n("l_quantity >= 40"), lambda old, new: old * 1000 + new)


@query(f"with {SEQ} select sum(v)::bigint as first, sum(idx)::bigint as second, max(v * 1000000 + idx) as greatest from s")
def reduce_pairs(spark, sf):
    """A monoid on pairs, and one of the user's own."""
    return amounts(spark, sf).agg(F.sum("v").alias("first"), F.sum("idx").alias("second"), F.max(F.col("v") * 1000000 + F.col("idx")).alias("greatest"))


@query(f"with {EMB} select k, round(sum(v), 4) + 0e0 as v from y group by k")
def reduce_arrays(spark, sf):
    """Arrays added place by place."""
    cells = _vectors(spark, sf).select(F.posexplode("vec").alias("k", "v"))
    return cells.groupBy((F.col("k") + 1).cast("long").alias("k")).agg((F.round(F.sum("v"), 4) + F.lit(0.0)).alias("v"))


@query(f"with {SEQ} select idx, v::varchar as text, length(v::varchar)::int as size from s")
def number_text(spark, sf):
    return amounts(spark, sf).select("idx", F.col("v").cast("string").alias("text"), F.length(F.col("v").cast("string")).alias("size"))


@query(f"with {SEQ} select count(*) as n, count(*) as images, 0::bigint as outside from s")
def mixer_properties(spark, sf):
    """The 64-bit mixer is a bijection, and uniform numbers lie in [0, 1)."""
    u = random.uniform(3, "idx")
    return amounts(spark, sf).withColumn("h", hashes.hash64(F.col("idx"))).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("h").alias("images"), F.sum(F.when((u < 0) | (u >= 1), 1).otherwise(0)).alias("outside"))


@query(f"with {EMB} select vec_id, k, round(v * sqrt(100e0 / (k * k)), 5) + 0e0 as v from y where k <= 8")
def sigma_scale(spark, sf):
    import numpy as np

    width = len(t(spark, sf, "embeddings").first()["embedding"])
    return _cells(la.sigma_scale(_vectors(spark, sf), 100.0 / np.arange(1, width + 1) ** 2, 8))


@query(f"with {EMB}, z as (select vec_id, k, v, v * v as w from y) select vec_id, k, round(w - 2 * v - (v + w), 5) + 0e0 as v from z")
def chebyshev_step(spark, sf):
    """The next term of the recurrence from the two before it and the product."""
    x = _vectors(spark, sf)
    product = x.select("id", F.transform("vec", lambda a: a * a).alias("vec"))
    before = x.select("id", F.transform("vec", lambda a: a + a * a).alias("vec"))
    return _cells(la.combine([(1.0, product), (-2.0, x), (-1.0, before)]))


@query(f"with {EMB}, c as (select k, unnest(range(1, 5)) as c from (select distinct k from y)) select vec_id, c as k, round(sum(v * ((y.k * c) % 5 - 2)), 4) + 0e0 as v from y join c using (k) group by 1, 2")
def times_small(spark, sf):
    """A tall matrix times a small one."""
    import numpy as np

    width = len(t(spark, sf, "embeddings").first()["embedding"])
    small = (np.outer(np.arange(1, width + 1), np.arange(1, 5)) % 5 - 2).astype(float)
    return _cells(la.times_small(_vectors(spark, sf), small), 4)


@query("with a as (select i, x / 4e0 as x, unnest(range(0, 40)) as k from (select unnest(range(0, 6)) as i), (select unnest(range(1, 9)) as x)) select i, round(x, 2) as x, round(sum(pow(x / 2, 2 * k + i) / (gamma(k + 1) * gamma(k + i + 1))), 8) as v from a group by all")
def bessel(spark, sf):
    rows = [(i, x / 4, round(la.bessel_i(i, x / 4), 8)) for i in range(6) for x in range(1, 9)]
    return spark.createDataFrame(rows, "i long, x double, v double")


