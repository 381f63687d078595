"""The core operators applied to the shared tables, each with the same thing in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import strings
from .operators import graph as g
from .operators import sequence as q
from .plans import embedding as em
from .plans import evaluation as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Graphs: part and supplier (bipartite), parts ordered together in bulk, and event types by succession (directed).


def part_supplier(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "lineitem").select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")).distinct()
    return e.unionByName(g.transpose(e))


def parts_together(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem").where("l_quantity >= 40").select("l_orderkey", "l_partkey").distinct()
    a, b = li.select("l_orderkey", F.col("l_partkey").alias("src")), li.select(F.col("l_orderkey").alias("_o"), F.col("l_partkey").alias("dst"))
    return a.join(b, F.col("l_orderkey") == F.col("_o")).where("src <> dst").select("src", "dst").distinct()


def successions(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, sf, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"))


def amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Event values in cents, in the order of time."""
    ev_ = t(spark, sf, "events").select("ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    return q.indexed(ev_, "ts", "event_id").select("idx", "v")


def unordered_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """The same values for folds that need no order, so nothing is numbered."""
    return t(spark, sf, "events").select(F.round(F.col("value") * 100).cast("long").alias("v"))


G1 = "p as (select distinct 2 * l_partkey as a, 2 * l_suppkey + 1 as b from lineitem), e as (select a as src, b as dst from p union all select b, a from p)"
G6 = "li as (select distinct l_orderkey, l_partkey from lineitem where l_quantity >= 40), e as (select distinct x.l_partkey as src, y.l_partkey as dst from li x join li y using (l_orderkey) where x.l_partkey <> y.l_partkey)"
G4 = "n as (select event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events), e as (select src, dst, count(*) as w from n where dst is not null group by 1, 2)"
SEQ = "s as (select row_number() over (order by ts, event_id) - 1 as idx, cast(round(value * 100) as bigint) as v from events)"
DEG = "d as (select src as id, count(*) as degree from e group by 1)"
FRONT = "f as (select p_partkey as id from part where p_partkey % 10 = 1)"


def front(spark: SparkSession, sf: str) -> DataFrame:
    return parts(spark, sf).where("id % 10 = 1")


@query(f"with {G1}, {DEG}, r as (select dst as id, pow(sum(1.0 / degree), 0.75) as neg from e join d on id = src group by 1) select src, dst, round(ln(1.0 / degree) - ln(neg / (select sum(neg) from r)), 6) as v from e join d on d.id = src join r on r.id = dst")
def inverse_degree_log_matrix(spark, sf):
    return em.inverse_degree_log_matrix(part_supplier(spark, sf)).select(F.col("row").alias("src"), F.col("col").alias("dst"), F.round("v", 6).alias("v"))


@query(f"with {G6}, {DEG} select p_partkey as id, coalesce(degree, 0) as degree from part left join d on id = p_partkey")
def graph_degree(spark, sf):
    return g.degrees(parts_together(spark, sf), parts(spark, sf))


@query("with x as (select l_partkey as a, l_suppkey as b from lineitem where l_partkey <> l_suppkey) select a as src, b as dst from x union select b, a from x")
def graph_symmetrize(spark, sf):
    return g.symmetrize(t(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query(f"with {G4} select src, dst, w from e where src <> dst")
def graph_self_loop_drop(spark, sf):
    return g.filter_edges(successions(spark, sf), F.col("src") != F.col("dst"))


@query(f"with {G4} select dst as src, src as dst, w from e")
def graph_transpose(spark, sf):
    return g.transpose(successions(spark, sf))


@query(f"with {G4} select src, dst, w from e where not exists (select 1 from e x where x.src = e.dst and x.dst = e.src)")
def graph_asymmetric_arcs(spark, sf):
    return g.asymmetric_arcs(successions(spark, sf))


@query(f"with {G6}, m as (select id, row_number() over (order by id) - 1 as n from (select distinct src as id from e)) select a.n as src, b.n as dst from e join m a on a.id = src join m b on b.id = dst")
def graph_relabel(spark, sf):
    return g.relabel(parts_together(spark, sf))[0]


@query(f"with {G6}, {DEG}, v as (select p_partkey as id, coalesce(degree, 0) as degree from part left join d on id = p_partkey) select id, degree, cast(coalesce(sum(degree) over (order by id rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from v")
def csr_offsets(spark, sf):
    return g.csr_offsets(parts_together(spark, sf), parts(spark, sf))


@query(f"with {G6} select src, dst from e where (src + dst) % 3 = 0")
def edge_filter(spark, sf):
    return g.filter_edges(parts_together(spark, sf), (F.col("src") + F.col("dst")) % 3 == 0)


@query(f"with {G6} select src, dst from e where (src + dst) % 3 = 0")
def edge_filter3_keep(spark, sf):
    return g.filter_edges3(parts_together(spark, sf), (F.col("src") + F.col("dst")) % 3)[0]


@query(f"with {G6} select src, dst from e where (src + dst) % 3 = 2")
def edge_filter3_out(spark, sf):
    return g.filter_edges3(parts_together(spark, sf), (F.col("src") + F.col("dst")) % 3)[1]


@query()
def edge_sample(spark, sf):
    return g.sample_edges(parts_together(spark, sf), 0.25, 7)


@query(f"with {G6}, {FRONT}, k as (select src, dst from e where src not in (select id from f) or dst > src) select src as id, count(*) as degree from k group by 1")
def pack_edges_degree(spark, sf):
    return g.degrees(g.pack_edges(parts_together(spark, sf), front(spark, sf), F.col("dst") > F.col("src")))


@query(f"with {G6} select src, dst from (select *, row_number() over (partition by src order by dst) as n from e) where n <= 2")
def first_neighbours(spark, sf):
    return g.first_neighbours(parts_together(spark, sf), 2)


@query(f"with {G6}, {FRONT} select distinct dst as id from e join f on src = id where dst % 2 = 0")
def edge_map_one_hop(spark, sf):
    return g.edge_map(front(spark, sf), parts_together(spark, sf), cond=F.col("dst") % 2 == 0)


@query(f"with {G6}, {FRONT} select dst as id from e join f on src = id")
def edge_map_induced_bag(spark, sf):
    return g.edge_map(front(spark, sf), parts_together(spark, sf), distinct=False)


@query(f"with {G6}, {FRONT} select dst as id, count(*) as value from e join f on src = id group by 1")
def edge_map_count(spark, sf):
    return g.edge_map_count(front(spark, sf), parts_together(spark, sf))


@query(f"with {G6}, {FRONT} select dst as id, cast(sum(src) as bigint) as value from e join f on src = id where dst > 50 group by 1")
def edge_map_reduce_sum(spark, sf):
    return g.edge_map_reduce(front(spark, sf), parts_together(spark, sf), F.col("src"), "sum", F.col("dst") > 50)


@query(f"with {G6}, {FRONT} select dst as id, min(src * 7 % 101) as value from e join f on src = id group by 1")
def edge_map_reduce_min(spark, sf):
    return g.edge_map_reduce(front(spark, sf), parts_together(spark, sf), F.col("src") * 7 % 101, "min")


@query(f"with {G6}, {FRONT} select dst as id, min(src) as parent from e join f on src = id where dst not in (select id from f) group by 1")
def edge_map_dense_parent(spark, sf):
    return g.parents(front(spark, sf), parts_together(spark, sf), front(spark, sf))


@query(f"with {G6}, {FRONT} select f.id, count(dst) filter (where dst > src) as n from f left join e on src = f.id group by 1")
def edge_map_filter_count(spark, sf):
    return g.edge_map_filter(front(spark, sf), parts_together(spark, sf), F.col("dst") > F.col("src"))


@query("select p_partkey as id from part where p_size > 25")
def vertex_filter(spark, sf):
    return t(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"))


@query("select p_partkey as id, p_size * 2 + 1 as data from part")
def vertex_map(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 2 + 1).alias("data"))


@query("select p_partkey as id from part where p_size > 40 union select p_partkey from part where p_partkey % 10 = 1")
def frontier_union(spark, sf):
    return t(spark, sf, "part").where("p_size > 40").select(F.col("p_partkey").alias("id")).unionByName(front(spark, sf)).distinct()


@query(f"with recursive {G6}, r(id, level) as (select min(src), 0 from e union select e.dst, r.level + 1 from r join e on e.src = r.id where r.level < 30), l as (select id, min(level) as level from r group by 1) select l.id, cast(level as int) as level, (select min(e.src) from e join l p on p.id = e.src where e.dst = l.id and p.level = l.level - 1) as parent from l")
def bfs_levels(spark, sf):
    e = parts_together(spark, sf)
    return g.bfs(e, e.agg(F.min("src").alias("id")))


@query()
def connected_components(spark, sf):
    return g.components(parts_together(spark, sf), parts(spark, sf))


@query()
def spanning_forest(spark, sf):
    return g.spanning_forest(parts_together(spark, sf), parts(spark, sf))


@query(f"with {G6} select count(*) as n from e x join e y on y.src = x.dst and y.dst > y.src join e z on z.src = x.src and z.dst = y.dst where x.dst > x.src")
def triangle_count(spark, sf):
    return g.triangles(parts_together(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {G6} select x.src, x.dst, count(z.dst) as n from e x left join e y on y.src = x.src left join e z on z.src = x.dst and z.dst = y.dst where x.src < x.dst group by 1, 2")
def common_neighbors(spark, sf):
    return g.common_neighbours(parts_together(spark, sf))


@query()
def chain_removal(spark, sf):
    e = parts_together(spark, sf).where("src < dst or (src + dst) % 7 = 0")
    return g.remove_chains(e)


@query()
def k_core_numbers(spark, sf):
    return g.k_core_numbers(parts_together(spark, sf))


@query()
def maximal_matching(spark, sf):
    return g.maximal_matching(parts_together(spark, sf))


@query(f"with {G6}, {DEG} select id, degree from d where degree = (select max(degree) from d)")
def bucket_next_max(spark, sf):
    d = g.degrees(parts_together(spark, sf))
    return d.where(F.col("degree") == g.next_bucket(d, "degree", increasing=False))


@query(f"with {G6}, {DEG} select id, degree from d where degree = (select min(degree) from d)")
def bucket_next_min(spark, sf):
    d = g.degrees(parts_together(spark, sf))
    return d.where(F.col("degree") == g.next_bucket(d, "degree"))


@query("select p_partkey as id, case when p_partkey % 10 = 1 then 99 else p_size end as bucket from part where not (p_partkey % 10 = 1 and p_size > 40)")
def bucket_update(spark, sf):
    b = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("bucket"))
    return g.update_buckets(b, b.where("id % 10 = 1").select("id", F.expr("case when bucket > 40 then null else 99 end").alias("bucket")))


@query("select b as bucket, count(l_suppkey) as n from range(0, 256) x(b) left join lineitem on l_suppkey = b group by 1")
def histogram(spark, sf):
    return q.histogram(t(spark, sf, "lineitem"), "l_suppkey", 256)


@query("select b as k, cast(coalesce(sum(l_quantity), 0) as bigint) as total from range(0, 200) x(b) left join lineitem on l_suppkey = b group by 1")
def collect_reduce_dense(spark, sf):
    return q.collect_reduce(t(spark, sf, "lineitem"), "l_suppkey", F.col("l_quantity").cast("long"), 200)


@query("select l_partkey as k, cast(sum(l_quantity) as bigint) as total from lineitem group by 1")
def collect_reduce_sparse(spark, sf):
    return q.collect_reduce(t(spark, sf, "lineitem"), "l_partkey", F.col("l_quantity").cast("long"))


@query(f"with {SEQ} select cast(sum(v) as bigint) as total, max(v) as high, min(v) as low, bit_xor(v) as bits, cast(count(*) filter (where v > 5000) as bigint) as n, bool_and(v >= 0) as every, bool_or(v > 5000) as some, not bool_or(v < 0) as none from s")
def reduce_monoids(spark, sf):
    v = F.col("v")
    return unordered_amounts(spark, sf).agg(F.sum(v).alias("total"), F.max(v).alias("high"), F.min(v).alias("low"), F.bit_xor(v).alias("bits"), F.count_if(v > 5000).alias("n"), F.bool_and(v >= 0).alias("every"), F.bool_or(v > 5000).alias("some"), (~F.bool_or(v < 0)).alias("none"))


@query(f"with {SEQ} select idx, v, cast(coalesce(sum(v) over (order by idx rows between unbounded preceding and 1 preceding), 0) as bigint) as s from s")
def scan_exclusive(spark, sf):
    return q.scan(amounts(spark, sf))


@query(f"with {SEQ} select idx, v, max(v) over (order by idx rows unbounded preceding) as s from s")
def scan_inclusive(spark, sf):
    return q.scan(amounts(spark, sf), "max", inclusive=True)


@query(f"with {SEQ} select idx, v, min(v) over (order by idx desc rows unbounded preceding) as s from s")
def reverse_scan_min(spark, sf):
    return q.reverse_scan(amounts(spark, sf))


@query(f"with {SEQ} select idx from s where v % 7 = 0")
def pack_index(spark, sf):
    return q.pack_index(amounts(spark, sf), F.col("v") % 7 == 0)


@query(f"with {SEQ} select idx, v, row_number() over (order by idx) - 1 as at from s where v % 7 = 0")
def pack(spark, sf):
    return q.pack(amounts(spark, sf), F.col("v") % 7 == 0)


@query(f"with {SEQ} select idx, v, cast(v % 3 as int) as side, row_number() over (order by v % 3, idx) - 1 as at from s")
def split_three(spark, sf):
    return q.split_by(amounts(spark, sf), F.expr("cast(v % 3 as int)"))


@query(f"with {SEQ}, m as (select idx, v % 5 as v from s) select idx, v from (select *, lag(v) over (order by idx) as p from m) where p is null or p <> v")
def unique_adjacent(spark, sf):
    return q.unique_adjacent(amounts(spark, sf).select("idx", (F.col("v") % 5).alias("v")))


@query(f"with {SEQ}, m as (select idx, v % 50 as v, lead(v % 50) over (order by idx) as n from s) select coalesce(min(idx) filter (where v = n), max(idx)) as idx from m")
def adjacent_find(spark, sf):
    return q.adjacent_find(amounts(spark, sf).select("idx", (F.col("v") % 50).alias("v")))


@query(f"with {SEQ} select coalesce(min(idx) filter (where v > 9000), count(*)) as idx from s")
def find_if(spark, sf):
    return q.find_if(amounts(spark, sf), F.col("v") > 9000)


@query(f"with {SEQ} select min(idx) as idx from s where v % 100 in (select p_size from part)")
def find_first_of(spark, sf):
    return q.find_first_of(amounts(spark, sf).select("idx", (F.col("v") % 100).alias("v")), t(spark, sf, "part").select(F.col("p_size").cast("long").alias("v")))


@query(f"with {SEQ} select coalesce(min(idx) filter (where v % 1000 = 3), count(*)) as idx from s")
def mismatch(spark, sf):
    a = amounts(spark, sf)
    return q.mismatch(a, a.select("idx", F.expr("case when v % 1000 = 3 then -1 else v end").alias("v")))


@query("select true as equal, false as less")
def equal_and_compare(spark, sf):
    a = amounts(spark, sf)
    return q.equal(a, q.reverse(q.reverse(a))).crossJoin(F.broadcast(q.compare(a, a)))


@query(f"with {SEQ}, m as (select idx, v % 4 as v, lead(v % 4) over (order by idx) as a, lead(v % 4, 2) over (order by idx) as b from s) select coalesce(min(idx) filter (where v = 1 and a = 2 and b = 3), count(*)) as idx from m")
def search_subseq(spark, sf):
    return q.search(amounts(spark, sf).select("idx", (F.col("v") % 4).alias("v")), [1, 2, 3])


@query(f"with {SEQ} select arg_min(idx, (v, idx)) as min_idx, arg_min(idx, (-v, idx)) as max_idx from s")
def min_max_element_idx(spark, sf):
    return q.extremes(amounts(spark, sf))


@query(f"with {SEQ}, c as (select idx, v - 5000 as v from s), p as (select idx, cast(sum(v) over (order by idx) as bigint) as s from c) select greatest(0, max(s - least(0, coalesce(low, 0)))) as best from (select s, min(s) over (order by idx rows between unbounded preceding and 1 preceding) as low from p)")
def max_contiguous_sum(spark, sf):
    return q.max_subsequence(amounts(spark, sf).select("idx", (F.col("v") - 5000).alias("v")))


@query(f"with {SEQ}, n as (select count(*) as n from s), w as (select k as q, k * n // 80 as i, n - 1 - k * n // 80 as j from range(0, 40) x(k), n) select q, arg_min(idx, (v, idx)) as idx from w join s on idx between i and j group by 1")
def range_min_whole(spark, sf):
    """Windows over the whole sequence, the first of all of it."""
    a = amounts(spark, sf)
    n, k = F.lit(a.count()), F.col("id")
    return q.range_min(a, spark.range(40).select(k.alias("q"), F.floor(k * n / 80).alias("i"), (n - 1 - F.floor(k * n / 80)).alias("j")), 64)


@query(f"with {SEQ} select v from s order by v limit 1 offset 700")
def kth_smallest(spark, sf):
    return q.kth_smallest(unordered_amounts(spark, sf), 700)


@query()
def approximate_kth_smallest(spark, sf):
    return q.approximate_kth(unordered_amounts(spark, sf), 0.5)


@query("with a as (select c_custkey as v, 0 as side from customer), b as (select s_suppkey, 1 from supplier), u as (select * from a union all select * from b) select row_number() over (order by v, side) - 1 as idx, v, side from u")
def merge_sorted(spark, sf):
    a = q.indexed(t(spark, sf, "customer").select(F.col("c_custkey").alias("v")), "v")
    b = q.indexed(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("v")), "v")
    return q.merge_sorted(a, b)


@query(f"with {SEQ} select row_number() over (order by v % 100, idx) - 1 as idx, idx as was, v from s")
def stable_sort(spark, sf):
    a = amounts(spark, sf).select(F.col("idx").alias("was"), "v", (F.col("v") % 100).alias("k"))
    return q.indexed(a, "k", "was").select("idx", "was", "v")


@query("select distinct l_partkey as v from lineitem")
def remove_duplicates(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_partkey").alias("v")).distinct()


@query(f"with {G6} select a.dst as id from e a join e b using (dst) where a.src = (select min(src) from e) and b.src = (select max(src) from e)")
def set_intersect(spark, sf):
    e = parts_together(spark, sf)
    lo, hi = e.agg(F.min("src"), F.max("src")).first()
    return e.where(F.col("src") == lo).select(F.col("dst").alias("id")).intersect(e.where(F.col("src") == hi).select(F.col("dst").alias("id")))


@query(f"with {SEQ}, n as (select count(*) as n from s) select (n - 1 - idx + 17) % n as idx, v from s, n")
def rotate_reverse(spark, sf):
    return q.rotate(q.reverse(amounts(spark, sf)), 17)


@query(f"with {SEQ}, n as (select count(*) as n from s) select a.idx, b.v from s a join s b on b.idx = (a.idx * 7 + 3) % (select n from n)")
def gather(spark, sf):
    a = amounts(spark, sf)
    n = a.count()
    return q.gather(a, spark.range(n).select(F.col("id").alias("idx"), ((F.col("id") * 7 + 3) % n).alias("v")))


@query(f"with {SEQ} select idx, v from s union all select idx + (select count(*) from s), v from s")
def append_sequences(spark, sf):
    a = amounts(spark, sf)
    return q.append(a, a)


@query()
def shuffle(spark, sf):
    return q.shuffle(amounts(spark, sf), 3)


@query(f"with {G6}, {DEG} select p_partkey as row, coalesce(cast(sum(degree) as double), 0) as v from part left join e on src = p_partkey left join d on id = dst group by 1")
def sparse_matrix_vector(spark, sf):
    e = parts_together(spark, sf)
    x = g.degrees(e).select("id", F.col("degree").cast("double").alias("v"))
    return em.spmv(e.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("v")), x, parts(spark, sf))


@query(f"with {G6} select a.src as row, b.dst as col, cast(count(*) as double) as v from e a join e b on b.src = a.dst group by 1, 2")
def sparse_matrix_product(spark, sf):
    a = parts_together(spark, sf).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("v"))
    return em.spmm_sparse(a, a)


_WALK1 = f"with {G6}, {DEG}, m as (select count(*) as m from e) select src as row, dst as col, round(ln(m * 1.0 / x.degree / y.degree), 6) as v from e join d x on x.id = src join d y on y.id = dst, m"


@query(_WALK1)
def walk_matrix_1(spark, sf):
    return em.walk_matrix(parts_together(spark, sf), 1).select("row", "col", F.round(F.ln("v"), 6).alias("v"))


_WALK2 = f"{G6}, {DEG}, m as (select count(*) as m from e), p as (select src as row, dst as col, 1e0 / degree as v from e join d on id = src union all select a.src, b.dst, sum(1e0 / x.degree / y.degree) from e a join d x on x.id = a.src join e b on b.src = a.dst join d y on y.id = a.dst group by 1, 2), n as (select row, col, sum(p.v) / degree * m / 2e0 as v from p join d on id = col, m group by row, col, degree, m)"


@query(f"with {_WALK2} select row, col, round(ln(v), 6) as v from n")
def walk_matrix_2(spark, sf):
    return em.walk_matrix(parts_together(spark, sf), 2).select("row", "col", F.round(F.ln("v"), 6).alias("v"))


@query(f"with {_WALK2} select row, col, round(ln(v / 50e0), 6) as v from n where v / 50e0 > 1")
def trunc_log(spark, sf):
    return em.trunc_log(em.walk_matrix(parts_together(spark, sf), 2, negative=50)).select("row", "col", F.round("v", 6).alias("v"))


@query(f"with {G6}, {DEG}, n as (select ln(count(*)) as l from d) select src, dst, round(least(1e0, (1e0 / x.degree + 1e0 / y.degree) * l * 0.1e0), 6) as p from e join d x on x.id = src join d y on y.id = dst, n")
def downsample_probability(spark, sf):
    return em.downsample_probability(parts_together(spark, sf), factor=0.1).select("src", "dst", F.round("p", 6).alias("p"))


@query(f"with {G6}, {DEG} select src as row, dst as col, round(-1e0 / (degree + 1), 6) as v from e join d on id = src union all select p_partkey, p_partkey, round(1 - 0.2e0 - 1e0 / (coalesce(degree, 0) + 1), 6) from part left join d on id = p_partkey")
def modulated_laplacian(spark, sf):
    return em.modulated_laplacian(parts_together(spark, sf), parts(spark, sf)).select("row", "col", F.round("v", 6).alias("v"))


_E = "x as (select vec_id, label, unnest(range(1, 65)) as k, embedding from embeddings), y as (select vec_id, label, k, cast(embedding[k] as double) as v from x)"


@query(f"with {_E} select vec_id, k, round(v / sqrt(sum(v * v) over (partition by vec_id)), 5) + 0e0 as v from y")
def row_l2_normalize(spark, sf):
    e = em.l2_normalize(t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")))
    return e.select(F.col("id").alias("vec_id"), F.posexplode("vec").alias("k", "v")).select("vec_id", (F.col("k") + 1).cast("long").alias("k"), (F.round("v", 5) + F.lit(0.0)).alias("v"))


@query("with s as (select vec_id, unnest(range(1, 11)) as label, embedding from embeddings), r as (select vec_id, label, row_number() over (partition by vec_id order by embedding[label] desc, label desc) as n from s) select vec_id as id, label from r where n <= 1 + vec_id % 3")
def topk_label_indicator(spark, sf):
    e = t(spark, sf, "embeddings")
    scores = e.select(F.col("vec_id").alias("id"), F.posexplode(F.slice("embedding", 1, 10)).alias("k", "score")).select("id", (F.col("k") + 1).cast("long").alias("label"), "score")
    return ev.top_labels(scores, e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3 + 1).alias("n")))


_F1 = "with c as (select unnest([0, 1]) as label), r as (select label, count(*) filter (where quality = label and toxic = label) as tp, count(*) filter (where quality <> label and toxic = label) as fp, count(*) filter (where quality = label and toxic <> label) as fn from labels, c group by 1)"


@query(_F1 + " select round(ln(1 + 2e0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))), 6) as micro, round(ln(1 + avg(case when 2 * tp + fp + fn > 0 then 2e0 * tp / (2 * tp + fp + fn) else 0 end)), 6) as macro from r")
def f1_scores(spark, sf):
    x = t(spark, sf, "labels").where("quality is not null and toxic is not null")
    f1 = ev.f1(x.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), x.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")))
    return f1.select(F.round(F.ln(1 + F.col("micro")), 6).alias("micro"), F.round(F.ln(1 + F.col("macro")), 6).alias("macro"))


@query()
def evaluate_splits(spark, sf):
    """How well the embeddings tell their labels: half of them learn, three splits."""
    e = t(spark, sf, "embeddings")
    vec = F.col("embedding").cast("array<double>").alias("vec")
    return ev.evaluate_splits(e.select(F.col("vec_id").alias("id"), vec), e.select(F.col("vec_id").alias("id"), "label"), 0.5, 3)


@query(r"with w as (select unnest(string_split_regex(text, '[\r\t\n\x00 ]+')) as token from documents) select token, count(*) as n from w where token <> '' group by 1")
def tokens_wordcount(spark, sf):
    return strings.tokens(t(spark, sf, "documents"), "doc_id", "text").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _texts(spark, sf):
    return t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("s"))


@query()
def suffix_array(spark, sf):
    return strings.suffix_array(_texts(spark, sf))


@query()
def lcp_array(spark, sf):
    return strings.lcp_array(_texts(spark, sf))


@query()
def suffix_tree(spark, sf):
    return strings.suffix_tree(_texts(spark, sf))


@query("select doc_id as id, case when strpos(text, 'the') > 0 then strpos(text, 'the') - 1 end as at from documents")
def substring_find(spark, sf):
    return strings.find(t(spark, sf, "documents"), "doc_id", "text", "the")


@query()
def sampled_embedding(spark, sf):
    return em.embed(parts_together(spark, sf), walk_length=3, rank=16, dim=8, sample_ratio=0.5, seed=5).where("id is not null")


@query()
def spectral_embedding(spark, sf):
    e = parts_together(spark, sf)
    return em.spectral_propagation(e, em.embed(e, walk_length=2, rank=16, dim=8, sample_ratio=0.5, seed=5), order=4)


@query()
def sampled_walk_matrix(spark, sf):
    return em.sampled_walk_matrix(parts_together(spark, sf), walk_length=3, sample_ratio=0.5, seed=5)
