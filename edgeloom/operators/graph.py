"""Graphs as edges (src, dst[, w]) with both directions of an undirected edge, and vertices (id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Pile, drop_staged, staged


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge but loops, once each."""
    e = edges.where("src <> dst").select("src", "dst")
    return e.unionByName(transpose(e)).distinct()


def transpose(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def asymmetric_arcs(edges: DataFrame) -> DataFrame:
    """Arcs whose reverse is missing; empty for an undirected graph."""
    back = edges.select(F.col("dst").alias("_s"), F.col("src").alias("_d"))
    return edges.join(back, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_anti")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def degrees(edges: DataFrame, vtx: DataFrame | None = None) -> DataFrame:
    """(id, degree) by out-arcs; with vtx, isolated vertices have 0."""
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    if vtx is None:
        return d
    return vtx.select("id").join(d.withColumnRenamed("id", "_d"), F.col("id") == F.col("_d"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def relabel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with ids 0 .. n - 1 in the order of the old ids, idmap (old_id, new_id))."""
    from .sequence import indexed

    idmap = indexed(vertices(edges), "id").select(F.col("id").alias("old_id"), F.col("idx").alias("new_id"))
    return apply_idmap(edges, idmap), idmap


def apply_idmap(edges: DataFrame, idmap: DataFrame) -> DataFrame:
    a, b = (idmap.select(F.col("old_id").alias(f"_o{x}"), F.col("new_id").alias(f"_n{x}")) for x in "ab")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(a, F.col("src") == F.col("_oa")).join(b, F.col("dst") == F.col("_ob")).select(F.col("_na").alias("src"), F.col("_nb").alias("dst"), *rest)


def csr_offsets(edges: DataFrame, vtx: DataFrame) -> DataFrame:
    """(id, degree, offset): exclusive prefix sums of degrees in the order of ids."""
    from .sequence import indexed, scan

    d = indexed(degrees(edges, vtx), "id")
    s = scan(d.select("idx", F.col("degree").alias("v")), "sum").select(F.col("idx").alias("_i"), F.col("s").alias("offset"))
    return d.join(s, F.col("idx") == F.col("_i")).select("id", "degree", "offset")


def filter_edges(edges: DataFrame, keep: Column) -> DataFrame:
    return edges.where(keep)


def filter_edges3(edges: DataFrame, sort: Column) -> tuple[DataFrame, DataFrame]:
    """Arcs by class: 0 stay, 1 go, 2 go and are returned."""
    marked = edges.withColumn("_k", sort)
    return marked.where("_k = 0").drop("_k"), marked.where("_k = 2").drop("_k")


def sample_edges(edges: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Arcs drawn by a hash of their ends: the same whatever the partitions."""
    from ..functions.random import uniform

    return edges.where(uniform(seed, "src", "dst") < ratio)


def pack_edges(edges: DataFrame, frontier: DataFrame, keep: Column) -> DataFrame:
    """Arcs of frontier vertices that keep holds for, and all others' arcs."""
    f = frontier.select(F.col("id").alias("_f")).distinct()
    return edges.join(f, F.col("src") == F.col("_f"), "left").where(F.col("_f").isNull() | keep).drop("_f")


def first_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """The first k arcs of every vertex by target."""
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("_n") <= k).drop("_n")


def edge_map(frontier: DataFrame, edges: DataFrame, cond: Column | None = None, update: Column | None = None, distinct: bool = True) -> DataFrame:
    """Targets (id) of arcs out of the frontier for which cond (of dst) and update (of src, dst, w) hold; a set, or with distinct off a bag."""
    out = edges.join(frontier.select(F.col("id").alias("_f")), F.col("src") == F.col("_f"))
    for test in (cond, update):
        out = out if test is None else out.where(test)
    out = out.select(F.col("dst").alias("id"))
    return out.distinct() if distinct else out


def edge_map_reduce(frontier: DataFrame, edges: DataFrame, value: Column, how: str = "sum", cond: Column | None = None) -> DataFrame:
    """(id, value): value of src, dst, w and the frontier's columns folded over the frontier's arcs into each target."""
    f = frontier.select(*[F.col(c).alias(f"f_{c}") for c in frontier.columns])
    out = edges.join(f, F.col("src") == F.col("f_id"))
    out = out if cond is None else out.where(cond)
    return out.groupBy(F.col("dst").alias("id")).agg(getattr(F, how)(value).alias("value"))


def edge_map_count(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    return edge_map_reduce(frontier, edges, F.lit(1), "count")


def edge_map_filter(frontier: DataFrame, edges: DataFrame, test: Column) -> DataFrame:
    """(id, n): for every frontier vertex the number of its arcs that pass, 0 included."""
    n = edges.join(frontier.select(F.col("id").alias("_f")), F.col("src") == F.col("_f"), "left_semi").groupBy(F.col("src").alias("_s")).agg(F.count_if(test).alias("n"))
    return frontier.select("id").join(n, F.col("id") == F.col("_s"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def parents(frontier: DataFrame, edges: DataFrame, visited: DataFrame) -> DataFrame:
    """(id, parent): unvisited targets with their least source in the frontier."""
    out = edge_map_reduce(frontier, edges, F.col("src"), "min")
    return out.join(visited.select(F.col("id").alias("_v")), F.col("id") == F.col("_v"), "left_anti").withColumnRenamed("value", "parent")


def bfs(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, level, parent) of every vertex reached; a table a level, so lineage stays short."""
    edges = staged(edges.select("src", "dst"))
    front = staged(sources.select("id", F.lit(0).alias("level"), F.lit(None).cast(edges.schema["src"].dataType).alias("parent")))
    seen, level = Pile(front), 0
    while not front.isEmpty():
        level += 1
        front = staged(parents(front.select("id"), edges, seen.all()).select("id", F.lit(level).alias("level"), "parent"))
        seen.add(front)
    drop_staged(edges)
    return seen.all()


def _order(node: str, turn: int) -> Column:
    """The order of a round: ids themselves in rounds 0, 1, 3, 5 ..., which end stars at once; else by a hash that changes with the round."""
    plain = turn == 0 or turn % 2 == 1
    return F.struct((F.lit(0).cast("long") if plain else F.xxhash64(F.lit(turn), F.col(node))).alias("rank"), F.col(node).alias("id"))


def contract(edges: DataFrame) -> DataFrame:
    """(node, component) for both ends of every edge but loops. Each round every node goes into the least of itself and its
    neighbours; edges between merged nodes go on to the next. By a hashed order a quarter of the nodes with edges is
    expected to go, whatever the shape and the ids, so rounds are logarithmic, also on a long path with shuffled ids.
    """
    low, high = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    left, steps = staged(edges.where("src <> dst").select(low, high).distinct()), []
    while not left.isEmpty():
        turn = len(steps)
        ends = left.select(F.col("src").alias("node"), _order("dst", turn).alias("to")).unionByName(left.select(F.col("dst").alias("node"), _order("src", turn).alias("to")))
        steps.append(staged(ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("to", _order("node", turn))["id"].alias("into"))))
        a, b = (steps[-1].select(F.col("node").alias(f"_{x}"), F.col("into").alias(f"_to_{x}")) for x in "ab")
        merged = left.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).select(F.col("_to_a").alias("src"), F.col("_to_b").alias("dst"))
        rest = staged(merged.where("src <> dst").select(low, high).distinct())
        drop_staged(left)
        left = rest
    if not steps:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    drop_staged(left)
    top = steps.pop()
    while steps:
        step = steps.pop()
        further = top.select(F.col("node").alias("_via"), F.col("into").alias("_top"))
        whole = staged(step.join(further, F.col("into") == F.col("_via"), "left").select("node", F.coalesce("_top", "into").alias("into")))
        drop_staged(step, top)
        top = whole
    names = top.groupBy(F.col("into").alias("_into")).agg(F.min(F.least("node", "into")).alias("component"))
    out = staged(top.join(names, F.col("into") == F.col("_into")).select("node", "component"))
    drop_staged(top)
    return out


def components(edges: DataFrame, vtx: DataFrame) -> DataFrame:
    """(id, component): the least id of each connected component, an isolated vertex its own."""
    tied = contract(edges)
    out = staged(vtx.select("id").join(tied, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component")))
    drop_staged(tied)
    return out


def spanning_forest(edges: DataFrame, vtx: DataFrame) -> DataFrame:
    """(src, dst) with src < dst: in each round every component takes its least arc to another one (by (src, dst)); the components that these arcs join then merge."""
    ordered = staged(edges.where("src < dst").select("src", "dst").distinct())
    labels, forest = staged(vtx.select("id", F.col("id").alias("component"))), Pile(ordered.limit(0))
    while True:
        a, b = (labels.select(F.col("id").alias(f"_{x}"), F.col("component").alias(f"c{x}")) for x in "ab")
        cross = staged(ordered.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).where("ca <> cb").select(F.struct("src", "dst", "ca", "cb").alias("e")))
        drop_staged(ordered)
        ends = cross.select(F.col("e.ca").alias("c"), "e").unionByName(cross.select(F.col("e.cb").alias("c"), "e"))
        taken = staged(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        if taken.isEmpty():
            drop_staged(labels, cross)
            return forest.all()
        forest.add(staged(taken.select("src", "dst")))
        merged = contract(taken.select(F.col("ca").alias("src"), F.col("cb").alias("dst"))).select(F.col("node").alias("_c"), F.col("component").alias("into"))
        further = staged(labels.join(merged, F.col("component") == F.col("_c"), "left").select("id", F.coalesce("into", "component").alias("component")))
        ordered = staged(cross.select("e.src", "e.dst"))
        drop_staged(labels, cross, taken)
        labels = further


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c. Arcs point from the lower to the higher (degree, id), so a hub has few out-arcs and the wedge join stays small."""
    d = degrees(edges)
    a, b = (d.select(F.col("id").alias(f"_{x}"), F.col("degree").alias(f"d{x}")) for x in "ab")
    up = edges.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).where("da < db or (da = db and src < dst)").select("src", "dst")
    left, right = up.select("src", F.col("dst").alias("x")), up.select(F.col("src").alias("s2"), F.col("dst").alias("y"))
    wedge = left.join(right, F.col("x") == F.col("s2")).select("src", "x", "y")
    close = up.select(F.col("src").alias("_s"), F.col("dst").alias("_y"))
    found = wedge.join(close, (F.col("src") == F.col("_s")) & (F.col("y") == F.col("_y")), "left_semi")
    three = F.sort_array(F.array("src", "x", "y"))
    return found.select(three[0].alias("a"), three[1].alias("b"), three[2].alias("c"))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(src, dst, n) with src < dst for adjacent pairs: how many neighbours they share, 0 included."""
    t = triangles(edges)
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    each = t.select(F.explode(F.array(*[F.struct(F.col(x).alias("s"), F.col(y).alias("d")) for x, y in pairs])).alias("p")).groupBy("p.s", "p.d").agg(F.count(F.lit(1)).alias("n"))
    e = edges.where("src < dst")
    return e.join(each, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")), "left").select("src", "dst", F.coalesce("n", F.lit(0)).alias("n"))


def remove_chains(edges: DataFrame) -> DataFrame:
    """The arcs left after vertices without in-arcs or without out-arcs have gone, again and again; a round takes one vertex off each end of a chain."""
    left, n = staged(edges), -1
    while (m := left.count()) != n:
        n = m
        has_in, has_out = left.select(F.col("dst").alias("_v")).distinct(), left.select(F.col("src").alias("_v")).distinct()
        rest = staged(left.join(has_in, F.col("src") == F.col("_v"), "left_semi").join(has_out, F.col("dst") == F.col("_v"), "left_semi"))
        drop_staged(left)
        left = rest
    return left


def k_core_numbers(edges: DataFrame) -> DataFrame:
    """(id, core): peel by buckets: the least degree left sets the level, and all at or below it go."""
    left, level = staged(edges.select("src", "dst")), 0
    alive = staged(vertices(left))
    out = Pile(alive.select("id", F.lit(0).alias("core")).limit(0))
    while not alive.isEmpty():
        d = staged(degrees(left, alive))
        level = max(level, next_bucket(d, "degree"))
        out.add(staged(d.where(F.col("degree") <= level).select("id", F.lit(level).alias("core"))))
        stay = staged(d.where(F.col("degree") > level).select("id"))
        a = stay.select(F.col("id").alias("_k"))
        rest = staged(left.join(a, F.col("src") == F.col("_k"), "left_semi").join(a, F.col("dst") == F.col("_k"), "left_semi"))
        drop_staged(d, alive, left)
        alive, left = stay, rest
    drop_staged(left)
    return out.all()


def edge_map_reduce_dense(edges: DataFrame, vtx: DataFrame, cond: Column, value: Column, zero) -> DataFrame:
    """(id, v): for every vertex that meets cond the sum of value over all its in-arcs, zero without any; arcs into others don't reach the shuffle of sums."""
    wanted = vtx.where(cond).select("id")
    sums = edges.join(wanted.select(F.col("id").alias("_w")), F.col("dst") == F.col("_w"), "left_semi").groupBy(F.col("dst").alias("_d")).agg(F.sum(value).alias("_v"))
    return wanted.join(sums, F.col("id") == F.col("_d"), "left").select("id", F.coalesce("_v", F.lit(zero)).alias("v"))


def ith_neighbour(edges: DataFrame, i: int) -> DataFrame:
    """(src, dst): the out-neighbour at place i of every vertex that has so many, in the order of ids."""
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("_n") == i + 1).select("src", "dst")


def next_bucket(buckets: DataFrame, name: str = "bucket", increasing: bool = True) -> int:
    """The next non-empty bucket."""
    return buckets.agg(F.min(name) if increasing else F.max(name)).first()[0]


def update_buckets(buckets: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, bucket) with the changed ids moved; a null bucket takes an id out."""
    c = changes.select(F.col("id").alias("_c"), F.col("bucket").alias("_b"))
    moved = buckets.join(c, F.col("id") == F.col("_c"), "left")
    return moved.where("_c is null or _b is not null").select("id", F.coalesce("_b", "bucket").alias("bucket"))


def maximal_matching(edges: DataFrame, seed: int = 1) -> DataFrame:
    """Speculative rounds of reserve and commit: every arc bids for both ends, the least bid that wins both is taken.

    Bids are ordered by a hash, so the rounds are logarithmic as expected also on a path whose ids rise.
    """
    left = staged(edges.where("src < dst").select("src", "dst").distinct())
    out = Pile(left.limit(0))
    while not left.isEmpty():
        bid = F.struct(F.xxhash64(F.lit(seed), "src", "dst").alias("rank"), "src", "dst").alias("e")
        ends = left.select(F.col("src").alias("v"), bid).unionByName(left.select(F.col("dst").alias("v"), bid))
        won = staged(ends.groupBy("v").agg(F.min("e").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("e.src", "e.dst"))
        used = won.select(F.col("src").alias("_u")).unionByName(won.select(F.col("dst").alias("_u")))
        rest = staged(left.join(used, F.col("src") == F.col("_u"), "left_anti").join(used, F.col("dst") == F.col("_u"), "left_anti"))
        out.add(won)
        drop_staged(left)
        left = rest
    drop_staged(left)
    return out.all()
