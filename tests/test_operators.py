import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from edgeloom import queries
from edgeloom.functions import strings
from edgeloom.operators import graph as g
from edgeloom.operators import sequence as q
from edgeloom.plans import embedding as em
from edgeloom.plans import evaluation as ev
from edgeloom.plans import linalg as la

#: A path on eleven vertices without two of its edges and with two others.
PATH = [(k, k + 1) for k in range(10) if k not in (1, 2)] + [(0, 10), (1, 10)]


def both(spark, pairs):
    return spark.createDataFrame([*pairs, *((b, a) for a, b in pairs)], "src long, dst long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_degrees_of_the_broken_path(spark):
    d = dict(rows(g.degrees(both(spark, PATH), spark.range(11))))
    assert [d[k] for k in range(11)] == [2, 2, 0, 1, 2, 2, 2, 2, 2, 2, 3]
    offsets = [r["offset"] for r in g.csr_offsets(both(spark, PATH), spark.range(11)).orderBy("id").collect()]
    assert offsets == [0, 2, 4, 4, 5, 7, 9, 11, 13, 15, 17]


def test_components_with_an_isolated_vertex(spark):
    found = dict(rows(g.components(both(spark, [(0, 1), (1, 2), (5, 6)]), spark.range(8))))
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}


def test_spanning_forest_has_one_edge_less_than_each_component(spark):
    e = both(spark, [(0, 1), (1, 2), (0, 2), (5, 6), (6, 7), (5, 7), (2, 3)])
    f = g.spanning_forest(e, spark.range(8))
    assert f.count() == 5
    assert rows(g.components(f.unionByName(g.transpose(f)), spark.range(8))) == rows(g.components(e, spark.range(8)))


def test_bfs_and_triangles_and_cores(spark):
    e = both(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4)])
    levels = {r["id"]: (r["level"], r["parent"]) for r in g.bfs(e, spark.createDataFrame([(4,)], "id long")).collect()}
    assert levels == {4: (0, None), 3: (1, 4), 2: (2, 3), 0: (3, 2), 1: (3, 2)}
    assert rows(g.triangles(e)) == [(0, 1, 2)]
    assert dict(rows(g.k_core_numbers(e))) == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1}


def test_loops_end_on_long_paths_in_any_order(spark):
    ids = list(range(300))
    random.Random(7).shuffle(ids)
    e = both(spark, list(itertools.pairwise(ids)))
    assert rows(g.components(e, spark.range(301))) == [*((k, 0) for k in range(300)), (300, 300)]
    f = {frozenset(r) for r in rows(g.spanning_forest(e, spark.range(301)))}
    assert f == {frozenset(p) for p in itertools.pairwise(ids)}
    used = [v for r in rows(g.maximal_matching(both(spark, [(k, k + 1) for k in range(300)]))) for v in r]
    assert len(used) == len({*used}) and all(k in used or k + 1 in used for k in range(300))
    levels = {r["id"]: (r["level"], r["parent"]) for r in g.bfs(both(spark, list(itertools.pairwise(ids[:20]))), spark.createDataFrame([(ids[0],)], "id long")).collect()}
    assert levels == {v: (k, ids[k - 1] if k else None) for k, v in enumerate(ids[:20])}
    assert dict(rows(g.k_core_numbers(both(spark, list(itertools.pairwise(ids[:24])))))) == dict.fromkeys(ids[:24], 1)
    none = both(spark, [])
    assert rows(g.components(none, spark.range(2))) == [(0, 0), (1, 1)] and rows(g.spanning_forest(none, spark.range(2))) == []
    assert rows(g.k_core_numbers(none)) == rows(g.maximal_matching(none)) == rows(g.remove_chains(none)) == []


def test_chains_leave_cycles_and_what_lies_between(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (9, 8)], "src long, dst long")
    assert rows(g.remove_chains(e)) == [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)]


def test_matching_is_maximal(spark):
    e = both(spark, PATH)
    used = [v for r in g.maximal_matching(e).collect() for v in r]
    assert len(used) == len({*used})
    assert all(a in used or b in used for a, b in PATH)


def test_blocks_of_scans_agree_with_one_pass(spark, monkeypatch):
    monkeypatch.setattr(q, "BLOCK", 7)
    rng = random.Random(3)
    v = [rng.randrange(-50, 50) for _ in range(100)]
    s = spark.createDataFrame(list(enumerate(v)), "idx long, v long")
    assert [r["s"] for r in q.scan(s).orderBy("idx").collect()] == [0, *itertools.accumulate(v)][:-1]
    assert [r["s"] for r in q.scan(s, "min", True).orderBy("idx").collect()] == list(itertools.accumulate(v, min))
    sums = [0, *itertools.accumulate(v)]
    assert q.max_subsequence(s).first()["best"] == max(0, *(b - a for k, a in enumerate(sums) for b in sums[k:]))
    w = spark.createDataFrame([(k, k, 99 - k) for k in range(50)], "q long, i long, j long")
    assert dict(rows(q.range_min(s, w, 8))) == {k: min(range(k, 100 - k), key=lambda i: (v[i], i)) for k in range(50)}
    for size in (3, 7):
        monkeypatch.setattr(q, "BLOCK", size)
        assert [r["s"] for r in q.scan(s, "max").orderBy("idx").collect()] == [0, *itertools.accumulate(v, max)][:-1]
        assert [r[1:] for r in rows(q.pack(s, F.col("v") % 3 == 0))] == [(x, k) for k, x in enumerate(x for x in v if x % 3 == 0)]
        side = [None if x % 5 == 4 else x % 5 for x in v]
        want = sorted(range(100), key=lambda i: (-1 if side[i] is None else side[i], i))
        got = q.split_by(s, F.expr("if(pmod(v, 5) = 4, null, pmod(v, 5))")).orderBy("at").collect()
        assert [(r["at"], r["idx"], r["side"]) for r in got] == [(k, i, side[i]) for k, i in enumerate(want)]
    assert [q.kth_smallest(s, k).first()["v"] for k in (0, 1, 37, 98, 99)] == [sorted(v)[k] for k in (0, 1, 37, 98, 99)] and q.kth_smallest(s, 100).isEmpty()
    assert rows(q.equal(s, s)) == [(True,)] and rows(q.compare(s, s.where("idx < 50"))) == [(False,)] and rows(q.is_sorted(s)) == [(False,)]
    assert sorted(r["v"] for r in q.shuffle(s, 1).collect()) == sorted(v)


def test_suffix_structures():
    for text in (b"aabcabd", b"bacacdaba", b"", b"a", b"aaaa", bytes(random.Random(1).choices(range(3), k=60))):
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert strings.ranks(text) == order
        lcp = strings.common_prefixes(text, order)
        assert all(text[a : a + n] == text[b : b + n] and text[a : a + n + 1] != text[b : b + n + 1] for a, b, n in zip(order, order[1:], lcp[1:], strict=False))
        tree = strings._tree(text)
        assert sorted(n[3] for n in tree if n[0] and n[2] == len(text) - n[3]) == sorted(order)
        assert all(tree[p][2] < d or (p == 0 and d == 0) for _, p, d, _ in tree[1:])
    assert strings.cartesian_parents([3, 1, 2, 1]) == [1, None, 3, 1]


def test_suffix_queries_take_whole_texts(spark, tmp_path):
    rng = random.Random(2)
    texts = [(1, "é☃" + "".join(rng.choices("ab\n", k=400))), (2, "abc" * 300), (3, "x" * 500), (4, None), (5, ""), (6, "line of text\n" * 40 + "end")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    array, lcp = [], []
    for i, text in texts:
        b = (text or "").encode()
        order = sorted(range(len(b)), key=lambda k: b[k:])  # noqa: B023
        array += [(i, rank, start) for rank, start in enumerate(order)]
        lcp += [(i, rank, shared(b[order[rank - 1] :], b[order[rank] :])) for rank in range(1, len(b))]
    assert sorted(map(tuple, queries.suffix_array(spark, str(tmp_path)).collect())) == array
    assert sorted(map(tuple, queries.lcp_array(spark, str(tmp_path)).collect())) == lcp
    tree = {(r["id"], r["node"]): r for r in queries.suffix_tree(spark, str(tmp_path)).collect()}
    for i, text in texts:
        b = (text or "").encode()
        nodes = {n: r for (j, n), r in tree.items() if j == i}
        label = lambda n: b[nodes[n]["start"] :][: nodes[n]["depth"]]  # noqa: B023, E731
        prefixes = {label(n) for n in nodes}
        branches = {b[k:][:depth] for (j, r, depth), k in zip(lcp, [a[2] for a in array if a[1]], strict=True) if j == i}
        assert len(prefixes) == len(nodes) and prefixes == {b"", *branches, *(b[k:] for k in range(len(b)))}  # noqa: B023
        assert all(label(r["parent"]) == max((p for p in prefixes if label(n).startswith(p) and p != label(n)), key=len) for n, r in nodes.items() if n and n % 7 == 0)


def test_sampled_matrix_estimates_the_exact_one(spark):
    e = both(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)])
    exact = {(r["row"], r["col"]): r["v"] for r in em.walk_matrix(e, 3).collect()}
    for downsample in (False, True):
        found = {(r["row"], r["col"]): r["v"] for r in em.sampled_walk_matrix(e, 3, 1500.0, seed=4, downsample=downsample).collect()}
        assert {*found} == {*exact}
        assert max(abs(found[k] - exact[k]) for k in exact) < 0.06 * max(exact.values())


def test_samples_do_not_depend_on_partitions(spark):
    e = both(spark, PATH)
    once = rows(em.sampled_pairs(e.repartition(1), 3, 5.0, 2))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = rows(em.sampled_pairs(e.repartition(5), 3, 5.0, 2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [r[:2] for r in once] == [r[:2] for r in again] and np.allclose([r[2] for r in once], [r[2] for r in again])


def test_randomized_svd_against_numpy(spark):
    rng = np.random.default_rng(0)
    b = rng.standard_normal((30, 4))
    a = b @ np.diag([5, 3, -2, 1]) @ b.T
    m = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(30)], "row long, col long, v double")
    u, s = la.randomized_svd(m, spark.range(30), 8)
    u = np.array([r["vec"] for r in u.orderBy("id").collect()])
    want = np.linalg.svd(a)[1]
    assert np.allclose(s[:4], want[:4], rtol=1e-6) and np.all(s[4:] < 1e-6 * s[0])
    assert np.allclose(u[:, :4].T @ u[:, :4], np.eye(4), atol=1e-8)
    projected, none = la.randomized_svd(m, spark.range(30), 8, sparse=2.0, project_only=True)
    assert none is None and projected.count() == 30


def test_spectral_propagation_against_numpy(spark):
    e = both(spark, PATH)
    ids = spark.range(11)
    x = np.random.default_rng(1).standard_normal((11, 3))
    emb = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(11)], "id long, vec array<double>")
    adj = np.zeros((11, 11))
    for a, b in PATH:
        adj[a, b] = adj[b, a] = 1
    d = adj.sum(1) + 1
    m = -adj / d[:, None] + np.diag(1 - 0.2 - 1 / d)
    l0, l1 = x, 0.5 * m @ (m @ x) - x
    conv = la.bessel_i(0, 0.5) * l0 - 2 * la.bessel_i(1, 0.5) * l1
    for i in range(2, 4):
        l0, l1 = l1, m @ (m @ l1) - 2 * l1 - l0
        conv += (-1) ** i * 2 * la.bessel_i(i, 0.5) * l1
    smooth = (adj + np.eye(11)) @ (x - conv)
    u, s, _ = np.linalg.svd(smooth, full_matrices=False)
    want = u * np.sqrt(s)
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = np.array([r["vec"] for r in em.spectral_propagation(e, emb, order=4).orderBy("id").collect()])
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-6) and ids.count() == 11
    assert abs(la.bessel_i(0, 0.5) - 1.0634833707413236) < 1e-12


def test_f1_by_hand(spark):
    truth = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 2)], "id long, label long")
    guess = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "id long, label long")
    r = ev.f1(truth, guess).first()
    assert abs(r["micro"] - 2 / 7) < 1e-12 and abs(r["macro"] - 0.5 / 3) < 1e-12


def test_evaluation_learns_separable_labels(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(v) for v in rng.normal(3 if i % 2 else -3, 1, 2)]) for i in range(60)]
    emb = spark.createDataFrame(data, "id long, vec array<double>")
    labels = spark.range(60).select("id", (F.col("id") % 2).alias("label"))
    assert ev.evaluate(emb, labels, 0.5).first()["micro"] > 0.9


def test_regressions_of_all_labels_against_newton(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3))
    has = [[bool(x[i, 0] + rng.normal() > 0), bool(x[i, 1] - x[i, 2] + rng.normal() > 1)] for i in range(90)]
    emb = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(90)], "id long, vec array<double>")
    labels = spark.createDataFrame([(i, name) for i in range(90) for name, h in zip((7, 11), has[i], strict=True) if h], "id long, label long")
    found = {(r["id"], r["label"]): r["score"] for r in ev.predict_scores(emb, labels, spark.range(60), c=0.7, tol=1e-9).collect()}
    one = np.hstack([x, np.ones((90, 1))])
    for k, name in enumerate((7, 11)):
        y, w = np.array([h[k] for h in has[:60]], float), np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-one[:60] @ w))
            w -= np.linalg.solve(0.7 * (one[:60].T * (p * (1 - p))) @ one[:60] + np.eye(4), 0.7 * one[:60].T @ (p - y) + w)
        want = 1 / (1 + np.exp(-one[60:] @ w))
        assert np.allclose([found[i, name] for i in range(60, 90)], want, atol=1e-6)
    assert len(found) == 60 and ev.predict_scores(emb, labels.limit(0), spark.range(60)).isEmpty() and ev.predict_scores(emb, labels, spark.range(0)).isEmpty()


def test_repeated_splits_give_means_and_deviations(spark):
    rng = np.random.default_rng(4)
    emb = spark.createDataFrame([(i, [float(v) for v in rng.normal(i % 2, 1, 2)]) for i in range(60)], "id long, vec array<double>")
    labels = spark.range(60).select("id", (F.col("id") % 2).alias("label"))
    runs = np.array([tuple(ev.evaluate(emb, labels, 0.5, 3 + k).first()) for k in range(2)]) * 100
    r = ev.evaluate_splits(emb, labels, 0.5, 2, 3).first()
    assert (r["train_share"], r["splits"]) == (0.5, 2)
    assert np.allclose([r["micro"], r["macro"], r["micro_std"], r["macro_std"]], [*runs.mean(0), *runs.std(0)])
