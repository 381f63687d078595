import pytest

from edgeloom import queries, queries_more  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(compare, name):
    compare(queries.QUERIES[name], queries.SQL[name], SF)


def test_connected_components_against_brute_force(spark):
    near = {}
    for r in queries.parts_together(spark, SF).collect():
        near.setdefault(r["src"], set()).add(r["dst"])
        near.setdefault(r["dst"], set()).add(r["src"])
    want = {}
    for start in sorted(r["id"] for r in queries.parts(spark, SF).collect()):
        stack = [start]
        while stack:
            v = stack.pop()
            if v not in want:
                want[v] = start
                stack += near.get(v, ())
    assert {r["id"]: r["component"] for r in queries.connected_components(spark, SF).collect()} == want


def test_range_minima_reach_the_end(spark):
    a = {r["idx"]: r["v"] for r in queries.amounts(spark, SF).collect()}
    got = {r["q"]: r["idx"] for r in queries.QUERIES["range_min_whole"](spark, SF).collect()}
    n = len(a)
    assert got == {k: min(range(k * n // 80, n - k * n // 80), key=lambda i: (a[i], i)) for k in range(40)} and n > 403


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3810
    assert {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}
