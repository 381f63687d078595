import pytest

from edgeloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(compare, name):
    compare(registry.QUERIES[name], registry.SQL[name], "/root/testdata/sf0.01")


def test_all_operators_have_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, tmp_path_factory, name):
    at = tmp_path_factory.getbasetemp() / "empty"
    if not at.exists():
        for t in ("documents", "pages", "benchmark"):
            spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    assert registry.QUERIES[name](spark, str(at)).count() == 0
