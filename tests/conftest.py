import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL on one scale and compares the rows."""
    import datetime
    import decimal

    import duckdb

    def norm(v):
        if isinstance(v, (float, decimal.Decimal)):
            return round(float(v), 6)
        if isinstance(v, (list, tuple)):
            return tuple(map(norm, v))
        return v.isoformat() if isinstance(v, datetime.datetime) else v

    def run(query, sql, sf="/root/testdata/sf0.001"):
        df = query(spark, sf)
        got = sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        out = con.sql(sql)
        assert sorted(out.columns) == sorted(df.columns)
        order = [out.columns.index(c) for c in sorted(out.columns)]
        assert got == sorted((tuple(norm(r[k]) for k in order) for r in out.fetchall()), key=repr)

    return run
