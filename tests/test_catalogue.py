"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
from glosspark.plans import more_queries, tree_queries  # noqa: E402, F401  register their own
from glosspark.plans.catalogue import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    names = sorted(df.columns)
    df = df.astype({c: "float64" for c in names if str(df[c].dtype) in ("Int32", "Int64")})  # as Spark's frames hold integers with nulls
    flat = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return names, sorted(repr([flat(x.item() if hasattr(x, "item") else x) for x in r]) for r in df[names].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLES[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
