"""Every query with SQL against another engine on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")


def one(x):
    x = x.tolist() if hasattr(x, "tolist") else x
    if x is None or str(x) in ("<NA>", "NaT", "nan"):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 5) + 0.0
    return [one(v) for v in x] if isinstance(x, (list, tuple)) else x


def rows(df):
    return sorted(repr(tuple(one(x) for x in r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    return c


CORE = {k for m in entry.CORE for k in m.QUERIES}
#: Queries without rows at the smallest scale, and those with a column that may be null throughout.
EMPTY: set[str] = set()
OPEN: set[str] = set()
HEAVY = {"space_control", "controlled_threat"}


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k in CORE and k not in HEAVY))
def test_matches_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, FOLDER).toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k in CORE and k not in entry.oracle_sql()))
def test_runs_without_sql(spark, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert len(got) or name in EMPTY
    assert not got.isna().all().any() or name in EMPTY or name in OPEN


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partition_count_does_not_matter(spark):
    name = "transition_table"
    was = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(rows(entry.queries()[name](spark, FOLDER).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] == got[1] == got[2]
