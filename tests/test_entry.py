import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["concordance_prizes", "reciprocal_collapse", "propagate_k4", "bh_adjust", "biotype_coverage_rollup", "annotate_unpack", "component_summary", "seed_quality"])
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).map(lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x).values.tolist()))
    assert key(got) == key(want)


def test_entry(spark):
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0
