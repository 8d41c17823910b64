import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from cohortweave.functions import ranks, special
from pyspark.sql import functions as F


def table(spark, xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, x double")


def test_ties_share_their_mean(spark):
    rows = ranks.rank_normalise(table(spark, [1.0, 1.0, 2.0, 5.0, 5.0, None]), "x").orderBy("id").collect()
    assert [r["score"] for r in rows] == [0.3, 0.3, 0.6, 0.9, 0.9, None]
    assert [r["score"] for r in ranks.rank_normalise(table(spark, [7.0] * 3), "x").collect()] == [2 / 3] * 3
    assert ranks.rank_normalise(table(spark, []), "x").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 6), min_size=2, max_size=40))
def test_ranks_bins_and_adjustment_match_pandas(spark, xs):
    df = table(spark, [float(x) for x in xs])
    s = pd.Series(xs, dtype=float)
    got = ranks.average_rank(df, "x").orderBy("id").toPandas()["rank"]
    assert np.allclose(got, s.rank())
    bins = ranks.rank_bins(df, "x", "id", 10).orderBy("id").toPandas()["bin"]
    r = s.rank(method="first")
    assert bins.tolist() == [max(1, math.ceil(10 * (v - 1) / (len(xs) - 1))) for v in r]
    p = (s + 1) / 10
    padj = ranks.bh_adjust(df.withColumn("p", (F.col("x") + 1) / 10), "p").orderBy("id").toPandas()["padj"]
    order = np.argsort(p.to_numpy(), kind="stable")[::-1]
    want = np.empty(len(p))
    want[order] = np.minimum.accumulate(np.minimum(1, p.to_numpy()[order] * len(p) / np.arange(len(p), 0, -1)))
    low = pd.Series(want).groupby(p).transform("min")
    assert np.allclose(padj, low)


def test_spearman_and_constant_side(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0), (2.0, 1.0, 0.0), (3.0, 4.0, 0.0), (4.0, 3.0, 0.0)], "a double, b double, c double")
    assert ranks.spearman(df, "a", "b").first()["rho"] == pytest.approx(0.6)
    assert ranks.spearman(df, "a", "c").first()["rho"] is None


def test_groups_of_any_share(spark):
    """One group with most rows, one of a single row, a NULL group, NULL and repeated values, against pandas."""
    rng = np.random.default_rng(5)
    rows = [("big" if i < 400 else "one" if i == 400 else None, int(rng.integers(0, 30)) / 30, float(rng.integers(0, 9))) for i in range(430)] + [("big", None, 1.0)] * 3 + [("none", None, 2.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, g string, p double, y double").repartition(5)
    got = {r["id"]: r["padj"] for r in ranks.bh_adjust(df, "p", by=["g"]).collect()}
    assert len(got) == len(rows) and all(got[i] is None for i, r in enumerate(rows) if r[1] is None)
    for g in ("big", "one", None):
        p = {i: r[1] for i, r in enumerate(rows) if r[0] == g and r[1] is not None}
        want = {i: min(1.0, *(q * len(p) / sum(z <= q for z in p.values()) for q in p.values() if q >= x), 1.0) for i, x in p.items()}
        assert all(got[i] == pytest.approx(want[i]) for i in p)
    rho = {r["g"]: (r["rho"], r["n"]) for r in ranks.spearman(df, "p", "y", by=["g"]).collect()}
    assert rho.keys() == {"big", "one", None} and rho["one"] == (None, 1)
    for g in ("big", None):
        some = pd.DataFrame([r[1:] for r in rows if r[0] == g and r[1] is not None], columns=["p", "y"]).rank()
        assert rho[g][1] == len(some) and rho[g][0] == pytest.approx(some["p"].corr(some["y"]))
    assert ranks.bh_adjust(df.limit(0), "p", by=["g"]).count() == 0 and ranks.spearman(df.limit(0), "p", "y", by=["g"]).count() == 0
    empty = ranks.spearman(df.limit(0), "p", "y").first()
    assert (empty["rho"], empty["n"]) == (None, 0)


def test_special_functions():
    assert special.t_two_sided(2.0, 10)[()] == pytest.approx(0.07338803477074039, rel=1e-9)
    assert special.t_two_sided(12.0, 3)[()] == pytest.approx(0.0012460, rel=1e-3)
    assert special.normal_two_sided(1.959963984540054)[()] == pytest.approx(0.05, rel=1e-9)
    assert special.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert special.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-9)
    assert special.inverse_trigamma(special.trigamma(3.3)) == pytest.approx(3.3, rel=1e-6)


def test_halves_are_rounded_as_duckdb_rounds_doubles(spark):
    import duckdb

    from cohortweave.functions.scalars import rounded_half

    xs = [1.005, -1.005, 2.675, 1.115, 0.125, -0.125, 123.455, 8.345, 0.0, 1e6 + 0.005]
    want = [duckdb.sql(f"SELECT round({x!r}::DOUBLE, 2)").fetchall()[0][0] for x in xs]
    got = [r["r"] for r in table(spark, xs).select("id", rounded_half("x", 2).alias("r")).orderBy("id").collect()]
    assert got == want
    assert [r["r"] for r in table(spark, xs).select("id", F.round("x", 2).alias("r")).orderBy("id").collect()] != want


def test_signed_ranks_sum_in_the_order_of_keys(spark, tmp_path):
    """Many differences lie between two cents, and sums by file have other last bits than the SQL's over rows in order."""
    duckdb = pytest.importorskip("duckdb")
    from cohortweave.plans import queries

    c = duckdb.connect()
    c.execute("SET threads=1")
    c.execute("SELECT setseed(0.3)")
    c.execute("CREATE TABLE orders AS SELECT range AS o_orderkey, floor(random()*4000)::BIGINT AS o_custkey, CASE WHEN random()<0.5 THEN 'O' ELSE 'F' END AS o_orderstatus, round(1000+random()*3,2) AS o_totalprice FROM range(40000)")
    (tmp_path / "orders.parquet").mkdir()
    for i in range(8):
        c.execute(f"COPY (SELECT * FROM orders WHERE o_orderkey%8={i}) TO '{tmp_path}/orders.parquet/{i}.parquet'")
    want = c.execute(queries.ORACLES["paired_signed_rank"]).fetchone()
    assert tuple(queries.QUERIES["paired_signed_rank"](spark, str(tmp_path)).first()) == want
    assert tuple(queries.QUERIES["paired_signed_rank_p"](spark, str(tmp_path)).select("n", "z").first()) == (want[0], want[2])
