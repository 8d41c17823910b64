"""Scratch scopes, annotation with a fallback, typed readers, warnings and summaries."""

import os

import pytest
from pyspark.sql import functions as F

from cohortweave.functions import ranks, scalars
from cohortweave.operators import components, evidence, solver, summaries
from cohortweave.scratch import Scope, cut
from cohortweave.sources import tables


def path_of(df):
    return df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]


def test_scopes_delete_what_is_not_kept(spark):
    with Scope() as outer:
        with Scope() as scope:
            a, b, c = (cut(spark.range(5), "scope") for _ in range(3))
            paths = [path_of(x) for x in (a, b, c)]
            scope.free(a)
            assert not os.path.exists(paths[0]) and os.path.exists(paths[1])
            scope.keep(c)
        assert [os.path.exists(p) for p in paths] == [False, False, True] and c.count() == 5
        outer.keep(c)
    assert os.path.exists(paths[2])
    with pytest.raises(ValueError), Scope():
        d = cut(spark.range(3), "scope")
        gone = path_of(d)
        raise ValueError
    assert not os.path.exists(gone)


@pytest.mark.parametrize("few,most", [(0, 200_000), (0, 0), (10_000, 200_000)])
def test_components_of_stars_and_chains(spark, monkeypatch, few, most):
    monkeypatch.setattr(components, "FEW", few)
    monkeypatch.setattr(components, "HEAVY", 20)
    monkeypatch.setattr(components, "MOST_HEAVY", most)
    edges = [(5000, i) for i in range(300)] + [(6000 + i, 6001 + i) for i in range(40)] + [(7000, 7000), (None, 1)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(300), 5000]} | {6000 + i: 6000 for i in range(41)}


def test_quantiles_by_group(spark):
    rows = [("a", float(x)) for x in (1, 2, 2, 10)] + [("b", 3.0), ("b", None), (None, 4.0), (None, 6.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["m"], r["q"]) for r in ranks.quantiles(df, "x", {"m": 0.5, "q": 0.9}, ["g"]).collect()}
    assert got == {"a": (2.0, pytest.approx(7.6)), "b": (3.0, 3.0), None: (5.0, pytest.approx(5.8))}
    assert ranks.quantiles(df.where("x > 100"), "x", {"m": 0.5}).first()["m"] is None


def test_a_group_over_many_ranges_has_the_ranks_of_one(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 1000).cast("double").alias("x"))
    got = ranks.average_rank(df, "x", ["g"]).groupBy("g", "x").agg(F.max("rank").alias("r")).collect()
    values = {g: sorted(float(i * 7 % 1000) for i in range(3000) if i % 2 == g) for g in (0, 1)}
    for r in got:
        v = values[r["g"]]
        assert r["r"] == v.index(r["x"]) + (v.count(r["x"]) + 1) / 2


def test_annotation_or_takes_fields_of_the_fallback(spark):
    a = spark.createDataFrame([("p1", "A", ""), ("p2", None, "Body")], "probe string, genes string, regions string")
    b = spark.createDataFrame([("p1", "B", "TSS200"), ("p3", "C", "Body")], "probe string, genes string, regions string")
    assert sorted(tuple(r) for r in evidence.annotation_or(a, b).collect()) == [("p1", "A", "TSS200"), ("p2", None, "Body"), ("p3", "C", "Body")]
    with pytest.raises(ValueError):
        evidence.annotation_or(a.withColumn("regions", F.lit("")), b.withColumn("regions", F.lit(None).cast("string")))
    with pytest.warns(UserWarning, match="nothing"):
        evidence.warn_if_empty(a.limit(0), "nothing passed")


def test_aliquots_keep_the_input_order(spark):
    rows = [("P2-000000000-01B", 1), ("P1-000000000-01A", 2), ("P2-000000000-01A", 3), ("P1-000000000-01C", 4)]
    got = evidence.dedup_aliquots(spark.createDataFrame(rows, "barcode string, pos int"), position="pos").collect()
    assert [r["pos"] for r in got] == [2, 3]


def test_typed_results_and_sample_counts(spark, tmp_path):
    (tmp_path / "cis.tsv").write_text("gene\tpadj\trho\nA\t0.1\tNA\n")
    assert tuple(tables.read_result(spark, str(tmp_path / "cis.tsv"), "cis").first()) == ("A", None, None, 0.1, None)
    (tmp_path / "s1.tsv").write_text("# model\ngene_id\tunstranded\nN_unmapped\t9\ng1\t3\n")
    manifest = spark.createDataFrame([("S", "s1.tsv")], "id string, filename string")
    assert [tuple(r) for r in tables.ingest_sample_counts(spark, str(tmp_path / "s1.tsv"), manifest).collect()] == [("g1", "S", 3)]


def test_backends_and_the_warning_of_an_empty_forest(spark, monkeypatch):
    e = spark.createDataFrame([("A", "B", 0.5)], "source string, target string, cost double")
    v = spark.createDataFrame([("A", 0.1)], "node string, prize double")
    with pytest.warns(UserWarning, match="hub penalty"):
        edges, nodes = solver.solve_forest(e, v, mu=1.0)
    assert edges.count() == nodes.count() == 0
    monkeypatch.setitem(solver.BACKENDS, "mine", lambda *a: ("edges", "nodes"))
    assert solver.solve_forest(e, v, backend="mine") == ("edges", "nodes")
    with pytest.raises(ValueError):
        solver.solve_forest(e, v, backend="other")


def test_report_figures(spark):
    df = spark.createDataFrame([("x", 0.1234, 41.6), ("y", None, 7.0)], "r string, rho double, share double")
    assert [tuple(r) for r in summaries.figures_as_text(df, rho="%+.3f", share="%.0f%%").collect()] == [("x", "+0.123", "42%"), ("y", None, "7%")]


def test_draws_have_their_means(spark):
    df = spark.range(20_000).select(
        scalars.gamma(1, 3, "id").alias("g"), scalars.beta(2, 2, 6, "id").alias("b"), scalars.negative_binomial(3, 4, 30.0, "id").alias("n"), scalars.choice(4, ["x", "y", "z"], [1, 2, 1], "id").alias("c")
    )
    r = df.agg(F.avg("g"), F.avg("b"), F.avg("n"), F.var_samp("n"), F.avg((F.col("c") == "y").cast("int")), F.avg((F.col("c") == "z").cast("int"))).first()
    assert list(r) == [pytest.approx(m, rel=0.06) for m in (3, 0.25, 30, 30 + 30**2 / 4, 0.5, 0.25)]


def test_partitions_grow_in_number_and_not_in_rows(spark, monkeypatch):
    """Complete probes, unpacked annotations and cis ranks read partitions of a bounded number of rows, with the results of a small table."""
    from pyspark.sql import functions as F

    from cohortweave import scratch
    from cohortweave.operators import evidence, regulon

    seen = []
    plain = scratch.dealt
    for module in (evidence, regulon):
        monkeypatch.setattr(module, "dealt", lambda df, *keys, rows=0: seen.append(plain(df, *keys, rows=500)) or seen[-1])
    beta = spark.range(4000).select((F.col("id") % 1000).alias("probe"), F.when(F.col("id") != 17, F.col("id") * 0.5).alias("beta"))
    beta = beta.unionByName(spark.sql("select cast(null as long) as probe, 1.0D as beta"))
    out = evidence.complete_probes(beta)
    assert sorted(out.columns) == ["beta", "probe"] and out.count() == 3996 and out.where("probe = 17 or probe is null").count() == 0
    packed = spark.range(2000).select((F.col("id") % 1500).alias("probe"), F.lit("a;b;a").alias("genes"), F.lit("x;y;x").alias("regions"))
    assert evidence.unpack_annotation(packed).count() == 3000
    rows = spark.range(6000).select((F.col("id") % 200).alias("k"), F.col("id").alias("pair"), F.col("id").cast("double").alias("value"))
    got = regulon.cis_correlation(rows, rows.withColumn("value", -F.col("value")), "k", "pair").collect()
    assert len(got) == 200 and all(abs(r["rho"] + 1) < 1e-9 and r["n"] == 30 for r in got)
    assert [df.rdd.getNumPartitions() for df in seen] == [8, 4, 12]
