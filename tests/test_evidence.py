import pytest
from pyspark.sql import functions as F

from cohortweave.functions import scalars
from cohortweave.operators import evidence, regulon


def test_barcodes_and_aliquots(spark):
    rows = ["AAAA-01-0001-01A-x", "AAAA-01-0001-01B-x", "AAAA-01-0001-11A-x", "AAAA-01-0002-06A-x"]
    df = spark.createDataFrame([(r,) for r in rows], "barcode string")
    assert sorted(r["barcode"] for r in evidence.dedup_aliquots(df).collect()) == [rows[0], rows[2], rows[3]]
    assert [r["g"] for r in df.select(scalars.sample_group("barcode").alias("g")).collect()] == ["tumour", "tumour", "normal", "other"]
    assert [r["patient"] for r in evidence.patients_with_both(df).collect()] == ["AAAA-01-0001"]
    d = evidence.summarise_design(df, df.where("barcode not like '%11A%'")).first()
    assert (d["expr_tumour"], d["expr_normal"], d["expr_pairs"], d["meth_pairs"], d["both_tumour"]) == (2, 1, 1, 0, 1)


def test_packed_fields(spark):
    rows = [("p1", "A;B", "TSS200;Body"), ("p2", "A;B", "Body"), ("p3", "A;", "Body"), ("p4", "", ""), ("p5", None, None), ("p6", "A;A", "Body;Body")]
    df = spark.createDataFrame(rows, "probe string, genes string, regions string")
    got = sorted(tuple(r) for r in evidence.unpack_annotation(df).collect())
    assert got == [("p1", "A", "TSS200"), ("p1", "B", "Body"), ("p3", "A", "Body"), ("p6", "A", "Body")]
    assert evidence.mismatched_probes(df).first()["dropped"] == 2
    assert [r["n"] for r in df.select(scalars.distinct_fields("genes").alias("n")).collect()] == [2, 2, 1, 0, 0, 1]


@pytest.mark.parametrize("row,want", [((0.81, -1.0, 0.64, 1.0, None, None), 0.72), ((0.81, 1.0, None, None, 0.64, 1.0), 0.36), ((0.81, 1.0, 0.64, 1.0, None, None), 0.0)])
def test_concordance(spark, row, want):
    df = spark.createDataFrame([row], "a double, b double, c double, d double, e double, f double")
    assert df.select(scalars.concordance("a", "b", "c", "d", "e", "f").alias("x")).first()["x"] == pytest.approx(want)


def test_scores_and_prizes(spark):
    de = spark.createDataFrame([("g1", 2.0, 0.01), ("g1", -2.0, 0.02), ("g2", -1.0, 0.05), ("g3", 5.0, 0.2), ("g4", None, 0.0)], "gene string, log2FC double, padj double")
    e = {r["gene"]: (r["expr_score"], r["expr_direction"]) for r in evidence.expression_scores(de).collect()}
    assert e == {"g1": (1.0, 1.0), "g2": (0.5, -1.0)}
    dmr = spark.createDataFrame([("g1", "TSS200", -0.3, 0.01), ("g1", "Body", 0.2, 0.01), ("g5", "body", 0.5, 0.01), ("g6", "IGR", 0.5, 0.01)], "gene string, region string, delta_beta double, padj double")
    m = evidence.methylation_scores(dmr)
    out = {r["gene"]: r for r in evidence.build_prizes(evidence.expression_scores(de), m).collect()}
    assert set(out) == {"g1", "g2", "g5"}
    assert out["g1"]["concordance"] == pytest.approx(1.0 + 0.5 * 0.5**0.5)
    assert out["g5"]["prize"] == pytest.approx(0.4)
    empty = evidence.build_prizes(evidence.expression_scores(de.limit(0)), evidence.methylation_scores(dmr.limit(0)))
    assert empty.count() == 0 and "prize" in empty.columns


def test_probe_filters(spark):
    probes = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "probe string")
    anno = spark.createDataFrame([("p1", "chr1"), ("p2", "chrX"), ("p3", "chr2")], "probe string, chr string")
    bad = spark.createDataFrame([("p3",)], "probe string")
    assert [r["probe"] for r in evidence.filter_probes(probes, anno, bad=bad).collect()] == ["p1"]
    assert evidence.filter_probes(probes, anno.drop("chr")).count() == 3


def test_activity_matches_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.normal(size=60)
    w = np.zeros(60)
    w[:12] = rng.choice([-1, 1], 12)
    x = np.column_stack([np.ones(60), w])
    b, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    t = b[1] / np.sqrt(rss[0] / 58 * np.linalg.inv(x.T @ x)[1, 1])
    reg = spark.createDataFrame([("tf", f"g{i}", int(w[i])) for i in range(12)], "tf string, target string, mor int")
    resp = spark.createDataFrame([(f"g{i}", float(v)) for i, v in enumerate(y)], "gene string, y double")
    got = regulon.activity(reg, resp, with_p=True).first()
    assert got["activity"] == pytest.approx(t) and 0 < got["p"] < 1 and got["n_targets"] == 12


def test_left_chain_refuses_repeated_columns(spark):
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        regulon.left_chain([a, a], "k")


def test_m_value_keeps_null(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (None,)], "b double")
    got = [r["m"] for r in df.select(scalars.m_value("b").alias("m")).collect()]
    assert got[0] == pytest.approx(-9.9643, abs=1e-3) and got[1] == 0 and got[2] is None


def test_noise_does_not_depend_on_partitions(spark):
    df = spark.range(500)
    a = df.repartition(7).select("id", scalars.normal(1, "id").alias("z")).orderBy("id").toPandas()["z"]
    b = df.coalesce(1).select("id", scalars.normal(1, "id").alias("z")).orderBy("id").toPandas()["z"]
    assert (a == b).all() and abs(a.mean()) < 0.15 and abs(a.std() - 1) < 0.15
    assert df.select(F.max(scalars.uniform(1, "id"))).first()[0] < 1
