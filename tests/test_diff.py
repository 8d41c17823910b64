import numpy as np
import pytest

from cohortweave.operators import diff
from cohortweave.plans import cohort
from cohortweave.sources import interactions


@pytest.fixture(scope="module")
def cohort_data(spark):
    rng = np.random.default_rng(11)
    bars = [f"TT-AA-{i:05d}X-01A-r" for i in range(24)] + [f"TT-AA-{i:05d}X-11A-r" for i in range(12)]
    base = rng.gamma(2.0, 200.0, 300)
    counts = []
    for b in bars:
        mu = base * rng.uniform(0.7, 1.3)
        if "-01A" in b:
            mu = np.where(np.arange(300) < 20, mu * 0.25, mu)
        y = rng.poisson(rng.gamma(6.0, mu / 6.0))
        counts += [(f"E{g:04d}.1", b, int(v)) for g, v in enumerate(y)]
    beta = []
    for b in bars:
        v = rng.beta(2, 5, 200)
        v = np.where((np.arange(200) < 20) & ("-01A" in b), np.minimum(0.99, v + 0.32), v)
        beta += [(f"cg{i}", b, float(x)) for i, x in enumerate(v)]
    s = spark.createDataFrame([(b,) for b in bars], "barcode string")
    return s, spark.createDataFrame(counts, "gene_id string, sample string, count long"), spark.createDataFrame(beta, "probe string, sample string, beta double")


@pytest.mark.parametrize("paired", [False, True])
def test_planted_genes_come_first(spark, cohort_data, paired):
    samples, counts, _ = cohort_data
    symbols = counts.select("gene_id").distinct().selectExpr("gene_id", "substring_index(gene_id, '.', 1) as symbol")
    de = diff.diff_expression(counts, samples, symbols, paired).toPandas().sort_values("padj")
    top = set(de["gene"].head(20))
    assert len(top & {f"E{g:04d}" for g in range(20)}) >= 16
    hit = de[de["gene"].isin([f"E{g:04d}" for g in range(20)])]
    assert (hit["log2FC"] < -1).mean() > 0.9 and de["gene"].is_unique


@pytest.mark.parametrize("paired", [False, True])
def test_planted_probes_come_first(spark, cohort_data, paired):
    samples, _, beta = cohort_data
    dm = diff.diff_methylation(beta, samples, paired).toPandas().sort_values("padj")
    assert len(set(dm["probe"].head(20)) & {f"cg{i}" for i in range(20)}) >= 16
    assert len(dm) == 200 and (dm.head(10)["delta_beta"] > 0.15).all()


def test_too_few_pairs(spark, cohort_data):
    samples, _, beta = cohort_data
    with pytest.raises(ValueError):
        diff.diff_methylation(beta, samples.where("barcode like '%000_X%'").limit(2), paired=True)


def test_cohort_run(spark, cohort_data):
    samples, counts, beta = cohort_data
    symbols = counts.select("gene_id").distinct().selectExpr("gene_id", "substring_index(gene_id, '.', 1) as symbol")
    genes = symbols.selectExpr("symbol as gene", "'protein_coding' as biotype")
    anno = spark.createDataFrame([(f"cg{i}", f"E{i:04d};E{i + 1:04d}", "TSS200;Body", "chr1") for i in range(200)], "probe string, genes string, regions string, chr string")
    net = spark.createDataFrame([(f"E{i:04d}", f"E{(i * 7 + 3) % 60:04d}", i % 9) for i in range(60)], f"{interactions.SOURCE} string, {interactions.TARGET} string, curation_effort int")
    tables = {"counts": counts, "expression_samples": samples, "symbols": symbols, "beta": beta, "methylation_samples": samples, "annotation": anno, "biotype": genes}
    out = cohort.run(spark, tables, net, cohort.CohortConfig(noise_runs=3, permutations=3, omega_quantile=0.1))
    assert out["prizes"].count() >= 16 and out["permutation"].count() == 1
    assert {r["stage"] for r in out["timings"].collect()} >= {"expression", "solve", "permutation"}


@pytest.mark.parametrize("paired", [False, True])
def test_a_query_of_genes_reads_its_lines_once(spark, monkeypatch, paired):
    import os

    from cohortweave.plans import queries

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    seen, plain = spark.sparkContext.accumulator(0), queries.table

    def each(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    def table(spark, sf_dir, name):
        df = plain(spark, sf_dir, name)
        return df.mapInPandas(each, df.schema) if name == "lineitem" else df

    def tested(counts, samples, paired):
        assert diff.design(samples, paired).count() and counts.count()
        return counts

    monkeypatch.setattr(queries, "table", table)
    monkeypatch.setattr(queries.diff, "diff_expression", tested)
    assert queries._genes(spark, "/root/testdata/sf0.001", paired).count()
    assert seen.value == plain(spark, "/root/testdata/sf0.001", "lineitem").count()
