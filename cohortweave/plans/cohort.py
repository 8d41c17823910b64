"""The cohort run: tables of an expression and a methylation assay to a scored, tested subnetwork.

python -m cohortweave.plans.cohort --input DIR --output DIR runs it over Parquet tables counts, expression_samples, symbols,
beta, methylation_samples, annotation and a tab-separated network; symbols and biotype, annotation_fallback and bad_probes may be there.
"""

from __future__ import annotations

import argparse
import time
import warnings
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortweave.operators import diff, evidence, network, solver
from cohortweave.scratch import cut
from cohortweave.sources import interactions
from cohortweave.sources.tables import exists, write_bundle, write_tsv

NEEDED = ("counts", "expression_samples", "beta", "methylation_samples", "annotation")
OPTIONAL = ("symbols", "biotype", "annotation_fallback", "bad_probes")


@dataclass(frozen=True)
class CohortConfig:
    padj: float = 0.05
    effect: float = 1.0
    min_delta: float = 0.1
    least_pairs: int = 10
    paired: bool = True
    coding_only: bool = True
    least_coverage: float = 0.4
    mu: float = 0.005
    omega_quantile: float = 0.9
    noise_runs: int = 100
    permutations: int = 200
    prizes: evidence.PrizeConfig = field(default_factory=evidence.PrizeConfig)


class Timings:
    """Seconds per stage. A stage ends with a written table, so its time is that of the work."""

    def __init__(self):
        self.rows: list[tuple[str, float]] = []

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        yield
        self.rows.append((name, time.perf_counter() - began))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "stage string, seconds double")


def run(spark: SparkSession, tables: dict[str, DataFrame], raw_network: DataFrame, config: CohortConfig = CohortConfig()) -> dict[str, DataFrame]:
    """All result tables. Raises when no region survives, when no gene is left, or when too few genes are in the network."""
    t = Timings()
    with t.stage("design"):
        design = cut(evidence.summarise_design(tables["expression_samples"], tables["methylation_samples"]), "cohort").first()
    with t.stage("expression"):
        samples = evidence.dedup_aliquots(tables["expression_samples"])
        de = cut(diff.diff_expression(tables["counts"], samples, tables.get("symbols"), config.paired and design["expr_pairs"] >= config.least_pairs), "cohort")
    with t.stage("methylation"):
        samples = evidence.dedup_aliquots(tables["methylation_samples"])
        annotation = tables["annotation"]
        if "annotation_fallback" in tables:
            annotation = cut(evidence.annotation_or(annotation, tables["annotation_fallback"]), "cohort")
        beta = evidence.filter_probes(tables["beta"], annotation, bad=tables.get("bad_probes"))
        dm = cut(diff.diff_methylation(beta, samples, config.paired and design["meth_pairs"] >= config.least_pairs), "cohort")
        dropped = evidence.mismatched_probes(annotation).first()["dropped"]
        if dropped:
            warnings.warn(f"{dropped} annotated probes have unequal numbers of genes and regions and are left out", stacklevel=2)
        dmr = cut(evidence.annotate_probes(dm, annotation), "cohort")
        if dmr.where("region is not null and region <> ''").isEmpty():
            raise ValueError("no probe has a region; check the annotation")
    with t.stage("prizes"):
        scored, regions = de, dmr
        if config.coding_only and "biotype" in tables:
            scored, regions = evidence.coding_only(de, tables["biotype"]), evidence.coding_only(dmr, tables["biotype"])
            if scored.isEmpty():
                raise ValueError("no gene is left after the restriction to coding genes")
        expr = evidence.warn_if_empty(cut(evidence.expression_scores(scored, padj_cutoff=config.padj, effect_cutoff=config.effect), "cohort"), "no gene passed the expression thresholds")
        meth = evidence.warn_if_empty(cut(evidence.methylation_scores(regions, padj_cutoff=config.padj, min_delta=config.min_delta), "cohort"), "no gene passed the methylation thresholds")
        prizes = cut(evidence.build_prizes(expr, meth, config.prizes), "cohort")
    with t.stage("network"):
        edges = cut(network.cost_graph(raw_network, interactions.SOURCE, interactions.TARGET, "curation_effort"), "cohort")
        vector = cut(evidence.prize_vector(prizes).withColumnRenamed("gene", "node"), "cohort")
        biotype = tables["biotype"] if "biotype" in tables else spark.createDataFrame([], "gene string, biotype string")
        nodes = network.nodes_of(edges)
        coverage = cut(network.biotype_coverage(vector.select(F.col("node").alias("gene")), nodes, biotype), "cohort")
        inside = coverage.where("biotype = 'ALL'").first()
        if inside is None or inside["coverage"] < config.least_coverage:
            raise ValueError("too few scored genes are in the network; are both keyed by the same symbols?")
    with t.stage("solve"):
        omega = network.suggest_omega(vector, config.omega_quantile).first()["omega"]
        forest = [cut(x, "cohort") for x in solver.solve_forest(edges, vector, omega, config.mu)]
        summary = cut(solver.summarise_forest(*forest, omega), "cohort")
    with t.stage("robustness"):
        frequency, node_frequency = (cut(x, "cohort") for x in solver.robust_forest(edges, vector, omega, config.mu, config.noise_runs))
    with t.stage("permutation"):
        test = cut(solver.permutation_test(edges, vector, omega, config.mu, config.permutations), "cohort")
    return {
        "de": de, "dmr": dmr, "prizes": prizes, "coverage": coverage, "forest_edges": forest[0], "forest_nodes": forest[1], "summary": summary,
        "edge_frequency": frequency, "node_frequency": node_frequency, "permutation": test, "timings": t.table(spark),
    }


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--input", required=True)
    args.add_argument("--output", required=True)
    args.add_argument("--network", help="tab-separated interaction records; INPUT/network.tsv by default")
    args.add_argument("--annotation-fallback", help="annotation of probes that the first one lacks; INPUT/annotation_fallback by default, if it is there")
    args.add_argument("--bad-probes", help="probes to leave out; INPUT/bad_probes by default, if it is there")
    args.add_argument("--tsv", action="store_true", help="write every result table as tab-separated text too")
    a = args.parse_args()
    spark = SparkSession.builder.getOrCreate()
    tables = {n: spark.read.parquet(f"{a.input}/{n}") for n in NEEDED}
    given = {"annotation_fallback": a.annotation_fallback, "bad_probes": a.bad_probes}
    for name in OPTIONAL:
        at = given.get(name) or f"{a.input}/{name}"
        if given.get(name) or exists(spark, at):
            tables[name] = spark.read.parquet(at)
    out = run(spark, tables, interactions.load(spark, a.network or f"{a.input}/network.tsv"))
    write_bundle(spark, a.output, out, asdict(CohortConfig()) | {"optional_tables": sorted(set(tables) - set(NEEDED))})
    if a.tsv:
        for name, df in out.items():
            write_tsv(df, f"{a.output}/tsv/{name}", "overwrite", na="NA")


if __name__ == "__main__":
    main()
