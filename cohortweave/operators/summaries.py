"""Summary tables of the reports: regions, cross tables, seeds from scores, sweeps over a grid, figures as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortweave.functions.ranks import average_rank, pearson, quantiles


def region_summary(cis: DataFrame, by: str = "region", rho: str = "rho", padj: str = "padj", strong: float = 0.2, cutoff: float = 0.05) -> DataFrame:
    """Per region: genes, median rho, share of negative ones, and how many are strongly negative or positive and significant."""
    passed = F.col(padj) < cutoff
    counts = cis.groupBy(by).agg(
        F.count(F.lit(1)).alias("genes"), F.avg((F.col(rho) < 0).cast("double")).alias("share_negative"),
        F.count_if((F.col(rho) < -strong) & passed).alias("strong_negative"), F.count_if((F.col(rho) > strong) & passed).alias("strong_positive"),
    )
    return counts.join(quantiles(cis, rho, {"median_rho": 0.5}, [by]), by, "left")


def cross_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """How many rows have each pair of values."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def seed_vector(methylation: DataFrame, nodes: DataFrame, cis: DataFrame | None = None, rho: float = -0.1, padj: float = 0.25) -> DataFrame:
    """(node, state) with state = -direction * score of the promoter, for genes of the network and, given cis correlations (gene, rho, padj), with a loose one."""
    scored = methylation.where("prom_direction is not null and prom_score is not null")
    out = scored.select(F.col("gene").alias("node"), (-F.col("prom_direction") * F.col("prom_score")).alias("state"))
    out = out.join(nodes.select("node").distinct(), "node", "left_semi")
    if cis is None:
        return out
    kept = cis.where((F.col("rho") < rho) & (F.col("padj") < padj)).select(F.col("gene").alias("node")).distinct()
    return out.join(kept, "node", "left_semi")


def seed_evidence(seeds: DataFrame, de: DataFrame, cis: DataFrame) -> DataFrame:
    """Seeds (node, state) with the expression effect and the cis correlation of their gene; all three must know it."""
    effects = de.select(F.col("gene").alias("node"), F.col("log2FC").alias("effect"), F.col("padj").alias("de_padj"))
    cis = cis.select(F.col("gene").alias("node"), "rho", F.col("padj").alias("cis_padj"))
    return seeds.select("node", "state").join(effects.where("effect is not null"), "node").join(cis, "node")


def activity_against(activity: DataFrame, evidence: DataFrame, value: str, left: str = "tf", right: str = "gene") -> DataFrame:
    """One row: Spearman rho and n of regulator activity against a value of the gene of that name."""
    rows = activity.select(F.col(left).alias("__k"), "activity").join(evidence.select(F.col(right).alias("__k"), F.col(value).alias("__v")), "__k")
    ranked = average_rank(average_rank(rows.where("activity is not null and __v is not null"), "activity", name="ra"), "__v", name="rv")
    return ranked.agg(pearson(F.col("ra"), F.col("rv")).alias("rho"), F.count(F.lit(1)).alias("n"))


def threshold_sweep(rows: DataFrame, grid: DataFrame, effect: str = "log2FC", padj: str = "padj") -> DataFrame:
    """Per row of a small grid (padj_cutoff, effect_cutoff): how many rows pass both, and how many of them go up and down.

    The grid is a table of settings that the caller writes out, so it is broadcast; rows are scanned once for all of them.
    """
    e, p = F.col(effect), F.col(padj)
    passed = rows.join(F.broadcast(grid), (p <= F.col("padj_cutoff")) & (F.abs(e) >= F.col("effect_cutoff")))
    counts = passed.groupBy("padj_cutoff", "effect_cutoff").agg(F.count(F.lit(1)).alias("n"), F.count_if(e > 0).alias("up"), F.count_if(e < 0).alias("down"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return grid.join(counts, ["padj_cutoff", "effect_cutoff"], "left").select("padj_cutoff", "effect_cutoff", zero("n"), zero("up"), zero("down"))


def grid_rows(results: DataFrame, setting: str, value, order: dict[str, list[str]], measures: list[str]) -> DataFrame:
    """Rows of one setting of a result grid, with the place of each factor value in its given order; values that the order lacks go."""
    out = results.where(F.col(setting) == value)
    for c, names in order.items():
        out = out.withColumn(f"{c}_place", F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)).cast("long")).where(F.col(f"{c}_place") > 0)
    return out.select(*order, *[f"{c}_place" for c in order], *measures)


def figures_as_text(df: DataFrame, **formats: str) -> DataFrame:
    """Columns as report strings by printf formats, with %% for a per cent sign; NULL stays NULL."""
    return df.select(*[(F.when(F.col(c).isNotNull(), F.format_string(formats[c], F.col(c))).alias(c) if c in formats else F.col(c)) for c in df.columns])
