"""Networks from raw interaction records: hygiene, costs, signs, coverage and reports."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.functions.ranks import quantiles, rank_normalise
from cohortweave.functions.scalars import clamp, edge_sign, has_column, string_bool
from cohortweave.operators.components import connected_components

CARRIED = ("is_directed", "is_stimulation", "is_inhibition")


def clean_endpoints(raw: DataFrame, source: str = "source", target: str = "target", drop_complexes: bool = False) -> DataFrame:
    """Records with two different non-empty ends; with drop_complexes, none that starts with COMP:."""
    s, t = F.col(source), F.col(target)
    out = raw.where(s.isNotNull() & t.isNotNull() & (s != "") & (t != "") & (s != t))
    return out.where(~s.startswith("COMP:") & ~t.startswith("COMP:")) if drop_complexes else out


def edge_costs(raw: DataFrame, confidence: str = "confidence", min_cost: float = 0.05, max_cost: float = 1.0) -> DataFrame:
    """Add confidence rank `conf` over all rows and `cost`; without a confidence column every conf is 0.5, with a warning."""
    if not has_column(raw, confidence):
        warnings.warn(f"no column {confidence!r}: all edges cost the same", stacklevel=2)
        ranked = raw.withColumn("conf", F.lit(0.5))
    else:
        ranked = rank_normalise(raw.withColumn("__c", F.coalesce(F.col(confidence).cast("double"), F.lit(0.0))), "__c", name="conf").drop("__c")
    return ranked.withColumn("cost", clamp(max_cost * (1 - F.col("conf")), min_cost, max_cost))


def collapse_reciprocal(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """One row per unordered pair: the cheapest, then the smallest (source, target); its columns survive."""
    w = Window.partitionBy(F.least(source, target), F.greatest(source, target)).orderBy("cost", source, target)
    return edges.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def cost_graph(raw: DataFrame, source: str = "source", target: str = "target", confidence: str = "confidence", min_cost: float = 0.05, max_cost: float = 1.0, drop_complexes: bool = False) -> DataFrame:
    """Undirected cost network (source, target, cost and whatever flags raw has) from raw records."""
    edges = edge_costs(clean_endpoints(raw, source, target, drop_complexes), confidence, min_cost, max_cost)
    kept = [F.col(c) for c in CARRIED if has_column(raw, c)]
    return collapse_reciprocal(edges, source, target).select(F.col(source).alias("source"), F.col(target).alias("target"), "cost", *kept)


def suggest_omega(prizes: DataFrame, quantile: float = 0.9, prize: str = "prize") -> DataFrame:
    """One row: the interpolated quantile of the positive prizes, 1 without any."""
    return quantiles(prizes.where(F.col(prize) > 0), prize, {"omega": quantile}).select(F.coalesce("omega", F.lit(1.0)).alias("omega"))


def nodes_of(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    return edges.select(F.col(source).alias("node")).unionByName(edges.select(F.col(target).alias("node"))).distinct()


def degrees(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    ends = edges.select(F.col(source).alias("node")).unionByName(edges.select(F.col(target).alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def biotype_coverage(genes: DataFrame, nodes: DataFrame, biotype: DataFrame) -> DataFrame:
    """Per biotype and for ALL: genes, those in the network, share. Genes count once; unmapped ones are `unknown`."""
    inside = nodes.select(F.col("node").alias("gene")).distinct().withColumn("__in", F.lit(1))
    rows = genes.select("gene").distinct().join(biotype.select("gene", "biotype").dropDuplicates(["gene"]), "gene", "left").join(inside, "gene", "left")
    rows = rows.select(F.coalesce("biotype", F.lit("unknown")).alias("biotype"), F.coalesce("__in", F.lit(0)).alias("hit"))
    rolled = rows.rollup("biotype").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("in_network"), F.grouping("biotype").alias("__all"))
    rolled = rolled.where("__all = 0 or n > 0")
    return rolled.select(F.when(F.col("__all") == 1, "ALL").otherwise(F.col("biotype")).alias("biotype"), "n", F.col("in_network").cast("long").alias("in_network"), (F.col("in_network") / F.col("n")).alias("coverage"))


def component_summary(edges: DataFrame, nodes: DataFrame | None = None, source: str = "source", target: str = "target") -> DataFrame:
    """One row: components, singletons, components of several nodes, size of the largest."""
    labels = connected_components(edges, source, target)
    if nodes is not None:
        labels = nodes.select("node").distinct().join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_components"), F.count_if(F.expr("size = 1")).alias("n_singletons"),
        F.count_if(F.expr("size > 1")).alias("n_multinode"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"),
    )


def component_sizes(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Sizes above 1, largest first."""
    sizes = connected_components(edges, source, target).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.where("size > 1").orderBy(F.desc("size"), "component")


def signed_edges(raw: DataFrame, source: str = "source", target: str = "target", unsigned: int = 0) -> DataFrame:
    """Cleaned directed edges with a sign; unsigned ones get the given value."""
    return clean_endpoints(raw, source, target).withColumn("sign", edge_sign("is_stimulation", "is_inhibition", unsigned))


def network_report(raw: DataFrame, edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """One row of sanity figures: nodes, edges, largest degree, cost range, directed and signed shares of the raw records."""
    share = lambda c: F.avg(c.cast("double"))
    s, i = string_bool("is_stimulation"), string_bool("is_inhibition")
    top = degrees(edges, source, target).agg(F.count(F.lit(1)).alias("n_nodes"), F.max("degree").alias("max_degree"))
    cost = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.min("cost").alias("min_cost"), F.max("cost").alias("max_cost"))
    flags = raw.agg(share(string_bool("is_directed")).alias("directed_share"), share(s != i).alias("signed_share"))
    return top.crossJoin(cost).crossJoin(flags)


def confident(edges: DataFrame, value: Column, quantile: float = 0.75) -> DataFrame:
    """Rows whose value is at or above its interpolated quantile; the threshold is one row, broadcast."""
    rows = edges.withColumn("__v", value)
    limit = quantiles(rows, "__v", {"__limit": quantile})
    return rows.join(F.broadcast(limit), F.col("__v") >= F.col("__limit")).drop("__v", "__limit")
