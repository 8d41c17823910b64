"""From assay tables to prizes: designs, probe filters, rank scores, concordance, one prize per gene."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from cohortweave.functions.ranks import rank_normalise
from cohortweave.functions.scalars import concordance, has_column, patient_of, sample_group, sample_type_of, sign, split_fields
from cohortweave.scratch import dealt

#: Region labels and chromosome names as annotations spell them.
PROMOTER = ("TSS1500", "TSS200", "5'UTR", "1stExon", "promoter")
BODY = ("Body", "3'UTR", "ExonBnd", "body")
SEX_CHROMOSOMES = ("chrX", "chrY", "X", "Y")


@dataclass(frozen=True)
class PrizeConfig:
    w_expr: float = 1.0
    w_prom: float = 1.0
    w_body: float = 0.4
    w_conc: float = 1.5
    beta: float = 1.0


def strongest(df: DataFrame, key: list[str], effect: str, ties: list[str]) -> DataFrame:
    """The row of largest absolute effect per key; ties go to the smallest of the tie columns."""
    w = Window.partitionBy(*key).orderBy(F.abs(F.col(effect)).desc(), *[F.col(t).asc_nulls_last() for t in ties])
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def dedup_aliquots(samples: DataFrame, barcode: str = "barcode", position: str | None = None) -> DataFrame:
    """One sample per patient and sample type: the one whose barcode sorts first. With a position column, in the order that it gives."""
    w = Window.partitionBy(patient_of(barcode), sample_type_of(barcode)).orderBy(barcode)
    out = samples.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
    return out if position is None else out.orderBy(position)


def annotation_or(primary: DataFrame, fallback: DataFrame, probe: str = "probe", region: str = "regions") -> DataFrame:
    """Annotation by probe: the primary table's row, field by field the fallback's where the primary has none or an empty one.

    Without a single region label methylation evidence would be zero unseen, so that is an error.
    """
    fields = [c for c in primary.columns if c != probe]
    a, b = primary.alias("a"), fallback.alias("b")
    named = lambda side, c: F.nullif(F.col(f"{side}.{c}").cast("string"), F.lit(""))
    both = a.join(b, F.col(f"a.{probe}") == F.col(f"b.{probe}"), "full")
    out = both.select(F.coalesce(f"a.{probe}", f"b.{probe}").alias(probe), *[F.coalesce(named("a", c), named("b", c)).alias(c) if c in fallback.columns else F.col(f"a.{c}").alias(c) for c in fields])
    if out.where(F.col(region).isNotNull()).isEmpty():
        raise ValueError(f"no probe has a region label: column {region} is empty in both annotations")
    return out


def warn_if_empty(df: DataFrame, message: str) -> DataFrame:
    """df as it is; a warning when it has no row, since empty evidence makes empty prizes without an error."""
    if df.isEmpty():
        warnings.warn(message, stacklevel=2)
    return df


def patients_with_both(samples: DataFrame, barcode: str = "barcode") -> DataFrame:
    """Patients that have a tumour and a normal sample."""
    rows = samples.select(patient_of(barcode).alias("patient"), sample_group(barcode).alias("grp"))
    return rows.where("grp <> 'other'").groupBy("patient").agg(F.count_distinct("grp").alias("n")).where("n = 2").select("patient")


def summarise_design(expression: DataFrame, methylation: DataFrame, barcode: str = "barcode") -> DataFrame:
    """One row: tumours and normals per assay, complete pairs per assay, patients with tumours in both."""

    def sides(samples: DataFrame, name: str) -> DataFrame:
        rows = samples.select(patient_of(barcode).alias("patient"), sample_group(barcode).alias("grp"))
        per = rows.groupBy("patient").agg(F.count_if(F.col("grp") == "tumour").alias("t"), F.count_if(F.col("grp") == "normal").alias("n"))
        return per.select("patient", F.lit(name).alias("assay"), "t", "n")

    each = sides(expression, "expr").unionByName(sides(methylation, "meth"))
    per = each.groupBy("patient").agg(*[F.sum(F.when(F.col("assay") == a, F.col(c)).otherwise(0)).alias(f"{a}_{c}") for a in ("expr", "meth") for c in ("t", "n")])
    return per.agg(
        F.coalesce(F.sum("expr_t"), F.lit(0)).alias("expr_tumour"), F.coalesce(F.sum("expr_n"), F.lit(0)).alias("expr_normal"),
        F.coalesce(F.sum("meth_t"), F.lit(0)).alias("meth_tumour"), F.coalesce(F.sum("meth_n"), F.lit(0)).alias("meth_normal"),
        F.count_if(F.expr("expr_t > 0 and expr_n > 0")).alias("expr_pairs"), F.count_if(F.expr("meth_t > 0 and meth_n > 0")).alias("meth_pairs"),
        F.count_if(F.expr("expr_t > 0 and meth_t > 0")).alias("both_tumour"),
    )


def filter_probes(probes: DataFrame, annotation: DataFrame, probe: str = "probe", chromosome: str = "chr", bad: DataFrame | None = None, drop_sex: bool = True) -> DataFrame:
    """Rows of probes without those on sex chromosomes (if the annotation says) or in a list of bad probes."""
    out = probes
    if drop_sex and has_column(annotation, chromosome):
        out = out.join(annotation.where(F.col(chromosome).isin(*SEX_CHROMOSOMES)).select(probe).distinct(), probe, "left_anti")
    return out if bad is None else out.join(bad.select(probe).distinct(), probe, "left_anti")


def complete_probes(beta_long: DataFrame, probe: str = "probe", value: str = "beta") -> DataFrame:
    """Rows of probes that have no NULL in any sample. Rows are dealt once, into partitions that do not grow with the table."""
    known = dealt(beta_long.where(F.col(probe).isNotNull()), probe).withColumn("__none", F.count_if(F.col(value).isNull()).over(Window.partitionBy(probe)))
    return known.where("__none = 0").drop("__none")


def unpack_annotation(annotation: DataFrame, probe: str = "probe", genes: str = "genes", regions: str = "regions") -> DataFrame:
    """(probe, gene, region), distinct, from two packed columns whose fields stand in pairs.

    Probes with unequal numbers of fields, or none, and pairs without a gene are left out.
    """
    g, r = split_fields(genes), split_fields(regions)
    rows = annotation.select(F.col(probe).alias("probe"), g.alias("gene"), r.alias("region")).where((F.size("gene") > 0) & (F.size("gene") == F.size("region")))
    # a probe's rows lie in one small partition, where its pairs are told apart without another shuffle
    pairs = dealt(rows, "probe", rows=100_000).select("probe", F.inline(F.arrays_zip("gene", "region")))
    return pairs.where("gene is not null and gene <> ''").dropDuplicates(["probe", "gene", "region"])


def mismatched_probes(annotation: DataFrame, genes: str = "genes", regions: str = "regions") -> DataFrame:
    """One row: how many annotated probes were left out for unequal numbers of fields."""
    return annotation.agg(F.count_if((F.size(split_fields(genes)) != F.size(split_fields(regions))) | (F.size(split_fields(genes)) == 0)).alias("dropped"))


def annotate_probes(dm: DataFrame, annotation: DataFrame, probe: str = "probe", genes: str = "genes", regions: str = "regions") -> DataFrame:
    """Gene and region for each tested probe: gene, region, delta_beta, padj, probe."""
    tested = annotation.join(dm.select(F.col("probe").alias(probe)), probe, "left_semi")
    return unpack_annotation(tested, probe, genes, regions).join(dm, "probe").select("gene", "region", "delta_beta", "padj", "probe")


def expression_scores(de: DataFrame, gene: str = "gene", effect: str = "log2FC", padj: str = "padj", padj_cutoff: float = 0.05, effect_cutoff: float = 0.0) -> DataFrame:
    """gene, expr_score, expr_direction: rank of the absolute effect among genes that pass both cutoffs."""
    rows = de.select(F.col(gene).alias("gene"), F.col(effect).alias("e"), F.col(padj).alias("p")).dropna()
    rows = strongest(rows.where((F.col("p") <= padj_cutoff) & (F.abs("e") >= effect_cutoff)), ["gene"], "e", ["p", "e"])
    ranked = rank_normalise(rows.withColumn("size", F.abs("e")), "size", name="expr_score")
    return ranked.select("gene", "expr_score", sign("e").alias("expr_direction"))


def methylation_scores(dmr: DataFrame, gene: str = "gene", region: str = "region", effect: str = "delta_beta", padj: str = "padj", padj_cutoff: float = 0.05, min_delta: float = 0.1, promoter=PROMOTER, body=BODY) -> DataFrame:
    """gene with score and direction for promoter and body regions, each ranked in its own context."""
    context = F.when(F.col("region").isin(*promoter), "prom").when(F.col("region").isin(*body), "body")
    rows = dmr.select(F.col(gene).alias("gene"), F.col(region).alias("region"), F.col(effect).alias("e"), F.col(padj).alias("p")).dropna(subset=["gene", "e", "p"])
    rows = rows.where((F.col("p") <= padj_cutoff) & (F.abs("e") >= min_delta)).withColumn("context", context).where("context is not null")
    rows = strongest(rows, ["gene", "context"], "e", ["p", "region", "e"])
    ranked = rank_normalise(rows.withColumn("size", F.abs("e")), "size", by=["context"], name="s")
    return ranked.groupBy("gene").agg(*[F.max(F.when(F.col("context") == c, v)).alias(f"{c}_{n}") for c in ("prom", "body") for n, v in (("score", F.col("s")), ("direction", sign("e")))])


def build_prizes(expression: DataFrame, methylation: DataFrame, config: PrizeConfig = PrizeConfig()) -> DataFrame:
    """Full outer join of both score tables with concordance and prize; every component column stays."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    merged = expression.join(methylation, "gene", "full")
    merged = merged.withColumn("concordance", concordance("expr_score", "expr_direction", "prom_score", "prom_direction", "body_score", "body_direction"))
    prize = config.w_expr * z("expr_score") + config.w_prom * z("prom_score") + config.w_body * z("body_score") + config.w_conc * F.col("concordance")
    return merged.withColumn("prize", config.beta * prize)


def prize_vector(prizes: DataFrame) -> DataFrame:
    return prizes.where("prize > 0").select("gene", "prize")


def coding_only(table: DataFrame, biotype: DataFrame, gene: str = "gene", allowed=("protein_coding",)) -> DataFrame:
    """Rows whose gene has an allowed biotype; apply before ranking, so that ranks are among these genes."""
    return table.join(biotype.where(F.col("biotype").isin(*allowed)).select(gene).distinct(), gene, "left_semi")

