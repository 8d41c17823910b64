"""Differential tests over long matrices (feature, sample, value), in closed form per feature.

Two-group and pair-blocked linear models need only sums per feature, so each is one grouped pass. The driver handles
a handful of scalars: the prior of the moderated variances, and about a hundred knots of the mean-variance trend, which all genes shape.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.functions.ranks import bh_adjust, quantiles
from cohortweave.functions.scalars import m_value, patient_of, sample_group
from cohortweave.functions.smooth import between, local_regression
from cohortweave.functions.special import digamma, inverse_trigamma, t_p_value, trigamma
from cohortweave.operators.evidence import complete_probes, patients_with_both, strongest
from cohortweave.scratch import cut


def design(samples: DataFrame, paired: bool = False, barcode: str = "barcode") -> DataFrame:
    """(sample, patient, grp) of the normal and tumour samples; when paired, of patients with both (at least 3, else an error)."""
    rows = samples.select(F.col(barcode).alias("sample"), patient_of(barcode).alias("patient"), sample_group(barcode).alias("grp")).where("grp <> 'other'").distinct()
    if not paired:
        return rows
    both = patients_with_both(samples, barcode)
    if both.limit(3).count() < 3:
        raise ValueError("fewer than 3 patients have a tumour and a normal sample")
    return rows.join(both, "patient", "left_semi").select("sample", "patient", "grp")


def _fit_means(rows: DataFrame, key: str, paired: bool) -> DataFrame:
    """key, effect, s2, df, scale, mean of weighted rows (key, patient, grp, y, w)."""
    if paired:
        side = lambda g, c: F.sum(F.when(F.col("grp") == g, c))
        wy = F.col("w") * F.col("y")
        per = rows.groupBy(key, "patient").agg(side("tumour", F.col("w")).alias("w1"), side("normal", F.col("w")).alias("w0"), side("tumour", wy).alias("s1"), side("normal", wy).alias("s0"), F.sum("y").alias("sy"), F.count(F.lit(1)).alias("n"))
        per = per.where("w1 is not null and w0 is not null").select(key, (F.col("w1") * F.col("w0") / (F.col("w1") + F.col("w0"))).alias("e"), (F.col("s1") / F.col("w1") - F.col("s0") / F.col("w0")).alias("d"), "sy", "n")
        g = per.groupBy(key).agg(F.sum("e").alias("se"), F.sum(F.col("e") * F.col("d")).alias("sd"), F.sum(F.col("e") * F.col("d") ** 2).alias("sdd"), (F.count(F.lit(1)) - 1).cast("double").alias("df"), (F.sum("sy") / F.sum("n")).alias("mean"))
        effect = F.col("sd") / F.col("se")
        return g.where("df > 0").select(key, effect.alias("effect"), (F.greatest(F.lit(0.0), F.col("sdd") - effect * F.col("sd")) / F.col("df")).alias("s2"), "df", (1 / F.col("se")).alias("scale"), "mean")
    cols = []
    for g in ("tumour", "normal"):
        for name, c in (("w", F.col("w")), ("y", F.col("w") * F.col("y")), ("yy", F.col("w") * F.col("y") ** 2), ("n", F.lit(1))):
            cols.append(F.sum(F.when(F.col("grp") == g, c)).alias(f"{name}_{g[0]}"))
    g = rows.groupBy(key).agg(*cols, F.avg("y").alias("mean")).where("n_t > 0 and n_n > 0 and n_t + n_n > 2")
    ss = sum(F.greatest(F.lit(0.0), F.col(f"yy_{c}") - F.col(f"y_{c}") ** 2 / F.col(f"w_{c}")) for c in "tn")
    df = (F.col("n_t") + F.col("n_n") - 2).cast("double")
    return g.select(key, (F.col("y_t") / F.col("w_t") - F.col("y_n") / F.col("w_n")).alias("effect"), (ss / df).alias("s2"), df.alias("df"), (1 / F.col("w_t") + 1 / F.col("w_n")).alias("scale"), "mean")


def variance_prior(fits: DataFrame) -> tuple[float, float]:
    """(d0, s0^2) of the scaled inverse chi-square that the variances come from; d0 may be infinite."""
    groups = fits.where("s2 > 0").groupBy("df").agg(F.count(F.lit(1)).alias("n"), F.avg(F.log("s2")).alias("m"), F.var_samp(F.log("s2")).alias("v")).collect()
    total = sum(r["n"] for r in groups)
    if total < 2:
        return 0.0, 1.0
    center = {r["df"]: digamma(r["df"] / 2) - math.log(r["df"] / 2) for r in groups}
    mean = sum(r["n"] * (r["m"] - center[r["df"]]) for r in groups) / total
    spread = sum((r["n"] - 1) * (r["v"] or 0.0) + r["n"] * (r["m"] - center[r["df"]] - mean) ** 2 for r in groups) / (total - 1)
    excess = spread - sum(r["n"] * trigamma(r["df"] / 2) for r in groups) / total
    if excess <= 1e-12:
        return math.inf, math.exp(mean)
    d0 = 2 * inverse_trigamma(excess)
    return d0, math.exp(mean + digamma(d0 / 2) - math.log(d0 / 2))


def moderated(fits: DataFrame) -> DataFrame:
    """Add t and p from variances shrunk towards their prior."""
    d0, s0 = variance_prior(fits)
    total = fits.agg(F.sum("df")).first()[0] or 0.0
    if math.isinf(d0):
        s2, df = F.lit(s0), F.lit(float(total))
    else:
        s2, df = (d0 * s0 + F.col("df") * F.col("s2")) / (d0 + F.col("df")), F.least(F.col("df") + d0, F.lit(float(total)))
    t = F.try_divide("effect", F.sqrt(s2 * F.col("scale")))
    return fits.withColumn("t", t).withColumn("p", t_p_value(F.col("t"), df))


def group_fits(beta: DataFrame, samples: DataFrame, paired: bool = False, barcode: str = "barcode") -> DataFrame:
    """Per probe the fit on M-values before its variance is moderated: effect, s2, df, scale and mean."""
    rows = complete_probes(cut(beta.join(design(samples, paired, barcode), "sample"), "diff-rows"))
    return _fit_means(rows.select("probe", "patient", "grp", m_value("beta").alias("y"), F.lit(1.0).alias("w")), "probe", paired)


def mean_difference(rows: DataFrame, key: str, value: str, group: str, one: str, other: str) -> DataFrame:
    """Per key the mean of value in group `one` less that in group `other`; NULL where a group has no value."""
    side = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    return rows.groupBy(key).agg((side(one) - side(other)).alias("delta"))


def diff_methylation(beta: DataFrame, samples: DataFrame, paired: bool = False, barcode: str = "barcode") -> DataFrame:
    """probe, delta_beta, padj, t: tests on M-values, effect as the difference of group means of beta.

    beta: probe, sample, beta in long form. Probes with a NULL in a used sample are dropped; the effect is unpaired in any design.
    """
    d = cut(design(samples, paired, barcode), "diff-design")
    # the measurements are worked out once, for the differences and for the fits
    rows = complete_probes(cut(beta.select("probe", "sample", "beta").join(d, "sample"), "diff-rows"))
    delta = mean_difference(rows, "probe", "beta", "grp", "tumour", "normal").withColumnRenamed("delta", "delta_beta")
    fits = cut(_fit_means(rows.select("probe", "patient", "grp", m_value("beta").alias("y"), F.lit(1.0).alias("w")), "probe", paired), "diff-fits")
    return bh_adjust(moderated(fits), "p", "padj").join(delta, "probe").select("probe", "delta_beta", "padj", "t")


def library_sizes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sample").agg(F.sum("count").cast("double").alias("lib"))


def expressed(counts: DataFrame, d: DataFrame, min_count: int = 10) -> DataFrame:
    """Genes with enough counts per million in as many samples as the smaller group has (softened above 10), and 15 counts in all."""
    lib = cut(library_sizes(counts), "diff-lib")
    sizes = [r["n"] for r in d.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()]
    if len(sizes) < 2:
        raise ValueError("samples of both groups are needed")
    least = min(sizes)
    need = least if least <= 10 else 10 + 0.7 * (least - 10)
    median = lib.agg(F.median("lib")).first()[0]
    cut_off = min_count * 1e6 / median
    rows = counts.join(lib, "sample").groupBy("gene_id").agg(F.count_if(F.col("count") / F.col("lib") * 1e6 >= cut_off).alias("k"), F.sum("count").alias("total"))
    return rows.where((F.col("k") >= need - 1e-14) & (F.col("total") >= 15)).select("gene_id")


def tmm_factors(counts: DataFrame) -> DataFrame:
    """(sample, lib, factor): trimmed mean of M-values against the sample of the most typical upper quartile, geometric mean 1."""
    lib = cut(library_sizes(counts), "tmm-lib")
    shares = counts.join(lib, "sample").withColumn("q", F.col("count") / F.col("lib"))
    upper = cut(quantiles(shares, "q", {"u": 0.75}, ["sample"]), "tmm-quartiles")
    ref = upper.crossJoin(F.broadcast(upper.agg(F.avg("u").alias("m")))).orderBy(F.abs(F.col("u") - F.col("m")), "sample").limit(1).select("sample").first()
    base = shares.where(F.col("sample") == ref["sample"]).select("gene_id", F.col("q").alias("rq"), F.col("count").alias("rc"), F.col("lib").alias("rl"))
    rows = shares.join(base, "gene_id").where("count > 0 and rc > 0")
    rows = rows.withColumn("m", F.log2(F.col("q") / F.col("rq"))).withColumn("a", F.log2(F.col("q") * F.col("rq")) / 2)
    rows = rows.withColumn("v", (F.col("lib") - F.col("count")) / F.col("lib") / F.col("count") + (F.col("rl") - F.col("rc")) / F.col("rl") / F.col("rc"))
    w = Window.partitionBy("sample")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rm", F.rank().over(w.orderBy("m"))).withColumn("ra", F.rank().over(w.orderBy("a")))
    inner = lambda r, share: (F.col(r) >= F.floor(F.col("n") * share) + 1) & (F.col(r) <= F.col("n") - F.floor(F.col("n") * share))
    f = rows.where(inner("rm", 0.3) & inner("ra", 0.05)).groupBy("sample").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("lf"))
    f = lib.join(f, "sample", "left").withColumn("lf", F.coalesce("lf", F.lit(0.0)))
    mean = f.agg(F.avg("lf").alias("mean"))
    return f.crossJoin(F.broadcast(mean)).select("sample", "lib", F.pow(F.lit(2.0), F.col("lf") - F.col("mean")).alias("factor"))


def mean_variance_trend(fits: DataFrame, shift: float) -> tuple[list[float], list[float]]:
    """Knots of the trend of sqrt(sd) on mean log count, a robust local line through all genes."""
    rows = fits.where("s2 > 0").select((F.col("mean") + shift).alias("x"), F.pow(F.col("s2"), F.lit(0.25)).alias("y"))
    knots, levels = local_regression(rows)
    return knots, [max(v, 1e-6) for v in levels]


def diff_expression(counts: DataFrame, samples: DataFrame, symbols: DataFrame | None = None, paired: bool = False, min_count: int = 10, barcode: str = "barcode") -> DataFrame:
    """gene, log2FC, padj, AveExpr, t of tumour against normal: filter, scale, precision weights, weighted model, moderated t.

    counts: gene_id, sample, count in long form; symbols: gene_id, symbol. One row per symbol, that of the strongest effect.
    """
    d = cut(design(samples, paired, barcode), "diff-design")
    used = counts.join(d.select("sample"), "sample", "left_semi")
    used = cut(used.join(expressed(used, d, min_count), "gene_id", "left_semi").select("gene_id", "sample", "count"), "diff-counts")
    scale = cut(tmm_factors(used).select("sample", (F.col("lib") * F.col("factor")).alias("size")), "diff-sizes")
    logs = used.join(scale, "sample").join(d, "sample").select("gene_id", "sample", "patient", "grp", "size", F.log2((F.col("count") + 0.5) / (F.col("size") + 1) * 1e6).alias("y"))
    first = cut(_fit_means(logs.withColumn("w", F.lit(1.0)), "gene_id", paired), "diff-first")
    shift = scale.agg(F.avg(F.log2(F.col("size") + 1))).first()[0] - math.log2(1e6)
    knots, levels = mean_variance_trend(first, shift)

    def weight(x: Column) -> Column:
        return F.pow(between(x, knots, levels), F.lit(-4.0))

    means = logs.groupBy("gene_id", *(["patient"] if paired else []), *([] if paired else ["grp"])).agg(F.avg("y").alias("__m"))
    if paired:
        effect = first.select("gene_id", "effect")
        fitted = logs.join(means, ["gene_id", "patient"]).join(effect, "gene_id").withColumn("f", F.col("__m") + F.when(F.col("grp") == "tumour", F.col("effect") / 2).otherwise(-F.col("effect") / 2))
    else:
        fitted = logs.join(means, ["gene_id", "grp"]).withColumn("f", F.col("__m"))
    weighted = fitted.withColumn("w", weight(F.col("f") + F.log2(F.col("size") + 1) - math.log2(1e6)))
    fits = cut(_fit_means(weighted.select("gene_id", "patient", "grp", "y", "w"), "gene_id", paired), "diff-fits")
    out = bh_adjust(moderated(fits), "p", "padj")
    out = out.join(symbols.select("gene_id", F.col("symbol").alias("gene")), "gene_id") if symbols is not None else out.withColumn("gene", F.col("gene_id"))
    out = out.where("gene is not null and gene <> ''").select("gene", F.col("effect").alias("log2FC"), "padj", F.col("mean").alias("AveExpr"), "t")
    return strongest(out, ["gene"], "log2FC", ["padj", "log2FC"])
