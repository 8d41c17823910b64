"""Activities and associations in closed form: univariate models, rank correlations, signed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.functions.ranks import average_rank, pearson, quantiles, windowed_rank
from cohortweave.functions.scalars import is_finite, sign
from cohortweave.functions.special import t_p_value, z_p_value
from cohortweave.scratch import cut, dealt


def activity(regulon: DataFrame, response: DataFrame, min_targets: int = 5, with_p: bool = False) -> DataFrame:
    """Per regulator: slope t of the response regressed on its weights (0 for non-targets), and n_targets.

    regulon: tf, target, mor; response: gene, y. One grouped pass gives sums of w, w^2 and w*y; sums of y are global.
    """
    y = response.where(is_finite("y")).select(F.col("gene").alias("target"), F.col("y").cast("double").alias("y"))
    edges = regulon.where("tf <> target and mor <> 0").dropDuplicates(["tf", "target"]).join(y, "target")
    m = F.col("mor").cast("double")
    per = edges.groupBy("tf").agg(F.count(F.lit(1)).alias("n_targets"), F.sum(m).alias("sw"), F.sum(m * m).alias("sww"), F.sum(m * F.col("y")).alias("swy")).where(F.col("n_targets") >= min_targets)
    all_ = y.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    rows = per.crossJoin(F.broadcast(all_))
    n = F.col("n").cast("double")
    cww, cwy, cyy = F.col("sww") - F.col("sw") * F.col("sw") / n, F.col("swy") - F.col("sw") * F.col("sy") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    rows = rows.withColumn("slope", F.try_divide(cwy, cww)).withColumn("se", F.sqrt(F.greatest(F.lit(0.0), F.try_divide((cyy - F.try_divide(cwy * cwy, cww)) / (n - 2), cww))))
    out = rows.withColumn("activity", F.try_divide("slope", "se"))
    return out.select("tf", "n_targets", "activity", t_p_value(F.col("activity"), F.col("n") - 2).alias("p")) if with_p else out.select("tf", "n_targets", "activity")


def paired_deltas(samples: DataFrame, key: str, value: str, patient: str = "patient", group: str = "grp") -> DataFrame:
    """(key, patient, delta) tumour minus normal, of the means per patient where both exist."""
    side = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    return samples.groupBy(key, patient).agg((side("tumour") - side("normal")).alias("delta")).where("delta is not null")


def cis_correlation(x: DataFrame, y: DataFrame, key: str, pair: str, least: int = 25, name: str = "rho") -> DataFrame:
    """Per key: Spearman correlation of x.value and y.value over shared pairs; NULL below `least` finite pairs."""
    rows = x.select(key, pair, F.col("value").alias("x")).join(y.select(key, pair, F.col("value").alias("y")), [key, pair]).where(is_finite("x") & is_finite("y"))
    # keys are dealt into partitions that do not grow with the table, so a task sorts a bounded number of rows
    rows = dealt(cut(rows, "cis-pairs"), key)
    ranked = rows.select(key, windowed_rank("x", [key]).alias("rx"), windowed_rank("y", [key]).alias("ry"))
    return ranked.groupBy(key).agg(pearson(F.col("rx"), F.col("ry")).alias("__rho"), F.count(F.lit(1)).alias("n")).select(key, F.when(F.col("n") >= least, F.col("__rho")).alias(name), "n")


def with_spearman_p(table: DataFrame, rho: str = "rho", n: str = "n", name: str = "p") -> DataFrame:
    """Add the two-sided p of a rank correlation by the t approximation."""
    r, df = F.col(rho), F.col(n) - 2
    t = F.try_divide(r * F.sqrt(df.cast("double")), F.sqrt(F.greatest(F.lit(0.0), 1 - r * r)))
    return table.withColumn(name, F.when(F.col(n) > 2, t_p_value(t, df)))


def partial_correlation(table: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """One row: correlation of the ranks of x and y with the rank of z taken out of both, and n."""
    rows = table.where(is_finite(x) & is_finite(y) & is_finite(z)).select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"))
    for c in "xyz":
        rows = average_rank(rows, c, name=f"r{c}")
    one = rows.agg(*[pearson(F.col(f"r{a}"), F.col(f"r{b}")).alias(a + b) for a, b in ("xy", "xz", "yz")], F.count(F.lit(1)).alias("n"))
    bottom = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("xz") ** 2)) * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("yz") ** 2))
    return one.select(F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), bottom).alias("rho"), "n")


def rank_regression(table: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """One row: t statistics of both predictors in the regression of rank(y) on rank(x1) and rank(x2)."""
    rows = table.where(is_finite(y) & is_finite(x1) & is_finite(x2)).select(F.col(y).alias("y"), F.col(x1).alias("a"), F.col(x2).alias("b"))
    for c in "yab":
        rows = average_rank(rows, c, name=f"r{c}")
    s = lambda p, q: (F.sum(F.col(f"r{p}") * F.col(f"r{q}")) - F.sum(f"r{p}") * F.sum(f"r{q}") / F.count(F.lit(1))).alias(p + q)
    one = rows.agg(*[s(p, q) for p, q in ("aa", "bb", "ab", "ay", "by", "yy")], F.count(F.lit(1)).alias("n"))
    det = F.col("aa") * F.col("bb") - F.col("ab") ** 2
    one = one.withColumn("b1", F.try_divide(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), det)).withColumn("b2", F.try_divide(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), det))
    s2 = (F.col("yy") - F.col("b1") * F.col("ay") - F.col("b2") * F.col("by")) / (F.col("n") - 3)
    return one.select(F.try_divide("b1", F.sqrt(F.greatest(F.lit(0.0), s2 * F.col("bb") / det))).alias("t1"), F.try_divide("b2", F.sqrt(F.greatest(F.lit(0.0), s2 * F.col("aa") / det))).alias("t2"), "n")


def ordered_means(table: DataFrame, key: str, order: str, values: dict[str, Column]) -> DataFrame:
    """(key, and the named means) with every sum made in the order of a column, so that its last bits do not depend on partitions and files.

    A running sum passes over the rows of a key, which may spill; none is gathered. NULL values are left out.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [c for name, x in values.items() for c in (F.sum(x).over(w).alias(f"__s_{name}"), F.count(x).over(w).alias(f"__n_{name}"))]
    last = table.select(key, F.struct(F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("__at"), *sums).alias("__r")).groupBy(key).agg(F.max("__r").alias("__r"))
    return last.select(key, *[F.try_divide(F.col(f"__r.__s_{name}"), F.col(f"__r.__n_{name}")).alias(name) for name in values])


def signed_rank(table: DataFrame, x: str, y: str, with_p: bool = False) -> DataFrame:
    """One row of the paired signed-rank test: n, v, z with tie and continuity correction (and p)."""
    rows = table.where(is_finite(x) & is_finite(y)).select((F.col(x) - F.col(y)).alias("d")).where("d <> 0")
    rows = average_rank(rows.withColumn("size", F.abs("d")), "size", name="r")
    ties = rows.groupBy("size").agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.coalesce(F.sum(F.col("t") ** 3 - F.col("t")), F.lit(0.0)).alias("ties"))
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("v")).crossJoin(ties)
    n = F.col("n").cast("double")
    off = F.col("v") - n * (n + 1) / 4
    out = one.withColumn("z", F.try_divide(off - sign(off) * 0.5, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)))
    return out.select("n", "v", "z", z_p_value(F.col("z")).alias("p")) if with_p else out.select("n", "v", "z")


def compare_variants(a: DataFrame, b: DataFrame, key: str = "tf", value: str = "activity") -> DataFrame:
    """One row: keys in both, share of equal signs, Spearman correlation."""
    rows = a.select(key, F.col(value).alias("va")).join(b.select(key, F.col(value).alias("vb")), key)
    ranked = average_rank(average_rank(rows, "va", name="ra"), "vb", name="rb")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.avg((sign("va") == sign("vb")).cast("double")).alias("sign_agreement"), pearson(F.col("ra"), F.col("rb")).alias("rho"))


def left_chain(tables: list[DataFrame], key: str) -> DataFrame:
    """Left joins of all tables on key; columns other than the key must be unique across them."""
    names = [c for t in tables for c in t.columns if c != key]
    if len(names) != len(set(names)):
        raise ValueError("columns repeat across the joined tables")
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "left")
    return out


def five_numbers(table: DataFrame, by: list[str], value: str) -> DataFrame:
    """Minimum, quartiles and maximum per group, interpolated."""
    counts = table.groupBy(*by).agg(F.count(value).alias("n"))
    return counts.join(quantiles(table, value, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}, by), by, "left")


def histogram(table: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per bin of equal width; the upper limit belongs to the last bin."""
    at = F.floor((F.col(value) - low) * bins / (high - low))
    rows = table.where(F.col(value).between(low, high)).select(F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def fitted_lines(table: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept per group."""
    return table.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


SEED_FILTERS = {
    "all": "true",
    "paired_nominal": "rho < -0.1 and p < 0.05",
    "loose": "rho < -0.1 and padj < 0.25",
    "strict": "rho < -0.2 and padj < 0.05",
}


def seed_quality(seeds: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """Per named filter: seeds, shares of hyper seeds that go down and hypo seeds that go up, and the gap of their mean effects.

    seeds: direction, effect, rho, p, padj. Each row is expanded to the filters it passes, so the table is read once.
    """
    names = F.array(*[F.when(F.coalesce(F.expr(e), F.lit(False)), F.lit(n)) for n, e in (filters or SEED_FILTERS).items()])
    rows = seeds.select("direction", "effect", F.explode(F.array_compact(names)).alias("filter"))
    hyper, hypo = F.col("direction") > 0, F.col("direction") < 0
    return rows.groupBy("filter").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(hyper, (F.col("effect") < 0).cast("double"))).alias("hyper_down"),
        F.avg(F.when(hypo, (F.col("effect") > 0).cast("double"))).alias("hypo_up"),
        (F.avg(F.when(hypo, F.col("effect"))) - F.avg(F.when(hyper, F.col("effect")))).alias("separation"),
    )


def top_per_group(table: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return table.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
