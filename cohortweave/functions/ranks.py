"""Ranks, bins and multiple-testing adjustment over whole tables or per group.

A rank never goes through one partition, be it over a whole table or in a group that holds most of one: values are
counted, the counts are range-partitioned, and each range adds the total of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.scratch import cut


def counted_values(df: DataFrame, value: list[str], by: list[str] | None = None, marks: tuple[str, ...] = ()) -> DataFrame:
    """Distinct values (per group) in ascending order with n_equal, n_before and n_total; NULL values are left out.

    For each of the boolean columns `marks`, the same three of the rows where it is true (n_equal_<mark> and so on).
    """
    by = by or []
    known = df
    for c in value:
        known = known.where(F.col(c).isNotNull())
    of = ["", *[f"_{m}" for m in marks]]
    counts = known.groupBy(*by, *value).agg(F.count(F.lit(1)).alias("n_equal"), *[F.count_if(m).alias(f"n_equal_{m}") for m in marks])
    key = [*by, "__range"]
    dealt = cut(counts.repartitionByRange(*by, *value).withColumn("__range", F.spark_partition_id()), "ranks")
    # a group may span ranges: each adds what its group has in the ranges before it
    sums = dealt.groupBy(*key).agg(*[F.sum(f"n_equal{m}").alias(f"__n{m}") for m in of])
    if by:
        group = Window.partitionBy(*by)
        earlier = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added = [c for m in of for c in ((F.sum(f"__n{m}").over(earlier) - F.col(f"__n{m}")).alias(f"__offset{m}"), F.sum(f"__n{m}").over(group).alias(f"n_total{m}"))]
        offsets = sums.select(*key, *added)
        ranked = dealt.join(offsets, (dealt["__range"] == offsets["__range"]) & _same(dealt, offsets, by)).select(dealt["*"], *[c for m in of for c in (f"__offset{m}", f"n_total{m}")])
    else:
        before, total = [], [0] * len(of)
        for r in sorted(sums.collect(), key=lambda r: r["__range"]):
            before.append((r["__range"], *total))
            total = [t + r[f"__n{m}"] for t, m in zip(total, of)]
        offsets = df.sparkSession.createDataFrame(before, ", ".join(["__range int", *[f"__offset{m} long" for m in of]]))
        ranked = dealt.join(F.broadcast(offsets), "__range").select("*", *[F.lit(t).cast("long").alias(f"n_total{m}") for t, m in zip(total, of)])
    upto = Window.partitionBy(*key).orderBy(*value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = [(f"n_equal{m}", (F.sum(f"n_equal{m}").over(upto) - F.col(f"n_equal{m}") + F.col(f"__offset{m}")).alias(f"n_before{m}"), f"n_total{m}") for m in of]
    return ranked.select(*by, *value, *[c for three in ends for c in three])


def _same(x: DataFrame, y: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & x[c].eqNullSafe(y[c])
    return out


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Interpolated quantiles of a column, per group: a column for each named share, from counted ranks and not from a buffer of values.

    NULL values are left out; a group without any has no row, and a table without any gives one row of NULLs.
    """
    by = by or []
    at = lambda q: (F.col("n_total") - 1) * F.lit(float(q))
    holds = lambda place: (F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n_equal"))
    ends = []
    for name, q in shares.items():
        ends += [F.max(F.when(holds(F.floor(at(q))), F.col(value))).alias(f"__l_{name}"), F.max(F.when(holds(F.ceil(at(q))), F.col(value))).alias(f"__h_{name}")]
    ranked = counted_values(df.select(*by, F.col(value).cast("double").alias(value)), [value], by)
    found = ranked.groupBy(*by).agg(F.max("n_total").alias("n_total"), *ends)
    mixed = [(F.col(f"__l_{n}") + (F.col(f"__h_{n}") - F.col(f"__l_{n}")) * (at(q) - F.floor(at(q)))).alias(n) for n, q in shares.items()]
    return found.select(*by, *mixed)


def average_rank(df: DataFrame, value: str, by: list[str] | None = None, name: str = "rank", normalise: bool = False) -> DataFrame:
    """Add the ascending rank of value, ties sharing their mean; with normalise, divided by the number of values.

    NULL values have a NULL rank.
    """
    rank = F.col("n_before") + (F.col("n_equal") + 1).cast("double") / 2.0
    ranks = counted_values(df, [value], by).select(*(by or []), value, (rank / F.col("n_total") if normalise else rank).alias(name))
    return df.join(ranks, [*(by or []), value], "left")


def rank_normalise(df: DataFrame, value: str, by: list[str] | None = None, name: str = "score") -> DataFrame:
    """Average-tie rank over the number of values, in (0, 1]; all-equal values get (n + 1) / 2n."""
    return average_rank(df, value, by, name, normalise=True)


def windowed_rank(value: Column | str, by: list[str], normalise: bool = False) -> Column:
    """The same per group as a window expression, for groups that fit one task."""
    value = F.col(value) if isinstance(value, str) else value
    same, all_ = Window.partitionBy(*by, value), Window.partitionBy(*by)
    rank = F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(same) - 1).cast("double") / 2.0
    return rank / F.count(F.lit(1)).over(all_) if normalise else rank


def equal_width_bin(rank: Column, n: Column, bins: int) -> Column:
    """Bin 1..bins of a rank 1..n: right-closed breaks of equal width between 1 and n."""
    return F.greatest(F.lit(1), F.ceil(F.try_divide(bins * (rank - 1).cast("double"), (n - 1).cast("double")))).cast("int")


def rank_bins(df: DataFrame, value: str, key: str, bins: int = 10, name: str = "bin") -> DataFrame:
    """Add the rank of (value, key), of which every row has one of its own, and the rank's bin. One row has bin 1."""
    ranks = counted_values(df, [value, key])
    bin_ = F.coalesce(equal_width_bin(F.col("n_before") + 1, F.col("n_total"), bins), F.lit(1))
    return df.join(ranks.select(value, key, (F.col("n_before") + 1).alias("rank"), bin_.alias(name)), [value, key], "left")


def bh_adjust(df: DataFrame, p: str = "p", name: str = "padj", by: list[str] | None = None) -> DataFrame:
    """Add Benjamini-Hochberg adjusted p-values: the smallest of p_j n / j over ranks j at or above, at most 1.

    A group may hold any share of the table: its p-values lie in ranges, and each takes the least of the ranges after it. Rows with a
    NULL p have none.
    """
    by = by or []
    raw = (F.col(p) * F.col("n_total") / (F.col("n_before") + F.col("n_equal"))).alias("__raw")
    ranks = counted_values(df, [p], by).select(*by, p, raw)
    dealt = cut(ranks.repartitionByRange(*by, p).withColumn("__range", F.spark_partition_id()), "bh")
    lows = dealt.groupBy(*by, "__range").agg(F.min("__raw").alias("__low"))
    if by:
        later = Window.partitionBy(*by).orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
        rest = lows.select(*by, "__range", F.least(F.lit(1.0), F.min("__low").over(later)).alias("__after"))
        ranged = dealt.join(rest, (dealt["__range"] == rest["__range"]) & _same(dealt, rest, by)).select(dealt["*"], "__after")
    else:
        after, low = [], 1.0
        for r in sorted(lows.collect(), key=lambda r: -r["__range"]):
            after.append((r["__range"], low))
            low = min(low, r["__low"])
        ranged = dealt.join(F.broadcast(df.sparkSession.createDataFrame(after, "__range int, __after double")), "__range")
    above = Window.partitionBy(*by, "__range").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = ranged.select(*by, p, F.least("__after", F.min("__raw").over(above)).alias(name))
    if not by:
        return df.join(adjusted, p, "left")
    return df.join(adjusted, (df[p] == adjusted[p]) & _same(df, adjusted, by), "left").select(df["*"], adjusted[name])


def pearson(x: Column, y: Column) -> Column:
    """Correlation from sums in an aggregation; NULL where a side has no variance. Rows with a NULL side must be filtered before."""
    n = F.count(F.lit(1))
    sx, sy = F.sum(x), F.sum(y)
    cov, vx, vy = n * F.sum(x * y) - sx * sy, n * F.sum(x * x) - sx * sx, n * F.sum(y * y) - sy * sy
    return F.when((vx > 1e-9) & (vy > 1e-9), F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None, name: str = "rho") -> DataFrame:
    """Spearman correlation per group (or of the table): rho and n, from rows where both are finite numbers.

    Equal pairs are counted first. The values of both sides are ranked in one table, by ranges, so a group may hold any share of the rows.
    """
    from cohortweave.functions.scalars import is_finite

    by = by or []
    fields = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
    keys = [f"__by{i}" for i in range(len(by))]
    known = df.where(is_finite(F.col(x).cast("double")) & is_finite(F.col(y).cast("double")))
    rows = known.select(*fields, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("v")) for c in ("__x", "__y")]))
    values = counted_values(rows.select(*keys, sides.alias("s")).select(*keys, F.col("s.of").alias("__of"), F.col("s.v").alias("__v")), ["__v"], [*keys, "__of"])
    ranked = cut(values.select(*keys, "__of", "__v", (F.col("n_before") + (F.col("n_equal") + 1).cast("double") / 2.0).alias("__rank")), "spearman-ranks")
    pairs = rows.groupBy(*keys, "__x", "__y").agg(F.count(F.lit(1)).cast("double").alias("__n"))
    for c in ("__x", "__y"):
        side = ranked.where(F.col("__of") == c).select(*[F.col(k).alias(f"{k}_r") for k in keys], F.col("__v"), F.col("__rank").alias(f"__r{c}"))
        on = F.col(c) == F.col("__v")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}_r"))
        pairs = pairs.join(side, on).drop("__v", *[f"{k}_r" for k in keys])
    n, u, v, w = F.sum("__n"), F.col("__r__x"), F.col("__r__y"), F.col("__n")
    su, sv = F.sum(w * u), F.sum(w * v)
    cov, vu, vv = n * F.sum(w * u * v) - su * sv, n * F.sum(w * u * u) - su * su, n * F.sum(w * v * v) - sv * sv
    rho = F.when((vu > 1e-9) & (vv > 1e-9), F.try_divide(cov, F.sqrt(vu) * F.sqrt(vv)))
    return pairs.groupBy(*keys).agg(rho.alias(name), F.coalesce(n, F.lit(0.0)).cast("long").alias("n")).select(*[F.col(k).alias(c) for k, c in zip(keys, by)], name, "n")
