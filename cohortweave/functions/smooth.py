"""Local regression over all rows of a table: weighted lines at anchors, linear between them, with robustness rounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cohortweave.functions.ranks import counted_values, quantiles
from cohortweave.scratch import Scope, cut


def anchors_of(points: DataFrame, step: float) -> tuple[list[float], int]:
    """The smallest x and the largest of each step of the range of x, at most 1 / step + 2 of them, and the number of points."""
    n, low, high = points.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return [], 0
    width = (high - low) * step
    at = F.floor((F.col("x") - low) / width) if width > 0 else F.lit(0)
    return sorted({low, *(r["x"] for r in points.groupBy(at.alias("at")).agg(F.max("x").alias("x")).collect())}), n


def between(x: Column, knots: list[float], levels: list[float]) -> Column:
    """The piecewise linear function through knots at x, level beyond them; a search in a short array for each row."""
    if len(knots) == 1:
        return F.when(x.isNotNull(), F.lit(levels[0]))
    at = F.array(*[F.lit(float(k)) for k in knots])
    up = F.array(*[F.lit(float(v)) for v in levels])
    i = F.greatest(F.lit(1), F.least(F.lit(len(knots) - 1), F.size(F.filter(at, lambda k: k <= x))))
    a, b, u, v = F.element_at(at, i), F.element_at(at, i + 1), F.element_at(up, i), F.element_at(up, i + 1)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))
    return u + (v - u) * share


def local_regression(points: DataFrame, span: float = 0.5, rounds: int = 3, step: float = 0.01) -> tuple[list[float], list[float]]:
    """Knots and levels of a robust local line through points (x, y), NULLs left out.

    At each anchor a line is fitted to the share `span` of all points that is nearest, with tricube weights, and again `rounds` times
    with bisquare weights of the residuals. Every point counts in every fit: an anchor's sums are partial sums of the tasks. The
    driver holds the anchors alone, 1 / step + 2 at most. Ties in x count singly; where the points near an anchor have one x, their mean is taken.
    """
    with Scope():
        points = cut(points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null"), "smooth-points")
        knots, n = anchors_of(points, step)
        if not n:
            return [0.0], [1.0]
        spark, k = points.sparkSession, min(n, max(2, math.floor(span * n + 1e-7)))
        table = F.broadcast(spark.createDataFrame([(i, a) for i, a in enumerate(knots)], "anchor int, at double"))
        apart = counted_values(points.crossJoin(table).select("anchor", F.abs(F.col("x") - F.col("at")).alias("far")), ["far"], ["anchor"])
        reach = {r["anchor"]: r["h"] for r in apart.where(F.col("n_before") + F.col("n_equal") >= k).groupBy("anchor").agg(F.min("far").alias("h")).collect()}
        table = F.broadcast(spark.createDataFrame([(i, a, max(reach[i], 1e-12)) for i, a in enumerate(knots)], "anchor int, at double, h double"))
        levels: list[float] = []
        for round_ in range(rounds + 1):
            weight = F.lit(1.0)
            if round_:
                left = F.abs(F.col("y") - between(F.col("x"), knots, levels))
                rest = points.select(left.alias("left"))
                scale, mean = 6 * quantiles(rest, "left", {"m": 0.5}).first()["m"], rest.agg(F.avg("left")).first()[0]
                if scale <= 1e-7 * mean or scale == 0:
                    break
                weight = F.pow(F.greatest(F.lit(0.0), 1 - F.pow(left / scale, F.lit(2.0))), F.lit(2.0))
            d = F.col("x") - F.col("at")
            near = points.withColumn("robust", weight).join(table, F.abs(d) < F.col("h"))
            g = F.pow(1 - F.pow(F.abs(d) / F.col("h"), F.lit(3.0)), F.lit(3.0)) * F.col("robust")
            rows = near.select("anchor", "h", "y", d.alias("d"), g.alias("g")).groupBy("anchor", "h").agg(
                F.sum("g").alias("s"), F.sum(F.col("g") * F.col("d")).alias("sx"), F.sum(F.col("g") * F.col("y")).alias("sy"), F.sum(F.col("g") * F.col("d") * F.col("d")).alias("sxx"), F.sum(F.col("g") * F.col("d") * F.col("y")).alias("sxy")
            )
            found = {r["anchor"]: _at_zero(r) for r in rows.collect()}
            last = levels
            levels = [found[i] if found.get(i) is not None else (last[i] if last else 0.0) for i in range(len(knots))]
    return knots, levels


def _at_zero(r) -> float | None:
    """The line of an anchor's sums at the anchor; the mean where the points do not spread."""
    if not r["s"] > 0:
        return None
    det = r["s"] * r["sxx"] - r["sx"] ** 2
    slope = (r["s"] * r["sxy"] - r["sx"] * r["sy"]) / det if det > 1e-12 * (r["s"] * r["h"]) ** 2 else 0.0
    return (r["sy"] - slope * r["sx"]) / r["s"]


def local_regression_sql(points: str, span: float = 0.5, rounds: int = 3, step: float = 0.01) -> str:
    """The same for DuckDB: CTEs from a table of (x, y) to `smooth` (pos, level)."""
    parts = [
        f"sp AS MATERIALIZED (SELECT x, y FROM {points} WHERE x IS NOT NULL AND y IS NOT NULL), sn AS (SELECT count(*) AS n, min(x) AS low, max(x) AS high FROM sp)",
        f"sa AS MATERIALIZED (SELECT pos, row_number() OVER (ORDER BY pos) AS i FROM (SELECT low AS pos FROM sn UNION SELECT max(x) FROM sp, sn GROUP BY floor((x-low)/((high-low)*{step}::DOUBLE))))",
        f"sh AS MATERIALIZED (SELECT i, pos, greatest(d, 1e-12) AS h FROM (SELECT i, pos, abs(x-pos) AS d, row_number() OVER (PARTITION BY i ORDER BY abs(x-pos)) AS k FROM sp, sa), sn WHERE k=least(n, greatest(2, floor({span}::DOUBLE*n+1e-7))))",
        "w0 AS MATERIALIZED (SELECT x, y, 1.0::DOUBLE AS robust FROM sp)",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"f{r} AS MATERIALIZED (SELECT i, pos, CASE WHEN s*sxx-sx*sx>1e-12*(s*h)*(s*h) THEN (sy-(s*sxy-sx*sy)/(s*sxx-sx*sx)*sx)/s ELSE sy/s END AS level FROM (SELECT i, pos, h, sum(g) AS s, sum(g*d) AS sx, sum(g*y) AS sy, sum(g*d*d) AS sxx, sum(g*d*y) AS sxy"
            f" FROM (SELECT i, pos, h, y, x-pos AS d, pow(1-pow(abs(x-pos)/h,3),3)*robust AS g FROM w{r}, sh WHERE abs(x-pos)<h) GROUP BY 1,2,3))"
        )
        if r < rounds:
            parts.append(f"l{r} AS MATERIALIZED (SELECT i, pos, level, lead(pos) OVER (ORDER BY i) AS up, lead(level) OVER (ORDER BY i) AS above, count(*) OVER () AS c FROM f{r})")
            parts.append(f"g{r} AS MATERIALIZED (SELECT x, y, abs(y-(level+(above-level)*greatest(0,least(1,(x-pos)/(up-pos))))) AS e FROM sp JOIN l{r} ON pos<=x AND up IS NOT NULL AND (x<up OR i=c-1))")
            parts.append(f"w{r + 1} AS MATERIALIZED (SELECT x, y, pow(greatest(0, 1-pow(e/(6*m),2)),2) AS robust FROM g{r}, (SELECT quantile_cont(e,0.5) AS m FROM g{r}))")
    return ",\n".join(parts) + f",\nsmooth AS (SELECT pos, level FROM f{rounds})"
