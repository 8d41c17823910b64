"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from cohortweave.scratch import Scope, cut, cut_counted

ROUNDS = 64
#: A table of at most so many edges takes its rounds as one plan each.
FEW = 10_000
#: Neighbours from which on a node is heavy: its edges are joined where they lie, or dealt over SALTS tasks.
HEAVY, SALTS = 1000, 64
#: Heavy nodes that a broadcast may have; beyond, every node's minimum is repeated for each salt.
MOST_HEAVY = 200_000


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _lowest(rows: DataFrame) -> DataFrame:
    """Each node's smallest neighbour m and its number of neighbours."""
    return rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))


def _with_low(rows: DataFrame, low: DataFrame, heavy: int) -> DataFrame:
    """rows joined to the m of their node a."""
    if not heavy:
        return rows.join(low.select("a", "m"), "a")
    if heavy <= MOST_HEAVY:
        split = rows.join(F.broadcast(low.where(F.col("n") > HEAVY).select("a", F.col("m").alias("hm"))), "a", "left")
        light = split.where("hm is null").drop("hm").join(low.where(F.col("n") <= HEAVY).select("a", "m"), "a")
        return light.unionByName(split.where("hm is not null").withColumnRenamed("hm", "m"))
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    copies = low.select("a", "m").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", salt).join(copies, ["a", "__salt"]).drop("__salt")


def _round(edges: DataFrame, cut_low) -> DataFrame:
    """A large star and a small star over edges (a > b). Every node hands its larger neighbours to the smallest node that it knows;
    then its smaller neighbours, and itself, to the smallest of them."""
    both = _neighbours(edges)
    low, heavy = cut_low(_lowest(both))
    large = _with_low(both.where("b > a"), low.withColumn("m", F.least("a", "m")), heavy).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    large = large if heavy is None else cut(large, "components-large")
    low, heavy = cut_low(_lowest(large))
    handed = _with_low(large, low, heavy).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _cut_low(low: DataFrame) -> tuple[DataFrame, int]:
    seen = Observation()
    held = cut(low.observe(seen, F.count_if(F.col("n") > HEAVY).alias("heavy")), "components-low")
    return held, seen.get["heavy"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge table; the component is its smallest node.

    NULL ends and self-loops are ignored, repeated edges count once. Each round is joins, minima and a distinct, cut to a
    shared table, after which the round before is deleted; the driver sees two numbers per round. Stops when a round
    changes nothing, where every edge joins a node to its component; the number of rounds grows with the logarithm of
    the longest path. The centre of a star may own most edges: its edges are never joined in one task.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    now = ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    with Scope() as scope:
        now, n, mark = cut_counted(now.distinct(), "components", ("a", "b"))
        for _ in range(ROUNDS):
            if not n:
                break
            with Scope() as round_:
                step = _round(now, _cut_low if n > FEW else lambda low: (low, None))
                after, n, seen = cut_counted(step, "components", ("a", "b"))
                round_.keep(after)
            scope.free(now)
            now = after
            if seen == mark:
                break
            mark = seen
        else:
            raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
        scope.keep(now)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
