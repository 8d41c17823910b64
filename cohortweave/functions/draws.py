"""Permutations of any range by plain integer arithmetic, the same in every engine and for every partitioning.

A swap-or-not network: each round pairs x with k - x mod n, k drawn for the round, and a bit drawn for the pair says if they change
places. Every round, and so the whole, is a permutation of 0..n-1 for any n, without walking along cycles and without a sort.
Draws are squares modulo a prime below 2**31, so that nothing exceeds 63 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.scratch import cut, cut_counted

PRIME = 2_147_483_647
ROUNDS = 24
#: Draws of a partition.
DRAWS = 100_000


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def _permuted(x: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    x, n, key = x.to_numpy(), n.to_numpy(), key.to_numpy()
    for r in range(1, ROUNDS + 1):
        k = (key * 31 + r * 1_299_709 + 12_345) % PRIME
        k = (k * k + k * 69_621 + 1) % PRIME
        other = (k + n - x) % n
        z = (np.maximum(x, other) + k) % PRIME
        z = (z * z + z * 16_807 + k) % PRIME
        z = (z * z + z * 48_271 + 11) % PRIME
        x = np.where(z // 32_768 % 2 == 1, other, x)
    return pd.Series(x)


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Where x of 0..n-1 goes in the permutation of a key (0 to 2**31 - 2); n at most 2**31 - 1."""
    return F.pandas_udf(_permuted, "long")(x.cast("long"), n.cast("long"), key.cast("long"))


def permuted_sql(x: str, n: str, key: str) -> str:
    """The same for DuckDB; x, n and key are columns."""
    keys = f"list_transform(list_transform(range(1,{ROUNDS + 1}), lambda r: ({key}*31+r*1299709+12345)%{PRIME}), lambda k: (k*k+k*69621+1)%{PRIME})"
    first = f"list_transform([(greatest(s,(k+{n}-s)%{n})+k)%{PRIME}], lambda z: (z*z+z*16807+k)%{PRIME})"
    second = f"list_transform({first}, lambda z: (z*z+z*48271+11)%{PRIME})[1]"
    return f"list_reduce(list_concat([{x}::BIGINT], {keys}), lambda s, k: CASE WHEN ({second}//32768)%2=1 THEN (k+{n}-s)%{n} ELSE s END)"


def draw_key(seed: int, run: Column, group: Column) -> Column:
    """A key from a seed, a run and a small group number."""
    return _let((F.lit(seed) * 7_919 + run.cast("long") * 104_729 + group.cast("long") * 15_485_863) % PRIME, lambda k: (k * k + k * 48_271 + 7) % PRIME)


def draw_key_sql(seed: int, run: str, group: str) -> str:
    k = f"(({seed * 7919}+({run})*104729+({group})*15485863)%{PRIME})"
    return f"(({k}*{k}+{k}*48271+7)%{PRIME})"


def placed_in_bins(binned: DataFrame) -> DataFrame:
    """binned (node, bin, rank from 1) with the node's place in its bin, from 0, and the bin's size; bins are runs of ranks."""
    sizes = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("bin", "size", before.alias("before"))
    return binned.join(F.broadcast(starts), "bin").select("node", "bin", (F.col("rank") - 1 - F.col("before")).alias("place"), "size")


def permuted_nodes(binned: DataFrame, held: DataFrame, runs: int, seed: int) -> DataFrame:
    """held (node, and further columns) for runs 1..runs, each row at the node of its bin that its node goes to.

    binned: node, bin, rank (rank_bins with its rank); nodes outside are dropped. Rows are those of held times the runs;
    a bin is neither sorted nor gathered. Rows are dealt out before they are drawn, a bounded number of draws in a partition.
    """
    places = cut(placed_in_bins(binned), "draws-places")
    placed, n, _ = cut_counted(held.join(places, "node"), "draws-held")
    rows = placed.repartition(max(1, math.ceil(n * runs / DRAWS)), "node").withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    moved = rows.withColumn("place", permuted(F.col("place"), F.col("size"), draw_key(seed, F.col("run"), F.col("bin")))).drop("node", "size")
    # Spark does not count the rows that explode makes, so it would broadcast all draws: the places are built into tables by partition instead
    at = places.select("node", "bin", "place").hint("shuffle_hash")
    return moved.join(at, ["bin", "place"]).select("run", *held.columns)
