"""Signed directed propagation, its scores and its degree-matched null, as joins and sums.

A `run` column lets one plan carry any number of seed sets, so a null of hundreds of shuffles is one job.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from cohortweave.functions.draws import permuted_nodes
from cohortweave.functions.ranks import counted_values, quantiles, rank_bins
from cohortweave.functions.scalars import sign
from cohortweave.scratch import Scope, cut, cut_counted


#: Entries of a row of a matrix, or of a column, that are joined in one place; a hub's are dealt over blocks of as many.
HEAVY = 10_000
#: States (nodes times runs), sources and entries of the matrix in a block of a product of many runs, and the fewest blocks.
CELLS, SOURCES, ENTRIES, BLOCKS = 16_000_000, 400_000, 6_000_000, 24
#: Entries that a task multiplies at a time.
SLICE = 16_384
#: Networks of a grid whose entries stand in columns of one row, and seed sets whose states do.
WIDE = 4


def dealt_by(matrix: DataFrame, keys: list[str], by: str) -> tuple[DataFrame, DataFrame]:
    """matrix with the block of each entry among those with equal keys, by the hash of `by`, and the hubs (keys, blocks) with more than one."""
    hubs = matrix.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / HEAVY).cast("int").alias("blocks")).where("blocks > 1")
    hubs = cut(hubs, "matrix-hubs")
    block = F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")).otherwise(0)
    # hubs are few, at most an entry in HEAVY: Spark broadcasts them or splits the join, by their size
    return matrix.join(hubs, keys, "left").withColumn("block", block).drop("blocks"), hubs


def for_blocks(rows: DataFrame, hubs: DataFrame, keys: list[str]) -> DataFrame:
    """rows with a block of their keys each: those of a hub once for every block."""
    blocks = F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)
    return rows.join(hubs, keys, "left").withColumn("block", F.explode(blocks)).drop("blocks")


def signed_matrix(edges: DataFrame, source: str = "source", target: str = "target", sign_: str = "sign", weight: str | None = None) -> DataFrame:
    """(source, target, w): sums of sign * weight over directed pairs; no self-loops, unsigned edges or zero sums."""
    s, t = F.col(source), F.col(target)
    w = F.col(sign_) * (F.col(weight) if weight else F.lit(1.0))
    rows = edges.where(s.isNotNull() & t.isNotNull() & (s != t) & (F.col(sign_) != 0))
    return rows.groupBy(s.alias("source"), t.alias("target")).agg(F.sum(w.cast("double")).alias("w")).where("w <> 0")


def induced(matrix: DataFrame, nodes: DataFrame) -> DataFrame:
    """The entries with both ends among nodes."""
    keep = nodes.select("node").distinct()
    return matrix.join(keep.withColumnRenamed("node", "source"), "source", "left_semi").join(keep.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target", "w")


def normalised(matrix: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Entries over the sum of absolute entries into their target (in their group). The entries of a hub are not joined in one place."""
    keys = [*(groups or []), "target"]
    total = matrix.groupBy(*keys).agg(F.sum(F.abs("w")).alias("total"))
    dealt, hubs = dealt_by(matrix, keys, "source")
    met = dealt.join(for_blocks(total, hubs, keys), [*keys, "block"])
    return met.select(*(groups or []), "source", "target", (F.col("w") / F.col("total")).alias("w"))


def _block_sizes(nodes: int, entries: int, runs: int) -> tuple[int, int, int]:
    """Into how many parts a product deals sources, targets and runs, so that a block stays within its bounds and all tasks have work."""
    s = math.ceil(max(nodes, 1) / SOURCES)
    c = math.ceil(runs / max(1, CELLS * s // max(nodes, 1)))
    t = math.ceil(max(entries, 1) / (s * ENTRIES))
    return s, t, min(runs, max(c, math.ceil(BLOCKS / (s * t))))


def _block_product(key, entries, states):
    """Sums of w * state by target of one block, for all of its runs: (node, chunk, runs, states) of what a signal reaches."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    states = states.take(pc.sort_indices(states["node"]))
    at = pc.index_in(entries["source"].combine_chunks(), value_set=states["node"].combine_chunks())
    entries, at = entries.filter(pc.is_valid(at)), at.drop_null().to_numpy(zero_copy_only=False)
    named = entries["target"].combine_chunks().dictionary_encode()
    code, w = named.indices.to_numpy(zero_copy_only=False), entries["w"].to_numpy()
    order = np.lexsort((at, code))
    at, code, w = at[order], code[order], w[order]
    owner = np.repeat(np.arange(len(states)), pc.list_value_length(states["runs"]).to_numpy())
    runs, column = np.unique(pc.list_flatten(states["runs"]).to_numpy(), return_inverse=True)
    x, known = np.zeros((len(states), len(runs))), np.zeros((len(states), len(runs)), bool)
    x[owner, column], known[owner, column] = pc.list_flatten(states["states"]).to_numpy(), True
    out, reached = np.zeros((len(named.dictionary), len(runs))), np.zeros((len(named.dictionary), len(runs)), bool)
    for i in range(0, len(at), SLICE):
        c, a = code[i : i + SLICE], at[i : i + SLICE]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        out[c[first]] += np.add.reduceat(w[i : i + SLICE, None] * x[a], first, axis=0)
        reached[c[first]] |= np.logical_or.reduceat(known[a], first, axis=0)
    ends = np.r_[0, np.cumsum(reached.sum(axis=1))].astype(np.int32)
    lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (runs.astype(np.int32)[np.nonzero(reached)[1]], out[reached])]
    return pa.table([named.dictionary, pa.array(np.full(len(out), key[2].as_py(), np.int32)), *lists], ["node", "chunk", "runs", "states"])


def _propagate_runs(w: DataFrame, state: DataFrame, damping: float, hops: int, scope: Scope) -> DataFrame:
    """The hops of propagate for many runs: blocks of sources, targets and runs are multiplied in tasks, and no product of an entry and a run is shuffled.

    A state is sent once for each part of the targets, an entry once for each part of the runs; blocks do not grow with the input, their number does.
    """
    w, entries, _ = cut_counted(w, "run-matrix")
    state = cut(state, "run-seeds")
    nodes = w.select("source").distinct().count()
    runs = state.select("run").distinct().count()
    s, t, c = _block_sizes(nodes, entries, runs)
    part = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = w.select("source", "target", "w", part("source", s).alias("s"), part("target", t).alias("t")).withColumn("c", every(c))
    packed = lambda rows: rows.groupBy("node", F.pmod("run", F.lit(c)).alias("chunk")).agg(F.collect_list(F.struct("run", "state")).alias("x")).select("node", "chunk", F.col("x.run").alias("runs"), F.col("x.state").alias("states"))
    spread = lambda rows: rows.select("node", F.col("chunk").alias("c"), F.explode(F.arrays_zip("runs", "states")).alias("x")).select(F.col("x.runs").alias("run"), "node", F.col("x.states").alias("state"))
    now, total = packed(state.groupBy("run", "node").agg(F.sum("state").alias("state"))), None
    for _ in range(hops):
        sent = now.select("node", "runs", "states", part("node", s).alias("s"), F.col("chunk").alias("c")).withColumn("t", every(t))
        met = dealt.groupBy("s", "t", "c").cogroup(sent.groupBy("s", "t", "c")).applyInArrow(_block_product, "node string, chunk int, runs array<int>, states array<double>")
        now = scope.keep(cut(met.withColumn("states", F.transform("states", lambda x: damping * x)), "run-hop"))
        if s > 1:
            now = scope.keep(cut(packed(spread(now).groupBy("run", "node").agg(F.sum("state").alias("state"))), "run-hop"))
        total = spread(now) if total is None else total.unionByName(spread(now))
    return total.groupBy("run", "node").agg(F.sum("state").alias("state"))


def propagate(matrix: DataFrame, seeds: DataFrame, nodeset: DataFrame | None = None, damping: float = 0.5, hops: int = 4, normalise: bool = True) -> DataFrame:
    """(run, node, state) summed over hops 1..hops; a node that no signal reaches has no row, and the seed itself is not counted.

    seeds: node, state and optionally run. A hop is a join on source and a sum by (run, target), so partial sums are
    combined before they are shuffled, and the entries of a hub's row are joined block by block. Seeds with runs of their own are multiplied in
    blocks (_propagate_runs). The matrix and every hop are cut, so that a hop is planned and run once.
    """
    w = matrix if nodeset is None else induced(matrix, nodeset)
    state = (seeds if "run" in seeds.columns else seeds.withColumn("run", F.lit(0))).select("run", "node", F.col("state").cast("double").alias("state"))
    with Scope() as scope:
        if "run" in seeds.columns:
            return _propagate_runs(normalised(w) if normalise else w, state, damping, hops, scope)
        w, hubs = dealt_by(cut(normalised(w) if normalise else w, "hop-entries"), ["source"], "target")
        w, total = cut(w, "hop-matrix"), None
        for _ in range(hops):
            state = for_blocks(state.withColumnRenamed("node", "source"), hubs, ["source"])
            state = state.join(w, ["source", "block"]).groupBy("run", F.col("target").alias("node")).agg((damping * F.sum(F.col("w") * F.col("state"))).alias("state"))
            state = scope.keep(cut(state, "hop"))
            total = state if total is None else total.unionByName(state)
    return total.groupBy("run", "node").agg(F.sum("state").alias("state"))


def score_prediction(predicted: DataFrame, observed: DataFrame, exclude: DataFrame | None = None, min_abs: float = 1e-9, conf_quantile: float = 0.75, least: int = 10, runs: DataFrame | None = None) -> DataFrame:
    """Per run: rho_global, rho_local, rho_conf, sign_acc, sign_acc_conf, n_reached, n_sign_scored, n_conf.

    observed: node, value and optionally sig, which gates sign grading and the confident tail. Excluded nodes are not
    evaluated; an unreached node is predicted 0. Both may have a run of their own (run). Every statistic but rho_global needs `least` rows, else it is NULL. A row comes
    for each run in runs (run), also for one that reaches nothing; without runs, for those that have a prediction.
    """
    runs = (predicted if runs is None else runs).select("run").distinct()
    own = "run" in observed.columns
    rows = observed.select(*(["run"] if own else []), "node", F.col("value").cast("double").alias("v"), (F.coalesce("sig", F.lit(False)) if "sig" in observed.columns else F.lit(True)).alias("sig"))
    with Scope() as scope:
        rows = rows.join(F.broadcast(runs), "run") if own else rows.crossJoin(F.broadcast(runs))
        if exclude is not None:
            keys = [c for c in ("run", "node") if c in exclude.columns]
            rows = rows.join(exclude.select(*keys).distinct(), keys, "left_anti")
        rows = rows.join(predicted, ["run", "node"], "left")
        rows = rows.select("run", F.coalesce("state", F.lit(0.0)).alias("p"), "v", "sig")
        rows = rows.withColumn("reached", F.abs("p") > min_abs).withColumn("hit", F.col("reached") & F.col("sig"))
        rows = cut(rows, "scored")
        hit = rows.where("hit").select("run", F.abs("p").alias("size"))
        limit = quantiles(hit, "size", {"limit": conf_quantile}, ["run"]).join(hit.groupBy("run").agg(F.count(F.lit(1)).alias("hits")), "run")
        rows = rows.join(limit, "run", "left").withColumn("conf", F.coalesce(F.col("hit") & (F.abs("p") >= F.col("limit")) & (F.col("hits") >= least), F.lit(False)))
        # the six ranks of a row, of p and v among all, reached and confident rows: a value is counted once for all three
        sides = {"g": "", "l": "_reached", "c": "_conf"}
        for c in ("p", "v"):
            ranks = [(F.col(f"n_before{m}") + (F.col(f"n_equal{m}") + 1).cast("double") / 2.0).alias(f"{c}{k}") for k, m in sides.items()]
            rows = rows.join(counted_values(rows, [c], ["run"], ("reached", "conf")).select("run", c, *ranks), ["run", c], "left")
        for k, on in (("l", "reached"), ("c", "conf")):
            rows = rows.withColumns({f"{c}{k}": F.when(F.col(on), F.col(f"{c}{k}")) for c in ("p", "v")})
        agree = (sign("p") == sign("v")).cast("double")

        def rho(k: str):
            x, y = F.col(f"p{k}"), F.when(F.col(f"p{k}").isNotNull(), F.col(f"v{k}"))
            n = F.count(x)
            cov = n * F.sum(x * y) - F.sum(x) * F.sum(y)
            vx, vy = n * F.sum(x * x) - F.sum(x) * F.sum(x), n * F.sum(y * y) - F.sum(y) * F.sum(y)
            return F.when((vx > 1e-9) & (vy > 1e-9), F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))

        agg = rows.groupBy("run").agg(
            rho("g").alias("rho_global"), rho("l").alias("rho_local"), rho("c").alias("rho_conf"),
            F.avg(F.when(F.col("hit"), agree)).alias("sign_acc"), F.avg(F.when(F.col("conf"), agree)).alias("sign_acc_conf"),
            F.count_if("reached").alias("n_reached"), F.count_if("hit").alias("n_sign_scored"), F.count_if("conf").alias("n_conf"),
        )
        enough = lambda c, n: F.when(F.col(n) >= least, F.col(c)).alias(c)
        out = agg.select("run", "rho_global", enough("rho_local", "n_reached"), enough("rho_conf", "n_conf"), enough("sign_acc", "n_sign_scored"), enough("sign_acc_conf", "n_conf"), "n_reached", "n_sign_scored", "n_conf")
        return scope.keep(cut(out, "scores"))


def _places(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(name, sheet, slot) of the distinct names, of which there are few, WIDE to a sheet; and the number of slots."""
    names = sorted(r[0] for r in rows.select(name).distinct().collect() if r[0] is not None)
    places = [(x, i // WIDE, i % WIDE) for i, x in enumerate(names)]
    return rows.sparkSession.createDataFrame(places, f"{name} {rows.schema[name].dataType.simpleString()}, {name}_sheet int, {name}_slot int"), min(WIDE, len(names))


def propagate_grid(matrices: DataFrame, seeds: DataFrame, depths: list[int], damping: float = 0.5, normalise: bool = True) -> DataFrame:
    """(network, seeds, k_hops, node, state) of every network, seed set and depth, as propagate gives them for one.

    matrices: network, source, target, w; seeds: seeds, node, state. Settings that differ in depth alone share their hops. A pair of nodes is
    one row for WIDE networks and a node one row for as many seed sets too, so that a hop moves each once.
    """
    with Scope() as scope:
        (nets, n), (sets, m) = _places(matrices, "network"), _places(seeds, "seeds")
        slot = lambda c, i, x: F.sum(F.when(F.col(f"{c}_slot") == i, x))
        row, into = ["network_sheet", "source"], ["network_sheet", "target"]
        placed = matrices.join(F.broadcast(nets), "network").groupBy("network_sheet", "source", "target")
        w = cut(placed.agg(*[slot("network", i, F.col("w").cast("double")).alias(f"w{i}") for i in range(n)], *[slot("network", i, F.abs("w")).alias(f"a{i}") for i in range(n)]), "grid-entries")
        sheets, total = nets.select("network_sheet").distinct(), w.groupBy(*into).agg(*[F.sum(f"a{i}").alias(f"t{i}") for i in range(n)])
        w, hubs = dealt_by(w, row, "target")
        if normalise:
            dealt, ends = dealt_by(w.withColumnRenamed("block", "row_block"), into, "source")
            met = dealt.join(for_blocks(total, ends, into), [*into, "block"])
            w = met.select(*row, "target", F.col("row_block").alias("block"), *[(F.col(f"w{i}") / F.col(f"t{i}")).alias(f"w{i}") for i in range(n)])
        w = cut(w, "grid-matrix")
        state = seeds.join(F.broadcast(sets), "seeds").groupBy("seeds_sheet", "node").agg(*[slot("seeds", j, F.col("state").cast("double")).alias(f"x{j}") for j in range(m)])
        cells = [(i, j, f"x{i}_{j}") for i in range(n) for j in range(m)]
        state = state.crossJoin(F.broadcast(sheets)).select("network_sheet", "seeds_sheet", "node", *[F.col(f"x{j}").alias(c) for _, j, c in cells])
        every = None
        for k in range(1, max(depths) + 1):
            # few states meet many entries: the entries are not sorted
            sent = for_blocks(state.withColumnRenamed("node", "source"), hubs, row).hint("shuffle_hash")
            moved = w.join(sent, [*row, "block"]).groupBy("network_sheet", "seeds_sheet", F.col("target").alias("node"))
            moved = moved.agg(*[(damping * F.sum(F.col(f"w{i}") * F.col(c))).alias(c) for i, _, c in cells])
            state = scope.keep(cut(moved.where(F.coalesce(*[c for *_, c in cells]).isNotNull()), "grid-hop"))
            # a hop counts in every depth that reaches it
            hop = state.withColumn("k_hops", F.explode(F.array(*[F.lit(d) for d in depths if d >= k])))
            every = hop if every is None else every.unionByName(hop)
    every = every.groupBy("network_sheet", "seeds_sheet", "k_hops", "node").agg(*[F.sum(c).alias(c) for *_, c in cells])
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("network_slot"), F.lit(j).alias("seeds_slot"), F.col(c).alias("state")) for i, j, c in cells]))
    named = every.select("network_sheet", "seeds_sheet", "k_hops", "node", each).where("state is not null")
    named = named.join(F.broadcast(nets), ["network_sheet", "network_slot"]).join(F.broadcast(sets), ["seeds_sheet", "seeds_slot"])
    return named.select("network", "seeds", "k_hops", "node", "state")


def evaluate_grid(matrices: DataFrame, seeds: DataFrame, observed: DataFrame, depths: list[int], digits: int = 12, **options) -> DataFrame:
    """The scores of every setting of a grid: a row for each network, seed set, depth and observation, in one plan.

    matrices and seeds as in propagate_grid; observed: observation, node, value and optionally sig, such as one signal under several
    noises. A set's seeds are not evaluated. Settings are the caller's own names, so their table is small; a setting that reaches nothing has
    its row too. States are rounded to so many digits before they are ranked; options are those of score_prediction.
    """
    with Scope() as scope:
        matrices, seeds, observed = cut(matrices, "grid-matrices"), cut(seeds, "grid-seeds"), cut(observed, "grid-observed")
        spark = matrices.sparkSession
        names = lambda df, c: df.select(c).distinct()
        grid = names(matrices, "network").crossJoin(names(seeds, "seeds")).crossJoin(names(observed, "observation")).crossJoin(spark.createDataFrame([(d,) for d in depths], "k_hops int"))
        grid = cut(grid.withColumn("run", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("network", "seeds", "observation", "k_hops"))), "grid-settings")
        predicted = propagate_grid(matrices, seeds, depths).withColumn("state", F.round("state", digits))
        predicted = cut(predicted.join(F.broadcast(grid), ["network", "seeds", "k_hops"]).select("run", "node", "state"), "grid-predicted")
        seen = observed.join(F.broadcast(grid.select("run", "observation")), "observation").drop("observation")
        out = seeds.join(F.broadcast(grid.select("run", "seeds")), "seeds").select("run", "node")
        scores = score_prediction(predicted, seen, out, runs=grid, **options)
        return scope.keep(cut(grid.join(scores, "run").drop("run"), "grid-scores"))


def degree_bins(matrix: DataFrame, bins: int = 10) -> DataFrame:
    """(node, degree, bin): bins of equal width over ranks of in- plus out-degree, ties ranked by node."""
    ends = matrix.select(F.col("source").alias("node")).unionByName(matrix.select(F.col("target").alias("node")))
    return rank_bins(ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "degree", "node", bins)


def shuffle_seeds(seeds: DataFrame, bins: DataFrame, runs: int, seed: int = 1) -> DataFrame:
    """(run, node, state) for runs 1..runs: each seed's state moves to a node of its degree bin, without replacement.

    bins: degree_bins. Seeds outside the network are dropped. A run permutes the places in a bin by arithmetic, so draws do not
    depend on partitioning, and only rows of seeds are made.
    """
    return permuted_nodes(bins, seeds.select("node", "state"), runs, seed)


def empirical_p(observed: DataFrame, null: DataFrame, value: str, lower: bool = False) -> DataFrame:
    """One row: (count of null at least as extreme + 1) / (n + 1)."""
    one = observed.select(F.col(value).alias("__obs")).limit(1)
    rows = null.join(F.broadcast(one), how="cross")
    extreme = F.col(value) <= F.col("__obs") if lower else F.col(value) >= F.col("__obs")
    return rows.agg(((F.count_if(extreme) + 1) / (F.count(F.lit(1)) + 1)).alias("p"), F.avg(value).alias("null_mean"), F.count(F.lit(1)).alias("n"))


def null_scores(matrix: DataFrame, seeds: DataFrame, observed: DataFrame, runs: int, seed: int = 1, bins: int = 10, digits: int = 12, **options) -> DataFrame:
    """Scores of `runs` degree-matched shuffles of the seeds, all of them at once, a row for each run.

    States are rounded to so many digits before they are ranked, so that nodes that tie do so in whatever order their sums are made.

    The inputs, the shuffles and the predictions are cut: the driver holds small plans instead of one with each of them many times.
    """
    with Scope() as scope:
        matrix, seeds, observed = cut(matrix, "null-matrix"), cut(seeds, "null-seeds"), cut(observed, "null-observed")
        moved = cut(shuffle_seeds(seeds, cut(degree_bins(matrix, bins), "null-bins"), runs, seed), "null-shuffles")
        every = matrix.sparkSession.range(1, runs + 1).select(F.col("id").cast("int").alias("run"))
        predicted = propagate(matrix, moved, **options).withColumn("state", F.round("state", digits))
        return scope.keep(score_prediction(cut(predicted, "null-predicted"), observed, seeds.select("node"), runs=every))


def star(matrix: DataFrame, seeds: DataFrame, observed: DataFrame, least: int = 5, top: int = 14) -> DataFrame:
    """Direct targets of each seed with a significant observation, strongest first: predicted against observed sign."""
    hit = seeds.join(matrix, seeds["node"] == matrix["source"]).select("source", "target", (F.col("w") * F.col("state")).alias("push"))
    rows = hit.join(observed.where("sig").select(F.col("node").alias("target"), "value"), "target")
    w = Window.partitionBy("source")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= least)
    rows = rows.withColumn("nth", F.row_number().over(w.orderBy(F.abs("value").desc(), "target"))).where(F.col("nth") <= top)
    return rows.select("source", "target", "nth", sign("push").alias("predicted"), sign("value").alias("observed"), (sign("push") == sign("value")).alias("agree"))

