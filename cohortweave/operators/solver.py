"""Prize-collecting Steiner forests as Spark jobs.

A tree over the terminals of each component is the Steiner heuristic of metric closure, minimum spanning tree and path expansion.
The closure is never built: every node finds its nearest terminal, and the edges between the regions of two terminals hold a
minimum spanning tree of the closure. The ways from those edges to their terminals close it to a tree whose leaves are terminals.
Regions are joined by contraction rounds in which every part takes its cheapest edge. Trees are pruned bottom-up, all
chains of leaves at once by pointer doubling, so rounds go by the logarithm of a tree's size and not by its depth. Ties are broken by
(cost, smaller end, larger end), so results do not depend on partitioning. Many runs are one job: the network is held once, and what
is known of a node carries its run.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from cohortweave.functions.draws import permuted_nodes
from cohortweave.functions.ranks import rank_bins
from cohortweave.functions.scalars import normal
from cohortweave.operators.components import connected_components
from cohortweave.operators import regions
from cohortweave.operators.network import degrees
from cohortweave.scratch import Scope, cut, cut_counted

#: Chains of the network are contracted where one node in so many is inside of one.
CHAINED = 10
#: Rows of a contracted table that are settled in one task instead of further rounds, with the same result.
FEW = 50_000
#: Edges of a tree and nodes of a run that are pruned in one task, each run in its own.
RUN_FEW = 500_000
_NEAR = ("dist", "seed", "hops", "via")


def _both_ways(edges: DataFrame, *keys: str) -> DataFrame:
    return edges.select(*keys, "a", "b", "cost").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "cost"))


def _counted_cut(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """cut with sums over its rows, observed while it is written."""
    seen = Observation()
    out = cut(df.observe(seen, *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in counts.items()]), name)
    return out, seen.get


def _unsent(df: DataFrame, rows: bool) -> DataFrame:
    """df, if it may have many rows, with the hint that no side of its join is broadcast: a column that repeats takes few bytes in a file, but not on the driver."""
    return df.hint("merge") if rows else df


def _with_run(df: DataFrame) -> DataFrame:
    return df if "run" in df.columns else df.withColumn("run", F.lit(0))


def network_chains(arcs: DataFrame, keep: DataFrame) -> DataFrame | None:
    """(a, b, cost, first, last, hops): from a node a by way of its neighbour `first` to the next node b that is kept or has not two neighbours.

    arcs: a, b, cost, both ways. `last` is the node before b. Chains of any length are followed in as many rounds as its
    logarithm. None where few nodes are inside of chains. Rings without a kept node lead nowhere and are left out.
    """
    around = arcs.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi"))
    ends = around.join(keep.select("node", F.lit(True).alias("kept")), "node", "left").select("node", (F.col("kept").isNull() & (F.col("n") == 2) & (F.col("lo") < F.col("hi"))).alias("inside"), "lo", "hi")
    ends, seen = _counted_cut(ends, "chain-ends", n=F.lit(1), inside=F.col("inside"))
    if not seen["inside"] or seen["inside"] * CHAINED < seen["n"]:
        return None
    after = F.when(F.col("inside"), F.when(F.col("lo") == F.col("a"), F.col("hi")).otherwise(F.col("lo")))
    step = arcs.join(ends.withColumnRenamed("node", "b"), "b").select("a", F.col("b").alias("first"), "b", F.col("a").alias("last"), "cost", F.lit(1).alias("hops"), after.alias("next"))
    step, seen = _counted_cut(step, "chain-steps", open=F.col("next").isNotNull())
    left = seen["open"]
    while left:
        on = step.select(F.col("a").alias("b"), F.col("first").alias("next"), F.col("b").alias("b_"), F.col("last").alias("last_"), F.col("cost").alias("cost_"), F.col("hops").alias("hops_"), F.col("next").alias("next_"))
        way = step.join(on, ["b", "next"], "left")
        gone = F.col("b_").isNotNull()
        way = way.select("a", "first", F.coalesce("b_", "b").alias("b"), F.coalesce("last_", "last").alias("last"), (F.col("cost") + F.coalesce("cost_", F.lit(0.0))).alias("cost"), (F.col("hops") + F.coalesce("hops_", F.lit(0))).alias("hops"), F.when(gone, F.col("next_")).otherwise(F.col("next")).alias("next"))
        step, seen = _counted_cut(way, "chain-steps", open=F.col("next").isNotNull())
        if seen["open"] == left:
            break
        left = seen["open"]
    return step.where("next is null").drop("next")


def nearest_terminal(edges: DataFrame, terminals: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(run, node, dist, seed, hops, via): each node's nearest terminal in each run, the edges to it and the neighbour that leads there.

    edges: a, b, cost; terminals: node and optionally run; known: rows as returned that hold for these edges and
    terminals, to start from. Chains are contracted first. Then the nodes that changed in the last round are relaxed, until none changes,
    in as many rounds as a way has edges in the contracted network; a round joins them to the network by node. Negative costs are refused.
    """
    tied = "run" not in terminals.columns
    terminals = _with_run(terminals).select("run", "node")
    with Scope() as scope:
        seen = Observation()
        arcs = cut(_both_ways(edges).observe(seen, F.count_if(F.col("cost") < 0).alias("n"), F.count(F.lit(1)).alias("arcs")), "steiner-arcs")
        if seen.get["n"]:
            raise ValueError("negative costs: distances do not settle")
        chains = network_chains(arcs, terminals.select("node").distinct()) if known is None else None
        ways = arcs.select("a", "b", "cost", F.col("a").alias("last"), F.lit(1).alias("hops")) if chains is None else chains.select("a", "b", "cost", "last", "hops")
        ways = _unsent(ways, seen.get["arcs"] > 2 * FEW)
        state = F.struct(*_NEAR)
        start = terminals.select("run", "node", F.lit(0.0).alias("dist"), F.col("node").alias("seed"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via"))
        if known is not None:
            start = start.unionByName(known.select(start.columns)).groupBy("run", "node").agg(F.min(state).alias("k")).select("run", "node", "k.*")
        best = front = held = cut(start, "steiner-near")
        while True:
            offer = front.withColumnRenamed("hops", "walked").join(ways, front["node"] == ways["a"]).select("run", F.col("b").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), "seed", (F.col("walked") + F.col("hops")).alias("hops"), F.col("last").alias("via"))
            offer = offer.groupBy("run", "node").agg(F.min(state).alias("n"))
            merged = best.select("run", "node", state.alias("o")).join(offer, ["run", "node"], "full")
            new = F.col("n").isNotNull() & (F.col("o").isNull() | (F.col("n.dist") < F.col("o.dist") - 1e-12))
            merged, seen = _counted_cut(merged.select("run", "node", F.when(new, F.col("n")).otherwise(F.col("o")).alias("k"), new.alias("new")), "steiner-near", n=F.col("new"))
            scope.free(held)
            held = merged
            best, front = merged.select("run", "node", "k.*"), merged.where("new").select("run", "node", "k.*")
            if not seen["n"]:
                break
        if chains is not None:
            inner = chains.join(best.select(F.col("node").alias("b"), "run", "dist", "seed", F.col("hops").alias("walked")), "b")
            inner = inner.select("run", F.col("a").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), "seed", (F.col("walked") + F.col("hops")).alias("hops"), F.col("first").alias("via"))
            fill = inner.groupBy("run", "node").agg(F.min(state).alias("k")).select("run", "node", "k.*")
            best = best.unionByName(fill.join(best.select("run", "node"), ["run", "node"], "left_anti"))
        out = scope.keep(cut(best, "steiner-regions"))
    return out.drop("run") if tied else out


def distance_table(edges: DataFrame, sources: DataFrame, radius: float | None = None) -> DataFrame:
    """(src, node, dist, hops, via): the shortest ways from each source to the nodes within the radius, `via` the neighbour on the way to the source.

    Built once, it serves every run whose terminals are among the sources, since costs do not depend on a run. Without a radius it
    has a row for every source and node that are connected.
    """
    alone = sources.select(F.col("node").alias("src")).distinct()
    with Scope() as scope:
        arcs = cut(_both_ways(edges), "distance-arcs")
        state = F.struct("dist", "hops", "via")
        best = front = held = cut(alone.select("src", F.col("src").alias("node"), F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via")), "distances")
        while True:
            offer = front.join(arcs, front["node"] == arcs["a"]).select("src", F.col("b").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("a").alias("via"))
            offer = offer if radius is None else offer.where(F.col("dist") <= radius)
            offer = offer.groupBy("src", "node").agg(F.min(state).alias("n"))
            new = F.col("n").isNotNull() & (F.col("o").isNull() | (F.col("n.dist") < F.col("o.dist") - 1e-12))
            merged = best.select("src", "node", state.alias("o")).join(offer, ["src", "node"], "full")
            merged, seen = _counted_cut(merged.select("src", "node", F.when(new, F.col("n")).otherwise(F.col("o")).alias("k"), new.alias("new")), "distances", n=F.col("new"))
            scope.free(held)
            held = merged
            best, front = merged.select("src", "node", "k.*"), merged.where("new").select("src", "node", "k.*")
            if not seen["n"]:
                return scope.keep(merged).select("src", "node", "k.*")


def known_from(distances: DataFrame, terminals: DataFrame) -> DataFrame:
    """What a distance table says of each run's nearest terminals, as nearest_terminal takes it in `known`."""
    rows = terminals.select("run", F.col("node").alias("src")).join(distances, "src")
    return rows.groupBy("run", "node").agg(F.min(F.struct("dist", F.col("src").alias("seed"), "hops", "via")).alias("k")).select("run", "node", "k.*")


def _joined_few(rows: DataFrame) -> DataFrame:
    """What is left of a contraction, at most FEW rows (run, pa, pb, e): its taken edges (run, e), and (run, part, tree) with a null e."""
    made = rows.sparkSession.createDataFrame([], rows.select("run", "e", F.col("pa").alias("part"), F.col("pa").alias("tree")).schema).schema
    order = [f"e.{f.name}" for f in rows.schema["e"].dataType]

    def join(frames):
        import pandas as pd

        up: dict = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        taken = []
        for frame in frames:
            for row in frame.itertuples(index=False):
                a, b = find((row.run, row.pa)), find((row.run, row.pb))
                if a != b:
                    up[max(a, b)] = min(a, b)
                    taken.append((row.run, row.e, None, None))
        out = [*taken, *((run, None, part, find((run, part))[1]) for run, part in list(up))]
        yield pd.DataFrame(out, columns=["run", "e", "part", "tree"])

    return rows.repartition(1).sortWithinPartitions("run", *order).mapInPandas(join, made)


def _contracted(rows: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Borůvka rounds over rows (run, pa, pb, e), e a struct in whose order edges are taken: the taken (run, e), and (run, part, tree).

    Every part takes its smallest outgoing edge; a part goes to the part at the other end, and so on for eight steps, where the two parts
    that took the same edge stop at the smaller. Parts that are not yet together then still lie in one tree. Of parallel edges the
    smallest stays. The last FEW rows are joined in one task.
    """
    taken, homes = None, None
    while True:
        ends = rows.select("run", F.col("pa").alias("part"), F.col("pb").alias("up"), "e").unionByName(rows.select("run", F.col("pb").alias("part"), F.col("pa").alias("up"), "e"))
        take, n, _ = cut_counted(ends.groupBy("run", "part").agg(F.min(F.struct("e", "up")).alias("t")).select("run", "part", "t.e", "t.up"), "forest-take")
        if not n:
            return taken, homes
        found = take.select("run", "e")
        taken = found if taken is None else taken.unionByName(found)
        back = take.select("run", F.col("part").alias("up"), F.col("up").alias("part"), F.lit(True).alias("mutual"))
        hook = take.select("run", "part", "up").join(back, ["run", "part", "up"], "left")
        hook = hook.select("run", "part", F.when(F.col("mutual") & (F.col("part") < F.col("up")), F.col("part")).otherwise(F.col("up")).alias("up"))
        for _ in range(3):
            above = hook.select("run", F.col("part").alias("up"), F.col("up").alias("over"))
            hook = hook.join(above, ["run", "up"], "left").select("run", "part", F.coalesce("over", "up").alias("up"))
        hook = cut(hook, "forest-parts")
        a, b = hook.select("run", F.col("part").alias("pa"), F.col("up").alias("na")), hook.select("run", F.col("part").alias("pb"), F.col("up").alias("nb"))
        moved = rows.join(a, ["run", "pa"]).join(b, ["run", "pb"]).where("na <> nb").groupBy("run", F.least("na", "nb").alias("pa"), F.greatest("na", "nb").alias("pb")).agg(F.min("e").alias("e"))
        rows, left, _ = cut_counted(moved, "forest")
        few = cut(_joined_few(rows), "forest-few") if 0 < left <= FEW else None
        if few is not None:
            taken = taken.unionByName(few.where("e is not null").select("run", "e"))
            last = few.where("e is null").select("run", F.col("part").alias("up"), "tree")
            hook = hook.join(last, ["run", "up"], "left").select("run", "part", F.coalesce("tree", "up").alias("up"))
        if homes is None:
            homes = hook.select("run", "part", F.col("up").alias("tree"))
        else:
            homes = cut(homes.join(hook.select("run", F.col("part").alias("tree"), "up"), ["run", "tree"], "left").select("run", "part", F.coalesce("up", "tree").alias("tree")), "forest-homes")
        if few is not None or not left:
            return taken, homes


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest of (a, b, cost, and further columns), ties by (smaller end, larger end)."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    with Scope() as scope:
        rows = edges.where("a <> b").select(F.lit(0).alias("run"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.struct("cost", lo.alias("lo"), hi.alias("hi")).alias("e"))
        taken, _ = _contracted(rows)
        if taken is None:
            return edges.limit(0)
        taken = scope.keep(cut(taken.select("e.*").distinct(), "forest-taken"))
    return edges.join(taken, [edges["cost"] == taken["cost"], lo == taken["lo"], hi == taken["hi"]], "left_semi")


def _upwards(marks: DataFrame, via: DataFrame) -> DataFrame:
    """marks (run, node) and all nodes that via (run, node, to) leads to from them, in rounds by the logarithm of the longest way."""
    marks, n, _ = cut_counted(marks.distinct(), "walk-marks")
    while True:
        more = marks.join(via, ["run", "node"]).select("run", F.col("to").alias("node"))
        marks, seen, _ = cut_counted(marks.unionByName(more).distinct(), "walk-marks")
        if seen == n:
            return marks
        n = seen
        via = cut(via.join(via.select("run", F.col("node").alias("to"), F.col("to").alias("over")), ["run", "to"]).select("run", "node", F.col("over").alias("to")), "walk-jumps")


def steiner_trees(edges: DataFrame, terminals: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees over the terminals (run, node) of each component: their edges (run, a, b, cost), the tree of each of their nodes (run, node,
    tree), and the terminals (run, node) that are alone in their component.

    The ways run along each node's nearest terminal, so they and the edges between regions form trees, and no leaf is without a prize.
    Networks of more than FEW and at most regions.EDGES edges are worked out in blocks of runs, whatever is known; others by joins.
    """
    edges, seen = _counted_cut(edges.select("a", "b", "cost"), "steiner-network", n=F.lit(1), negative=F.col("cost") < 0)
    if seen["negative"]:
        raise ValueError("negative costs: distances do not settle")
    both = None
    if FEW < seen["n"] <= regions.EDGES:
        runs = terminals.select("run").distinct().count()
        both = (regions.region_trees if seen["n"] <= regions.NAMED else regions.coded_trees)(edges, terminals, runs)
    if both is not None:
        both = cut(both, "steiner-trees")
        home = both.where("cost is null").select("run", F.col("a").alias("node"), F.col("b").alias("tree"))
        return both.where("cost is not null"), home, terminals.select("run", "node").join(_unsent(home, True), ["run", "node"], "left_anti")
    near = nearest_terminal(edges, terminals, known)
    x = near.select("run", F.col("node").alias("a"), F.col("dist").alias("da"), F.col("seed").alias("sa"))
    y = near.select("run", F.col("node").alias("b"), F.col("dist").alias("db"), F.col("seed").alias("sb"))
    many = seen["n"] > FEW
    met = edges.select("a", "b", "cost").join(_unsent(x, many), "a").join(_unsent(y, many), ["run", "b"]).where("sa <> sb")
    bridges = met.select("run", F.col("sa").alias("pa"), F.col("sb").alias("pb"), F.struct((F.col("da") + F.col("cost") + F.col("db")).alias("len"), "a", "b", "cost").alias("e"))
    taken, homes = _contracted(bridges)
    if taken is None:
        none = terminals.limit(0)
        return none.select("run", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("cost")), none.select("run", "node", F.col("node").alias("tree")), terminals.select("run", "node")
    steps = taken.distinct().select("run", "e.a", "e.b", "e.cost")
    ends = steps.select("run", F.col("a").alias("node")).unionByName(steps.select("run", F.col("b").alias("node")))
    walked = _upwards(ends, near.where("via is not null").select("run", "node", F.col("via").alias("to")))
    path = near.where("via is not null").join(_unsent(walked, many), ["run", "node"], "left_semi").select("run", F.least("node", "via").alias("lo"), F.greatest("node", "via").alias("hi"))
    priced = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "cost").groupBy("lo", "hi").agg(F.min("cost").alias("cost"))
    tree = cut(steps.unionByName(path.join(priced, ["lo", "hi"]).select("run", F.col("lo").alias("a"), F.col("hi").alias("b"), "cost")), "steiner-tree")
    home = near.join(_unsent(walked, many), ["run", "node"], "left_semi").join(_unsent(homes.withColumnRenamed("part", "seed"), many), ["run", "seed"]).select("run", "node", "tree")
    alone = terminals.select("run", "node").join(_unsent(homes.select("run", F.col("part").alias("node")), many), ["run", "node"], "left_anti")
    return tree, cut(home, "steiner-home"), alone


def _leaf_by_leaf(around: dict, net: dict, root: set) -> list[tuple]:
    """(node, parent, cost, gain) of trees given as {node: {neighbour: cost}}, children before their parents."""
    leaves, out = sorted(x for x, near in around.items() if len(near) == 1 and x not in root), []
    while leaves:
        x = leaves.pop()
        (up, cost), *_ = around[x].items()
        gain = max(0.0, net[x] - cost)
        out.append((x, up, cost, gain))
        net[up] += gain
        del around[up][x]
        if len(around[up]) == 1 and up not in root:
            leaves.append(up)
    return out


def _pruned_run(tree, worth):
    """Of one run's trees (run, a, b, cost) and nodes (run, node, tree, net): the kept nodes (run, node, parent, cost), roots without a parent."""
    import pandas as pd

    around, kept = {x: {} for x in worth["node"]}, []
    for a, b, cost in zip(tree["a"], tree["b"], tree["cost"]):
        around[a][b] = around[b][a] = cost
    roots = worth.sort_values(["net", "node"], ascending=[False, True]).drop_duplicates("tree")["node"]
    inside = set(roots)
    for x, up, cost, gain in reversed(_leaf_by_leaf(around, dict(zip(worth["node"], worth["net"])), set(roots))):
        if gain > 0 and up in inside:
            inside.add(x)
            kept.append((x, up, cost))
    out = pd.DataFrame([*kept, *((x, None, None) for x in roots)], columns=["node", "parent", "cost"])
    out.insert(0, "run", worth["run"].iloc[0] if len(worth) else 0)
    return out


def _settled_few(arcs: DataFrame, own: DataFrame, roots: DataFrame) -> DataFrame:
    """The rest of settled_leaves where at most FEW arcs are left: leaf by leaf in one task."""
    rows = arcs.join(own, ["run", "a"], "left").join(roots.select("run", F.col("node").alias("a"), F.lit(True).alias("root")), ["run", "a"], "left")
    rows = rows.select("run", "a", "b", "cost", F.coalesce("net", F.lit(0.0)).alias("net"), F.coalesce("root", F.lit(False)).alias("root"))

    def settle(frames):
        import pandas as pd

        around, net, root = {}, {}, set()
        for frame in frames:
            for r in frame.itertuples(index=False):
                at = (r.run, r.a)
                around.setdefault(at, {})[r.run, r.b] = r.cost
                net[at] = r.net
                if r.root:
                    root.add(at)
        out = [(x[0], x[1], up[1], cost, gain) for x, up, cost, gain in _leaf_by_leaf(around, net, root)]
        yield pd.DataFrame(out, columns=["run", "node", "parent", "cost", "gain"])

    return rows.repartition(1).sortWithinPartitions("run", "a", "b").mapInPandas(settle, "run int, node string, parent string, cost double, gain double")


def settled_leaves(tree: DataFrame, worth: DataFrame, roots: DataFrame) -> DataFrame:
    """(run, node, parent, cost, gain) of every node but the roots of trees (run, a, b, cost): what its subtree is worth to its parent, at least 0.

    worth: run, node, net, the node's own; roots: run, node, one of each tree. A subtree is worth its root's own, what its
    children are worth to it, less the cost of the edge above it. All chains that end in a leaf settle in one phase, by composing the maps
    x -> max(least, x + less) along them, twice as far in each round; a phase leaves at most half of the leaves. The last FEW arcs settle in a task.
    """
    arcs, n, _ = cut_counted(_both_ways(tree, "run"), "settle-arcs")
    done = None
    while n:
        own = worth.select("run", F.col("node").alias("a"), "net")
        if done is not None:
            own = own.unionByName(done.select("run", F.col("parent").alias("a"), F.col("gain").alias("net")))
        own = own.groupBy("run", "a").agg(F.sum("net").alias("net"))
        if n <= FEW:
            found = cut(_settled_few(arcs, own, roots), "settle-few")
            return found if done is None else done.unionByName(found)
        around = arcs.groupBy("run", "a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi")).where("n < 3")
        around = around.join(roots.select("run", F.col("node").alias("a")), ["run", "a"], "left_anti").join(own, ["run", "a"])
        x = arcs.join(around, ["run", "a"]).withColumn("over", F.col("net") - F.col("cost"))
        leaf = F.col("n") == 1
        x = x.select(
            "run", "a", "b", "cost", F.greatest(F.lit(0.0), F.when(leaf, F.col("over"))).alias("least"), F.when(~leaf, F.col("over")).alias("less"),
            F.when(~leaf, F.when(F.col("lo") == F.col("b"), F.col("hi")).otherwise(F.col("lo"))).alias("q"), F.when(~leaf, F.col("a")).alias("r"),
        )
        open_ = 1
        while open_:
            before = x.select("run", F.col("a").alias("q"), F.col("b").alias("r"), F.col("least").alias("least_"), F.col("less").alias("less_"), F.col("q").alias("q_"), F.col("r").alias("r_"))
            met = x.where("q is not null").join(before, ["run", "q", "r"]).select("run", "a", "b", "cost", F.greatest("least", F.col("least_") + F.col("less")).alias("least"), (F.col("less_") + F.col("less")).alias("less"), F.col("q_").alias("q"), F.col("r_").alias("r"))
            x, seen = _counted_cut(x.where("q is null").unionByName(met), "settle-chains", open=F.col("q").isNotNull())
            open_ = seen["open"]
        found = x.select("run", F.col("a").alias("node"), F.col("b").alias("parent"), "cost", F.col("least").alias("gain"))
        done = found if done is None else done.unionByName(found)
        gone = found.select("run", "node")
        arcs, n, _ = cut_counted(arcs.join(gone.withColumnRenamed("node", "a"), ["run", "a"], "left_anti").join(gone.withColumnRenamed("node", "b"), ["run", "b"], "left_anti").select("run", "a", "b", "cost"), "settle-arcs")
    return tree.select("run", F.col("a").alias("node"), F.col("b").alias("parent"), "cost", F.lit(0.0).alias("gain")).limit(0) if done is None else done


def stripped_leaves(tree: DataFrame, terminals: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges (run, a, b, cost) of trees without the leaves that are no terminals, again and again: those above a subtree with a terminal.

    roots: a terminal of each tree.
    """
    worth = tree.select("run", F.col("a").alias("node")).unionByName(tree.select("run", F.col("b").alias("node"))).distinct()
    worth = worth.join(terminals.select("run", "node", F.lit(1.0).alias("net")), ["run", "node"], "left").select("run", "node", F.coalesce("net", F.lit(0.0)).alias("net"))
    free = tree.select("run", "a", "b", F.lit(0.0).alias("cost"))
    up = settled_leaves(free, worth, roots).where("gain > 0").select("run", F.least("node", "parent").alias("lo"), F.greatest("node", "parent").alias("hi"))
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    return tree.join(up.withColumnRenamed("run", "run_"), [tree["run"] == F.col("run_"), lo == up["lo"], hi == up["hi"]], "left_semi")


def prune_trees(tree: DataFrame, prizes: DataFrame, home: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the best part of each tree that holds its root, the node of largest prize.

    tree: a, b, cost and optionally run; prizes: node, p and optionally run; home: run, node, tree, if it is known which node is in which tree.
    A child stays if what it and its kept children are worth exceeds the cost of its edge.
    """
    tied = "run" not in tree.columns
    tree, prizes = _with_run(tree), _with_run(prizes)
    if home is None:
        key = lambda c: F.concat_ws(":", "run", c)
        parts = connected_components(tree.select(key("a").alias("a"), key("b").alias("b")))
        home = parts.select(F.split_part("node", F.lit(":"), F.lit(1)).cast("int").alias("run"), F.expr("substring(node, instr(node, ':') + 1)").alias("node"), F.col("component").alias("tree"))
    with Scope() as scope:
        worth = cut(home.join(_unsent(prizes.select("run", "node", "p"), not tied), ["run", "node"], "left").select("run", "node", "tree", F.coalesce("p", F.lit(0.0)).alias("net")), "prune-worth")
        most = worth.groupBy("run").count().agg(F.max("count")).first()[0] or 0
        if most <= RUN_FEW:
            trees, nodes = tree.select("run", "a", "b", "cost").groupBy("run"), worth.groupBy("run")
            kept = scope.keep(cut(trees.cogroup(nodes).applyInPandas(_pruned_run, "run int, node string, parent string, cost double"), "prune-kept"))
            edges = kept.where("parent is not null").select("run", F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"), "cost")
            nodes = kept.select("run", "node")
            return (edges.drop("run"), nodes.drop("run")) if tied else (edges, nodes)
        roots = cut(worth.groupBy("run", "tree").agg(F.min(F.struct((-F.col("net")).alias("x"), "node")).alias("r")).select("run", F.col("r.node").alias("node")), "prune-roots")
        kept = cut(settled_leaves(tree, worth.select("run", "node", "net"), roots).where("gain > 0"), "prune-kept")
        # a node stays if all edges above it do: the topmost node that is reached from it is a root
        top, moved = kept.select("run", "node", F.col("parent").alias("to")), 1
        while moved:
            for _ in range(2):
                top = top.join(top.select("run", F.col("node").alias("to"), F.col("to").alias("over")), ["run", "to"], "left").select("run", "node", F.coalesce("over", "to").alias("to"), F.col("over").isNotNull().alias("moved"))
            top, seen = _counted_cut(top, "prune-tops", n=F.col("moved"))
            moved, top = seen["n"], top.drop("moved")
        inside = top.join(roots.withColumnRenamed("node", "to"), ["run", "to"], "left_semi").select("run", "node")
        edges = kept.join(inside, ["run", "node"], "left_semi").select("run", F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"), "cost")
        edges, nodes = scope.keep(cut(edges, "prune-edges")), scope.keep(cut(inside.unionByName(roots), "prune-nodes"))
    return (edges.drop("run"), nodes.drop("run")) if tied else (edges, nodes)


#: Solvers by name, each (edges, prizes, omega, mu) to (edges, nodes) as solve_forest gives them; add others here.
BACKENDS: dict[str, Callable[..., tuple[DataFrame, DataFrame]]] = {}


def solve_forest(edges: DataFrame, prizes: DataFrame, omega: float = 3.0, mu: float = 0.005, backend: str = "builtin", distances: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the forest: edges (run, a, b, cost), nodes (run, node, prize, p, terminal).

    edges: source, target, cost, the undirected network; prizes: node, prize and optionally run; distances: a distance_table of
    this network whose sources are among the terminals, to start from; whatever its radius, the result is the same. Prizes lose mu per
    degree; a component with one terminal is that terminal, others are trees; edges above omega are cut; absent
    terminals worth more than omega come back alone; lone nodes worth no more than omega go. Without a prize left after
    the penalty both tables are empty, with a warning.
    """
    if backend != "builtin":
        if backend not in BACKENDS:
            raise ValueError(f"no solver named {backend!r}; register it in solver.BACKENDS")
        return BACKENDS[backend](edges, prizes, omega, mu)
    runs = _with_run(prizes)
    with Scope() as scope:
        net = cut(edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.coalesce("cost", F.lit(1.0)).alias("cost")), "forest-network")
        many = "run" in prizes.columns
        p = runs.join(_unsent(degrees(net, "a", "b"), many), "node").select("run", "node", F.col("prize").cast("double").alias("prize"), (F.col("prize") - mu * F.col("degree")).alias("p"))
        p, seen = _counted_cut(p, "forest-prizes", n=F.col("p") > 0)
        terminals = p.where("p > 0").select("run", "node", "p")
        if not seen["n"]:
            warnings.warn("all prizes are zero after the hub penalty", stacklevel=2)
        known = None if distances is None else known_from(distances, terminals)
        tree, home, alone = steiner_trees(net, terminals, known)
        tree, tree_nodes = prune_trees(tree, terminals, home)
        tree = scope.keep(cut(tree.where(F.col("cost") <= omega), "forest-edges"))
        nodes = tree_nodes.unionByName(alone).unionByName(terminals.where(F.col("p") > omega).select("run", "node")).distinct()
        touched = tree.select("run", F.col("a").alias("node")).unionByName(tree.select("run", F.col("b").alias("node"))).distinct()
        worth = nodes.join(_unsent(terminals, many), ["run", "node"], "left").join(_unsent(touched.withColumn("held", F.lit(True)), many), ["run", "node"], "left")
        worth = worth.where(F.col("held") | (F.coalesce("p", F.lit(0.0)) > omega)).select("run", "node", "p")
        out = worth.join(_unsent(p.select("run", "node", "prize"), many), ["run", "node"], "left").select("run", "node", F.coalesce("prize", F.lit(0.0)).alias("prize"), F.coalesce("p", F.lit(0.0)).alias("p"), F.col("p").isNotNull().alias("terminal"))
        return tree, scope.keep(cut(out, "forest-nodes"))


def summarise_forest(edges: DataFrame, nodes: DataFrame, omega: float = 3.0) -> DataFrame:
    """Per run: nodes, n_trees, terminals, steiner and objective = prizes - costs - omega * trees.

    In a forest the number of trees is nodes less edges.
    """
    e = edges.groupBy("run").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("cost").alias("costs"))
    v = nodes.groupBy("run").agg(F.count(F.lit(1)).alias("nodes"), F.sum("p").alias("worth"), F.count_if("terminal").alias("terminals"), F.count_if(~F.col("terminal")).alias("steiner"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    trees = F.col("nodes") - z("n_edges")
    return v.join(e, "run", "left").select("run", "nodes", trees.alias("n_trees"), "terminals", "steiner", (F.col("worth") - F.coalesce("costs", F.lit(0.0)) - omega * trees).alias("objective"))


def noisy_prizes(prizes: DataFrame, runs: int, sd: float = 0.1, seed: int = 1) -> DataFrame:
    """(run, node, prize) for runs 1..runs, each prize times 1 + N(0, sd), at least 0."""
    run = prizes.sparkSession.range(1, runs + 1).select(F.col("id").cast("int").alias("run"))
    noise: Column = 1 + sd * normal(seed, "run", "node")
    return prizes.select("node", "prize").crossJoin(F.broadcast(run)).select("run", "node", F.greatest(F.lit(0.0), F.col("prize") * noise).alias("prize"))


def robust_forest(edges: DataFrame, prizes: DataFrame, omega: float = 3.0, mu: float = 0.005, runs: int = 100, sd: float = 0.1, seed: int = 1, radius: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Selection frequencies over noisy runs: edges (source, target, frequency) and nodes (node, frequency); empty runs count.

    All runs start from one table of the distances up to a radius from the nodes with a prize; None: omega for networks of at most
    FEW edges, none for others, which are worked out in blocks; 0: no such table.
    """
    with Scope() as scope:
        edges, n, _ = cut_counted(edges.select("source", "target", "cost"), "robust-network")
        prizes = cut(prizes.select("node", "prize"), "robust-prizes")
        noisy = cut(noisy_prizes(prizes, runs, sd, seed), "noisy-prizes")
        table, radius = None, (omega if n <= FEW else 0.0) if radius is None else radius
        if radius > 0:
            net = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.coalesce("cost", F.lit(1.0)).alias("cost"))
            table = distance_table(net, prizes.where("prize > 0").select("node"), radius)
        e, v = solve_forest(edges, noisy, omega, mu, distances=table)
        share = (F.count(F.lit(1)) / runs).alias("frequency")
        pairs = scope.keep(cut(e.groupBy(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).agg(share), "robust-edges"))
        return pairs, scope.keep(cut(v.groupBy("node").agg(share), "robust-nodes"))


def shuffled_prizes(edges: DataFrame, prizes: DataFrame, runs: int, bins: int = 10, seed: int = 1) -> DataFrame:
    """(run, node, prize) of the nodes with a prize other than 0, for runs 1..runs: prizes of all nodes, zeros too, permuted within bins of the degree rank."""
    with Scope() as scope:
        binned = cut(rank_bins(degrees(edges), "degree", "node", bins), "shuffle-bins")
        held = prizes.select("node", F.col("prize").cast("double").alias("prize")).where("prize <> 0")
        return scope.keep(cut(permuted_nodes(binned, held, runs, seed), "shuffle-prizes")).select("run", "node", "prize")


def permutation_test(edges: DataFrame, prizes: DataFrame, omega: float = 3.0, mu: float = 0.005, runs: int = 200, seed: int = 1) -> DataFrame:
    """One row: observed and mean null nodes, steiner and objective, with p (nodes: at most the observed; others: at least)."""
    spark = edges.sparkSession
    all_runs = spark.range(0, runs + 1).select(F.col("id").cast("int").alias("run"))
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    with Scope() as scope:
        edges, prizes = cut(edges.select("source", "target", "cost"), "permuted-network"), cut(prizes.select("node", "prize"), "permuted-own")
        own = prizes.select(F.lit(0).alias("run"), "node", F.col("prize").cast("double").alias("prize"))
        both = cut(own.unionByName(shuffled_prizes(edges, prizes, runs, seed=seed)), "permuted-prizes")
        info = summarise_forest(*solve_forest(edges, both, omega, mu), omega)
        info = scope.keep(cut(all_runs.join(info, "run", "left").select("run", z("nodes"), z("steiner"), z("objective")), "permutation"))
    obs = info.where("run = 0").select(*[F.col(c).alias(f"observed_{c}") for c in ("nodes", "steiner", "objective")])
    rows = info.where("run > 0").crossJoin(F.broadcast(obs))
    p = lambda cond, name: ((F.count_if(cond) + 1) / F.lit(runs + 1)).alias(name)
    return rows.groupBy("observed_nodes", "observed_steiner", "observed_objective").agg(
        *[F.avg(c).alias(f"null_{c}_mean") for c in ("nodes", "steiner", "objective")],
        p(F.col("nodes") <= F.col("observed_nodes"), "p_compactness"), p(F.col("steiner") >= F.col("observed_steiner"), "p_steiner"), p(F.col("objective") >= F.col("observed_objective"), "p_objective"),
    )
