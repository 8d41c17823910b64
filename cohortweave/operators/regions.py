"""Regions of nearest terminals and their spanning trees for many runs, a block of runs in a task.

A block holds the edges of a network of bounded size and the terminals of its runs; nothing of an edge and a run is shuffled. Ties are
broken as in operators/solver: offers by (distance, terminal, edges walked, neighbour), bridges by (length, a, b, cost).
Networks of more than NAMED edges are sent with numbers for their nodes, 16 bytes an edge, and read a slice at a time (coded_trees).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cohortweave.functions.ranks import counted_values
from cohortweave.operators.network import nodes_of
from cohortweave.scratch import cut_counted

#: Edges that a block may hold, those that it may hold with their names, and the most blocks that runs are dealt into.
EDGES, NAMED, BLOCKS = 50_000_000, 8_000_000, 16
#: Nodes of a network that is held by numbers, and edges of all its blocks together, which bounds their number.
NODES, PLACED = 4_000_000, 240_000_000
#: Bridges that are sorted at a time, and offers that are held before the best of each node are picked.
BRIDGES, OFFERS = 4_000_000, 2_000_000
#: Arcs that are relaxed at a time.
SLICE = 1_000_000
_OUT = "run int, a string, b string, cost double"


def _near(start, arc_to, arc_cost, ends):
    """(dist, seed, hops, via, step) of each node of one run: its nearest of `ends`, the neighbour that leads there and that edge's cost."""
    n = len(start) - 1
    dist, low, step = np.full(n, np.inf), np.full(n, np.inf), np.zeros(n)
    seed, hops, via = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.full(n, -1, np.int32)
    dist[ends], seed[ends] = 0.0, ends
    front = ends
    while len(front):
        size = start[front + 1] - start[front]
        offers = []
        for part in np.array_split(np.arange(len(front)), size.sum() // SLICE + 1):
            count = size[part]
            arc = np.arange(count.sum()) + np.repeat(start[front[part]] - np.r_[0, np.cumsum(count)[:-1]], count) if len(part) else np.zeros(0, np.int64)
            x, y = np.repeat(front[part], count), arc_to[arc]
            d = dist[x] + arc_cost[arc]
            better = d < dist[y] - 1e-12
            x, y, d, c = x[better], y[better], d[better], arc_cost[arc[better]]
            np.minimum.at(low, y, d)
            least = d == low[y]
            offers.append((x[least], y[least], d[least], c[least]))
        x, y, d, c = (np.concatenate(o) for o in zip(*offers))
        least = d == low[y]
        x, y, d, c = x[least], y[least], d[least], c[least]
        low[y] = np.inf
        order = np.lexsort((x, hops[x], seed[x], y))
        order = order[np.r_[True, np.diff(y[order]) != 0]] if len(order) else order
        x, front = x[order], y[order]
        seed[front], hops[front], via[front], dist[front], step[front] = seed[x], hops[x] + 1, x, d[order], c[order]
    return dist, seed, via, step


def _joined(n, x, y):
    """Of pairs (x, y) in the order in which they are taken: the places of those of the spanning forest, and the tree of each of n parts."""
    home, at, taken = np.arange(n), np.arange(len(x)), []
    while True:
        p, q = home[x], home[y]
        open_ = p != q
        x, y, at, p, q = x[open_], y[open_], at[open_], p[open_], q[open_]
        if not len(at):
            return np.concatenate(taken) if taken else at, home
        # written backwards, so that a part's first pair stays
        first = np.full((2, n), len(at))
        back = np.arange(len(at))[::-1]
        first[0, p[::-1]], first[1, q[::-1]] = back, back
        first = first.min(axis=0)
        parts = np.flatnonzero(first < len(at))
        pick = first[parts]
        up = np.arange(n)
        up[parts] = np.where(p[pick] == parts, q[pick], p[pick])
        top = parts[(up[up[parts]] == parts) & (parts < up[parts])]
        up[top] = top
        while (over := up[up]).tobytes() != up.tobytes():
            up = over
        home = up[home]
        taken.append(at[np.unique(pick)])


def _block(edges, terminals):
    """Of each run in a block: its tree's edges (run, a, b, cost), and its nodes (run, node, tree, null)."""
    names = pc.unique(pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]))
    names = names.take(pc.sort_indices(names))
    code = lambda c: pc.index_in(c, value_set=names).to_numpy()
    a, b, cost = code(edges["a"]), code(edges["b"]), edges["cost"].to_numpy()
    order = np.lexsort((cost, b, a))
    a, b, cost = a[order], b[order], cost[order]
    arcs = np.argsort(np.r_[a, b], kind="stable")
    arc_to, arc_cost = np.r_[b, a][arcs], np.r_[cost, cost][arcs]
    start = np.r_[0, np.cumsum(np.bincount(np.r_[a, b], minlength=len(names)))]
    at = pc.index_in(terminals["node"], value_set=names)
    terminals, at = terminals.filter(pc.is_valid(at)), at.drop_null().to_numpy()
    run_of = terminals["run"].to_numpy()
    out = [pa.table({"run": pa.array([], pa.int32()), "a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "cost": pa.array([], pa.float64())})]
    for run in np.unique(run_of):
        dist, seed, via, step = _near(start, arc_to, arc_cost, np.unique(at[run_of == run]).astype(np.int32))
        bridge = np.flatnonzero((seed[a] != seed[b]) & (seed[a] >= 0) & (seed[b] >= 0))
        bridge = bridge[np.argsort((dist[a[bridge]] + cost[bridge]) + dist[b[bridge]], kind="stable")]
        taken, home = _joined(len(names), seed[a[bridge]], seed[b[bridge]])
        out.append(_trees_of(run, names, bridge[taken], a, b, cost, seed, via, step, home))
    return pa.concat_tables(out)


def _trees_of(run, names, taken, a, b, cost, seed, via, step, home):
    """The rows of one run: the taken edges, the ways from them to their terminals, and the nodes of both with their tree."""
    walked = np.zeros(len(names), bool)
    way = np.unique(np.r_[a[taken], b[taken]])
    while len(way):
        walked[way] = True
        way = np.unique(via[way])
        way = way[way >= 0]
        way = way[~walked[way]]
    nodes = np.flatnonzero(walked)
    inner = nodes[via[nodes] >= 0]
    x = np.r_[a[taken], np.minimum(inner, via[inner]), nodes]
    y = np.r_[b[taken], np.maximum(inner, via[inner]), home[seed[nodes]]]
    c = pa.array(np.r_[cost[taken], step[inner], np.zeros(len(nodes))], mask=np.arange(len(x)) >= len(x) - len(nodes))
    return pa.table([pa.array(np.full(len(x), run, np.int32)), names.take(pa.array(x)), names.take(pa.array(y)), c], ["run", "a", "b", "cost"])


def region_trees(edges: DataFrame, terminals: DataFrame, runs: int) -> DataFrame:
    """(run, a, b, cost): the trees' edges of every run, and with a null cost each node a of a tree b.

    edges: a, b, cost, at most NAMED of them; terminals: run, node. The edges are sent once for every block of runs.
    """
    blocks = max(1, min(runs, BLOCKS))
    sent = edges.where("a is not null and b is not null").select("a", "b", "cost", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = terminals.select("run", "node", F.pmod("run", F.lit(blocks)).cast("int").alias("block"))
    # more partitions than blocks, so that few blocks meet in one
    parts = lambda df: df.repartition(4 * blocks, "block").groupBy("block")
    met = parts(sent).cogroup(parts(dealt))
    return met.applyInArrow(_block, _OUT)


def _slices(n):
    return (slice(i, min(i + SLICE, n)) for i in range(0, n, SLICE))


def _best_offers(offers, seed, hops):
    """Of offers (x, y, d, c) the least of each y by (d, seed, hops, x)."""
    x, y, d, c = (np.concatenate(o) for o in zip(*offers))
    order = np.lexsort((x, hops[x], seed[x], d, y))
    order = order[np.r_[True, np.diff(y[order]) != 0]] if len(order) else order
    return x[order], y[order], d[order], c[order]


def _near_by_slices(n, a, b, cost, ends):
    """_near over edges in any order, a slice at a time: a round reads those with an end that changed in the last one."""
    dist, low, step = np.full(n, np.inf), np.full(n, np.inf), np.zeros(n)
    seed, hops, via = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.full(n, -1, np.int32)
    dist[ends], seed[ends] = 0.0, ends
    front = ends
    while len(front):
        active = np.zeros(n, bool)
        active[front] = True
        offers, held = [], 0
        for part in _slices(len(a)):
            for x, y in ((a[part], b[part]), (b[part], a[part])):
                on = np.flatnonzero(active[x])
                x, y, c = x[on], y[on], cost[part][on]
                d = dist[x] + c
                better = d < np.minimum(dist[y] - 1e-12, np.nextafter(low[y], np.inf))
                x, y, d, c = x[better], y[better], d[better], c[better]
                np.minimum.at(low, y, d)
                least = d == low[y]
                offers.append((x[least], y[least], d[least], c[least]))
                held += int(least.sum())
            if held > OFFERS:
                offers = [_best_offers(offers, seed, hops)]
                held = len(offers[0][0])
        x, front, d, c = _best_offers(offers, seed, hops) if offers else (ends[:0],) * 4
        low[front] = np.inf
        seed[front], hops[front], via[front], dist[front], step[front] = seed[x], hops[x] + 1, x, d, c
    return dist, seed, via, step


def _sorted_bridges(length, at, a, b, cost):
    order = np.argsort(length, kind="stable")
    if (np.diff(length[order]) == 0).any():
        order = np.lexsort((cost[at], b[at], a[at], length))
    return length[order], at[order]


def _joined_by_slices(n, a, b, cost, dist, seed):
    """The places of the edges that join the regions to trees, in the order of (length, a, b, cost), and the tree of each of n parts.

    The shortest bridges come first, up to a length that a sample gives; of the others only those between different trees are sorted. More than
    BRIDGES are thinned to their spanning forest on the way.
    """
    home, taken, above = np.arange(n), [], -np.inf
    every = max(1, len(a) // 1_000_000)
    sa, sb = seed[a[::every]], seed[b[::every]]
    sample = np.sort((dist[a[::every]] + cost[::every] + dist[b[::every]])[(sa != sb) & (sa >= 0) & (sb >= 0)])
    share = BRIDGES / 2 / max(1, len(a))
    for limit in ([sample[int(share * len(sample))]] if share < 1 and len(sample) else []) + [np.inf]:
        lengths, places, held = [], [], 0

        def forest():
            length, at = _sorted_bridges(np.concatenate(lengths), np.concatenate(places), a, b, cost)
            kept, up = _joined(n, home[seed[a[at]]], home[seed[b[at]]])
            return length[kept], at[kept], up

        for part in _slices(len(a)):
            sa, sb = seed[a[part]], seed[b[part]]
            on = np.flatnonzero((sa != sb) & (sa >= 0) & (sb >= 0))
            on = on[home[sa[on]] != home[sb[on]]]
            length = (dist[a[part][on]] + cost[part][on]) + dist[b[part][on]]
            inside = (length > above) & (length <= limit)
            lengths.append(length[inside])
            places.append(on[inside] + part.start)
            held += int(inside.sum())
            if held > BRIDGES:
                length, at, _ = forest()
                lengths, places, held = [length], [at], len(at)
        if held:
            _, at, up = forest()
            home = up[home]
            taken.append(at)
        above = limit
    return np.concatenate(taken) if taken else np.zeros(0, np.int64), home


def _coded_block(edges: int, names: int):
    def solve(batches):
        """Of one block: names (0, code, -, -, name), edges (1, a, b, cost) and terminals (2, code, run), in any order."""
        a, b, cost = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges)
        n, ends, named, codes = 0, [], [], []
        for batch in batches:
            kind = batch["kind"].to_numpy()
            x, y = batch["a"].to_numpy(), batch["b"].to_numpy(zero_copy_only=False)
            on = np.flatnonzero(kind == 1)
            if len(on):
                a[n : n + len(on)], b[n : n + len(on)], cost[n : n + len(on)] = x[on], y[on], batch["cost"].to_numpy(zero_copy_only=False)[on]
                n += len(on)
            if (kind == 2).any():
                ends.append(np.stack([x[kind == 2], y[kind == 2].astype(np.int32)]))
            if (kind == 0).any():
                named.append(batch["name"].filter(pa.array(kind == 0)))
                codes.append(x[kind == 0])
        if not ends:
            return
        a, b, cost = a[:n], b[:n], cost[:n]
        name = pa.concat_arrays(named).take(pa.array(np.argsort(np.concatenate(codes))))
        at, run_of = np.concatenate(ends, axis=1)
        for run in np.unique(run_of):
            dist, seed, via, step = _near_by_slices(names, a, b, cost, np.unique(at[run_of == run]))
            taken, home = _joined_by_slices(names, a, b, cost, dist, seed)
            yield from _trees_of(run, name, taken, a, b, cost, seed, via, step, home).combine_chunks().to_batches(max_chunksize=100_000)

    return solve


def coded_trees(edges: DataFrame, terminals: DataFrame, runs: int) -> DataFrame | None:
    """region_trees for networks of at most EDGES edges; None where they have more than NODES nodes.

    Nodes go by their place among all names, so that ties are broken alike. The edges are sent once for every block, the fewer blocks the more edges.
    """
    known = edges.where("a is not null and b is not null")
    codes, n, _ = cut_counted(counted_values(nodes_of(known, "a", "b"), ["node"]).select("node", F.col("n_before").cast("int").alias("code")), "region-names")
    if n > NODES:
        return None
    code = lambda c: codes.select(F.col("node").alias(c), F.col("code").alias(f"{c}_code")).hint("shuffle_hash")
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda kind, a, b, cost, name: [F.lit(kind).alias("kind"), F.col(a).alias("a"), b.alias("b"), cost.alias("cost"), name.alias("name")]
    coded, m, _ = cut_counted(known.join(code("a"), "a").join(code("b"), "b").select(F.col("a_code").alias("a"), F.col("b_code").alias("b"), "cost"), "region-edges")
    blocks = max(1, min(runs, BLOCKS, PLACED // max(1, m)))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    sent = codes.select(*row(0, "code", none("int"), none("double"), F.col("node")), every)
    sent = sent.unionByName(coded.select(*row(1, "a", F.col("b"), F.col("cost"), none("string")), every))
    ends = terminals.select("run", "node").join(code("node"), "node").select(*row(2, "node_code", F.col("run"), none("double"), none("string")), F.pmod("run", F.lit(blocks)).cast("int").alias("block"))
    return sent.unionByName(ends).repartitionById(blocks, "block").drop("block").mapInArrow(_coded_block(m, n), _OUT)
