"""The solver's parts against plain versions, and draws as permutations."""

import heapq
import math
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortweave.functions import draws
from cohortweave.operators import propagation, solver
from cohortweave.scratch import Scope


def tree_of(rng, n, run, shape):
    """Random edges (run, a, b, cost) of a tree of n nodes: a path, a star, or each node under an earlier one."""
    over = {"path": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rng.randrange(i)}[shape]
    order = rng.sample(range(n), n)
    return [(run, f"n{order[i]:04d}", f"n{order[over(i)]:04d}", round(rng.uniform(0.1, 1.0), 3)) for i in range(1, n)]


def plain_gains(edges, net, root):
    """{node: (parent, gain)} by a walk from the root."""
    around = {}
    for _, a, b, c in edges:
        around.setdefault(a, []).append((b, c))
        around.setdefault(b, []).append((a, c))
    order, parent = [root], {root: None}
    for x in order:
        for y, c in around.get(x, []):
            if y not in parent:
                parent[y] = (x, c)
                order.append(y)
    total, out = dict(net), {}
    for x in reversed(order):
        if parent[x] is not None:
            p, c = parent[x]
            gain = max(0.0, total[x] - c)
            total[p] += gain
            out[x] = (p, gain)
    return out


@pytest.mark.parametrize("shape, n, few", [("path", 40, 0), ("random", 60, 0), ("random", 60, 50_000)])
def test_settled_leaves_and_pruned_trees(spark, monkeypatch, shape, n, few):
    monkeypatch.setattr(solver, "FEW", few)
    rng = random.Random(n)
    edges, worth, roots, want, best = [], [], [], {}, {}
    for run in range(3):
        mine = tree_of(rng, n, run, shape)
        net = {f"n{i:04d}": round(rng.choice([0.0, 0.0, rng.uniform(0, 1.2)]), 3) for i in range(n)}
        root = min(net, key=lambda x: (-net[x], x))
        gains = plain_gains(mine, net, root)
        want |= {(run, x): g for x, g in gains.items()}
        keep = {root}
        while more := {x for x, (p, g) in gains.items() if g > 0 and p in keep and x not in keep}:
            keep |= more
        best[run] = keep
        edges, worth, roots = edges + mine, worth + [(run, x, v) for x, v in net.items()], [*roots, (run, root)]
    tree = spark.createDataFrame(edges, "run int, a string, b string, cost double")
    net = spark.createDataFrame(worth, "run int, node string, net double")
    got = solver.settled_leaves(tree, net, spark.createDataFrame(roots, "run int, node string")).collect()
    assert {(r["run"], r["node"]): r["parent"] for r in got} == {k: p for k, (p, _) in want.items()}
    for r in got:
        assert r["gain"] == pytest.approx(want[r["run"], r["node"]][1], abs=1e-9)
    kept, nodes = solver.prune_trees(tree, net.withColumnRenamed("net", "p"))
    found = {}
    for r in nodes.collect():
        found.setdefault(r["run"], set()).add(r["node"])
    assert found == best and kept.count() == sum(len(k) - 1 for k in best.values())


def test_stripped_leaves(spark):
    rng = random.Random(3)
    edges = tree_of(rng, 80, 0, "random")
    terminals = set(rng.sample([f"n{i:04d}" for i in range(80)], 9))
    left = list(edges)
    while True:
        ends = [x for _, a, b, _ in left for x in (a, b)]
        rest = [e for e in left if all(ends.count(x) > 1 or x in terminals for x in e[1:3])]
        if len(rest) == len(left):
            break
        left = rest
    tree = spark.createDataFrame(edges, "run int, a string, b string, cost double")
    at = spark.createDataFrame([(0, t) for t in terminals], "run int, node string")
    got = solver.stripped_leaves(tree, at, at.limit(1))
    assert sorted(map(tuple, got.collect())) == sorted(left)


def counting(monkeypatch, *names):
    """How often the solver's functions of these names are called."""
    seen = dict.fromkeys(names, 0)
    for name in names:
        real = getattr(solver, name)

        def called(*args, _real=real, _name=name, **kwargs):
            seen[_name] += 1
            return _real(*args, **kwargs)

        monkeypatch.setattr(solver, name, called)
    return seen


def test_a_path_of_2000_nodes_takes_few_rounds(spark, monkeypatch):
    path = [(f"n{i:04d}", f"n{i + 1:04d}", 0.1) for i in range(1999)]
    monkeypatch.setattr(solver, "FEW", 0)
    seen = counting(monkeypatch, "cut", "cut_counted")
    tree = spark.createDataFrame(path, "a string, b string, cost double")
    edges, nodes = solver.prune_trees(tree.withColumn("run", F.lit(0)), spark.createDataFrame([("n0000", 500.0), ("n1999", 400.0)], "node string, p double"), spark.createDataFrame([(0, f"n{i:04d}", "t") for i in range(2000)], "run int, node string, tree string"))
    assert edges.count() == 1999 and nodes.count() == 2000 and sum(seen.values()) <= 40
    seen.update(dict.fromkeys(seen, 0))
    near = solver.nearest_terminal(tree, spark.createDataFrame([("n0000",), ("n1999",)], "node string"))
    assert near.agg(F.round(F.max("dist"), 6), F.max("hops"), F.count("*")).first()[:] == (99.9, 999, 2000) and sum(seen.values()) <= 40


def graph(rng, chains):
    """Edges of a random graph with zero costs and ties, of which some are long chains."""
    edges = {}
    for _ in range(45):
        a, b = rng.sample(range(20), 2)
        edges[f"g{min(a, b):02d}", f"g{max(a, b):02d}"] = rng.choice([0.0, 0.1, 0.1, 0.5])
    for k in range(chains):
        names = [f"g{rng.randrange(20):02d}", *[f"c{k}{i:02d}" for i in range(rng.randint(1, 12))], f"g{rng.randrange(20):02d}"]
        edges |= {(a, b): rng.choice([0.0, 0.1, 0.2]) for a, b in zip(names, names[1:]) if a != b}
    ring = [f"r{i}" for i in range(5)]
    return edges | {(a, b): 0.1 for a, b in zip(ring, ring[1:] + ring[:1])}


def dijkstra(edges, sources):
    around, dist, todo = {}, {}, [(0.0, s) for s in sources]
    for (a, b), c in edges.items():
        around.setdefault(a, []).append((b, c))
        around.setdefault(b, []).append((a, c))
    while todo:
        d, x = heapq.heappop(todo)
        if x not in dist:
            dist[x] = d
            for y, c in around.get(x, []):
                heapq.heappush(todo, (d + c, y))
    return dist


@pytest.mark.parametrize("seed, chains", [(1, 9), (2, 0)])
def test_nearest_terminals_distances_and_known_ways(spark, seed, chains):
    rng = random.Random(seed)
    edges = graph(rng, chains)
    cost = edges | {(b, a): c for (a, b), c in edges.items()}
    names = sorted({x for e in edges for x in e if x[0] != "r"})
    ends = {run: rng.sample(names, 3) for run in range(3)}
    net = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "a string, b string, cost double")
    terminals = spark.createDataFrame([(run, t) for run, ts in ends.items() for t in ts], "run int, node string")
    table = solver.distance_table(net, terminals, radius=0.2)
    for src, some in {r["src"]: None for r in table.select("src").collect()}.items():
        want = {k: d for k, d in dijkstra(edges, [src]).items() if d <= 0.2 + 1e-12}
        assert {r["node"]: pytest.approx(r["dist"]) for r in table.where(F.col("src") == src).collect()} == want
    for known in (None, solver.known_from(table, terminals)):
        rows = {(r["run"], r["node"]): r for r in solver.nearest_terminal(net, terminals, known).collect()}
        for run, ts in ends.items():
            want = dijkstra(edges, ts)
            assert {n: pytest.approx(r["dist"], abs=1e-9) for (k, n), r in rows.items() if k == run} == want
            for node in want:
                at, walked, hops = node, 0.0, 0
                while rows[run, at]["via"] is not None:
                    walked, hops, at = walked + cost[at, rows[run, at]["via"]], hops + 1, rows[run, at]["via"]
                    assert hops <= len(names)
                assert at in ts and walked == pytest.approx(want[node], abs=1e-9)


@pytest.mark.parametrize("few", [0, 50_000])
def test_spanning_forest_with_ties(spark, monkeypatch, few):
    monkeypatch.setattr(solver, "FEW", few)
    rng = random.Random(4)
    edges = sorted({(*sorted(rng.sample(range(60), 2)), rng.choice([0.1, 0.2])) for _ in range(150)})
    cheapest = {}
    for a, b, c in edges:
        cheapest[a, b] = min(c, cheapest.get((a, b), 9))
    root, want = list(range(60)), set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in sorted(cheapest.items(), key=lambda e: (e[1], e[0])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, c))
    got = solver.spanning_forest(spark.createDataFrame(edges, "a long, b long, cost double")).collect()
    assert {tuple(r) for r in got} == want


def forest_inputs(spark, rng, n=40, e=90):
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(e)}
    edges = spark.createDataFrame([(f"v{a}", f"v{b}", round(rng.uniform(0.05, 1), 3)) for a, b in sorted(pairs)], "source string, target string, cost double")
    return edges, spark.createDataFrame([(f"v{i}", round(rng.uniform(0.2, 1.5), 3)) for i in range(0, n, 3)], "node string, prize double")


def test_reruns_share_one_table_of_distances_and_give_the_same(spark, monkeypatch):
    edges, prizes = forest_inputs(spark, random.Random(8))
    seen, some = counting(monkeypatch, "distance_table"), []
    for radius, few in ((None, 50_000), (0.0, 0)):
        monkeypatch.setattr(solver, "FEW", few)
        some.append([sorted(map(tuple, df.collect())) for df in solver.robust_forest(edges, prizes, omega=0.6, mu=0.0, runs=3, radius=radius)])
    assert some[0] == some[1] and some[0][0] and seen["distance_table"] == 1


def test_no_scratch_is_left(spark):
    base = re.sub("^file:/*", "/", spark.conf.get("spark.checkpoint.dir"))
    edges, prizes = forest_inputs(spark, random.Random(9))
    before = set(os.listdir(base))
    with Scope():
        e, v = solver.solve_forest(edges, prizes, omega=0.6, mu=0.0)
        assert e.count() < v.count()
        assert len(set(os.listdir(base)) - before) == 2
    assert set(os.listdir(base)) == before


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_draws_are_permutations_and_the_same_in_sql(spark, n):
    keys = spark.range(3).select(F.col("id").cast("int").alias("run")).crossJoin(spark.range(n).select(F.col("id").alias("x")))
    key = draws.draw_key(5, F.col("run"), F.lit(2))
    got = {(r["run"], r["x"]): r["y"] for r in keys.select("run", "x", draws.permuted(F.col("x"), F.lit(n), key).alias("y")).collect()}
    for run in range(3):
        assert sorted(got[run, x] for x in range(n)) == list(range(n))
    sql = f"SELECT run, x, {draws.permuted_sql('x', 'n', 'k')} FROM (SELECT run, x, {n} AS n, {draws.draw_key_sql(5, 'run', '2')} AS k FROM range(3) AS r(run), range({n}) AS s(x))"
    assert {(r, x): y for r, x, y in duckdb.sql(sql).fetchall()} == got


def test_draws_are_even(spark):
    """Each of 7 places gets each node about as often, and so does each pair of neighbours."""
    runs = 4200
    rows = spark.range(1, runs + 1).select(F.col("id").alias("run")).crossJoin(spark.range(7).select(F.col("id").alias("x")))
    moved = rows.select("run", "x", draws.permuted(F.col("x"), F.lit(7), draws.draw_key(1, F.col("run"), F.lit(1))).alias("y"))
    counts = moved.groupBy("x", "y").count().toPandas()["count"]
    assert len(counts) == 49 and ((counts - 600).abs() < 5 * math.sqrt(600)).all()
    pairs = moved.alias("a").join(moved.alias("b"), (F.col("a.run") == F.col("b.run")) & (F.col("a.x") == 0) & (F.col("b.x") == 1)).groupBy("a.y", "b.y").count().toPandas()["count"]
    assert len(pairs) == 42 and ((pairs - 100).abs() < 5.5 * 10).all()


def test_a_run_that_reaches_nothing_keeps_its_row(spark):
    matrix = propagation.signed_matrix(spark.createDataFrame([("a", "b", 1), ("c", "b", -1)], "source string, target string, sign int"))
    seeds = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (3, "zz", 1.0)], "run int, node string, state double")
    observed = spark.createDataFrame([("b", 1.0), ("c", 2.0)], "node string, value double")
    got = propagation.score_prediction(propagation.propagate(matrix, seeds), observed, runs=seeds)
    assert {r["run"]: r["n_reached"] for r in got.collect()} == {1: 1, 2: 0, 3: 0}
    wide = spark.createDataFrame([(f"s{i}", f"t{i % 3}", 1) for i in range(30)], "source string, target string, sign int")
    sinks = spark.createDataFrame([("t0", 1.0), ("t1", -1.0)], "node string, state double")
    nodes = spark.createDataFrame([(f"s{i}", float(i)) for i in range(30)], "node string, value double")
    assert sorted(r["run"] for r in propagation.null_scores(propagation.signed_matrix(wide), sinks, nodes, runs=12).collect()) == list(range(1, 13))


def test_draws_are_dealt_into_partitions_of_a_bounded_number(spark, monkeypatch):
    monkeypatch.setattr(draws, "DRAWS", 50)
    names = [f"n{i:03d}" for i in range(40)]
    binned = spark.createDataFrame([(x, i // 20, i + 1) for i, x in enumerate(names)], "node string, bin int, rank int")
    held = spark.createDataFrame([(x, float(i)) for i, x in enumerate(names)], "node string, prize double")
    with Scope():
        moved = draws.permuted_nodes(binned, held, 10, 1)
        assert re.search(r"hashpartitioning\(node#\d+, 8\), REPARTITION_BY_NUM", moved._jdf.queryExecution().toString())
        rows = moved.collect()
    assert len({(r["run"], r["node"]) for r in rows}) == len(rows) == 400


def test_draws_are_not_broadcast(spark):
    names = [f"n{i:03d}" for i in range(40)]
    binned = spark.createDataFrame([(x, i // 20, i + 1) for i, x in enumerate(names)], "node string, bin int, rank int")
    held = spark.createDataFrame([(x, float(i)) for i, x in enumerate(names)], "node string, prize double")
    with Scope():
        moved = draws.permuted_nodes(binned, held, 10, 1)
        assert "BroadcastHashJoin [bin" not in moved._jdf.queryExecution().sparkPlan().toString()
        assert moved.select("run", "node").distinct().count() == 400
