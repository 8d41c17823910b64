"""The SQL of the forest steps and the library's solver, two implementations, on random networks with several runs."""

import random

import pytest

from cohortweave.operators import solver
from cohortweave.plans.forest_sql import forest_sql

duckdb = pytest.importorskip("duckdb")


def world(seed):
    """Edges with costs of their own, in two parts and a lone pair, and prizes of three runs, some below the penalty."""
    rng, edges, prizes = random.Random(seed), {}, []
    for part, n, m in (("x", 30, 60), ("y", 12, 14)):
        for _ in range(m):
            a, b = sorted(rng.sample(range(n), 2))
            edges[f"{part}{a:02d}", f"{part}{b:02d}"] = rng.uniform(0.05, 0.7)
    edges["z0", "z1"] = 0.4
    names = sorted({x for e in edges for x in e})
    for run in range(3):
        prizes += [(run, x, rng.choice([0.001, rng.uniform(0.1, 1.5)])) for x in rng.sample(names, 5 + 4 * run)]
        prizes.append((run, "z0", 0.9))
    return [(a, b, c) for (a, b), c in edges.items()], prizes


@pytest.mark.parametrize("seed, few, omega", [(1, 0, 0.3), (2, 50_000, 0.6)])
def test_forest_of_both(spark, monkeypatch, seed, few, omega):
    monkeypatch.setattr(solver, "FEW", few)
    edges, prizes = world(seed)
    e, v = solver.solve_forest(spark.createDataFrame(edges, "source string, target string, cost double"), spark.createDataFrame(prizes, "run int, node string, prize double"), omega, 0.01)
    got = sorted((r["run"], *sorted((r["a"], r["b"])), round(r["cost"], 9)) for r in e.collect())
    nodes = sorted((r["run"], r["node"], round(r["p"], 9), r["terminal"]) for r in v.collect())
    c = duckdb.connect()
    c.execute("CREATE TABLE fe (a VARCHAR, b VARCHAR, cost DOUBLE)")
    c.execute("CREATE TABLE fp (run INTEGER, node VARCHAR, prize DOUBLE)")
    c.executemany("INSERT INTO fe VALUES (?, ?, ?)", edges)
    c.executemany("INSERT INTO fp VALUES (?, ?, ?)", prizes)
    ask = lambda select: c.execute("WITH RECURSIVE " + ",\n".join(forest_sql(omega, 0.01)) + "\n" + select).fetchall()
    assert got and got == sorted(ask("SELECT run, a, b, round(cost,9) FROM fedges"))
    assert nodes == sorted(ask("SELECT run, node, round(p,9), terminal FROM fnodes"))
    assert any(not terminal for *_, terminal in nodes)


@pytest.mark.parametrize("edges_of_a_block, run_few", [(10_000, 500_000), (10_000, 0), (0, 0)])
def test_blocks_of_runs_and_joins_give_the_same_forest(spark, monkeypatch, edges_of_a_block, run_few):
    """Runs are worked out in blocks, no row of an edge and a run is made; larger networks go by joins."""
    monkeypatch.setattr(solver, "FEW", 0)
    monkeypatch.setattr(solver, "RUN_FEW", run_few)
    monkeypatch.setattr(solver.regions, "EDGES", edges_of_a_block)
    monkeypatch.setattr(solver.regions, "SLICE", 7)
    joined, plain = [], solver.nearest_terminal
    monkeypatch.setattr(solver, "nearest_terminal", lambda *a: joined.append(1) or plain(*a))
    edges, prizes = world(5)
    e, v = solver.solve_forest(spark.createDataFrame(edges, "source string, target string, cost double"), spark.createDataFrame(prizes, "run int, node string, prize double"), 0.4, 0.01)
    got = sorted((r["run"], *sorted((r["a"], r["b"])), round(r["cost"], 9)) for r in e.collect())
    nodes = sorted((r["run"], r["node"]) for r in v.collect())
    assert len(joined) == (not edges_of_a_block)
    c = duckdb.connect()
    c.execute("CREATE TABLE fe (a VARCHAR, b VARCHAR, cost DOUBLE)")
    c.execute("CREATE TABLE fp (run INTEGER, node VARCHAR, prize DOUBLE)")
    c.executemany("INSERT INTO fe VALUES (?, ?, ?)", edges)
    c.executemany("INSERT INTO fp VALUES (?, ?, ?)", prizes)
    ask = lambda select: c.execute("WITH RECURSIVE " + ",\n".join(forest_sql(0.4, 0.01)) + "\n" + select).fetchall()
    assert got and got == sorted(ask("SELECT run, a, b, round(cost,9) FROM fedges"))
    assert nodes == sorted(ask("SELECT run, node FROM fnodes"))


def test_the_steps_queries_work_their_network_out_once(spark, monkeypatch):
    from cohortweave.plans import queries

    seen = []
    monkeypatch.setattr(queries.solver, "steiner_trees", lambda net, ends: seen.extend([net, ends]) or (None, None, None))
    monkeypatch.setattr(queries.roles, "prizes", lambda *a: spark.createDataFrame([("u1", 0.5), ("u2", 0.6)], "node string, prize double"))
    monkeypatch.setattr(queries, "_edges", lambda *a: spark.createDataFrame([("u1", "u2", 0.4)], "source string, target string, cost double"))
    queries._steiner(spark, "")
    assert all(df.inputFiles() for df in seen) and seen[0].count() == 1


@pytest.mark.parametrize("ties", [False, True])
def test_blocks_of_numbered_nodes_give_the_same_forest(spark, monkeypatch, ties):
    """Networks of more than NAMED edges do not go by joins: their nodes get numbers, and a block reads them in slices."""
    for module, name, size in ((solver, "FEW", 0), (solver.regions, "SLICE", 7), (solver.regions, "BRIDGES", 9), (solver.regions, "OFFERS", 5)):
        monkeypatch.setattr(module, name, size)
    monkeypatch.setattr(solver, "nearest_terminal", None)
    edges, prizes = world(6)
    edges = spark.createDataFrame([(a, b, round(c, 1) if ties else c) for a, b, c in edges], "source string, target string, cost double")
    prizes, some = spark.createDataFrame(prizes, "run int, node string, prize double"), []
    for named in (10_000, 0):
        monkeypatch.setattr(solver.regions, "NAMED", named)
        e, v = solver.solve_forest(edges, prizes, 0.4, 0.01)
        some.append((sorted(tuple(r) for r in e.select("run", "a", "b", "cost").collect()), sorted(tuple(r) for r in v.select("run", "node", "prize", "p", "terminal").collect())))
    assert some[0] == some[1] and some[0][0]


def test_tables_of_many_runs_are_not_broadcast(spark, monkeypatch):
    """Files of columns that repeat are small, their rows are not: Spark would send them all through the driver."""
    monkeypatch.setattr(solver, "FEW", 0)
    monkeypatch.setattr(solver.regions, "EDGES", 0)
    plans, plain = {}, solver.cut
    monkeypatch.setattr(solver, "cut", lambda df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().sparkPlan().toString()) or plain(df, name))
    edges, prizes = world(7)
    solver.solve_forest(spark.createDataFrame(edges, "source string, target string, cost double"), spark.createDataFrame(prizes, "run int, node string, prize double"), 0.4, 0.01)
    for name in ("forest-prizes", "steiner-near", "forest-nodes"):
        assert plans[name] and not any("BroadcastHashJoin" in p for p in plans[name]), name
