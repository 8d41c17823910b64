"""Grids against settings that are evaluated one by one, and hubs that no task holds alone."""

import random

import pytest
from pyspark.sql import functions as F

from cohortweave.operators import propagation


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(1)
    pairs = {(f"n{a}", f"n{b}") for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(260)) if a != b}
    edges = spark.createDataFrame([(a, b, rng.choice([1, -1])) for a, b in sorted(pairs)], "source string, target string, sign int")
    return propagation.signed_matrix(edges), propagation.signed_matrix(edges.where("source < 'n3'"))


def test_a_grid_is_its_settings(spark, net):
    sets = {"a": [("n1", 1.0), ("n2", -1.0)], "b": [("n7", 0.5)], "none": [("zz", 1.0)]}
    rng = random.Random(2)
    seen = {o: [(f"n{i}", rng.gauss(0, 1), rng.random() < 0.8) for i in range(40)] for o in ("x", "y")}
    matrices = net[0].withColumn("network", F.lit("p")).unionByName(net[1].withColumn("network", F.lit("q")))
    seeds = spark.createDataFrame([(s, *r) for s, rows in sets.items() for r in rows], "seeds string, node string, state double")
    observed = spark.createDataFrame([(o, *r) for o, rows in seen.items() for r in rows], "observation string, node string, value double, sig boolean")
    got = {(r["network"], r["seeds"], r["observation"], r["k_hops"]): r for r in propagation.evaluate_grid(matrices, seeds, observed, [1, 3], least=5).collect()}
    assert len(got) == 2 * 3 * 2 * 2 and got["p", "none", "x", 3]["n_reached"] == 0
    for name, matrix, s, o, k in (("p", net[0], "a", "x", 3), ("q", net[1], "b", "y", 1)):
        mine = spark.createDataFrame(sets[s], "node string, state double")
        pred = propagation.propagate(matrix, mine, hops=k).withColumn("state", F.round("state", 12))
        want = propagation.score_prediction(pred, spark.createDataFrame(seen[o], "node string, value double, sig boolean"), mine.select("node"), least=5, runs=spark.sql("SELECT 0 AS run")).first()
        for c in ("rho_global", "rho_local", "rho_conf", "sign_acc", "sign_acc_conf", "n_reached", "n_sign_scored", "n_conf"):
            assert got[name, s, o, k][c] == pytest.approx(want[c]), c


def test_a_hub_with_half_of_all_edges(spark, monkeypatch):
    edges = [("hub", f"t{i}", 1.0) for i in range(600)] + [(f"t{i}", "hub", 1.0) for i in range(600)] + [(f"t{i}", f"t{(i * 7 + 1) % 600}", -0.5) for i in range(600)]
    matrix = spark.createDataFrame(edges, "source string, target string, w double")
    seeds = spark.createDataFrame([(1, "hub", 1.0), (2, "t3", -1.0)], "run int, node string, state double")
    plain = {(r["run"], r["node"]): r["state"] for r in propagation.propagate(matrix, seeds, hops=3).collect()}
    monkeypatch.setattr(propagation, "HEAVY", 40)
    for keys, by in ((["source"], "target"), (["target"], "source")):
        dealt, hubs = propagation.dealt_by(matrix, keys, by)
        sizes = dealt.groupBy(*keys, "block").count().toPandas()["count"]
        assert hubs.count() == 1 and sizes.max() <= 80 and sizes.sum() == len(edges)
    split = {(r["run"], r["node"]): r["state"] for r in propagation.propagate(matrix, seeds, hops=3).collect()}
    assert split.keys() == plain.keys() and all(split[k] == pytest.approx(v) for k, v in plain.items())


def test_runs_in_blocks_are_those_of_single_runs(spark, monkeypatch):
    """Any number of blocks gives what each run gives alone, reached zeros too, and an entry times a run is no row."""
    import random

    from cohortweave.operators import propagation

    r = random.Random(5)
    pairs = {(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(150)}
    matrix = spark.createDataFrame([(a, b, r.choice([-2.0, -1.0, 1.0, 3.0])) for a, b in sorted(pairs)] + [("z1", "z", 1.0), ("z2", "z", -1.0)], "source string, target string, w double")
    rows = [(run, f"n{n}", r.choice([-1.0, 0.5])) for run in (3, 4, 9, 12) for n in r.sample(range(35), 4)] + [(4, "z1", 1.0), (4, "z2", 1.0)]
    seeds = spark.createDataFrame(rows, "run int, node string, state double")
    want = {}
    for run in (3, 4, 9, 12):
        want |= {(run, x["node"]): x["state"] for x in propagation.propagate(matrix, seeds.where(f"run = {run}").drop("run")).collect()}
    assert (4, "z") in want and abs(want[4, "z"]) < 1e-12
    for name, size in (("SOURCES", 8), ("CELLS", 20), ("ENTRIES", 12), ("SLICE", 5)):
        assert getattr(propagation, name) > size
        monkeypatch.setattr(propagation, name, size)
        got = {(x["run"], x["node"]): x["state"] for x in propagation.propagate(matrix, seeds).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_blocks_stay_within_their_bounds_and_grow_in_number_only():
    from cohortweave.operators.propagation import CELLS, ENTRIES, SOURCES, _block_sizes

    for nodes, entries, runs in ((90_000, 6_000_000, 300), (540_000, 36_000_000, 300), (5_000_000, 400_000_000, 300), (10, 20, 3)):
        s, t, c = _block_sizes(nodes, entries, runs)
        assert nodes / s <= SOURCES and -(-runs // c) * nodes / s <= 1.1 * CELLS and entries / (s * t) <= ENTRIES and c <= runs


def test_a_grid_moves_a_node_once_and_counts_a_value_once(spark, net, monkeypatch):
    """A hop has a row for a node, and a rank a row for a value of a run, not one for each setting; more names than WIDE change no state."""
    rows = {}

    def counted(df, name):
        out = cut(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    from cohortweave.functions import ranks
    from cohortweave.scratch import cut

    monkeypatch.setattr(propagation, "cut", counted)
    monkeypatch.setattr(ranks, "cut", counted)
    matrices = net[0].withColumn("network", F.lit("p")).unionByName(net[1].withColumn("network", F.lit("q"))).unionByName(net[1].withColumn("network", F.lit("r")))
    sets = {"a": [("n1", 1.0), ("n2", -1.0)], "b": [("n7", 0.5), ("n7", 0.25)], "c": [("n9", 1.0)]}
    seeds = spark.createDataFrame([(s, *r) for s, of in sets.items() for r in of], "seeds string, node string, state double")
    seen = spark.createDataFrame([("x", f"n{i}", float(i % 7), i % 5 > 0) for i in range(40)], "observation string, node string, value double, sig boolean")
    propagation.evaluate_grid(matrices, seeds, seen, [1, 3], least=5).collect()
    assert len(rows["grid-hop"]) == 3 and max(rows["grid-hop"]) <= 40
    assert max(rows["ranks"]) <= rows["scored"][0]
    for wide in (4, 2):
        monkeypatch.setattr(propagation, "WIDE", wide)
        got = {(r["network"], r["seeds"], r["k_hops"], r["node"]): r["state"] for r in propagation.propagate_grid(matrices, seeds, [1, 3]).collect()}
        for name, matrix, s, k in (("p", net[0], "a", 3), ("q", net[1], "b", 1), ("r", net[1], "c", 3)):
            want = {r["node"]: r["state"] for r in propagation.propagate(matrix, spark.createDataFrame(sets[s], "node string, state double"), hops=k).collect()}
            mine = {n: x for (w, o, d, n), x in got.items() if (w, o, d) == (name, s, k)}
            assert mine.keys() == want.keys() and all(mine[n] == pytest.approx(want[n]) for n in want)
