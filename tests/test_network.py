import inspect
import itertools
import random
import warnings

import pytest
from pyspark.sql import functions as F

from cohortweave.operators import network, propagation, solver
from cohortweave.operators.components import connected_components
from cohortweave.sources import interactions, tables


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    df = spark.createDataFrame([*edges, (None, 5), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(df.limit(0)).count() == 0


def test_cost_graph(spark):
    raw = spark.createDataFrame([("A", "B", 1), ("B", "A", 9), ("C", "C", 5), ("COMP:x", "A", 4), ("", "A", 1), (None, "B", 2)], "source string, target string, confidence int")
    g = {(r["source"], r["target"]): r["cost"] for r in network.cost_graph(raw).collect()}
    assert g == pytest.approx({("B", "A"): 0.05, ("COMP:x", "A"): 1 / 3})
    assert network.cost_graph(raw, drop_complexes=True).count() == 1
    assert [r["cost"] for r in network.cost_graph(raw.drop("confidence")).collect()] == [0.5, 0.5]


def test_sign_algebra(spark):
    e = spark.createDataFrame([("A", "B", -1), ("B", "C", -1), ("A", "D", 1), ("D", "E", -1)], "source string, target string, sign int")
    s = spark.createDataFrame([("A", 1.0)], "node string, state double")
    out = {r["node"]: r["state"] for r in propagation.propagate(propagation.signed_matrix(e), s).collect()}
    assert out == {"B": -0.5, "C": 0.25, "D": 0.5, "E": -0.25}
    both = e.unionByName(spark.createDataFrame([("A", "B", 1), ("A", "A", 1)], e.schema))
    assert propagation.signed_matrix(both).where("source = 'A'").count() == 1


def test_planted_signal_is_recovered_and_noise_is_not(spark):
    random.seed(2)
    nodes = [f"G{i:03d}" for i in range(300)]
    edges = [(random.choice(nodes), random.choice(nodes), 1 if random.random() < 0.8 else -1, random.uniform(0.3, 1)) for _ in range(1500)]
    m = propagation.signed_matrix(spark.createDataFrame(edges, "source string, target string, sign int, weight double"), weight="weight").cache()
    seeds = spark.createDataFrame([(n, random.choice([-1.0, 1.0])) for n in random.sample(nodes, 25)], "node string, state double")
    truth = {r["node"]: r["state"] for r in propagation.propagate(m, seeds).collect()}
    obs = spark.createDataFrame([(n, truth.get(n, 0.0) + random.gauss(0, 0.02)) for n in nodes], "node string, value double")
    score = propagation.score_prediction(propagation.propagate(m, seeds), obs, seeds.select("node")).first()
    assert score["rho_conf"] > 0.8 and score["sign_acc_conf"] > 0.9
    null = propagation.null_scores(m, seeds, obs, runs=30).toPandas()
    assert len(null) == 30 and (null["rho_local"] < score["rho_local"]).mean() > 0.95
    moved = propagation.shuffle_seeds(seeds, propagation.degree_bins(m), 5).toPandas()
    assert not moved.duplicated(["run", "node"]).any()
    few = propagation.score_prediction(propagation.propagate(m, seeds).limit(3), obs.limit(6)).first()
    assert few["rho_local"] is None and few["sign_acc"] is None


def brute(edges, p, omega):
    """Best value of sum(p) - sum(cost) - omega * trees over all forests of a small graph, by edge subsets."""
    best = 0.0
    for k in range(len(edges) + 1):
        for chosen in itertools.combinations(edges, k):
            root = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    x = root[x]
                return x

            cyclic = False
            for a, b, _ in chosen:
                q, r = find(a), find(b)
                cyclic |= q == r
                root[q] = r
            if cyclic:
                continue
            trees = {}
            for x in root:
                trees.setdefault(find(x), []).append(x)
            value = sum(sum(p.get(x, 0) for x in t) - omega for t in trees.values()) - sum(c for *_, c in chosen)
            value += sum(v - omega for x, v in p.items() if x not in root and v > omega)
            best = max(best, value)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_is_valid_and_near_the_optimum(spark, seed):
    random.seed(seed)
    names = "ABCDEFG"
    edges = {tuple(sorted(random.sample(names, 2))): round(random.uniform(0.1, 0.6), 3) for _ in range(9)}
    rows = [(a, b, c) for (a, b), c in edges.items()]
    prizes = {n: round(random.uniform(0.4, 1.5), 3) for n in random.sample(names, 4)}
    e = spark.createDataFrame(rows, "source string, target string, cost double")
    v = spark.createDataFrame(list(prizes.items()), "node string, prize double")
    fe, fv = solver.solve_forest(e, v, omega=0.3, mu=0.0)
    got_e = [(r["a"], r["b"], r["cost"]) for r in fe.collect()]
    got_v = {r["node"] for r in fv.collect()}
    assert all(edges[tuple(sorted((a, b)))] == c for a, b, c in got_e)
    assert {x for a, b, _ in got_e for x in (a, b)} <= got_v
    info = solver.summarise_forest(fe, fv, 0.3).first()
    assert info["n_trees"] == len(got_v) - len(got_e) > 0
    used = {n for n in got_v if n in prizes}
    assert info["objective"] == pytest.approx(sum(prizes[n] for n in used) - sum(c for *_, c in got_e) - 0.3 * info["n_trees"])
    best = brute(rows, {n: x for n, x in prizes.items() if n in {y for r in rows for y in r[:2]}}, 0.3)
    assert best / 2 - 1e-9 <= info["objective"] <= best + 1e-9


def test_forest_connects_through_a_steiner_node(spark):
    e = spark.createDataFrame([("A", "S", 0.1), ("B", "S", 0.1), ("C", "S", 0.1), ("A", "B", 0.9), ("C", "T", 0.1), ("X", "Y", 0.1)], "source string, target string, cost double")
    v = spark.createDataFrame([("A", 1.0), ("B", 1.0), ("C", 1.0), ("X", 3.0)], "node string, prize double")
    fe, fv = solver.solve_forest(e, v, omega=0.5, mu=0.0)
    assert {frozenset((r["a"], r["b"])) for r in fe.collect()} == {frozenset(x) for x in ("AS", "BS", "CS")}
    assert {r["node"]: r["terminal"] for r in fv.collect()} == {"A": True, "B": True, "C": True, "S": False, "X": True}
    edges, nodes = solver.robust_forest(e, v, omega=0.5, mu=0.0, runs=5)
    assert {r["frequency"] for r in edges.collect()} == {1.0}
    p = solver.permutation_test(e, v, omega=0.5, mu=0.0, runs=5).first()
    assert p["observed_steiner"] == 1 and 0 < p["p_objective"] <= 1


def test_request_is_checked():
    url = interactions.request_url("http://x/q", ["dorothea"], 9606)
    assert "datasets=dorothea" in url and "fields=curation_effort,sources,references" in url
    for bad in (dict(datasets=["nope"]), dict(datasets=["dorothea"], fields=["nope"])):
        with pytest.raises(ValueError):
            interactions.request_url("http://x/q", **bad)
    with pytest.raises(TypeError):
        interactions.request_url("http://x/q", ["dorothea"], "human")
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        interactions.request_url("http://x/q", ["dorothea"], 7227)
    assert len(w) == 1


def test_records_from_a_file_and_a_url(spark, tmp_path):
    text = "source_genesymbol\ttarget_genesymbol\tcuration_effort\treferences\tsources\nA\tB\t3\t\"p1;p1;p2\tx;y\nB\tA\t1\t\tx\n"
    path = tmp_path / "net.tsv"
    path.write_text(text)
    for df in (interactions.load(spark, str(path)), interactions.fetch(spark, f"file://{path}")):
        got = {r["source_genesymbol"]: r["n_references"] for r in df.collect()}
        assert got == {"A": 3, "B": 0}
        assert interactions.interaction_graph(df).count() == 1
    (tmp_path / "bad.tsv").write_text("error\nsomething\n")
    with pytest.raises(ValueError):
        interactions.load(spark, str(tmp_path / "bad.tsv"))


def test_caches_bundles_and_sample_files(spark, tmp_path):
    made = []

    def ingest():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "c"), ingest).count() == 3
    assert made == [1]
    tables.write_bundle(spark, str(tmp_path / "b"), {"t": spark.range(4)}, {"x": 1})
    got, params = tables.read_bundle(spark, str(tmp_path / "b"), ["t"])
    assert got["t"].count() == 4 and params == {"x": 1}
    (tmp_path / "s1.txt").write_text("p1\t0.5\np2\tNA\n")
    manifest = spark.createDataFrame([("S1", "s1.txt", "", 1, "ok")], tables.MANIFEST)
    rows = tables.read_sample_files(spark, str(tmp_path / "s1.txt"), manifest).orderBy("probe").collect()
    assert [(r["sample"], r["beta"]) for r in rows] == [("S1", 0.5), ("S1", None)]
    tables.write_tsv(spark.range(2), str(tmp_path / "o"))
    assert tables.read_tsv(spark, str(tmp_path / "o"), "id long").count() == 2


def test_deep_trees_are_pruned_whole(spark, monkeypatch):
    """Chains longer than any number of rounds that the solver might stop at."""
    monkeypatch.setattr(solver, "ROUNDS", 2, raising=False)
    monkeypatch.setattr(solver, "FOLD", 2, raising=False)
    chain = [(f"n{i:02d}", f"n{i + 1:02d}", 0.1) for i in range(5)]
    tree = spark.createDataFrame(chain, "a string, b string, cost double")
    worth = spark.createDataFrame([(f"n{i:02d}", 5.0 if i == 0 else 0.3) for i in range(6)], "node string, p double")
    edges, nodes = solver.prune_trees(tree, worth)
    assert edges.count() == 5 and nodes.count() == 6
    gap = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", 0.1) for i in range(5)], "source string, target string, cost double")
    ends = spark.createDataFrame([("n00", 5.0), ("n05", 4.0)], "node string, prize double")
    edges, nodes = solver.solve_forest(gap, ends, omega=0.5, mu=0.0)
    assert edges.count() == 5 and nodes.count() == 6
    with pytest.raises(ValueError):
        solver.nearest_terminal(tree.withColumn("cost", -F.col("cost")), worth)


def test_resampling_queries_run_at_full_size(monkeypatch):
    """The registered queries ask for the reference's numbers of runs."""
    from cohortweave.plans import queries

    asked = {}

    def spy(module, name):
        real = getattr(module, name)

        def called(*args, **kwargs):
            bound = inspect.signature(real).bind(*args, **kwargs)
            bound.apply_defaults()
            asked[name] = bound.arguments["runs"]
            raise InterruptedError

        monkeypatch.setattr(module, name, called)

    for module, name in ((solver, "robust_forest"), (solver, "permutation_test"), (propagation, "null_scores")):
        spy(module, name)
    for f in ("_tree_inputs", "_matrix"):
        monkeypatch.setattr(queries, f, lambda *a: (None, None))
    for f in ("seeds", "observed"):
        monkeypatch.setattr(queries.roles, f, lambda *a: None)
    for name in ("robust_frequency", "permutation_test", "null_scores"):
        with pytest.raises(InterruptedError):
            queries.QUERIES[name](None, "")
    assert asked == {"robust_forest": 100, "permutation_test": 200, "null_scores": 300}
