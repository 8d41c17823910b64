import itertools
import random
import re

import numpy as np

from cohortweave.llm.embedding_dedup import IndexConfig, embedding_links
from cohortweave.llm.jaccard_join import JoinConfig, jaccard_components
from cohortweave.llm.words import shingle_set


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(ids), 2):
        if linked(a, b):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def documents(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(55)]
    docs = {}
    for i in range(60):
        docs[i] = [word() for _ in range(rng.randint(30, 120))]
        if i % 3 == 0:
            docs[i][5:5] = passage
    n = 60
    for base in (0, 1, 2):
        for _ in range(25):
            w = list(docs[base])
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            docs[n] = w
            n += 1
    text = {i: " ".join(w) for i, w in docs.items()}
    text |= {200: None, 201: "", 202: " \n", 203: "one two", 204: "One TWO", 205: "two one", 206: text[7], 207: text[7].upper(), 208: "É x y z w v", 209: "é x y z w v"}
    return text


def families(seed, families, each, words, edits, common):
    """Edited, cut and lengthened copies of texts that share their first words."""
    rng = random.Random(seed)
    out = []
    for f in range(families):
        base = [f"c{k}" for k in range(common)] + [f"w{f}_{k}" for k in range(words)]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
            w = w[: len(w) - rng.randrange(1, len(w) // 5 + 2)] if rng.random() < 0.3 else w
            out.append(" ".join(w + [f"t{rng.randrange(10**9)}" for _ in range(rng.randrange(1, 12))] if rng.random() < 0.1 else w))
    rng.shuffle(out)
    return dict(enumerate(out))


def test_frequent_shingles_lose_no_link(spark):
    for config, shape in ((JoinConfig(pairs_up_to=1, block=5, sample_of=1, sample_least=1), (60, 3, 30, 1, 25)), (JoinConfig(pairs_up_to=3, block=7, sample_of=2), (3, 50, 60, 3, 10))):
        text = families(5, *shape)
        rows = [*text.items(), (1, text[5]), (2, text[2])]
        s = {}
        for i, t in rows:
            s.setdefault(i, []).append(shingles(t))
        want = components(s, lambda a, b: any(100 * len(x & y) >= 80 * len(x | y) for x in s[a] for y in s[b]))
        got = {r["doc_id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), config).collect()}
        assert got == want


def test_jaccard_matches_brute_force(spark):
    text = documents()
    rows = [(i, t, "x") for i, t in text.items()] + [(7, text[7], "x"), (None, text[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    s = {i: shingles(t) for i, t in text.items()}
    want = components(text, lambda a, b: bool(s[a]) and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]) and bool(s[b]))
    for config in (JoinConfig(), JoinConfig(sample_of=2, sample_least=2, pairs_up_to=4, block=8)):
        out = jaccard_components(df, config).collect()
        assert len(out) == len(rows)
        for r in out:
            if r["doc_id"] is not None:
                assert (r["n_shingles"], r["component_id"]) == (len(s[r["doc_id"]]), want[r["doc_id"]])
            else:
                assert r["component_id"] is None
    assert jaccard_components(df.limit(0)).count() == 0


def test_long_texts_hash_alike():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(6)) for _ in range(250_000)]
    assert len(shingle_set(" ".join(words))) == len(shingles(" ".join(words)))
    assert (shingle_set("a b c d e f") == shingle_set("A  b\tc\nd e f")).all()


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(250, 16))
    near = base[:60] + 0.09 * rng.normal(size=(60, 16)) * np.linalg.norm(base[:60], axis=1, keepdims=True) / 4
    x = np.vstack([base, near, base[:20], base[:5] * 3.0]).astype(np.float32)
    rows = [(i, [float(v) for v in r], int(i % 2) if i < 250 else int((i - 250) % 60 % 2)) for i, r in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [float("inf")] + [1.0] * 15, 1), (904, rows[0][1], None), (905, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, n_links string")
    u = {i: (np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)), k) for i, v, k in rows}
    linked = lambda a, b: u[a][1] == u[b][1] and float(u[a][0] @ u[b][0]) >= 0.93
    want = {i: sum(linked(i, j) for j in u if j != i) for i in u}
    for config in (IndexConfig(recall=1.0, per_cell=4), IndexConfig(recall=1.0, per_cell=4, block=7, queries=9)):
        got = {r["vec_id"]: r for r in embedding_links(df, config).collect()}
        assert len(got) == len(rows) + len(odd)
        found = sum(got[i]["n_links"] for i in u)
        assert all(got[i]["n_links"] <= want[i] for i in u) and found >= 0.97 * sum(want.values())
        for i, *_ in odd:
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
        if found == sum(want.values()):
            comp = components(u, linked)
            assert all(got[i]["component_id"] == comp[i] and got[i]["kept"] == (comp[i] == i) for i in u)
    assert embedding_links(df.limit(0)).count() == 0


def test_production_index_on_the_test_vectors(spark):
    """The registered query's settings over nudged copies of the given vectors: recall against all pairs, and no false link."""
    import os

    import pytest

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    base = spark.read.parquet(path).where("label is not null").orderBy("vec_id").limit(2500).collect()
    rng = np.random.default_rng(11)
    rows = []
    for r in base:
        x = np.array(r["embedding"], np.float64)
        rows.append((len(rows), x, r["label"]))
        for _ in range(int(rng.integers(0, 3))):
            noise = rng.normal(size=len(x))
            rows.append((len(rows), x * rng.uniform(0.5, 2) + np.linalg.norm(x) * rng.uniform(0.05, 0.38) * noise / np.linalg.norm(noise), r["label"]))
    rows += [(len(rows) + k, np.array([1.0, 2.0, 3.0 + k * 1e-3]), rows[0][2]) for k in range(2)]
    df = spark.createDataFrame([(i, [float(v) for v in x], k) for i, x, k in rows], "vec_id long, embedding array<float>, label int")
    want = dict.fromkeys(range(len(rows)), 0)
    for size in {len(x) for _, x, _ in rows}:
        some = [r for r in rows if len(r[1]) == size]
        u = np.array([x for _, x, _ in some], np.float32).astype(np.float64)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        labels = np.array([k for *_, k in some])
        hit = (u @ u.T >= 0.93) & (labels[:, None] == labels[None])
        want |= {r[0]: int(h.sum()) - 1 for r, h in zip(some, hit)}
    got = {r["vec_id"]: r["n_links"] for r in embedding_links(df).collect()}
    assert got.keys() == want.keys() and all(got[i] <= want[i] for i in want)
    assert sum(want.values()) > 1000 and sum(got.values()) >= 0.95 * sum(want.values()), (sum(got.values()), sum(want.values()))


def repeated_ids(spark):
    words = [" ".join(f"{k}{i}" for i in range(40)) for k in "abc"]
    rows = [(1, words[0]), (2, words[0] + " end"), (2, words[1]), (2, None), (3, words[2]), (3, words[2]), (4, ""), (4, ""), (5, None), (1, words[1] + " end"), (1, "")]
    return words, spark.createDataFrame(rows, "doc_id long, text string")


def test_empty_texts_of_a_linked_doc_id(spark):
    """doc_ids 1 and 2 have linked texts and empty ones."""
    from cohortweave.llm.jaccard_join import jaccard_components

    _, docs = repeated_ids(spark)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()]
    assert len(got) == 11 and {(i, c) for i, _, c in got} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}


def test_one_label_holds_nearly_all_vectors(spark):
    """Many labels of one vector beside a large one: its cells are as fine as its own size asks for, and links are found."""
    from cohortweave.llm.embedding_dedup import _units, fit_books, label_tiers
    from pyspark.sql import functions as F

    rng = np.random.default_rng(21)
    base = rng.normal(size=(2200, 24))
    near = base[:900] + 0.2 * rng.normal(size=(900, 24))
    x = np.vstack([base, near]).astype(np.float32)
    rows = [(i, [float(c) for c in v], "all") for i, v in enumerate(x)] + [(10_000 + i, [float(c) for c in x[i]], f"own{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    config = IndexConfig(per_cell=10)
    units = df.select("vec_id", "label", "embedding").mapInArrow(_units(False), "vec_id long, label string, dim int, x binary, key binary")
    tiers = label_tiers(units, config)
    assert [(r["label"], r["tier"]) for r in tiers.collect()] == [("all", 3)]
    books = fit_books(units.join(tiers, ["label", "dim"], "left").withColumn("tier", F.coalesce("tier", F.lit(0))), config)
    assert {book: len(index.left) for book, index in books.items()} == {(24, 0): 4, (24, 3): round((3100 / 10) ** 0.5)}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_links(df, config).collect()}
    assert len(got) == len(rows) and all(got[i] == 0 for i in got if i >= 10_000)
    assert all(got[i] <= want[i] for i in range(len(x)))
    found = sum(got[i] for i in range(len(x)))
    assert want.sum() > 1000 and found >= 0.95 * want.sum(), (found, want.sum())


def test_kmeans_in_blocks_is_plain_kmeans(monkeypatch):
    from cohortweave.llm import embedding_dedup

    x = np.random.default_rng(3).normal(size=(500, 6))
    whole = embedding_dedup.kmeans(x, 9, np.random.default_rng(1))
    monkeypatch.setattr(embedding_dedup, "CELLS", 50)
    assert np.allclose(embedding_dedup.kmeans(x, 9, np.random.default_rng(1)), whole)
    own = ((x[:, None] - whole[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert len(set(own.tolist())) == 9
