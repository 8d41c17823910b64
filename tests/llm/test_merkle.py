"""Merkle manifests against trees built level by level."""

import hashlib
import random
import zlib

import pytest

from cohortweave.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, keys string, group_ int, place string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grown(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def steps(tree, i):
    for level in tree[:-1]:
        yield i & 1, level[i ^ 1] if i ^ 1 < len(level) else None
        i >>= 1


def plain(rows):
    groups, out = {}, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))):
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: grown([leaf_of(r) for r in v]) for k, v in groups.items()}
    top = grown([trees[k][-1][0] for k in langs])
    for at, k in enumerate(langs):
        for i, r in enumerate(groups[k]):
            path = [*steps(trees[k], i), *steps(top, at)]
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            x = leaf_of((*r[:3], r[3] + 1, r[4]) if changed else r)
            for side, s in path:
                x = digest(x) if s is None else digest(s + x) if side else digest(x + s)
            out.append((r[0], leaf_of(r), trees[k][-1][0], top[-1][0], digest("".join(s for _, s in path if s)), x, x == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n, height", [(1, 10), (5, 10), (300, 10), (300, 2), (77, 1)])
def test_against_trees_by_level(spark, monkeypatch, n, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rng = random.Random(n + height)
    rows = [(rng.choice([None, i, i, i, i // 2]), rng.choice([None, "a", "ü"]), rng.choice(["de", "de", "de", "en", None, "z"]), rng.choice([None, 3, 44]), rng.choice([None, "", "hé " * rng.randint(0, 9)])) for i in range(n)]
    rows += rows[: n // 10]
    docs = spark.createDataFrame([(*r, "k", 1, "p") for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, merkle.checked_manifest(docs).collect()), key=str) == plain(rows)


def test_an_empty_table(spark):
    assert merkle.checked_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_positions_are_those_of_a_postorder_log():
    """Nodes come after all below them, alone ones right after their child, and every position is taken once."""
    for n in [*range(1, 70), 127, 128, 129]:
        for top in {merkle.levels(n), merkle.levels(n) + 2}:
            leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
            log, at = merkle.append_log(leaves, top), {}
            level = leaves
            for h in range(top + 1):
                for i, node in enumerate(level):
                    p = merkle.node_position(h, i, n)
                    assert bytes(log[32 * p : 32 * p + 32]) == node
                    at[p] = (h, i)
                    if h:
                        assert all(merkle.node_position(h - 1, c, n) < p for c in (2 * i, 2 * i + 1) if c < (n + (1 << h - 1) - 1) >> h - 1)
                level = [merkle.parent(*level[i : i + 2]) for i in range(0, len(level), 2)]
            assert sorted(at) == list(range(len(log) // 32))
            for i in range(n):
                assert merkle.fold(leaves[i], merkle.sibling_steps(bytes(log), i, n, top)) == bytes(log[-32:])


def test_a_lang_may_hold_nearly_all_rows_and_proofs_hold_for_others(spark):
    docs = spark.createDataFrame([(i, "s", "de" if i % 50 else "fr", i, f"text {i}", "", 0, "") for i in range(3000)], SCHEMA).repartition(4)
    found = merkle.proofs(merkle.build_manifest(docs), with_siblings=True)
    rows = found.collect()
    assert len(rows) == 3000 and all(r["verified"] for r in rows) and len({r["root"] for r in rows}) == 1
    assert all(digest("".join(r["siblings"])) == r["proof_sha256"] for r in rows)
