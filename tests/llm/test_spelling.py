"""Spelling variants against a plain version that compares all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from cohortweave.llm import spelling

SCHEMA = "doc_id long, text string"


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {a: [b for b in words if near(a, b)] for a in words}
    best = {a: min(around[a], key=lambda x: (-words[x], x), default=None) for a in words}
    form = {a: b if b is not None and words[b] >= 2 * words[a] else None for a, b in best.items()}

    def root(a):
        while form[a]:
            a = form[a]
        return a

    return sorted(((a, form[a], root(a), words[a], len(around[a]), words.get(form[a])) for a in words), key=repr)


@pytest.mark.parametrize("seed, letters, crowd", [(1, "abÀé", 64), (2, "abc", 3), (4, "abcdefgh", 1)])
def test_against_all_pairs(spark, monkeypatch, seed, letters, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "SHORT", 64 if seed % 2 else 5)
    rng = random.Random(seed)
    pool = ["".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(600)]
    text = lambda: " ".join(rng.choices(pool, weights=[1 / (k + 1) for k in range(600)], k=200)).title()
    rows = [(rng.choice([None, i, i]), rng.choice([None, "", *[text() for _ in range(6)]])) for i in range(60)]
    rows += rows[:5]
    got = spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_names_that_clash_long_runs_and_empty_tables(spark):
    long = "x" * 300_000
    rows = [(i, f"{long} {long[:-1]}y hello hellos", "k", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, gram int")
    got = {len(r["word"]): (r["n"], r["n_near"], r["form"]) for r in spelling.spelling_variants(docs).collect()}
    assert got[5] == got[6] == (3, 1, None) and got[300_000] == (3, 1, None)
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (None, "")], SCHEMA)).collect() == []


def test_a_crowded_gram_meets_in_small_groups(spark):
    """2000 words that begin alike: pairs grow with the words, not with their square."""
    rng = random.Random(7)
    words = sorted({"prefixes" + "".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(2000)})
    near = spelling.near_words(spark.createDataFrame([(w, 3) for w in words], "word string, n long"))
    links = {(r["word"], r["other"]) for r in near.collect()}
    by_gap = {}
    for w in words:
        for i in range(len(w)):
            by_gap.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    assert links == {(a, b) for g in by_gap.values() for a in g for b in g if a != b}
