"""Ids above 2**53 beside a null one, extra columns with clashing names, and empty tables, for every operator on documents."""

import pytest

pytest.importorskip("public_tokenizers")
from cohortweave.llm import bpe, jaccard_join, language_id, mixing, pii, quality_classifier, quality_rules, token_files
from cohortweave.llm.tokens import tokenizer_path

IDS = [2**60 + 1, 2**60 + 3, None, -(2**60) - 1, 5]


def _labels(df):
    return df.sparkSession.createDataFrame([(5, 1), (7, 0)], "doc_id long, quality int")


OPERATORS = {
    "op1": lambda df: token_files.token_files(df, tokenizer_path()),
    "op2": lambda df: quality_classifier.quality_scores(df, _labels(df)),
    "op3": jaccard_join.jaccard_components,
    "op4": quality_rules.quality_rules,
    "op5": lambda df: bpe.bpe_round_trip(df, tokenizer_path()),
    "op7": language_id.language_id,
    "op8": mixing.cube_mix,
    "op9": pii.pii_spans,
    "quality stage": lambda df: quality_classifier.keep_quality(df, df.sparkSession.createDataFrame([], "doc_id long, quality int")),
    "PII stage": pii.redact_documents,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_stay(spark, name):
    texts = ["call +1 (632) 555-4827 now", None, "", "the same words here " * 30, "x y z " * 4000]
    rows = [(i, t, "en", None if i == 5 else "s", -7, -1, "k") for i, t in zip(IDS, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, n_words int, component_id string").coalesce(1)
    got = [r["doc_id"] for r in OPERATORS[name](df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, IDS))
    assert OPERATORS[name](df.limit(0)).count() == 0


def test_mixed_documents_keep_every_column(spark):
    rows = [(i, f"w{i} " * (5 + i % 7), f"s{i % 3}", -7, float(i)) for i in range(60)] + [(None, "a b c", None, -7, 0.5)] * 9 + [(3, None, "s0", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target double")
    got = mixing.mixed_documents(df).collect()
    assert {tuple(r) for r in got} <= set(rows) and got
    sizes = {}
    for _, t, s, _, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = mixing.targets(sizes)
    for s in sizes:
        assert abs(sum(len((r["text"] or "").split()) for r in got if r["source"] == s) - goal[s]) <= 6
    assert max(sum(tuple(r) == row for r in got) for row in set(rows) if row[0] is not None) <= 3
    assert sum(r["doc_id"] is None for r in got) <= 27
    assert mixing.mixed_documents(df.limit(0)).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_documents(df.repartition(5)).collect()))


def test_source_targets_match_the_plain_rule(spark):
    rng = __import__("random").Random(3)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 3000]) for i in range(n)} | {None: 4}
        df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, size long, n long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = mixing.targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_one_huge_document_lands_near_the_target():
    import numpy as np

    for seed in range(5):
        rng = np.random.default_rng(seed)
        size = [20_020, *rng.integers(20, 900, 300).tolist()]
        p = mixing.land(mixing.fly_largest([0.31] * len(size), size, rng, mixing.HELD), size)
        goal = 0.31 * sum(size)
        assert set(p) <= {0.0, 1.0} and abs(np.dot(p, size) - goal) <= goal / 1000
