"""Helper columns never meet the columns of the input, and personal data is read whole."""

import time

import pytest

import corpus_pipeline
from cohortweave.llm import pii
from cohortweave.llm.mixing import mixed_documents

HELPERS = ["__row", "__a", "__b", "__copies", "__copy", "__alike", "__of_all", "__salt", "__n", "__at", "__source", "__blocks", "__block", "__level", "__order", "__text", "__hash", "row", "id", "place", "copies", "alike", "of_all", "first", "digest", "component_id", "n_shingles", "size", "n"]


@pytest.fixture(scope="module")
def crf():
    return pii.Crf().train(pii.LABELLED)


@pytest.mark.parametrize("repeated", [False, True])
def test_stages_keep_columns_of_any_name(spark, tmp_path, repeated):
    """All helper names at once as columns of the documents, in every stage that returns documents."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[i : i + 30]) for i in range(0, 30, 6)] + [" ".join(words[:30]), "mail me at ann@example.org now", None, ""]
    rows = [(i if not repeated or i else 1, t, "en", f"s{i % 2}", 5, *[1000 * i + k for k in range(len(HELPERS))]) for i, t in enumerate(texts)]
    if repeated:
        rows += rows[2:4]
    named = ", ".join("`" + h.replace("`", "``") + "` long" for h in HELPERS)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {named}")
    spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    own = {r[5:] for r in rows}
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = [tuple(r)[5:] for r in out.collect()]
        assert set(got) <= own and got


def test_copies_of_one_row_come_from_many_tasks(spark):
    docs = spark.range(6000).selectExpr("7L AS doc_id", "'one two three' AS text", "'s' AS source")
    out = mixed_documents(docs)
    assert out.count() > 0 and out.select("text").distinct().count() == 1


@pytest.mark.parametrize("line, found", [
    ("write to ann at mail dot one dot two dot com now", "ann at mail dot one dot two dot com"),
    ("mail bob dot lee dot von dot der dot berg at corp dot org today", "bob dot lee dot von dot der dot berg at corp dot org"),
    ("mail bob (at) example.com", "bob (at) example.com"),
])
def test_spelled_addresses_are_read_whole(crf, line, found):
    spans = pii.add_spans(crf, [line], [pii.base_spans(line)])[0]
    assert [line[a:b] for _, a, b in spans] == [found]


@pytest.mark.parametrize("text", ["x " + "at-" * 400_000, "x" * 1_000_000 + " at 7"])
def test_long_words_take_linear_time(crf, text):
    began = time.time()
    pii.add_spans(crf, [text], [[]])
    assert time.time() - began < 5


def test_superscripts_are_no_digits():
    assert not pii._plausible("ip", "12.3.4.²")
