import os
import re

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    from cohortweave.llm.jaccard_join import jaccard_components
    from cohortweave.llm.mixing import targets
    from cohortweave.llm.quality_classifier import quality_scores

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert len(stages) == 5
    good = pipeline.cut(stages["quality classifier"](spark, docs, DATA), "t")
    scores = quality_scores(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    once = pipeline.cut(stages["n-gram Jaccard join"](spark, good, DATA), "t")
    found = jaccard_components(good).collect()
    assert sorted(r["doc_id"] for r in once.collect()) == sorted({r["component_id"] for r in found})
    twice = good.unionByName(good.limit(3))
    assert sorted(r["doc_id"] for r in stages["n-gram Jaccard join"](spark, twice, DATA).collect()) == sorted({r["component_id"] for r in found})
    clean = pipeline.cut(stages["PII"](spark, once, DATA), "t")
    assert clean.count() == once.count() and clean.schema == once.schema
    assert clean.where("text rlike '[A-Za-z0-9]@[a-z0-9]+[.]example'").count() == 0
    mixed = pipeline.cut(stages["mixing"](spark, clean, DATA), "t")
    copies, taken, sizes, largest = {}, {}, {}, {}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in clean.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
        largest[r["source"]] = max(largest.get(r["source"], 0), words(r["text"]))
    for r in mixed.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
    assert max(copies.values()) <= 3 and mixed.columns == docs.columns
    assert all(abs(taken.get(k, 0) - goal) <= largest[k] / 2 for k, goal in targets(sizes).items())
    assert stages["BPE"](spark, mixed, DATA).count() == mixed.count() > 0


def test_rows_that_share_a_doc_id_go_by_their_own_text(spark):
    words = [" ".join(f"{k}{i}" for i in range(40)) for k in "abcd"]
    rows = [(1, words[0]), (2, words[0] + " end"), (2, words[1]), (3, words[2]), (3, words[2]), (3, words[3]), (4, ""), (4, ""), (5, None), (None, words[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in dict(pipeline.STAGES)["n-gram Jaccard join"](spark, docs, DATA).collect()]
    want = [(1, words[0]), (2, words[1]), (3, words[2]), (3, words[3]), (4, ""), (5, None), (None, words[0])]
    assert sorted(got, key=str) == sorted(want, key=str)
