import random
import zlib

import numpy as np
from cohortweave.llm.quality_classifier import QualityConfig, keep_quality, pava, quality_scores
from cohortweave.llm.quality_rules import POLICIES, ablation, apply_policy, measure, quality_rules, rule_ledger
from cohortweave.llm.language_id import language_id


def brute(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    seen, dup = set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    win = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {w for w in win if win.count(w) > 1}
    hit = {i + k for i, w in enumerate(win) if w in many for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_measures_match_brute_force():
    rng = random.Random(1)
    alphabet = ["a", "b", "a", "é", "|", "*", " ", " ", "\n", "\t", "\x0b", "\x1c", "日", "　", "\x00"]
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert measure(s)[:5] == brute(s)
    assert measure(None)[:5] == measure("")[:5] == (0, 0, 0, 0, 0)
    long = "word " * 300_000
    assert measure(long)[0] == measure(long)[4] == 300_000


def test_ledger_policies_and_ablation(spark):
    clean = " ".join(f"w{i}" for i in range(30))
    rows = [(1, clean), (2, None), (3, ""), (4, "x y"), (5, " ".join(["a b c d e"] * 10)), (6, " ".join(f"W{i} |" for i in range(30))), (1, clean)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, kept string")
    got = {r["doc_id"]: r for r in quality_rules(df).collect()}
    assert got[1]["kept"] and not got[1]["base_failed"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (2, 3, 4, 5))
    assert not got[6]["base_failed"] and not got[6]["kept"]
    assert quality_rules(df).count() == 7
    ledger = rule_ledger(df)
    assert apply_policy(ledger, POLICIES["base"]).where("kept").count() == 3
    table = {(r["policy"], r["rule"]): r for r in ablation(ledger).collect()}
    assert table["base", "too_few_words"]["n_failed"] == 3 and table["base", "too_few_words"]["n_only_this"] == 3
    assert table["base", "repeated_windows"]["n_kept_without"] == 4
    assert quality_rules(df.limit(0)).count() == 0


def corpus(n, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(20, 60))]
        docs.append((i, " ".join(words) + "." if good else " | ".join(words).upper(), "x"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_pava():
    assert np.allclose(pava(np.array([3.0, 1.0, 2.0, 5.0]), np.ones(4)), [2, 2, 2, 5])


def test_quality_classifier(spark):
    docs, labels = corpus(600)
    docs += [(1000, None, "x"), (1001, "", "x"), (None, "null id", "x"), (0, docs[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_scores(df, lab, QualityConfig(features=64)).toPandas()
    assert len(out) == len(docs) and out["score"].between(0, 1).all()
    truth = dict((i, q) for i, q, _ in labels)
    held = out[out["held_out"] & out["doc_id"].isin(truth.keys())]
    assert set(held["doc_id"]) == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert (held["predicted"] == held["doc_id"].map(truth)).mean() > 0.97
    # held-out labels do not matter
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    again = quality_scores(df, spark.createDataFrame(flipped, lab.schema), QualityConfig(features=64)).toPandas()
    assert (out.sort_values(["doc_id", "score"])["score"].to_numpy() == again.sort_values(["doc_id", "score"])["score"].to_numpy()).all()
    kept = keep_quality(df, lab, QualityConfig(features=64))
    assert kept.columns == df.columns and abs(kept.count() - int(out["predicted"].sum())) == 0
    assert quality_scores(df.limit(0), lab).count() == 0
    none = quality_scores(df, lab.limit(0)).toPandas()
    assert (none["score"] == 0.5).all()


def test_language_id(spark):
    rng = random.Random(3)
    make = {"xx": "abcde", "yy": "vwxyz", "zz": "mnopq"}
    docs = [(i, " ".join("".join(rng.choice(make[k]) for _ in range(5)) for _ in range(30)), k, "lang") for i, k in enumerate(rng.choice(list(make)) for _ in range(400))]
    docs += [(900, None, "xx", ""), (901, "", "xx", ""), (902, "123 456", None, ""), (903, docs[0][1], None, ""), (None, docs[1][1], "xx", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string")
    out = language_id(df).toPandas()
    assert len(out) == len(docs)
    got = {r.doc_id: r for r in out.itertuples()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == docs[0][2]
    assert set(out["lang_pred"]) <= {"xx", "yy", "zz", "und"} and out["score"].between(0, 1).all()
    truth = {d[0]: d[2] for d in docs[:400]}
    held = out[out["held_out"] & out["doc_id"].isin(truth.keys())]
    assert set(held["doc_id"]) == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held["lang_pred"] == held["doc_id"].map(truth)).mean() > 0.98
    assert language_id(df.limit(0)).count() == 0
