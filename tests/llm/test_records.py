import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohortweave.llm import mixing, pii, warc


def brute_spans(text):
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]


def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    parts = ["1", "22", "255", "256", ".", "..", "@", "a", "b-", ".com", "+", "+1", " ", "(", "-", "4111111111111111", "4111 1111-1111 1111", "é", "\n", "00", "dot"]
    for _ in range(20000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(s) == (brute_spans(s) if re.search(r"[0-9@]", s) else [])


def test_long_runs_are_linear():
    assert pii.base_spans("a" * 300_000 + " @ " + "9" * 300_000) == []


def test_field_learns_its_table_and_adds_spans():
    crf = pii.Crf().train(pii.LABELLED)
    right = total = 0
    for row in pii.LABELLED:
        words, labels = pii.labelled_words(row)
        got = crf.decode([words])[0]
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.97
    texts = ["please call (415) 555-1234 now", "nothing at all here", "version 2.0 of 2021", None, ""]
    added = pii.add_spans(crf, texts, [pii.base_spans(t) for t in texts])
    assert [a and (a[0][0], texts[0][a[0][1] : a[0][2]]) for a in added] == [("phone", "(415) 555-1234"), [], [], [], []]


def test_pii_rows(spark):
    rows = [(1, "mail a.b@c.example.org or 10.0.0.1"), (2, None), (3, ""), (1, "mail a.b@c.example.org or 10.0.0.1"), (4, "é +1 (632) 555-4827 and 4111 1111 1111 1111")]
    df = spark.createDataFrame([(i, t, "z", 5) for i, t in rows], "doc_id long, text string, spans string, n_chars long")
    out = pii.pii_spans(df).collect()
    assert len(out) == 5
    for r, (_, t) in zip(sorted(out, key=lambda r: r["doc_id"]), sorted(rows, key=lambda r: r[0])):
        b = sorted(brute_spans(t or ""), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in b) for k in pii.KINDS]
        assert set(f"{k}:{s}:{e}" for k, s, e in b) <= set(r["spans"].split(",")) | {""}
    red = {r["doc_id"]: r for r in pii.redact_documents(df).collect()}
    assert red[1]["text"] == "mail [email] or [ip]" and red[1]["n_chars"] == len(red[1]["text"])
    assert red[2]["text"] is None and red[2]["n_chars"] == 5 and red[4]["text"] == "é [phone] and [card]"
    assert pii.pii_spans(df.limit(0)).count() == 0


def test_targets():
    t = mixing.targets({"a": 100, "b": 100, None: 10})
    assert t[None] == 30 and t["a"] + t["b"] == pytest.approx(180) and t["b"] == pytest.approx(2 * t["a"])
    assert mixing.targets({"a": 0}) == {"a": 0.0} and mixing.targets({}) == {}
    assert list(mixing.targets({"\U0001f600": 1, "￿": 1}, most=100).values()) == pytest.approx([2 * 1 / 3, 2 * 2 / 3])


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 50, 400).tolist()
    p0 = rng.uniform(0.05, 0.95, 400)
    p = mixing.flight(p0.tolist(), size, rng)
    assert sum(p) == pytest.approx(p0.sum()) and np.dot(p, size) == pytest.approx(np.dot(p0, size))
    assert sum(0 < x < 1 for x in p) <= 2
    share = np.mean([mixing.flight([0.3] * 60, list(range(1, 61)), np.random.default_rng(k)) for k in range(300)], axis=0)
    assert abs(share - 0.3).max() < 0.12


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 80)), rng.choice(["s1", "s1", "s1", "s2", "s3", None])) for i in range(900)]
    rows += [(5000, None, "s1"), (5001, "", "s9"), (None, "a b c", "s2"), rows[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, target string")
    for block in (mixing.BLOCK, 40):
        old, mixing.BLOCK = mixing.BLOCK, block
        try:
            out = mixing.cube_mix(df).toPandas()
            again = mixing.cube_mix(df.repartition(5)).toPandas()
        finally:
            mixing.BLOCK = old
        assert len(out) == len(rows)
        key = ["doc_id", "size", "taken"]
        assert out[key].fillna(-1).sort_values(key).values.tolist() == again[key].fillna(-1).sort_values(key).values.tolist()
        assert (out["taken"] <= 3 * out["size"]).all()
        for _, g in out.fillna({"source": "~"}).groupby("source"):
            assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 3
    assert mixing.cube_mix(df.limit(0)).count() == 0


def pages():
    big = "<html>" + "x" * 200
    return [(3, "http://a/ü b\n", big), (1, None, big), (2, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", big), (1, None, big), (None, "u", big), (8, "u", "é" * 60), (9, "u", "é" * 60), (10, "u", "y" * 5_000_000)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*r, "z") for r in pages()], "page_id long, url string, html string, digest string")
    out = warc.warc_round_trip(df).collect()
    assert len(out) == len(pages())
    first = {}
    for i, _, h in pages():
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in pages():
        raw = (h or "").encode()
        ref = first[h] if h in first and i is not None and i > first[h] else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if ref is None else "revisit", ref))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_every_split_owns_the_records_that_start_in_it():
    rng = random.Random(5)
    bodies = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 3000))) for _ in range(12)]
    raw = b"".join(warc.encode_record(i, f"http://x/{i}", b, hashlib.sha256(b).hexdigest(), None, "2024-01-01T00:00:00Z", level=rng.choice([0, 5])) for i, b in enumerate(bodies))
    # a stored member whose payload holds gzip magic and even a whole gzip stream that is no record
    trap = warc.MAGIC + zlib.compress(b"z") + warc.MAGIC * 5
    raw += warc.encode_record(99, None, trap, hashlib.sha256(trap).hexdigest(), None, "2024-01-01T00:00:00Z", level=0)
    f = pa.BufferReader(raw)
    for step in (1, 7, 100, 5000, len(raw)):
        got = [x["page_id"] for a in range(0, len(raw), step) for _, x in warc.records(warc.Ranges(f, len(raw), 512), a, min(a + step, len(raw)))]
        assert got == [*range(12), 99]


def test_field_reads_long_runs_whole_and_spelled_forms(monkeypatch):
    crf = pii.Crf().train(pii.LABELLED)

    def found(texts):
        added = pii.add_spans(crf, texts, [pii.base_spans(t) for t in texts])
        return [[t[a:b] for _, a, b in spans] for t, spans in zip(texts, added)]

    long = [" ".join(["7"] * n + ["(632)", "555-4827"] + ["7"] * 5) for n in (254, 255, 256, 511)]
    assert found(long) == [["(632) 555-4827"]] * 4
    assert found(["write to bob (at) example.com please", "contact ida AT example DOT org today"]) == [["bob (at) example.com"], ["ida AT example DOT org"]]
    assert found(["look at the list. We met at noon", "AT THE END. DOT"]) == [[], []]
    monkeypatch.setattr(pii, "CELLS", 300, raising=False)
    assert found(long) == [["(632) 555-4827"]] * 4
