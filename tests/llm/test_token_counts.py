"""Token counts against the libraries on whole texts."""

import random
import unicodedata

import numpy as np
import pytest

from cohortweave.llm import token_counts as tc
from cohortweave.llm.tokens import tokenizer_path

PARTS = ["a", "b", "s", "t", "re", "ll", "'", "'s", "'ve", " ", "  ", "\n", "\t", " ", "1", "é", "!", "-", "漢", "😀", "\x85", " ", "\x1c", "̀", "²", "'m", "D", "<|endoftext|>", "\U000e0100", "͸"]


def counter(pieces=()):
    tok = tc._library(tokenizer_path())
    ends = np.cumsum([len(p) for p in pieces]).astype(np.int64)
    points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
    hashes = tc.pre_token_hashes(points, np.append(0, ends[:-1])[: len(ends)].astype(np.int64), ends) if len(pieces) else np.zeros(0, np.uint64)
    lengths = np.array([len(tok.encode(p, add_special_tokens=False)) for p in pieces], np.int64)
    return tc.TwoTierCounter(tok, tc.LengthTable(hashes, lengths), tc.code_point_classes()), tok


def test_mixed_code_points():
    rng = random.Random(5)
    count, tok = counter([" a", "ll", "'s", "  ", "é", "!"])
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(20_000)]
    assert count(texts) == [len(tok.encode(t, add_special_tokens=False)) for t in texts]


def test_every_code_point_has_the_library_class():
    """Between letters, digits and marks each code point joins what the library joins."""
    tok, classes = tc._library(tokenizer_path()), tc.code_point_classes()
    some = [c for c in [*range(0x3000), *range(0xA000, 0xD800), *range(0xE000, 0x11000), *range(0x1F000, 0x1FB00)] if unicodedata.category(chr(c)) != "Cn"]
    for edge in "a1!":
        text = "\n".join(edge + chr(c) + edge for c in some)
        starts = [a for _, (a, _) in tok.pre_tokenizer.pre_tokenize_str(text)]
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        assert tc.pre_token_starts(points, classes[points]).tolist() == starts


def test_windows(monkeypatch):
    monkeypatch.setattr(tc, "WINDOW", 40)
    rng = random.Random(6)
    count, tok = counter()
    for _ in range(400):
        text = "".join(rng.choices(PARTS[:27], k=rng.randint(30, 300)))
        assert count([text]) == [len(tok.encode(text, add_special_tokens=False))], text


def test_the_table_holds_what_it_was_given():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 1 << 63, 5000).astype(np.uint64))
    table = tc.LengthTable(keys[::2], np.arange(1, len(keys[::2]) + 1))
    assert table(keys[::2]).tolist() == list(range(1, len(keys[::2]) + 1)) and not table(keys[1::2]).any()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_whole_table(spark, name):
    path = tokenizer_path(name)
    texts = [None, "", "hello hello world", "a" * 5000, "x y " * 300_000, "hi<|endoftext|>there", "über 12 'll", "hello hello world"] + [f"word{i} the the" for i in range(40)]
    docs = spark.createDataFrame([(None if i % 9 == 4 else i, t, 7, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, piece string").repartition(3)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lambda t: len(model.encode(t))
    else:
        tok = tc._library(path)
        n = lambda t: len(tok.encode(t, add_special_tokens=False))
    want = sorted((None if i % 9 == 4 else i, len((t or "").encode()), n(t or ""), n(t or "") > 512) for i, t in enumerate(texts) if i % 9 != 4)
    got = tc.token_counts(docs, path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(texts) and sorted(r for r in rows if r[0] is not None) == want
    assert tc.token_counts(docs.limit(0), path).collect() == []


def test_the_sample_only_saves_time(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 5} gamma") for i in range(500)], "doc_id long, text string")
    full, some = (tc.frequent_lengths(docs, tokenizer_path(), sample=n) for n in (4096, 20))
    assert (full.lengths > 0).sum() >= 7
    assert (some.lengths > 0).sum() <= (full.lengths > 0).sum()
