import hashlib
import random
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from cohortweave.llm.bpe import ForcedBoundaryBpe, bpe_round_trip  # noqa: E402
from cohortweave.llm.token_files import EliasFano, ef_encode, token_files  # noqa: E402
from cohortweave.llm.tokens import LibraryEncoder  # noqa: E402

PATH = public.path("byte_bpe_50k.json")
PARTS = ["a", "Th", " ", "  ", "\n", "\t", " \n", "\x1c", "\x85", "\xa0", "é", "ß", "日本", "😀", "'s", "'ll", "123", "!!!", "<|endoftext|>", "<|endof", "　", "İ", "½", "a" * 70, "the", "\r\n"]


def texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_encoders_match_the_library():
    lib, own = LibraryEncoder(PATH), ForcedBoundaryBpe(PATH)
    for s, a, b in zip(ts := texts(1500), lib.encode(ts), own.encode(ts)):
        want = lib.tok.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(a, lib.dtype).tolist() == want
        assert np.frombuffer(b, own.dtype).tolist() == want
        assert own.decode(want) == lib.tok.decode(want, skip_special_tokens=False)


def test_no_token_holds_a_forced_pair():
    own = ForcedBoundaryBpe(PATH)
    for raw in own.bytes:
        a = np.frombuffer(raw, np.uint8).astype(int)
        if raw != b"<|endoftext|>":
            assert not own.forced[a[:-1] << 8 | a[1:]].any()


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (5, 3), (1000, 10), (3000, 1 << 40), (700, 1 << 63)):
        x = np.sort(rng.integers(0, top + 1, n, dtype=np.uint64)) if top else np.zeros(n, np.uint64)
        head, raw = ef_encode(x, int(x[-1]))
        ef = EliasFano(head, lambda at, k: raw[at : at + k])
        assert (ef.select(0, n) == x).all()
        for i in range(0, n, 97):
            assert ef.select(i, min(n, i + 300)).tolist() == x[i : i + 300].tolist()
        assert len(raw) * 8 < n * (2 + max(1, (max(top, 1) // n).bit_length())) + 64 + n / 4


ROWS = [(3, "the end", "x"), (1, None, "x"), (2, "", None), (7, "é " * 3000, "y"), (3, "the end", "x"), (5, "a <|endoftext|> b", "z"), (None, "null id", "z")]


def test_token_files(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, start string")
    tok = tokenizers.Tokenizer.from_file(PATH)
    got = sorted(token_files(df, PATH, 2).select("doc_id", "start", "n_tokens", "ids_crc32").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 5, 7]
    at = 0
    by = {i: t for i, t, _ in ROWS}
    for r in got:
        ids = [*tok.encode(by[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files(df.limit(0), PATH).count() == 0


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    tok = tokenizers.Tokenizer.from_file(PATH)
    rows = bpe_round_trip(df, PATH, keep_ids=True).collect()
    assert len(rows) == len(ROWS)
    by = {i: t or "" for i, t, _ in ROWS}
    for r in rows:
        ids = tok.encode(by[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(by[r["doc_id"]].encode()).hexdigest()
    assert bpe_round_trip(df.limit(0), PATH).count() == 0


def test_repetitive_texts_are_linear():
    own, lib = ForcedBoundaryBpe(PATH), tokenizers.Tokenizer.from_file(PATH)
    assert own.ordered
    for text in ("-" * 5001, "0" * 40_000, "ACGT" * 9999 + "A", "e" * 1_000_000, " a", " ", "é" * 777):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == want
    own.ordered = False
    assert np.frombuffer(own.encode(["-" * 501])[0], own.dtype).tolist() == lib.encode("-" * 501, add_special_tokens=False).ids


def test_real_texts_match_the_library_row_by_row():
    import glob

    import pyarrow.parquet as pq

    files = glob.glob("/root/testdata/sf0.01/documents.parquet") or pytest.skip("no test tables")
    own, lib = ForcedBoundaryBpe(PATH), LibraryEncoder(PATH)
    texts = [t or "" for t in pq.read_table(files[0], columns=["text"])["text"].to_pylist()]
    for text, a, b in zip(texts, own.encode(texts), lib.encode(texts)):
        ids = lib.tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(a, own.dtype).tolist() == ids == np.frombuffer(b, lib.dtype).tolist()
        assert own.decode(ids) == lib.tok.decode(ids, skip_special_tokens=False)
