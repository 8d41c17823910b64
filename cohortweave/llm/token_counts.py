"""Token counts of whole texts by a two-tier lookup in map tasks; no pre-token is ever shuffled.

A byte-level vocabulary is applied to pre-tokens, so a text has as many tokens as its pre-tokens have together. The first tier is
a compact hash table, broadcast, of how many tokens each frequent pre-token has; texts are cut into pre-tokens, hashed and looked up
as whole arrays. What it misses is encoded by the library once for each worker, whose bounded cache is the second tier. The table only
saves time: counts are the library's whatever it holds.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cohortweave.llm.rows import map_texts
from cohortweave.llm.words import mix

#: Documents, about, whose frequent pre-tokens fill the table, and the bytes that one of them may have; the table's entries at most.
SAMPLE, SAMPLE_BYTES, ENTRIES = 4096, 1 << 16, 1 << 16
#: Tasks that count the sample; each hands at most ENTRIES // 2 pre-tokens to the driver.
SAMPLERS = 8
#: Code points that are cut and hashed at once, and hashes in each of the two generations of a worker's cache.
WINDOW, ROOM = 1 << 19, 400_000

LETTER, NUMBER, OTHER, SPACE, END, UNSURE = range(6)
#: Stands between texts in an array of code points; no text holds it.
_END = 0x110000
#: What may follow an apostrophe that opens a pre-token (fixed values of the vocabulary's pattern).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_K = np.uint64(0x9E3779B97F4A7C15)
_KINV = np.uint64(pow(int(_K), -1, 1 << 64))


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """The class of each code point in the pre-tokenizer's pattern.

    Code points that this Python's Unicode tables leave unassigned are UNSURE: the library may know newer ones, and
    texts that hold one go to it whole.
    """
    out = np.full(_END + 1, OTHER, np.uint8)
    by_category = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    for c in range(_END):
        category = unicodedata.category(chr(c))
        out[c] = UNSURE if category == "Cn" else by_category.get(category[0], OTHER)
    out[[*range(0x09, 0x0E), 0x85]] = SPACE
    out[_END] = END
    return out


def pre_token_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of an array of code points start; texts in it end with _END, which starts one of its own."""
    n = len(points)
    before = np.concatenate([[END], kinds[:-1]]).astype(np.uint8)
    after = np.concatenate([kinds[1:], [END]]).astype(np.uint8)
    start = kinds != before
    # the last of several white spaces leaves them if something follows, and a blank goes with it
    space = kinds == SPACE
    start |= space & (before == SPACE) & (after != SPACE) & (after != END)
    blank = np.concatenate([[False], points[:-1] == 0x20])
    start &= ~(blank & (kinds < SPACE))
    start |= kinds == END
    marks = np.flatnonzero((points == 0x27) & start)
    if len(marks):
        padded = np.concatenate([points[:n], np.full(3, _END, points.dtype)])
        for letters in CONTRACTIONS:
            hit = marks
            for i, letter in enumerate(letters, 1):
                hit = hit[padded[hit + i] == ord(letter)]
            start[hit + 1] = False
            ends = hit + 1 + len(letters)
            start[ends[ends < n]] = True
    return np.flatnonzero(start)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    powers, inverse = np.full(n, _K, np.uint64), np.full(n, _KINV, np.uint64)
    powers[0] = inverse[0] = 1
    return np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


@lru_cache(maxsize=1)
def _spread_table() -> np.ndarray:
    return mix(np.arange(1, 0x10001, dtype=np.uint64))


def _spread(points: np.ndarray) -> np.ndarray:
    """A number of 64 mixed bits for each code point."""
    low = _spread_table()[points & np.uint32(0xFFFF)]
    high = points >> np.uint32(16)
    return low + high.astype(np.uint64) * _KINV if high.any() else low


def pre_token_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pre-token, never 0. Two of 2**32 pre-tokens that are looked up and in the table meet with odds of 2**-16."""
    powers, inverse = _powers(1 << max(WINDOW.bit_length(), len(points).bit_length()))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_spread(points) * powers[: len(points)], out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _K)
    return np.where(h == 0, np.uint64(1), h)


class LengthTable:
    """How many tokens a pre-token has, by its hash, in an open-addressing table at most half full; 0 for one it does not hold."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray):
        self.mask = (1 << max(4, int(2 * len(hashes)).bit_length())) - 1
        self.keys, self.lengths, self.reach = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.uint16), 1
        for h, n in zip(hashes.tolist(), lengths.tolist()):
            slot, tries = h & self.mask, 1
            while self.keys[slot] not in (0, h):
                slot, tries = (slot + 1) & self.mask, tries + 1
            self.keys[slot], self.lengths[slot], self.reach = h, n, max(self.reach, tries)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        slots = (hashes & np.uint64(self.mask)).astype(np.int64)
        out = np.where(self.keys[slots] == hashes, self.lengths[slots], 0).astype(np.int64)
        todo = np.flatnonzero((out == 0) & (self.keys[slots] != 0))
        for _ in range(1, self.reach):
            if not len(todo):
                break
            slots[todo] = (slots[todo] + 1) & self.mask
            key = self.keys[slots[todo]]
            out[todo] = np.where(key == hashes[todo], self.lengths[slots[todo]], 0)
            todo = todo[(out[todo] == 0) & (key != 0)]
        return out


class TwoTierCounter:
    """Counts tokens of texts with a length table and, for what it misses, the library and a cache."""

    def __init__(self, tokenizer, table: LengthTable, classes: np.ndarray):
        self.tok, self.table, self.classes = tokenizer, table, classes
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[int, int] = {}
        self.old: dict[int, int] = {}

    def _missed(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> np.ndarray:
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        found, new = [], []
        for i, h in enumerate(keys.tolist()):
            n = self.young.get(h)
            if n is None and (n := self.old.get(h)) is not None:
                self.young[h] = n
            if n is None:
                new.append(i)
            found.append(n)
        for k in range(0, len(new), 10_000):
            some = new[k : k + 10_000]
            pieces = [text[starts[first[i]] : ends[first[i]]] for i in some]
            for i, x in zip(some, self.tok.encode_batch_fast(pieces, add_special_tokens=False)):
                found[i] = self.young[int(keys[i])] = len(x)
        if len(self.young) > ROOM:
            self.old, self.young = self.young, {}
        return np.array(found, np.int64)[back]

    def _tokens(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> np.ndarray:
        hashes = pre_token_hashes(points, starts, ends)
        out = self.table(hashes)
        missed = np.flatnonzero(out == 0)
        if len(missed):
            out[missed] = self._missed(hashes[missed], starts[missed], ends[missed], text)
        return out

    def _whole(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False))

    def _long(self, text: str) -> int:
        """Window by window; a start is certain where the three code points behind it are there too."""
        at, total, size = 0, 0, WINDOW
        while at < len(text):
            part = text[at : at + size]
            points = np.frombuffer(part.encode("utf-32-le"), np.uint32)
            kinds = self.classes[points]
            if (kinds == UNSURE).any():
                return self._whole(text)
            starts, done = pre_token_starts(points, kinds), at + size >= len(text)
            if not done:
                starts = starts[starts < len(points) - 3]
                if len(starts) < 2:
                    size *= 2
                    continue
            ends = np.append(starts[1:], len(points)) if done else starts[1:]
            total += int(self._tokens(points, starts[: len(ends)], ends, part).sum())
            at, size = (len(text) if done else at + int(starts[-1])), WINDOW
        return total

    def _some(self, texts: list[str]) -> list[int]:
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        points[stops] = _END
        kinds = self.classes[points]
        starts = pre_token_starts(points, kinds)
        ends = np.append(starts[1:], len(points))
        real = kinds[starts] != END
        n = np.zeros(len(starts), np.int64)
        n[real] = self._tokens(points, starts[real], ends[real], joined)
        total = np.concatenate([[0], np.cumsum(n)])
        upto = total[np.searchsorted(starts, stops)]
        out = np.diff(upto, prepend=0).tolist()
        for i in set(np.searchsorted(stops, np.flatnonzero(kinds == UNSURE)).tolist()):
            out[i] = self._whole(texts[i])
        return out

    def __call__(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        some: list[int] = []
        size = 0

        def flush():
            for i, n in zip(some, self._some([texts[i] for i in some]) if some else []):
                out[i] = n
            some.clear()

        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = self._whole(text)
            elif len(text) > WINDOW:
                out[i] = self._long(text)
            elif text:
                if size + len(text) > WINDOW:
                    flush()
                    size = 0
                some.append(i)
                size += len(text)
        flush()
        return out


@lru_cache(maxsize=1)
def _library(path: str):
    """The library's tokenizer without truncation and padding, once for a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _two_tiers(tok) -> bool:
    """If the tokenizer's texts can be cut into pre-tokens by the pattern of byte-level vocabularies, and nothing else is done to them."""
    import json

    spec = json.loads(tok.to_str())
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens") or [])
    return plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not spec.get("normalizer")


def _sampled_counts(batches) -> Iterator:
    """The most frequent pre-tokens of a task's sampled texts."""
    import pyarrow as pa

    classes, counts = code_point_classes(), Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
            if len(points):
                starts = pre_token_starts(points, classes[points]).tolist()
                counts.update([text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])])
    top = counts.most_common(ENTRIES // 2)
    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])


def frequent_lengths(docs: DataFrame, tokenizer: str, text: str = "text", sample: int = SAMPLE) -> LengthTable:
    """The lengths of the pre-tokens that a sample of about `sample` documents of at most SAMPLE_BYTES bytes holds most often.

    At most ENTRIES of them, counted by SAMPLERS tasks that give at most half as many each, so that the driver and the broadcast hold
    a bounded table at any size of the corpus.
    """
    n = docs.count()
    some = docs.where(F.octet_length(text) <= SAMPLE_BYTES).select(text)
    some = some if n <= sample else some.sample(False, sample / n, 1)
    counts: Counter = Counter()
    for row in some.repartition(SAMPLERS).mapInArrow(_sampled_counts, "piece string, n long").collect():
        counts[row["piece"]] += row["n"]
    pieces = [p for p, k in counts.most_common(ENTRIES) if k > 1]
    if not pieces:
        return LengthTable(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    lengths = np.array([len(x) for x in _library(tokenizer).encode_batch_fast(pieces, add_special_tokens=False)])
    points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(p) for p in pieces])
    hashes = pre_token_hashes(points, np.append(0, ends[:-1]), ends)
    short = lengths < 1 << 16
    return LengthTable(hashes[short], lengths[short])


_counters: dict = {}


def _counter(tokenizer: str, held) -> TwoTierCounter:
    """This worker's counter for a broadcast table; its cache serves the worker's later tasks too."""
    key = (tokenizer, held.id if hasattr(held, "id") else id(held))
    if key not in _counters:
        _counters.clear()
        _counters[key] = TwoTierCounter(_library(tokenizer), *held.value)
    return _counters[key]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, n_bytes (UTF-8), n_tokens and over_limit (more tokens than limit) of every whole text, row by row.

    Tokens are those that the library of the file gives without begin, end or added special tokens, truncation or padding: tokenizers
    for .json, sentencepiece for .model. Special strings inside texts are what the library makes of them. Byte-level .json files go
    by the two tiers; other kinds, and texts with special strings or unassigned code points, go to the library whole.

    A null text counts as an empty one: 0 bytes, 0 tokens, not over the limit. Nulls in kept columns stay; repeated rows give
    repeated results, an empty table an empty one; texts of any length are counted whole, window by window. Other
    columns are ignored; the kept ones must not have the names of the added ones.
    """
    rows = docs.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text)
    make = _counting(docs, tokenizer, text)
    out = map_texts(rows, make, "n_tokens long", (*keep, "n_bytes"), text)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _counting(docs: DataFrame, tokenizer: str, text: str) -> Callable[[], Callable[[list], tuple]]:
    if tokenizer.endswith(".model"):

        def pieces():
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            return lambda texts: ([len(ids) for ids in model.encode([t or "" for t in texts], num_threads=1)],)

        return pieces
    if not re.search(r"\.json$", tokenizer):
        raise ValueError(f"a .json or .model file is needed, not {tokenizer}")
    if not _two_tiers(_library(tokenizer)):
        return lambda: lambda texts: ([len(x) for x in _library(tokenizer).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)],)
    held = docs.sparkSession.sparkContext.broadcast((frequent_lengths(docs, tokenizer, text), code_point_classes()))

    def counter():
        count = _counter(tokenizer, held)
        return lambda texts: (count([t or "" for t in texts]),)

    return counter
