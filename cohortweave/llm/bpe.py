"""Byte-level BPE by forced-boundary splitting.

A byte pair that lies inside no token of the vocabulary can never be bridged by a
merge, so the text may be cut between its two bytes and the fragments encoded
independently. Cuts come at two levels. Between a text's non-space byte and a
space that a non-space follows (no token holds such a pair, and the pre-tokenizer's pattern
starts a piece at that space too) the text falls into pieces. Inside each pre-token of a
piece, the remaining never-bridged pairs cut fragments. Pieces and fragments are
memoised within bounds; ids of the parts are concatenated.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from cohortweave.llm.rows import map_texts
from cohortweave.llm.tokens import HEAD, PieceMemo, byte_alphabet

FRAGMENTS = 100_000
NEVER = np.int32(2**31 - 1)
#: The pre-tokenizer's pattern that byte-level vocabularies of this family are built with (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PairRanks:
    """Merge ranks of id pairs in an open-addressing table, looked up for whole arrays."""

    def __init__(self, pairs: list[tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        self.bits = max(10, int(4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1), np.uint64)
        self.ranks = np.full(1 << self.bits, NEVER, np.int32)
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.ranks[slots[todo]] == NEVER
            _, first = np.unique(np.where(free, slots[todo], (1 << 60) + todo), return_index=True)
            placed = first[free[first]]
            self.keys[slots[todo[placed]]], self.ranks[slots[todo[placed]]] = keys[todo[placed]], todo[placed]
            todo = np.delete(todo, placed)
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NEVER)
        todo = np.flatnonzero((out == NEVER) & (self.ranks[slot] != NEVER))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            at = slot[todo]
            out[todo] = np.where(self.keys[at] == keys[todo], self.ranks[at], NEVER)
            todo = todo[(out[todo] == NEVER) & (self.ranks[at] != NEVER)]
        return out


class ForcedBoundaryBpe(PieceMemo):
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    room = 120_000

    def __init__(self, path: str):
        import regex

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without prefix space or normalizer is needed")
        alphabet = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special_id, self.special = specials, list(specials)
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *specials.values()]))
        self.dtype = np.dtype("<u2") if len(self.bytes) <= 1 << 16 else np.dtype("<u4")
        inside = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            raw = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
            self.bytes[i] = raw
            if token not in specials:
                a = np.frombuffer(raw, np.uint8)
                inside[a[:-1], a[1:]] = True
        for token, i in specials.items():
            self.bytes[i] = token.encode()
        #: forced[a << 8 | b]: no token holds byte a before byte b
        self.forced = ~inside.ravel()
        self.decimal = [str(i).encode() for i in range(len(self.bytes))]
        self.byte_id = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = PairRanks([(vocab[a], vocab[b]) for a, b in merges])
        self.new_id = np.array([vocab[a + b] for a, b in merges], np.int64)
        #: no merge takes part in one of a lower rank, so that all equal pairs of a fragment may merge at once
        first = np.full(len(self.bytes), NEVER, np.int64)
        np.minimum.at(first, np.array([[vocab[a], vocab[b]] for a, b in merges], np.int64).reshape(-1), np.repeat(np.arange(len(merges)), 2))
        self.ordered = bool((first[self.new_id] > np.arange(len(merges))).all())
        self.pre = regex.compile(PATTERN)
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.fragments: dict[bytes, bytes] = {}

    def cut(self, tokens: list[str]) -> tuple[list[bytes], list[int]]:
        """All fragments of the pre-tokens, in order, and how many each has."""
        raws = [t.encode() for t in tokens]
        ends = np.cumsum([len(r) for r in raws])
        buf = b"".join(raws)
        a = np.frombuffer(buf, np.uint8).astype(np.int64)
        cut = np.zeros(len(a), bool)
        cut[1:] = self.forced[a[:-1] << 8 | a[1:]]
        cut[ends[:-1]] = True
        starts = np.append(0, np.flatnonzero(cut))
        counts = np.diff(np.append(0, np.searchsorted(starts, ends))).tolist()
        starts = [*starts.tolist(), len(buf)]
        return [buf[i:j] for i, j in zip(starts, starts[1:])], counts

    def merged(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of each fragment: all together, again and again, each merges its pairs of the lowest rank, leftmost first.

        In a run of equal tokens pairs overlap, and every second one merges. A round so takes a whole rank off a fragment.
        """
        lens = np.array([len(f) for f in fragments])
        ids = self.byte_id[np.frombuffer(b"".join(fragments), np.uint8)]
        owner = np.repeat(np.arange(len(fragments)), lens)
        done: list[bytes] = [b""] * len(fragments)
        ranks = np.full(len(ids), NEVER, np.int32)
        pair = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[pair] = self.rank(ids[pair], ids[pair + 1])
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            counts = np.diff(np.append(starts, len(ids)))
            low = np.minimum.reduceat(ranks, starts)
            ended = low == NEVER
            if ended.any() and (ended.mean() > 0.25 or ended.all()):
                raw, w = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
                for f, s, c in zip(owner[starts[ended]].tolist(), starts[ended].tolist(), counts[ended].tolist()):
                    done[f] = raw[w * s : w * (s + c)]
                rest = ~np.repeat(ended, counts)
                ids, owner, ranks = ids[rest], owner[rest], ranks[rest]
                continue
            at = np.flatnonzero((ranks == np.repeat(low, counts)) & (ranks != NEVER))
            if self.ordered:
                run = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            else:
                at = at[np.append(True, owner[at][1:] != owner[at][:-1])]
            ids[at] = self.new_id[ranks[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, owner, ranks = ids[stay], owner[stay], ranks[stay]
            at -= np.arange(len(at))
            changed = np.zeros(len(ids) + 1, bool)
            changed[at] = changed[at - 1] = True
            fresh = np.flatnonzero(changed[:-1])
            ranks[fresh] = NEVER
            fresh = fresh[fresh + 1 < len(ids)]
            fresh = fresh[owner[fresh] == owner[fresh + 1]]
            ranks[fresh] = self.rank(ids[fresh], ids[fresh + 1])
        return done

    def _pretokens(self, tokens: list[str]) -> list[bytes]:
        """Ids of each pre-token, from those of its fragments."""
        if not tokens:
            return []
        parts, counts = self.cut(tokens)
        if len(self.fragments) > FRAGMENTS:
            self.fragments.clear()
        memo = self.fragments
        new = [f for f in dict.fromkeys(parts) if f not in memo]
        if new:
            memo.update(zip(new, self.merged(new)))
        values = [memo[f] for f in parts]
        if len(values) == len(tokens):
            return values
        out, at = [], 0
        for n in counts:
            out.append(values[at] if n == 1 else b"".join(values[at : at + n]))
            at += n
        return out

    def _plain(self, text: str) -> bytes:
        out = []
        tokens = self.pre.findall(text)
        for at in range(0, len(tokens), 50_000):
            out += self._pretokens(tokens[at : at + 50_000])
        return b"".join(out)

    def learn(self, pieces: list[str]) -> list[bytes]:
        tokens: list[str] = []
        ends = []
        for p in pieces:
            tokens += self.pre.findall(p[1:] if p[0] == HEAD else " " + p)
            ends.append(len(tokens))
        values, out, at = self._pretokens(tokens), [], 0
        for e in ends:
            out.append(values[at] if e == at + 1 else b"".join(values[at:e]))
            at = e
        return out

    def whole(self, text: str) -> bytes:
        """Ids of a whole text; special tokens in it become their ids."""
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special_id[m.group()]], self.dtype).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def forced_boundary_bpe(path: str) -> ForcedBoundaryBpe:
    """The encoder of this worker process; its memo serves the worker's later tasks too."""
    return ForcedBoundaryBpe(path)


def bpe_round_trip(docs: DataFrame, tokenizer: str, keep_ids: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode every whole text, row by row and without a shuffle.

    Adds n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the
    decoded text) and, with keep_ids, ids and decoded. A null or empty text has no ids; both digests
    are then those of the empty string. The columns in keep, null ids among them, pass through untouched. Rows are never
    merged: repeated rows give repeated results, an empty table an empty one. A text may have any length. Columns other
    than text and those in keep are ignored; those in keep must not have the names of the added ones.
    """

    def encoder():
        bpe = forced_boundary_bpe(tokenizer)
        decimal = bpe.decimal.__getitem__

        def run(texts: list[str | None]) -> tuple:
            n, ids_sha, text_sha, kept, decoded = [], [], [], [], []
            for raw in bpe.encode([t or "" for t in texts]):
                ids = np.frombuffer(raw, bpe.dtype).tolist()
                back = bpe.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b",".join(map(decimal, ids))).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                if keep_ids:
                    kept.append(ids)
                    decoded.append(back)
            return (n, ids_sha, text_sha, kept, decoded)[: 5 if keep_ids else 3]

        return run

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return map_texts(docs, encoder, fields, keep)
