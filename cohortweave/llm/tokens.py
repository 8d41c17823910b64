"""Encoding with the tokenizers library inside tasks, once for each distinct space-delimited piece."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Marks a text's first piece, which has no space before it; no piece holds a space.
HEAD = " "
_UNSAFE = re.compile(r" (?:\s|\Z)")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceMemo:
    """Ids of texts, put together from the memoised ids of their space-delimited pieces.

    Subclasses say how to encode a whole text and how to encode many new pieces. The memo
    has two generations of bounded size, so that frequent pieces outlive a change.
    """

    special: list[str] = []
    pieces = True
    #: Pieces in each of the two generations.
    room = 500_000

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        raise NotImplementedError

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with a space before it; of one that is marked as HEAD, without mark and space."""
        raise NotImplementedError

    def _some(self, texts: list[str]) -> list[bytes]:
        every: list[str] = []
        ends = []
        for t in texts:
            pieces = t.split(" ")
            pieces[0] = HEAD + pieces[0]
            every += pieces
            ends.append(len(every))
        values = list(map(self.young.get, every))
        missing = [i for i, v in enumerate(values) if v is None]
        if missing:
            old, young = self.old, self.young
            new = []
            for p in dict.fromkeys([every[i] for i in missing]):
                v = old.get(p)
                if v is None:
                    new.append(p)
                else:
                    young[p] = v
            for k in range(0, len(new), 20_000):
                young.update(zip(new[k : k + 20_000], self.learn(new[k : k + 20_000])))
            for i in missing:
                values[i] = young[every[i]]
            if len(young) > self.room:
                self.old, self.young = young, {}
        out, at = [], 0
        for end in ends:
            out.append(b"".join(values[at:end]))
            at = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of self.dtype."""
        out: list[bytes] = [b""] * len(texts)
        split: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.pieces or _UNSAFE.search(text) or any(s in text for s in self.special):
                out[i] = self.whole(text)
            else:
                split.append(i)
        at = 0
        while at < len(split):
            size, end = 0, at
            while end < len(split) and size < 1 << 20:
                size += len(texts[split[end]])
                end += 1
            for i, raw in zip(split[at:end], self._some([texts[i] for i in split[at:end]])):
                out[i] = raw
            at = end
        return out


class LibraryEncoder(PieceMemo):
    """ids of whole texts exactly as tokenizers' encode(text, add_special_tokens=False) gives them.

    With a byte-level pre-tokenizer a space before a non-space always starts a new
    pre-token, so the pieces between such spaces are encoded independently: the library
    sees each distinct piece once and a bounded memo keeps its ids. Texts where that cut
    is not certain (runs of white space, special tokens) and other kinds of tokenizer go to the
    library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.pieces = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", False)
            and not pre.get("add_prefix_space", True)
            and not spec.get("normalizer")
            and all(" " not in t for t in self.special)
        )
        self.opens = np.zeros(size, bool)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.opens[i] = token.startswith("Ġ")

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, pieces: list[str]) -> list[bytes]:
        """One call for all pieces, cut at the ids that open with a space; one more for the heads."""
        heads = [i for i, p in enumerate(pieces) if p[:1] == HEAD]
        if heads:
            whole = self.tok.encode_batch_fast([pieces[i][1:] for i in heads], add_special_tokens=False)
            known = {i: np.array(x.ids, self.dtype).tobytes() for i, x in zip(heads, whole)}
            rest = [p for i, p in enumerate(pieces) if i not in known]
            others = iter(self.learn(rest) if rest else [])
            return [known[i] if i in known else next(others) for i in range(len(pieces))]
        many = self.tok.encode_batch_fast([" " + " ".join(pieces)], add_special_tokens=False)
        ids = np.array(many[0].ids, self.dtype)
        cuts = np.append(np.flatnonzero(self.opens[ids]), len(ids)).tolist()
        if len(cuts) != len(pieces) + 1:
            return [self.whole(" " + p) for p in pieces]
        raw, w = ids.tobytes(), self.dtype.itemsize
        return [raw[w * a : w * b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    """The encoder of this worker process; its memo serves the worker's later tasks too."""
    return LibraryEncoder(path)
