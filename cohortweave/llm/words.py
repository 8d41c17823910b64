"""Words, 64-bit word hashes and 5-word shingles of whole texts, in numpy.

A word is a maximal run of bytes other than space and \\t..\\r. Word hashes are
polynomial over a table of random byte values and then mixed, so that they are
the same in every process.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Bytes of a text that are hashed at once; words are the same however it is cut.
_SEGMENT = 1 << 17
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_K = np.uint64(0x9E3779B97F4A7C15)
_KINV = np.uint64(pow(int(_K), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 14), base, np.uint64)
        p[0] = 1
        have = _powers[name] = np.multiply.accumulate(p)
    return have[:n]


def spans(arr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    inside = np.zeros(len(arr) + 2, np.int8)
    inside[1:-1] = ~_WS[arr]
    d = np.diff(inside)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _segment_hashes(arr: np.ndarray) -> np.ndarray:
    starts, ends = spans(arr)
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(arr) + 1, np.uint64)
    np.cumsum(_BYTES[arr] * _power("k", _K, len(arr)), out=total[1:])
    h = (total[ends] - total[starts]) * _power("kinv", _KINV, len(arr))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _STEP)


def word_hashes(data: bytes) -> np.ndarray:
    """A uint64 for each word of the text, in order. Long texts go segment by segment, cut at white space."""
    if len(data) <= _SEGMENT:
        return _segment_hashes(np.frombuffer(data, np.uint8))
    out, at = [], 0
    arr = np.frombuffer(data, np.uint8)
    while at < len(arr):
        end = min(len(arr), at + _SEGMENT)
        while end < len(arr) and not _WS[arr[end]]:
            end += 1
        out.append(_segment_hashes(arr[at:end]))
        at = end
    return np.concatenate(out)


def windows(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all windows of n words; none when there are fewer words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for i in range(1, n):
        out *= _STEP
        out += h[i : i + m]
    return mix(out)


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of the text with A-Z lower-cased.

    Fewer than n words make one shingle of the whole sequence; no word, none.
    """
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if len(h) == 0:
        return h
    if len(h) < n:
        whole = np.uint64(len(h))
        for x in h:
            whole = np.uint64((int(whole) * int(_STEP) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        return mix(np.array([whole], np.uint64))
    return np.unique(windows(h, n))
