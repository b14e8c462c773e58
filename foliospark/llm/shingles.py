"""Word shingles of whole batches of texts as 64-bit codes, straight from their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes that are hashed at a time.
SEGMENT = 1 << 18

#: True for bytes of a word: all but the white space 0x20 and 0x09-0x0D.
NOT_SPACE = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: True for ASCII letters and digits and for all bytes of characters beyond ASCII.
ALPHANUMERIC = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit codes evenly (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: A random code for each byte; A-Z have those of a-z.
_BYTES = mix(np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1000))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = np.full(max(n, SEGMENT + 4096), _ODD if kind == "up" else _INVERSE)
        base[0] = 1
        _powers[kind] = np.multiply.accumulate(base)
    return _powers[kind][:n]


def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the number of words before each row; words don't reach over rows."""
    inside = is_word[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    if len(cuts) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    held = inside[cuts[:-1]]
    starts, ends = cuts[:-1][held], cuts[1:][held]
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A code of each word, without regard to the case of A-Z."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + SEGMENT, side="right")))
        high = ends[stop - 1]
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTES[raw[low:high]] * _power("up", high - low), out=total[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = (total[e] - total[s]) * _power("down", high - low)[s]
        at = stop
    return mix(out)


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the k-word shingles of each row in order, and where each row's begin.

    A row of fewer than k words has one, the whole sequence; a row without words has none.
    """
    starts, ends, before = words(raw, offsets, is_word)
    w = word_codes(raw, starts, ends)
    count = np.diff(before)
    number = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.zeros(len(offsets), np.int64)
    np.cumsum(number, out=begin[1:])
    first = np.arange(begin[-1]) + np.repeat(before[:-1] - begin[:-1], number)
    full = np.repeat(count >= k, number)
    code = np.zeros(len(first), np.uint64)
    at = first[full]
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total = total * _ODD + w[at + j]
    code[full] = total + np.uint64(k)
    for m in range(1, k):
        short = np.flatnonzero(~full & (np.repeat(count, number) == m))
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for j in range(m):
                total = total * _ODD + w[first[short] + j]
            code[short] = total + np.uint64(m)
    return mix(code), begin
