"""Character n-grams of whole batches of texts, found by rolling 64-bit codes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from foliospark.llm.common import windows

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are held as 64-bit codes at a time.
WINDOW = 1 << 19


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each row begins among them."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lead = (raw & 0xC0) != 0x80
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    text = raw[int(np.argmax(lead)):].tobytes().decode("utf-8", "ignore")
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    return points, np.minimum(before[offsets], len(points))


def rolling(points: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, code of the n-gram that begins at each position) for each order, ascending."""
    points = (points + np.uint64(1)) * _SPREAD
    codes = points.copy()
    for n in range(1, max(orders) + 1):
        if n > 1:
            codes = codes[:-1] * _STEP + points[n - 1:] if len(codes) > 1 else codes[:0]
        if not len(codes):
            return
        if n in orders:
            yield n, codes + np.uint64(n)


class NgramIndex:
    """Maps the codes of chosen n-grams to feature numbers 0, 1, ...; other n-grams have none."""

    BITS = 21

    def __init__(self, codes: np.ndarray, orders: tuple[int, ...]):
        self.codes, self.orders = np.asarray(codes, np.uint64), orders
        slots = self._slots(self.codes)
        self.table = np.full(1 << self.BITS, -1, np.int32)
        self.table[slots[::-1]] = np.arange(len(codes), dtype=np.int32)[::-1]
        # codes that share a slot with an earlier one are looked up in a sorted list instead
        late = np.flatnonzero(self.table[slots] != np.arange(len(codes)))
        late = late[np.argsort(self.codes[late], kind="stable")]
        self.late, self.late_codes = late, self.codes[late]

    def __len__(self) -> int:
        return len(self.codes)

    def __reduce__(self) -> tuple:  # the table is made again where the index arrives
        return type(self), (self.codes, self.orders)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _STEP) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that hold a chosen n-gram, and its feature number."""
        found = self.table[self._slots(codes)]
        at = np.flatnonzero(found >= 0)
        feature = found[at]
        same = self.codes[feature] == codes[at]
        if len(self.late) and not same.all():
            other = np.flatnonzero(~same)
            place = np.minimum(np.searchsorted(self.late_codes, codes[at[other]]), len(self.late) - 1)
            hit = self.late_codes[place] == codes[at[other]]
            feature[other[hit]] = self.late[place[hit]]
            same[other[hit]] = True
        return at[same], feature[same]

    def occurrences(self, raw: np.ndarray, offsets: np.ndarray, seen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, feature) of each occurrence in a batch of UTF-8 rows; n-grams don't reach over a row's end.

        ``seen`` (rows by slots) gets a 1 in the slot of every n-gram of a row, chosen or not.
        """
        for first, end, low, high in windows(offsets, WINDOW, 4 * max(self.orders)):
            points, starts = code_points(raw[low:high], np.clip(offsets[first:end + 1] - low, 0, high - low))
            row_of = np.repeat(np.arange(first, end, dtype=np.int32), np.diff(starts))
            for n, codes in rolling(points, self.orders):
                if seen is not None:
                    whole = np.flatnonzero(row_of[: len(codes)] == row_of[n - 1:])
                    seen[row_of[whole], ((codes[whole] * _STEP) >> np.uint64(64 - seen.shape[1].bit_length() + 1)).astype(np.int64)] = 1
                at, feature = self._find(codes)
                row = row_of[at]
                inside = row == row_of[at + (n - 1)]
                yield (row, feature) if inside.all() else (row[inside], feature[inside])

    def presence(self, raw: np.ndarray, offsets: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
        """Rows by features: 1 where the text holds the n-gram anywhere. ``seen``: see ``occurrences``."""
        rows, width = len(offsets) - 1, len(self)
        flags = np.zeros(rows * width, np.uint8)
        for row, feature in self.occurrences(raw, offsets, seen):
            flags[row.astype(np.int64) * width + feature] = 1
        return flags.reshape(rows, width)

    SLOT_BITS = 16

    def spectra(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Presence of the chosen n-grams, and of each row the number of all its distinct n-grams, by linear counting in ``2 ** SLOT_BITS`` slots."""
        slots = 1 << self.SLOT_BITS
        seen = np.zeros((len(offsets) - 1, slots), np.uint8)
        flags = self.presence(raw, offsets, seen)
        free = slots - seen.sum(1, dtype=np.int64)
        return flags, np.where(free == slots, 0.0, -slots * np.log(np.maximum(free, 1) / slots))


def distinct_codes(text: str, orders: tuple[int, ...]) -> np.ndarray:
    """Codes of the distinct n-grams of one text."""
    raw = np.frombuffer(text.encode("utf-8", "ignore"), np.uint8)
    points, _ = code_points(raw, np.array([0, len(raw)]))
    parts = [np.unique(codes) for _, codes in rolling(points, orders)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def as_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a list of texts."""
    coded = [t.encode("utf-8", "ignore") for t in texts]
    offsets = np.zeros(len(coded) + 1, np.int64)
    np.cumsum([len(c) for c in coded], out=offsets[1:])
    return np.frombuffer(b"".join(coded), np.uint8), offsets
