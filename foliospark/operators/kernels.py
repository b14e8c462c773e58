"""Kernels on grey images and masks in numpy: running extremes, closings, blurs, connected components, edges, rectangles.

Masks are boolean arrays. Extremes over a window take a step for each doubling of its width, whatever the image holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np


def block_means(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means over a grid of nearly equal cells."""
    if (rows, cols) == x.shape:
        return x.astype(np.float64)
    exact = np.float32 if x.dtype in (np.uint8, bool) and x.shape[0] < 1 << 16 else np.float64  # sums of a column's bytes fit 24 bits
    total, sizes = x.astype(exact), []
    for n, cells in zip(x.shape, (rows, cols), strict=True):
        at = np.linspace(0, n, cells + 1).astype(int)
        least = int(np.diff(at).min())  # cells are so many pixels, or one more
        longer = np.flatnonzero(np.diff(at) > least)
        block = total[at[:-1, None] + np.arange(least)].sum(1)
        block[longer] += total[at[longer] + least]
        total = np.ascontiguousarray(block.T, np.float64)
        sizes.append(np.diff(at))
    return total / np.outer(*sizes)


def ranked(upto: Callable[[int], int], number: int, percent: float, near: int = 128) -> float:
    """Percentile (linear between neighbours) of so many 8-bit values, of which ``upto(v)`` are at most v; the search begins at ``near``."""

    def at(rank: int, low: int, first: int) -> int:
        high, middle = 255, first
        while low < high:
            low, high = (low, middle) if upto(middle) > rank else (middle + 1, high)
            middle = high - 1 if high == first else (low + high) // 2  # a good guess is only looked at from below
        return low

    place = (number - 1) * percent / 100
    below = int(place)
    low = at(below, 0, min(max(near, 0), 254))
    high = low if place == below or upto(low) > below + 1 else at(below + 1, low, low)
    return float(low + (high - low) * (place - below))


def percentile(x: np.ndarray, percent: float) -> float:
    """``numpy.percentile`` of 8-bit values, by counting those up to a value."""
    seen = np.sort(x.ravel()[::max(1, x.size // 1000)])
    return ranked(lambda v: np.count_nonzero(x <= v), x.size, percent, int(seen[int((len(seen) - 1) * percent / 100)]))


def median(x: np.ndarray, mask: np.ndarray | None = None) -> float:
    """``numpy.median`` (of the values in the mask): only values near the middle of a sample are put in order."""
    x, mask = x.ravel(), None if mask is None else mask.ravel()
    number = x.size if mask is None else np.count_nonzero(mask)
    within = lambda at: at if mask is None else at & mask
    step = max(1, x.size // 2000)
    seen = np.sort(x[::step] if mask is None else x[::step][mask[::step]])
    low, high = (seen[int(len(seen) * 0.45)], seen[int(len(seen) * 0.55)]) if len(seen) > 100 else (0, 0)
    before, first, last = np.count_nonzero(within(x < low)), (number - 1) // 2, number // 2
    near = x[within((x >= low) & (x <= high))] if low < high else np.full(np.count_nonzero(within(x == low)), low, x.dtype)
    if first < before or last >= before + near.size:
        return float(np.median(x if mask is None else x[mask]))
    near = np.partition(near, (first - before, last - before)) if low < high else near
    return float(np.mean(near[[first - before, last - before]]))


# ---- windows --------------------------------------------------------------------------------------------------------------------------


def bordered(x: np.ndarray, rows: int, cols: int, value: int = 0) -> np.ndarray:
    """``x`` with so many rows and columns of ``value`` around it."""
    out = np.full((x.shape[0] + 2 * rows, x.shape[1] + 2 * cols), value, x.dtype)
    out[rows:rows + x.shape[0], cols:cols + x.shape[1]] = x
    return out


def _extreme(x: np.ndarray, widths: list[int], largest: bool) -> np.ndarray:
    """Extreme over a shape that is symmetric both ways: ``widths[d]`` neighbours of the rows at distance d.

    Rows lie end to end with a border between them, so that a shift either way is one of a flat array. Each width is made of the one before by two shifted
    copies, or by doubling where that is too narrow.
    """
    if x.dtype == bool:
        return _extreme(np.ascontiguousarray(x).view(np.uint8), widths, largest).view(bool)
    pick, outside = (np.maximum, 0) if largest else (np.minimum, int(np.iinfo(x.dtype).max))
    side, reach, (rows, cols) = max(widths) // 2, len(widths) - 1, x.shape
    wide, oblong = cols + side, len(set(widths)) == 1
    edge = reach if oblong else 0  # rows above and below
    y = np.empty((rows + 2 * edge) * wide + 2 * side, x.dtype)
    y[:side + edge * wide] = y[side + (edge + rows) * wide:] = outside
    inside = y[side + edge * wide:side + (edge + rows) * wide].reshape(rows, wide)
    inside[:, :cols], inside[:, cols:] = x, outside
    have, out = 1, None
    for w in sorted(set(widths)):
        while have < w:  # y[i]: extreme over ``have`` pixels from i on
            step = min(have, w - have)
            y = pick(y[:-step], y[step:])
            have += step
        if oblong:
            tall = 1
            while tall < 2 * reach + 1:
                step = min(tall, 2 * reach + 1 - tall)
                y = pick(y[:-step * wide], y[step * wide:])
                tall += step
        own = y[side - w // 2:side - w // 2 + rows * wide]
        if oblong:
            out = own
            continue
        out = np.full(rows * wide, outside, x.dtype) if out is None else out
        for d in [d for d, v in enumerate(widths) if v == w and d < rows]:  # rows at distance d, either way
            pick(out[d * wide:], own[:(rows - d) * wide], out=out[d * wide:])
            if d:
                pick(out[:-d * wide], own[d * wide:], out=out[:-d * wide])
    return np.ascontiguousarray(out.reshape(rows, wide)[:, :cols])


def box(height: int, width: int) -> list[int]:
    return [width] * (height // 2 + 1)


@lru_cache(maxsize=8)
def ellipse(size: int) -> tuple[int, ...]:
    """Widths of the rows of a disc of ``size`` pixels across (odd), from its middle outwards."""
    r = size // 2
    return tuple(2 * int(np.rint(r * np.sqrt((r * r - d * d) / (r * r)))) + 1 for d in range(r + 1)) if r else (1,)


def dilated(x: np.ndarray, shape: list[int] | tuple[int, ...]) -> np.ndarray:
    return _extreme(x, list(shape), True)


def eroded(x: np.ndarray, shape: list[int] | tuple[int, ...]) -> np.ndarray:
    return _extreme(x, list(shape), False)


def closed(x: np.ndarray, shape: list[int] | tuple[int, ...]) -> np.ndarray:
    """What is darker than all of a shape's surroundings is filled."""
    return eroded(dilated(x, shape), shape)


def opened(x: np.ndarray, shape: list[int] | tuple[int, ...]) -> np.ndarray:
    return dilated(eroded(x, shape), shape)


def majority(mask: np.ndarray, side: int) -> np.ndarray:
    """Median of a mask over squares (side 3 or more): True where most of the square is; the border repeats outwards."""
    (h, w), half = mask.shape, side // 2
    wide = w + 2 * half
    count = np.zeros((h + 2 * half) * wide + 2 * half, np.uint8)  # rows lie end to end
    rows = count[:(h + 2 * half) * wide].reshape(h + 2 * half, wide)
    rows[half:half + h, half:half + w] = mask
    rows[:, :half], rows[:, half + w:] = rows[:, half:half + 1], rows[:, half + w - 1:half + w]
    rows[:half], rows[half + h:] = rows[half], rows[half + h - 1]
    for step, n in ((1, (h + 2 * half) * wide), (wide, h * wide)):
        total = count[:n] + count[step:step + n]
        for i in range(2, side):
            total += count[i * step:i * step + n]
        count = total
    return np.ascontiguousarray((count > side * side // 2).reshape(h, wide)[:, :w])


def places(mask: np.ndarray) -> np.ndarray:
    """``numpy.flatnonzero`` of a flat mask that is mostly False: only words of eight that aren't empty are looked at."""
    n = len(mask) // 8 * 8
    words = np.flatnonzero(np.ascontiguousarray(mask[:n]).view(np.uint64)) if n else np.zeros(0, int)
    if len(words) * 24 > n:
        return np.flatnonzero(mask)
    at = np.flatnonzero(mask[:n].reshape(-1, 8)[words])
    return np.concatenate([words[at >> 3] * 8 + (at & 7), n + np.flatnonzero(mask[n:])])


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places before the begin and at the end of each run along rows, in rows that are two places longer."""
    flat = bordered(np.ascontiguousarray(mask).view(np.uint8), 0, 1).ravel()
    at = places(flat[1:] != flat[:-1])  # rows begin and end with 0, so that changes take turns
    return at[::2], at[1::2]


def long_runs(mask: np.ndarray, least: int, down: bool = False) -> np.ndarray:
    """Only the runs of at least ``least`` pixels along rows, or down columns."""
    h, w = mask.shape
    if least > (h if down else w):
        return np.zeros((h, w), bool)
    rows = np.ascontiguousarray(mask).view(np.uint8)
    y, one, have = rows.ravel() if down else bordered(rows, 0, 1).ravel(), w if down else 1, 1  # rows lie end to end
    size = len(y)
    while have < least:  # y[i]: all of ``have`` pixels from i on
        step = min(have, least - have)
        y = y[:-step * one] & y[step * one:]
        have += step
    if not y.any():
        return np.zeros((h, w), bool)
    out = np.zeros(size + (least - 1) * one, np.uint8)
    out[(least - 1) * one:(least - 1) * one + len(y)] = y
    have = 1
    while have < least:  # any of the ``have`` places before
        step = min(have, least - have)
        out = out[:-step * one] | out[step * one:]
        have += step
    return np.ascontiguousarray(out[:size].view(bool).reshape(h, -1)[:, 0 if down else 1:][:, :w])


# ---- blurs and slopes -----------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=16)
def _blur_matrix(n: int, sigma: float) -> np.ndarray:
    """Row i holds the weights of a Gaussian around i; the image is mirrored at its ends."""
    reach = int(np.ceil(4 * sigma))
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    at = np.abs(np.arange(n)[:, None] + np.arange(-reach, reach + 1)[None, :]) % max(1, 2 * (n - 1))
    at = np.where(at >= n, 2 * (n - 1) - at, at)
    out = np.zeros((n, n), np.float32)
    np.add.at(out, (np.repeat(np.arange(n), len(taps)), at.ravel()), np.tile((taps / taps.sum()).astype(np.float32), n))
    return out


#: Rows of a blur that are made by one product.
_BAND = 64


def _banded(x: np.ndarray, sigma: float) -> np.ndarray:
    """The blur matrix times ``x``: a block of rows at a time, with the columns that aren't 0 alone. Where a column of ``x`` doesn't change, it stays as it is."""
    n, reach = len(x), int(np.ceil(4 * sigma))
    m = _blur_matrix(n, sigma)
    if n <= 2 * (reach + _BAND):
        return m @ x.astype(np.float32, copy=False)
    out = np.empty(x.shape, np.float32)
    for i in range(0, n, _BAND):
        low, high = max(0, i - reach), min(n, i + _BAND + reach)  # mirrored weights lie inside as well
        part = np.ascontiguousarray(x[low:high])
        change = np.flatnonzero((part != part[0]).any(0))
        out[i:i + _BAND] = part[0]
        if len(change):
            at = np.s_[change[0]:change[-1] + 1]
            out[i:i + _BAND, at] = m[i:i + _BAND, low:high] @ part[:, at].astype(np.float32, copy=False)
    return out


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur: matrix products for each axis."""
    return _banded(_banded(x if x.dtype == np.uint8 else x.astype(np.float32), sigma).T, sigma).T


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows between the rows of ``x``, each of which is the middle of its cell."""
    at = np.clip((np.arange(n) + 0.5) * len(x) / n - 0.5, 0, len(x) - 1)
    low = np.minimum(at.astype(int), max(0, len(x) - 2))
    share = (at - low).astype(np.float32)[:, None]
    out = x[low]
    out += (x[np.minimum(low + 1, len(x) - 1)] - out) * share
    return out


def smooth_field(x: np.ndarray, sigma: float) -> np.ndarray:
    """A wide blur: cells of a fraction of sigma are averaged, blurred and spread again."""
    step = max(1, int(sigma / 4))
    rows, cols = max(1, x.shape[0] // step), max(1, x.shape[1] // step)
    if (rows, cols) == x.shape:  # each cell is a pixel
        return np.ascontiguousarray(gaussian(x, sigma))
    small = gaussian(block_means(x, rows, cols), sigma * rows / x.shape[0])
    return _spread(np.ascontiguousarray(_spread(np.ascontiguousarray(small.T), x.shape[1]).T), x.shape[0])


def slopes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel slopes across and down of 8-bit pixels, as 16-bit integers; the border is mirrored."""
    if min(x.shape) > 1:
        y = np.empty((x.shape[0] + 2, x.shape[1] + 2), np.int16)
        y[1:-1, 1:-1] = x
        y[0, 1:-1], y[-1, 1:-1] = x[1], x[-2]
        y[:, 0], y[:, -1] = y[:, 2], y[:, -3]
    else:
        y = np.pad(x.astype(np.int16), 1, mode="edge")
    rows = y[:-2] + y[2:]
    rows += y[1:-1]
    rows += y[1:-1]
    cols = y[:, :-2] + y[:, 2:]
    cols += y[:, 1:-1]
    cols += y[:, 1:-1]
    return rows[:, 2:] - rows[:, :-2], cols[2:] - cols[:-2]


#: Steps by which ridges grow from their strong points before all of them are labelled.
_GROWTH = 4


def edges(x: np.ndarray, low: float, high: float, slope: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Ridges of the slope that reach ``low`` and hang together with one above ``high``."""
    across, down = slopes(x) if slope is None else slope
    gx, gy = np.abs(across), np.abs(down)
    size = bordered(gx + gy, 1, 1)
    here = size[1:-1, 1:-1]
    strong = here > high
    if not strong.any():
        return np.zeros(x.shape, bool)
    wide, n = size.shape[1], size.size
    flat_size, ridge_of = size.ravel(), {}
    for step in (1, wide, wide + 1, wide - 1):  # larger than the one before, not smaller than the one after
        top = np.zeros(n, bool)
        middle = flat_size[step:n - step]
        np.greater(middle, flat_size[:n - 2 * step], out=top[step:n - step])
        top[step:n - step] &= middle >= flat_size[2 * step:]
        ridge_of[step] = top.reshape(size.shape)[1:-1, 1:-1]
    fx, fy = gx.astype(np.float32), gy.astype(np.float32)
    level, steep = fy < np.float32(0.4142) * fx, fy > np.float32(2.4142) * fx
    falling = (across ^ down) >= 0  # of one sign; on a diagonal neither is 0
    ridge = (falling & ridge_of[wide + 1]) | (~falling & ridge_of[wide - 1])
    ridge = (level & ridge_of[1]) | (~level & ((steep & ridge_of[wide]) | (~steep & ridge)))
    ridge &= here > low
    found = ridge & strong
    for _ in range(_GROWTH):
        number = np.count_nonzero(found)
        if number in (0, np.count_nonzero(ridge)):
            return found
        found = dilated(found, box(3, 3)) & ridge
        if np.count_nonzero(found) == number:
            return found
    parts = components(ridge)
    hold = np.zeros(parts.number, bool)
    hold[parts.of_pixels(np.flatnonzero(ridge & strong))] = True
    return parts.mask(hold)


# ---- connected components ---------------------------------------------------------------------------------------------------------------


@dataclass
class Components:
    """Runs of a mask along rows (row, begin, end), in page order, with the number of the component of each; and each component's box, area and centre."""

    shape: tuple[int, int]
    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    label: np.ndarray
    number: int

    def _per(self, pick: np.ufunc, values: np.ndarray, start: int) -> np.ndarray:
        out = np.full(self.number, start)
        pick.at(out, self.label, values)
        return out

    @cached_property
    def area(self) -> np.ndarray:
        return np.bincount(self.label, self.end - self.begin, self.number).astype(np.int64)

    @cached_property
    def boxes(self) -> np.ndarray:
        """x, y, width, height of each component."""
        big = max(self.shape)
        x, y = self._per(np.minimum, self.begin, big), self._per(np.minimum, self.row, big)
        return np.stack([x, y, self._per(np.maximum, self.end, 0) - x, self._per(np.maximum, self.row + 1, 0) - y], 1)

    @cached_property
    def centres(self) -> np.ndarray:
        n = self.end - self.begin
        area = np.maximum(1, self.area)
        return np.stack([np.bincount(self.label, (self.begin + self.end - 1) * n / 2, self.number) / area, np.bincount(self.label, self.row * n, self.number) / area], 1)

    def of_pixels(self, at: np.ndarray) -> np.ndarray:
        """The component of each pixel (row * width + column) of the mask."""
        return self.label[np.searchsorted(self.row * self.shape[1] + self.begin, at, side="right") - 1]

    def mask(self, keep: np.ndarray) -> np.ndarray:
        """Pixels of the components that are kept."""
        kept = keep[self.label] if self.number else np.zeros(0, bool)
        if not kept.any():
            return np.zeros(self.shape, bool)
        size = (self.end - self.begin)[kept]
        first = (self.row * self.shape[1] + self.begin)[kept] - (np.cumsum(size) - size)
        out = np.zeros(self.shape, bool)
        out.ravel()[np.repeat(first, size) + np.arange(size.sum())] = True
        return out

    def borders(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last pixel of each row of these components: the component's place in ``which``, row, first and last column, by component and row."""
        place = np.full(self.number, -1)
        place[which] = np.arange(len(which))
        at = np.flatnonzero(place[self.label] >= 0)
        at = at[np.argsort(place[self.label[at]], kind="stable")]
        of, row = place[self.label[at]], self.row[at]
        new = np.flatnonzero(np.diff(of, prepend=-1) | np.diff(row, prepend=-1))
        last = np.append(new[1:], len(at))[:len(new)] - 1
        return of[new], row[new], self.begin[at][new], self.end[at][last] - 1


def joined(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """The least node that links (a, b) reach from each of the nodes 0, 1, ...: union by repeated hooking and halving of paths."""
    label = np.arange(nodes)
    label[np.maximum(a, b)] = np.minimum(a, b)  # one lower neighbour of each, at first
    while True:
        up = label[label]
        if (up == label).all():
            break
        label = up
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def components(mask: np.ndarray, diagonal: bool = True) -> Components:
    """Connected parts of a mask: runs of each row, joined where runs of the next row touch them."""
    h, w = mask.shape
    first, last = _runs(mask)
    row, begin = np.divmod(first + 1, w + 2)
    begin, end = begin - 1, (last + 1) % (w + 2) - 1
    wide, reach = w + 2, 1 if diagonal else 0
    starts, ends = row * wide + begin, row * wide + end
    n = len(row)
    key, upto = starts + wide + (0 if diagonal else 1), ends + wide - 1 + reach
    if 64 * n < h * wide:
        low, high = np.searchsorted(ends, key, side="left"), np.searchsorted(starts, upto, side="right")
    else:
        begun = np.repeat(np.arange(n + 1, dtype=np.int32), np.diff(starts, prepend=0, append=(h + 2) * wide))  # how many runs have begun at a place or before it
        low, high = begun[key - 1].astype(np.int64), begun[upto]
        low -= ends[low - 1] >= key
    number = np.maximum(0, high - low)
    a = np.repeat(np.arange(n), number)
    b = np.arange(len(a)) + np.repeat(low - np.cumsum(number) + number, number)
    least = joined(a, b, n)
    own = least == np.arange(n)
    return Components((h, w), row, begin, end, (np.cumsum(own) - 1)[least], int(np.count_nonzero(own)))


def border_parts(parts: Components) -> np.ndarray:
    """Which components reach the border of the image."""
    out = np.zeros(parts.number, bool)
    out[parts.label[(parts.row == 0) | (parts.row == parts.shape[0] - 1) | (parts.begin == 0) | (parts.end == parts.shape[1])]] = True
    return out


def spanned_area(mask: np.ndarray) -> float:
    """Area of the outline through the middles of border pixels: whole squares of four pixels, half of those of three."""
    m = mask.astype(np.int8)
    four = m[:-1, :-1] + m[1:, :-1] + m[:-1, 1:] + m[1:, 1:]
    return float((four == 4).sum() + 0.5 * (four == 3).sum())


# ---- rectangles and neighbours ----------------------------------------------------------------------------------------------------------


def _bends(of: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Of points in the order of components and rows, the corners of the hull towards smaller columns.

    A point that isn't beyond the line between its neighbours is no corner: all such go, until none is left.
    """
    at = np.arange(len(of))
    while len(at) > 2:
        a, b, c = at[:-2], at[1:-1], at[2:]
        inside = (of[a] == of[c]) & ((column[b] - column[a]) * (row[c] - row[a]) >= (column[c] - column[a]) * (row[b] - row[a]))
        if not inside.any():
            break
        at = at[np.concatenate([[True], ~inside, [True]])]
    return at


def least_rectangles(of: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """Of the least rectangle around each of the components 0, 1, ...: long side, short side, and the angle of the long side in degrees (above -90 to 90, falling lines positive).

    Components are given by their rows' first and last columns, by component and row (see ``Components.borders``).
    """
    number = int(of.max(initial=-1)) + 1
    left, right = _bends(of, row, first), _bends(of, row, -last)
    # corners in turn: down the right side, up the left one, from the upper corner of the least column on
    corner_of = np.concatenate([of[right], of[left][::-1]])
    points = np.concatenate([np.stack([last[right], row[right]], 1), np.stack([first[left], row[left]], 1)[::-1]]).astype(float)
    order = np.argsort(corner_of, kind="stable")
    corner_of, points = corner_of[order], points[order]
    start = np.searchsorted(corner_of, np.arange(number))
    size = np.diff(start, append=len(corner_of))
    turn = np.arange(len(corner_of)) - start[corner_of]
    begin = np.lexsort((points[:, 1], points[:, 0], corner_of))[start]  # by column, then row
    turn = (turn - (begin - start)[corner_of]) % size[corner_of]
    order = np.lexsort((turn, corner_of))
    points = points[order]
    after = np.arange(len(points)) + 1
    after[start + size - 1] = start
    side = points[after] - points
    length = np.hypot(side[:, 0], side[:, 1])
    edge = np.flatnonzero(length > 0)
    u = side[edge] / length[edge][:, None]
    # each side with all corners of its component
    many = size[corner_of[edge]]
    begins = np.cumsum(many) - many
    which = np.repeat(np.arange(len(edge)), many)
    corner = np.arange(len(which)) - begins[which] + start[corner_of[edge]][which]
    x, y = points[corner].T
    along, across = x * u[which, 0] + y * u[which, 1], y * u[which, 0] - x * u[which, 1]
    spans = [np.maximum.reduceat(v, begins) - np.minimum.reduceat(v, begins) if len(edge) else np.zeros(0) for v in (along, across)]
    best = np.lexsort((np.arange(len(edge)), spans[0] * spans[1], corner_of[edge]))
    best = best[np.diff(corner_of[edge][best], prepend=-1) > 0]
    out = np.zeros((3, number))
    a, b = spans[0][best], spans[1][best]
    angle = np.degrees(np.arctan2(u[best, 1], u[best, 0])) + np.where(a >= b, 0, 90)
    out[:, corner_of[edge][best]] = np.maximum(a, b), np.minimum(a, b), 90 - (90 - angle) % 180
    return tuple(out.tolist())


def least_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """Long side, short side and angle of the least rectangle around the points (x, y)."""
    x, y = points[np.lexsort((points[:, 0], points[:, 1]))].T
    first = np.flatnonzero(np.diff(y, prepend=y[0] - 1))
    (long,), (short,), (angle,) = least_rectangles(np.zeros(len(first), int), y[first], x[first], x[np.append(first[1:], len(x)) - 1])
    return long, short, angle


def nearest(points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the points with another within ``reach``: their numbers, and their nearest others (ties: the first), by a grid of cells of that size."""
    cell = np.floor((points - points.min(0, initial=0)) / reach).astype(np.int64) + 1 if len(points) else np.zeros((0, 2), np.int64)
    wide = int(cell[:, 0].max(initial=0)) + 2
    key = cell[:, 1] * wide + cell[:, 0]
    order = np.argsort(key, kind="stable")
    sorted_key, x, y = key[order], *np.ascontiguousarray(points.T)
    pairs = []
    for down in (-1, 0, 1):
        low = np.searchsorted(sorted_key, key + down * wide - 1, side="left")
        number = np.searchsorted(sorted_key, key + down * wide + 1, side="right") - low
        a = np.repeat(np.arange(len(points)), number)
        b = order[np.arange(len(a)) + np.repeat(low - np.cumsum(number) + number, number)]
        d = (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2
        d[(a == b) | (d >= reach * reach)] = np.inf
        pairs.append((a, b, d))
    a, b, d = (np.concatenate(v) for v in zip(*pairs, strict=True))
    least = np.full(len(points), np.inf)
    np.minimum.at(least, a, d)
    tied = (d == least[a]) & (d < np.inf)
    other = np.full(len(points), len(points))
    np.minimum.at(other, a[tied], b[tied])
    who = np.flatnonzero(other < len(points))
    return who, other[who]
