"""Measurements of page images, in numpy on batches of 8-bit grey pixels. Formulas follow the metrics' definitions, not any library's pixels.

A page is measured at a bounded working size, inside of its sheet: dark surroundings that reach the border aren't paper. Light is judged
against the page's own illumination field. Each image is one row of a Spark table and is measured by itself; regions come in pixels of the source.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from foliospark.operators import kernels as k

# Working size, grids and limits of the metrics.
WORK, INK_STEP, GRID, TILES = 1600, 18, 48, 6
GLARE_LEVEL, GLARE_OVER, SHADOW_SHARE, LOW_TILE = 250, 10, 0.70, 28.0
LEAST_SHEET, TOUCHES, VISIBLE = 0.15, 0.5, 0.85
LEAST_PARTS, LEAST_LINES, LEAST_GLYPHS, LEAST_NEIGHBOURS = 25, 6, 80, 40
SPREAD_ASPECT, SPREAD_BAND, VALLEY = 1.15, (0.32, 0.68), 22.0
SIDES = ("top", "bottom", "left", "right")
#: Pixels and glyphs that are looked at where there are more, drawn by this seed.
SAMPLE, GLYPHS, SEED = 20_000, 1_500, 7

REGION = "struct<x:int,y:int,w:int,h:int>"
METRICS = (
    "page_id long, width int, height int, is_bitonal boolean, median_luma double, paper_level double, ink_level double, ink_paper_contrast double, ink_coverage double, text_ink_coverage double, text_component_count int, "
    "est_text_height_px double, est_dpi double, noise_sigma double, snr double, stroke_sharpness double, skew_deg double, rotation_deg int, rotation_confidence double, glare_area_fraction double, "
    "shadow_area_fraction double, illumination_ratio double, tile_count int, low_contrast_tiles int, cutoff_edges array<string>, likely_spread boolean, hash long, error string, doc_area_fraction double, "
    f"visible_edges array<string>, spread_split_x int, capture_profile string, worst_tile {REGION}, worst_tile_contrast double, shadow_regions array<{REGION}>, glare_regions array<{REGION}>, cutoff_regions array<{REGION}>, seconds double")


def read_pgm(data: bytes) -> np.ndarray:
    """Pixels of a binary PGM (P5, 8 bits): the one image format that needs no library."""
    head = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not head or int(head[3]) > 255:
        raise ValueError("not an 8-bit binary PGM")
    w, h = int(head[1]), int(head[2])
    if not w or not h:
        raise ValueError("the image has no pixels")
    if len(data) < head.end() + w * h:
        raise ValueError("the image is cut off")
    return np.frombuffer(data, np.uint8, w * h, head.end()).reshape(h, w)


def write_pgm(x: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (x.shape[1], x.shape[0]) + np.ascontiguousarray(x, np.uint8).tobytes()


def shrunk(x: np.ndarray, most: int = WORK) -> np.ndarray:
    """At most ``most`` pixels long, by means over areas; never enlarged."""
    scale = most / max(x.shape)
    return x if scale >= 1 else np.rint(k.block_means(x, max(1, int(x.shape[0] * scale)), max(1, int(x.shape[1] * scale)))).astype(np.uint8)


def illumination(x: np.ndarray) -> np.ndarray:
    """Brightness of the paper around each pixel: a closing by a disc wider than any stroke, then a blur.

    Where a square inside of the disc meets the brightest level of the image, so does the disc; the closing is made around the other pixels.
    """
    size = max(15, min(x.shape) // 20 | 1)
    disc, half, top = k.ellipse(size), size // 2, x.max()
    square = half * 2 // 3 * 2 + 1
    lower = k.dilated(x, k.box(square, square)) < top
    rows, cols = np.flatnonzero(lower.any(1)), np.flatnonzero(lower.any(0))
    if not len(rows):
        return np.full(x.shape, top, np.float32)
    around = lambda n: np.s_[max(0, rows[0] - n):rows[-1] + 1 + n, max(0, cols[0] - n):cols[-1] + 1 + n]
    bright = np.full_like(x, top)
    bright[around(half)] = k.dilated(x[around(2 * half)], disc)[_inner(x.shape, around(2 * half), around(half))]
    field = np.full_like(x, top)
    field[around(half)] = k.eroded(bright[around(2 * half)], disc)[_inner(x.shape, around(2 * half), around(half))]
    return k.smooth_field(field, size / 4)


def _inner(shape: tuple[int, int], whole: tuple[slice, slice], part: tuple[slice, slice]) -> tuple[slice, slice]:
    """Where ``part`` of an image lies in ``whole``."""
    return tuple(slice(p.start - w.start, min(p.stop, n) - w.start) for n, w, p in zip(shape, whole, part, strict=True))


def paper_percentile(x: np.ndarray, percent: float = 85, side: int = 5) -> float:
    """Percentile of the medians of small squares; on larger images every fourth square each way counts.

    A median is at most v where most of its square is, so squares are counted, not sorted.
    """
    step = 4 if min(x.shape) >= 200 else 1
    y = np.pad(x, side // 2, mode="edge")
    h, w = x.shape

    wide = y.shape[1]

    def upto(v: int) -> int:
        low = (y <= v).view(np.uint8)
        down = sum((low[i:i + h:step] for i in range(1, side)), low[:h:step]).ravel()
        n = len(down) - side + 1
        most = np.zeros(len(down), bool)
        most[:n] = sum((down[j:j + n] for j in range(1, side)), down[:n]) > side * side // 2
        return np.count_nonzero(most.reshape(-1, wide)[:, :w:step])

    seen = np.sort(x[::step * 8, ::step * 8].ravel())
    return k.ranked(upto, -(-h // step) * -(-w // step), percent, int(seen[int((len(seen) - 1) * percent / 100)]))


def sheet(x: np.ndarray) -> tuple[np.ndarray, float, list[str]]:
    """Mask of the sheet, its share of the frame, and the sides on which its edge can be seen.

    What is dark, freed of specks and small gaps, and reaches the border is no paper. Where that leaves under 15 % of the frame, the whole frame is the sheet.
    """
    h, w = x.shape
    dark = k.eroded(k.majority(x < max(50.0, 0.45 * paper_percentile(x)), 5), k.box(7, 7))
    if not dark.any():  # a page without dark surroundings
        return np.ones((h, w), bool), 1.0, []
    dark = k.dilated(dark, k.box(7, 7))
    parts = k.components(k.closed(dark, k.box(11, 11)), diagonal=False)
    paper = k.opened(~parts.mask(k.border_parts(parts)), k.box(7, 7))
    share = float(paper.mean())
    if share < LEAST_SHEET:
        paper, share = np.ones((h, w), bool), 1.0
    edge = max(2, int(min(h, w) * 0.004))
    cover = (paper[:edge].mean(), paper[-edge:].mean(), paper[:, :edge].mean(), paper[:, -edge:].mean())
    return paper, share, [side for side, c in zip(SIDES, cover, strict=True) if c < VISIBLE]


def without_rules(ink: np.ndarray) -> np.ndarray:
    """Ink without long straight lines: runs of a twelfth of the page, and what touches them."""
    h, w = ink.shape
    lines = k.long_runs(ink, max(20, w // 12)) | k.long_runs(ink, max(20, h // 12), down=True)
    return ink & ~k.dilated(lines, k.box(3, 3)) if lines.any() else ink


def noise(x: np.ndarray, paper: np.ndarray, slope: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """Immerkaer's noise estimate on paper away from edges; 0 with under 500 such pixels."""
    if min(x.shape) < 8:
        return 0.0
    y = x.astype(np.int16)
    down = y[:-2] - 2 * y[1:-1] + y[2:]
    across = np.abs(down[:, :-2] - 2 * down[:, 1:-1] + down[:, 2:])
    flat = (paper & ~k.dilated(k.edges(x, 40, 120, slope), k.box(5, 5)))[1:-1, 1:-1]
    number = np.count_nonzero(flat)
    return float((across * flat).sum(dtype=np.int64) / number * np.sqrt(np.pi / 2) / 6) if number >= 500 else 0.0


def sharpness(x: np.ndarray, ink: np.ndarray, dark: float, near: float = 128, slope: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """Mean slope at the borders of ink in shares of the step from paper to ink (``dark``: its mean; ``near``: about the paper's); a seeded sample of borders on large pages."""
    number = np.count_nonzero(ink)
    if number < 300:
        return 0.0
    at = k.places((k.dilated(ink, k.box(3, 3)) & ~k.eroded(ink, k.box(3, 3))).ravel())
    if len(at) < 200:
        return 0.0
    if len(at) > SAMPLE:
        at = np.random.default_rng(SEED).choice(at, SAMPLE, replace=False)
    across, down = (s.ravel()[at].astype(np.float32) for s in (k.slopes(x) if slope is None else slope))
    clear = ~ink
    bright = k.ranked(lambda v: np.count_nonzero((x <= v) & clear), ink.size - number, 60, int(near)) if number < ink.size else 255.0
    return float(np.hypot(across, down).mean() / max(1.0, bright - dark))


def _region(x: float, y: float, w: float, h: float, scale: float) -> dict:
    return {"x": int(x * scale), "y": int(y * scale), "w": int(w * scale), "h": int(h * scale)}


@dataclass
class Light:
    ratio: float = 1.0
    shadow: float = 0.0
    glare: float = 0.0
    shadows: tuple = ()
    glares: tuple = ()


def light(field: np.ndarray, paper: np.ndarray, scale: float) -> Light:
    """Unevenness, shadow and glare on a grid of cells of paper, with the three largest regions of each.

    A bright part of over a fifth of the cells isn't glare but another sheet.
    """
    n = GRID, GRID
    short = tuple((0, max(0, GRID - size)) for size in field.shape)
    level, real = (k.block_means(np.pad(m, short, mode="edge"), *n) if any(after for _, after in short) else np.full(n, float(m[0, 0])) if (m == m[0, 0]).all() else k.block_means(m, *n) for m in (field, paper))
    real = real > 200 / 255
    if real.sum() < 40:
        return Light()
    middle = float(np.median(level[real]))
    low, high = np.percentile(level[real], (5, 95))
    glare = real & (level >= GLARE_LEVEL) & (level > middle + GLARE_OVER)
    bright = k.components(glare)
    glare = bright.mask(bright.area <= 0.20 * real.sum())
    shadow = real & (level < SHADOW_SHARE * middle)
    dy, dx = field.shape[0] / GRID * scale, field.shape[1] / GRID * scale

    def regions(cells: np.ndarray) -> tuple:
        parts = k.components(k.closed(cells, k.box(3, 3)))
        found = []
        for i in range(parts.number):
            x, y, w, h = parts.boxes[i].tolist()
            own = parts.mask(np.arange(parts.number) == i)[y:y + h, x:x + w]
            found.append((k.spanned_area(own), {"x": int(x * dx), "y": int(y * dy), "w": int(w * dx), "h": int(h * dy)}))
        return tuple(r for area, r in sorted(found, key=lambda f: -f[0])[:3] if area >= 4)

    return Light(float(high / max(1.0, low)), float(shadow.sum() / real.sum()), float(glare.sum() / real.sum()), regions(shadow), regions(glare))


def text_size(text: np.ndarray, parts: k.Components) -> tuple[int, float]:
    """Number of writing-like parts and their median height."""
    h, w = text.shape
    boxes = parts.boxes
    kept = (parts.area >= 10) & (boxes[:, 3] >= 4) & (boxes[:, 3] <= 0.25 * h) & (boxes[:, 2] <= 0.5 * w)
    number = int(kept.sum())
    return number, float(np.median(boxes[kept, 3])) if number else 0.0


def text_skew(text: np.ndarray, number: int, height: float) -> float:
    """The skew in degrees of so many parts of this height.

    Closed along the line, the parts become lines; the skew is the median of the long lines' angles, weighted by length. 0 with under 25 parts or 6 lines.
    """
    if number < LEAST_PARTS:
        return 0.0
    lines = k.components(k.closed(text, k.box(3, max(9, int(4 * height) | 1))))
    found = []
    wide = np.flatnonzero(np.hypot(lines.boxes[:, 2], lines.boxes[:, 3]) >= 6 * height)
    for long, short, angle in zip(*k.least_rectangles(*lines.borders(wide)), strict=True):
        if short > 0 and long / max(short, 1.0) >= 4 and long >= 6 * height:
            found.append((angle - 90 if angle > 45 else angle + 90 if angle < -45 else angle, long))
    if len(found) < LEAST_LINES:
        return 0.0
    angle, weight = np.array(sorted(found)).T
    total = np.cumsum(weight)
    return float(angle[np.searchsorted(total, total[-1] / 2)])


def line_energy(text: np.ndarray, height: float) -> float:
    """Total length of what becomes long and thin when ink is closed along the rows."""
    lines = k.components(k.closed(text, k.box(1, max(5, int(2.5 * height)) | 1)))
    long, thick = lines.boxes[:, 2], lines.boxes[:, 3]
    return float(long[(long >= 4 * thick) & (long > 6 * height)].sum())


def rotation(text: np.ndarray, height: float, parts: k.Components) -> tuple[int, float]:
    """0 or 90 degrees, and how sure: lines of ink and the direction in which glyphs neighbour each other must agree, else 0 with no confidence.

    An upright page and one upside down look the same here, and so do both turned ones.
    """
    if height <= 0:
        return 0, 0.0
    across, down = line_energy(text, height), line_energy(np.ascontiguousarray(text.T), height)
    by_lines = 0 if across >= down else 90
    sure = abs(across - down) / (across + down) if across + down else 0.0
    alone = by_lines, sure if by_lines else 0.0
    boxes = parts.boxes
    glyph = (parts.area >= max(10, 0.8 * height)) & (boxes[:, 3] >= 0.45 * height) & (boxes[:, 3] <= 3 * height) & (boxes[:, 2] <= 8 * height)
    if glyph.sum() < LEAST_GLYPHS:
        return alone
    centres = parts.centres[glyph]
    if len(centres) > GLYPHS:
        centres = centres[np.random.default_rng(SEED).choice(len(centres), GLYPHS, replace=False)]
    who, other = k.nearest(centres, 3 * height)
    if len(who) < LEAST_NEIGHBOURS:
        return alone
    step = np.abs(centres[other] - centres[who])
    votes = int((step[:, 0] > step[:, 1]).sum())
    by_glyphs = 0 if 2 * votes >= len(who) else 90
    if by_glyphs != by_lines:
        return 0, 0.0
    return by_lines, max(sure, abs(2 * votes - len(who)) / len(who))


def tiles(x: np.ndarray, paper: np.ndarray, ink: np.ndarray, field: np.ndarray, scale: float) -> tuple[int, int, dict | None, float | None]:
    """Number of tiles with ink on paper, those of low contrast, and the worst one with its contrast."""
    h, w = x.shape[0] // TILES, x.shape[1] // TILES
    if min(h, w) < 12:
        return 0, 0, None, None
    inked = (x * ink)[:TILES * h, :TILES * w].reshape(TILES, h, TILES * w).sum(1, dtype=np.uint32).reshape(TILES, TILES, w).sum(2)
    grid = field[:TILES * h, :TILES * w].reshape(TILES, h, TILES * w)
    lowest, highest = grid.min(1).reshape(TILES, TILES, w).min(2), grid.max(1).reshape(TILES, TILES, w).max(2)
    found = []  # (row, column, least and largest contrast that its median can have, mean of the ink)
    for row in range(TILES):
        for column in range(TILES):
            at = np.s_[row * h:(row + 1) * h, column * w:(column + 1) * w]
            number = np.count_nonzero(ink[at])
            if number >= max(40, int(0.002 * h * w)) and np.count_nonzero(paper[at]) >= 0.5 * h * w:
                mean = float(inked[row, column]) / number
                found.append((row, column, float(lowest[row, column]) - mean, float(highest[row, column]) - mean, mean))
    if not found:
        return 0, 0, None, None
    least, low, worst = min(f[3] for f in found), 0, None
    for row, column, below, above, mean in found:
        if below <= least or below < LOW_TILE <= above:  # the median decides
            at = np.s_[row * h:(row + 1) * h, column * w:(column + 1) * w]
            below = above = (float(lowest[row, column]) if below == above else k.median(field[at][paper[at]])) - mean
            worst = (below, column, row) if worst is None or below < worst[0] else worst
        low += above < LOW_TILE
    return len(found), low, _region(worst[1] * w, worst[2] * h, w, h, scale), worst[0]


def fold(x: np.ndarray, paper: np.ndarray) -> int | None:
    """The column at which a wide image is two pages: the darkest valley of the columns' means in its middle, if deep enough."""
    h, w = x.shape
    if w < SPREAD_ASPECT * h or not paper.any():
        return None
    number = paper.sum(0)
    profile = np.where(paper, x, 0).sum(0) / np.maximum(1, number)
    usual = float(np.median(profile[number > 0]))
    profile = k.gaussian(np.where(number > 0, profile, usual)[None, :], 6.0)[0]
    low, high = int(w * SPREAD_BAND[0]), int(w * SPREAD_BAND[1])
    if low >= high:
        return None
    at = low + int(profile[low:high].argmin())
    return at if float(np.median(profile) - profile[at]) > VALLEY else None


def cut_off(text: np.ndarray, visible: list[str], height: float, scale: float, parts: k.Components) -> tuple[list[str], list[dict]]:
    """Sides on which writing runs out of the frame, and where: four writing-like parts or more at a side along 15 % of it, whose paper edge isn't seen."""
    h, w = text.shape
    band = max(2, int(min(h, w) * 0.006))
    height = height or max(4.0, 0.01 * min(h, w))
    x, y, wide, tall = parts.boxes.T
    like = (parts.area >= max(15.0, 0.4 * height * height)) & (tall >= 0.5 * height) & (tall <= 3.5 * height) & (wide >= 0.4 * height) & (wide <= 0.35 * w) & (tall <= 0.35 * h)
    names, regions = [], []
    for side, near, along, size in zip(SIDES, (y <= band, y + tall >= h - band, x <= band, x + wide >= w - band), (x, x, y, y), (w, w, h, h), strict=True):
        at = np.flatnonzero(like & near)
        if side not in visible and len(at) >= 4 and np.ptp(along[at]) / size >= 0.15:
            left, top = x[at].min(), y[at].min()
            names.append(side)
            regions.append(_region(left, top, max(1, (x + wide)[at].max() - left), max(1, (y + tall)[at].max() - top), scale))
    return names, regions


def perceptual_hash(x: np.ndarray) -> int:
    """63 bits: the low frequencies of a 32 x 32 cosine transform, above or below their median."""
    small = k.block_means(x, min(32, x.shape[0]), min(32, x.shape[1]))
    small = np.pad(small, ((0, 32 - small.shape[0]), (0, 32 - small.shape[1])), mode="edge")
    waves = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(32) + 1) / 64)
    low = (waves @ small @ waves.T).ravel()[1:]
    return sum(int(b) << i for i, b in enumerate(low > np.median(low)))


def measure(source: np.ndarray, wanted: frozenset[str] | None = None) -> dict:
    """All metrics of one page of 8-bit pixels, which are only read; or those of ``wanted`` alone, with what they are made of."""
    needs = lambda *names: wanted is None or not wanted.isdisjoint(names)
    x = shrunk(source)
    scale = source.shape[0] / x.shape[0]
    paper, share, visible = sheet(x)
    out = {"width": source.shape[1], "height": source.shape[0], "error": None, "doc_area_fraction": share, "visible_edges": visible}
    if wanted is not None and wanted <= out.keys():
        return out
    field = illumination(x)
    ink = k.majority((field - x > INK_STEP) & paper, 3)
    text = without_rules(ink)
    paper_size, ink_size = np.count_nonzero(paper), np.count_nonzero(ink)
    if needs("text_component_count", "est_text_height_px", "est_dpi", "skew_deg", "rotation_deg", "rotation_confidence", "cutoff_edges", "cutoff_regions"):
        parts = k.components(text)
        number, height = text_size(text, parts)
        out |= {"text_component_count": number, "est_text_height_px": height * scale, "est_dpi": height * scale * 9 if height * scale > 2 else None}
    if needs("median_luma", "paper_level", "ink_level", "ink_paper_contrast", "snr", "stroke_sharpness"):
        on_paper = paper if paper_size > 100 else np.ones(x.shape, bool)
        bright = k.median(field, None if paper_size == paper.size else paper) if paper_size > 100 else 255.0
        ink_mean = float((x * ink).sum(dtype=np.int64)) / max(1, ink_size)
        dark = ink_mean if ink_size > 50 else bright
        contrast = max(0.0, bright - dark)
        out |= {"median_luma": k.ranked(lambda v: np.count_nonzero((x <= v) & on_paper), np.count_nonzero(on_paper), 50, int(bright)), "paper_level": bright, "ink_level": dark, "ink_paper_contrast": contrast}
    if needs("glare_area_fraction", "shadow_area_fraction", "illumination_ratio", "shadow_regions", "glare_regions", "capture_profile"):
        found = light(field, paper, scale)
        out |= {"glare_area_fraction": found.glare, "shadow_area_fraction": found.shadow, "illumination_ratio": found.ratio, "shadow_regions": list(found.shadows), "glare_regions": list(found.glares)}
    if needs("likely_spread", "spread_split_x", "capture_profile"):
        split = fold(x, paper)
        out |= {"likely_spread": split is not None, "spread_split_x": None if split is None else int(split * scale)}
    if needs("capture_profile"):
        out["capture_profile"] = "photo" if share < 0.95 or split is not None or found.ratio > 1.6 else "flatbed"
    out |= {"ink_coverage": ink_size / max(1, paper_size), "text_ink_coverage": np.count_nonzero(text) / max(1, paper_size)}
    if needs("is_bitonal"):
        sampled = source[::max(1, source.shape[0] // 400), ::max(1, source.shape[1] // 400)]
        others = sampled[(sampled != sampled.min()) & (sampled != sampled.max())]
        out["is_bitonal"] = bool((others == others[:1]).all())
    if needs("skew_deg"):
        out["skew_deg"] = text_skew(text, number, height)
    if needs("rotation_deg", "rotation_confidence"):
        out["rotation_deg"], out["rotation_confidence"] = rotation(text, height, parts)
    if needs("tile_count", "low_contrast_tiles", "worst_tile", "worst_tile_contrast"):
        out["tile_count"], out["low_contrast_tiles"], out["worst_tile"], out["worst_tile_contrast"] = tiles(x, paper, ink, field, scale)
    if needs("cutoff_edges", "cutoff_regions"):
        out["cutoff_edges"], out["cutoff_regions"] = cut_off(text, visible, height, scale, parts)
    if needs("noise_sigma", "snr", "stroke_sharpness"):
        slope = k.slopes(x)
        sigma = noise(x, paper, slope)
        out |= {"noise_sigma": sigma, "snr": contrast / (sigma + 1e-6), "stroke_sharpness": sharpness(x, ink, ink_mean, bright, slope)}
    if needs("hash"):
        out["hash"] = perceptual_hash(x)
    return out


#: Images, and rows made of them, that a worker holds at a time.
IMAGES = 64
#: Memory that a worker keeps for the arrays of its images (glibc takes 32 MB at most).
HELD_BYTES = 31 << 20


def _rows_of(images: DataFrame, schema: str, of_image: Callable[..., list[dict]], beside: tuple[str, ...] = ()) -> DataFrame:
    """Rows that ``of_image`` makes of each ``page_id``, ``content`` and the columns ``beside`` them; the rows of some images are one batch."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.empty(HELD_BYTES, np.uint8)  # once freed, the allocator keeps so much: else each image's arrays are given back to the system, and cleared when they are taken again
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                rows = of_image(*[c[i].as_py() for c in batch.columns])
                held += rows
                size += sum(len(r.get("content") or b"") for r in rows)
                if len(held) >= IMAGES or size > 16 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return images.select(F.col("page_id").cast("long").alias("page_id"), "content", *beside).mapInArrow(run, schema)


def measured(images: DataFrame, only: tuple[str, ...] | None = None, beside: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of each image (page_id, content: a PGM) and the ``seconds`` it took. An image that can't be read is a row with ``error``; the others go on.

    With ``only`` these metrics alone are made and returned, with ``page_id``, ``error`` and ``seconds``. Columns of the images named in ``beside`` stay with their rows.
    """
    wanted = None if only is None else frozenset(only)
    known = [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(METRICS)]
    if unknown := (wanted or set()) - {n for n, _ in known}:
        raise ValueError(f"no such metrics: {sorted(unknown)}")
    fields = [(n, kind) for n, kind in known if wanted is None or n in wanted or n in ("page_id", "error", "seconds")] + [(c, images.schema[c].dataType.simpleString()) for c in beside]

    def row(page: int | None, data: bytes | None, *others: object) -> list[dict]:
        began = time.perf_counter()
        try:
            found = measure(read_pgm(data or b""), wanted)
        except ValueError as e:
            found = {"width": 0, "height": 0, "error": str(e)[:200]}
        return [{"page_id": page, **found, "seconds": time.perf_counter() - began, **dict(zip(beside, others, strict=True))}]

    return _rows_of(images, ", ".join(f"{n} {kind}" for n, kind in fields), row, beside)


#: The metrics that ``problem_regions`` reads.
REGIONS = ("shadow_regions", "glare_regions", "cutoff_regions", "cutoff_edges", "worst_tile", "worst_tile_contrast")


def split_spreads(images: DataFrame) -> DataFrame:
    """``page_id``, ``part``, ``x``, ``content``: each image as it is (part 0), or, where it shows two pages, its halves (parts 1 and 2, from column ``x`` on).

    An image that can't be read, or null, stays one row as it is.
    """

    def parts(page: int | None, data: bytes | None) -> list[dict]:
        try:
            source = read_pgm(data or b"")
        except ValueError:
            return [{"page_id": page, "part": 0, "x": 0, "content": data}]
        x = shrunk(source)
        at = fold(x, sheet(x)[0])
        if at is None:
            return [{"page_id": page, "part": 0, "x": 0, "content": data}]
        at = int(at * source.shape[0] / x.shape[0])
        return [{"page_id": page, "part": 1, "x": 0, "content": write_pgm(source[:, :at])}, {"page_id": page, "part": 2, "x": at, "content": write_pgm(source[:, at:])}]

    return _rows_of(images, "page_id long, part int, x int, content binary", parts)


def outlined(x: np.ndarray, box: dict) -> bool:
    """Do the first two and the last two rows of a box show an edge along more than half of its width? Boxes reach no further than the image; where nothing is left, no."""
    crop = x[max(box["y"], 0):max(box["y"] + box["h"], 0), max(box["x"], 0):max(box["x"] + box["w"], 0)]
    if not crop.size:
        return False
    found = k.edges(crop, 60, 160)
    return (np.count_nonzero(found[:2]) + np.count_nonzero(found[-2:])) / max(box["w"], 1) > 0.5


def _outlines(images: list[np.ndarray], wanted: list[tuple[int, dict]]) -> list[bool]:
    """``outlined`` of boxes (number of the image, box), most of them at once.

    The first two and last two rows of each box and their neighbours are laid side by side. Where the ridges above the low limit are too few, or those above
    the high limit enough, that is the answer; only boxes between, and those under four rows, are looked at whole.
    """
    found, strips, at = [False] * len(wanted), [], []
    for i, (n, box) in enumerate(wanted):
        x = images[n]
        crop = x[max(box["y"], 0):max(box["y"] + box["h"], 0), max(box["x"], 0):max(box["x"] + box["w"], 0)]
        if min(crop.shape) < 4:
            found[i] = outlined(x, box)
            continue
        strips += [crop[:4], crop[:-5:-1]]  # the lower border upside down, so that the border is the first row of both
        at.append(i)
    if not at:
        return found
    widths = np.array([s.shape[1] for s in strips])
    starts = np.cumsum(widths + 2) - widths - 1
    y = np.zeros((5, int((widths + 2).sum())), np.int16)
    wide = np.concatenate([part for s in strips for part in (s[:, 1:2], s, s[:, -2:-1])], 1)  # mirrored at both ends
    y[1:], y[0] = wide, wide[1]
    rows = y[:-2] + 2 * y[1:-1] + y[2:]
    across, down = np.zeros(rows.shape, np.int16), np.zeros(rows.shape, np.int16)
    across[:, 1:-1] = rows[:, 2:] - rows[:, :-2]
    down[:, 1:-1] = (y[:, :-2] + 2 * y[:, 1:-1] + y[:, 2:])[2:] - (y[:, :-2] + 2 * y[:, 1:-1] + y[:, 2:])[:-2]
    size = np.abs(across) + np.abs(down)
    size[:, starts - 1] = size[:, starts + widths] = 0  # nothing beyond a box
    size = np.concatenate([np.zeros((1, size.shape[1]), np.int16), size])
    here, gx, gy = size[1:3, 1:-1], across[:2, 1:-1].astype(np.float32), down[:2, 1:-1].astype(np.float32)
    # a strip upside down has its slopes turned, and of two equal ones the other is the ridge
    turned = np.repeat(np.arange(len(strips)) % 2 == 1, widths + 2)[1:-1]
    flat, steep = np.abs(gy) < 0.4142 * np.abs(gx), np.abs(gy) > 2.4142 * np.abs(gx)
    falling = (gx * gy) > 0
    near = lambda dy, dx: size[1 + dy:3 + dy, 1 + dx:size.shape[1] - 1 + dx]
    pick = lambda sign: np.where(flat, near(0, sign), np.where(steep, near(sign, 0), np.where(falling, near(sign, sign), near(sign, -sign))))
    before, after = pick(-1), pick(1)
    # upside down: down the page is up the strip; flat steps stay, all others change sides
    swap = turned & ~flat
    before, after = np.where(swap, after, before), np.where(swap, before, after)
    ridge = (here > before) & (here >= after)
    count = lambda limit: np.add.reduceat(np.pad((ridge & (here > limit)).sum(0), 1), starts - 1).reshape(-1, 2).sum(1)
    weak, strong = count(60), count(160)
    for i, few, many in zip(at, weak.tolist(), strong.tolist(), strict=True):
        least = max(wanted[i][1]["w"], 1) * 0.5
        found[i] = many > least or (few > least and outlined(images[wanted[i][0]], wanted[i][1]))
    return found


def with_frames(regions: DataFrame, images: DataFrame, read: Callable[[object], np.ndarray] = read_pgm) -> DataFrame:
    """``regions`` (page_id, x, y, w, h and others) with ``framed``: whether a region over 30 pixels wide and high has a hard outline on its page's image; null for smaller ones, and without an image that can be read.

    A page's regions travel to its image as one list and come back with it, so that each image is read once and no region is dealt again. The lists are the hashed side
    of the join; images are neither broadcast nor sorted. ``read`` makes pixels of ``content`` where the task that looks at them runs: what is large (a file, a sheet to
    be drawn) can be named in ``images`` instead of carried. The boxes of some images are looked at together.
    """
    lists = regions.groupBy("page_id").agg(F.collect_list(F.struct(*regions.columns)).alias("regions"))
    joined = lists.hint("shuffle_hash").join(images.select("page_id", "content"), "page_id", "left").select("content", "regions")
    kinds = StructType([joined.schema["regions"], StructField("framed", ArrayType(BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, IMAGES):
                content, lists = (c.slice(start, IMAGES) for c in batch.columns)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                boxes = {c: lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in "xywh"}
                page = np.repeat(np.arange(len(sizes)), sizes)
                large = np.flatnonzero((boxes["w"] > 30) & (boxes["h"] > 30) & np.isfinite(boxes["x"]) & np.isfinite(boxes["y"]))
                held, place = [], np.full(len(sizes), -1)
                for i in np.unique(page[large]).tolist():
                    try:
                        data = content[i].as_py()
                        if data is not None:
                            held.append(read(data))
                            place[i] = len(held) - 1
                    except ValueError:
                        continue
                large = large[place[page[large]] >= 0]
                x, y, w, h = (boxes[c][large].astype(int).tolist() for c in "xywh")
                found = np.zeros(len(page), bool)
                found[large] = _outlines(held, [(n, {"x": a, "y": b, "w": c, "h": d}) for n, a, b, c, d in zip(place[page[large]].tolist(), x, y, w, h, strict=True)])
                unknown = np.ones(len(page), bool)
                unknown[large] = False
                flags = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(found, pa.bool_(), mask=unknown))
                yield pa.RecordBatch.from_arrays([lists, flags], names=["regions", "framed"])

    row = lambda r, i: F.struct(*[r[c].alias(c) for c in regions.columns], F.get("framed", i).alias("framed"))
    return joined.mapInArrow(run, kinds).select(F.inline(F.transform("regions", row)))


def problem_regions(metrics: DataFrame) -> DataFrame:
    """``page_id``, ``kind`` (shadow, glare, cutoff, low_contrast), ``edge`` of a cut-off, ``x``, ``y``, ``w``, ``h``: a row for each region of ``measured``."""
    region = lambda kind, at, edge=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if edge is None else edge).alias("edge"), *[at[c].alias(c) for c in "xywh"])
    none = F.array().cast("array<struct<kind:string,edge:string,x:int,y:int,w:int,h:int>>")
    of = lambda kind: F.coalesce(F.transform(f"{kind}_regions", lambda r: region(kind, r)), none)
    cut = F.coalesce(F.transform("cutoff_regions", lambda r, i: region("cutoff", r, F.get("cutoff_edges", i))), none)
    worst = F.when(F.col("worst_tile_contrast") < LOW_TILE, F.array(region("low_contrast", F.col("worst_tile")))).otherwise(none)
    return metrics.select("page_id", F.explode(F.concat(of("shadow"), of("glare"), cut, worst)).alias("r")).select("page_id", "r.*")
