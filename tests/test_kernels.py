"""Kernels against naive forms on small images, and measurements of drawn pages of real size."""

import time

import numpy as np
import pytest

from foliospark.operators import kernels as k
from foliospark.operators import measure as m
from foliospark.operators import rules

# ---- naive forms ----------------------------------------------------------------------------------------------------------------------


def naive_extreme(x, shape, largest):
    out, reach = np.empty_like(x), len(shape) - 1
    for i in range(x.shape[0]):
        for j in range(x.shape[1]):
            parts = [x[i + d, max(0, j - shape[abs(d)] // 2):j + shape[abs(d)] // 2 + 1] for d in range(-reach, reach + 1) if 0 <= i + d < x.shape[0]]
            out[i, j] = max(p.max() for p in parts) if largest else min(p.min() for p in parts)
    return out


def flood(mask, diagonal):
    label, number = np.full(mask.shape, -1), 0
    for start in zip(*np.nonzero(mask)):
        if label[start] < 0:
            label[start], stack = number, [start]
            while stack:
                a, b = stack.pop()
                for da in (-1, 0, 1):
                    for db in (-1, 0, 1):
                        c = a + da, b + db
                        if (diagonal or not da or not db) and 0 <= c[0] < mask.shape[0] and 0 <= c[1] < mask.shape[1] and mask[c] and label[c] < 0:
                            label[c] = number
                            stack.append(c)
            number += 1
    return label, number


SHAPES = {"square": k.box(3, 3), "flat": k.box(1, 11), "tall": k.box(21, 1), "oblong": k.box(7, 5), "disc": k.ellipse(9), "large disc": k.ellipse(15)}


@pytest.mark.parametrize("shape", SHAPES)
def test_extremes_and_closings_equal_naive_ones(shape):
    draw, shape = np.random.default_rng(3), list(SHAPES[shape])
    for _ in range(12):
        x = draw.integers(0, 256, draw.integers(1, 26, 2)).astype(np.uint8)
        assert (k.dilated(x, shape) == naive_extreme(x, shape, True)).all() and (k.eroded(x, shape) == naive_extreme(x, shape, False)).all()
        assert (k.closed(x, shape) == naive_extreme(naive_extreme(x, shape, True), shape, False)).all()
        mask = x > 128
        assert (k.opened(mask, shape) == naive_extreme(naive_extreme(mask, shape, False), shape, True)).all()


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_equal_flooding(diagonal):
    draw = np.random.default_rng(5)
    for _ in range(1000):
        mask = draw.random(draw.integers(1, 18, 2)) < draw.random()
        label, number = flood(mask, diagonal)
        found = k.components(mask, diagonal)
        assert found.number == number
        at = np.flatnonzero(mask)
        pairs = set(zip(found.of_pixels(at).tolist(), label.ravel()[at].tolist()))
        assert len(pairs) == number
        border = k.border_parts(found)
        for mine, theirs in pairs:
            r, c = np.nonzero(label == theirs)
            assert found.boxes[mine].tolist() == [c.min(), r.min(), np.ptp(c) + 1, np.ptp(r) + 1] and found.area[mine] == len(r)
            assert np.allclose(found.centres[mine], [c.mean(), r.mean()])
            assert border[mine] == (r.min() == 0 or c.min() == 0 or r.max() == mask.shape[0] - 1 or c.max() == mask.shape[1] - 1)
            assert (found.mask(np.arange(number) == mine) == (label == theirs)).all()


def test_components_of_a_spiral():
    mask = np.zeros((201, 201), bool)
    y, x, dy, dx, size = 100, 100, 0, 1, 2
    while size < 190:
        for _ in range(2):
            for _ in range(size):
                mask[y, x] = True
                y, x = y + dy, x + dx
            dy, dx = dx, -dy
        size += 2
    assert k.components(mask, False).number == flood(mask, False)[1] == 1


def test_runs_majorities_and_blurs():
    draw = np.random.default_rng(6)
    for _ in range(50):
        mask = draw.random(draw.integers(1, 20, 2)) < 0.6
        around = np.pad(mask, 1, mode="edge").astype(int)
        assert (k.majority(mask, 3) == (sum(around[i:i + mask.shape[0], j:j + mask.shape[1]] for i in range(3) for j in range(3)) > 4)).all()
        least = int(draw.integers(1, 6))
        wanted = np.zeros_like(mask)
        for i, j in zip(*np.nonzero(mask)):
            a = b = j
            while a and mask[i, a - 1]:
                a -= 1
            while b + 1 < mask.shape[1] and mask[i, b + 1]:
                b += 1
            wanted[i, j] = b - a + 1 >= least
        assert (k.long_runs(mask, least) == wanted).all()
    x = np.add.outer(np.arange(300) % 200, np.arange(240)).astype(np.uint8)
    smooth = k.closed(x, k.ellipse(15))
    assert np.abs(k.smooth_field(smooth, 15.0) - k.gaussian(smooth, 15.0)).max() < 6 and np.allclose(k.gaussian(np.full((9, 5), 7.0), 2.0), 7)
    assert np.allclose(k.block_means(x, 300, 240), x)


def test_least_rectangles_and_neighbours():
    draw = np.random.default_rng(8)
    for _ in range(60):
        angle, long, short = draw.uniform(-89, 89), draw.uniform(20, 60), draw.uniform(1, 15)
        corners = np.array([[0, 0], [long, 0], [long, short], [0, short], [long / 2, short / 2]])
        turn = np.array([[np.cos(np.radians(angle)), np.sin(np.radians(angle))], [-np.sin(np.radians(angle)), np.cos(np.radians(angle))]])
        assert np.allclose(k.least_rectangle(corners @ turn), (long, short, angle))
        points = draw.uniform(0, 50, (int(draw.integers(0, 60)), 2))
        who, other = k.nearest(points, 6.0)
        d = ((points[:, None] - points[None]) ** 2).sum(2) + np.diag(np.full(len(points), np.inf)) if len(points) else np.zeros((0, 0))
        assert who.tolist() == [i for i in range(len(points)) if d[i].min() < 36] and other.tolist() == [int(d[i].argmin()) for i in who]
    assert k.least_rectangle(np.array([[3.0, 3.0], [3.0, 3.0]])) == (0.0, 0.0, 0.0)


def test_edges_need_a_strong_point():
    x = np.full((60, 60), 100, np.uint8)
    x[20:40, 20:40] = 115  # a step of 15: slopes of 60
    assert not k.edges(x, 40, 120).any() and k.edges(x, 40, 50).sum() > 60
    x[30:40, 20:40] = 200
    assert k.edges(x, 40, 120)[21:25, 19:22].any()  # the weak part hangs on the strong one


# ---- pages ----------------------------------------------------------------------------------------------------------------------------


def text_page(h=1754, w=1240, paper=246, ink=30, margin=100, glyph=20, pitch=34, seed=1):
    draw, x = np.random.default_rng(seed), np.full((h, w), paper, np.uint8)
    for top in range(margin, h - margin - glyph + 1, pitch):
        left = margin - 10
        while left < w - margin - 19:
            for _ in range(draw.integers(2, 9)):
                wide = int(draw.integers(14, 19))
                bar = top + int(draw.integers(0, glyph - 4))
                x[top:top + glyph, left:left + 5] = x[bar:bar + 4, left:left + wide] = x[top + glyph - 4:top + glyph, left:left + wide] = ink
                left += wide + 4
                if left > w - margin - 19:
                    break
            left += 14
    return x


def turned(x, degrees, fill=246):
    h, w = x.shape
    a, (yy, xx) = np.radians(degrees), np.mgrid[0:h, 0:w]
    across = np.rint(np.cos(a) * (xx - w / 2) + np.sin(a) * (yy - h / 2) + w / 2).astype(int)
    down = np.rint(np.cos(a) * (yy - h / 2) - np.sin(a) * (xx - w / 2) + h / 2).astype(int)
    inside = (down >= 0) & (down < h) & (across >= 0) & (across < w)
    out = np.full_like(x, fill)
    out[inside] = x[down[inside], across[inside]]
    return out


@pytest.fixture(scope="module")
def page():
    return text_page()


def test_an_ordinary_page(page):
    before = page.copy()
    found = m.measure(page)
    assert (page == before).all() and found == m.measure(page)
    assert found["doc_area_fraction"] == 1 and found["skew_deg"] == 0 and found["rotation_deg"] == 0 and found["rotation_confidence"] > 0.8 and 19 <= found["est_text_height_px"] <= 21
    assert not found["cutoff_edges"] and not found["likely_spread"] and not found["glare_regions"] and not found["shadow_regions"] and found["tile_count"] == 36 and found["low_contrast_tiles"] == 0
    assert found["capture_profile"] == "flatbed" and found["text_component_count"] > 1000 and 1.5 < found["stroke_sharpness"] < 6


@pytest.mark.parametrize("degrees", [-5, -3, -1.2, -0.4, 0.7, 2, 4, 5])
def test_skew(page, degrees):
    assert abs(m.measure(turned(page, degrees))["skew_deg"] - degrees) < 0.2


def test_skew_needs_parts_and_lines(page):
    few = page.copy()
    few[100 + 5 * 34:] = 246  # five lines
    assert m.measure(turned(few, 2))["skew_deg"] == 0
    assert m.measure(text_page(h=300, w=300, margin=130))["text_component_count"] < 25


@pytest.mark.parametrize("quarter", range(4))
def test_rotation(page, quarter):
    found = m.measure(np.rot90(page, quarter).copy())
    assert found["rotation_deg"] == (90 if quarter % 2 else 0) and found["rotation_confidence"] > 0.8


def test_a_page_without_direction_is_not_turned():
    draw, x = np.random.default_rng(4), np.full((900, 900), 246, np.uint8)
    for top in range(60, 830, 40):
        for left in range(60, 830, 40):
            x[top + draw.integers(0, 9):, left + draw.integers(0, 9):][:18, :18] = 30
    assert m.measure(x)["rotation_confidence"] < 0.5


def test_a_photo_on_a_dark_desk(page):
    desk = np.full((1754, 1240), 20, np.uint8)
    desk[120:1700, 90:1150] = page[120:1700, 90:1150]
    found = m.measure(desk)
    assert 0.74 < found["doc_area_fraction"] < 0.79 and found["visible_edges"] == ["top", "bottom", "left", "right"]
    assert found["capture_profile"] == "photo" and found["median_luma"] == 246
    black = m.measure(np.full((400, 300), 5, np.uint8))
    assert black["doc_area_fraction"] == 1  # no sheet found: the whole frame


def test_rules_go_and_text_stays(page):
    ruled = page.copy()
    for y in range(90, 1700, 170):
        ruled[y:y + 3, 60:1180] = 30
    for x in range(60, 1200, 280):
        ruled[90:1620, x:x + 3] = 30
    plain, found = m.measure(page), m.measure(ruled)
    assert found["ink_coverage"] > 1.1 * plain["ink_coverage"]
    assert abs(found["text_ink_coverage"] - plain["text_ink_coverage"]) < 0.06 * plain["text_ink_coverage"]
    third = np.zeros((900, 900), bool)
    third[100, 50:350] = third[300:312, 40:60] = True
    assert m.without_rules(third).sum() == 12 * 20


def test_shadow_and_glare_regions(page):
    dark = page.astype(float)
    dark[:700, :500] *= 0.55
    found = m.measure(dark.astype(np.uint8))
    (region,) = found["shadow_regions"]
    assert region["x"] == 0 and region["y"] == 0 and abs(region["w"] - 500) < 60 and abs(region["h"] - 700) < 80 and 0.12 < found["shadow_area_fraction"] < 0.2 and found["illumination_ratio"] > 1.5
    dull = np.minimum(page, 225)
    dull[800:1050, 700:950] = 255
    found = m.measure(dull)
    (region,) = found["glare_regions"]
    assert abs(region["x"] - 700) < 60 and abs(region["y"] - 800) < 80 and abs(region["w"] - 250) < 90 and found["glare_area_fraction"] > 0.01
    dull[600:, 300:] = 255  # over a fifth of the page is another sheet
    assert not m.measure(dull)["glare_regions"]
    many = np.minimum(page, 225)
    for i, size in enumerate((60, 90, 120, 150, 180)):
        many[200 + 250 * i:200 + 250 * i + size + 40, 500:540 + size] = 255
    assert len(m.measure(many)["glare_regions"]) <= 3


def test_cut_off_sides(page):
    cut = page[:, 88:].copy()  # lines begin at the left border
    found = m.measure(cut)
    assert found["cutoff_edges"] == ["left"] and found["cutoff_regions"][0]["x"] <= 5 and found["cutoff_regions"][0]["h"] > 1000
    assert m.measure(np.ascontiguousarray(np.rot90(cut, 2)))["cutoff_edges"] == ["right"]
    desk = np.pad(cut, ((0, 0), (60, 0)), constant_values=15)  # the paper's edge is seen: nothing is cut off
    assert m.measure(desk)["cutoff_edges"] == []


def test_noise_and_blur_are_ordered(page):
    noisy = [np.clip(page + np.random.default_rng(2).normal(0, s, page.shape), 0, 255).astype(np.uint8) for s in (2, 8)]
    sigma = [m.measure(x)["noise_sigma"] for x in noisy]
    assert 1 < sigma[0] < 3.5 and 5 < sigma[1] < 10
    sharp = [m.measure(np.clip(k.gaussian(page, s), 0, 255).astype(np.uint8))["stroke_sharpness"] for s in (0.5, 1.5, 2.5, 4.0)]
    assert sharp == sorted(sharp, reverse=True) and sharp[0] > 1.8 * sharp[-1]


def spread():
    x = np.concatenate([text_page(1200, 860), text_page(1200, 860, seed=2)], 1)
    x[:, 845:875] = 120
    return x


def test_spreads_become_two_rows(spark, page):
    found = m.measure(spread())
    assert found["likely_spread"] and abs(found["spread_split_x"] - 860) < 20 and found["capture_profile"] == "photo"
    assert not m.measure(np.concatenate([text_page(1200, 860), text_page(1200, 860, seed=2)], 1))["likely_spread"]
    small = text_page(500, 400)
    images = spark.createDataFrame([(1, m.write_pgm(spread())), (2, m.write_pgm(small)), (3, b"broken"), (4, None), (None, m.write_pgm(small))], "page_id long, content binary")
    rows = sorted(((r["page_id"], r["part"], r["x"], r["content"]) for r in m.split_spreads(images).collect()), key=str)
    assert [(r[0], r[1]) for r in rows] == [(1, 1), (1, 2), (2, 0), (3, 0), (4, 0), (None, 0)]
    left, right = (m.read_pgm(bytes(r[3])) for r in rows[:2])
    assert rows[1][2] == left.shape[1] and (np.concatenate([left, right], 1) == spread()).all() and bytes(rows[3][3] or b"") in (b"broken", b"")


def test_regions_as_rows(spark, page):
    dark = page.astype(float)
    dark[:700, :500] *= 0.55
    images = spark.createDataFrame([(1, m.write_pgm(dark.astype(np.uint8))), (2, m.write_pgm(page[:, 88:])), (3, b"x")], "page_id long, content binary")
    judged = rules.judge(m.measured(images))
    rows = m.problem_regions(judged).collect()
    assert {(r["page_id"], r["kind"], r["edge"]) for r in rows} == {(1, "shadow", None), (2, "cutoff", "left")}
    codes = {r["page_id"]: {f["code"] for f in r["findings"]} for r in judged.collect()}
    assert "SHADOW" in codes[1] and "SUSPECTED_CUTOFF" in codes[2] and codes[3] == set()


@pytest.mark.parametrize("shape", [(1, 1), (1, 40), (300, 3), (3, 300), (7, 7), (50, 50), (3000, 2)])
def test_odd_sizes(shape):
    for level in (0, 128, 255):
        m.measure(np.full(shape, level, np.uint8))
    m.measure(np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8))


def test_a_page_takes_less_than_a_second(page):
    m.measure(page)
    began = time.time()
    m.sheet(page)
    middle = time.time()
    m.measure(page)
    assert middle - began < 0.3 and time.time() - middle < 2


def test_outlines_at_once_equal_each_alone():
    draw = np.random.default_rng(8)
    images, boxes = [], []
    for n in range(60):
        x = np.full((200, 180), 240, np.uint8) if n % 3 else draw.integers(0, 256, (200, 180)).astype(np.uint8)
        for _ in range(6):
            b = {"x": int(draw.integers(-5, 120)), "y": int(draw.integers(-5, 150)), "w": int(draw.integers(1, 90)), "h": int(draw.integers(1, 90))}
            boxes.append((n, b))
            box = x[max(b["y"], 0):b["y"] + b["h"], max(b["x"], 0):b["x"] + b["w"]]
            level, part = int(draw.choice([60, 150, 205, 222])), int(draw.integers(0, max(1, box.shape[1])))
            box[:2, part:] = box[-2:, part // 2:] = level
            if n % 2:
                box[:, :2] = 60
        images.append(x)
    found = m._outlines(images, boxes)
    assert found == [m.outlined(images[n], b) for n, b in boxes] and 20 < sum(found) < 340
    assert m._outlines([], []) == []


def test_percentiles_medians_and_runs_equal_numpy():
    draw = np.random.default_rng(12)
    for n in range(60):
        x = draw.integers(0, int(draw.choice([2, 7, 256])), draw.integers(1, 200, 2)).astype(np.uint8)
        percent = float(draw.choice([0, 5, 50, 60, 85, 100]))
        assert np.isclose(k.percentile(x, percent), np.percentile(x, percent))
        assert k.ranked(lambda v: np.count_nonzero(x <= v), x.size, percent, int(draw.integers(0, 256))) == k.percentile(x, percent)
        field = (x + draw.random(x.shape) * (n % 3)).astype(np.float32)
        mask = draw.random(x.shape) < 0.7
        assert k.median(field) == float(np.median(field)) and (not mask.any() or k.median(field, mask) == float(np.median(field[mask])))
        runs = x > 0
        assert (k.long_runs(runs, 5, down=True) == k.long_runs(np.ascontiguousarray(runs.T), 5).T).all()
        assert (k.places(runs.ravel()) == np.flatnonzero(runs)).all()
        rows, cols = (int(draw.integers(1, size + 1)) for size in x.shape)
        at = [np.linspace(0, size, cells + 1).astype(int) for size, cells in zip(x.shape, (rows, cols))]
        assert np.allclose(k.block_means(x, rows, cols), [[x[a:b, c:d].mean() for c, d in zip(at[1], at[1][1:])] for a, b in zip(at[0], at[0][1:])])


def test_least_rectangles_of_all_components_at_once_equal_each_alone():
    draw = np.random.default_rng(13)
    for _ in range(40):
        parts = k.components(draw.random(draw.integers(1, 40, 2)) < draw.choice([0.3, 0.5, 0.7]))
        which = np.flatnonzero(parts.area >= 3)
        found = list(zip(*k.least_rectangles(*parts.borders(which))))
        assert len(found) == len(which)
        for i, rectangle in zip(which, found):
            at = parts.label == i
            ends = np.concatenate([np.stack([parts.begin[at], parts.row[at]], 1), np.stack([parts.end[at] - 1, parts.row[at]], 1)]).astype(float)
            sides = [(np.ptp(ends @ [np.cos(t), np.sin(t)]), np.ptp(ends @ [-np.sin(t), np.cos(t)])) for t in np.radians(np.arange(0, 90, 0.25))]
            assert rectangle == pytest.approx(k.least_rectangle(ends)) and rectangle[0] * rectangle[1] <= min(a * b for a, b in sides) + 1e-9


def test_paper_of_one_level_is_neither_blurred_nor_sorted(page, monkeypatch):
    whole = m.measure(page)
    for name in ("gaussian", "smooth_field", "least_rectangle"):
        monkeypatch.setattr(k, name, lambda *_: pytest.fail("a pass over the page that it doesn't need"))
    monkeypatch.setattr(np, "partition", lambda *_, **__: pytest.fail("a sort of the page"))
    assert m.measure(page) == whole


@pytest.mark.parametrize("level", [244, 130])
def test_illumination_around_dark_parts_equals_the_whole(page, level):
    x = np.minimum(page[:600, :500], level)
    x[150:260, 60:330] = 90
    size = max(15, min(x.shape) // 20 | 1)
    whole = k.smooth_field(k.closed(x, k.ellipse(size)), size / 4)
    assert np.abs(m.illumination(x) - whole).max() < 1e-4


def test_regions_alone_need_no_levels_spreads_or_slopes(page, monkeypatch):
    whole = m.measure(page[:, 88:])
    for module, name in ((m, "fold"), (k, "median"), (k, "slopes"), (m, "perceptual_hash"), (m, "rotation"), (m, "text_skew")):
        monkeypatch.setattr(module, name, lambda *_: pytest.fail("not asked for"))
    found = m.measure(page[:, 88:], frozenset(m.REGIONS))
    assert found["cutoff_edges"] == ["left"] and all(found[name] == whole[name] for name in m.REGIONS)


@pytest.mark.parametrize("name", ["capture_profile", "snr", "est_dpi", "spread_split_x", "stroke_sharpness", "text_ink_coverage", "worst_tile", "glare_regions", "rotation_confidence", "median_luma", "hash", "is_bitonal"])
def test_each_metric_alone_equals_that_of_all(page, name):
    assert m.measure(page, frozenset([name]))[name] == m.measure(page)[name]


def test_a_calibration_reads_what_it_measures_and_no_more(spark, page, monkeypatch):
    from foliospark.sources import scans

    whole = m.measure(page)
    monkeypatch.setattr(m, "perceptual_hash", lambda *_: pytest.fail("not asked for"))
    found = m.measure(page, frozenset(scans.READ))
    assert all(found[name] == whole[name] for name in scans.READ)
    images = spark.createDataFrame([(1, "a.pgm", m.write_pgm(page[:, 88:])), (2, "b.pgm", b"broken")], "page_id long, filename string, content binary")
    judged = rules.judge(m.measured(images)).orderBy("page_id").collect()
    report = scans.calibration(images).orderBy("page_id").collect()
    assert [(r["class"], r["score"], r["defects"], r["profile"]) for r in report] == [(r["overall"], r["score"], ",".join(sorted({f["code"] for f in r["findings"]})), r["capture_profile"]) for r in judged]
