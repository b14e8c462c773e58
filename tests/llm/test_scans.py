"""License scans, hard negatives, importance resampling: against plain versions, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import licenses, negatives, resample
from foliospark.llm.ngrams import as_batch

DOCS = "doc_id long, text string, lang string, score double, rank long, spans string, row int, n_words int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, 7, "clash", 1, 2) for i, t in rows], DOCS)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


# ---- licenses -------------------------------------------------------------------------------------------------------------------------


def longest_match(seen, texts):
    """For each word, how long the longest run is that ends there and stands in some text."""
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    return [max((n for n in range(1, i + 2) if tuple(seen[i + 1 - n:i + 1]) in runs), default=0) for i in range(len(seen))]


@pytest.mark.parametrize("seed", range(12))
def test_matching_statistics_equal_all_runs(seed):
    draw = random.Random(seed)
    letters = "abcd"[: draw.randint(2, 4)]
    texts = [[draw.choice(letters) for _ in range(draw.randint(2, 12))] for _ in range(draw.randint(1, 6))]
    phrases = [i for i, t in enumerate(texts) if draw.random() < 0.5]
    automaton = licenses.Automaton(texts, phrases)
    assert len(automaton.places) <= 2 * sum(map(len, texts)) + 1
    rows = [[draw.choice(letters + "z") for _ in range(draw.randint(0, 40))] for _ in range(8)]
    raw, offsets = as_batch([" ".join(r) for r in rows])
    starts, ends, before = licenses.words(raw, offsets, licenses.ALPHANUMERIC)
    at, length, state = automaton.statistics(raw, starts, ends, before)
    got = np.zeros(before[-1], int)
    got[at] = length
    wanted = [x for r in rows for x in longest_match(r, texts)]
    assert got.tolist() == [x if x > 1 else 0 for x in wanted]
    flat = [(r, i) for r in range(len(rows)) for i in range(len(rows[r]))]
    for i, n, s in zip(at.tolist(), length.tolist(), state.tolist()):
        r, end = flat[i][0], flat[i][1] + 1
        run = rows[r][end - n:end]
        assert automaton.places[s] == sorted((t, e) for t, x in enumerate(texts) for e in range(n, len(x) + 1) if x[e - n:e] == run)
        assert sorted(p for p, size in automaton.phrases[s] if size <= n) == [p for p in phrases if rows[r][max(0, end - len(texts[p])):end] == texts[p]]


def plain_places(text):
    w = plain_words(text)
    return [(label, i) for i in range(len(w)) for label, phrase in licenses.PHRASES if w[i:i + len(phrase.split())] == phrase.split()]


ODD = ["", None, "cc", "CC BY", "cc-by cc_by", "by cc by cc by", "All rights\n\nreserved. ALL RIGHTS RESERVED", "ccby", "é cc by é", "general public license general public license", "all rights cc by reserved",
       "GNU General Public License, version 3", "x " * 50_000 + "cc by " + "general public " * 20_000 + "license"]


def test_phrases_equal_a_plain_search(spark):
    draw = random.Random(4)
    pool = "cc by general public license all rights reserved the of x".split()
    rows = list(enumerate(ODD + [" ".join(draw.choices(pool, k=draw.randint(0, 60))) for _ in range(150)]))
    rows += [(3, "CC BY"), (3, "CC BY"), (None, "cc by"), (None, None)]
    found = licenses.digest(licenses.scan(docs(spark, rows))).collect()
    wanted = Counter()
    for i, t in rows:
        p = plain_places(t)
        at = [x for _, x in p]
        wanted[i, len(plain_words(t)), len(p), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in p}))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found) == wanted
    for r in found:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["n_base"] == 0 or r["score"] == 1)
    assert licenses.scan(docs(spark, [])).count() == 0


def test_spans_of_changed_passages(spark):
    label, passage = next((n, t) for n, t in licenses.TEMPLATES if n == "bsd")
    w = passage.split()
    changed = w[:20] + ["ACME", "corp"] + w[22:40] + w[44:]  # two words replaced, four left out
    other = "wholly different words about rivers and stones that no licence has ".split() * 3
    rows = [(1, " ".join(other + changed + other)), (2, " ".join(other)), (3, " ".join(w[:12])), (4, ", ".join(w).upper()), (5, " ".join(w + other + w))]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    (span,) = got[1]["spans"]
    assert (span["label"], span["first_word"], span["end_word"]) == (label, len(other), len(other) + len(changed))
    assert 0.85 < span["share"] < 1 and span["covered"] == span["share"] * len(w)
    assert not got[2]["spans"] and not got[3]["spans"]
    assert [(s["label"], s["share"]) for s in got[4]["spans"]] == [("bsd", 1.0)]
    assert [(s["first_word"], s["end_word"]) for s in got[5]["spans"]] == [(0, len(w)), (len(w) + len(other), 2 * len(w) + len(other))]
    with pytest.raises(ValueError):
        licenses.scan(docs(spark, rows), templates=(("x", "..."),)).collect()


# ---- hard negatives -------------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, row int, v string, score long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "clash", 2) for i, v, y in rows], VECTORS)


def brute_negatives(rows, every, positives=5, k=10):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, v, y in ok:
        if a % every:
            continue
        s = sorted((-sum(p * q for p, q in zip(v, w)), i, z) for i, w, z in ok if len(w) == len(v))
        near = [(i, -t) for t, i, z in s if z == y and i != a][:positives]
        for i, p in near:
            far = [(j, -t) for t, j, z in s if z != y and 30 * p <= -100 * t <= 90 * p][:k]
            out.update((a, i, r, j, p, t) for r, (j, t) in enumerate(far, 1))
    return out


def found_negatives(df):
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.mark.parametrize("block", [None, 7])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.7 * draw.normal(size=8)).tolist(), int(draw.integers(4))) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8, i % 2) for i in range(40)]  # ties
    rows += [(2000, None, 1), (2010, [1.0] * 8, None), (2020, [float("nan")] * 8, 1), (2030, [None] * 8, 1), (None, [1.0] * 8, 1), (2040, [], 0), (2050, [], 0), (2060, [1.0] * 3, 0), (2070, [2.0] * 3, 1), (2080, [1.0] * 3, 0)]
    if block:
        monkeypatch.setattr(negatives, "BLOCK", block)
        monkeypatch.setattr(negatives, "SORTED", 3 * block)
        monkeypatch.setattr(negatives, "SLICE", 700)  # so that there are many slices
    found = found_negatives(negatives.mine(vectors(spark, rows).repartition(5), anchors=F.col("vec_id") % 10 == 0))
    assert found == brute_negatives(rows, 10) and len(found) > 500


def test_hard_negatives_of_repeated_and_of_no_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.5], 0), (1, [0.9, 0.1], 0), (1, [0.9, 0.1], 0), (2, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, [0.4, 0.2], 2)]
    assert found_negatives(negatives.mine(vectors(spark, rows), anchors=F.col("vec_id") == 0)) == brute_negatives(rows, 5)
    assert negatives.mine(vectors(spark, []), anchors=F.lit(True)).count() == 0
    assert negatives.mine(vectors(spark, rows), anchors=F.lit(None).cast("boolean")).count() == 0


def test_a_task_keeps_the_best_only():
    draw, best = np.random.default_rng(1), negatives.Best(3)
    key, ids, score = draw.integers(5, size=900), np.arange(900), draw.integers(20, size=900)
    for i in range(0, 900, 30):
        best.add(key[i:i + 30], ids[i:i + 30], score[i:i + 30])
        best.rows()
    got = sorted(zip(*(x.tolist() for x in best.rows())))
    wanted = sorted(x for k in range(5) for x in sorted(((k, i, s) for a, i, s in zip(key.tolist(), ids.tolist(), score.tolist()) if a == k), key=lambda x: (-x[2], x[1]))[:3])
    assert got == wanted


# ---- resampling -----------------------------------------------------------------------------------------------------------------------


def plain_features(text, n):
    w = plain_words(text)
    return [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute_resample(rows, target, n, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source, wanted = Counter(), Counter()
    for _, t in rows:
        source.update(map(bucket, plain_features(t, n)))
    for t in target:
        wanted.update(map(bucket, plain_features(t, n)))
    s, t = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets))))
    out = []
    for i, text in rows:
        f = plain_features(text, n)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(f), weight, score, i is not None and len(plain_words(text)) >= least))
    drawn = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0]))
    drawn = drawn[: len(drawn) * percent // 100]
    ranks = {}
    for r, x in enumerate(drawn, 1):
        ranks.setdefault(x, []).append(r)
    return Counter((*x[:4], ranks[x].pop() if ranks.get(x) else None) for x in out)


@pytest.mark.parametrize("n, buckets, small", [(1, 10_000, False), (3, 50, False), (2, 1000, True)])
def test_resampling_equals_a_plain_version(spark, monkeypatch, n, buckets, small):
    draw = random.Random(n)
    pool = [f"w{i}" for i in range(60)] + ["Été", "中文", "A", "b-c", "x1"]
    rows = [(i, " ".join(draw.choices(pool, k=draw.choice([0, 1, 5, 19, 20, 21, 60])))) for i in range(160)]
    rows += [(None, "w1 " * 30), (500, None), (501, ""), (502, "...")] + [(503, "w1 w2 " * 15)] * 9 + [(504, " ".join(draw.choices(pool, k=60_000)))]
    target = [" ".join(draw.choices(pool[:20], k=30)) for _ in range(9)] + [None, ""]
    if small:
        monkeypatch.setattr(resample, "TURN", 300)
        monkeypatch.setattr(resample, "HELD_BYTES", 50)
    found = resample.resample(docs(spark, rows).repartition(7), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), n=n, buckets=buckets, percent=30, least_words=20)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect()) == brute_resample(rows, target, n, buckets, 30, 20)


def test_resampling_of_nothing(spark):
    empty, target = docs(spark, []), docs(spark, [(1, "a b")])
    assert resample.resample(empty, target).count() == 0
    assert [tuple(r)[1:4] for r in resample.resample(target, empty).collect()] == [(2, 2, math.floor(1000 * math.log(10_002 / 20_000)))]
    with pytest.raises(ValueError):
        resample.resample(empty, target, n=0)


def test_each_distinct_tuple_is_hashed_once(monkeypatch):
    calls = []
    monkeypatch.setattr(resample.zlib, "crc32", lambda b: calls.append(b) or zlib_crc32(b))
    known = resample.Dictionary(100)
    for _ in range(3):
        list(resample.features(*as_batch(["a b a b c", "b a", "", "c c c"]), 2, known))
    assert Counter(calls) == Counter([b"a", b"b", b"c", b"a b", b"b a", b"b c", b"c c"])


zlib_crc32 = zlib.crc32
