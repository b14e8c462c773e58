"""Shingles, the Jaccard join, decontamination, top-k search, components, helpers, pipeline."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import components, decontaminate, jaccard, topk
from foliospark.llm.common import IdFilter, attach_groups, kept_rows, windows
from foliospark.llm.ngrams import as_batch
from foliospark.llm.shingles import ALPHANUMERIC, shingles, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, bits int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in rows], DOCS)


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


TEXTS = ["", "a", "A b\tc", "a b c d", "a b c d e", "a b c d a b c d a b c d", "x  y\n\nz\x0b\x0cq é É", "word " * 40, " lead and trail "]


@pytest.mark.parametrize("k", [1, 4, 5])
def test_shingles_match_plain_sets(k):
    codes, begin = shingles(*as_batch(TEXTS), k)
    sets = [set(codes[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:])]
    plain = [shingle_set(t, k) for t in TEXTS]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert len(a & b) == len(plain[i] & plain[j])


def test_words_in_small_segments(monkeypatch):
    monkeypatch.setattr("foliospark.llm.shingles.SEGMENT", 8)
    whole, _ = shingles(*as_batch(TEXTS), 4)
    monkeypatch.undo()
    assert (whole == shingles(*as_batch(TEXTS), 4)[0]).all()
    starts, ends, before = words(*as_batch(["a-b", "", "c"]), ALPHANUMERIC)
    assert before.tolist() == [0, 2, 2, 3] and (ends - starts).tolist() == [1, 1, 1]


def test_windows_cover_everything():
    offsets = np.array([0, 3, 3, 40, 45, 60])
    seen = np.zeros(60, int)
    for first, end, low, high in windows(offsets, 10, 2):
        assert high - low <= 15 and offsets[first] <= low and high <= offsets[end]
        seen[low:high] += 1
    assert (seen > 0).all()


def brute_components(rows, k, percent):
    ids = sorted({i for i, _ in rows})
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    least = {i: i for i in ids}

    def find(a):
        while least[a] != a:
            a = least[a]
        return a

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                least[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def near_copies(draw, n=90):
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [draw.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(n):
        if i and draw.random() < 0.6:
            w = list(draw.choice(rows)[1].split())
            for _ in range(draw.randint(0, 3)):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
        else:
            w = [draw.choice(vocabulary) for _ in range(draw.choice([2, 3, 9, 40, 120]))] + (passage if draw.random() < 0.5 else [])
        rows.append((i * 3 % 271, " ".join(w)))
    return rows


@pytest.mark.parametrize("k,percent,block,sets", [(4, 85, 2048, 2048), (5, 80, 4, 5), (4, 85, 4, 3)])
def test_classes_match_brute_force(spark, monkeypatch, k, percent, block, sets):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # with 4, lists are large, and clusters are cut into blocks
    monkeypatch.setattr(jaccard, "SETS", sets)
    monkeypatch.setattr(jaccard, "POSITIONS", sets)
    rows = near_copies(random.Random(k)) + [(900, ""), (901, None), (902, "A b"), (903, "a B"), (904, "w1 " * 20_000), (905, "w1 " * 20_001)]
    rows = list(dict(rows).items())
    found = jaccard.similar_documents(docs(spark, rows).repartition(3), k, percent).collect()
    assert len(found) == len(rows)
    expected = brute_components(rows, k, percent)
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(shingle_set(t, k)) for i, t in rows}


def test_classes_of_odd_tables(spark):
    assert jaccard.similar_documents(docs(spark, [])).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e"), (3, None), (3, None)]
    found = sorted((tuple(r) for r in jaccard.similar_documents(docs(spark, rows)).collect()), key=str)
    assert found == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 2, 1), (3, 0, 3), (3, 0, 3)], key=str)


def test_one_of_each_keeps_columns_and_clean_rows(spark):
    rows = [(5, "a b c d e f g"), (4, "a b c d e f g"), (9, "q r s t u v w"), (9, "q r s t u v w"), (None, "a b c d e f g"), (7, None), (8, "")]
    table = docs(spark, rows)
    kept = jaccard.one_of_each(table)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([4, 9, None, 7, 8], key=str)


A, B, C = "a b c d e f g", "q r s t u v w", "h i j k l m n"


def test_ids_with_several_texts_lose_no_clean_one(spark):
    rows = [(3, A), (5, A), (5, B), (5, B), (7, C), (7, ""), (7, None), (None, A), (9, "x y"), (2, "X y z"), (2, "other words")]
    kept = jaccard.one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    found = sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str)
    assert found == sorted([(3, A), (5, B), (7, C), (7, ""), (None, A), (9, "x y"), (2, "X y z"), (2, "other words")], key=str)
    hot = [(1, " ".join(f"h{i}n{j}" for j in range(9))) for i in range(40)] + [(i, B) for i in range(2, 6)]
    assert jaccard.one_of_each(docs(spark, hot)).count() == 41


def test_classes_link_through_ids_with_several_texts(spark):
    rows = [(3, A), (5, A), (5, B), (8, B), (8, ""), (8, B), (9, C), (1, None), (None, C)]
    rows += [(1000 + i % 40, t) for i, (_, t) in enumerate(near_copies(random.Random(3), 70))]
    found = jaccard.similar_documents(docs(spark, rows).repartition(3), 4, 85).collect()
    expected = brute_components([r for r in rows if r[0]], 4, 85)
    assert [expected[i] for i in (5, 8, 9)] == [3, 3, 9] and len(found) == len(rows)
    assert all(r["component_id"] == expected.get(r["doc_id"]) for r in found)
    assert sorted(r["n_shingles"] for r in found) == sorted(len(shingle_set(t, 4)) for _, t in rows)


def test_bitmaps_bound_differences(monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_BITS", 64)
    draw = random.Random(5)
    sets = [set(draw.sample(range(3000), n)) for n in (3, 40, 90, 180, 300, 700)]
    sets += [s ^ set(draw.sample(range(3000), 5)) for s in sets]
    made = []
    for s in sets:
        width = max(64, 1 << (len(s) // 2).bit_length())
        made.append(np.packbits(np.bincount(np.array(sorted(s)) & (width - 1), minlength=width) & 1).tobytes())
    bits = jaccard.Bitmaps(pa.array(made, pa.binary()))
    x, y = map(np.array, zip(*[(i, j) for i in range(12) for j in range(12)], strict=True))
    apart = bits.apart(x, y)
    assert all(d <= len(sets[i] ^ sets[j]) for d, i, j in zip(apart, x, y, strict=True))
    assert apart[5 * 12 + 4] > 100 and all(apart[i * 12 + i] == 0 for i in range(12))


def test_answers_are_derived_exactly():
    draw = random.Random(8)
    base = [draw.randrange(10**6) for _ in range(60)]
    sets = [np.unique(np.array([x if draw.random() > i % 7 / 20 else draw.randrange(10**6) for x in base], np.uint64)) for i in range(80)]
    answers = jaccard.Answers(sets, 80)
    plain = [set(s.tolist()) for s in sets]
    for x in range(80):
        assert answers.overlaps(x).tolist() == [len(plain[x] & p) for p in plain]
    assert 1 < len(answers.kept) < 80
    joined = jaccard.classes(sets, 80, np.arange(80))
    for a in range(80):
        assert joined[a] <= a and all(joined[a] == joined[b] for b in range(80) if 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b]))


@pytest.mark.parametrize("changes, alone", [(1, (0.0, 0.2)), (3, (0.3, 0.7))])
def test_a_large_group_of_near_copies_gives_rows_in_proportion(spark, monkeypatch, changes, alone):
    """Candidates, links and sets dealt in every class step grow with a group, not with its square, and the classes are those of brute force."""
    made, sizes = {}, (200, 800)
    candidates, classes = jaccard._candidates, jaccard._classes

    def counted(rows, *x):
        made["dealt"] = made.get("dealt", 0) + rows.count()
        made["calls"] = made.get("calls", 0) + 1
        return classes(rows, *x)

    monkeypatch.setattr(jaccard, "_candidates", lambda *x: made.setdefault("candidates", candidates(*x)))
    monkeypatch.setattr(jaccard, "_classes", counted)
    monkeypatch.setattr(jaccard, "SETS", 50)
    rows = {}
    for size in sizes:
        draw = random.Random(size)
        made.clear()
        base = [f"b{i}" for i in range(60)]
        texts = []
        for _ in range(size):
            w = list(base)
            for _ in range(draw.randint(0, changes)):
                w[draw.randrange(60)] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(w))
        table = docs(spark, list(enumerate(texts)))
        found = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(table, 5, 80).collect()}
        if size == 200:
            assert found == brute_components(list(enumerate(texts)), 5, 80)
        assert alone[0] * size <= len(set(found.values())) < alone[1] * size  # with 3 changes about half stay alone, candidates of each other
        assert made["calls"] == 3 or size < 800  # a cluster of several blocks
        rows[size] = made["candidates"].count(), made["dealt"]
    print(rows)
    # each set travels at most once in each of the three steps, and the few that visit or ask a few times more
    assert all(candidates <= size and dealt <= 4 * size for size, (candidates, dealt) in rows.items()), rows


def test_forest_spans():
    draw = np.random.default_rng(2)
    a, b = draw.integers(0, 60, 150), draw.integers(0, 60, 150)
    kept = jaccard._forest(a, b)
    whole, part = jaccard._least(a, b, 60), jaccard._least(a[kept], b[kept], 60)
    assert (whole == part).all() and len(kept) == 60 - len(set(whole.tolist()))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_attach_groups_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr("foliospark.llm.common.HOT_SHARE", 10)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else (None if i % 4 else f"k{i % 8}")) for i in range(100)], "i long, k string")
    groups = spark.createDataFrame([("hot", 50, "H"), ("k0", 13, "Z")], "k string, n long, v string")
    found = attach_groups(rows, groups, "k", "n", 100).collect()
    assert sorted((r["i"], r["k"], r["v"]) for r in found if r["k"]) == [(i, "hot" if i % 2 else f"k{i % 8}", "H" if i % 2 else "Z" if i % 8 == 0 else None) for i in range(100) if i % 2 or i % 4 == 0]
    assert len(found) == 100


def test_id_filter_holds_all_ids(spark):
    ids = spark.createDataFrame([(i,) for i in range(0, 5000, 3)] + [(None,)], "id long")
    f = IdFilter(ids, "id")
    kept = {r["id"] for r in kept_rows(spark.range(5000), [IdFilter.slot(F.col("id"))], lambda x: f.may_hold(x[0])).collect()}
    assert set(range(0, 5000, 3)) <= kept and len(kept) < 1700


# ---- decontamination


def test_leaks_match_brute_force(spark):
    draw = random.Random(4)
    vocabulary = [f"t{i}" for i in range(3000)]
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(i, some(n)) for i, n in enumerate([5, 6, 9, 14, 20, 33, 50, 70, 100, 3])]
    rows = [(i, some(draw.choice([3, 30, 300, 5000]))) for i in range(60)]
    for i, (_, w) in enumerate(rows[:40]):
        _, x = items[i % 10]
        x = list(x)
        if i >= 20 and len(x) > 40:
            x[-1] = "changed"
        w[len(w) // 2:len(w) // 2] = x
    rows += [(70, None), (71, ["the"]), (72, items[9][1]), (72, items[9][1])]
    table = docs(spark, [(i, w if w is None else (" ".join(w)).upper() + ".") for i, w in rows])
    benchmark = spark.createDataFrame([(i, ", ".join(w)) for i, w in items] + [(80, None), (81, ""), (82, "--")], "item_id long, text string")

    def plain(text):
        w = re.findall(r"[a-z0-9]+", (text or "").lower())
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    expected = []
    for r in table.select("doc_id", "text").collect():
        for b in benchmark.collect():
            s, own = plain(b["text"]), plain(r["text"])
            if s and len(s & own) >= 0.8 * len(s):
                expected.append((r["doc_id"], b["item_id"], len(s), len(s & own)))
    found = [tuple(r)[:4] for r in decontaminate.leaks(table, benchmark).collect()]
    assert sorted(found) == sorted(expected) and len(expected) > 30
    assert sorted(tuple(r)[:4] for r in decontaminate.leaks(table, benchmark, block_chars=200).collect()) == sorted(expected)
    clean = decontaminate.without_leaks(table, benchmark, block_chars=500)
    assert clean.columns == table.columns and {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {e[0] for e in expected}
    assert decontaminate.leaks(table, benchmark.limit(0)).count() == 0 and decontaminate.leaks(table.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_short_items_are_never_missed(threshold):
    draw = random.Random(9)
    some = lambda n: [f"t{draw.randrange(5000)}" for _ in range(n)]
    items = [some(5 + i % 8) for i in range(1600)]
    rows = []
    for i in range(0, 1600, 8):  # each document holds eight items among other words, every other item with its last word changed
        w = some(20)
        for j, x in enumerate(items[i:i + 8]):
            w += (x[:-1] + ["changed"] if j % 2 else x) + some(30)
        rows.append(w)
    index = decontaminate.index_items(list(range(1600)), [" ".join(x) for x in items], 5, threshold)
    found = {(r, i) for r, i, _, _ in decontaminate._hits(index, pa.array([" ".join(w) for w in rows]), 5, threshold)}
    sets = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    own = [sets(w) for w in rows]
    expected = {(i // 8, i) for i, x in enumerate(items) if len(sets(x) & own[i // 8]) >= threshold * len(sets(x))}
    assert len(expected) >= 800 and expected <= found


def test_scattered_items_are_never_missed():
    draw = random.Random(12)
    some = lambda n: [f"t{draw.randrange(9000)}" for _ in range(n)]
    items = [some(n) for n in range(5, 105)]
    rows = []
    for x in items:  # the item in pieces of a third with two thousand words between, now and then with a word changed
        w, cut = some(50), max(1, len(x) // 3)
        for a in range(0, len(x), cut):
            w += x[a:a + cut] + some(2000)
        rows += [w, some(300) + [v if draw.random() > 0.02 else "changed" for v in x] + some(300)]
    index = decontaminate.index_items(list(range(100)), [" ".join(x) for x in items], 5)
    found = {(r, i) for r, i, _, _ in decontaminate._hits(index, pa.array([" ".join(w) for w in rows]), 5, 0.8)}
    sets = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    own = [sets(w) for w in rows]
    expected = {(r, i) for i, x in enumerate(items) for r in range(len(rows)) if len(sets(x) & own[r]) >= 0.8 * len(sets(x))}
    assert found == expected and sum(r % 2 == 0 for r, _ in expected) > 25
    for threshold in (0.3, 0.5, 1.0):
        some_index = decontaminate.index_items(list(range(100)), [" ".join(x) for x in items], 5, threshold)
        hits = {(r, i) for r, i, _, _ in decontaminate._hits(some_index, pa.array([" ".join(w) for w in rows]), 5, threshold)}
        assert hits == {(r, i) for i, x in enumerate(items) for r in range(len(rows)) if len(sets(x) & own[r]) >= threshold * len(sets(x))}


# ---- top-k


def brute_top(rows, k, every):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(object)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted(((-int(sum(q * x)), j) for j, x in ok if j != i and len(x) == len(q)))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return out


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 64)
    monkeypatch.setattr(topk, "BLOCK", 8)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(4, 6))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 4] + draw.normal(size=6) * 0.1]) for i in range(300)]
    rows += [(400 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]
    rows += [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (600, [1.0, 2.0]), (601, [2.0, 1.0]), (700, [])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    found = sorted(tuple(r) for r in topk.top_k(table, F.col("vec_id") % 10 == 0, k=5).collect())
    assert found == sorted(brute_top(rows, 5, 10))
    assert topk.top_k(table.limit(0), F.lit(True)).count() == 0 and topk.top_k(table, F.lit(False)).count() == 0


def test_top_k_skips_blocks_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 7)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(30, 8)) * 3
    rows = [(i, [float(np.float32(x)) for x in centres[i % 30] + draw.normal(size=8) * 0.05]) for i in range(900)]
    rows += [(40, rows[41][1]), (40, rows[42][1])]  # an id that repeats asks once, for all its rows
    found, pairs = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=3)
    blocks = -(-900 // 16)
    assert pairs.count() < 0.3 * 45 * blocks and pairs.count() == pairs.distinct().count()
    plain = []
    for i in sorted({i for i, _ in rows if i % 20 == 0}):
        asked = [np.floor(1024 * np.array(x)).astype(np.int64) for j, x in rows if j == i]
        best = sorted((-int((q * np.floor(1024 * np.array(x)).astype(np.int64)).sum()), j) for q in asked for j, x in rows if j != i)[:3]
        plain += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, found.collect())) == plain


def test_large_products_stay_exact():
    q, x = np.array([[2**30, 3]]), np.array([[2**30, 5], [2**31, 7]])
    assert topk.scores(q, x).tolist() == [[2**60 + 15, 2**61 + 21]]


# ---- pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language id", "near duplicates", "benchmark decontamination", "token encoding"]
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, before = documents, documents.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == documents.columns, name
        now = kept.count()
        assert 0.5 * before < now <= before, name
        before = now
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == ids


def plain_chain(spark, sf_dir):
    """The pipeline's rows told one by one: the classifiers' models judge single texts, everything else is Python sets. The ids that stay, sorted."""
    from foliospark.llm import langid, toxicity
    from foliospark.llm.common import crc_part

    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    alone = lambda scores, text: scores(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
    rows_of = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    documents = table("documents")
    toxic = toxicity._trained(documents, table("labels"), crc_part("doc_id", 5) != 0, "toxic", 1200, {}).value
    calm = [(i, t) for i, t in rows_of(documents) if alone(toxic.scores, (t or "").lower())[0] < 0.5]
    languages = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    first = spark.createDataFrame([(i, t, languages[i]) for i, t in calm], "doc_id long, text string, lang string")
    sample = langid.training_sample(first, crc_part("doc_id", 4) != 2, 400, 20_000)
    judge, letters = langid.fit(*sample), langid.spelling(*sample)
    known = [(i, t) for i, t in calm if re.search(r"[^\W\d_]", t or "") and ((alone(judge.scores, t.lower()) >= 0.3) & alone(letters.fits, f" {t.lower()} ")).any()]
    sets = [(i, t, shingle_set(t, 5)) for i, t in known]
    group = list(range(len(sets)))
    for x, (i, _, a) in enumerate(sets):
        for y, (j, _, b) in enumerate(sets[:x]):
            if None not in (i, j) and a and b and 100 * len(a & b) >= 80 * len(a | b):
                group = [group[y] if g == group[x] else g for g in group]
    single = [min((sets[x] for x in range(len(sets)) if group[x] == g), key=lambda s: s[0] is not None and s[0])[:2] for g in set(group)]

    def items(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    tests = [s for s in (items(r["text"]) for r in table("benchmark").collect()) if s]
    return [("calm", len(calm)), ("known", len(known)), ("single", len(single))], sorted((i for i, t in single if not any(10 * len(s & items(t)) >= 8 * len(s) for s in tests)), key=str)


def test_pipeline_matches_a_plain_chain(spark, sf_dir, tmp_path):
    import corpus_pipeline

    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(given.collect(), key=lambda r: r["doc_id"])
    item = max((r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()), key=len)
    clean = next(r["text"] for r in rows if len(r["text"]) > 300)
    made = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows]
    made += [(10_001, None, "en", "s"), (10_002, "", "en", "s"), (10_003, " 12 ... ", None, "s"), (None, rows[3]["text"], "en", "s"), (None, None, None, None), (10_004, f"{clean} {item} {clean[::-1]}", "en", "s"),
             (10_005, clean, "en", None), (10_006, f"{clean} more", "en", "s"), (10_006, f"{clean} more", "en", "s"), (10_007, " ".join(r["text"] for r in rows[:60] if r["lang"] == rows[0]["lang"]), rows[0]["lang"], "s")]
    awkward = spark.createDataFrame([(*r, len(r[1] or ""), 0.5, -1, "clash") for r in made], "doc_id long, text string, lang string, source string, n_chars long, score double, _node int, component_id string")
    for name, df in (("documents", awkward), ("labels", spark.read.parquet(f"{sf_dir}/labels.parquet")), ("benchmark", spark.read.parquet(f"{sf_dir}/benchmark.parquet"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    sizes, expected = plain_chain(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == expected, sizes
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    assert 10_004 not in expected and 10_006 not in expected and [n for _, n in sizes] == sorted((n for _, n in sizes), reverse=True)
    empty = tmp_path / "none"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
