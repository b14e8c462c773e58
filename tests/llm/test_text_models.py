"""Language, toxicity and quality classifiers; token encoding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import langid, quality, toxicity, unigram
from foliospark.llm.common import crc_part, labelled_sample
from foliospark.llm.ngrams import NgramIndex, as_batch, distinct_codes, rolling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, extra int"
EN = "the cat and the dog went to the house in the morning and they saw the river "
DE = "der hund und die katze gingen am morgen zum haus und sie sahen den fluss dort "


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "clash", 1) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, (EN if i % 2 else DE) * (1 + i % 4) + str(i), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !!", "en"), (103, EN, None), (104, DE * 3000, None), (None, EN, None), (103, EN, None)]
    return docs(spark, rows)


def test_language_of_every_row(corpus):
    found = langid.identify(corpus, train=crc_part("doc_id", 4) != 2).collect()
    assert len(found) == corpus.count()
    by = {r["doc_id"]: r for r in found}
    assert [by[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3
    assert by[103]["lang_pred"] == "en" and by[104]["lang_pred"] == "de" and by[None]["lang_pred"] == "en"
    assert all(by[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60))
    assert all(0 <= r["score"] <= 1 for r in found)


def test_models_are_learned_off_the_driver(spark, corpus, monkeypatch):
    """The texts of a sample don't reach the driver, and the model is the one that the driver would have learned of them."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    texts, languages = langid.training_sample(corpus.filter("doc_id < 60"), F.lit(True), 400, 20_000)
    marked = labelled_sample(corpus.select("doc_id", F.lower("text").alias("text")), labels, "toxic", F.lit(True), 1200, 20_000)
    seen, kind = [], type(corpus)
    monkeypatch.setattr(kind, "collect", lambda self, f=kind.collect: seen.append(self.columns) or f(self))
    assert seen == [] and corpus.select("doc_id").collect() and seen.pop() == ["doc_id"]
    model = toxicity._trained(corpus, labels, F.lit(True), "toxic", 1200, {}).value
    kept = langid.in_known_language(corpus.filter("doc_id < 60"), F.lit(True))
    judge = langid.learned(langid.training_rows(corpus.filter("doc_id < 60"), F.lit(True), 400, 20_000), langid.fit).value
    assert not any("text" in columns for columns in seen)
    monkeypatch.undo()
    assert kept.count() == 60
    here = toxicity.fit(*marked)
    assert len(model.index) and (model.index.codes == here.index.codes).all() and (model.weights == here.weights).all() and (model.bias, (model.index.table == here.index.table).all()) == (here.bias, True)
    there = langid.fit(texts, languages)
    assert judge.languages == there.languages and (judge.landmarks == there.landmarks).all() and np.allclose(judge.weights, there.weights, atol=1e-3)  # BLAS sums in another order with more threads


def test_languages_without_training_rows(spark, corpus):
    found = langid.identify(corpus, train=F.lit(False)).collect()
    assert {r["lang_pred"] for r in found} == {"und"}
    assert langid.identify(corpus.limit(0), train=F.lit(True)).count() == 0


def test_language_filter_keeps_columns(corpus):
    kept = langid.in_known_language(corpus, train=crc_part("doc_id", 4) != 2)
    assert kept.columns == corpus.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {100, 101, 102} and {103, 104, None} <= ids


UNLEARNED = [
    "人人生而自由,在尊严和权利上一律平等。", "你好。", "ყველა ადამიანი იბადება თავისუფალი და თანასწორი", "Все люди рождаются свободными и равными в своем достоинстве", "да.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.", "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti.",
    "xqzt bvkrw plmqz wrtgh zxcvb nmkjh qwrtp sdfgh", "zzzzzzzzzz"]


def test_texts_of_unlearned_languages_go(spark, sf_dir):
    learned = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    short = learned.filter("length(text) between 1 and 400").select(F.col("doc_id") + 100_000, F.substring_index("text", " ", 2), "lang", "source", "n_chars")
    foreign = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in enumerate(UNLEARNED)], learned.schema)
    kept = {r["doc_id"] for r in langid.in_known_language(learned.union(short).union(foreign), train=F.col("doc_id").between(1000, 99_999)).select("doc_id").collect()}
    assert not [t for i, t in enumerate(UNLEARNED) if i in kept]
    assert learned.count() + short.count() == len(kept)


def test_unknown_texts_score_nothing(corpus, spark):
    foreign = docs(spark, [(900, "ყველაადამიანი", None)])
    found = langid.identify(corpus.union(foreign), train=crc_part("doc_id", 4) != 2).filter("doc_id = 900").first()
    assert found["lang_pred"] in {r["lang"] for r in corpus.collect()} and found["score"] == 0  # it has letters, so some language is named


def test_the_sample_of_a_dirty_language_column_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 5)
    monkeypatch.setattr(langid, "SAMPLE", 60)
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), "id")).otherwise(F.concat(F.lit("l"), F.col("id") % 4)).alias("lang"))
    texts, languages = langid.training_sample(table, F.lit(True), 400, 20_000)
    assert {"l0", "l1", "l2", "l3"} < set(languages) and len(set(languages)) <= 5 and 20 < len(texts) < 120


def test_kernel_values_match_set_intersections():
    """With the options of the query: against sets of all n-grams, of landmarks' texts and of others."""
    texts = [EN, DE, EN[::-1] * 3, "zebra", "日本語の文"]
    model = langid.fit(texts * 3, ["x", "y", "z", "u", "v"] * 3)
    marks = [set(distinct_codes(t, langid.ORDERS).tolist()) for t in texts * 3]
    asked = [*texts, "the zebra und 日本", EN + "äöü with more of its own: 0123456789"]
    k = langid.kernels(*model.index.spectra(*as_batch(asked)), model.landmarks)
    for row, t in zip(k, asked, strict=True):
        own = set(distinct_codes(t, langid.ORDERS).tolist())
        assert np.allclose(sorted(row), sorted(len(own & m) / np.sqrt(len(own) * len(m)) for m in marks), atol=0.01)
    scores = model.scores(*as_batch(asked))
    assert np.allclose(scores, np.clip((k @ model.weights + 1) / 2, 0, 1), atol=1e-5) and scores[:5].argmax(1).tolist() == [model.languages.index(x) for x in "xyzuv"]


def test_language_with_long_texts_only(spark):
    table = docs(spark, [(i, EN * 3 + str(i), "en") for i in range(10)] + [(i, DE * 40 + str(i), "de") for i in range(10, 14)])
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(table, train=F.lit(True), max_chars=1000).collect()}
    assert found == {i: "en" if i < 10 else "de" for i in range(14)}


def test_ngram_index_is_exact():
    text = "äöü hello wörld " * 50
    codes = distinct_codes(text, (2, 3))
    index = NgramIndex(codes[::2], (2, 3))
    assert index.presence(*as_batch([text]))[0].all()
    assert index.presence(*as_batch(["", "q"])).sum() == 0
    both = index.presence(*as_batch([text[:7], text[7:20]]))
    for t, row in zip((text[:7], text[7:20]), both, strict=True):
        assert (row == np.isin(index.codes, distinct_codes(t, (2, 3)))).all()


def test_long_text_in_windows(monkeypatch):
    text = "abc def " * 400 + "needle" + " ghi" * 300
    index = NgramIndex(distinct_codes("needle", (5,)), (5,))
    monkeypatch.setattr("foliospark.llm.ngrams.WINDOW", 64)
    assert index.presence(*as_batch(["x", text, ""])).tolist() == [[0, 0], [1, 1], [0, 0]]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_filters(spark):
    rows = [(i, EN * 2 + ("you idiot moron " if i % 3 == 0 else "") + f"w{i % 7}", "en") for i in range(120)]
    rows += [(500, None, "en"), (501, "", "en"), (502, EN * 2000 + "you idiot moron", "en"), (None, EN, "en")]
    table = docs(spark, rows)
    marks = labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(120)] + [(3, None, None), (None, 1, 1), (0, 1, 0)])
    found = {r["doc_id"]: r for r in toxicity.score(table, marks, train=crc_part("doc_id", 5) != 0).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["predicted"] == (i % 3 == 0) for i in range(120))
    assert found[500]["score"] == found[501]["score"] < 0.5 and found[502]["predicted"] == 1
    kept = toxicity.without_toxic(table, marks, train=F.lit(True))
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(120) if i % 3} | {500, 501, None}


def test_toxicity_matches_plain_sums(monkeypatch):
    draw = np.random.default_rng(4)
    vocabulary = ["idiot", "moron", "the", "house", "Öl", "日本", "hate", "river", "morning"]
    texts = [" ".join(draw.choice(vocabulary, draw.integers(1, 30))) for _ in range(80)]
    model = toxicity.fit(texts, np.array([float("idiot" in t or "hate" in t) for t in texts]))
    weight = dict(zip(model.index.codes.tolist(), model.weights.tolist(), strict=True))
    asked = [*texts, "", "x", "idiot " * 3000 + "river"]
    monkeypatch.setattr("foliospark.llm.ngrams.WINDOW", 4096)
    for t, s in zip(asked, model.scores(*as_batch(asked)), strict=True):
        margin = model.bias + sum(weight.get(c, 0.0) for c in distinct_codes(t, toxicity.ORDERS).tolist())
        assert s == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-4)


def plain_buckets(text, bits):
    """Buckets of a text, one by one, as the module's docstrings define them."""
    mask = 2**64 - 1
    step, spread, mix_, place = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x9E3779B97F4A7C15
    points = [max(32, ord(c)) for c in text]
    out, words, at = [], [], None
    for n in quality.ORDERS:
        for i in range(len(points) - n + 1):
            if 32 not in points[i + 1:i + n - 1]:
                code = 0
                for p in points[i:i + n]:
                    code = (code * step + (p + 1) * spread) & mask
                out.append(((code + n) * mix_ & mask) >> (64 - bits))
    for i, p in enumerate([*points, 32]):
        if p == 32:
            at = None
            continue
        if at is None:
            at = i
            words.append(0)
        letter = (p * mix_ + (i - at) * place) & mask
        words[-1] = (words[-1] + (letter ^ letter >> 29) * mix_) & mask
    return out + [(w * mix_ & mask) >> (64 - bits) for w in words] + [(((a ^ b) * place + mix_) & mask) >> (64 - bits) for a, b in zip(words, words[1:])]


def test_quality_matches_plain_means():
    draw = np.random.default_rng(6)
    texts = [" ".join(draw.choice(["good", "words", "bad###", "Öl", "日本語", "a\n\tb"], draw.integers(1, 25))) for _ in range(60)]
    model = quality.fit(texts, np.array([float("bad" not in t) for t in texts]))
    asked = [*texts, "", " ", "q", "long words here " * 20_000]
    for t, s in zip(asked, model.scores(*as_batch(asked)), strict=True):
        found = plain_buckets(t, model.bits)
        margin = model.bias + (np.mean(model.margins[found]) if found else 0.0)
        assert s == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-4)


def test_classifiers_of_empty_tables(spark, corpus):
    none = corpus.limit(0)
    assert toxicity.score(none, labels(spark, [(1, 1, 1)]), train=F.lit(True)).count() == 0
    assert quality.score(none, labels(spark, [(1, 1, 1)]), train=F.lit(True)).count() == 0
    assert toxicity.without_toxic(none, labels(spark, []), train=F.lit(True)).columns == corpus.columns


def test_classifiers_without_labels(spark, corpus):
    none = labels(spark, [])
    assert {r["predicted"] for r in toxicity.score(corpus, none, train=F.lit(True)).collect()} == {0}
    assert quality.score(corpus, none, train=F.lit(True)).count() == corpus.count()


def test_quality_learns_repetition_and_noise(spark):
    good = [(i, EN + f"w{i % 11} " + DE, "en") for i in range(80)]
    bad = [(i, ("###$$ " + EN.replace(" ", "%%% ")) if i % 2 else f"Word{i} " * 60, "en") for i in range(100, 180)]
    table, marks = docs(spark, good + bad + [(900, None, "en"), (901, "", "en")]), labels(spark, [(i, int(i < 100), 0) for i, _, _ in good + bad])
    found = {r["doc_id"]: r for r in quality.score(table, marks, train=crc_part("doc_id", 3) != 1).collect()}
    assert np.mean([found[i]["predicted"] == int(i < 100) for i, _, _ in good + bad]) > 0.97
    assert found[900]["score"] == found[901]["score"]


def test_rolling_orders():
    points = np.array([1, 2, 1, 2], np.uint64)
    by = dict(rolling(points, (1, 2)))
    assert by[1][0] == by[1][2] and by[2][0] == by[2][2] != by[2][1]


# ---- tokens


@pytest.fixture(scope="module")
def model():
    return unigram.Unigram.load()


ODD = ["", "   ", " a", "a  b   c ", "日本語 é \U0001f600\x00x", "\n\n", "x" * 300, "tab\there\nnext line", "Hello world, hello."]


def test_round_trip(model):
    raw, offsets = as_batch(ODD)
    again, places = model.decode(*model.encode(raw, offsets))
    assert [bytes(again[a:b]).decode() for a, b in zip(places[:-1], places[1:])] == ODD


def test_segmentation_is_the_best(model):
    """Scores equal those of a plain Viterbi over whole texts; the library's own unigram encoder agrees."""
    score = dict(zip(model.ids.tolist(), model.scores.tolist()))
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    proto = pb.ModelProto()
    with open(unigram.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        if i in score:
            p.score, p.type = score[i], 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    raw, offsets = as_batch(ODD)
    ids, begin = model.encode(raw, offsets)
    lowest = min(score.values()) - unigram.UNKNOWN_PENALTY
    total = lambda x: sum(score.get(i, lowest) for i in x)
    for t, a, b in zip(ODD, begin[:-1], begin[1:]):
        theirs, ours = library.encode(t), ids[a:b].tolist()
        assert theirs == ours or total(theirs) == pytest.approx(total(ours), abs=1e-3), t


def test_turns_of_bytes_change_nothing(model):
    texts = [*ODD, "words of a  long text, with\nlines and  spaces " * 300, "日本語 " * 500, "nospace" * 400, ""]
    raw, offsets = as_batch(texts)
    whole, begin = model.encode(raw, offsets)
    for limit in (40, 700, 5000):
        ids, at = model.encode_all(raw, offsets, limit)
        assert (ids == whole).all() and (at == begin).all()
    assert model.encode_all(*as_batch([]))[1].tolist() == [0] and model.encode_all(*as_batch(["", ""]))[1].tolist() == [0, 0, 0]


def test_long_texts_round_trip(spark):
    table = docs(spark, [(1, "some words, and more of them. " * 200_000, "en"), (2, "x" * 100_000, "en")])
    assert all(r["round_trip"] for r in unigram.encode(table).collect())


def test_encode_table(spark, model):
    table = docs(spark, [(i, t, "en") for i, t in enumerate(ODD)] + [(50, None, "en"), (None, "same", "en"), (1, "same", "en")])
    rows = unigram.encode(table).collect()
    assert len(rows) == len(ODD) + 3 and all(r["round_trip"] for r in rows)
    assert next(r for r in rows if r["doc_id"] == 50)["ids"] == []
    texts = {r["doc_id"]: r["text"] for r in unigram.decode(unigram.encode(docs(spark, [(i, t, "en") for i, t in enumerate(ODD)]))).collect()}
    assert texts == dict(enumerate(ODD))
    assert unigram.encode(table.limit(0)).count() == 0


def test_double_array_finds_all_and_only_keys():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\xfe", b"ba"]
    trie = unigram.DoubleArray(keys)
    for key in [*keys, b"c", b"abd", b"\xff"]:
        s = np.zeros(1, np.int64)
        for c in key:
            s = trie.step(s, np.array([c])) if s[0] >= 0 else s
        assert (trie.value[s[0]] if s[0] >= 0 else -1) == (keys.index(key) if key in keys else -1)
