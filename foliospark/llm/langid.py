"""Language identification with string kernels.

A text is the set of its character n-grams (orders 1 to 3: a blended spectrum, by presence). The kernel of
two texts is the number of n-grams they share, divided by the geometric mean of their set sizes. Nyström landmarks
stand for the training set: one ridge regression per language is solved on kernels to the landmarks, and a batch
is scored by two matrix products, n-grams by landmarks and landmarks by languages. All n-grams of the landmarks take part; a text's
other n-grams count in its set's size.

Regression scores only compare the learned languages. Whether a text is in one of them at all is judged by how many of its letters
stand between neighbours as that language's training texts have them, against what held-out texts of the language reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import kept_rows, learned, small_batches, text_buffers, windows
from foliospark.llm.ngrams import WINDOW, NgramIndex, as_batch, code_points, distinct_codes, rolling

ORDERS = (1, 2, 3)
UNDETERMINED = "und"
#: A text fits a language with this part of what nearly all of its held-out texts reach.
MARGIN = 0.75
_LETTER = np.char.isalpha(np.arange(0x110000, dtype=np.uint32).view("U1"))


@dataclass
class LanguageModel:
    index: NgramIndex
    landmarks: np.ndarray  # features by landmarks
    weights: np.ndarray  # landmarks by languages
    languages: list[str]

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows by languages, in 0 to 1: the regression's -1 to 1, cut at its ends; 0 without an n-gram that a landmark holds."""
        kernel = kernels(*self.index.spectra(raw, offsets), self.landmarks)
        return np.where(kernel.any(1, keepdims=True), np.clip((kernel @ self.weights + 1) / 2, 0, 1), 0)


def kernels(presence: np.ndarray, sizes: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel values of rows to landmarks; a text without known n-grams is 0 to all."""
    parts = [presence[at:at + 32].astype(np.float32) @ landmarks for at in range(0, len(presence), 32)]
    shared = np.concatenate(parts) if parts else np.zeros((0, landmarks.shape[1]), np.float32)
    return shared / np.sqrt(np.maximum(sizes, 1))[:, None].astype(np.float32)


class TrigramIndex(NgramIndex):
    """Some thousand trigrams need a small table only."""

    BITS = 17


@dataclass
class Spelling:
    """Which letters stand between which neighbours in each language; all that is no letter counts as one sign."""

    index: TrigramIndex
    held: np.ndarray  # trigrams by languages: 1 where the language has it
    least: np.ndarray  # of each language, the share of known letters that a long text needs

    def known(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each row, and how many of them each language knows (rows by languages). Texts come with a blank at both ends."""
        rows, names = len(offsets) - 1, self.held.shape[1]
        letters, known = np.zeros(rows), np.zeros((rows, names))
        for row, codes in centred(raw, offsets):
            letters += np.bincount(row, minlength=rows)
            at, feature = self.index._find(codes)
            for n in range(names):
                known[:, n] += np.bincount(row[at], self.held[feature, n], rows)
        return letters, known

    def fits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows by languages: True where enough letters are known, less one standard deviation, so that short texts get the benefit of doubt."""
        letters, known = self.known(raw, offsets)
        n = letters[:, None]
        return known >= np.maximum(1, self.least * n - np.sqrt(n * self.least * (1 - self.least)))


def centred(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, code of the letter with its two neighbours) of the letters of a batch, in pieces."""
    for first, end, low, high in windows(offsets, WINDOW, 12):
        points, starts = code_points(raw[low:high], np.clip(offsets[first:end + 1] - low, 0, high - low))
        letter = _LETTER[points.astype(np.int64)]
        row = np.repeat(np.arange(first, end), np.diff(starts))
        for _, codes in rolling(np.where(letter, points, np.uint64(32)), (3,)):
            at = np.flatnonzero(letter[1:-1] & (row[2:] == row[:-2]))
            yield row[at], codes[at]


def spelling(texts: list[str], languages: list[str]) -> Spelling:
    """Learn from whole lower-cased texts; the least shares come from halves of the texts that are judged by the other half."""
    names = sorted(set(languages))
    own = [[np.unique(np.concatenate([c for _, c in centred(*as_batch([f" {t} "]))] or [np.zeros(0, np.uint64)])) for t, x in zip(texts, languages, strict=True) if x == n] for n in names]

    def common(sets: list[np.ndarray]) -> np.ndarray:
        codes, number = np.unique(np.concatenate(sets), return_counts=True)
        return codes[number >= (2 if len(sets) >= 50 else 1)]  # what a single one of many texts has may be noise

    least = np.full(len(names), MARGIN)
    for n, name in enumerate(names):
        mine, shares = [f" {t} " for t, x in zip(texts, languages, strict=True) if x == name], []
        for half in (0, 1) if len(mine) > 1 else ():
            codes = common(own[n][half::2])
            judge = Spelling(TrigramIndex(codes, (3,)), np.ones((len(codes), 1)), np.zeros(1))
            letters, known = judge.known(*as_batch(mine[1 - half::2]))
            shares.append((known[:, 0] / np.maximum(letters, 1))[letters > 0])
        held_out = np.concatenate(shares) if shares else np.zeros(0)
        if len(held_out):  # a few odd texts among them don't open the door
            least[n] *= max(np.quantile(held_out, 0.01), 0.8 * np.median(held_out))
    sets = [common(x) for x in own]
    codes = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    return Spelling(TrigramIndex(codes, (3,)), np.stack([np.isin(codes, x) for x in sets], 1).astype(float) if sets else np.zeros((0, 0)), least)


def fit(texts: list[str], languages: list[str], landmarks: int = 128, ridge: float = 1e-2, seed: int = 7) -> LanguageModel:
    """Learn from whole lower-cased texts. Landmarks are dealt evenly over the languages."""
    names = sorted(set(languages))
    if not names:
        return LanguageModel(NgramIndex(np.zeros(0, np.uint64), ORDERS), np.zeros((0, 1), np.float32), np.zeros((1, 1), np.float32), [UNDETERMINED])
    draw = np.random.default_rng(seed)
    by_name = {n: draw.permutation([i for i, x in enumerate(languages) if x == n]) for n in names}
    chosen = [i for n in names for i in by_name[n][: max(1, landmarks // len(names))]]
    index = NgramIndex(np.unique(np.concatenate([distinct_codes(texts[i], ORDERS) for i in chosen])), ORDERS)
    held, sizes = index.spectra(*as_batch([texts[i] for i in chosen]))
    marks = (held.astype(np.float32) / np.sqrt(np.maximum(sizes, 1))[:, None].astype(np.float32)).T.copy()
    rows = [kernels(*index.spectra(*as_batch(texts[at:at + 256])), marks) for at in range(0, len(texts), 256)]
    k = np.concatenate(rows).astype(np.float64)
    among = k[chosen]
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in languages])
    weight = np.array([len(languages) / (len(names) * languages.count(x)) for x in languages])[:, None]
    system = k.T @ (k * weight) + ridge * len(texts) / len(chosen) * among + 1e-6 * np.eye(len(chosen))
    return LanguageModel(index, marks, np.linalg.solve(system, k.T @ (y * weight)).astype(np.float32), names)


#: Languages that are learned at most, and texts that the driver gets about at most, where that leaves 8 of each language.
LANGUAGES, SAMPLE = 500, 20_000


def training_rows(documents: DataFrame, train: Column, limit: int, max_chars: int) -> DataFrame:
    """``doc_id``, lower-cased ``text`` and ``lang`` of about ``limit`` texts of each language, of ``max_chars`` characters at most: a bounded sample.

    Of a language that only has longer texts, their beginnings are taken. The ``LANGUAGES`` commonest values of ``lang`` are learned (ties: the first in
    order), and where these are many, fewer texts of each, so that about ``SAMPLE`` texts or 8 of each language are taken in all.
    """
    usable = documents.filter(train & F.col("lang").isNotNull() & (F.length("text") > 0))
    fits = F.length("text") <= max_chars
    counts = {r["lang"]: (r["n"], r["short"]) for r in usable.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(fits).alias("short")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    limit = min(limit, max(8, SAMPLE // max(1, len(counts))))
    if not counts:
        return usable.select("doc_id", "text", "lang").limit(0)
    share = F.create_map(*[F.lit(x) for n, (c, k) in sorted(counts.items()) for x in (n, min(1.0, limit / (k or c)))])
    only_long = [n for n, (_, k) in counts.items() if not k]
    return (usable.filter(fits | F.col("lang").isin(*only_long)).withColumn("text", F.left("text", F.lit(max_chars)))
            .filter(F.col("lang").isin(*counts))
            .filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
            .select("doc_id", F.lower("text").alias("text"), "lang"))


def training_sample(documents: DataFrame, train: Column, limit: int, max_chars: int) -> tuple[list[str], list[str]]:
    """``training_rows`` on the driver: texts and languages, by (doc_id, text)."""
    rows = training_rows(documents, train, limit, max_chars).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(documents: DataFrame, train: Column, sample: int = 400, max_chars: int = 20_000, **options) -> DataFrame:
    """Predict the language of each whole text: adds ``lang_pred`` and ``score`` (0 to 1) to ``doc_id``.

    ``train`` marks the rows whose ``lang`` may be learned; ``sample`` rows of each language are (see ``training_rows``). A null text and a text without a
    letter are ``und`` with score 0. A text without any learned n-gram gets some learned language with score 0: callers that want known languages only
    ask for a score (see ``in_known_language``). Where nothing can be learned, all are ``und``. Every row is answered once, repeated ids and null ids too.
    """
    spark = documents.sparkSession
    small_batches(spark, 128)
    model = learned(training_rows(documents, train, sample, max_chars), lambda texts, languages: fit(texts, languages, **options))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.value.languages, dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = model.value.scores(*text_buffers(batch.column(1)))
            best = scores.argmax(1)
            has_letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.where(has_letter, names[best], UNDETERMINED), pa.string()),
                 pa.array(np.where(has_letter, scores[np.arange(len(best)), best], 0.0), pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", F.lower("text").alias("text"), lettered().alias("lettered")).mapInArrow(score, "doc_id long, lang_pred string, score double")


def lettered() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def in_known_language(documents: DataFrame, train: Column, least: float = 0.3, sample: int = 400, max_chars: int = 20_000, **options) -> DataFrame:
    """The rows whose text is in a learned language; all columns stay. Texts without a letter go.

    Some language must score at least ``least`` and know as many of the text's letters as its spelling asks for (see ``Spelling``).
    """
    spark = documents.sparkSession
    small_batches(spark, 128)
    model = learned(training_rows(documents, train, sample, max_chars), lambda texts, languages: (fit(texts, languages, **options), spelling(texts, languages)))

    def keep(x: list[pa.Array]) -> np.ndarray:
        judge, letters = model.value
        scores = judge.scores(*text_buffers(x[0]))
        if not letters.least.size:
            return np.zeros(len(scores), bool)
        return ((scores >= least) & letters.fits(*text_buffers(x[1]))).any(1) & x[2].to_numpy(zero_copy_only=False).astype(bool)

    text = F.lower("text")
    return kept_rows(documents, [text, F.concat(F.lit(" "), text, F.lit(" ")), lettered()], keep)
