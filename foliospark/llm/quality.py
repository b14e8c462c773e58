"""Document quality by supervised subword embeddings.

Each word, each pair of neighbouring words and each character 3- to 5-gram inside a word (with its edges marked) is hashed to a bucket that holds a learned vector. A
document is the mean of its vectors; a softmax layer gives the label. Trained by minibatch stochastic gradient descent in numpy.
Since the output layer is linear, scoring adds up each bucket's product with it, made once, instead of its vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from foliospark.llm.common import labelled_sample, small_batches, text_buffers, windows
from foliospark.llm.ngrams import WINDOW, as_batch, code_points, rolling

ORDERS = (3, 4, 5)
SPACE = 32
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def buckets(raw: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of each word and each character n-gram of a batch of UTF-8 rows.

    White space is the code points up to 32. An n-gram may begin with the space before a word and end with the one after it, but
    holds none inside. A word's code is the sum of its characters' codes by place; pairs of neighbouring words count as well.
    """
    shift = np.uint64(64 - bits)
    for first, end, low, high in windows(offsets, WINDOW, 32):
        points, starts = code_points(raw[low:high], np.clip(offsets[first:end + 1] - low, 0, high - low))
        if not len(points):
            continue
        space = points <= SPACE
        points = np.where(space, np.uint64(SPACE), points)
        before = np.zeros(len(points) + 1, np.int32)
        np.cumsum(space, out=before[1:])
        row_of = np.repeat(np.arange(first, end, dtype=np.int32), np.diff(starts))
        for n, codes in rolling(points, ORDERS):
            k = len(codes)
            at = np.flatnonzero((before[n - 1:n - 1 + k] == before[1:1 + k]) & (row_of[n - 1:] == row_of[:k]))
            yield row_of[at], ((codes[at] * _MIX) >> shift).astype(np.int64)
        begin = ~space
        begin[1:] &= space[:-1] | (row_of[1:] != row_of[:-1])
        at = np.flatnonzero(begin)
        if not len(at):
            continue
        place = np.arange(len(points), dtype=np.int64)
        place[at[0]:] -= np.repeat(at, np.diff(np.append(at, len(points))))
        letter = points * _MIX + place.astype(np.uint64) * _PLACE
        letter ^= letter >> np.uint64(29)
        letter *= _MIX
        letter[space] = 0
        word, row = np.add.reduceat(letter, at), row_of[at]
        yield row, ((word * _MIX) >> shift).astype(np.int64)
        pair = np.flatnonzero(row[1:] == row[:-1])  # a word and the next; all words that follow themselves share a bucket
        yield row[pair], (((word[pair] ^ word[pair + 1]) * _PLACE + _MIX) >> shift).astype(np.int64)


@dataclass
class QualityModel:
    margins: np.ndarray  # of each bucket: its vector times the difference of the two output rows
    bias: float
    bits: int

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        total, number = np.zeros(rows), np.zeros(rows)
        for row, bucket in buckets(raw, offsets, self.bits):
            total += np.bincount(row, self.margins[bucket], rows)
            number += np.bincount(row, minlength=rows)
        margin = total / np.maximum(number, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def fit(texts: list[str], labels: np.ndarray, bits: int = 16, width: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> QualityModel:
    """Train on whole texts; both labels count alike, however many rows they have."""
    n1, n0 = float(labels.sum()), float((1 - labels).sum())
    if not n1 or not n0:
        return QualityModel(np.zeros(1 << bits, np.float32), 0.0, bits)
    docs = []
    for at in range(0, len(texts), 64):
        part = texts[at:at + 64]
        found = list(buckets(*as_batch(part), bits))
        row, bucket = np.concatenate([x[0] for x in found] or [np.zeros(0, np.int64)]), np.concatenate([x[1] for x in found] or [np.zeros(0, np.int64)])
        for i in range(len(part)):
            b, c = np.unique(bucket[row == i], return_counts=True)
            docs.append((b.astype(np.int32), (c / max(1, c.sum())).astype(np.float32)))
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / width, 1 / width, (1 << bits, width)).astype(np.float32)
    out, bias = np.zeros((2, width), np.float32), np.zeros(2, np.float32)
    weight = np.where(labels == 1, len(labels) / (2 * n1), len(labels) / (2 * n0))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in draw.permutation(len(docs)):
            b, c = docs[i]
            step = np.float32(rate * (1 - done / steps) * weight[i])
            done += 1
            hidden = c @ vectors[b] if len(b) else np.zeros(width, np.float32)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            vectors[b] -= (step * len(b) ** 0.5) * c[:, None] * (p @ out)[None, :]
            out -= step * np.outer(p, hidden)
            bias -= np.float32(0.1) * step * p
    return QualityModel((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]), bits)


def score(documents: DataFrame, labels: DataFrame, train: Column, label: str = "quality", sample: int = 1500, **options) -> DataFrame:
    """Score each whole text: ``doc_id``, ``score`` (0 to 1, higher: label 1 likelier), ``predicted`` (1 from 0.5 on).

    Learned from about ``sample`` labelled rows of each label among those that ``train`` marks. Null and empty texts
    get the score of the bias alone. Every row is answered once, repeated and null ids too.
    """
    spark = documents.sparkSession
    small_batches(spark, 128)
    texts, y = labelled_sample(documents, labels, label, train, sample, max_chars=20_000)
    model = spark.sparkContext.broadcast(fit(texts, y, **options))
    del texts

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = model.value.scores(*text_buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return documents.select("doc_id", "text").mapInArrow(apply, "doc_id long, score double, predicted int")
