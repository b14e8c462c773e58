"""Toxicity scores from character n-grams scaled by naive Bayes log-count ratios.

Of each labelled text the presence of n-grams (orders 2 to 5) counts. Each n-gram gets the log ratio of its smoothed shares among
toxic and other texts; a logistic regression is then trained on presence times ratio, with an L1 penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import kept_rows, labelled_rows, learned, small_batches, text_buffers
from foliospark.llm.ngrams import NgramIndex, as_batch, distinct_codes

ORDERS = (2, 3, 4, 5)


@dataclass
class ToxicityModel:
    index: NgramIndex
    weights: np.ndarray
    bias: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margin = self.index.presence(raw, offsets).astype(np.float32) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -50, 50)))


def fit(texts: list[str], labels: np.ndarray, features: int = 6144, smooth: float = 1.0, l1: float = 3e-3, steps: int = 150) -> ToxicityModel:
    """Learn from whole lower-cased texts; both labels count alike, however many rows they have.

    ``features`` n-grams with the strongest evidence (log ratio over its standard error) are kept.
    """
    empty = ToxicityModel(NgramIndex(np.zeros(0, np.uint64), ORDERS), np.zeros(0, np.float32), -4.0)
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    if not n1 or not n0:
        return empty
    sets = [distinct_codes(t, ORDERS) for t in texts]

    def counted(of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate(of), return_counts=True)

    codes = np.unique(np.concatenate(sets))
    counts = np.zeros((2, len(codes)))
    for y in (0, 1):
        c, k = counted([s for s, label in zip(sets, labels, strict=True) if label == y])
        counts[y, np.searchsorted(codes, c)] = k
    ratio = np.log((counts[1] + smooth) / (n1 + 2 * smooth)) - np.log((counts[0] + smooth) / (n0 + 2 * smooth))
    error = np.sqrt(1 / (counts[1] + smooth) + 1 / (counts[0] + smooth))
    best = np.argsort(-np.abs(ratio) / error, kind="stable")[:features]
    best = best[np.argsort(codes[best])]
    index, r = NgramIndex(codes[best], ORDERS), ratio[best].astype(np.float32)
    del sets

    x = np.empty((len(texts), len(best)), np.uint8)
    for at in range(0, len(texts), 256):
        x[at:at + 256] = index.presence(*as_batch(texts[at:at + 256]))
    w, bias = np.zeros(len(best), np.float32), 0.0
    share = np.where(labels == 1, 0.5 / n1, 0.5 / n0).astype(np.float32)
    step_w, step_b = np.full(len(best), 1e-8, np.float32), 1e-8
    for _ in range(steps):  # full-batch AdaGrad; the rows go through in blocks so that floats of all of them never exist
        gw, gb = np.zeros_like(w), 0.0
        for at in range(0, len(texts), 512):
            block = x[at:at + 512].astype(np.float32) * r
            p = 1 / (1 + np.exp(-np.clip(block @ w + bias, -50, 50)))
            d = (p - labels[at:at + 512].astype(np.float32)) * share[at:at + 512]
            gw, gb = gw + block.T @ d, gb + float(d.sum())
        step_w += gw * gw
        step_b += gb * gb
        rate = 0.1 / np.sqrt(step_w)
        w -= rate * gw
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)  # drops n-grams that only mark length or chance
        bias -= 0.1 * gb / float(np.sqrt(step_b))
    return ToxicityModel(index, (w * r).astype(np.float32), bias)


def _trained(documents: DataFrame, labels: DataFrame, train: Column, label: str, sample: int, options: dict) -> Broadcast:
    spark = documents.sparkSession
    small_batches(spark, 128)
    lowered = documents.select("doc_id", F.lower("text").alias("text"))
    return learned(labelled_rows(lowered, labels, label, train, sample, max_chars=20_000), lambda texts, y: fit(texts, np.array(y, np.float64), **options))


def score(documents: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", sample: int = 1200, **options) -> DataFrame:
    """Score each whole text: ``doc_id``, ``score`` (0 to 1, higher: more likely toxic), ``predicted`` (1 from 0.5 on).

    Learned from about ``sample`` labelled rows of each label among those that ``train`` marks. Null and empty
    texts are scored like a text without n-grams. Every row is answered once, repeated and null ids too.
    """
    model = _trained(documents, labels, train, label, sample, options)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = model.value.scores(*text_buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return documents.select("doc_id", F.lower("text").alias("text")).mapInArrow(apply, "doc_id long, score double, predicted int")


def without_toxic(documents: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", sample: int = 1200, **options) -> DataFrame:
    """The rows whose text scores below 0.5; all columns stay."""
    model = _trained(documents, labels, train, label, sample, options)
    return kept_rows(documents, [F.lower("text")], lambda x: model.value.scores(*text_buffers(x[0])) < 0.5)
