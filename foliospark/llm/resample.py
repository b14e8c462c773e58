"""Target-distribution importance resampling of documents by hashed n-gram features.

A document's features are its runs of words. Each task keeps an integer dictionary of its words: n-grams are tuples of word ids, the bytes of each
distinct tuple are put together and hashed once while the dictionary holds them, and the buckets are joined back to all places by the tuples' numbers.
Bucket counts of the corpus and of the target texts give each bucket a gain; a document's weight is the mean gain of its features. Weight plus Gumbel noise
from a hash of the id is its score, and the highest scores are drawn: a sample without replacement in proportion to exp(weight / 1000).

No token is shuffled: tasks send a count for each bucket, and one short row for each document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import text_buffers, turns, written
from foliospark.llm.shingles import ALPHANUMERIC, words

#: Bytes of text of a turn, where texts aren't longer themselves.
TURN = 4 << 20
#: Bytes of words and number of tuples that a task's dictionary may hold before it starts anew.
HELD_BYTES, HELD_TUPLES = 32 << 20, 1 << 20
#: Numbers of rows in a partition are the low bits of ``monotonically_increasing_id``.
_IN_PARTITION = 33

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Dictionary:
    """Word ids and the buckets of tuples of word ids, as far as a task has met them."""

    def __init__(self, buckets: int):
        self.buckets, self.ids, self.spelled, self.bucket, self.bytes = buckets, {}, [], {}, 0

    def begin(self) -> None:
        """Start anew where too much is held; between turns, as ids hold within one."""
        if self.bytes > HELD_BYTES or len(self.bucket) > HELD_TUPLES:
            self.ids, self.spelled, self.bucket, self.bytes = {}, [], {}, 0

    def word_ids(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The id of each word; A-Z count as a-z."""
        size = ends - starts
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        edge = np.zeros(len(raw) + 1, np.int8)
        edge[starts] += 1
        edge[ends] -= 1  # words never touch within a row, and a word that begins where another ends makes 0
        data = _LOWER[raw[np.cumsum(edge[:-1], dtype=np.int8) > 0]]
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        own = np.empty(len(found.dictionary), np.int64)
        for i, word in enumerate(found.dictionary.to_pylist()):
            at = self.ids.get(word)
            if at is None:
                at = self.ids[word] = len(self.spelled)
                self.spelled.append(word)
                self.bytes += len(word)
            own[i] = at
        return own[found.indices.to_numpy()]

    def of_tuples(self, tuples: np.ndarray) -> np.ndarray:
        """The bucket of each row of word ids: crc32 of the words joined by one space, once for each distinct tuple."""
        out = np.empty(len(tuples), np.int64)
        for i, key in enumerate(map(tuple, tuples.tolist())):
            at = self.bucket.get(key)
            if at is None:
                at = self.bucket[key] = zlib.crc32(b" ".join([self.spelled[w] for w in key])) % self.buckets
            out[i] = at
        return out


def features(raw: np.ndarray, offsets: np.ndarray, n: int, known: Dictionary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of 1 to ``n`` words: the row of each distinct tuple of that row's, its bucket, and how often the row has it."""
    known.begin()
    starts, ends, before = words(raw, offsets, ALPHANUMERIC)
    if not len(starts):
        return
    ids = known.word_ids(raw, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    number = ids
    for length in range(1, n + 1):
        if length > 1:  # a tuple is its first words' number and one more word
            begin = begin[(begin + length - 1 < len(ids)) & (row[np.minimum(begin + length - 1, len(ids) - 1)] == row[begin])]
            number = number[begin] * (int(ids.max()) + 1) + ids[begin + length - 1]
        else:
            begin = np.arange(len(ids))
        if not len(begin):
            return
        distinct, first, number = np.unique(number, return_index=True, return_inverse=True)
        bucket = known.of_tuples(np.stack([ids[begin[first] + j] for j in range(length)], 1))
        pair, count = np.unique(row[begin] * len(distinct) + number, return_counts=True)
        at_row, at_tuple = np.divmod(pair, len(distinct))
        yield at_row, bucket[at_tuple], count
        whole = np.zeros(len(ids), np.int64)
        whole[begin] = number
        number = whole


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all rows of ``text`` fall into each bucket. The driver gets one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), Dictionary(buckets)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for first, end in turns(offsets, TURN):
                low, high = offsets[first], offsets[end]
                for _, bucket, number in features(raw[low:high], offsets[first:end + 1] - low, n, known):
                    np.add.at(total, bucket, number)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of target to source) of each bucket."""
    b, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = (target + 1).astype(np.float64) * float(s + b) / ((source + 1).astype(np.float64) * float(t + b))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighted(documents: DataFrame, gain: np.ndarray, n: int = 1) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` (floored mean gain; 0 without features) of each row."""
    shared = documents.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        known = Dictionary(len(gain))
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            rows = len(offsets) - 1
            n_words, n_features, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for first, end in turns(offsets, TURN):
                low, high = offsets[first], offsets[end]
                for i, (row, bucket, number) in enumerate(features(raw[low:high], offsets[first:end + 1] - low, n, known)):
                    np.add.at(total, first + row, gain[bucket] * number)
                    np.add.at(n_features, first + row, number)
                    if not i:
                        np.add.at(n_words, first + row, number)
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return documents.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * a Gumbel number) out of the first 32 bits of sha256(``seed:doc_id``)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(documents: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (from 1; null if not drawn) of each row of ``documents``.

    Of the N rows with an id and at least ``least_words`` words, floor(percent * N / 100) are drawn: those of the highest scores, ties to the
    smaller doc_id. Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z as a-z; null texts have none. A row with a null id counts in the corpus
    but has a null score and isn't drawn. Rows that repeat an id each count and have the same noise; equal rows take ranks in any order.
    Empty tables draw nothing. Other columns of both tables are left alone.

    Ranks need no task that sees all rows: scores are dealt in ranges (ties are split, too), and a row's rank is its place in its range plus the sizes of those before.
    """
    if n < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("n and buckets must be positive, percent from 0 to 100")
    gain = gains(bucket_counts(documents, n, buckets), bucket_counts(target, n, buckets))
    scored = weighted(documents, gain, n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored.withColumn("drawable", F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)), "scored")
    wanted = scored.filter("drawable").count() * percent // 100
    order = [F.desc("drawable"), F.desc("score"), F.asc("doc_id")]
    ranged = scored.withColumn("row", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*order, F.asc("row")).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = written(ranged.drop("row"), "ranged")
    part = F.shiftright("place", _IN_PARTITION)
    sizes = sorted((r["part"], r["n"]) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each task
    before, known = 0, []
    for p, size in sizes:
        known.append((p, before))
        before += size
    offsets = F.broadcast(ranged.sparkSession.createDataFrame(known, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << _IN_PARTITION) - 1)) + 1
    return (ranged.withColumn("part", part).join(offsets, "part", "left")
            .select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("drawable") & (rank <= wanted), rank).alias("rank")))
