"""Hard negatives: rows of other labels that score just below an anchor's positives.

Anchors are a stated part of the rows. They go out in slices of bounded size; against a slice, every task reads its rows in blocks, computes the integer
scores of a block by one matrix product, and sorts each anchor's scores of it, by score and id. A first reading takes the best rows of the anchor's own label. With these
known, the second finds each positive's upper limit in the sorted scores by binary search and reads the next rows of other labels down to the lower
limit. A task keeps no more than the best k of each list, so what is shuffled follows anchors and tasks, not scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import scratch_path, written
from foliospark.llm.topk import quantised, scores, usable

#: Bytes of anchor vectors that go out at a time; rows of a block, and scores that are sorted at a time.
SLICE, BLOCK, SORTED = 8 << 20, 4_096, 1 << 20


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length of vector, and their vectors."""
    ends = column.offsets.to_numpy().astype(np.int64)
    size, flat = np.diff(ends), column.values.to_numpy(zero_copy_only=False)
    out = []
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        out.append((at, flat[ends[at][:, None] + np.arange(dim)]))
    return out


def first_of_each(key: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k rows of each key with the highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, key))
    sorted_key = key[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_key, sorted_key) < k]


class Best:
    """The best k (id, score) of each key so far."""

    def __init__(self, k: int):
        self.k, self.held, self.new, self.size = k, tuple(np.zeros(0, np.int64) for _ in range(3)), [], 0

    def add(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.new.append((key, ids, score))
        self.size += len(key)
        if self.size > max(1 << 18, len(self.held[0])):
            self.rows()

    def rows(self) -> tuple[np.ndarray, ...]:
        merged = [np.concatenate(x) for x in zip(self.held, *self.new, strict=True)]
        at = first_of_each(*merged, self.k)
        self.held, self.new, self.size = tuple(x[at] for x in merged), [], 0
        return self.held


class Anchors:
    """A slice: number, id, label and vector of each anchor; later its positives' scores too (``start`` of anchor i to that of i + 1)."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        order = np.argsort(column("row"))
        self.row, self.ids, self.label = (column(c)[order] for c in ("row", "vec_id", "label"))
        place = np.argsort(order)
        v = table.column("v").combine_chunks()
        self.by_length = [(place[at], x) for at, x in _matrix(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v)] if len(order) else []
        self.start, self.positive = np.zeros(len(order) + 1, np.int64), np.zeros(0, np.int64)

    def with_positives(self, row: np.ndarray, score: np.ndarray) -> None:
        """Positives' scores by anchor, in order of rank."""
        self.start, self.positive = np.searchsorted(row, np.append(self.row, np.iinfo(np.int64).max)), score


def sorted_scores(anchors: Anchors, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the anchors with parts of the batch: anchors, the block's ids and labels, its scores, and each anchor's order of them."""
    ids, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for at, x in _matrix(batch.column(2)):
        for who, q in anchors.by_length:
            if q.shape[1] != x.shape[1]:
                continue
            for low in range(0, len(at), BLOCK):
                block = at[low:low + BLOCK]
                step = max(1, SORTED // len(block))
                for first in range(0, len(who), step):
                    s = scores(q[first:first + step], x[low:low + BLOCK])
                    yield who[first:first + step], ids[block], label[block], s, np.lexsort((np.broadcast_to(ids[block], s.shape), -s))


def positives_of(anchors: Anchors, batches: Iterator[pa.RecordBatch], k: int) -> tuple[np.ndarray, ...]:
    """Anchor, id and score of the k best other rows of each anchor's label."""
    best = Best(k)
    for batch in batches:
        for who, ids, label, s, order in sorted_scores(anchors, batch):
            alike = (label[order] == anchors.label[who][:, None]) & (ids[order] != anchors.ids[who][:, None])
            row, column = np.nonzero(alike & (np.cumsum(alike, axis=1) <= k))
            at = order[row, column]
            best.add(who[row], ids[at], s[row, at])
    return best.rows()


def negatives_of(anchors: Anchors, batches: Iterator[pa.RecordBatch], k: int, low: int, high: int) -> tuple[np.ndarray, ...]:
    """Number of the positive, id and score of the first k rows of other labels within the positive's limits."""
    best = Best(k)
    floor, ceil = anchors.positive * high // 100, -(-anchors.positive * low // 100)
    for batch in batches:
        for who, ids, label, s, order in sorted_scores(anchors, batch):
            for i, a in enumerate(who.tolist()):
                mine = np.arange(anchors.start[a], anchors.start[a + 1])
                if not len(mine):
                    continue
                other = order[i][label[order[i]] != anchors.label[a]]
                falling = -s[i][other]
                begin = np.searchsorted(falling, -floor[mine], side="left")
                number = np.clip(np.searchsorted(falling, -ceil[mine], side="right") - begin, 0, k)
                at = other[np.repeat(begin - np.cumsum(number) + number, number) + np.arange(number.sum())]
                best.add(np.repeat(mine, number), ids[at], s[i][at])
    return best.rows()


def mine(vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, scale: int = 256, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score`` and ``negative_score``.

    Components become floor(``scale`` * x), scores are inner products. An anchor's positives are its first ``positives`` other rows of the same
    label; for each of them the first ``negatives`` rows of other labels with ``low`` * positive <= 100 * negative <= ``high`` * positive are returned.
    Higher scores come first, ties by smaller id. Rows with a null id, a null label or an unusable vector take no part; vectors of different lengths
    don't meet. Where ids repeat, each row is an anchor and a candidate of its own, and no row is a positive of an anchor with its id.
    Empty tables, anchors without positives and positives without negatives give no rows. Products are 64-bit: components beyond about 2**31 / ``scale`` wrap.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", (F.col("label") if label is None else label).cast("long").alias("label"), "embedding", F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = (rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
            .select(F.col("vec_id").cast("long").alias("vec_id"), "label", quantised(F.col("embedding"), scale).alias("v"), "asks"))
    data = written(rows, "rows")
    asking = written(data.filter("asks").select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v"), "anchors")
    held = asking.agg(F.coalesce(F.sum(8 * F.size("v") + 24), F.lit(0))).first()[0]
    slices = -(-held // SLICE)
    candidates = data.select("vec_id", "label", "v")

    def best(anchors: Anchors, search: Callable[..., tuple[np.ndarray, ...]], k: int, *limits: int) -> DataFrame:
        """The first k of each ``key``, as ``rank``; ``search`` finds those of one task."""
        shared = spark.sparkContext.broadcast(anchors)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in search(shared.value, batches, k, *limits)], names=["key", "vec_id", "score"])

        found = candidates.mapInArrow(run, "key long, vec_id long, score long")
        order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")  # at most k rows of each task
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    paths = []
    for i in range(slices):
        slice_ = Anchors(asking.filter(F.pmod(F.xxhash64("row"), F.lit(slices)) == i).toArrow())  # about SLICE bytes
        if not len(slice_.row):
            continue
        near = best(slice_, positives_of, positives).orderBy("key", "rank").toArrow().combine_chunks()
        key, positive_id, score = (near.column(c).to_numpy() for c in ("key", "vec_id", "score"))
        slice_.with_positives(slice_.row[key], score)
        names = spark.createDataFrame(pa.table({"key": np.arange(len(key)), "anchor_id": slice_.ids[key], "positive_id": positive_id, "positive_score": score}))
        found = best(slice_, negatives_of, negatives, low, high).join(F.broadcast(names), "key")  # a row for each positive of the slice
        paths.append(scratch_path(spark, "negatives"))
        found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(paths[-1])
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
