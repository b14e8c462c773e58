"""What the corpus operators share: samples, scratch tables, joins that survive hot keys, batches."""

from __future__ import annotations

import atexit
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to a Python worker; texts may be long, so the batches are short.
BATCH_ROWS = 256
#: Upper bound of the rows that a hot-key broadcast may hold (see ``attach_groups``).
HOT_SHARE = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Python workers get short Arrow batches: their memory then doesn't follow the table."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, removed when the driver ends.

    Where the setting is absent (tests on one machine) a folder in the warehouse directory is set.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        folder = f"{base.rstrip('/')}/foliospark-{uuid.uuid4().hex}"
        _folders[app] = folder
        atexit.register(_remove, spark, folder)
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        drop_table(spark, folder)
    except Exception:  # the session has ended: whoever owns the shared folder clears it
        return


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system, wherever the shared folder lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, df: DataFrame) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_part(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def hash_share(column: str, share: float) -> Column:
    """True for about ``share`` of all ids, the same ones on every run."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def labelled_rows(documents: DataFrame, labels: DataFrame, label: str, train: Column, limit: int, max_chars: int = 50_000) -> DataFrame:
    """``doc_id``, whole ``text`` and the 0/1 label ``y`` of rows to learn from, about ``limit`` of each label at most.

    ``limit`` and ``max_chars`` (texts longer than that aren't sampled) bound the sample.
    Rows are taken by a hash of their id, so every part of the table is represented. Null ids, labels and
    texts are left out, as are labels other than 0 and 1; of several labels of an id the largest counts.
    """
    marked = (labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
              .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & train)
              .groupBy("doc_id").agg(F.max("y").alias("y")))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    chosen = marked.filter(
        F.when(F.col("y") == 1, hash_share("doc_id", limit / max(1, counts.get(1, 0))))
        .otherwise(hash_share("doc_id", limit / max(1, counts.get(0, 0)))))
    return (documents.select("doc_id", "text").filter(F.length("text") <= max_chars)
            .join(F.broadcast(chosen), "doc_id")  # at most about 2 * limit ids
            .select("doc_id", "text", "y"))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, train: Column, limit: int,
                    max_chars: int = 50_000) -> tuple[list[str], np.ndarray]:
    """``labelled_rows`` for training on the driver: texts and labels, by (doc_id, text)."""
    rows = labelled_rows(documents, labels, label, train, limit, max_chars).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], dtype=np.float64)


def learned(sample: DataFrame, fit: Callable[[list, list], object]) -> Broadcast:
    """What ``fit`` learns from a bounded sample (``doc_id``, ``text`` and one more column), broadcast.

    A task learns, from the texts and the other column's values by (doc_id, text), so that the driver holds the model only, never the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows]), 5)], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return sample.sparkSession.sparkContext.broadcast(pickle.loads(found["model"]) if found else fit([], []))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of ``rows`` to one row per group, where some groups may hold a large share of all rows.

    Groups of more than ``total / HOT_SHARE`` rows (so fewer than ``HOT_SHARE``, whatever the input) go out
    by broadcast; the rows of all others are dealt by ``key``. ``groups`` has ``key``, ``size`` and what is attached;
    rows with a null key get nulls. No row is lost or repeated.
    """
    bound = max(1, total // HOT_SHARE)
    extra = [c for c in groups.columns if c not in (key, size)]
    hot = groups.filter(F.col(size) > bound).drop(size).withColumn("_hot", F.lit(True))
    first = rows.join(F.broadcast(hot), key, "left")
    cold = groups.filter(F.col(size) <= bound).drop(size)
    split = first.filter(F.col("_hot").isNotNull() | F.col(key).isNull()).drop("_hot")
    dealt = (first.filter(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot", *extra)
             .join(cold.hint("shuffle_hash"), key, "left"))
    return split.unionByName(dealt.select(split.columns))


def kept_rows(df: DataFrame, inputs: list[Column], keep: Callable[[list[pa.Array]], np.ndarray]) -> DataFrame:
    """The rows of ``df`` for which ``keep`` says True, given batches of the ``inputs``; all columns stay, whatever their names."""
    width = len(df.columns)
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mask = pa.array(np.asarray(keep(batch.columns[width:]), dtype=bool))
                yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns[:width]], names=batch.schema.names[:width])

    return df.select("*", *[c.alias(f"_input_{i}") for i, c in enumerate(inputs)]).mapInArrow(run, schema)


#: Bits of an ``IdFilter``: a broadcast of 1 MB.
ID_BITS = 23


class IdFilter:
    """A fixed-size filter of ids: ``may_hold`` is true for all of them and, while they are far fewer than 2 ** ID_BITS, for few others."""

    def __init__(self, ids: DataFrame, column: str):
        slot = self.slot(F.col(column))
        words = ids.filter(F.col(column).isNotNull()).select(F.shiftright(slot, 15).alias("word"), F.pmod(slot, F.lit(1 << 15)).alias("bit"))
        flags = np.zeros((1 << (ID_BITS - 15), 4096), np.uint8)
        for r in words.groupBy("word").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # 256 rows of 4 KB at most
            flags[r["word"]] = np.frombuffer(r["bits"], np.uint8)
        self.flags = ids.sparkSession.sparkContext.broadcast(flags.ravel())

    @staticmethod
    def slot(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(1 << ID_BITS))

    def may_hold(self, slots: pa.Array) -> np.ndarray:
        """For each value of ``slot``; bit p of a word is at byte p // 8."""
        at = slots.to_numpy()
        return ((self.flags.value[(at >> 15) * 4096 + (at & 0x7FFF) // 8] >> (at % 8).astype(np.uint8)) & 1).astype(bool)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the offsets of its rows; a null is an empty row. No copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]] if len(column) else raw[:0], ends.astype(np.int64) - (int(ends[0]) if len(ends) else 0)


def windows(offsets: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """Cut a batch into pieces of about ``limit`` bytes: (first row, end row, first byte, end byte).

    Rows stay whole where they fit; a longer row comes in pieces that overlap by ``overlap`` bytes.
    """
    row, rows = 0, len(offsets) - 1
    while row < rows:
        if offsets[row + 1] - offsets[row] > limit:
            at, end = int(offsets[row]), int(offsets[row + 1])
            while at < end:
                yield row, row + 1, at, min(end, at + limit)
                if at + limit >= end:
                    break
                at += limit - overlap
            row += 1
            continue
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = max(row + 1, min(stop, rows))
        yield row, stop, int(offsets[row]), int(offsets[stop])
        row = stop


def turns(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Whole rows (first, end) of about ``limit`` bytes; a longer row is a turn by itself."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, stop
        row = stop
