"""A folder of scans as a Spark data source, and the calibration report of its pages: rows, counters, CSV and JSON."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliospark.operators import measure, rules

SCHEMA = "page_id long, path string, filename string, bytes long, content binary"
#: Bytes of files that one task reads about.
PART_BYTES = 64 << 20
#: Files of one task at most: packed scans are few bytes, but each is measured.
PART_FILES = 32


@dataclass
class ScanFiles(InputPartition):
    """Numbers, paths and sizes of the files of one task."""

    files: list[tuple[int, str, int]]


class ScanReader(DataSourceReader):
    """Lists the folder once; tasks open their files themselves. A file that can't be read is a row without content.

    Files that end in ``.gz`` are unpacked as they are read; ``bytes`` is their size in the folder.
    """

    def __init__(self, uri: str, suffix: str, part_bytes: int):
        self.uri, self.suffix, self.part_bytes = uri, suffix.lower(), part_bytes

    def partitions(self) -> list[ScanFiles]:
        system, root = fs.FileSystem.from_uri(self.uri)
        found = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.path.lower().removesuffix(".gz").endswith(self.suffix))
        parts, held, size = [], [], 0
        for i, (path, n) in enumerate(found):
            if held and (size + n > self.part_bytes or len(held) >= PART_FILES):
                parts.append(ScanFiles(held))
                held, size = [], 0
            held.append((i, path, n))
            size += n
        return [*parts, ScanFiles(held)] if held or not parts else parts

    def read(self, partition: ScanFiles) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.uri)
        for number, path, size in partition.files:
            try:
                with system.open_input_stream(path, compression="gzip" if path.lower().endswith(".gz") else None) as f:
                    content = f.read()
            except OSError:
                content = None
            yield number, path, path.rsplit("/", 1)[-1], size, content


class ScanSource(DataSource):
    """``spark.read.format("scans").load(uri)``; options ``suffix`` (.pgm) and ``partbytes``. ``page_id`` numbers the files by path, from 0."""

    @classmethod
    def name(cls) -> str:
        return "scans"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ScanReader:
        path = self.options["path"]
        return ScanReader(path if "://" in path else f"file://{path}", self.options.get("suffix", ".pgm"), int(self.options.get("partbytes", PART_BYTES)))


def read_scans(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The scans below ``path``: any file system that Arrow knows, or a folder that all executors mount."""
    spark.dataSource.register(ScanSource)
    return spark.read.format("scans").options(**options).load(path)


#: The metrics that the rules and the report read.
READ = ("width", "height", "is_bitonal", "median_luma", "ink_paper_contrast", "ink_coverage", "text_ink_coverage", "text_component_count", "est_text_height_px", "noise_sigma", "snr", "stroke_sharpness", "skew_deg",
        "rotation_deg", "rotation_confidence", "glare_area_fraction", "shadow_area_fraction", "illumination_ratio", "tile_count", "low_contrast_tiles", "cutoff_edges", "likely_spread", "capture_profile")


def calibration(scans: DataFrame, overrides: dict | None = None) -> DataFrame:
    """A row for each scan: file, class, score, codes of its defects, and the metrics that thresholds are set by. Broken scans are rows with their ``error``."""
    judged = rules.judge(measure.measured(scans, READ, ("filename",)), overrides)
    codes = F.array_join(F.array_sort(F.array_distinct(F.col("findings.code"))), ",")
    return judged.select("page_id", "filename", F.col("overall").alias("class"), "score", codes.alias("defects"), F.col("capture_profile").alias("profile"), F.coalesce("likely_spread", F.lit(False)).alias("spread"),
                         F.round(F.col("ink_coverage") * 100, 3).alias("ink_percent"), F.round(F.col("text_ink_coverage") * 100, 3).alias("text_ink_percent"), F.round("ink_paper_contrast", 1).alias("contrast"),
                         F.round("stroke_sharpness", 4).alias("sharpness"), F.round("median_luma", 1).alias("luma"), F.round("noise_sigma", 2).alias("noise"), F.round("skew_deg", 2).alias("skew"),
                         F.col("rotation_deg").alias("rotation"), F.round("est_text_height_px", 1).alias("text_height"), F.round("seconds", 3).alias("seconds"), "error")


def counters(report: DataFrame) -> DataFrame:
    """``kind`` (pages, error, class, defect), ``name`` and ``n`` of a calibration, and the mean ``seconds`` a page (kind pages)."""
    kinds = F.array(F.struct(F.lit("pages").alias("kind"), F.lit("all").alias("name")), F.struct(F.lit("class").alias("kind"), F.col("class").alias("name")),
                    F.when(F.col("error").isNotNull(), F.struct(F.lit("error").alias("kind"), F.lit("unreadable").alias("name"))))
    defects = F.transform(F.filter(F.split("defects", ","), lambda c: c != ""), lambda c: F.struct(F.lit("defect").alias("kind"), c.alias("name")))
    return (report.select("seconds", F.explode(F.array_compact(F.concat(kinds, F.coalesce(defects, F.array().cast("array<struct<kind:string,name:string>>"))))).alias("k"))
            .groupBy("k.kind", "k.name").agg(F.count("*").alias("n"), F.avg(F.when(F.col("k.kind") == "pages", F.col("seconds"))).alias("seconds")))


def write_report(report: DataFrame, path: str, form: str) -> None:
    """The report as ``csv`` (with a heading) or ``json`` files below ``path``, a part for each task."""
    if form not in ("csv", "json"):
        raise ValueError("the form is csv or json")
    writer = report.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)


def write_scans(images: DataFrame, uri: str) -> DataFrame:
    """Write each image (``filename``, ``content``) below ``uri``, by the tasks that hold them; a task that runs again writes the same files.

    Names that end in ``.gz`` are written packed. Returns the rows' names and the images' sizes.
    """
    root = uri if "://" in uri else f"file://{uri}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(root)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1).to_pylist(), strict=True):
                packed = name.lower().endswith(".gz")
                with system.open_output_stream(f"{folder}/{name}", compression=None) as f:
                    f.write(gzip.compress(content or b"", 1, mtime=0) if packed else content or b"")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["filename", "bytes"])

    return images.select("filename", "content").mapInArrow(run, "filename string, bytes long")
