"""Bytes of files in ranges, so that a file of any size is read by many tasks and no row is larger than a range.

``byte_ranges`` is a data source: options ``path`` (a file or a folder, on any
store that pyarrow opens), ``range_bytes`` and ``overlap``. A row is a range with the
``overlap`` bytes after it. What begins in a range belongs to it, so hits that lie
over a border are found once, and results do not depend on the ranges' size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.damage import merge_regions
from .files import rmc_sentences

RANGE_BYTES = 4 << 20
#: No sentence is longer.
SENTENCE_BYTES = 256
ZERO_BLOCK, ZERO_RUN = 1 << 16, 1 << 18
#: Bytes that one task reads, about.
TASK_BYTES = 64 << 20
#: Ranges that go from task to Spark at a time.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096
#: What opening a file counts as.
OPEN_BYTES = 1 << 20
SCHEMA = "path string, at long, length long, file_size long, content binary"


class Stretches(InputPartition):
    """What one task reads: (path, begin, end, size of the file) of parts of large files or of several small ones."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        self.parts = parts


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class ByteRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range, self.overlap = int(options.get("range_bytes", RANGE_BYTES)), int(options.get("overlap", 0))
        #: Ranges of one task.
        self.task = max(1, int(options.get("task_bytes", TASK_BYTES)) // self.range) * self.range

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _opened(self.path)
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        parts = []
        for f in files:
            if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")):
                parts += [(f.path, a, min(f.size, a + self.task), f.size) for a in range(0, f.size, self.task)]
        tasks: list[InputPartition] = []
        room = 0
        for part in parts:
            length = part[2] - part[1]
            if not tasks or length > room:
                tasks.append(Stretches([]))
                room = self.task
            tasks[-1].parts.append(part)
            room -= length + OPEN_BYTES
        return tasks

    def read(self, partition: Stretches) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        for path, begin, end, size in partition.parts:
            with store.open_input_file(path) as f:
                yield from _batches((path, at, min(self.range, end - at), size, f.read_at(min(min(self.range, end - at) + self.overlap, size - at), at)) for at in range(begin, end, self.range))


def _batches(ranges: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of ``SCHEMA`` in batches of up to ``BATCH_BYTES``, or of one range that is larger."""
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["path", "at", "length", "file_size", "content"])

    rows, held = [], 0
    for r in ranges:
        if rows and (held + len(r[4]) > BATCH_BYTES or len(rows) == BATCH_ROWS):
            yield batch(rows)
            rows, held = [], 0
        rows.append(r)
        held += len(r[4])
    if rows:
        yield batch(rows)


def read_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, overlap: int = 0) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").option("path", path).option("range_bytes", range_bytes).option("overlap", overlap).load()


def read_members(members: DataFrame, range_bytes: int = RANGE_BYTES, overlap: int = 0) -> DataFrame:
    """Ranges of files that lie one after another in larger ones: members(path, name, begin, size) names what each is and where.

    ``path`` of the result is the member's name, ``at`` counts from its beginning, and no range or overlap goes past its end.
    """
    names = ("name", "store", "begin", "size", "a", "b")
    step = range_bytes * max(1, TASK_BYTES // range_bytes)
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))
    parts = members.filter("size > 0").select("name", F.col("path").alias("store"), "begin", "size", F.explode(starts).alias("a"))
    parts = parts.select("*", F.least(F.col("a") + step, "size").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches(ranges(zip(*(b.column(k).to_pylist() for k in range(len(names))), strict=True)))

    def ranges(rows: Iterator[tuple]) -> Iterator[tuple]:
        opened, f = None, None
        try:
            for name, path, begin, size, a, b in rows:
                if path != opened:
                    if f is not None:
                        f.close()
                    store, root = _opened(path)
                    opened, f = path, store.open_input_file(root)
                for at in range(a, b, range_bytes):
                    length = min(range_bytes, b - at)
                    yield name, at, length, size, f.read_at(min(length + overlap, size - at), begin + at)
        finally:
            if f is not None:
                f.close()

    spark = members.sparkSession
    total = members.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, total // TASK_BYTES + 1)
    # Few and small rows stand for many bytes, so their number of tasks is not left to AQE.
    return parts.select(*names).repartitionByRange(tasks, "store", "begin", "a").mapInArrow(run, SCHEMA)


def carve_sentences(ranges: DataFrame) -> DataFrame:
    """GPS sentences with a right checksum, a valid state and a place; the first of each (date, UTC) of a file.

    ``ranges`` need an overlap of a sentence's length.
    """
    names = ("path", "at", "gps_date", "gps_utc_time", "latitude", "longitude", "speed_kmh")
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, at, length, content in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                rows += [(path, at + r[0], *r[1:]) for r in rmc_sentences(content) if r[0] < length]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "path string, at long, gps_date string, gps_utc_time string, latitude double, longitude double, speed_kmh double"
    found = ranges.select("path", "at", "length", "content").mapInArrow(run, schema)
    first = found.groupBy("path", "gps_date", "gps_utc_time").agg(F.min_by(F.struct("at", "latitude", "longitude", "speed_kmh"), "at").alias("r"))
    return first.select("path", "gps_date", "gps_utc_time", "r.*")


def zero_runs(ranges: DataFrame, block: int = ZERO_BLOCK, least: int = ZERO_RUN) -> DataFrame:
    """(path, a, b): runs of all-zero blocks of ``least`` bytes or more; ranges must be whole blocks.

    A range reports its own runs of any length; those that meet at its borders are put together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = bytes(block)
        for b in batches:
            all_found = []
            for path, at, length, content in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if at % block:
                    raise ValueError("ranges must be whole blocks")
                found: list[list[int]] = []
                for i in range(0, length, block):
                    piece = content[i : min(i + block, length)]
                    if piece == zero[: len(piece)]:
                        if found and found[-1][1] == at + i:
                            found[-1][1] = at + i + len(piece)
                        else:
                            found.append([at + i, at + i + len(piece)])
                all_found += [(path, *x) for x in found]
            if all_found:
                paths, starts, ends = zip(*all_found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["path", "a", "b"])

    parts = ranges.select("path", "at", "length", "content").mapInArrow(run, "path string, a long, b long")
    return merge_regions(parts, keys=("path",)).filter(F.col("b") - F.col("a") >= least)


def sentence(body: str) -> Column:
    """The text of an NMEA sentence: ``$``, body, ``*`` and the exclusive or of the body's bytes."""
    codes = F.transform(F.sequence(F.lit(1), F.length(body)), lambda i: F.ascii(F.substring(F.col(body), i, F.lit(1))))
    check = F.lpad(F.hex(F.aggregate(codes, F.lit(0), lambda a, x: a.bitwiseXOR(x))), 2, "0")
    return F.concat(F.lit("$"), body, F.lit("*"), check)
