"""Rows out of binary files: hashes, container kinds, MP4 boxes, zero runs, NMEA sentences.

Files are read with Spark's binaryFile source, so any store works; each file is
one row and files are worked on in parallel. binaryFile holds a file of up to
2 GiB in one row.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def hashes(files: DataFrame) -> DataFrame:
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest(files: DataFrame, root: str) -> DataFrame:
    """Lines ``<sha256>  <path below root>``."""
    below = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    return files.select(F.concat_ws("  ", F.sha2("content", 256), below).alias("value"))


def containers(files: DataFrame) -> DataFrame:
    """Container by its magic bytes, and whether the name's extension says otherwise."""
    head = F.hex(F.substring("content", 1, 12))
    kind = F.when(head.rlike("^52494646.{8}41564920"), "avi").when(F.substring(head, 9, 8).isin("66747970", "6D6F6F76", "6D646174"), "mp4").otherwise("unknown")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    expected = F.when(ext == "avi", "avi").when(ext.isin("mp4", "mov", "m4v"), "mp4")
    return files.select("path", kind.alias("container"), F.coalesce(expected != kind, F.lit(False)).alias("mismatch"))


def sample_digest(files: DataFrame, part: int = 1 << 20) -> DataFrame:
    """SHA-256 of the size and the first, middle and last ``part`` bytes."""
    n = F.col("length")
    middle = F.greatest(F.lit(0), F.floor(n / 2) - part // 2).cast("int") + 1
    last = F.greatest(F.lit(0), n - part).cast("int") + 1
    cut = [F.col("content").substr(F.lit(1), F.lit(part)), F.col("content").substr(middle, F.lit(part)), F.col("content").substr(last, F.lit(part))]
    return files.select("path", F.sha2(F.concat(n.cast("string").cast("binary"), *cut), 256).alias("digest"))


def _per_file(files: DataFrame, of, schema: str) -> DataFrame:
    names = ["path", *[x.strip().split(" ")[0] for x in schema.split(",")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = [(path, *r) for r in of(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, "path string, " + schema)


def _boxes(data: bytes, start: int, end: int, path: str = "") -> Iterator[tuple]:
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        name = f"{path}/{kind.decode('latin-1')}"
        yield at, size, head, name
        if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"moof", b"traf", b"udta"):
            yield from _boxes(data, at + head, at + size, name)
        at += size


def mp4_boxes(files: DataFrame) -> DataFrame:
    """(path, at, size, head, name): boxes whose extent lies in their parent, depth first."""
    return _per_file(files, lambda d: _boxes(d, 0, len(d)), "at long, size long, head int, name string")


def mp4_durations(files: DataFrame) -> DataFrame:
    """(path, duration_sec, created): of the movie header."""

    def of(data: bytes) -> Iterator[tuple]:
        for at, size, head, name in _boxes(data, 0, len(data)):
            if name == "/moov/mvhd" and size >= head + 20:
                p = at + head
                if data[p] == 1 and size >= head + 32:
                    created, _, scale, length = struct.unpack_from(">QQIQ", data, p + 4)
                else:
                    created, _, scale, length = struct.unpack_from(">IIII", data, p + 4)
                if scale:
                    yield length / scale, created
                return

    return _per_file(files, of, "duration_sec double, created long")


def video_tracks(files: DataFrame) -> DataFrame:
    """(path, n_video): MP4 tracks with a video handler, or AVI stream headers of kind vids."""

    def of(data: bytes) -> Iterator[tuple]:
        if data[:4] == b"RIFF":
            head = data[: data.find(b"movi") if b"movi" in data else len(data)]
            yield (len(re.findall(rb"strh.{4}vids", head, re.S)),)
            return
        yield (sum(1 for at, _, head, name in _boxes(data, 0, len(data)) if name.endswith("/hdlr") and data[at + head + 8 : at + head + 12] == b"vide"),)

    return _per_file(files, of, "n_video int")


def zero_runs(files: DataFrame, block: int = 1 << 16, least: int = 1 << 18) -> DataFrame:
    """(path, a, b): runs of all-zero blocks of ``least`` bytes or more."""

    def of(data: bytes) -> Iterator[tuple]:
        zero, start = bytes(block), None
        for at in range(0, len(data) + 1, block):
            piece = data[at : at + block]
            if piece and piece == zero[: len(piece)]:
                start = at if start is None else start
                continue
            if start is not None and at - start >= least:
                yield start, min(at, len(data))
            start = None
        if start is not None and len(data) - start >= least:
            yield start, len(data)

    return _per_file(files, of, "a long, b long")


_RMC = re.compile(rb"\$G[NP]RMC,([^*$\r\n]{10,100})\*([0-9A-Fa-f]{2})")


def rmc_sentences(data: bytes) -> Iterator[tuple]:
    """(at, date, utc, latitude, longitude, speed_kmh) of sentences with a right checksum, a valid state and a place."""
    for m in _RMC.finditer(data):
        sum_ = 0
        for x in data[m.start() + 1 : m.end() - 3]:
            sum_ ^= x
        f = m[1].decode("latin-1").split(",")
        if sum_ != int(m[2], 16) or len(f) < 9 or f[1] != "A":
            continue
        try:
            lat = (float(f[2][:2]) + float(f[2][2:]) / 60) * (-1 if f[3] == "S" else 1)
            lon = (float(f[4][:3]) + float(f[4][3:]) / 60) * (-1 if f[5] == "W" else 1)
            speed = float(f[6]) * 1.852 if f[6] else None
        except ValueError:
            continue
        if lat or lon:
            yield m.start(), f[8], f[0], lat, lon, speed


def carve_rmc(files: DataFrame) -> DataFrame:
    """GPS sentences anywhere in the files, the first of each (date, UTC) of a file, by place."""
    rows = _per_file(files, rmc_sentences, "at long, gps_date string, gps_utc_time string, latitude double, longitude double, speed_kmh double")
    first = rows.groupBy("path", "gps_date", "gps_utc_time").agg(F.min_by(F.struct("at", "latitude", "longitude", "speed_kmh"), "at").alias("r"))
    return first.select("path", "gps_date", "gps_utc_time", "r.*")
