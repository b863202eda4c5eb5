"""CSV and log row contracts: every column is text, any may be missing, unknown ones are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..functions.strings import strip
from ..functions.texts import parse_offset
from ..operators.sequence import forward_fill, with_row_idx
from ..schema import TRACK_FIELDS
from .shared import checkpointed

#: Columns of each contract that differ in name from the track's.
TIMELINE = {"gps_abs_time": "abs_time", "gps_elapsed": "gps_elapsed_sec"}
SHEET_ROWS = 1_000_000
COORDINATES = {"gps_abs_time": "abs_time", "gps_elapsed": "elapsed_delta_sec", "gps_date": "date", "gps_utc_time": "utc_time", "gps_checksum_ok": "checksum_ok", "gps_trusted": "trusted", "gps_status": "status"}


def to_double(c: Column) -> Column:
    v = strip(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def to_boolean(c: Column) -> Column:
    t = F.lower(strip(c))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def read_csv(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """All columns as text, with the file and the row's place in it; ``name`` searches folders for files of that name."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False)
    if name:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    rows = reader.csv(path)
    return rows.select("*", F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("file_row"))


def normalize(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Track columns of a CSV contract, coerced; what is missing is null."""

    def cell(field: str) -> Column:
        own = names.get(field, field)
        return F.col(f"`{own}`") if own in raw.columns else F.lit(None).cast("string")

    out = []
    for field, kind in TRACK_FIELDS.items():
        c = cell(field)
        if field == "source_offset":
            c = parse_offset(c)
        elif isinstance(kind, T.DoubleType):
            c = to_double(c)
        elif isinstance(kind, T.BooleanType):
            c = to_boolean(c)
        out.append(c.alias(field))
    keep = [c for c in ("source_file", "file_row", "case_id") if c in raw.columns]
    rows = raw.select(*keep, *out, (to_boolean(F.col("status_valid")) if "status_valid" in raw.columns else F.lit(None).cast("boolean")).alias("_valid"))
    carved = F.when((F.coalesce("recovery_state", F.lit("")) == "") & (F.col("time_source") == "gap_carved_utc"), "gap_carved")
    rows = rows.withColumn("recovery_state", F.coalesce(carved, "recovery_state", F.lit("")))
    rows = rows.withColumn("gps_trusted", F.when(~F.coalesce("_valid", F.lit(True)), False).otherwise(F.col("gps_trusted")))
    return rows.withColumn("is_outlier", F.lit(False)).withColumn("time_estimated", F.coalesce("time_estimated", F.lit(False))).drop("_valid")


def load_timeline(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    return normalize(read_csv(spark, path, name), TIMELINE)


def load_coordinates(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Rows of coordinates.csv with the last fix filled forward within each file."""
    rows = normalize(read_csv(spark, path, name), COORDINATES).withColumn("case_id", F.col("source_file"))
    return forward_fill(with_row_idx(rows)).drop("case_id")


def load_slack(spark: SparkSession, path: str) -> DataFrame:
    names = COORDINATES | {f: "-" for f in ("start_time_sec", "end_time_sec")}
    return normalize(read_csv(spark, path, "slack_coordinates.csv"), names)


def attach_trust(timeline: DataFrame, sidecar: DataFrame) -> DataFrame:
    """AND of the timeline's trust and the sidecar's for equal (time, place, date, UTC), nulls being equal."""
    keys = ("start_time_sec", "latitude", "longitude", "gps_date", "gps_utc_time")
    side = sidecar.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.bool_and("gps_trusted").alias("_trust"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = timeline.join(side, cond, "left")
    both = F.when(F.col("gps_trusted").isNull(), F.col("_trust")).when(F.col("_trust").isNull(), F.col("gps_trusted")).otherwise(F.col("gps_trusted") & F.col("_trust"))
    return out.withColumn("gps_trusted", both).drop("_trust", *[f"_{k}" for k in keys])


def primary_file(rows: DataFrame) -> DataFrame:
    """The file with most fixes, the first by name of equals."""
    counted = rows.groupBy("source_file").agg(F.count_if(P.has_fix()).alias("fixes"))
    return counted.orderBy(F.col("fixes").desc(), "source_file").limit(1)


def pending_tracks(table: DataFrame, done: DataFrame) -> DataFrame:
    """Text tracks of track_table.csv that no output has yet."""
    text = F.lower("handler_type").isin("text", "sbtl", "subt") | to_boolean(F.col("is_text_track"))
    return table.filter(text).select(F.col("track").try_cast("int").alias("track")).filter("track is not null").distinct().join(done, "track", "left_anti")


def out_of_range(index: DataFrame) -> DataFrame:
    return index.agg(F.count_if(F.upper(strip("validation")) == "OUT_OF_RANGE").alias("n"))


def max_end(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("end_time_sec").alias("max_end"))


def tagged_json(lines: DataFrame, tag: str, schema: str) -> DataFrame:
    """Objects of lines ``TAG {...}`` of logs(run_id, line_no, line); lines that do not parse are left out."""
    rows = lines.filter(F.col("line").startswith(f"{tag} ")).withColumn("o", F.from_json(F.substring("line", len(tag) + 2, 1 << 20), schema))
    return rows.filter(F.col("o").isNotNull()).select("run_id", "line_no", "o.*")


def last_tagged_json(lines: DataFrame, tag: str, schema: str) -> DataFrame:
    rows = tagged_json(lines, tag, schema)
    w = Window.partitionBy("run_id").orderBy(F.col("line_no").desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def write_location_csv(rows: DataFrame, path: str, most: int = SHEET_ROWS) -> None:
    """A table as CSV for spreadsheets: UTF-8 with a mark on the first header of every file. Rows beyond ``most`` go to further files, as a sheet holds no more."""
    first, *rest = rows.columns
    rows = checkpointed(rows)
    files = -(-rows.count() // most)
    parts = rows.repartitionByRange(files, first) if files > 1 else rows.coalesce(1)
    parts.select(F.col(first).alias("﻿" + first), *rest).write.option("header", True).option("maxRecordsPerFile", most).csv(path)


def write_timeline(points: DataFrame, path: str) -> None:
    """Track rows under the timeline contract's names, flags and numbers as text."""
    back = {v: k for k, v in TIMELINE.items()}
    names = [TIMELINE.get(f, f) for f in TRACK_FIELDS]
    cells = [(F.col(back.get(n, n)) if back.get(n, n) in points.columns else F.lit(None)).cast("string").alias(n) for n in names]
    keys = [c for c in ("case_id",) if c in points.columns]
    points.select(*keys, *cells).write.option("header", True).csv(path)
