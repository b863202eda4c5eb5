"""Queries over files and sinks, overlaps, and texts, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts as X
from ..operators import damage as D
from ..operators import events as E
from ..operators import outliers, pairs
from ..sources import files as FL
from ..sources import rows as SR
from ..sources.shared import checkpointed, shared_path
from . import queries_damage as QD
from .adapter import ORACLE_CTE, track_points
from .queries_clips import marks_sql
from .queries_track import EVENTS

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str, table: str | None = None):
    def add(f: Callable[[DataFrame], DataFrame]):
        Q[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet") if table else track_points(spark, sf_dir))
        O[f.__name__] = sql if table else "WITH RECURSIVE " + ORACLE_CTE.strip() + ",\n" + sql
        return f

    return add


# --- files and rows


def _named_csv(rows: DataFrame, folder: str, name: str, by: str) -> None:
    """CSV files of a given name, one for each value of ``by`` that a task has, each in a folder of its own; dots in the value begin a folder below."""
    spark = rows.sparkSession
    staged = f"{folder}/.staged-{name}"
    rows.write.partitionBy(by).option("header", True).csv(staged)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = fs.globStatus(at(f"{staged}/{by}=*/part-*.csv"))
    if not len(parts):  # no rows: the header alone
        rows.drop(by).coalesce(1).write.option("header", True).csv(f"{staged}/{by}=none")
        parts = fs.globStatus(at(f"{staged}/{by}=*/part-*.csv"))
    for n, s in enumerate(parts):
        value = s.getPath().getParent().getName().partition("=")[2].replace(".", "/")
        part = at(f"{folder}/{value}/{n}/{name}")
        fs.mkdirs(part.getParent())
        fs.rename(s.getPath(), part)
    fs.delete(at(staged), True)


@query("SELECT case_id % 3 AS folder, latitude, longitude, speed_kmh, gps_date, gps_utc_time, source_offset FROM tp WHERE latitude IS NOT NULL")
def src_slack_csv(p: DataFrame) -> DataFrame:
    """Residue rows in files of one name, found in whatever folder they lie, beside files of another name (also src_find_csvs)."""
    root = shared_path(p.sparkSession, "slack")
    text = [F.col(c).cast("string").alias(n) for c, n in (("latitude", "latitude"), ("longitude", "longitude"), ("speed_kmh", "speed_kmh"), ("gps_date", "date"), ("gps_utc_time", "utc_time"))]
    folder = F.expr("concat(repeat('deep.', cast(case_id % 3 as int)), 'f', case_id % 3)")
    rows = p.filter("latitude is not null").select(folder.alias("_f"), *text, F.concat(F.lit("0x"), F.hex("source_offset")).alias("source_offset"))
    rows = checkpointed(rows)
    _named_csv(rows, root, "slack_coordinates.csv", "_f")
    _named_csv(rows, root, "other.csv", "_f")
    found = SR.load_slack(p.sparkSession, root)
    folder = F.regexp_extract("source_file", r"/f(\d)/", 1).cast("long")
    return found.select(folder.alias("folder"), "latitude", "longitude", "speed_kmh", "gps_date", "gps_utc_time", "source_offset")


@query("SELECT case_id, row_idx, latitude, longitude FROM tp WHERE latitude IS NOT NULL")
def snk_location_csv(p: DataFrame) -> DataFrame:
    """The table for spreadsheets written and read back, mark and all."""
    path = shared_path(p.sparkSession, "location")
    SR.write_location_csv(p.filter("latitude is not null").select("case_id", "row_idx", "latitude", "longitude"), path)
    rows = p.sparkSession.read.option("header", True).csv(path)
    first = rows.columns[0]
    return rows.select(F.col(f"`{first}`").cast("long").alias("case_id"), F.col("row_idx").cast("long").alias("row_idx"), F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))


def _binary(d: DataFrame) -> DataFrame:
    """Documents as files: path, length and bytes."""
    k = F.col("doc_id")
    head = F.when(k % 4 == 0, F.concat(F.lit("RIFFabcdAVI "), F.coalesce("text", F.lit("")))).when(k % 4 == 1, F.concat(F.lit("abcdftyp"), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    name = F.concat(F.lit("/cases/out/"), k, F.when(k % 3 == 0, ".avi").when(k % 3 == 1, ".mp4").otherwise(".bin"))
    return d.select(name.alias("path"), F.octet_length(head).cast("long").alias("length"), F.encode(head, "utf-8").alias("content"))


FILES = """WITH f AS (SELECT '/cases/out/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.avi' WHEN 1 THEN '.mp4' ELSE '.bin' END AS path, doc_id AS k, CASE doc_id % 4 WHEN 0 THEN 'RIFFabcdAVI ' WHEN 1 THEN 'abcdftyp' ELSE '' END || coalesce(text, '') AS body FROM documents)
"""


@query(FILES + "SELECT path, CAST(strlen(body) AS BIGINT) AS length, sha256(body) AS sha256 FROM f", "documents")
def src_binary_sha256(d: DataFrame) -> DataFrame:
    return FL.hashes(_binary(d))


@query(FILES + """, s AS (SELECT path, CASE k % 4 WHEN 0 THEN 'avi' WHEN 1 THEN 'mp4' ELSE 'unknown' END AS container, CASE k % 3 WHEN 0 THEN 'avi' WHEN 1 THEN 'mp4' END AS named FROM f)
SELECT path, container, coalesce(named <> container, false) AS mismatch FROM s""", "documents")
def src_sniff(d: DataFrame) -> DataFrame:
    return FL.containers(_binary(d))


@query(FILES + "SELECT sha256(body) || '  ' || replace(path, '/cases/out/', '') AS line FROM f", "documents")
def snk_manifest(d: DataFrame) -> DataFrame:
    return FL.manifest(_binary(d), "/cases/out").select(F.col("value").alias("line"))


# --- counts and overlaps


@query(marks_sql("pt") + """SELECT case_id, count(*) FILTER (WHERE fix AND NOT syn) AS fixes, count(*) FILTER (WHERE rec AND NOT coords) AS dropouts, count(*) FILTER (WHERE outlier_reason <> '') AS outliers,
 count(*) FILTER (WHERE outlier_reason IN ('coordinates', 'speed')) AS by_value FROM mk GROUP BY case_id""")
def agg_dropout_outlier_counts(p: DataFrame) -> DataFrame:
    """Fixes, dropouts and outliers of marked tracks."""
    from ..functions import predicates as P

    marked = outliers.mark_outliers(p)
    return marked.groupBy("case_id").agg(
        F.count_if(P.has_fix() & ~P.is_synthetic()).alias("fixes"), F.count_if(P.is_dropout()).alias("dropouts"), F.count_if("is_outlier").alias("outliers"),
        F.count_if(F.col("outlier_reason").isin("coordinates", "speed")).alias("by_value"),
    )


@query(QD.REGIONS + """, st AS (SELECT case_id, source_offset AS lo, lead(source_offset) OVER (PARTITION BY case_id ORDER BY source_offset) AS hi FROM pt WHERE NOT syn)
SELECT st.case_id, lo, hi, arg_max(kind, a) AS kind FROM st JOIN mr ON mr.case_id = st.case_id AND mr.a < hi AND mr.b > lo GROUP BY st.case_id, lo, hi""")
def jn_region_overlap(p: DataFrame) -> DataFrame:
    """Steps between records of a file with the last damaged region that they overlap."""
    from pyspark.sql import Window

    from ..functions import predicates as P

    at = Window.partitionBy("case_id").orderBy("source_offset")
    steps = p.filter(~P.is_synthetic()).select("case_id", F.col("source_offset").alias("lo"), F.lead("source_offset").over(at).alias("hi")).filter("hi is not null")
    return D.overlapped(steps, D.merged_kinds(QD.regions(p))).select("case_id", "lo", "hi", "kind")


# --- texts


@query("""WITH s AS (SELECT o_orderkey AS k, o_orderkey * 7919 % 400000 AS s FROM orders)
SELECT k, CASE WHEN s // 3600 > 0 THEN s // 3600 || ':' ELSE '' END || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock,
 CASE WHEN s >= 60 THEN s // 60 || ' min ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || ' s' ELSE s || ' s' END AS minutes,
 CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') WHEN s < 172800 THEN s // 3600 || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
  ELSE s // 86400 || 'd ' || lpad(CAST(s % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') END AS tick,
 CASE WHEN s < 120 THEN s || ' s' WHEN s < 86400 THEN CASE WHEN s >= 3600 THEN s // 3600 || ' h ' ELSE '' END || s % 3600 // 60 || ' min' ELSE CAST(round_even(s / 86400, 0) AS INTEGER) || ' d' END AS apart,
 CASE WHEN s < 120 THEN s || '.0 s' WHEN s < 7200 THEN CAST(round_even(s / 60, 0) AS INTEGER) || ' min' WHEN s < 172800 THEN printf('%.1f h', round(CAST(s AS DECIMAL(12, 4)) / 3600, 1)) ELSE CAST(round_even(s / 86400, 0) AS INTEGER) || ' d' END AS gap,
 strftime(TIMESTAMP '1970-01-01' + to_seconds(k * 7919 - 3000000), '%Y-%m-%d %H:%M:%S') || ' UTC' AS epoch FROM s""", "orders")
def fn_fmt_texts(o: DataFrame) -> DataFrame:
    """fn_fmt_dur, fn_fmt_gap, fn_fmt_offset, fn_fmt_epoch and fn_fmt_tick, and durations as clocks."""
    k = F.col("o_orderkey")
    s = (k * 7919 % 400000).cast("double")
    return o.select(
        k.alias("k"), X.clock_text(s).alias("clock"), X.minutes_text(s).alias("minutes"), X.tick_text(s).alias("tick"), X.offset_text(-s).alias("apart"), X.gap_text(s).alias("gap"), X.epoch_text(k * 7919 - 3000000).alias("epoch")
    )


CRITERIA = """c(vehicle, a1, a2, a3, st, d1, d2, d3, sp) AS (VALUES ('car', 12, 10, 8, 10, 14, 15, 15, 14), ('bus', 8, 7, 6, 8, 9, 10, 12, 9), ('truck', 7, 6, 5, 6, 8, 8, 8, 8)),
t AS (SELECT vehicle, 1 AS line_no, 'accel' AS kind, 'accel: from 6-10 km/h by ' || a1 || ', from 10-20 by ' || a2 || ', from over 20 by ' || a3 || ' km/h in a second' AS text FROM c
UNION ALL SELECT vehicle, 2, 'start', 'start: from up to 5 km/h by ' || st || ' km/h in a second' FROM c
UNION ALL SELECT vehicle, 3, 'decel', 'decel: from up to 30 km/h by ' || d1 || ', up to 50 by ' || d2 || ', over 50 by ' || d3 || ' km/h in a second, and still 6 km/h' FROM c
UNION ALL SELECT vehicle, 4, 'stop', 'stop: by ' || sp || ' km/h in a second to 5 km/h or less' FROM c)"""


@query(EVENTS + f""", {CRITERIA}, n AS (SELECT case_id, vehicle, kind, count(*) AS n FROM evt GROUP BY ALL)
SELECT n.case_id, n.vehicle, CAST(line_no AS INTEGER) AS line_no, text, n FROM n JOIN t ON t.vehicle = n.vehicle AND t.kind = n.kind""")
def op_criteria_text(p: DataFrame) -> DataFrame:
    """What each event of a case was judged by, line by line, and how many there are."""
    found = E.detect(p).groupBy("case_id", "vehicle", "kind").agg(F.count("*").alias("n"))
    lines = found.sparkSession.createDataFrame(E.criteria_lines(), "vehicle string, line_no int, text string").withColumn("kind", F.substring_index("text", ":", 1))
    return found.join(F.broadcast(lines), ["vehicle", "kind"]).select("case_id", "vehicle", "line_no", "text", "n")


@query(EVENTS + """, d AS (SELECT evt.*, a.speed_kmh AS va, b.speed_kmh AS vb, CAST(round_even(peak * 10, 0) AS BIGINT) AS p10 FROM evt JOIN pt a ON evt.case_id = a.case_id AND start_index = a.row_idx JOIN pt b ON evt.case_id = b.case_id AND end_index = b.row_idx)
SELECT case_id, vehicle, kind, start_index, CASE kind WHEN 'accel' THEN '#e67e22' WHEN 'start' THEN '#f1c40f' WHEN 'decel' THEN '#c0392b' ELSE '#8e44ad' END AS color, CASE WHEN p10 < 0 THEN '-' ELSE '+' END || abs(p10) // 10 || '.' || abs(p10) % 10 || ' km/h/s' AS rate,
 'rows ' || (start_index + 1) || '-' || (end_index + 1) AS rows FROM d""")
def fn_event_detail(p: DataFrame) -> DataFrame:
    """Colour and line of text of every event (also fn_event_label and fn_event_color)."""
    found = E.described(E.detect(p))
    parts = F.split("detail", ", ")
    return found.select("case_id", "vehicle", "kind", "start_index", "color", parts[0].alias("rate"), parts[2].alias("rows"))


@query("""SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 6 = 0 THEN 'brand' WHEN o_orderkey % 5 = 1 AND o_orderkey % 4 = 1 THEN 'front:engine_failed,rear:damaged' WHEN o_orderkey % 5 = 1 THEN 'front:engine_failed' WHEN o_orderkey % 4 = 1 THEN 'rear:damaged' WHEN o_orderkey % 7 = 2 THEN 'too_far' ELSE '' END AS problems,
 CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN 'damaged' WHEN o_orderkey % 5 = 1 THEN 'engine_failed' ELSE '' END AS code FROM orders""", "orders")
def op_compare_pair_full(o: DataFrame) -> DataFrame:
    """Files, extractions and GPS records of a pair, each step asked only where those before it found nothing."""
    k = F.col("o_orderkey")
    quick = o.select(k.alias("pair_id"), F.when(k % 6 == 0, F.array(F.lit("brand"))).otherwise(F.array().cast("array<string>")).alias("problems"))
    status = F.when((F.col("side") == "front") & (k % 5 == 1), "timed_out").when((F.col("side") == "rear") & (k % 4 == 1), "engine_failed").when(k % 3 == 0, "gps_untrusted").otherwise("ok")
    sides = o.select(k, F.explode(F.array(F.lit("front"), F.lit("rear"))).alias("side"))
    extracted = sides.select(k.alias("pair_id"), "side", status.alias("status"), (F.col("side") == "rear").alias("damaged"))
    by_gps = o.filter(k % 9 != 8).select(k.alias("pair_id"), F.when(k % 7 == 2, "too_far").otherwise("ok").alias("verdict"))
    by_gps = by_gps.unionByName(o.filter(k % 9 == 8).select(k.alias("pair_id"), F.when(k % 7 == 2, "too_far").alias("verdict")))
    out = pairs.compare_in_full(quick, extracted, by_gps)
    return out.select("pair_id", F.array_join("problems", ",").alias("problems"), "code")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return Q


def oracle_sql() -> dict[str, str]:
    return O
