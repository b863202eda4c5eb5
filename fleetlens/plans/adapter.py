"""Telemetry from the ``events`` table: one case per user, one row per event, integers decide everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track rows with case_id, row_idx, segment_index and t_us."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    by_case = Window.partitionBy("user_id").orderBy("ts", "event_id")
    # Below the window, where no later filter can take a copy of it: the JSON is parsed once a row.
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("k")
    e = raw.select("user_id", "ts", "event_id", k, "event_type", "value")
    e = e.select(F.col("user_id").alias("case_id"), (F.row_number().over(by_case) - 1).cast("long").alias("rn"), "k", "event_type", "value")
    e = e.withColumn("dmg", F.expr("event_type = 'purchase' and k % 9 = 0")).withColumn("v", F.expr("k % 11 = 0"))
    e = e.withColumn("utc", F.expr("rn - if(k % 6 = 5 and rn > 0, 1, 0)"))
    blank = "case when dmg or v then null else"
    return e.select(
        "case_id", F.col("rn").alias("row_idx"), F.expr("rn div 30").cast("int").alias("segment_index"),
        F.expr("(rn * 10 + k % 5) * 100000").alias("t_us"), F.expr("(rn * 10 + k % 5) / 10e0").alias("start_time_sec"),
        F.expr("(rn * 10 + k % 5) / 10e0 + 1e0").alias("end_time_sec"), F.lit("stts").alias("time_source"),
        F.expr(f"{blank} 37.5e0 + rn * 1e-4 + case when k % 17 = 3 then 2e-2 else 0e0 end end").alias("latitude"),
        F.expr(f"{blank} 127e0 + (k % 10) * 1e-5 end").alias("longitude"),
        F.expr(f"{blank} floor(least(value, 480e0) / 4e0 * 100e0 + 5e-1) / 100e0 end").alias("speed_kmh"),
        F.expr(f"{blank} case when k % 8 = 1 then null else (k % 36) * 10e0 end end").alias("track_deg"),
        F.expr("case when dmg then null else '2024-06-18' end").alias("gps_date"),
        F.expr("case when dmg then null else concat('00', lpad(cast(utc div 60 as string), 2, '0'), lpad(cast(utc % 60 as string), 2, '0'), '.00') end").alias("gps_utc_time"),
        F.expr("case when dmg or k % 7 = 0 then null else k % 13 <> 0 end").alias("gps_checksum_ok"),
        F.expr("case when dmg or k % 5 = 1 then null else k % 19 <> 0 end").alias("gps_trusted"),
        F.expr("case when dmg then '' when v then 'V' else 'A' end").alias("gps_status"),
        F.lit(None).cast("string").alias("gps_abs_time"), F.lit(None).cast("double").alias("gps_elapsed"),
        F.expr("case when k % 4 = 0 then null else (k % 50) / 20e0 end").alias("x_g"), F.lit(0.1).alias("y_g"), F.lit(1.0).alias("z_g"),
        F.expr("case when k % 3 = 0 then (k % 40) / 16e0 end").alias("x_g_cal"), F.lit(0.2).alias("y_g_cal"), F.lit(0.9).alias("z_g_cal"),
        F.expr("rn * 1000").alias("source_offset"), F.expr("case when dmg then 'damaged' else '' end").alias("recovery_state"),
        F.lit(False).alias("time_estimated"), F.lit(False).alias("is_outlier"),
    )


#: The same rows for DuckDB, as the first common table expressions of an oracle.
ORACLE_CTE = """
ev0 AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn,
  coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k, event_type, value FROM events),
ev AS (SELECT *, (event_type = 'purchase' AND k % 9 = 0) AS dmg, (k % 11 = 0) AS v,
  rn - CASE WHEN k % 6 = 5 AND rn > 0 THEN 1 ELSE 0 END AS utc FROM ev0),
tp AS (SELECT case_id, rn AS row_idx, CAST(rn // 30 AS INTEGER) AS segment_index, (rn * 10 + k % 5) * 100000 AS t_us,
  (rn * 10 + k % 5) / 10e0 AS start_time_sec, (rn * 10 + k % 5) / 10e0 + 1e0 AS end_time_sec, 'stts' AS time_source,
  CASE WHEN dmg OR v THEN NULL ELSE 37.5e0 + rn * 1e-4 + CASE WHEN k % 17 = 3 THEN 2e-2 ELSE 0e0 END END AS latitude,
  CASE WHEN dmg OR v THEN NULL ELSE 127e0 + (k % 10) * 1e-5 END AS longitude,
  CASE WHEN dmg OR v THEN NULL ELSE floor(least(value, 480e0) / 4e0 * 100e0 + 5e-1) / 100e0 END AS speed_kmh,
  CASE WHEN dmg OR v OR k % 8 = 1 THEN NULL ELSE (k % 36) * 10e0 END AS track_deg,
  CASE WHEN dmg THEN NULL ELSE '2024-06-18' END AS gps_date,
  CASE WHEN dmg THEN NULL ELSE '00' || lpad(CAST(utc // 60 AS VARCHAR), 2, '0') || lpad(CAST(utc % 60 AS VARCHAR), 2, '0') || '.00' END AS gps_utc_time,
  CASE WHEN dmg OR k % 7 = 0 THEN NULL ELSE k % 13 <> 0 END AS gps_checksum_ok,
  CASE WHEN dmg OR k % 5 = 1 THEN NULL ELSE k % 19 <> 0 END AS gps_trusted,
  CASE WHEN dmg THEN '' WHEN v THEN 'V' ELSE 'A' END AS gps_status,
  CASE WHEN k % 4 = 0 THEN NULL ELSE (k % 50) / 20e0 END AS x_g, 0.1e0 AS y_g, 1e0 AS z_g,
  CASE WHEN k % 3 = 0 THEN (k % 40) / 16e0 END AS x_g_cal, 0.2e0 AS y_g_cal, 0.9e0 AS z_g_cal,
  rn * 1000 AS source_offset, CASE WHEN dmg THEN 'damaged' ELSE '' END AS recovery_state, k FROM ev),
pt AS (SELECT *, recovery_state IN ('damaged', 'interpolated') AS syn, latitude IS NOT NULL AND longitude IS NOT NULL AS coords,
  coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND coalesce(gps_checksum_ok, true) AND coalesce(gps_trusted, true), false) AS fix,
  (trim(coalesce(gps_utc_time, '')) <> '' OR trim(coalesce(gps_date, '')) <> '' OR trim(coalesce(gps_status, '')) <> '') AS rec,
  coalesce(sqrt(x_g_cal * x_g_cal + y_g_cal * y_g_cal + z_g_cal * z_g_cal), sqrt(x_g * x_g + y_g * y_g + z_g * z_g)) AS g,
  coalesce(gps_date, '') || '/' || trim(coalesce(gps_utc_time, '')) AS rkey FROM tp)
"""
