"""Playback times of rows that have none, from the GPS clock.

Windows find the clock a case goes by, its first anchor and where its recording
ends. What is left to a walk is short: every anchor says for itself what time it
is, so rows between two anchors depend on nothing before them. Days are counted
through midnight only in cases where a clock falls back by half a day at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import times as T
from .sequence import ordered, so_far

#: Fixed values.
BACKSTEP_SEC = 5.0
FORWARD_GAP_SEC = 600.0
HALF_DAY = 43_200
SOURCES = ("gps_utc_estimated", "gps_elapsed_estimated", "gps_abs_time_estimated")
CLOCKS = ("utc", "elapsed", "abs")


def through_midnight(clock: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Seconds of the day, NaN where unknown, made to go on over midnight: one day at a time.

    A day ends before the first value half a day below the latest anchor's.
    """
    out = np.full(len(clock), np.nan)
    known = np.flatnonzero(~np.isnan(clock))
    value, held = clock[known], anchor[known]
    at, days, latest = 0, 0, -np.inf
    while at < len(known):
        today = value[at:] + days * T.DAY
        reached = np.maximum.accumulate(np.where(held[at:], today, -np.inf))
        before = np.maximum(np.concatenate(([-np.inf], reached[:-1])), latest)
        over = np.flatnonzero(today < before - HALF_DAY)
        over = over[over > 0] if days else over  # the value that began this day stays in it
        n = int(over[0]) if len(over) else len(today)
        out[known[at : at + n]] = today[:n]
        latest = max(latest, *reached[:n].tolist()) if n else latest
        at, days = at + n, days + 1
    return out


def _days_counted(rows: DataFrame) -> DataFrame:
    """``utc`` of cases without dates that pass midnight, counted on; the others as they are."""
    earlier = F.max(F.when(F.col("anchor"), F.col("utc"))).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    falls = ~F.col("_dated") & F.coalesce(F.col("utc") < earlier - HALF_DAY, F.lit(False))
    rows = rows.withColumn("_falls", falls).withColumn("_passes", F.max("_falls").over(Window.partitionBy("case_id")))

    def count(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("row_idx")
        return pd.DataFrame({"case_id": g["case_id"], "row_idx": g["row_idx"], "_on": through_midnight(g["utc"].to_numpy(float), g["anchor"].to_numpy(bool))})

    schema = f"case_id {dict(rows.dtypes)['case_id']}, row_idx long, _on double"
    on = rows.filter("_passes").select("case_id", "row_idx", "utc", "anchor").groupBy("case_id").applyInPandas(count, schema)
    return rows.join(on, ["case_id", "row_idx"], "left").withColumn("utc", F.coalesce(F.nanvl("_on", F.lit(None).cast("double")), "utc")).drop("_on", "_falls", "_passes")


def _between_anchors(rows: DataFrame) -> DataFrame:
    """(case_id, row_idx, _now, _lost): what readings that are no anchors say, one after the other from their anchor on.

    A reading counts if it is at most 5 s before and 600 s after the time so far.
    """
    readings = rows.filter(F.col("_in") & F.col("_rel").isNotNull() & ~F.col("anchor") & (F.col("_section") > 0))
    runs = readings.groupBy("case_id", "_section").agg(F.first("_from").alias("_from"), F.array_sort(F.collect_list(F.struct("row_idx", "_rel"))).alias("_run"))
    walk = f"""aggregate(_run, struct(_from AS now, cast(array() AS array<struct<row_idx: bigint, now: double, lost: boolean>>) AS said),
      (a, x) -> named_struct(
        'now', if(x._rel - a.now BETWEEN -{BACKSTEP_SEC}D AND {FORWARD_GAP_SEC}D AND x._rel >= 0, x._rel, a.now),
        'said', array_append(a.said, named_struct('row_idx', x.row_idx,
          'now', if(x._rel - a.now BETWEEN -{BACKSTEP_SEC}D AND {FORWARD_GAP_SEC}D AND x._rel >= 0, x._rel, a.now),
          'lost', x._rel - a.now BETWEEN -{BACKSTEP_SEC}D AND {FORWARD_GAP_SEC}D AND x._rel < 0))),
      a -> a.said)"""
    said = runs.select("case_id", F.explode(F.expr(walk)).alias("s"))
    return said.select("case_id", "s.row_idx", F.col("s.now").alias("_now"), F.col("s.lost").alias("_lost"))


def _placed(keyed: DataFrame) -> DataFrame:
    """(case_id, row_idx, _t, source): seconds since the first anchor, null for rows of another recording."""
    case = Window.partitionBy("case_id")
    chosen, source = F.lit(None).cast("double"), F.lit(None).cast("string")
    for clock, name in reversed(list(zip(CLOCKS, SOURCES, strict=True))):
        has = F.max(F.col("anchor") & F.col(clock).isNotNull()).over(case)
        chosen, source = F.when(has, F.col(clock)).otherwise(chosen), F.when(has, F.lit(name)).otherwise(source)
    rows = keyed.withColumn("_key", chosen).withColumn("source", source).filter("source is not null")
    held = F.when(F.col("anchor"), F.col("_key"))
    latest = F.max(held).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    breaks = (held < latest - BACKSTEP_SEC) | (held > latest + FORWARD_GAP_SEC)
    first = F.first(held, ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_rel", F.col("_key") - first).withColumn("_breaks", F.coalesce(breaks, F.lit(False)))
    rows = rows.withColumn("_in", ~F.max("_breaks").over(so_far()))
    own = F.when(F.col("_in") & F.col("anchor") & (F.col("_rel") >= 0), F.col("_rel"))
    rows = rows.withColumn("_own", own).withColumn("_section", F.count("_own").over(so_far())).withColumn("_from", F.last("_own", ignorenulls=True).over(so_far()))
    rows = rows.join(_between_anchors(rows), ["case_id", "row_idx"], "left")
    now = F.coalesce(F.last(F.coalesce("_own", "_now"), ignorenulls=True).over(so_far()), F.lit(0.0))
    begun = F.col("_section") > 0
    lost: Column = (
        F.when(~F.col("_in"), True).when(F.col("_rel").isNotNull() & F.col("anchor"), F.col("_rel") < 0)
        .when(F.col("_rel").isNotNull(), ~begun | F.coalesce("_lost", F.lit(False))).otherwise(~begun & F.col("record") & ~F.col("anchor"))
    )
    return rows.select("case_id", "row_idx", F.when(~lost, now).alias("_t"), "source")


def estimate_times(points: DataFrame) -> DataFrame:
    """Cases without any playback time get one from UTC, else elapsed seconds, else device time.

    Adds ``excluded``: rows of an older recording, which stay without a time.
    """
    dates = P.is_time_anchor() & T.date_days(F.col("gps_date")).isNotNull() & T.utc_seconds(F.col("gps_utc_time")).isNotNull()
    case = Window.partitionBy("case_id")
    rows = points.withColumn("_timed", F.max(F.col("start_time_sec").isNotNull()).over(case)).withColumn("_dated", F.max(dates).over(case))
    day = T.date_days(F.col("gps_date"))
    utc = T.utc_seconds(F.col("gps_utc_time"))
    keyed = rows.filter("not _timed").select(
        "case_id", "row_idx", "_dated", F.when(F.col("_dated"), day * F.lit(86400.0) + utc).otherwise(utc).alias("utc"),
        F.when(P.finite("gps_elapsed"), F.col("gps_elapsed")).alias("elapsed"), T.abs_time_seconds(F.col("gps_abs_time")).cast("double").alias("abs"),
        P.is_time_anchor().alias("anchor"), P.has_gps_record().alias("record"),
    )
    found = _placed(_days_counted(keyed))
    out = rows.join(found, ["case_id", "row_idx"], "left")
    given = F.col("_t").isNotNull()
    return (
        out.withColumn("excluded", ~F.col("_timed") & F.col("source").isNotNull() & ~given).withColumn("time_estimated", F.coalesce("time_estimated", F.lit(False)) | given)
        .withColumn("time_source", F.when(given, F.col("source")).otherwise(F.col("time_source"))).withColumn("start_time_sec", F.coalesce("start_time_sec", "_t"))
        .withColumn("end_time_sec", F.coalesce("end_time_sec", F.col("_t") + 1)).drop("_timed", "_dated", "_t", "source")
    )
