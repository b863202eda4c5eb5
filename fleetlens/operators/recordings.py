"""Recordings as a whole: stored tracks, where one recording ends, clip records, summaries and the analysis from rows to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import times as T
from ..functions.strings import strip
from ..sources.shared import checkpointed
from . import damage, events, outliers
from .sequence import with_row_idx
from .times import estimate_times

#: Fixed values.
BACK_SEC = 1
JUMP_FACTOR = 3
JUMP_SEC = 600


def stored_track(rows: DataFrame) -> DataFrame:
    """Rows of a stored timeline in track order, with times estimated where a case has none, and the first time source given."""
    track = with_row_idx(rows)
    track = estimate_times(track)
    track = with_row_idx(track.withColumnRenamed("row_idx", "_at"), tie="_at").drop("_at")
    own = Window.partitionBy("case_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return track.withColumn("time_source", F.coalesce(F.first(F.nullif("time_source", F.lit("")), ignorenulls=True).over(own), F.lit("")))


def map_points(rows: DataFrame) -> DataFrame:
    """Residue rows that a map can show: those with a time, as the others may belong to any recording."""
    return rows.filter(F.col("start_time_sec").isNotNull())


def nominal_rate(counts: DataFrame, keys: list[str], timescale: Column) -> DataFrame:
    """fps of counts(length, n): by the length that over half of the samples have, else by the mean."""
    used = counts.filter("length > 0 and n > 0").groupBy(*keys).agg(F.max_by("length", "n").alias("length"), F.max("n").alias("most"), F.sum("n").alias("n"), F.sum(F.col("length") * F.col("n")).alias("sum"))
    return used.withColumn("fps", F.when(F.col("most") * 2 > F.col("n"), timescale / F.col("length")).otherwise(F.col("n") * timescale / F.col("sum")))


def nearest_names(rows: DataFrame, keys: list[str], own: Column, number: Column) -> DataFrame:
    """Rows with ``rank``: by the distance of their name's number, then by name."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs(number - own), "name")))


def recording_cut(points: DataFrame, gaps: DataFrame) -> DataFrame:
    """(case_id, cut_at, reason): the first of gaps(case_id, a, b, kind) where another recording begins.

    The clock before and after decides: it runs back, or jumps further than three
    times what the lost bytes explain and ten minutes. Without a clock on both
    sides a stretch of zeros is taken as the same recording, any other ends it.
    """
    utc = T.date_days(F.col("gps_date")) * T.DAY + T.parse_time(F.col("gps_utc_time"))
    sure = P.not_false("gps_checksum_ok") & P.not_false("gps_trusted") & (F.upper(strip("gps_status")) == "A") & ~P.is_synthetic()
    anchors = points.filter(sure & utc.isNotNull()).select("case_id", F.col("source_offset").alias("at"), F.struct("source_offset", utc.alias("utc")).alias("anchor"))
    # Gaps stand among the anchors at both of their ends, so the nearest ones are the last and the next in order.
    starts = gaps.select("case_id", F.col("a").alias("at"), F.struct("a", "b", "kind").alias("gap"), F.lit(0).alias("side"))
    ends = gaps.select("case_id", F.col("b").alias("at"), F.struct("a", "b", "kind").alias("gap"), F.lit(2).alias("side"))
    stops = anchors.withColumn("gap", F.lit(None).cast(starts.schema["gap"].dataType)).withColumn("side", F.lit(1))
    rows = starts.union(ends).withColumn("anchor", F.lit(None).cast(anchors.schema["anchor"].dataType)).unionByName(stops)
    # A gap's start comes before an anchor at its place, its end as well.
    # Of anchors at one place the one with the latest clock is nearest before, that with the earliest nearest after.
    case = Window.partitionBy("case_id")
    order = case.orderBy("at", F.col("side") == 1, "anchor.utc")
    back = case.orderBy(F.desc("at"), F.col("side") != 1, F.desc("anchor.utc"))
    before = F.last("anchor", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("anchor", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    first = F.min("anchor").over(case)
    seen = rows.select("case_id", "gap", "side", before.alias("before"), after.alias("after"), first.alias("first")).filter("gap is not null")
    both = seen.groupBy("case_id", "gap").agg(F.max(F.when(F.col("side") == 0, F.col("before"))).alias("before"), F.max(F.when(F.col("side") == 2, F.col("after"))).alias("after"), F.max("first").alias("first"))
    du = F.col("after.utc") - F.col("before.utc")
    rate = (F.col("before.source_offset") - F.col("first.source_offset")) / (F.col("before.utc") - F.col("first.utc"))
    rate = F.when((F.col("before.utc") > F.col("first.utc")) & (F.col("before.source_offset") > F.col("first.source_offset")), rate)
    expected = (F.col("gap.b") - F.col("gap.a")) / rate
    reason = F.when(du < -BACK_SEC, "back").when(du > F.coalesce(expected * JUMP_FACTOR, F.lit(0.0)) + JUMP_SEC, "jump").when(du.isNull() & (F.col("gap.kind") != "zero"), "uncertain")
    cuts = both.withColumn("reason", reason).filter("reason is not null")
    return cuts.groupBy("case_id").agg(F.min("gap.a").alias("cut_at"), F.min_by("reason", "gap.a").alias("reason"))


def segment_records(points: DataFrame) -> DataFrame:
    """What is kept of every clip: label, folder, place in the whole, length, and what came of its GPS."""
    status = F.when(F.max(P.has_fix()), "ok").when(F.max(P.has_gps_record()), "no_fix").otherwise("no_gps")
    number = F.col("segment_index") + 1
    out = points.groupBy("case_id", "segment_index").agg(
        F.min("start_time_sec").alias("offset_sec"), F.round(F.max("end_time_sec") - F.min("start_time_sec"), 3).alias("duration_sec"), status.alias("status")
    )
    return out.select("case_id", "segment_index", F.concat(F.lit("clip "), number).alias("label"), F.concat(F.lit("seg"), F.lpad(number.cast("string"), 2, "0")).alias("output_subdir"), "offset_sec", "duration_sec", "status")


def damage_summary(cases: DataFrame, regions: DataFrame) -> DataFrame:
    """(case_id, line_no, code, n, bytes): what is wrong with a file, line by line; one line ``none`` if nothing is."""
    counts = regions.groupBy("case_id", "kind").agg(F.count("*").alias("n"), F.sum(F.col("b") - F.col("a")).alias("bytes"))
    gap = F.col("kind") == "gap"
    found = counts.select("case_id", F.when(gap, 1).otherwise(2).alias("line_no"), F.when(gap, "unreadable").otherwise("zeroed").alias("code"), "n", "bytes")
    zero = F.lit(0).cast("long")
    return found.union(cases.join(regions.select("case_id").distinct(), "case_id", "left_anti").select("case_id", F.lit(1), F.lit("none"), zero, zero))


def slot_start_text(basis: Column, began: Column) -> Column:
    """When a clip began: display time of the GPS clock, or the local time in its name; '' if unknown."""
    shown = F.date_format(F.when(basis == "gps", began + F.expr("interval 9 hours")).otherwise(began), "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(F.when(basis == "gps", shown).otherwise(F.concat(shown, F.lit(" (file name)"))), F.lit(""))


def analyse(points: DataFrame, regions: DataFrame, durations: DataFrame) -> DataFrame:
    """A row per case: rows, fixes, outliers, rows made for lost seconds, and events of cars by kind.

    Times are estimated where a case has none, outliers marked, damage applied, and events detected, each on what the step before has left.
    """
    timed = checkpointed(estimate_times(points).filter("not excluded").drop("excluded"))
    marked = checkpointed(outliers.mark_outliers(timed))
    lost = checkpointed(damage.intervals(marked, checkpointed(regions), durations))
    whole = checkpointed(damage.apply_marks(marked, lost))
    found = events.kinds_of(whole).groupBy("case_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("start", "stop", "accel", "decel")])
    rows = whole.groupBy("case_id").agg(
        F.count("*").alias("n_rows"), F.count_if(P.has_fix() & ~P.is_synthetic()).alias("n_fixes"), F.count_if(F.coalesce("is_outlier", F.lit(False))).alias("n_outliers"), F.count_if(P.is_synthetic()).alias("n_made")
    )
    return rows.join(found, "case_id", "left").fillna(0, ["n_start", "n_stop", "n_accel", "n_decel"])
