"""Counters, summaries and the row sample of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from .sequence import EVENT_MAX_WINDOW_SEC, distinct_fixes, frame_detail, gps_slots, ordered, speed_rate_pairs

IMPACT_G = 2.0
MAX_TABLE_ROWS = 200


def report_counts(points: DataFrame) -> DataFrame:
    """Per case: rows by what they are; drop-outs, failures and outliers are exclusive of each other."""
    syn, drop, failed = P.is_synthetic(), P.is_dropout(), P.verification_failed()
    real = ~syn
    return points.groupBy("case_id").agg(
        F.count_if(real).alias("real"), F.count_if(F.col("recovery_state") == "damaged").alias("damaged"), F.count_if(F.col("recovery_state") == "interpolated").alias("interpolated"),
        F.count_if(real & P.has_fix()).alias("fix"), F.count_if(real & F.col("is_outlier")).alias("outlier"), F.count_if(real & drop).alias("dropout"),
        F.count_if(real & failed & ~drop).alias("failed"), F.count_if(real & ~P.has_gps_record() & ~P.has_coords()).alias("unrecorded"),
        F.count_if(real & ~drop & ~failed & F.coalesce("gps_checksum_ok", F.lit(False))).alias("ok"), F.count_if(real & ~drop & ~failed & F.col("gps_checksum_ok").isNull()).alias("unknown"),
    )


def speed_stats(points: DataFrame) -> DataFrame:
    """Average (over hundredths, so that order does not matter) and highest speed of distinct fixes; rows left out."""
    fixes = distinct_fixes(points).groupBy("case_id").agg(
        (F.sum(F.round(F.col("speed_kmh") * 100).cast("long")) / F.count("*") / 100).alias("avg_kmh"), F.max("speed_kmh").alias("max_kmh"), F.count("*").alias("n_used")
    )
    rows = points.groupBy("case_id").agg(F.count("*").alias("n_rows"))
    return rows.join(fixes, "case_id", "left").select("case_id", "avg_kmh", "max_kmh", F.coalesce("n_used", F.lit(0)).alias("n_used"), (F.col("n_rows") - F.coalesce("n_used", F.lit(0))).alias("n_excluded"))


def judged_pairs(points: DataFrame) -> DataFrame:
    """Number of speed changes that events were judged on; 0 means that nothing can be said."""
    pairs = speed_rate_pairs(points).groupBy("case_id").agg(F.count_if(F.col("dt") <= EVENT_MAX_WINDOW_SEC).alias("n"))
    return points.select("case_id").distinct().join(pairs, "case_id", "left").select("case_id", F.coalesce("n", F.lit(0)).alias("judged"))


def impact_summary(points: DataFrame) -> DataFrame:
    """Strongest impact (the first of equals), its time and 1-based row, and the number of rows at 2 g or more."""
    g = points.withColumn("g", P.g_magnitude()).filter("g is not null")
    best = F.min_by(F.struct("g", "start_time_sec", "row_idx"), F.struct(-F.col("g"), "row_idx"))
    out = g.groupBy("case_id").agg(best.alias("b"), F.count_if(F.col("g") >= IMPACT_G).alias("n_impacts"))
    return out.select("case_id", F.col("b.g").alias("max_g"), F.col("b.start_time_sec").alias("at_sec"), (F.col("b.row_idx") + 1).alias("row_no"), "n_impacts")


def gps_interval(points: DataFrame) -> DataFrame:
    """Recording interval: median of the gaps between records, mean of those within 30 % of it, snapped to tenths, 0.1 to 10 s."""
    slots = gps_slots(points).filter(~P.is_synthetic() & F.col("start_time_sec").isNotNull())
    gap = (F.col("t_us") - F.lag("t_us").over(ordered())).cast("long")
    gaps = slots.select("case_id", gap.alias("us")).filter("us > 0")
    mid = gaps.groupBy("case_id").agg(F.median("us").alias("mid"))
    near = gaps.join(mid, "case_id").filter(F.abs(F.col("us") - F.col("mid")) <= 0.3 * F.col("mid"))
    mean = near.groupBy("case_id").agg((F.sum("us") / F.count("*") / F.lit(1e6)).alias("mean"))
    snapped = F.bround(F.col("mean") * 10) / 10
    value = F.when((snapped > 0) & (F.abs(F.col("mean") - snapped) <= 0.03 * snapped), snapped).otherwise(F.col("mean"))
    out = points.select("case_id").distinct().join(mean, "case_id", "left")
    return out.select("case_id", F.coalesce(F.least(F.lit(10.0), F.greatest(F.lit(0.1), F.when(F.col("mean").isNotNull(), value))), F.lit(1.0)).alias("interval_sec"))


def bounding_box(points: DataFrame) -> DataFrame:
    fix = points.filter(P.has_fix())
    return fix.groupBy("case_id").agg(*[f(c).alias(f"{n}_{s}") for c, s in (("latitude", "lat"), ("longitude", "lon")) for n, f in (("min", F.min), ("max", F.max))])


def track_status(points: DataFrame) -> DataFrame:
    return points.groupBy("case_id").agg(
        F.count_if(F.coalesce("time_estimated", F.lit(False))).alias("estimated"), F.count_if(P.is_synthetic()).alias("damaged"), F.count_if(P.is_dropout()).alias("dropout"), F.count_if("is_outlier").alias("outlier")
    )


def segment_ends(points: DataFrame) -> DataFrame:
    """Last fix of every clip, for cases of more than one."""
    fix = points.filter(P.has_fix())
    ends = fix.groupBy("case_id", "segment_index").agg(F.max_by(F.struct("latitude", "longitude", "row_idx"), "row_idx").alias("e"))
    many = fix.groupBy("case_id").agg(F.count_distinct("segment_index").alias("n")).filter("n > 1").select("case_id")
    return ends.join(many, "case_id").select("case_id", "segment_index", "e.row_idx", "e.latitude", "e.longitude")


def segment_spans(points: DataFrame) -> DataFrame:
    """Length of every clip: the latest end, or start where the end is missing or 0."""
    end = F.coalesce(F.when(F.col("end_time_sec") != 0, F.col("end_time_sec")), F.col("start_time_sec"))
    return points.groupBy("case_id", "segment_index").agg(F.coalesce(F.max(end), F.lit(0.0)).alias("span"))


def sampled_rows(points: DataFrame, events: DataFrame, most: int = MAX_TABLE_ROWS) -> DataFrame:
    """At most ``most`` rows of each case for its table.

    The pool is all rows, or GPS slots and impacts where rows come in frames.
    Rows in events and impacts come first; if they fill the table, a quarter of
    it goes to the strongest impacts. The rest is an even sample.
    """
    rows = points.select("case_id", "row_idx", P.g_magnitude().alias("g"))
    slots = gps_slots(points).select("case_id", "row_idx", F.lit(True).alias("slot"))
    inside = events.select("case_id", F.explode(F.sequence("start_index", "end_index")).alias("row_idx")).distinct().withColumn("ev", F.lit(True))
    pool = rows.join(slots, ["case_id", "row_idx"], "left").join(inside, ["case_id", "row_idx"], "left").join(frame_detail(points).select("case_id", "frame_detail"), "case_id")
    impact = F.coalesce(F.col("g") >= IMPACT_G, F.lit(False))
    pool = pool.withColumn("impact", impact).filter(~F.col("frame_detail") | F.col("slot") | F.col("impact"))
    pool = pool.withColumn("flagged", F.col("impact") | F.coalesce("ev", F.lit(False)))
    case = Window.partitionBy("case_id")
    strongest = F.row_number().over(case.orderBy(F.col("impact").desc(), F.col("g").desc_nulls_last(), "row_idx"))
    pool = pool.withColumn("n_pool", F.count("*").over(case)).withColumn("n_flagged", F.count_if("flagged").over(case)).withColumn("strength", strongest)
    full = F.col("n_flagged") >= most
    first = F.when(full, F.col("impact") & (F.col("strength") <= max(1, most // 4))).otherwise(F.col("flagged"))
    pool = pool.withColumn("first", first).withColumn("rest", ~F.col("first") & F.when(full, F.col("flagged")).otherwise(F.lit(True)))
    pool = pool.withColumn("count", most - F.count_if("first").over(case)).withColumn("n_rest", F.count_if("rest").over(case))
    pool = pool.withColumn("place", F.sum(F.col("rest").cast("int")).over(case.orderBy("row_idx")) - 1)
    # Place p is taken if round_half_even(i * (n - 1) / (count - 1)) = p for some i below count.
    step = (F.col("n_rest") - 1) / (F.col("count") - 1)
    guess = F.floor(F.col("place") / step)
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        i = guess + d
        hit = hit | ((i >= 0) & (i < F.col("count")) & (F.bround(i * (F.col("n_rest") - 1) / (F.col("count") - 1)) == F.col("place")))
    sampled = F.when(F.col("count") <= 0, False).when(F.col("count") == 1, F.col("place") == 0).otherwise(hit)
    keep = (F.col("n_pool") <= most) | F.col("first") | (F.col("rest") & sampled)
    return pool.filter(keep).select("case_id", "row_idx", "flagged")
