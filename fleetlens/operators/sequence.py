"""Sequence operators over a case's rows: windows partitioned by case, never by nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import geo
from ..functions import predicates as P

RATE_WINDOW_US = 850_000
MAX_GAP_SEC = 5.0
EVENT_MAX_WINDOW_SEC = 1.5


def ordered() -> WindowSpec:
    """Rows of a case in track order."""
    return Window.partitionBy("case_id").orderBy("row_idx")


def so_far() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def long_before() -> WindowSpec:
    """Rows of a case at least one rate window before, by time."""
    return Window.partitionBy("case_id").orderBy("t_us").rangeBetween(Window.unboundedPreceding, -RATE_WINDOW_US)


def long_after() -> WindowSpec:
    """Rows of a case at least one rate window after, by time."""
    return Window.partitionBy("case_id").orderBy(F.col("t_us").desc()).rangeBetween(Window.unboundedPreceding, -RATE_WINDOW_US)


def with_row_idx(rows: DataFrame, case: str = "case_id", tie: str = "file_row") -> DataFrame:
    """Position in the track: by time, rows without a time last, ties by file order."""
    w = Window.partitionBy(case).orderBy(F.col("start_time_sec").isNull(), "start_time_sec", tie)
    return rows.withColumn("row_idx", F.row_number().over(w).cast("long") - 1)


def run_starts(rows: DataFrame, key: Column) -> DataFrame:
    """The first row of each run of equal keys."""
    return rows.withColumn("_key", key).withColumn("_before", F.lag("_key").over(ordered())).filter(~F.col("_key").eqNullSafe(F.col("_before"))).drop("_before")


def distinct_fixes(points: DataFrame) -> DataFrame:
    """Usable rows, the first of each run of one GPS record."""
    return run_starts(points.filter(P.usable_speed()), P.record_key()).drop("_key")


def speed_rate_pairs(points: DataFrame, max_gap_sec: float = MAX_GAP_SEC) -> DataFrame:
    """Each distinct fix with the nearest one a rate window earlier: prev_idx, cur_idx, dt, rate (km/h per second), v0, v1.

    Pairs across a clip boundary or a synthetic row are left out. The search
    itself runs over the whole case.
    """
    counted = points.withColumn("_syn", F.sum(P.is_synthetic().cast("int")).over(so_far()))
    fixes = distinct_fixes(counted)
    prev = F.max(F.struct("t_us", "row_idx", "speed_kmh", "segment_index", "_syn")).over(long_before())
    dt = (F.col("t_us") - F.col("p.t_us")) / F.lit(1e6)
    pairs = fixes.withColumn("p", prev).filter(F.col("p").isNotNull()).withColumn("dt", dt)
    pairs = pairs.filter((F.col("dt") <= max_gap_sec) & (F.col("p.segment_index") == F.col("segment_index")) & (F.col("p._syn") == F.col("_syn")))
    return pairs.select(
        "case_id", F.col("p.row_idx").alias("prev_idx"), F.col("row_idx").alias("cur_idx"), "dt",
        ((F.col("speed_kmh") - F.col("p.speed_kmh")) / F.col("dt")).alias("rate"), F.col("p.speed_kmh").alias("v0"), F.col("speed_kmh").alias("v1"),
    )


def accelerations(points: DataFrame) -> DataFrame:
    """Every row with its rate window: accel (m/s2, null beyond 1.5 s), window_accel and window_sec."""
    pairs = speed_rate_pairs(points).select(F.col("case_id").alias("_c"), "cur_idx", "dt", "rate")
    joined = points.join(pairs, (F.col("case_id") == F.col("_c")) & (F.col("row_idx") == F.col("cur_idx")), "left")
    accel = F.col("rate") / 3.6
    return joined.select("case_id", "row_idx", F.when(F.col("dt") <= EVENT_MAX_WINDOW_SEC, accel).alias("accel"), accel.alias("window_accel"), F.col("dt").alias("window_sec"))


def gps_slots(points: DataFrame) -> DataFrame:
    """Rows where the GPS record changes; every synthetic row is one of its own."""
    rows = points.filter(P.has_gps_record() | P.has_coords() | P.is_synthetic())
    key = F.struct(F.when(P.is_synthetic(), F.col("row_idx")).alias("own"), F.when(~P.is_synthetic(), P.record_key()).alias("key"))
    return run_starts(rows, key).drop("_key")


def frame_detail(points: DataFrame) -> DataFrame:
    """Per case: rows and slots that are real, and whether rows come much more often than GPS records."""
    slots = gps_slots(points).filter(~P.is_synthetic()).groupBy("case_id").agg(F.count("*").alias("slots"))
    real = points.groupBy("case_id").agg(F.count_if(~P.is_synthetic()).alias("real_rows"))
    out = real.join(slots, "case_id", "left").withColumn("slots", F.coalesce("slots", F.lit(0)))
    detail = (F.col("slots") > 0) & (F.col("real_rows") - F.col("slots") >= 5) & (F.col("real_rows") >= 1.5 * F.col("slots"))
    return out.withColumn("frame_detail", detail)


def forward_fill(points: DataFrame) -> DataFrame:
    """latitude_last, longitude_last and speed_kmh_last of the latest fix, as one unit."""
    fix = F.when(P.has_fix(), F.struct("latitude", "longitude", "speed_kmh"))
    rows = points.drop("latitude_last", "longitude_last", "speed_kmh_last").withColumn("_f", F.last(fix, ignorenulls=True).over(so_far()))
    return rows.select("*", *[F.col(f"_f.{c}").alias(f"{c}_last") for c in ("latitude", "longitude", "speed_kmh")]).drop("_f")


def is_record() -> Column:
    """Whether a row is a fix with a time."""
    return P.has_fix() & P.finite("start_time_sec") & ~P.is_synthetic()


def record_rows(points: DataFrame) -> DataFrame:
    """Fixes with a time, numbered by runs that repeat one record and place (``group_id``); ``_key`` is what they repeat.

    Other rows are left out after the windows: a filter before them would repeat whatever the columns are made of.
    """
    key = F.struct(P.record_key().alias("r"), "latitude", "longitude")
    marked = points.withColumn("_record", is_record()).withColumn("_key", F.when(F.col("_record"), key))
    before = F.last("_key", ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("_new", (F.col("_record") & ~F.col("_key").eqNullSafe(before)).cast("int"))
    return marked.withColumn("group_id", F.sum("_new").over(so_far())).filter("_record").drop("_new", "_record")


def record_groups(points: DataFrame) -> DataFrame:
    """The runs of ``record_rows``: group_id, first row, time, place and speed, number of rows."""
    return record_rows(points).groupBy("case_id", "group_id").agg(
        F.min("row_idx").alias("row_idx"), F.max("row_idx").alias("last_idx"), F.count("*").alias("n_rows"),
        *[F.min_by(c, "row_idx").alias(c) for c in ("t_us", "start_time_sec", "latitude", "longitude", "speed_kmh", "segment_index")],
    )


def headings(points: DataFrame) -> DataFrame:
    """Direction of travel of every fix row: while moving the device's, else the bearing over 2 m or more; else the last one.

    The carried heading is dropped where time runs back or stands still for over five seconds.
    """
    fixes = points.filter(P.has_fix() & F.col("start_time_sec").isNotNull())
    before = [F.lag(c).over(ordered()).alias(f"_p_{c}") for c in ("t_us", "latitude", "longitude")]
    rows = fixes.select("*", *before)
    gap = (F.col("t_us") - F.col("_p_t_us")) / F.lit(1e6)
    rows = rows.withColumn("_new", F.coalesce((gap < 0) | (gap > 5), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(so_far()))
    here = [F.col(c) for c in ("latitude", "longitude")]
    there = [F.col(f"_p_{c}") for c in ("latitude", "longitude")]
    moving = P.finite("speed_kmh") & (F.col("speed_kmh") >= 3)
    walked = (F.col("_new") == 0) & (geo.haversine_m(*there, *here) >= 2)
    own = F.when(moving & P.finite("track_deg"), F.col("track_deg") % 360).when(moving & walked, geo.bearing_deg(*there, *here))
    run = Window.partitionBy("case_id", "_run").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_own", own).select("case_id", "row_idx", F.last("_own", ignorenulls=True).over(run).alias("heading"))


def curve_points(points: DataFrame, max_gap_sec: float = MAX_GAP_SEC) -> DataFrame:
    """Fixes with speed and the ``run_id`` of their chart run, cut at clip changes, gaps and any drop-out or synthetic row between."""
    broken = (P.is_dropout() | P.is_synthetic()).cast("int")
    rows = points.withColumn("_broken", F.sum(broken).over(so_far())).filter(P.usable_speed())
    same = (
        (F.lag("segment_index").over(ordered()) == F.col("segment_index")) & (F.lag("_broken").over(ordered()) == F.col("_broken"))
        & ((F.col("t_us") - F.lag("t_us").over(ordered())) / F.lit(1e6) <= max_gap_sec)
    )
    return rows.withColumn("run_id", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(so_far())).drop("_broken")


def curve_runs(points: DataFrame, max_gap_sec: float = MAX_GAP_SEC) -> DataFrame:
    """Speed-chart runs: first and last row and number of points."""
    return curve_points(points, max_gap_sec).groupBy("case_id", "run_id").agg(F.min("row_idx").alias("first_idx"), F.max("row_idx").alias("last_idx"), F.count("*").alias("n_points"))


def polyline_runs(points: DataFrame, events: DataFrame) -> DataFrame:
    """Map lines: consecutive fixes joined by style, the style of a step being that of the rows it crosses.

    interpolated > damaged > the event it lies in > dashed across a drop-out > solid; a clip change starts anew.
    """
    damaged = F.coalesce(F.col("recovery_state") == "damaged", F.lit(False)).cast("int")
    rows = points.withColumn("_d", F.sum(damaged).over(so_far())).withColumn("_o", F.sum(P.is_dropout().cast("int")).over(so_far()))
    fixes = rows.filter(P.has_fix()).withColumn("_interp", F.coalesce(F.col("recovery_state") == "interpolated", F.lit(False)))
    steps = fixes.select(
        "case_id", "row_idx", "segment_index", F.lag("segment_index").over(ordered()).alias("_seg"), F.lag("row_idx").over(ordered()).alias("from_idx"),
        (F.col("_interp") | F.lag("_interp").over(ordered())).alias("_i"), (F.col("_d") - F.lag("_d").over(ordered())).alias("_nd"), (F.col("_o") - F.lag("_o").over(ordered())).alias("_no"),
    ).filter(F.col("from_idx").isNotNull())
    kinds = events.select(F.col("case_id").alias("_c"), "kind", F.explode(F.sequence(F.col("start_index") + 1, F.col("end_index"))).alias("_at"))
    kinds = kinds.groupBy("_c", "_at").agg(F.min_by("kind", event_rank("kind")).alias("event_kind"))
    met = steps.join(kinds, (F.col("case_id") == F.col("_c")) & (F.col("row_idx") == F.col("_at")), "left")
    style = (
        F.when(F.col("_i"), "interpolated").when(F.col("_nd") > 0, "damaged").when(F.col("event_kind").isNotNull(), F.concat(F.lit("event:"), "event_kind"))
        .when(F.col("_no") > 0, "dashed").otherwise("solid")
    )
    met = met.filter("_seg = segment_index").withColumn("style", style)
    new = ~((F.lag("style").over(ordered()) == F.col("style")) & (F.lag("row_idx").over(ordered()) == F.col("from_idx")))
    met = met.withColumn("run_id", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(so_far()))
    return met.groupBy("case_id", "run_id", "style").agg(F.min("from_idx").alias("first_idx"), F.max("row_idx").alias("last_idx"), (F.count("*") + 1).alias("n_points"))


def event_rank(name: str) -> Column:
    """Order in which kinds of events take precedence."""
    order = F.create_map(*[x for i, k in enumerate(("stop", "start", "accel", "decel")) for x in (F.lit(k), F.lit(i))])
    return F.coalesce(order[F.col(name)], F.lit(99))
