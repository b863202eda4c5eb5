"""Dangerous-driving events from one-second speed changes, per vehicle class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import EVENT_MAX_WINDOW_SEC, event_rank, speed_rate_pairs

#: Limits in km/h per second: (accel by speed), start, (decel by speed), stop.
CRITERIA = {
    "car": ((12.0, 10.0, 8.0), 10.0, (14.0, 15.0, 15.0), 14.0),
    "bus": ((8.0, 7.0, 6.0), 8.0, (9.0, 10.0, 12.0), 9.0),
    "truck": ((7.0, 6.0, 5.0), 6.0, (8.0, 8.0, 8.0), 8.0),
}
DISPLAY_ORDER = ("accel", "start", "decel", "stop")


LIMITS = ("a1", "a2", "a3", "start", "d1", "d2", "d3", "stop")


def criteria() -> Column:
    """Array of the classes with their limits."""
    rows = [(v, (*a, s, *d, x)) for v, (a, s, d, x) in CRITERIA.items()]
    return F.array(*[F.struct(F.lit(v).alias("vehicle"), *[F.lit(x).alias(k) for k, x in zip(LIMITS, limits, strict=True)]) for v, limits in rows])


def criteria_lines() -> list[tuple[str, int, str]]:
    """(vehicle, line number, text): the limits in words."""
    out = []
    for vehicle, (a, start, d, stop) in CRITERIA.items():
        lines = (
            f"accel: from 6-10 km/h by {a[0]:g}, from 10-20 by {a[1]:g}, from over 20 by {a[2]:g} km/h in a second",
            f"start: from up to 5 km/h by {start:g} km/h in a second",
            f"decel: from up to 30 km/h by {d[0]:g}, up to 50 by {d[1]:g}, over 50 by {d[2]:g} km/h in a second, and still 6 km/h",
            f"stop: by {stop:g} km/h in a second to 5 km/h or less",
        )
        out += [(vehicle, k + 1, text) for k, text in enumerate(lines)]
    return out


def vehicle_or_car(name: str) -> Column:
    return F.when(F.col(name).isin(*CRITERIA), F.col(name)).otherwise("car")


def classify(v0: Column, v1: Column, rate: Column) -> Column:
    """Kind of event of a speed change under the joined criteria columns, or null."""
    up = F.when(v0 <= 10, F.col("a1")).when(v0 <= 20, F.col("a2")).otherwise(F.col("a3"))
    down = F.when(v0 <= 30, F.col("d1")).when(v0 <= 50, F.col("d2")).otherwise(F.col("d3"))
    return (
        F.when((rate > 0) & (v0 <= 5), F.when(rate >= F.col("start"), F.lit("start")))
        .when(rate > 0, F.when(rate >= up, F.lit("accel")))
        .when((rate < 0) & (v1 <= 5), F.when(-rate >= F.col("stop"), F.lit("stop")))
        .when((rate < 0) & (v1 >= 6), F.when(-rate >= down, F.lit("decel")))
    )


def hits(points: DataFrame) -> DataFrame:
    """Speed changes that meet a criterion, for every vehicle class."""
    pairs = speed_rate_pairs(points).filter(F.col("dt") <= EVENT_MAX_WINDOW_SEC)
    rated = pairs.select("*", F.inline(criteria()))
    return rated.withColumn("kind", classify(F.col("v0"), F.col("v1"), F.col("rate"))).filter("kind is not null").select(
        "case_id", "vehicle", "kind", F.col("prev_idx").alias("start_index"), F.col("cur_idx").alias("end_index"), "rate"
    )


def merge_hits(found: DataFrame) -> DataFrame:
    """Touching or overlapping hits of a kind become one event; its peak is the largest change, the earliest of equals."""
    keys = ["case_id", "vehicle", "kind"]
    w = Window.partitionBy(*keys).orderBy("start_index", "end_index")
    reach = F.max("end_index").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("_new", F.coalesce(F.col("start_index") > reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("_event", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*keys, "_event").agg(
        F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"),
        F.max_by("rate", F.struct(F.abs("rate"), -F.col("start_index"), -F.col("end_index"))).alias("peak"),
    ).drop("_event")


def detect(points: DataFrame) -> DataFrame:
    """Events of every case and vehicle class with times and speeds at both ends."""
    events = merge_hits(hits(points))
    ends = points.select(F.col("case_id").alias("_c"), F.col("row_idx").alias("_i"), "start_time_sec", "speed_kmh")
    for name, t, v in (("start_index", "start_time", "v_start"), ("end_index", "end_time", "v_end")):
        side = ends.select("_c", "_i", F.col("start_time_sec").alias(t), F.col("speed_kmh").alias(v))
        events = events.join(side, (F.col("case_id") == F.col("_c")) & (F.col(name) == F.col("_i"))).drop("_c", "_i")
    return events


def kinds_of(points: DataFrame, vehicle: str = "car") -> DataFrame:
    """Events of one vehicle class as ``detect`` finds them, by their rows alone: nothing is looked up at their ends."""
    return merge_hits(hits(points).filter(F.col("vehicle") == vehicle))


def event_rows(events: DataFrame, vehicle: str = "car") -> DataFrame:
    """Rows inside events with their kinds in order of precedence."""
    rows = events.filter(F.col("vehicle") == vehicle).select("case_id", "kind", F.explode(F.sequence("start_index", "end_index")).alias("row_idx"))
    ranked = rows.distinct().groupBy("case_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct(event_rank("kind").alias("r"), "kind"))).alias("k"))
    return ranked.select("case_id", "row_idx", F.array_join(F.col("k.kind"), ",").alias("kinds"))


def event_counts(points: DataFrame, events: DataFrame, vehicle: str = "car") -> DataFrame:
    """Number of events per case and kind, zero where there is none."""
    kinds = F.explode(F.array(*[F.lit(k) for k in DISPLAY_ORDER])).alias("kind")
    all_kinds = points.select("case_id").distinct().select("case_id", kinds)
    counted = events.filter(F.col("vehicle") == vehicle).groupBy("case_id", "kind").agg(F.count("*").alias("n"))
    return all_kinds.join(counted, ["case_id", "kind"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def event_colors(events: DataFrame, vehicle: str = "car") -> DataFrame:
    """Per row the kind that colours the step into it: rows after the first of an event, highest precedence."""
    rows = events.filter((F.col("vehicle") == vehicle) & (F.col("end_index") > F.col("start_index")))
    rows = rows.select("case_id", "kind", F.explode(F.sequence(F.col("start_index") + 1, F.col("end_index"))).alias("row_idx"))
    return rows.groupBy("case_id", "row_idx").agg(F.min_by("kind", event_rank("kind")).alias("kind"))


#: Colours of the kinds on maps and charts.
COLORS = {"accel": "#e67e22", "start": "#f1c40f", "decel": "#c0392b", "stop": "#8e44ad"}


def described(events: DataFrame) -> DataFrame:
    """Events with a colour and a line of text: the change in a second, the speeds at both ends, and the rows from 1."""
    colors = F.create_map(*[F.lit(x) for pair in COLORS.items() for x in pair])
    detail = F.format_string("%+.1f km/h/s, %.1f to %.1f km/h, rows %d-%d", F.rint(F.col("peak") * 10) / 10, "v_start", "v_end", F.col("start_index") + 1, F.col("end_index") + 1)
    return events.withColumns({"color": colors[F.col("kind")], "detail": detail})


def event_markers(points: DataFrame, events: DataFrame, vehicle: str = "car") -> DataFrame:
    """The middle fix of every event, where its marker stands."""
    from ..functions import predicates as P

    fixes = points.filter(P.has_fix()).select(F.col("case_id").alias("_c"), "row_idx", "latitude", "longitude")
    rows = events.filter(F.col("vehicle") == vehicle).withColumn("_at", F.explode(F.sequence("start_index", "end_index")))
    met = rows.join(fixes, (F.col("case_id") == F.col("_c")) & (F.col("_at") == F.col("row_idx")))
    w = Window.partitionBy("case_id", "kind", "start_index")
    met = met.withColumn("_rn", F.row_number().over(w.orderBy("row_idx"))).withColumn("_n", F.count("*").over(w))
    return met.filter(F.col("_rn") == F.floor(F.col("_n") / 2) + 1).select("case_id", "kind", "start_index", "row_idx", "latitude", "longitude")
