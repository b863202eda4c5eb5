"""Damaged stretches: from byte regions to time intervals to placeholder or interpolated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import predicates as P
from ..sources.shared import checkpointed

#: Fixed values.
RECORD_GAP_FACTOR = 1.5
MAX_PLACEHOLDERS = 20_000
MAX_ANCHOR_DISTANCE_SEC = 5.0
PLAUSIBLE_FACTOR = 1.5
PLAUSIBLE_SLACK_M = 50.0
MOVING_KMH = 3.0
LOOKBACK_SEC = 60.0
BLOCK_SEC = 4_096


def merge_regions(regions: DataFrame, touching: bool = True, keys: tuple[str, ...] = ("case_id",), a: str = "a", b: str = "b") -> DataFrame:
    """Merge ranges [a, b) that overlap, and with ``touching`` those that meet."""
    w = Window.partitionBy(*keys).orderBy(a, b)
    reach = F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(a) > reach if touching else F.col(a) >= reach
    rows = regions.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    others = [F.min_by(c, F.struct(a, b)).alias(c) for c in regions.columns if c not in (*keys, a, b)]
    return rows.groupBy(*keys, "_run").agg(F.min(a).alias(a), F.max(b).alias(b), *others).drop("_run")


def nominal_spacing(times: DataFrame) -> DataFrame:
    """Per case the upper median of the gaps between neighbouring times, 1.0 with fewer than two gaps."""
    w = Window.partitionBy("case_id").orderBy("start_time_sec")
    gaps = times.select("case_id", (F.col("start_time_sec") - F.lag("start_time_sec").over(w)).alias("gap"))
    by_case = gaps.groupBy("case_id").agg(F.array_sort(F.collect_list(F.when(F.col("gap") > 1e-6, F.col("gap")))).alias("g"))
    middle = F.element_at("g", (F.floor(F.size("g") / 2) + 1).cast("int"))
    return by_case.select("case_id", F.when(F.size("g") < 2, F.lit(1.0)).otherwise(middle).alias("nominal"))


def spacing_of(real: DataFrame) -> DataFrame:
    """Spacing of the rows with a place in the file, of all rows in cases where none has one."""
    placed = F.max(F.col("source_offset").isNotNull()).over(Window.partitionBy("case_id"))
    return nominal_spacing(real.withColumn("_placed", placed).filter(~F.col("_placed") | F.col("source_offset").isNotNull()))


def real_timed(points: DataFrame) -> DataFrame:
    return points.filter(~P.is_synthetic() & F.col("start_time_sec").isNotNull())


def subtract_ranges(runs: DataFrame, excluded: DataFrame, least: int = 1, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """What is left of [a, b) runs without the excluded ones, pieces of ``least`` or more."""
    cuts = merge_regions(excluded, keys=keys)
    marks = runs.select(*keys, F.col("a"), F.col("b"))
    met = marks.join(cuts.select(*keys, F.col("a").alias("x"), F.col("b").alias("y")), list(keys), "left")
    inside = F.when((F.col("x") < F.col("b")) & (F.col("y") > F.col("a")), F.struct("x", "y"))
    grouped = met.groupBy(*keys, "a", "b").agg(F.array_sort(F.collect_list(inside)).alias("cut"))
    starts = F.concat(F.array("a"), F.col("cut.y"))
    ends = F.concat(F.col("cut.x"), F.array("b"))
    pieces = grouped.select(*keys, F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("p"))
    return pieces.select(*keys, F.col("p.a").alias("a"), F.col("p.b").alias("b")).filter(F.col("b") - F.col("a") >= least)


def region_kinds(merged: DataFrame, regions: DataFrame) -> DataFrame:
    """Merged regions with their kind: a gap if any part is one, else zeros."""
    gaps = regions.filter("kind = 'gap'").select(F.col("case_id").alias("_g"), F.col("a").alias("_ga"), F.col("b").alias("_gb"))
    kinds = merged.join(gaps, (F.col("case_id") == F.col("_g")) & (F.col("_ga") < F.col("b")) & (F.col("_gb") > F.col("a")), "left")
    return kinds.groupBy("case_id", "a", "b").agg(F.when(F.count("_g") > 0, "gap").otherwise("zero").alias("kind"))


def merged_kinds(regions: DataFrame) -> DataFrame:
    """Damaged regions put together, a gap if any part of one is, in one pass."""
    w = Window.partitionBy("case_id").orderBy("a", "b")
    apart = F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = regions.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kind = F.when(F.bool_or(F.col("kind") == "gap"), "gap").otherwise("zero")
    return rows.groupBy("case_id", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"), kind.alias("kind")).drop("_run")


def overlapped(steps: DataFrame, merged: DataFrame) -> DataFrame:
    """Steps [lo, hi) of a file that damage lies in, with the ``kind`` of the last region in them.

    Merged regions lie apart, so the last one that begins before ``hi`` reaches furthest: one order of both, no range join.
    """
    regions = merged.select("case_id", F.col("a").alias("_at"), F.struct("b", "kind").alias("_region"))
    both = steps.withColumn("_at", F.col("hi")).withColumn("_step", F.lit(0)).unionByName(regions.withColumn("_step", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("case_id").orderBy("_at", "_step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_last", F.last("_region", ignorenulls=True).over(w)).filter("_step = 0")
    found = met.filter(F.col("_last.b") > F.col("lo")).withColumn("kind", F.col("_last.kind"))
    return found.drop("_at", "_step", "_region", "_last")


def on_line(v0, v1, t0, t1, t):
    """Value at a time on the line between two."""
    return v0 + (v1 - v0) * ((t - t0) / (t1 - t0))


def intervals(points: DataFrame, regions: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Time intervals (case_id, start_sec, end_sec, kind) where damaged bytes cost records.

    ``regions(case_id, a, b, kind)`` are byte ranges, kind ``gap`` or ``zero``;
    ``durations(case_id, duration_sec, truncated)`` adds the tail and a cut end.
    """
    real = checkpointed(real_timed(points).select("case_id", "row_idx", "source_offset", "start_time_sec"))
    anchors = real.filter(F.col("source_offset").isNotNull())
    spacing = checkpointed(spacing_of(real))
    merged = checkpointed(merged_kinds(regions))
    by_offset = Window.partitionBy("case_id").orderBy("source_offset")
    steps = anchors.select(
        "case_id", F.col("source_offset").alias("lo"), F.lead("source_offset").over(by_offset).alias("hi"), F.col("start_time_sec").alias("t0"), F.lead("start_time_sec").over(by_offset).alias("t1"),
    ).join(spacing, "case_id").withColumn("threshold", F.col("nominal") * RECORD_GAP_FACTOR + 1e-6)
    long = steps.filter(F.col("t1") > F.col("t0") + F.col("threshold"))
    found = overlapped(long, merged)
    out = found.select("case_id", F.round("t0", 3).alias("start_sec"), F.round("t1", 3).alias("end_sec"), "kind")
    ends = anchors.groupBy("case_id").agg(
        F.min_by(F.struct("source_offset", "start_time_sec"), "source_offset").alias("first"), F.max_by(F.struct("source_offset", "start_time_sec"), "source_offset").alias("last")
    )
    whole = merged.groupBy("case_id").agg(F.min("a").alias("a0"), F.max("b").alias("b1"), F.max_by("kind", "a").alias("last_kind"))
    edges = ends.join(whole, "case_id").join(spacing, "case_id").withColumn("threshold", F.col("nominal") * RECORD_GAP_FACTOR + 1e-6)
    head = edges.filter((F.col("a0") < F.col("first.source_offset")) & (F.col("first.start_time_sec") > F.col("threshold")))
    out = out.unionByName(head.select("case_id", F.lit(0.0).alias("start_sec"), F.round("first.start_time_sec", 3).alias("end_sec"), F.lit("head").alias("kind")))
    if durations is not None:
        timed = edges.join(durations, "case_id")
        tail = timed.filter((F.col("b1") > F.col("last.source_offset")) & (F.col("duration_sec") - F.col("last.start_time_sec") > F.col("threshold")))
        tail = tail.select("case_id", F.round("last.start_time_sec", 3).alias("start_sec"), F.round("duration_sec", 3).alias("end_sec"), F.col("last_kind").alias("kind"))
        out = out.unionByName(tail)
        last = real.groupBy("case_id").agg(F.max("start_time_sec").alias("last_t")).join(durations.filter("truncated"), "case_id").join(spacing, "case_id", "left")
        wait = F.greatest(F.lit(2.0), F.coalesce("nominal", F.lit(1.0)) * RECORD_GAP_FACTOR + 1e-6)
        cut = last.filter(F.col("duration_sec") - F.col("last_t") >= wait).join(tail.select("case_id"), "case_id", "left_anti")
        out = out.unionByName(cut.select("case_id", F.round("last_t", 3).alias("start_sec"), F.round("duration_sec", 3).alias("end_sec"), F.lit("truncated").alias("kind")))
    return merge_regions(out, touching=False, a="start_sec", b="end_sec")


def candidate_seconds(found: DataFrame) -> DataFrame:
    """Whole seconds inside each interval, from the one after its start; block by block, so no list is as long as an interval."""
    first, last = F.floor("start_sec") + 1, F.ceil("end_sec") - 1
    inside = found.filter(first < F.col("end_sec"))
    blocks = inside.select("*", F.explode(F.sequence(first, last, F.lit(BLOCK_SEC).cast("long"))).alias("_from"))
    return blocks.select(*found.columns, F.explode(F.sequence("_from", F.least(F.col("_from") + (BLOCK_SEC - 1), last))).alias("t"))


def free_seconds(points: DataFrame, found: DataFrame) -> DataFrame:
    """Candidate seconds with no real row within half a record of them, at most half a second."""
    real = real_timed(points)
    spacing = spacing_of(real).select("case_id", F.least(F.lit(0.5), F.col("nominal") / 2).alias("w"))
    c = candidate_seconds(found).join(spacing, "case_id", "left").withColumn("w", F.coalesce("w", F.lit(0.5)))
    # Equality on the second on either side turns the range test into a hash join.
    seconds = real.select(F.col("case_id").alias("_c"), F.col("start_time_sec").alias("_t"), F.explode(F.array(F.floor("start_time_sec"), F.floor("start_time_sec") + 1)).alias("_s"))
    taken = (F.col("case_id") == F.col("_c")) & (F.col("t") == F.col("_s")) & (F.col("_t") >= F.col("t") - F.col("w")) & (F.col("_t") < F.col("t") + F.col("w"))
    return c.join(seconds, taken, "left_anti")


def fixes_around(points: DataFrame, found: DataFrame) -> DataFrame:
    """Each interval with the last fix at or before its start and the first at or after its end.

    Fixes and ends of intervals stand in one order of time, so the nearest fix is the last one seen from either side.
    """
    fix = points.filter(P.has_fix() & ~P.is_synthetic() & F.col("start_time_sec").isNotNull())
    unit = F.struct("start_time_sec", "row_idx", "latitude", "longitude", "speed_kmh", "segment_index")
    none = F.lit(None).cast(found.select(F.struct("start_sec", "end_sec", "kind").alias("i")).schema["i"].dataType)
    fixes = fix.select("case_id", F.col("start_time_sec").alias("at"), "row_idx", unit.alias("unit"), none.alias("interval"), F.lit(0).alias("side"))
    sides = F.inline(F.array(F.struct(F.col("start_sec").alias("at"), F.lit(1).alias("side")), F.struct(F.col("end_sec").alias("at"), F.lit(2).alias("side"))))
    marks = found.select("case_id", F.struct("start_sec", "end_sec", "kind").alias("interval"), sides)
    rows = fixes.unionByName(marks, allowMissingColumns=True)
    case = Window.partitionBy("case_id")
    forward, back = case.orderBy("at", F.col("side") > 0, "row_idx"), case.orderBy(F.desc("at"), F.col("side") > 0, F.desc("row_idx"))
    moving = F.when(F.col("unit.speed_kmh") >= MOVING_KMH, F.col("unit"))
    seen = rows.withColumns({
        "before": F.last("unit", ignorenulls=True).over(forward.rowsBetween(Window.unboundedPreceding, 0)), "moving": F.last(moving, ignorenulls=True).over(forward.rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.last("unit", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)),
    }).filter("side > 0")
    out = seen.groupBy("case_id", "interval").agg(
        *[F.max(F.when(F.col("side") == side, F.col(c))).alias(c) for c, side in (("before", 1), ("after", 2), ("moving", 1))]
    ).select("case_id", "interval.*", "before", "after", "moving")
    own = F.col("before.speed_kmh") >= MOVING_KMH
    recent = F.col("before.start_time_sec") - F.col("moving.start_time_sec") <= LOOKBACK_SEC
    return out.withColumn("v_ref", F.when(own, F.col("before.speed_kmh")).when(recent, F.col("moving.speed_kmh")).otherwise(0.0))


def judge(around: DataFrame, interpolate: bool | Column = True) -> DataFrame:
    """Outcome of each interval: interpolated, implausible, no_anchor or not_recovered."""
    far = (F.col("start_sec") - F.col("before.start_time_sec") > MAX_ANCHOR_DISTANCE_SEC) | (F.col("after.start_time_sec") - F.col("end_sec") > MAX_ANCHOR_DISTANCE_SEC)
    dt = F.greatest(F.col("after.start_time_sec") - F.col("before.start_time_sec"), F.lit(0.001))
    expected = F.col("v_ref") / 3.6 * dt
    actual = geo.haversine_m(F.col("before.latitude"), F.col("before.longitude"), F.col("after.latitude"), F.col("after.longitude"))
    outcome = (
        F.when(~F.lit(interpolate), "not_recovered").when(F.col("before").isNull() | F.col("after").isNull() | far, "no_anchor")
        .when(actual > PLAUSIBLE_FACTOR * expected + PLAUSIBLE_SLACK_M, "implausible").otherwise("interpolated")
    )
    return around.select("*", expected.alias("expected_m"), actual.alias("actual_m"), outcome.alias("outcome"))


def synthetic_rows(points: DataFrame, found: DataFrame, interpolate: bool | DataFrame = True, budget: int | None = MAX_PLACEHOLDERS) -> DataFrame:
    """Rows for the lost seconds: on the line between the fixes, or empty; ``budget`` rows per case in interval order, all with None.

    A budget is for what is shown. Tracks are made of all rows.
    ``interpolate`` may be a table of the cases whose rows go on the line, so that cases of either kind are read once.
    """
    found = checkpointed(found)
    around = fixes_around(points, found)
    if isinstance(interpolate, DataFrame):
        around = around.join(interpolate.select("case_id", F.lit(True).alias("_on")), "case_id", "left").withColumn("_on", F.coalesce("_on", F.lit(False)))
        judged = judge(around, F.col("_on")).drop("_on")
    else:
        judged = judge(around, interpolate)
    rows = free_seconds(points, found).select("case_id", "start_sec", "end_sec", F.col("t").cast("double").alias("t"))
    met = rows.join(judged, ["case_id", "start_sec", "end_sec"])
    if budget is not None:
        met = met.withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy("start_sec", "t"))).filter(F.col("n") <= budget)
    f = (F.col("t") - F.col("before.start_time_sec")) / (F.col("after.start_time_sec") - F.col("before.start_time_sec"))
    on_line = F.col("outcome") == "interpolated"

    def between(c: str):
        return F.when(on_line, F.col(f"before.{c}") + (F.col(f"after.{c}") - F.col(f"before.{c}")) * f)

    return met.select(
        "case_id", F.col("t").alias("start_time_sec"), (F.col("t") + 1).alias("end_time_sec"), between("latitude").alias("latitude"), between("longitude").alias("longitude"),
        F.when(on_line, "interpolated").otherwise("damage").alias("time_source"), F.when(on_line, "interpolated").otherwise("damaged").alias("recovery_state"),
        F.coalesce("before.segment_index", "after.segment_index", F.lit(0)).alias("segment_index"),
    )


def in_one_track(real: DataFrame, made: DataFrame) -> DataFrame:
    """Real rows and rows made for lost seconds, numbered anew by time."""
    both = real.unionByName(made, allowMissingColumns=True)
    w = Window.partitionBy("case_id").orderBy(F.col("start_time_sec").isNull(), "start_time_sec", P.is_synthetic(), "row_idx")
    return both.withColumn("row_idx", F.row_number().over(w).cast("long") - 1)


def apply_marks(points: DataFrame, found: DataFrame, interpolate: bool = True) -> DataFrame:
    """Real rows and synthetic rows in one track."""
    return in_one_track(points.filter(~P.is_synthetic()), synthetic_rows(points, found, interpolate, None))
