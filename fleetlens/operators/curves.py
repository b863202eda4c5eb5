"""Monotone cubic curves through the points of a chart run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slopes at both ends of a step, in units of its own slope, stay within a circle of this radius.
RADIUS = 3.0


def _radius(at: Column, to: Column, slope: Column) -> Column:
    a, b = F.try_divide(at, slope), F.try_divide(to, slope)
    return F.sqrt(a * a + b * b)


def tangents(points: DataFrame) -> DataFrame:
    """Steps (case_id, run_id, x0, y0, x1, y1, m0, m1) of points(case_id, run_id, x, y): slopes that keep a cubic monotone (Fritsch and Carlson).

    A step that corrects its ends hands the corrected slope to the next one. Corrections only
    make slopes smaller, so a step that needs none with the slopes it began with needs
    none at all: windows cut the run after every such step, and only
    stretches of doubtful steps are folded, whatever the length of the run. Of points
    at one place the lowest counts.
    """
    keys = ["case_id", "run_id"]
    run = Window.partitionBy(*keys).orderBy("x")
    rows = points.groupBy(*keys, "x").agg(F.min("y").alias("y")).withColumns({"x1": F.lead("x").over(run), "y1": F.lead("y").over(run)})
    rows = rows.withColumn("d", (F.col("y1") - F.col("y")) / (F.col("x1") - F.col("x"))).withColumn("_before", F.lag("d").over(run))
    mean = F.when(F.col("d") * F.col("_before") > 0, (F.col("d") + F.col("_before")) / 2).otherwise(0.0)
    rows = rows.withColumn("m", F.when(F.col("_before").isNull(), F.col("d")).when(F.col("d").isNull(), F.col("_before")).otherwise(mean))
    rows = rows.withColumn("n", F.lead("m").over(run)).filter("x1 is not null")
    doubtful = (F.col("d") == 0) | (_radius(F.col("m"), F.col("n"), F.col("d")) > RADIUS)
    rows = rows.withColumn("_doubtful", F.coalesce(doubtful, F.lit(True)))
    rows = rows.withColumn("_piece", F.sum((~F.coalesce(F.lag("_doubtful").over(run), F.lit(False))).cast("long")).over(run))
    steps = rows.groupBy(*keys, "_piece").agg(F.array_sort(F.collect_list(F.struct("x", "y", "x1", "y1", "d", "m", "n"))).alias("s"))
    # By how much both ends of a step shrink, given the slope that it begins with.
    shrink = f"coalesce(least(1D, {RADIUS}D / nullif(sqrt(a.now / p.d * (a.now / p.d) + p.n / p.d * (p.n / p.d)), 0D)), 1D)"
    kinds = "x0: double, y0: double, x1: double, y1: double, m0: double, after: double"
    fold = f"""aggregate(s, struct(s[0].m AS now, cast(array() AS array<struct<{kinds}>>) AS out), (a, p) -> named_struct(
      'now', if(p.d = 0D, 0D, p.n * {shrink}),
      'out', array_append(a.out, named_struct('x0', p.x, 'y0', p.y, 'x1', p.x1, 'y1', p.y1, 'm0', if(p.d = 0D, 0D, a.now * {shrink}), 'after', if(p.d = 0D, 0D, p.n * {shrink})))), a -> a.out)"""
    ends = steps.select(*keys, F.inline(F.expr(fold)))
    along = Window.partitionBy(*keys).orderBy("x0")
    return ends.select(*keys, "x0", "y0", "x1", "y1", "m0", F.coalesce(F.lead("m0").over(along), "after").alias("m1"))


def monotone_segments(points: DataFrame) -> DataFrame:
    """Bézier segments (case_id, run_id, x0, y0, c1x, c1y, c2x, c2y, x1, y1) of points(case_id, run_id, x, y)."""
    h = (F.col("x1") - F.col("x0")) / 3
    return tangents(points).select(
        "case_id", "run_id", "x0", "y0", (F.col("x0") + h).alias("c1x"), (F.col("y0") + F.col("m0") * h).alias("c1y"),
        (F.col("x1") - h).alias("c2x"), (F.col("y1") - F.col("m1") * h).alias("c2y"), "x1", "y1",
    )
