import pytest
from pyspark.sql import functions as F

from fleetlens.operators import damage, linkage, outliers, report, sequence
from fleetlens.sources.shared import checkpointed

from .tracks import speeds, track


def marked(points):
    return sorted(r["row_idx"] for r in outliers.mark_outliers(points).filter("is_outlier").collect())


@pytest.mark.parametrize(("values", "expected"), [([30, 30, 80, 30, 30], [2]), ([30, 150, 150, 30], [1, 2]), ([60, 60, 0, 0, 0], [])])
def test_speed_outliers(spark, values, expected):
    assert marked(speeds(spark, values)) == expected


def test_one_far_place(spark):
    rows = [{"t": float(i), "v": 0.0, "lat": 37.5 + (0.02 if i == 30 else 0)} for i in range(40)]
    assert marked(track(spark, rows)) == [30]


def test_pieces_of_many_cases_share_tasks(spark):
    """Marks do not depend on where Arrow batches end, and no piece is a job of its own."""
    values = [30, 150, 150, 30, 30, 31, 120, 31, 30, 30, 30, 90, 30]
    points = speeds(spark, values)
    for case in range(2, 9):
        far = [{"t": float(i), "v": float(v), "lat": 37.5 + (0.02 if i == case else 0)} for i, v in enumerate(values[: case + 4])]
        points = points.union(track(spark, far, case))
    points = points.coalesce(1)
    whole = outliers.mark_outliers(points).select("case_id", "row_idx", "outlier_reason").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        small = outliers.mark_outliers(points).select("case_id", "row_idx", "outlier_reason").collect()
        groups = points.withColumns({"group_id": F.col("row_idx"), "last_idx": F.col("row_idx")})
        one_by_one = {c: marked(points.filter(F.col("case_id") == c)) for c in (1, 5)}
        plan = outliers.rate_groups(groups)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(whole) == sorted(small) and any(r["outlier_reason"] == "rate" for r in whole)
    assert all(sorted(r["row_idx"] for r in whole if r["case_id"] == c and r["outlier_reason"]) == rows for c, rows in one_by_one.items())
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_marking_makes_columns_once_and_writes_groups_only(spark, monkeypatch):
    """A filter below the windows would repeat what columns are made of, and rows of groups were written before they were grouped."""
    points = speeds(spark, [30, 150, 150, 30, 30, 31, 120, 31, 30, 30]).withColumn("latitude", F.sinh("latitude") / 1e16 + 37)
    plan = sequence.record_rows(points)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SINH(") == 1
    written = []
    monkeypatch.setattr(outliers, "checkpointed", lambda df: written.append(df.columns) or checkpointed(df))
    assert marked(points) == [1, 2, 6]
    assert len(written) == 4 and all("group_id" in c for c in written)


def test_a_mark_ends_with_its_group(spark):
    """Rows between and after a marked group's rows that are no records of it stay as they are."""
    rows = [{"t": float(i), "v": 30.0} for i in range(8)]
    rows[3] = {"t": 3.0, "v": 120.0, "lat": 37.5}
    rows[4] = {"t": 4.0, "v": None, "lat": None, "lon": None, "utc": "", "ok": False}
    rows[5] = {"t": 3.0, "v": 120.0, "lat": 37.5}
    assert marked(track(spark, rows)) == [3, 5]


def test_impossible_values(spark):
    rows = [{"t": float(i), "v": 10.0, "lat": lat, "lon": lon} for i, (lat, lon) in enumerate([(float("nan"), 127.0), (91.0, 127.0), (0.0, 0.0), (37.5, 127.0)])]
    assert marked(track(spark, rows)) == [0, 1, 2]


def interval(spark, rows, regions, durations=None):
    points = track(spark, rows)
    r = spark.createDataFrame([(1, a, b, k) for a, b, k in regions], "case_id long, a long, b long, kind string")
    return points, damage.intervals(points, r, durations)


def test_gap_interval_and_interpolation(spark):
    rows = [{"t": float(i), "v": 36.0, "at": i * 1000, "lat": 37.5 + i * 9e-5} for i in range(20) if not 6 <= i <= 9]
    points, found = interval(spark, rows, [(5500, 9500, "gap")])
    assert [(r["start_sec"], r["end_sec"], r["kind"]) for r in found.collect()] == [(5.0, 10.0, "gap")]
    made = damage.synthetic_rows(points, found).orderBy("start_time_sec").collect()
    assert [r["start_time_sec"] for r in made] == [6.0, 7.0, 8.0, 9.0] and {r["recovery_state"] for r in made} == {"interpolated"}
    full = [{"t": float(i), "v": 36.0, "at": i * 1000} for i in range(20)]
    assert interval(spark, full, [(5500, 9500, "gap")])[1].count() == 0


def test_far_ends_are_implausible(spark):
    rows = [{"t": float(i), "v": 36.0, "at": i * 1000, "lat": 37.5 + (0.01 if i > 4 else 0)} for i in range(16) if not 5 <= i <= 9]
    points, found = interval(spark, rows, [(4500, 9500, "zero")])
    assert damage.judge(damage.fixes_around(points, found)).first()["outcome"] == "implausible"
    assert {r["recovery_state"] for r in damage.synthetic_rows(points, found).collect()} == {"damaged"}


def test_two_zero_regions(spark):
    rows = [{"t": float(i), "v": 36.0, "at": i * 1000} for i in (0, 1, 3, 4, 6, 7, 8)]
    points, found = interval(spark, rows, [(1500, 2500, "zero"), (4500, 5500, "zero")])
    assert sorted((r["start_sec"], r["end_sec"]) for r in found.collect()) == [(1.0, 3.0), (4.0, 6.0)]
    assert sorted(r["start_time_sec"] for r in damage.synthetic_rows(points, found, interpolate=False).collect()) == [2.0, 5.0]


def test_placeholder_budget(spark):
    points = track(spark, [{"t": 0.0, "v": 0.0, "at": 0}])
    found = spark.range(100).select(F.lit(1).cast("long").alias("case_id"), (F.col("id") * 400 + 10.0).alias("start_sec"), (F.col("id") * 400 + 310.0).alias("end_sec"), F.lit("gap").alias("kind"))
    assert damage.synthetic_rows(points, found, interpolate=False).count() == 20_000


def test_report_sample_is_even(spark):
    points = speeds(spark, [10.0] * 600)
    none = spark.createDataFrame([], "case_id long, kind string, start_index long, end_index long")
    rows = sorted(r["row_idx"] for r in report.sampled_rows(points, none).collect())
    expected = sorted({round(i * 599 / 199) for i in range(200)})
    assert rows == expected and rows[0] == 0 and rows[-1] == 599


def test_slack_sessions(spark):
    rows = [(1, i, u) for i, u in enumerate([86398, 86399, 86401, 86701, None])]
    out = linkage.slack_sessions(spark.createDataFrame(rows, "case_id long, row_idx long, utc long")).orderBy("row_idx").collect()
    assert [(r["segment"], r["t"]) for r in out] == [(0, 0), (0, 1), (0, 3), (1, 303), (2, None)]


def test_greedy_pairs(spark):
    rows = [(0, 1, 11, 0.5), (0, 1, 12, 0.2), (0, 2, 12, 0.1), (0, 2, 11, 0.9), (0, 3, 11, 0.4)]
    pairs = spark.createDataFrame(rows, "group_id int, front_id long, rear_id long, cost double")
    pairs = pairs.withColumns({"front_start": F.col("front_id") * 1.0, "rear_start": F.col("rear_id") * 1.0})
    got = linkage.assign_pairs(pairs).collect()
    assert sorted((r["front_id"], r["rear_id"]) for r in got) == [(2, 12), (3, 11)]


def test_combined_segments(spark):
    rows = [{"t": float(i % 4), "v": 1.0, "seg": i // 4} for i in range(8)]
    points = track(spark, rows)
    out = linkage.combine_segments(points, report.segment_spans(points)).orderBy("row_idx").collect()
    assert [r["start_time_sec"] for r in out] == [float(i) for i in range(8)]
