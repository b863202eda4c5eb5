import pytest

from fleetlens.operators import events, sequence

from .tracks import kinds, speeds, track


@pytest.mark.parametrize(
    ("values", "vehicle", "expected"),
    [
        ([30, 30, 38, 38], "car", ["accel"]), ([30, 30, 37.9, 37.9], "car", []), ([30, 30, 36, 36], "bus", ["accel"]), ([30, 30, 34.9, 34.9], "truck", []),
        ([8, 8, 19, 19], "car", []), ([8, 8, 19, 19], "bus", ["accel"]), ([0, 0, 10, 10], "car", ["start"]), ([0, 0, 9, 9], "car", []), ([20, 20, 5, 5], "car", ["stop"]),
        ([18, 18, 5, 5], "car", []), ([20, 20, 7, 7], "car", []), ([60, 60, 45, 45], "car", ["decel"]), ([60, 60, 46, 46], "car", []), ([30, 30, 21, 21], "bus", ["decel"]),
    ],
)
def test_thresholds(spark, values, vehicle, expected):
    assert kinds(spark, values, vehicle) == expected


def test_touching_hits_are_one_event(spark):
    found = events.detect(speeds(spark, [30, 30, 40, 50, 60, 60])).filter("vehicle = 'car'").collect()
    assert [(r["start_index"], r["end_index"], r["start_time"], r["end_time"]) for r in found] == [(1, 4, 1.0, 4.0)]


def test_half_second_rows_use_a_one_second_window(spark):
    assert kinds(spark, [30, 30, 33, 36, 39, 42, 42], dt=0.5) == []
    rates = [r["rate"] for r in sequence.speed_rate_pairs(speeds(spark, [30, 30, 33, 36, 39, 42, 42], 0.5)).collect()]
    assert max(rates) == pytest.approx(6.0)


def test_long_window_is_not_judged(spark):
    points = track(spark, [{"t": t, "v": v} for t, v in ((0.0, 47.0), (1.0, 47.0), (4.0, 5.0), (5.0, 5.0))])
    row = {r["row_idx"]: r for r in sequence.accelerations(points).collect()}[2]
    assert row["window_sec"] == 3.0 and row["accel"] is None
    assert events.detect(points).count() == 0


def test_clip_boundary_and_synthetic_rows_break_pairs(spark):
    cut = track(spark, [{"t": 0.0, "v": 30.0}, {"t": 1.0, "v": 60.0, "seg": 1}])
    assert sequence.speed_rate_pairs(cut).count() == 0
    lost = track(spark, [{"t": 0.0, "v": 30.0}, {"t": 1.0, "state": "damaged"}, {"t": 2.0, "v": 60.0}])
    assert sequence.speed_rate_pairs(lost).count() == 0


def test_rows_with_events(spark):
    rows = events.event_rows(events.detect(speeds(spark, [30, 30, 40, 40]))).collect()
    assert sorted(r["row_idx"] for r in rows) == [1, 2]


def test_slots_and_frame_detail(spark):
    rows = [{"t": float(i), "v": 10.0} for i in range(10)] + [{"t": 10.0 + i, "state": "damaged"} for i in range(40)] + [{"t": 50.0 + i, "v": 10.0} for i in range(10)]
    points = track(spark, rows)
    assert sequence.gps_slots(points).count() == 60
    assert sequence.frame_detail(points).first()["frame_detail"] is False


def test_kinds_of_one_class_are_found_without_joins(spark):
    points = speeds(spark, [30, 30, 40, 50, 60, 60, 20, 20, 4, 4, 20, 30])
    rows = events.kinds_of(points)
    keys = ["case_id", "kind", "start_index", "end_index", "peak"]
    got = sorted(map(tuple, rows.select(*keys).collect()))
    assert got and got == sorted(map(tuple, events.detect(points).filter("vehicle = 'car'").select(*keys).collect()))
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_an_analysis_joins_counts_only(spark):
    from fleetlens.plans.queries_kept import queries

    rows = queries()["op_run_analysis"](spark, "/root/testdata/sf0.001")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
