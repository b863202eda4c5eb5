"""Matching, planning and combining of several clips."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import linkage, matching, multiclip
from fleetlens.plans import queries_clips

from .tracks import track

PROBE = (
    "job_id long, clip_id long, side string, ord long, name string, sha256 string, container string, brand string, udta string, model string, codec string, error string, duration double, "
    "gps_start double, name_start double, first_t double, first_lat double, first_lon double, last_t double, last_lat double, last_lon double, max_kmh double"
)


def test_greedy_equals_one_by_one(spark):
    r = random.Random(8)
    rows, expected = [], set()
    for group in range(12):
        at = {("l", i): r.uniform(0, 40) for i in range(25)} | {("r", i): r.uniform(0, 40) for i in range(25)}
        pairs = [(group, i, j, r.randrange(6), at["l", i], at["r", j]) for i in range(25) for j in range(25) if abs(at["l", i] - at["r", j]) < 4]
        rows += pairs
        left, right = set(), set()
        for _, i, j, _, _, _ in sorted(pairs, key=lambda p: (p[3], p[1], p[2])):
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                expected.add((group, i, j))
    df = spark.createDataFrame(rows, "g int, a long, b long, cost int, left_at double, right_at double")
    got = {(x["g"], x["a"], x["b"]) for x in matching.greedy(df, ["g"], "a", "b", ["cost", "a", "b"]).collect()}
    assert got == expected


def probe(job, clip, side, start, **more):
    row = dict(
        job_id=job, clip_id=clip, side=side, ord=clip, name=f"{clip}.mp4", sha256=str(clip), container="mp4", brand="b", udta="", model="m", codec="c", error=None, duration=60.0,
        gps_start=start, name_start=None, first_t=0.0, first_lat=37.5, first_lon=127.0, last_t=59.0, last_lat=37.5, last_lon=127.0, max_kmh=50.0,
    )
    return row | more


@pytest.fixture(scope="module")
def planned(spark):
    rows = [
        probe(1, 10, "front", 60.0), probe(1, 11, "front", 0.0), probe(1, 12, "rear", 1.0), probe(1, 13, "rear", 61.0), probe(1, 14, "rear", 120.0),  # out of order, one rear alone
        probe(2, 20, "front", 0.0), probe(2, 21, "front", 70.0),  # ten seconds between
        probe(3, 30, "front", 0.0), probe(3, 31, "front", 40.0),  # twenty seconds in common
        probe(4, 40, "front", 0.0), probe(4, 41, "front", 60.0, first_lat=38.5),  # too far apart
        probe(5, 50, "front", 0.0), probe(5, 51, "front", 60.0, model="other"),
        probe(6, 60, "front", None, name_start=0.0), probe(6, 61, "front", 60.0, name_start=60.0),  # file names decide
        probe(7, 70, "front", None), probe(7, 71, "front", 60.0),  # no clock
        probe(8, 80, "front", 0.0), probe(8, 81, "rear", 0.0, model="other"),  # the pair differs
        probe(9, 90, "front", 0.0, error="cut off"),
        probe(10, 100, "front", 0.0, duration=None), probe(10, 101, "front", 60.0),
        probe(11, 110, "front", 0.0, name="same.mp4"), probe(11, 111, "front", 60.0, name="same.mp4"),
        probe(12, 120, "front", 0.0), probe(12, 121, "front", 60.0, first_lat=None, first_lon=None, first_t=None),
        probe(13, 130, "front", None, name_start=5.0), probe(13, 131, "front", 60.0),  # clocks of different kinds
    ]
    names = [c.split(" ")[0] for c in PROBE.split(", ")]
    probes = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PROBE)
    points = track(spark, []).withColumn("clip_id", F.lit(None).cast("long"))
    slots, problems = multiclip.plan(probes, multiclip.checked(multiclip.candidates(probes), probes, points))
    return [tuple(r) for r in slots.orderBy("job_id", "slot_no").collect()], {(r["job_id"], r["clip_id"], r["code"]) for r in problems.collect()}


def test_plan_orders_and_pairs(planned):
    slots, _ = planned
    assert [s[1:4] + s[5:] for s in slots if s[0] == 1] == [(1, 11, 12, "gps", True), (2, 10, 13, "gps", True), (3, None, 14, "gps", True)]
    assert [(s[1], s[2], s[5], s[6]) for s in slots if s[0] == 6] == [(1, 60, "filename", True), (2, 61, "filename", True)]
    assert {s[0] for s in slots if s[6]} == {1, 6}


def test_plan_names_every_problem(planned):
    assert planned[1] == {
        (2, 20, "gap"), (3, 30, "overlap"), (4, 40, "too_far"), (5, 51, "device"), (7, 70, "no_clock"), (8, 81, "pair_differs"), (9, 90, "unreadable"), (10, 100, "no_duration"),
        (11, 111, "same_file"), (12, 120, "no_coordinates"), (13, None, "mixed_clocks"),
    }


def test_a_rear_goes_to_the_first_free_front_that_fits(spark):
    rows = [(1, 1, 11, 1, 11, []), (1, 1, 12, 1, 12, []), (1, 2, 12, 2, 12, ["model"]), (1, 1, 13, 1, 13, []), (1, 3, 13, 3, 13, [])]
    judged = spark.createDataFrame(rows, "job_id long, front_id long, rear_id long, front_ord long, rear_ord long, problems array<string>").withColumns({"front_at": F.lit(0.0), "rear_at": F.lit(0.0)})
    probes = spark.createDataFrame([(1, i, "front" if i < 10 else "rear", i, None) for i in (1, 2, 3, 11, 12, 13)], "job_id long, clip_id long, side string, ord long, error string")
    slots, problems = multiclip.slots_of(probes, judged)
    assert {(r["front_id"], r["rear_id"]) for r in slots.collect()} == {(1, 11), (2, None), (3, 13)}
    assert [(r["clip_id"], r["code"], r["detail"]) for r in problems.collect()] == [(12, "pair_differs", "model")]


def test_clips_become_one_track(spark):
    tracks = None
    for clip in (7, 8):
        rows = [{"t": float(i), "v": v} for i, v in enumerate([30.0, 30.0, 12.0, 12.0, 12.0])]
        one = track(spark, rows, case=clip).withColumn("clip_id", F.lit(clip).cast("long"))
        tracks = one if tracks is None else tracks.unionByName(one)
    slots = spark.createDataFrame([(1, 1, 8, True), (1, 2, 7, True), (2, 1, 9, False)], "job_id long, slot_no int, clip_id long, combined boolean")
    lengths = spark.createDataFrame([(7, 5.0), (8, 0.0), (9, 5.0)], "clip_id long, duration double")
    whole, found, records = multiclip.run_sequence(tracks, slots, lengths)
    assert [(r["clip_id"], r["offset_sec"], r["row_base"], r["span"]) for r in records.orderBy("slot_no").collect()] == [(8, 0.0, 0, 5.0), (7, 5.0, 5, 5.0)]
    assert [(r["row_idx"], r["start_time_sec"], r["segment_index"]) for r in whole.orderBy("row_idx").collect()] == [(i, float(i), i // 5) for i in range(10)]
    assert [(r["segment_index"], r["kind"], r["start_index"], r["start_time"]) for r in found.orderBy("start_index").collect()] == [(0, "decel", 1, 1.0), (1, "decel", 6, 6.0)]
    case = multiclip.combined_cases(records).first()
    assert (case["n_clips"], case["duration_sec"], case["worst"], case["status_detail"]) == (2, 10.0, "ok", "")


def test_rears_of_every_vehicle_by_time(spark):
    rows = [{"t": i * 1.1} for i in range(25)]
    points = track(spark, rows, 2).union(track(spark, rows, 7)).union(track(spark, rows[:12], 22)).union(track(spark, rows[3:], 41))
    starts = {}
    for case, n, t0 in ((2, 25, 0.0), (7, 25, 0.0), (22, 12, 0.0), (41, 22, 3.3)):
        starts |= {case * 100 + i: (case, case % 20 * 2 + i * 11 + t0 + i * 1.1) for i in range(0, n, 10)}
    expected = {(f, r) for f, (a, x) in starts.items() for r, (b, y) in starts.items() if a % 2 == 0 and b % 2 == 1 and abs(x - y) <= 3}
    got = [(x["front_id"], x["rear_id"]) for x in linkage.rear_by_time(*queries_clips._all_starts(points)).collect()]
    assert sorted(got) == sorted(expected) and {(f // 100, r // 100) for f, r in got} == {(2, 41), (22, 41)}


def clips(spark, n, step):
    return spark.range(n).select(F.col("id").alias("clip_id"), (F.col("id") * step % 1200 / 10).alias("start"))


def test_pairs_of_all_vehicles_are_all_there_in_lists_of_any_length(spark, monkeypatch):
    front, rear = clips(spark, 150, 7919), clips(spark, 140, 6007).withColumn("start", F.floor(F.col("start") / 7) * 7 + 0.1)
    expected = sorted((f[0], r[0], f[1], r[1]) for f in front.collect() for r in rear.collect() if abs(f[1] - r[1]) <= 3)
    for length, most in ((256, 2_000), (2, 2_000), (2, 5)):
        monkeypatch.setattr(linkage, "LIST_ROWS", length)
        monkeypatch.setattr(linkage, "FRONT_ROWS", length + 1)
        monkeypatch.setattr(linkage, "PAIRS_A_TASK", 4_000_000 if length == 256 else 10)
        monkeypatch.setattr(linkage, "MOST_TASKS", most)
        got = linkage.rear_by_time(front, rear)
        assert sorted(tuple(x) for x in got.select("front_id", "rear_id", "front_start", "rear_start").collect()) == expected
    assert linkage.rear_by_time(front.filter("clip_id < 0"), rear).count() == 0


def test_pairs_of_all_vehicles_take_little_space(spark, tmp_path):
    """Rows came bucket by bucket in any order, so a file held several bytes of each of a number of rows that grows with the square."""
    linkage.rear_by_time(clips(spark, 4000, 7919), clips(spark, 4000, 6007)).write.parquet(str(tmp_path / "pairs"))
    n = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < n


def test_a_clock_that_is_written_is_not_read_from_texts_again(spark):
    """The clock of every row was parsed once for its filter and once for each use."""
    points = track(spark, [{"t": float(i), "v": 30.0} for i in range(9)]).withColumn("clip_id", F.col("case_id"))
    written = multiclip.clocked(points).localCheckpoint()
    starts = multiclip.clip_starts(written)
    assert "gps_date" not in starts._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    assert starts.collect() == multiclip.clip_starts(points).collect() != []
