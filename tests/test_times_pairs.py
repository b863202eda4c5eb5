import pytest
from pyspark.sql import functions as F

from fleetlens.functions import texts, times
from fleetlens.operators import cases, curves, pairs
from fleetlens.operators.times import estimate_times
from fleetlens.streaming import sessions

from .tracks import track


def estimated(spark, rows):
    base = track(spark, [{"t": None, "v": 1.0} for _ in rows])
    keys = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_r long, u string, d string, e double, s string")
    points = base.drop("gps_utc_time", "gps_date", "gps_elapsed", "gps_status").join(keys, F.col("row_idx") == F.col("_r"))
    points = points.withColumnsRenamed({"u": "gps_utc_time", "d": "gps_date", "e": "gps_elapsed", "s": "gps_status"}).drop("_r")
    return estimate_times(points).orderBy("row_idx").collect()


def test_midnight_without_dates(spark):
    rows = [("235958", None, None, "A"), ("235959", None, None, "A"), (None, None, None, None), ("000001", None, None, "A")]
    assert [r["start_time_sec"] for r in estimated(spark, rows)] == [0.0, 1.0, 1.0, 3.0]


def test_elapsed_with_an_invalid_row(spark):
    out = estimated(spark, [(None, None, e, s) for e, s in ((100.0, "A"), (101.0, "A"), (101.5, "V"), (102.0, "A"), (103.0, "A"))])
    assert [r["start_time_sec"] for r in out] == [0.0, 1.0, 1.5, 2.0, 3.0] and {r["time_source"] for r in out} == {"gps_elapsed_estimated"}


def test_older_recording_is_cut(spark):
    out = estimated(spark, [("000000", "180624", None, "A"), ("000001", "180624", None, "A"), ("000000", "170624", None, "A"), ("000001", "170624", None, "A")])
    assert [r["excluded"] for r in out] == [False, False, True, True]


@pytest.mark.parametrize(
    ("text", "seconds", "shown"), [("235959.75", 86399.75, 86399), ("23:59:59", 86399.0, 86399), ("240030", 86430.0, None), ("99", None, None), ("", None, None), ("12a000", None, None)]
)
def test_two_readers(spark, text, seconds, shown):
    row = spark.createDataFrame([(text,)], "t string").select(times.utc_seconds(F.col("t")).alias("u"), times.parse_time(F.col("t")).alias("p")).first()
    assert (row["u"] if text else None) == seconds and row["p"] == shown


def test_rear_candidates(spark):
    row = spark.createDataFrame([("20240101_000000_F.MP4",)], "n string").select(texts.rear_candidates(F.col("n"))).first()[0]
    assert row[0] == "20240101_000000_R.MP4" and "20240101_000000_R.mp4" in row and "20240101_000000_F.MP4" not in row and len(row) == 2


def test_monotone_curve(spark):
    rows = [(1, 1, float(i), y) for i, y in enumerate([0.0, 0.0, 5.0, 6.0, 6.0, 2.0])]
    out = curves.monotone_segments(spark.createDataFrame(rows, "case_id long, run_id long, x double, y double")).orderBy("x0").collect()
    assert len(out) == 5
    for r in out:
        low, high = sorted((r["y0"], r["y1"]))
        assert low - 1e-9 <= r["c1y"] <= high + 1e-9 and low - 1e-9 <= r["c2y"] <= high + 1e-9


def test_curves_against_a_walk(spark):
    import math
    import random

    r = random.Random(6)
    rows, expected = [], {}
    for run in range(12):
        y = [float(r.choice([0, 0, 1, 2, 10, 50])) for _ in range(r.randrange(2, 40))]
        x = [float(sum(r.choice([1, 1, 2]) for _ in range(i))) + i for i in range(len(y))]
        x = sorted(set(x))[: len(y)]
        y = y[: len(x)]
        rows += [(1, run, a, b) for a, b in zip(x, y, strict=True)]
        d = [(y[i + 1] - y[i]) / (x[i + 1] - x[i]) for i in range(len(x) - 1)]
        if not d:
            continue
        m = [d[0], *((a + b) / 2 if a * b > 0 else 0.0 for a, b in zip(d, d[1:], strict=False)), d[-1]]
        for i, slope in enumerate(d):
            size = math.hypot(m[i] / slope, m[i + 1] / slope) if slope else math.inf
            for k in (i, i + 1):
                m[k] = 0.0 if not slope else 3 * m[k] / size if size > 3 else m[k]
        expected |= {(run, x[i]): (m[i], m[i + 1]) for i in range(len(d))}
    got = {(t["run_id"], t["x0"]): (t["m0"], t["m1"]) for t in curves.tangents(spark.createDataFrame(rows, "case_id long, run_id long, x double, y double")).collect()}
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_pair_problems(spark):
    side = "struct<path:string,sha256:string,name_time:timestamp,duration:double,recorded_at:timestamp,container:string,brand:string,udta:string,model:string,codec:string>"
    df = spark.sql(f"""select 1 as pair_id, cast(named_struct('path','a','sha256','x','name_time',timestamp'2024-01-01 00:00:00','duration',60d,'recorded_at',null,'container','mp4','brand','i','udta','','model','m','codec','h') as {side}) as front,
      cast(named_struct('path','b','sha256','y','name_time',timestamp'2024-01-01 00:00:05','duration',70d,'recorded_at',null,'container','avi','brand','i','udta','u','model','m','codec','h') as {side}) as rear""")
    assert pairs.compare_pairs(df).first()["problems"] == ["container", "name_time", "duration"]


def test_basis(spark):
    clips = spark.createDataFrame([(1, 1, 5.0, 6.0), (1, 2, None, 7.0), (2, 1, 3.0, None)], "case_id int, clip int, gps_start double, name_start double")
    assert {(r["case_id"], r["clip"], r["basis"], r["start"]) for r in pairs.choose_basis(clips).collect()} == {(1, 1, "filename", 6.0), (1, 2, "filename", 7.0), (2, 1, "gps", 3.0)}


def test_manifest(spark):
    m = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x")], "case_id int, path string, sha256 string")
    f = spark.createDataFrame([(1, "a", "x"), (1, "b", "z"), (1, "c", "w"), (2, "a", "x")], "case_id int, path string, sha256 string")
    assert {r["case_id"]: (r["missing"], r["unlisted"], r["changed"], r["intact"]) for r in cases.verify_manifest(m, f).collect()} == {1: (0, 1, 1, False), 2: (0, 0, 0, True)}


def test_stream_of_recordings(spark, tmp_path):
    source = tmp_path / "in"
    spark.sql("select 1L as case_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,x) as at, 5d as speed_kmh from values (0),(60),(120),(400),(430) as t(x)").write.parquet(str(source))
    stream = spark.readStream.schema("case_id long, at timestamp, speed_kmh double").parquet(str(source))
    query = sessions.recordings(stream).writeStream.format("memory").queryName("recs").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["n_rows"] for r in spark.table("recs").collect()) == [2, 3]


@pytest.mark.parametrize("white", [" ", "\t", "\n", "\r\n", "\x0b\x0c", "\x1c", "\x85", "\xa0", " ", "　"])
def test_white_space_around_texts(spark, white):
    row = spark.createDataFrame([(f"{white}082217{white}", f"{white}180624{white}")], "t string, d string").select(
        times.utc_seconds(F.col("t")).alias("u"), times.parse_time(F.col("t")).alias("p"), times.date_days(F.col("d")).alias("d")
    )
    got = row.first()
    assert got["u"] == 30137.0 and got["p"] is not None and got["d"] is not None
