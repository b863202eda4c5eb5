"""Histories, documents, carved GPS and analyses opened again."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import damage, history, reopen
from fleetlens.sources import documents

from .tracks import track


def log(spark, rows):
    return spark.createDataFrame(rows, history.CHANGE)


def test_history_replays_inserts_updates_and_deletions(spark, tmp_path):
    batches = [
        [(1, 1, "insert", {"case_number": "A", "settings": '{"v": 1}'}), (2, 2, "insert", {"case_number": "B"}), (3, 3, "update", {"memo": "of nobody"})],
        [(1, 4, "update", {"memo": "x", "damage": '{"mode": "none"'}), (2, 5, "delete", {}), (4, 6, "insert", {"case_number": "D", "memo": "old"})],
        [(1, 7, "update", {"memo": None, "segments": "{}"}), (2, 8, "update", {"memo": "late"}), (4, 9, "delete", {}), (4, 10, "insert", {"case_number": "E"})],
    ]
    path = str(tmp_path / "log")
    for b in (*batches, batches[0]):
        history.append_changes(log(spark, b), path)
    got = {r["case_id"]: r for r in history.replay(history.read_changes(spark, path)).collect()}
    assert set(got) == {1, 4}
    assert (got[1]["case_number"], got[1]["memo"], got[1]["settings"], got[1]["segments"], got[1]["damage"]) == ("A", "", '{"v":1}', "[]", None)
    assert (got[4]["case_number"], got[4]["memo"], got[4]["settings"]) == ("E", "", "{}")


def test_history_of_nothing(spark):
    assert history.replay(log(spark, [])).count() == 0


def test_snapshots_of_different_ages(spark, tmp_path):
    path = str(tmp_path / "cases")
    spark.createDataFrame([(1, 1, "A"), (2, 1, "B")], "case_id long, version long, case_number string").write.mode("append").parquet(path)
    spark.createDataFrame([(2, 2, "C", '{"m": 1}'), (3, 2, "D", "{}")], "case_id long, version long, case_number string, damage string").write.mode("append").parquet(path)
    got = {r["case_id"]: (r["case_number"], r["damage"], r["segments"]) for r in history.read_cases(spark, path).collect()}
    assert got == {1: ("A", None, "[]"), 2: ("C", '{"m":1}', "[]"), 3: ("D", None, "[]")}


def test_documents_are_there_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "documents")
    cases = spark.range(1, 6).withColumnRenamed("id", "case_id")
    assert {r["outcome"] for r in documents.read(cases, root).collect()} == {"absent"}
    batch = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": '), (3, "7"), (4, "")], "case_id long, document string")
    documents.commit(batch, root)
    staged = documents.stage(batch.withColumn("document", F.lit('{"a": 2}')), root)
    assert {r["case_id"]: (r["outcome"], r["document"]) for r in documents.read(cases, root).collect()} == {
        1: ("ok", '{"a":1}'), 2: ("corrupt", "{}"), 3: ("not_object", "{}"), 4: ("corrupt", "{}"), 5: ("absent", "{}")
    }
    assert documents.publish(spark, staged, root) == 2
    assert documents.read(cases, root).filter("document = '{\"a\":2}'").count() == 4
    with pytest.raises(FileNotFoundError):
        documents.publish(spark, staged, root)


def rows(n, **more):
    return [{"t": float(i), "v": 30.0, "at": i * 1000} | more for i in range(n)]


def test_carved_rows_are_adopted_only_if_there_are_more(spark):
    engine = track(spark, rows(5), case=1).unionByName(track(spark, rows(9), case=2))
    carved = track(spark, rows(6), case=1).unionByName(track(spark, rows(9), case=2)).unionByName(track(spark, rows(3), case=3))
    points, slack, outcomes = reopen.promote_carved(engine, carved)
    got = {r["case_id"]: (r["outcome"], r["n_rows"], r["n_slack"]) for r in outcomes.collect()}
    assert got == {1: ("carved_over_engine", 6, 0), 2: ("engine", 9, 0), 3: ("carved", 3, 0)}
    assert slack.count() == 0
    assert [r["start_time_sec"] for r in points.filter("case_id = 3").orderBy("row_idx").collect()] == [0.0, 1.0, 2.0]


def test_residue_of_another_recording_goes_to_the_slack(spark):
    old = [{"t": None, "v": 30.0, "utc": f"{100000 + i:06d}.00"} for i in range(3)]
    carved = track(spark, [r | {"utc": f"{i:06d}.00"} for i, r in enumerate(rows(4))] + old)
    points, slack, outcomes = reopen.promote_carved(track(spark, []), carved)
    assert outcomes.first()["outcome"] == "carved"
    assert (points.count(), slack.count()) == (4, 3)


def test_damage_of_both_modes_is_replayed_in_one_pass(spark, monkeypatch):
    points = track(spark, [r for i, r in enumerate(rows(20)) if not 5 <= i < 8], 1).union(track(spark, [r for i, r in enumerate(rows(20)) if not 5 <= i < 8], 2))
    regions = spark.createDataFrame([(c, 4500, 7500, "gap") for c in (1, 2)], "case_id long, a long, b long, kind string")
    lengths = spark.createDataFrame([(c, 20.0, False) for c in (1, 2)], "case_id long, duration_sec double, truncated boolean")
    reports = reopen.report_of(regions, lengths, "interpolate").filter("case_id = 1").union(reopen.report_of(regions, lengths, "none").filter("case_id = 2"))
    calls, real = [], damage.synthetic_rows
    monkeypatch.setattr(damage, "synthetic_rows", lambda *a: calls.append(1) or real(*a))
    out = reopen.apply_report(points, reports).filter("recovery_state <> ''").collect()
    assert sorted((r["case_id"], r["start_time_sec"], r["recovery_state"]) for r in out) == [(c, t, s) for c, s in ((1, "interpolated"), (2, "damaged")) for t in (5.0, 6.0, 7.0)]
    assert len(calls) == 1


def test_damage_of_any_length_is_replayed_whole(spark):
    """Of a case's lost seconds 20,000 were made and the rest dropped, which the SQL doesn't do."""
    points = track(spark, [r for i, r in enumerate(rows(20_210)) if not 100 <= i < 20_200])
    regions = spark.createDataFrame([(1, 99_500, 20_199_500, "gap")], "case_id long, a long, b long, kind string")
    lengths = spark.createDataFrame([(1, 20_210.0, False)], "case_id long, duration_sec double, truncated boolean")
    once = reopen.apply_report(points, reopen.report_of(regions, lengths, "interpolate"))
    again = reopen.apply_report(once, reopen.report_of(regions, lengths, "interpolate"))
    at_once = damage.apply_marks(points, damage.intervals(points, regions, lengths))
    for out in (once, again, at_once):
        assert [(r["row_idx"], r["start_time_sec"]) for r in out.orderBy("row_idx").collect()] == [(i, float(i)) for i in range(20_210)]


def test_replayed_damage_is_the_same_again_and_again(spark, tmp_path):
    points = track(spark, [r for i, r in enumerate(rows(40)) if not 10 <= i < 15])
    regions = spark.createDataFrame([(1, 9500, 14500, "gap")], "case_id long, a long, b long, kind string")
    lengths = spark.createDataFrame([(1, 40.0, False)], "case_id long, duration_sec double, truncated boolean")
    reports = reopen.report_of(regions, lengths, "interpolate")
    once = reopen.apply_report(points, reports)
    made = once.filter("recovery_state = 'interpolated'").orderBy("row_idx").collect()
    assert [r["start_time_sec"] for r in made] == [10.0, 11.0, 12.0, 13.0, 14.0]
    twice = reopen.apply_report(once, reports)
    assert [tuple(r) for r in once.select("row_idx", "start_time_sec", "latitude", "recovery_state").orderBy("row_idx").collect()] == [
        tuple(r) for r in twice.select("row_idx", "start_time_sec", "latitude", "recovery_state").orderBy("row_idx").collect()
    ]
    moved = reopen.apply_report(points, reopen.report_of(regions, lengths, "none", shift=100_000))
    assert moved.filter("recovery_state <> ''").count() == 0

    path = str(tmp_path / "store")
    document = reports.select("case_id", F.to_json(F.struct(F.lit("ok").alias("status"), F.parse_json("damage").alias("damage"))).alias("document"))
    reopen.store(once, document, path)
    case_rows = spark.createDataFrame([(1, "", None), (2, "ok", None)], "case_id long, analysis_status string, damage string")
    for _ in range(2):
        again, _, cases = reopen.reopen(case_rows, path)
        assert [(r["row_idx"], r["start_time_sec"]) for r in again.orderBy("row_idx").collect()] == [(i, float(i)) for i in range(40)]
        assert {r["case_id"]: (r["status"], r["outcome"], r["damage_source"]) for r in cases.collect()} == {1: ("ok", "ok", "document"), 2: ("unknown", "absent", "none")}


def test_folders_that_may_go(spark):
    rows = [("/d/c/A_1", True), ("/d/c/A_1/", True), ("/d/c", False), ("/d/c/x/A_1", False), ("/d/c/A_11", False), ("/d/c/../A_1", False), ("", False), (None, False)]
    df = spark.createDataFrame(rows, "folder string, want boolean").withColumn("got", reopen.may_delete(F.col("folder"), F.lit("/d/c"), F.lit(1)))
    assert [r["got"] for r in df.collect()] == [w for _, w in rows]
