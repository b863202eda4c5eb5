import struct

from fleetlens.functions import predicates as P
from fleetlens.sources import files, rows

HEAD = "start_time_sec,end_time_sec,time_source,latitude,longitude,speed_kmh,gps_date,gps_utc_time,gps_checksum_ok,gps_trusted,gps_status,source_offset\n"


def test_timeline_coercions(spark, tmp_path):
    (tmp_path / "timeline.csv").write_text(HEAD + "0.0,1.0,stts, 37.5 ,127,nan,180624,000000,TRUE,yes,A,0x1F\n1,2,gap_carved_utc,abc,inf,10,180624,000001,no,,A,12.0\n")
    got = rows.load_timeline(spark, str(tmp_path), "timeline.csv").orderBy("file_row").collect()
    assert got[0]["latitude"] == 37.5 and got[0]["speed_kmh"] is None and got[0]["gps_trusted"] is True and got[0]["source_offset"] == 31
    assert got[1]["latitude"] is None and got[1]["longitude"] is None and got[1]["gps_checksum_ok"] is False and got[1]["gps_trusted"] is None
    assert got[1]["recovery_state"] == "gap_carved" and got[1]["source_offset"] == 12 and got[1]["x_g"] is None


def test_sidecar_and_primary(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    line = "0.0,1.0,stts,37.5,127,1,180624,000000,{},true,A,\n"
    (tmp_path / "a" / "timeline.csv").write_text(HEAD + line.format("false") * 3)
    (tmp_path / "b" / "timeline.csv").write_text(HEAD + line.format("true"))
    (tmp_path / "coordinates.csv").write_text("start_time_sec,latitude,longitude,date,utc_time,trusted,status_valid\n0.0,37.5,127,180624,000000,true,false\n")
    timeline = rows.load_timeline(spark, str(tmp_path), "timeline.csv")
    assert rows.primary_file(timeline).first()["source_file"].endswith("/b/timeline.csv")
    out = rows.attach_trust(timeline, rows.load_coordinates(spark, str(tmp_path), "coordinates.csv"))
    assert out.filter(P.has_fix()).count() == 0


def test_round_trip(spark, tmp_path):
    (tmp_path / "timeline.csv").write_text(HEAD + "0.5,1.0,stts,37.5,127.25,3.5,180624,000000,true,false,A,5\n")
    first = rows.load_timeline(spark, str(tmp_path), "timeline.csv")
    rows.write_timeline(first, str(tmp_path / "out"))
    again = rows.load_timeline(spark, str(tmp_path / "out"))
    drop = ("source_file", "file_row")
    assert first.drop(*drop).collect() == again.drop(*drop).collect()


def test_tagged_json(spark):
    lines = spark.createDataFrame([(1, 1, 'D {"a": 1}'), (1, 2, "D {broken"), (1, 3, 'D {"a": 3}'), (1, 4, "other")], "run_id int, line_no int, line string")
    assert [(r["line_no"], r["a"]) for r in rows.last_tagged_json(lines, "D", "a int").filter("a is not null").collect()] in ([(3, 3)], [])


def nmea(sec, ok=True):
    body = f"GPRMC,{sec:06d}.00,A,3730.0000,N,12700.0000,E,10.0,84.4,160924,,,A"
    x = 0
    for c in body.encode():
        x ^= c
    return f"${body}*{x if ok else x ^ 1:02X}\r\n".encode()


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_binary_files(spark, tmp_path):
    mvhd = box(b"mvhd", bytes(4) + struct.pack(">IIII", 2_082_844_900, 0, 1000, 60_000))
    hdlr = box(b"hdlr", bytes(8) + b"vide" + bytes(12))
    movie = box(b"ftyp", b"isom0000") + box(b"moov", mvhd + box(b"trak", box(b"mdia", hdlr))) + box(b"mdat", b"x" * 20 + nmea(1) + nmea(1) + nmea(2) + nmea(3, ok=False))
    (tmp_path / "a.mp4").write_bytes(movie)
    (tmp_path / "b.avi").write_bytes(b"RIFF0000AVI " + b"strh0000vids" + b"movi" + bytes(1 << 19))
    f = files.read_files(spark, str(tmp_path))
    kinds = {r["path"][-5:]: (r["container"], r["mismatch"]) for r in files.containers(f).collect()}
    assert kinds == {"a.mp4": ("mp4", False), "b.avi": ("avi", False)}
    assert {r["name"] for r in files.mp4_boxes(f).filter("path like '%mp4'").collect()} == {"/ftyp", "/moov", "/moov/mvhd", "/moov/trak", "/moov/trak/mdia", "/moov/trak/mdia/hdlr", "/mdat"}
    assert files.mp4_durations(f).first()["duration_sec"] == 60.0
    assert {r["n_video"] for r in files.video_tracks(f).collect()} == {1}
    assert files.carve_rmc(f).count() == 2
    run = files.zero_runs(f).first()
    assert run["b"] - run["a"] >= 1 << 18
    assert files.hashes(f).count() == files.sample_digest(f).count() == 2


def test_csv_files_are_written_by_many_tasks(spark, tmp_path):
    """Neither the slack files nor the table for spreadsheets pass through one task, and all rows come back."""
    from fleetlens.plans import queries_small
    from fleetlens.sources import rows as R

    rows = spark.range(0, 900, 1, 6).selectExpr("id", "concat('deep.f', id % 2) AS _f")
    queries_small._named_csv(rows, str(tmp_path / "slack"), "slack.csv", "_f")
    found = list((tmp_path / "slack").rglob("slack.csv"))
    assert len(found) == 12 and all("/deep/f" in str(f) for f in found)
    assert R.read_csv(spark, str(tmp_path / "slack"), "slack.csv").selectExpr("sum(cast(id as long))").first()[0] == sum(range(900))
    queries_small._named_csv(rows.limit(0), str(tmp_path / "none"), "slack.csv", "_f")
    assert R.read_csv(spark, str(tmp_path / "none"), "slack.csv").count() == 0

    R.write_location_csv(rows, str(tmp_path / "sheet"), most=250)
    sheets = [f.read_text("utf-8") for f in (tmp_path / "sheet").glob("part-*")]
    assert len(sheets) > 3 and all(t.startswith("﻿id,_f\n") and t.count("\n") <= 251 for t in sheets)
    assert sum(t.count("\n") - 1 for t in sheets) == 900
