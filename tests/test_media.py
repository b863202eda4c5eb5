"""Bytes in ranges and tables of video files, against brute force."""

import random

import pytest

from fleetlens.operators import sample_tables
from fleetlens.sources import byte_ranges
from fleetlens.sources.files import rmc_sentences


def sentence(body):
    check = 0
    for c in body.encode():
        check ^= c
    return f"${body}*{check:02X}".encode()


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    r = random.Random(4)
    folder = tmp_path_factory.mktemp("files")
    data = {}
    for name, n in (("a.bin", 40), ("b.bin", 3), ("empty.bin", 0), ("deep/c.bin", 25)):
        out = b""
        for i in range(n):
            out += sentence(f"GPRMC,{i // 2:06d}.00,{'V' if i % 9 == 4 else 'A'},3730.5000,N,12701.2500,{'EW'[i % 2]},{i}.5,10.0,180624,,") + bytes(r.choices([0, 65, 36], k=r.randrange(90)))
            if i % 7 == 3:
                out += bytes(r.randrange(100, 700))
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_bytes(out)
        data[name.rsplit("/")[-1]] = out
    (folder / "_SUCCESS").write_bytes(bytes(5000))
    return str(folder), data


def named(path):
    return path.rsplit("/", 1)[-1]


@pytest.mark.parametrize("size", [64, 200, 4 << 20])
def test_sentences_do_not_depend_on_ranges(spark, files, size):
    folder, data = files
    expected = set()
    for name, content in data.items():
        seen = {}
        for at, date, utc, lat, lon, speed in rmc_sentences(content):
            seen.setdefault((date, utc), (name, at, date, utc, lat, lon, speed))
        expected |= set(seen.values())
    got = byte_ranges.carve_sentences(byte_ranges.read_ranges(spark, folder, size, byte_ranges.SENTENCE_BYTES)).collect()
    assert {(named(r["path"]), r["at"], r["gps_date"], r["gps_utc_time"], r["latitude"], r["longitude"], r["speed_kmh"]) for r in got} == expected
    assert len(got) == len(expected) > 20


def test_members_of_one_file_are_files_of_their_own(spark, files, tmp_path):
    """Files put one after another give what they give alone: ranges, overlaps, runs and repeats end with a member."""
    _, data = files
    members, whole = [], b""
    for name, content in data.items():
        members.append((f"file://{tmp_path}/all.bin", name, len(whole), len(content)))
        whole += content
    (tmp_path / "all.bin").write_bytes(whole)
    table = spark.createDataFrame(members, "path string, name string, begin long, size long")
    expected, zeros = set(), set()
    for name, content in data.items():
        seen = {}
        for at, date, utc, *_ in rmc_sentences(content):
            seen.setdefault((date, utc), (name, at))
        expected |= set(seen.values())
        blocks = [i for i in range(0, len(content), 32) if not any(content[i : i + 32])]
        zeros |= {(name, i) for i in blocks}
    for size in (96, 4 << 20):
        got = byte_ranges.carve_sentences(byte_ranges.read_members(table, size, byte_ranges.SENTENCE_BYTES)).collect()
        assert {(r["path"], r["at"]) for r in got} == expected and len(got) == len(expected) > 20
        runs = byte_ranges.zero_runs(byte_ranges.read_members(table, size), block=32, least=1).collect()
        assert {(r["path"], i) for r in runs for i in range(r["a"], r["b"], 32)} == zeros and zeros


@pytest.mark.parametrize("size", [32, 96, 1 << 20])
def test_zero_runs_do_not_depend_on_ranges(spark, files, size):
    folder, data = files
    expected = set()
    for name, content in data.items():
        start = None
        for at in range(0, len(content) + 32, 32):
            piece = content[at : at + 32]
            if piece and not any(piece):
                start = at if start is None else start
            else:
                end = min(at, len(content))
                if start is not None and end - start >= 128:
                    expected.add((name, start, end))
                start = None
    got = byte_ranges.zero_runs(byte_ranges.read_ranges(spark, folder, size), block=32, least=128).collect()
    assert {(named(r["path"]), r["a"], r["b"]) for r in got} == expected
    assert expected


def test_small_files_share_tasks_and_large_ones_are_split(files):
    folder, data = files
    whole = byte_ranges.RangeReader({"path": folder}).partitions()
    assert len(whole) == 1 and sorted(named(p[0]) for p in whole[0].parts) == ["a.bin", "b.bin", "c.bin"]
    split = byte_ranges.RangeReader({"path": f"{folder}/a.bin", "range_bytes": "100", "task_bytes": "1000"}).partitions()
    assert [p.parts[0][1:3] for p in split] == [(a, min(a + 1000, len(data["a.bin"]))) for a in range(0, len(data["a.bin"]), 1000)]


def test_samples_of_a_track(spark):
    r = random.Random(9)
    chunks, per, durations, shifts, sizes, expected = [], [], [], [], [], []
    for track in (1, 2):
        offsets = [1000 * c + r.randrange(50) for c in range(1, 21)]
        chunks += [(track, c, o) for c, o in enumerate(offsets, start=1)]
        entries = {1: 2, 5: 1, 6: 3, 15: 2}
        per += [(track, c, n) for c, n in entries.items()]
        deltas = [d for d, n in ((10, 4), (7, 0), (12, 20)) for _ in range(n)]
        durations += [(track, i, n, d) for i, (d, n) in enumerate(((10, 4), (7, 0), (12, 20)))]
        moved = [s for s, n in ((3, 2), (0, 5)) for _ in range(n)]
        shifts += [(track, i, n, s) for i, (s, n) in enumerate(((3, 2), (0, 5)))]
        no, now, n = 0, 0, 0
        for c, o in enumerate(offsets, start=1):
            n = entries.get(c, n)
            for _ in range(n):
                no += 1
                size = r.randrange(5, 40)
                sizes.append((track, no, size))
                timed = no <= len(deltas)
                shift = moved[no - 1] if no <= len(moved) else 0
                expected.append((track, no, c, o, size, now if timed else None, now + shift if timed else None))
                o += size
                now += deltas[no - 1] if timed else 0
    frame = [
        spark.createDataFrame(rows, schema)
        for rows, schema in (
            (chunks, "track_id long, chunk_no long, offset long"), (per, "track_id long, first_chunk long, n long"), (durations, "track_id long, run_no long, n long, delta long"),
            (shifts, "track_id long, run_no long, n long, shift long"), (sizes, "track_id long, sample_no long, size long"),
        )
    ]
    assert sorted(map(tuple, sample_tables.samples(*frame).collect())) == sorted(expected)


def test_an_older_recording_ends_a_fragmented_file(spark):
    fragments = spark.createDataFrame(
        [(1, 1, 100, 1, True), (1, 2, 200, 2, True), (1, 3, 300, 7, False), (1, 4, 400, 3, True), (2, 1, 100, 5, True), (2, 2, 200, 5, True), (2, 3, 300, 5, True), (3, 1, 100, 1, True), (3, 2, 200, None, True), (3, 3, 300, 3, True)],
        "file_id int, moof_no int, moof_at long, sequence long, intact boolean",
    )
    ends = spark.createDataFrame([(2, 1, 1, 0, 1000, 100), (2, 2, 1, 960, 1100, 100), (2, 3, 1, 1000, 1200, 100)], "file_id int, moof_no int, track_id int, base_time long, end_time long, timescale int")
    got = {r["file_id"]: (r["end_at"], r["reason"]) for r in sample_tables.recording_ends(fragments, ends).collect()}
    assert got == {1: (400, "sequence"), 2: (300, "clock"), 3: (300, "sequence")}


def test_frames_between_clock_readings(spark):
    clocks = [(1, i * 100, 86396 + i // 2 if i < 8 else i // 2 - 4) for i in range(24)] + [(1, 5000, 100)]
    frames = [(1, i * 100 + j) for i in range(24) for j in range(1, 16)]
    gaps = [(1, 1050)]
    schema = "case_id int, at int"
    row = sample_tables.clock_rates(spark.createDataFrame(clocks, schema + ", utc int"), spark.createDataFrame(frames, schema), spark.createDataFrame(gaps, schema)).first()
    # One step of eleven holds the gap, the last is longer than five seconds.
    assert (row["span_sec"], row["frames"], row["seconds"], row["fps"]) == (104.0, 300, 10.0, 30.0)
    none = sample_tables.clock_rates(spark.createDataFrame([(1, 0, 5)], schema + ", utc int"), spark.createDataFrame(frames, schema), spark.createDataFrame([], schema)).first()
    assert (none["span_sec"], none["fps"]) == (0.0, None)


def test_frames_of_many_cases_are_ordered_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sample_tables, "TASK_ROWS", 100)
    frames = spark.range(0, 40 * 50).selectExpr("id div 50 AS case_id", "id % 50 * 10 + 5 AS at")
    clocks = spark.range(0, 40 * 10).selectExpr("id div 10 AS case_id", "id % 10 * 50 AS at", "cast(id % 10 AS int) AS utc")
    out = sample_tables.clock_rates(clocks, frames, frames.limit(0))
    assert {tuple(x) for x in out.select("span_sec", "frames", "seconds", "fps").collect()} == {(9.0, 45, 9.0, 5.0)} and out.count() == 40
    assert "REPARTITION_BY_NUM, [plan_id" in out._jdf.queryExecution().executedPlan().toString() and "case_id#" in out.columns[0] + "#"
    assert any(f", {n})" in out._jdf.queryExecution().executedPlan().toString() for n in (24, 25))
