"""Queries over choices of several clips: probing, pairing, planning, analysing them as one, with their SQL.

A job is a vehicle with one front camera and one or two rear ones: users
0 and 1, then 2, 3 and 4 of every five. Each 30 rows of a track are a clip with playback
times of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import linkage, multiclip
from ..operators import outliers as X
from ..sources.shared import checkpointed, shared_path
from .adapter import ORACLE_CTE, track_points
from .queries_damage import GROUPS
from .queries_track import EVENTS, HAV

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[DataFrame], DataFrame]):
        Q[f.__name__] = lambda spark, sf_dir: f(track_points(spark, sf_dir))
        O[f.__name__] = "WITH RECURSIVE " + ORACLE_CTE.strip() + ",\n" + sql
        return f

    return add


# --- outliers, all passes


def _walk_lists(src: str, x: str) -> str:
    """Groups of ``src`` under names that end in ``x``."""
    named = GROUPS.replace("FROM pt ", f"FROM {src} ")
    for name in ("g0", "g1", "g2", "gr"):
        named = named.replace(f"{name} AS", f"{name}{x} AS").replace(f"FROM {name}", f"FROM {name}{x}")
    return named


def marks_sql(src: str) -> str:
    """``mk``: rows of ``src`` with the reason of the first pass that marks them; each pass groups what those before it have left."""
    lists = "list(t ORDER BY gid) AS t, list(gid ORDER BY gid) AS g"
    unit = "SELECT case_id, gid, arg_min(start_time_sec, row_idx) AS t, arg_min(speed_kmh, row_idx) AS v, arg_min(latitude, row_idx) AS la, arg_min(longitude, row_idx) AS lo FROM g2{x} GROUP BY case_id, gid"

    def metres(i: str, j: str) -> str:
        return HAV.format(a=f"la[{i}]", b=f"la[{j}]", c=f"lo[{i}]", d=f"lo[{j}]")

    return f"""
v0 AS (SELECT *, CASE WHEN NOT syn AND coords THEN CASE WHEN NOT (abs(latitude) >= 1e-6 OR abs(longitude) >= 1e-6) THEN 'coordinates' WHEN speed_kmh > 300 OR speed_kmh < 0 THEN 'speed' END END AS vr FROM {src}),
v1 AS (SELECT * REPLACE (fix AND vr IS NULL AS fix) FROM v0),
{_walk_lists("v1", "x").strip()},
bx AS (SELECT g.*, a.t_us AS ta, a.v AS va FROM grx g ASOF JOIN (SELECT * FROM grx WHERE v IS NOT NULL) a ON g.case_id = a.case_id AND g.t_us - 850000 >= a.t_us),
cx AS (SELECT bx.*, n.t_us AS tc, n.v AS vc FROM bx ASOF JOIN (SELECT * FROM grx WHERE v IS NOT NULL) n ON bx.case_id = n.case_id AND bx.t_us + 850000 <= n.t_us),
kx AS (SELECT case_id, row_idx FROM g2x WHERE (case_id, gid) IN (SELECT (case_id, gid) FROM cx WHERE abs((v - va) / ((t_us - ta) / 1e6)) > 60 AND abs((v - vc) / ((tc - t_us) / 1e6)) > 60
 AND ((v - va) / ((t_us - ta) / 1e6)) * ((v - vc) / ((tc - t_us) / 1e6)) > 0)),
v2 AS (SELECT * REPLACE (fix AND (case_id, row_idx) NOT IN (SELECT (case_id, row_idx) FROM kx) AS fix) FROM v1),
{_walk_lists("v2", "y").strip()},
ly AS (SELECT case_id, {lists}, list(v ORDER BY gid) AS v FROM ({unit.format(x="y")}) WHERE v IS NOT NULL GROUP BY case_id),
wy(case_id, i, kept, bad) AS (SELECT case_id, CAST(1 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM ly
 UNION ALL
 SELECT case_id, CASE WHEN ok THEN i + 1 WHEN bk IS NOT NULL THEN bk + 1 ELSE i + 1 END,
  CASE WHEN ok THEN list_append(kept, i) WHEN bk IS NOT NULL THEN list_append(kept, bk) WHEN t[i] IS NOT NULL AND v[i] > v[b] THEN kept ELSE list_append(kept, i) END,
  CASE WHEN ok THEN bad WHEN bk IS NOT NULL THEN list_concat(bad, range(i, bk)) WHEN v[i] > v[b] THEN list_append(bad, i) ELSE bad END
 FROM (SELECT *, list_filter(range(i + 1, len(t) + 1), lambda j: t[j] - t[b] <= 5 AND abs(v[j] - v[b]) / (t[j] - t[b]) <= 40 AND abs(v[j] - v[b]) < abs(v[j] - v[i]))[1] AS bk
  FROM (SELECT *, b IS NULL OR abs(v[i] - v[b]) / (t[i] - t[b]) <= 40 AS ok
   FROM (SELECT wy.case_id, i, kept, bad, t, v, list_filter(kept, lambda j: t[i] - t[j] >= 0.85)[-1] AS b FROM wy JOIN ly ON wy.case_id = ly.case_id WHERE i <= len(t))))),
ky AS (SELECT g2y.case_id, row_idx FROM g2y JOIN (SELECT wy.case_id, g, unnest(bad) AS x FROM wy JOIN ly ON wy.case_id = ly.case_id WHERE i > len(t)) w ON g2y.case_id = w.case_id AND g2y.gid = w.g[w.x]),
v3 AS (SELECT * REPLACE (fix AND (case_id, row_idx) NOT IN (SELECT (case_id, row_idx) FROM ky) AS fix) FROM v2),
{_walk_lists("v3", "z").strip()},
lz AS (SELECT case_id, {lists}, list(la ORDER BY gid) AS la, list(lo ORDER BY gid) AS lo FROM ({unit.format(x="z")}) GROUP BY case_id),
wz(case_id, i, good, bad) AS (SELECT case_id, CAST(1 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]) FROM lz
 UNION ALL
 SELECT case_id, i + 1, CASE WHEN mark THEN good ELSE i END, CASE WHEN mark THEN list_append(bad, i) ELSE bad END
 FROM (SELECT *, coalesce(CASE WHEN good IS NULL THEN i + 2 <= len(t) AND t[i + 1] > t[i] AND d1 / (t[i + 1] - t[i]) > 100 AND d1 > 150 AND t[i + 2] > t[i + 1] AND d2 < 0.5 * d1
    ELSE t[i] > t[good] AND dg / (t[i] - t[good]) > 100 AND dg > 150 AND (i = len(t) OR dn < 0.5 * dg) END, false) AS mark
  FROM (SELECT wz.case_id, i, good, bad, t, {metres("i", "i + 1")} AS d1, {metres("i + 1", "i + 2")} AS d2, {metres("good", "i")} AS dg, {metres("good", "i + 1")} AS dn
   FROM wz JOIN lz ON wz.case_id = lz.case_id WHERE i <= len(t)))),
kz AS (SELECT g2z.case_id, row_idx FROM g2z JOIN (SELECT wz.case_id, g, unnest(bad) AS x FROM wz JOIN lz ON wz.case_id = lz.case_id WHERE i > len(t)) w ON g2z.case_id = w.case_id AND g2z.gid = w.g[w.x]),
rs AS (SELECT case_id, row_idx, 'spike' AS reason FROM kx UNION ALL SELECT case_id, row_idx, 'rate' FROM ky UNION ALL SELECT case_id, row_idx, 'position' FROM kz),
mk AS (SELECT v0.* REPLACE (fix AND coalesce(vr, reason) IS NULL AS fix), coalesce(vr, reason, '') AS outlier_reason FROM v0 LEFT JOIN rs ON v0.case_id = rs.case_id AND v0.row_idx = rs.row_idx)
"""


@query(marks_sql("pt") + "SELECT case_id, row_idx, outlier_reason <> '' AS is_outlier, outlier_reason FROM mk")
def op_mark_outliers(p: DataFrame) -> DataFrame:
    return X.mark_outliers(p).select("case_id", "row_idx", "is_outlier", "outlier_reason")


# --- clips


def clips_of(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clips with their files' facts, and their tracks in playback time."""
    case = F.col("case_id")
    keyed = p.withColumns({"clip_id": case * 1000 + F.col("segment_index"), "job_id": F.expr("(case_id div 5) * 2 + if(case_id % 5 >= 2, 1, 0)")})
    clip = Window.partitionBy("clip_id")
    t0 = F.min("start_time_sec").over(clip)
    tracks = keyed.withColumns({"_t0": t0}).withColumns({"start_time_sec": F.col("start_time_sec") - F.col("_t0"), "end_time_sec": F.col("end_time_sec") - F.col("_t0")}).drop("_t0")
    files = tracks.groupBy("job_id", "clip_id", "case_id", "segment_index").agg(F.max("end_time_sec").alias("duration"))
    second = F.col("segment_index") * 30
    clock = F.concat(F.lit("00"), F.lpad(F.floor(second / 60).cast("string"), 2, "0"), F.lpad((second % 60).cast("string"), 2, "0"))
    front = case % 5 % 2 == 0
    side = F.when(front & (case % 5 < 4), "front").otherwise("rear")
    name = F.concat(F.lit("v"), F.col("job_id"), F.lit("_20240618_"), clock, F.when(side == "front", "_F.mp4").when(case % 5 == 4, "_R.MP4").otherwise("_R.mp4"))
    files = files.select(
        "job_id", "clip_id", side.alias("side"), F.col("clip_id").alias("ord"), name.alias("name"), "duration", F.col("clip_id").cast("string").alias("sha256"), F.lit("mp4").alias("container"),
        F.lit("isom").alias("brand"), F.lit("").alias("udta"), F.when((case % 11 == 7) & (F.col("segment_index") == 1), "other").otherwise("cam").alias("model"), F.lit("h264").alias("codec"),
        F.when((case % 17 == 5) & (F.col("segment_index") == 1), "cut off").alias("error"),
    )
    return files, tracks


#: The same clips, their tracks ``ct`` (a clip as a case), probes ``pb``, candidates ``cd`` and judged pairs ``jd``.
CLIPS = f"""
c0 AS (SELECT case_id, segment_index, case_id * 1000 + segment_index AS clip_id, (case_id // 5) * 2 + CASE WHEN case_id % 5 >= 2 THEN 1 ELSE 0 END AS job_id, min(start_time_sec) AS t0 FROM pt GROUP BY case_id, segment_index),
ct AS (SELECT pt.* REPLACE (start_time_sec - t0 AS start_time_sec, end_time_sec - t0 AS end_time_sec, clip_id AS case_id), pt.case_id AS user_case, job_id,
  epoch(CAST(gps_date AS TIMESTAMP)) + CAST(substr(gps_utc_time, 3, 2) AS INTEGER) * 60 + CAST(substr(gps_utc_time, 5, 2) AS INTEGER) AS clock FROM pt JOIN c0 ON pt.case_id = c0.case_id AND pt.segment_index = c0.segment_index),
fl AS (SELECT job_id, case_id AS clip_id, CASE WHEN user_case % 5 IN (0, 2) THEN 'front' ELSE 'rear' END AS side, segment_index * 30 AS s, max(end_time_sec) AS duration,
  CASE WHEN user_case % 11 = 7 AND segment_index = 1 THEN 'other' ELSE 'cam' END AS model, CASE WHEN user_case % 17 = 5 AND segment_index = 1 THEN 'cut off' END AS error,
  CASE user_case % 5 WHEN 0 THEN '_F.mp4' WHEN 2 THEN '_F.mp4' WHEN 4 THEN '_R.MP4' ELSE '_R.mp4' END AS tail FROM ct GROUP BY ALL),
s0 AS (SELECT case_id, clock, min(row_idx) AS row_idx, arg_min(clock - start_time_sec, row_idx) AS off FROM ct WHERE fix AND clock IS NOT NULL GROUP BY case_id, clock),
s1 AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY row_idx) AS n FROM s0),
s2 AS (SELECT case_id AS clip_id, list_sort(list(off))[len(list(off)) // 2 + 1] AS gps_start FROM s1 WHERE n <= 7 GROUP BY case_id),
e0 AS (SELECT * FROM (SELECT *, lag(rkey) OVER (PARTITION BY case_id ORDER BY row_idx) AS pk FROM ct WHERE fix AND NOT syn AND speed_kmh >= 0) WHERE rkey IS DISTINCT FROM pk),
e1 AS (SELECT case_id AS clip_id, arg_min(start_time_sec, row_idx) AS first_t, arg_min(latitude, row_idx) AS first_lat, arg_min(longitude, row_idx) AS first_lon,
  arg_max(start_time_sec, row_idx) AS last_t, arg_max(latitude, row_idx) AS last_lat, arg_max(longitude, row_idx) AS last_lon, max(speed_kmh) AS max_kmh FROM e0 GROUP BY case_id),
pb AS (SELECT fl.*, gps_start, epoch(TIMESTAMP '2024-06-18') + s AS name_start, first_t, first_lat, first_lon, last_t, last_lat, last_lon, coalesce(max_kmh, 0e0) AS max_kmh,
  'v' || job_id || '_20240618_00' || lpad(CAST(s // 60 AS VARCHAR), 2, '0') || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || tail AS name
  FROM fl LEFT JOIN s2 ON fl.clip_id = s2.clip_id LEFT JOIN e1 ON fl.clip_id = e1.clip_id),
"""
PLAN = CLIPS + f"""
cd AS (SELECT f.job_id, f.clip_id AS front_id, r.clip_id AS rear_id, f.name_start AS fn, r.name_start AS rn, f.duration AS fd, r.duration AS rd, f.model AS fm, r.model AS rm FROM pb f JOIN pb r ON f.job_id = r.job_id AND f.side = 'front' AND r.side = 'rear'
  AND r.error IS NULL AND (lower(replace(f.name, '_F.', '_R.')) = lower(r.name) OR abs(f.gps_start - r.gps_start) <= 3 OR abs(f.name_start - r.name_start) <= 3)),
k0 AS (SELECT case_id AS clip_id, clock, min(row_idx) AS row_idx, arg_min(CASE WHEN fix THEN struct_pack(la := latitude, lo := longitude) END, row_idx) AS aty, first(fix ORDER BY row_idx) AS fx,
  first(latitude ORDER BY row_idx) AS la, first(longitude ORDER BY row_idx) AS lo FROM ct WHERE rec AND clock IS NOT NULL GROUP BY case_id, clock),
k1 AS (SELECT clip_id, arg_min(clock, row_idx) AS began FROM k0 GROUP BY clip_id),
k2 AS (SELECT front_id, rear_id, count(*) AS matches, count(m) AS nd, median(m) AS mid FROM (SELECT front_id, rear_id, CASE WHEN f.fx AND r.fx THEN {HAV.format(a="f.la", b="r.la", c="f.lo", d="r.lo")} END AS m
  FROM cd JOIN k0 f ON f.clip_id = front_id JOIN k0 r ON r.clip_id = rear_id AND r.clock = f.clock) GROUP BY ALL),
jd AS (SELECT cd.job_id, cd.front_id, cd.rear_id, list_filter([CASE WHEN fm <> rm THEN 'model' END, CASE WHEN abs(fn - rn) > 3 THEN 'name_time' END, CASE WHEN abs(fd - rd) > greatest(2e0, 0.05e0 * greatest(fd, rd)) THEN 'duration' END,
  CASE WHEN abs(a.began - b.began) > 3 THEN 'start_differs' WHEN a.began IS NOT NULL AND b.began IS NOT NULL AND coalesce(matches, 0) = 0 THEN 'no_common_time' WHEN nd >= 3 AND mid > 50 THEN 'too_far' END], lambda x: x IS NOT NULL) AS problems
  FROM cd LEFT JOIN k1 a ON a.clip_id = cd.front_id LEFT JOIN k1 b ON b.clip_id = cd.rear_id LEFT JOIN k2 ON k2.front_id = cd.front_id AND k2.rear_id = cd.rear_id),
en AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY rear_id, front_id) AS n FROM jd WHERE len(problems) = 0),
wm(job_id, n, fs, rs) AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM en
 UNION ALL SELECT wm.job_id, wm.n + 1, CASE WHEN list_contains(fs, front_id) OR list_contains(rs, rear_id) THEN fs ELSE list_append(fs, front_id) END,
  CASE WHEN list_contains(fs, front_id) OR list_contains(rs, rear_id) THEN rs ELSE list_append(rs, rear_id) END FROM wm JOIN en ON wm.job_id = en.job_id AND en.n = wm.n + 1),
tk AS (SELECT job_id, unnest(fs) AS front_id, unnest(rs) AS rear_id FROM (SELECT job_id, arg_max(fs, n) AS fs, arg_max(rs, n) AS rs FROM wm GROUP BY job_id)),
fa AS (SELECT jd.job_id, jd.rear_id AS clip_id, arg_min(array_to_string(problems, ','), jd.front_id) AS detail FROM jd LEFT JOIN tk ON jd.front_id = tk.front_id
  WHERE jd.rear_id NOT IN (SELECT rear_id FROM tk) AND (tk.rear_id IS NULL OR tk.rear_id > jd.rear_id) GROUP BY ALL),
p0 AS (SELECT job_id, clip_id, 'unreadable' AS code, error AS detail FROM pb WHERE side = 'rear' AND error IS NOT NULL UNION ALL SELECT job_id, clip_id, 'pair_differs', detail FROM fa),
sl AS (SELECT pb.job_id, clip_id AS front_id, rear_id, clip_id, 0 AS late FROM pb LEFT JOIN tk ON pb.clip_id = tk.front_id WHERE side = 'front'
  UNION ALL SELECT job_id, NULL, clip_id, clip_id, 1 FROM pb WHERE side = 'rear' AND clip_id NOT IN (SELECT rear_id FROM tk) AND clip_id NOT IN (SELECT clip_id FROM p0)),
ld AS (SELECT pb.*, late FROM sl JOIN pb ON sl.clip_id = pb.clip_id WHERE sl.job_id NOT IN (SELECT job_id FROM p0)),
p1 AS (SELECT job_id, clip_id, 'unreadable' AS code, error AS detail FROM ld WHERE error IS NOT NULL),
op AS (SELECT * FROM ld WHERE job_id NOT IN (SELECT job_id FROM p1)),
bs AS (SELECT job_id, CASE WHEN bool_and(gps_start IS NOT NULL) THEN 'gps' ELSE 'filename' END AS basis FROM op GROUP BY job_id),
pl AS (SELECT op.*, basis, CASE basis WHEN 'gps' THEN gps_start ELSE name_start END AS start FROM op JOIN bs ON op.job_id = bs.job_id),
po AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start, late, clip_id) AS place FROM pl),
p2 AS (SELECT po.job_id, po.clip_id, 'device' AS code, 'model' AS detail FROM po JOIN po f ON f.job_id = po.job_id AND f.place = 1 WHERE po.model <> f.model),
n0 AS (SELECT a.job_id, a.clip_id, b.start - a.start - a.duration AS gap, {HAV.format(a="a.last_lat", b="b.first_lat", c="a.last_lon", d="b.first_lon")} AS m,
  greatest(a.max_kmh, b.max_kmh, 10e0) / 3.6e0 * greatest(1e0, abs(b.start + b.first_t - a.start - a.last_t)) + 50 AS reach FROM po a JOIN po b ON a.job_id = b.job_id AND b.place = a.place + 1),
p3 AS (SELECT job_id, clip_id, CASE WHEN gap > 5 THEN 'gap' WHEN gap < -5 THEN 'overlap' WHEN m IS NULL THEN 'no_coordinates' WHEN m > reach THEN 'too_far' END AS code, '' AS detail FROM n0),
pq AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 WHERE code IS NOT NULL),
so AS (SELECT sl.job_id, row_number() OVER (PARTITION BY sl.job_id ORDER BY place NULLS FIRST, sl.late, sl.clip_id) AS slot_no, front_id, rear_id, sl.clip_id, coalesce(basis, '') AS basis, sl.job_id NOT IN (SELECT job_id FROM pq) AS combined
  FROM sl LEFT JOIN po ON po.clip_id = sl.clip_id)
"""


def _planned(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    files, tracks = clips_of(p)
    tracks = checkpointed(multiclip.clocked(tracks))
    probes = checkpointed(multiclip.probe_clips(files, tracks))
    judged = checkpointed(multiclip.checked(multiclip.candidates(probes), probes, tracks))
    slots, problems = multiclip.plan(probes, judged)
    return tracks.drop("_clock"), probes, slots, problems


@query(CLIPS.rstrip().rstrip(",") + " SELECT job_id, clip_id, side, name, gps_start, name_start, duration, first_t, first_lat, last_t, last_lat, max_kmh, error FROM pb")
def op_probe_clip(p: DataFrame) -> DataFrame:
    """What is read of every clip before a plan is made."""
    probes = multiclip.probe_clips(*clips_of(p))
    return probes.select("job_id", "clip_id", "side", "name", "gps_start", "name_start", "duration", "first_t", "first_lat", "last_t", "last_lat", "max_kmh", "error")


@query(PLAN + "SELECT job_id, CAST(slot_no AS INTEGER) AS slot_no, front_id, rear_id, basis, combined FROM so")
def op_plan_sequence(p: DataFrame) -> DataFrame:
    """Slots of every job in order: front, rear, the clock they are compared by, and whether they become one."""
    return _planned(p)[2].select("job_id", "slot_no", "front_id", "rear_id", "basis", "combined")


@query(PLAN + "SELECT job_id, clip_id, code, detail FROM pq")
def op_probe_and_plan(p: DataFrame) -> DataFrame:
    """All that speaks against combining the clips of a job."""
    return _planned(p)[3].select("job_id", "clip_id", "code", "detail")


#: Combined jobs: marked tracks ``mk`` and events ``car`` of their leading clips, and a record ``rc`` for each.
RUN = PLAN + """,
le AS (SELECT ct.* FROM ct JOIN so ON ct.case_id = so.clip_id WHERE combined),
""" + marks_sql("le") + "," + EVENTS.replace("FROM pt)", "FROM mk)", 1) + """,
r0 AS (SELECT so.job_id, slot_no, so.clip_id, coalesce(nullif(duration, 0), 0) AS span, n_rows, n_fixes, n_outliers, base, CASE WHEN n_fixes = 0 THEN 'gps_untrusted' ELSE 'ok' END AS status
  FROM so JOIN fl ON fl.clip_id = so.clip_id JOIN (SELECT case_id, count(*) AS n_rows, count(*) FILTER (WHERE fix) AS n_fixes, count(*) FILTER (WHERE outlier_reason <> '') AS n_outliers, min(row_idx) AS base FROM mk GROUP BY case_id) m ON m.case_id = so.clip_id WHERE combined),
rc AS (SELECT *, coalesce(sum(span) OVER w, 0e0) AS offset_sec, CAST(coalesce(sum(n_rows) OVER w, 0) AS BIGINT) AS row_base FROM r0 WINDOW w AS (PARTITION BY job_id ORDER BY slot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


@query(RUN + """SELECT rc.job_id, CAST(slot_no - 1 AS INTEGER) AS segment_index, clip_id, 'video' || slot_no AS label, 'seg' || lpad(CAST(slot_no AS VARCHAR), 2, '0') AS output_subdir, round(offset_sec, 6) AS offset_sec,
 round(span, 6) AS duration_sec, row_base, n_rows, n_fixes, n_outliers, status FROM rc""")
def op_run_sequence(p: DataFrame) -> DataFrame:
    """The record of every clip of the combined jobs: its place in the whole and what its analysis found."""
    tracks, probes, slots, _ = _planned(p)
    records = multiclip.run_sequence(tracks, slots, probes.select("clip_id", "duration"))[2]
    names = ("job_id", "segment_index", "clip_id", "label", "output_subdir", F.round("offset_sec", 6).alias("offset_sec"), F.round("span", 6).alias("duration_sec"), "row_base", "n_rows", "n_fixes", "n_outliers", "status")
    return records.select(*names)


@query(RUN + """SELECT rc.job_id, CAST(slot_no - 1 AS INTEGER) AS segment_index, kind, start_index - base + row_base AS start_index, end_index - base + row_base AS end_index, round(peak, 9) AS peak,
 round(a.start_time_sec + offset_sec, 6) AS start_time, round(b.start_time_sec + offset_sec, 6) AS end_time FROM car JOIN rc ON car.case_id = rc.clip_id
 JOIN mk a ON a.case_id = car.case_id AND a.row_idx = start_index JOIN mk b ON b.case_id = car.case_id AND b.row_idx = end_index""")
def op_sequence_events(p: DataFrame) -> DataFrame:
    """Events of the combined jobs in the whole's rows and times."""
    tracks, probes, slots, _ = _planned(p)
    found = multiclip.run_sequence(tracks, slots, probes.select("clip_id", "duration"))[1]
    return found.select("job_id", "segment_index", "kind", "start_index", "end_index", F.round("peak", 9).alias("peak"), F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"))


#: Stored tracks hold no rows that are made, so reopened clips count only real ones.
REAL = RUN.replace("count(*) AS n_rows, count(*) FILTER (WHERE fix)", "count(*) FILTER (WHERE NOT syn) AS n_rows, count(*) FILTER (WHERE fix)")


@query(REAL + """SELECT rc.job_id, CAST(slot_no - 1 AS INTEGER) AS segment_index, clip_id, round(offset_sec, 6) AS offset_sec, round(span, 6) AS duration_sec, row_base, n_rows, n_fixes, n_outliers, status FROM rc WHERE rc.job_id % 7 <> 2""")
def op_reopen_sequence(p: DataFrame) -> DataFrame:
    """Combined jobs stored and opened again: the records of the first analysis; one in seven is not asked for."""
    tracks, probes, slots, _ = _planned(p)
    records = multiclip.run_sequence(tracks, slots, probes.select("clip_id", "duration"))[2]
    path = shared_path(p.sparkSession, "sequences")
    multiclip.store_sequence(tracks, records, path)
    jobs = records.filter("job_id % 7 <> 2").select("job_id").distinct()
    again = multiclip.reopen_sequence(jobs, path)
    return again[2].select("job_id", "segment_index", "clip_id", F.round("offset_sec", 6).alias("offset_sec"), F.round("span", 6).alias("duration_sec"), "row_base", "n_rows", "n_fixes", "n_outliers", "status")


# --- pairs by start time


def _starts(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clips of a vehicle's two cameras, so close together that several rears meet a front."""
    clips = p.groupBy(F.expr("case_id div 2").alias("group_id"), "case_id", "segment_index").agg(F.min("start_time_sec").alias("t"))
    clips = clips.select("group_id", (F.col("case_id") * 1000 + F.col("segment_index")).alias("clip_id"), (F.col("t") / 16 + F.col("case_id") % 3 * 0.5).alias("start"), "case_id")
    return clips.filter("case_id % 2 = 0"), clips.filter("case_id % 2 = 1")


STARTS = """
cp AS (SELECT case_id // 2 AS group_id, case_id * 1000 + segment_index AS clip_id, min(start_time_sec) / 16 + case_id % 3 * 0.5e0 AS start, case_id FROM pt GROUP BY case_id, segment_index),
cd AS (SELECT f.group_id, f.clip_id AS front_id, r.clip_id AS rear_id, f.start AS fs, r.start AS rs FROM cp f JOIN cp r ON f.group_id = r.group_id AND f.case_id % 2 = 0 AND r.case_id % 2 = 1 AND abs(f.start - r.start) <= 3)
"""


def _all_starts(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clips of ten rows of every even case as fronts and of every odd one as rears, whatever the vehicle."""
    clips = p.groupBy("case_id", F.expr("row_idx div 10").alias("clip")).agg(F.min("row_idx").alias("first"), F.min(F.expr("case_id % 20 * 2 + row_idx * 11 + t_us / 1e6")).alias("start"))
    clips = clips.select((F.col("case_id") * 100 + F.col("first")).alias("clip_id"), "start", "case_id")
    return clips.filter("case_id % 2 = 0"), clips.filter("case_id % 2 = 1")


@query("""
cp AS (SELECT case_id * 100 + min(row_idx) AS clip_id, min(case_id % 20 * 2 + row_idx * 11 + t_us / 1e6) AS start, case_id FROM pt GROUP BY case_id, row_idx // 10),
cd AS (SELECT f.clip_id AS front_id, f.start AS fs, r.clip_id AS rear_id, r.start AS rs FROM cp f JOIN cp r ON f.case_id % 2 = 0 AND r.case_id % 2 = 1 AND abs(f.start - r.start) <= 3)
SELECT front_id, rear_id, fs AS front_start, rs AS rear_start FROM cd""")
def jn_rear_by_time(p: DataFrame) -> DataFrame:
    """Every rear clip that starts within 3 s of a front clip, over all vehicles."""
    return linkage.rear_by_time(*_all_starts(p)).select("front_id", "rear_id", "front_start", "rear_start")


@query(STARTS + """, en AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY cost, front_id, rear_id) AS n FROM (SELECT *, round(abs(fs - rs), 3) AS cost FROM cd)),
wm(group_id, n, fs, rs, cs) AS (SELECT DISTINCT group_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST([] AS DOUBLE[]) FROM en
 UNION ALL SELECT wm.group_id, wm.n + 1, CASE WHEN list_contains(wm.fs, front_id) OR list_contains(wm.rs, rear_id) THEN wm.fs ELSE list_append(wm.fs, front_id) END,
  CASE WHEN list_contains(wm.fs, front_id) OR list_contains(wm.rs, rear_id) THEN wm.rs ELSE list_append(wm.rs, rear_id) END,
  CASE WHEN list_contains(wm.fs, front_id) OR list_contains(wm.rs, rear_id) THEN wm.cs ELSE list_append(wm.cs, cost) END FROM wm JOIN en ON wm.group_id = en.group_id AND en.n = wm.n + 1)
SELECT group_id, unnest(fs) AS front_id, unnest(rs) AS rear_id, unnest(cs) AS cost FROM (SELECT group_id, arg_max(fs, n) AS fs, arg_max(rs, n) AS rs, arg_max(cs, n) AS cs FROM wm GROUP BY group_id)""")
def jn_pair_assignment(p: DataFrame) -> DataFrame:
    found = linkage.rear_by_time(*_starts(p), keys=["group_id"]).withColumn("cost", F.round(F.abs(F.col("front_start") - F.col("rear_start")), 3))
    return linkage.assign_pairs(found).select("group_id", "front_id", "rear_id", "cost")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return Q


def oracle_sql() -> dict[str, str]:
    return O
