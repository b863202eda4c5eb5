"""Queries over tracks (rows, windows, events) and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import predicates as P
from ..operators import events as E
from ..operators import sequence as S
from .adapter import ORACLE_CTE, track_points

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (points, spark, sf_dir) -> DataFrame under its name, with its SQL after the adapter's tables."""

    def add(f):
        Q[f.__name__] = lambda spark, sf_dir: f(track_points(spark, sf_dir))
        if sql:
            O[f.__name__] = ("WITH RECURSIVE " if "wk(" in sql else "WITH ") + ORACLE_CTE.strip() + ("," if not sql.lstrip().upper().startswith("SELECT") else "") + "\n" + sql
        return f

    return add


PAIRS = """
us AS (SELECT *, sum(CASE WHEN syn THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY row_idx) AS nsyn FROM pt),
uf AS (SELECT * FROM (SELECT *, lag(rkey) OVER (PARTITION BY case_id ORDER BY row_idx) AS pk FROM us WHERE fix AND NOT syn AND speed_kmh >= 0)
       WHERE rkey IS DISTINCT FROM pk),
pr0 AS (SELECT c.case_id, p.row_idx AS prev_idx, c.row_idx AS cur_idx, (c.t_us - p.t_us) / 1e6 AS dt, p.speed_kmh AS v0, c.speed_kmh AS v1,
   c.segment_index = p.segment_index AND c.nsyn = p.nsyn AS joined
   FROM uf c ASOF JOIN uf p ON c.case_id = p.case_id AND c.t_us - 850000 >= p.t_us),
pr AS (SELECT case_id, prev_idx, cur_idx, dt, (v1 - v0) / dt AS rate, v0, v1 FROM pr0 WHERE joined AND dt <= 5)
"""
EVENTS = PAIRS + """,
crit(vehicle, a1, a2, a3, st, d1, d2, d3, sp) AS (VALUES ('car', 12.0, 10.0, 8.0, 10.0, 14.0, 15.0, 15.0, 14.0),
  ('bus', 8.0, 7.0, 6.0, 8.0, 9.0, 10.0, 12.0, 9.0), ('truck', 7.0, 6.0, 5.0, 6.0, 8.0, 8.0, 8.0, 8.0)),
ht AS (SELECT * FROM (SELECT case_id, vehicle, prev_idx AS s, cur_idx AS e, rate,
  CASE WHEN rate > 0 AND v0 <= 5 THEN CASE WHEN rate >= st THEN 'start' END
       WHEN rate > 0 THEN CASE WHEN rate >= CASE WHEN v0 <= 10 THEN a1 WHEN v0 <= 20 THEN a2 ELSE a3 END THEN 'accel' END
       WHEN rate < 0 AND v1 <= 5 THEN CASE WHEN -rate >= sp THEN 'stop' END
       WHEN rate < 0 AND v1 >= 6 THEN CASE WHEN -rate >= CASE WHEN v0 <= 30 THEN d1 WHEN v0 <= 50 THEN d2 ELSE d3 END THEN 'decel' END END AS kind
  FROM pr, crit WHERE dt <= 1.5) WHERE kind IS NOT NULL),
mg AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, vehicle, kind ORDER BY s, e) AS g FROM (
  SELECT *, max(e) OVER (PARTITION BY case_id, vehicle, kind ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ht)),
evt AS (SELECT case_id, vehicle, kind, min(s) AS start_index, max(e) AS end_index,
  arg_max(rate, struct_pack(a := abs(rate), b := -s, c := -e)) AS peak FROM mg GROUP BY case_id, vehicle, kind, g),
car AS (SELECT *, CASE kind WHEN 'stop' THEN 0 WHEN 'start' THEN 1 WHEN 'accel' THEN 2 ELSE 3 END AS prio FROM evt WHERE vehicle = 'car')
"""


@query("SELECT case_id, row_idx, segment_index, t_us, start_time_sec, latitude, longitude, speed_kmh, gps_checksum_ok, gps_trusted, gps_status, recovery_state FROM tp")
def src_track_points(p: DataFrame) -> DataFrame:
    return p.select("case_id", "row_idx", "segment_index", "t_us", "start_time_sec", "latitude", "longitude", "speed_kmh", "gps_checksum_ok", "gps_trusted", "gps_status", "recovery_state")


@query("""SELECT case_id, row_idx, coords AS has_coords, fix AS has_fix, rec AS has_gps_record, rec AND NOT coords AS is_dropout, syn AS is_synthetic,
 recovery_state = 'gap_carved' AS is_recovered, coalesce(abs(latitude) >= 1e-6 OR abs(longitude) >= 1e-6, false) AS coords_valid,
 coalesce(gps_checksum_ok, true) AND coalesce(gps_trusted, true) AND upper(trim(coalesce(gps_status, ''))) IN ('', 'A') AS time_anchor,
 NOT syn AND fix AND coalesce(speed_kmh >= 0, false) AS usable_speed FROM pt""")
def flt_predicates(p: DataFrame) -> DataFrame:
    """flt_has_fix, flt_dropout, flt_gps_record, flt_synthetic, flt_coords_valid, flt_time_anchor, flt_usable_speed."""
    return p.select(
        "case_id", "row_idx", P.has_coords().alias("has_coords"), P.has_fix().alias("has_fix"), P.has_gps_record().alias("has_gps_record"),
        P.is_dropout().alias("is_dropout"), P.is_synthetic().alias("is_synthetic"), P.is_recovered().alias("is_recovered"), P.coords_valid().alias("coords_valid"),
        P.is_time_anchor().alias("time_anchor"), P.usable_speed().alias("usable_speed"),
    )


@query("SELECT case_id, row_idx, round(g, 9) AS g FROM pt")
def fn_g_magnitude(p: DataFrame) -> DataFrame:
    return p.select("case_id", "row_idx", F.round(P.g_magnitude(), 9).alias("g"))


def _validation(recovered: bool = True):
    base = F.when(P.is_dropout(), "dropout").when(P.verification_failed(), "failed").when(F.coalesce("gps_checksum_ok", F.lit(False)), "ok").otherwise("not_provided")
    state = F.col("recovery_state")
    return F.when(state == "damaged", "damaged").when(state == "interpolated", "interpolated").otherwise(F.when(P.is_recovered(), F.concat(base, F.lit("_recovered"))).otherwise(base))


@query("""SELECT case_id, row_idx, CASE WHEN recovery_state = 'damaged' THEN 'damaged' WHEN rec AND NOT coords THEN 'dropout'
 WHEN gps_checksum_ok = false OR gps_trusted = false THEN 'failed' WHEN gps_checksum_ok THEN 'ok' ELSE 'not_provided' END AS validation FROM pt""")
def prj_validation_text(p: DataFrame) -> DataFrame:
    return p.select("case_id", "row_idx", _validation().alias("validation"))


@query("""SELECT case_id, row_idx, CASE WHEN recovery_state = 'damaged' THEN 'damaged' WHEN rec AND NOT coords THEN 'dropout'
 WHEN gps_checksum_ok = false OR gps_trusted = false THEN 'failed' WHEN fix THEN 'fix' ELSE 'none' END AS cell,
 CASE WHEN fix THEN round_even(latitude, 6) END AS lat_cell, CASE WHEN (gps_checksum_ok = false OR gps_trusted = false) AND NOT (rec AND NOT coords) THEN NULL ELSE round_even(speed_kmh, 1) END AS speed_cell,
 round_even(g, 2) AS g_cell, fix AS has_link FROM pt""")
def prj_row_texts(p: DataFrame) -> DataFrame:
    """Table cells as codes and numbers: damaged > interpolated > outlier > dropout > failed > fix."""
    failed = P.verification_failed() & ~P.is_dropout()
    state = F.col("recovery_state")
    cell = (
        F.when(state == "damaged", "damaged").when(state == "interpolated", "interpolated").when(F.col("is_outlier"), "outlier")
        .when(P.is_dropout(), "dropout").when(failed, "failed").when(P.has_fix(), "fix").otherwise("none")
    )
    return p.select(
        "case_id", "row_idx", cell.alias("cell"), F.when(P.has_fix(), F.bround("latitude", 6)).alias("lat_cell"),
        F.when(~failed, F.bround("speed_kmh", 1)).alias("speed_cell"), F.bround(P.g_magnitude(), 2).alias("g_cell"), P.has_fix().alias("has_link"),
    )


@query("""SELECT case_id, row_idx, CASE WHEN recovery_state = 'damaged' THEN 'damaged' WHEN gps_checksum_ok = false OR gps_trusted = false THEN CASE WHEN rec AND NOT coords THEN 'dropout' ELSE 'failed' END
 WHEN rec AND NOT coords THEN 'dropout' WHEN fix THEN 'fix' ELSE 'no_gps' END AS status FROM pt""")
def prj_playback_status(p: DataFrame) -> DataFrame:
    """Label of the row under the playback cursor: outliers come before drop-outs here."""
    state = F.col("recovery_state")
    status = (
        F.when(state == "damaged", "damaged").when(state == "interpolated", "interpolated").when(F.col("is_outlier"), "outlier")
        .when(P.is_dropout(), "dropout").when(P.verification_failed(), "failed").when(P.has_fix(), "fix").otherwise("no_gps")
    )
    return p.select("case_id", "row_idx", status.alias("status"))


@query("""SELECT case_id, row_idx, rec AND NOT coords AS d, false AS o, (gps_checksum_ok = false OR gps_trusted = false) IS TRUE AS u,
 syn AS h, false AS e, segment_index AS s, recovery_state AS r FROM pt""")
def prj_map_flags(p: DataFrame) -> DataFrame:
    return p.select(
        "case_id", "row_idx", P.is_dropout().alias("d"), F.col("is_outlier").alias("o"), P.verification_failed().alias("u"), P.is_synthetic().alias("h"),
        F.col("time_estimated").alias("e"), F.col("segment_index").alias("s"), F.col("recovery_state").alias("r"),
    )


@query("""u0 AS (SELECT *, lag(rkey) OVER (PARTITION BY case_id ORDER BY row_idx) AS pk FROM pt WHERE fix AND NOT syn AND speed_kmh >= 0)
SELECT case_id, row_idx, speed_kmh FROM u0 WHERE rkey IS DISTINCT FROM pk""")
def win_distinct_fix(p: DataFrame) -> DataFrame:
    return S.distinct_fixes(p).select("case_id", "row_idx", "speed_kmh")


@query(PAIRS + "SELECT case_id, prev_idx, cur_idx, dt, rate, v0, v1 FROM pr")
def win_speed_rate_pairs(p: DataFrame) -> DataFrame:
    return S.speed_rate_pairs(p)


@query(PAIRS + "SELECT case_id, prev_idx, cur_idx, dt FROM pr0")
def jn_rate_window(p: DataFrame) -> DataFrame:
    """The backward as-of join alone, before any pair is dropped."""
    prev = F.max(F.struct("t_us", "row_idx")).over(S.long_before())
    out = S.distinct_fixes(p).withColumn("p", prev).filter("p is not null")
    return out.select("case_id", F.col("p.row_idx").alias("prev_idx"), F.col("row_idx").alias("cur_idx"), ((F.col("t_us") - F.col("p.t_us")) / F.lit(1e6)).alias("dt"))


@query(PAIRS + "SELECT c.case_id, c.row_idx AS cur_idx, n.row_idx AS next_idx FROM uf c ASOF JOIN uf n ON c.case_id = n.case_id AND c.t_us + 850000 <= n.t_us")
def jn_ref_after(p: DataFrame) -> DataFrame:
    nxt = F.min(F.struct("t_us", "row_idx")).over(S.long_after())
    out = S.distinct_fixes(p).withColumn("n", nxt).filter("n is not null")
    return out.select("case_id", F.col("row_idx").alias("cur_idx"), F.col("n.row_idx").alias("next_idx"))


@query(PAIRS + """SELECT pt.case_id, row_idx, CASE WHEN dt <= 1.5 THEN rate / 3.6e0 END AS accel, rate / 3.6e0 AS window_accel, dt AS window_sec
FROM pt LEFT JOIN pr ON pt.case_id = pr.case_id AND pt.row_idx = pr.cur_idx""")
def win_accel(p: DataFrame) -> DataFrame:
    return S.accelerations(p)


SLOTS = """
s0 AS (SELECT *, CASE WHEN syn THEN 'row' || row_idx ELSE rkey END AS sk FROM pt WHERE rec OR coords OR syn),
sl AS (SELECT * FROM (SELECT *, lag(sk) OVER (PARTITION BY case_id ORDER BY row_idx) AS pk FROM s0) WHERE sk IS DISTINCT FROM pk)
"""


@query(SLOTS + "SELECT case_id, row_idx FROM sl")
def win_gps_slots(p: DataFrame) -> DataFrame:
    return S.gps_slots(p).select("case_id", "row_idx")


@query(SLOTS + """SELECT r.case_id, real_rows, coalesce(slots, 0) AS slots,
 coalesce(slots, 0) > 0 AND real_rows - slots >= 5 AND real_rows >= 1.5 * slots AS frame_detail FROM
 (SELECT case_id, count(*) FILTER (WHERE NOT syn) AS real_rows FROM pt GROUP BY case_id) r LEFT JOIN
 (SELECT case_id, count(*) AS slots FROM sl WHERE NOT syn GROUP BY case_id) s ON r.case_id = s.case_id""")
def win_frame_detail(p: DataFrame) -> DataFrame:
    return S.frame_detail(p)


@query("""g0 AS (SELECT *, rkey || '/' || latitude || '/' || longitude AS gk FROM pt WHERE fix AND NOT syn),
g1 AS (SELECT *, CASE WHEN gk IS DISTINCT FROM lag(gk) OVER (PARTITION BY case_id ORDER BY row_idx) THEN 1 ELSE 0 END AS nw FROM g0),
g2 AS (SELECT *, sum(nw) OVER (PARTITION BY case_id ORDER BY row_idx) AS gid FROM g1)
SELECT case_id, CAST(gid AS BIGINT) AS group_id, min(row_idx) AS row_idx, count(*) AS n_rows FROM g2 GROUP BY case_id, gid""")
def win_record_groups(p: DataFrame) -> DataFrame:
    return S.record_groups(p).select("case_id", "group_id", "row_idx", "n_rows")


@query("""SELECT case_id, row_idx, last_value(CASE WHEN fix THEN latitude END IGNORE NULLS) OVER w AS latitude_last,
 last_value(CASE WHEN fix THEN longitude END IGNORE NULLS) OVER w AS longitude_last, last_value(CASE WHEN fix THEN speed_kmh END IGNORE NULLS) OVER w AS speed_kmh_last
FROM pt WINDOW w AS (PARTITION BY case_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def win_forward_fill(p: DataFrame) -> DataFrame:
    return S.forward_fill(p).select("case_id", "row_idx", "latitude_last", "longitude_last", "speed_kmh_last")


HAV = "2 * 6371000e0 * asin(sqrt(least(1e0, greatest(0e0, power(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin(radians({d} - {c}) / 2), 2)))))"
BEAR = "fmod(degrees(atan2(sin(radians({d} - {c})) * cos(radians({b})), cos(radians({a})) * sin(radians({b})) - sin(radians({a})) * cos(radians({b})) * cos(radians({d} - {c})))) + 360, 360)"
STEP = {"a": "plat", "b": "latitude", "c": "plon", "d": "longitude"}


@query("f0 AS (SELECT case_id, row_idx, latitude, longitude, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM pt WHERE fix WINDOW w AS (PARTITION BY case_id ORDER BY row_idx))"
       f"SELECT case_id, row_idx, round({HAV.format(**STEP)}, 4) AS meters FROM f0 WHERE plat IS NOT NULL")
def fn_haversine_m(p: DataFrame) -> DataFrame:
    here = [F.col("latitude"), F.col("longitude")]
    there = [F.lag("latitude").over(S.ordered()), F.lag("longitude").over(S.ordered())]
    out = p.filter(P.has_fix()).select("case_id", "row_idx", F.round(geo.haversine_m(*there, *here), 4).alias("meters"))
    return out.filter("meters is not null")


@query("f0 AS (SELECT case_id, row_idx, latitude, longitude, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM pt WHERE fix WINDOW w AS (PARTITION BY case_id ORDER BY row_idx))"
       f"SELECT case_id, row_idx, round({BEAR.format(**STEP)}, 6) AS bearing FROM f0 WHERE plat IS NOT NULL")
def fn_bearing_deg(p: DataFrame) -> DataFrame:
    here = [F.col("latitude"), F.col("longitude")]
    there = [F.lag("latitude").over(S.ordered()), F.lag("longitude").over(S.ordered())]
    out = p.filter(P.has_fix()).select("case_id", "row_idx", F.round(geo.bearing_deg(*there, *here), 6).alias("bearing"))
    return out.filter("bearing is not null")


@query("f0 AS (SELECT *, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon, (t_us - lag(t_us) OVER w) / 1e6 AS dt FROM pt WHERE fix WINDOW w AS (PARTITION BY case_id ORDER BY row_idx))"
       f"SELECT case_id, row_idx, CASE WHEN dt > 0 THEN round({HAV.format(**STEP)} / dt, 4) END AS mps FROM f0 WHERE dt IS NOT NULL")
def fn_speed_between(p: DataFrame) -> DataFrame:
    here = [F.col("latitude"), F.col("longitude")]
    there = [F.lag("latitude").over(S.ordered()), F.lag("longitude").over(S.ordered())]
    dt = (F.col("t_us") - F.lag("t_us").over(S.ordered())) / F.lit(1e6)
    out = p.filter(P.has_fix()).select("case_id", "row_idx", dt.alias("dt"), geo.haversine_m(*there, *here).alias("m")).filter("dt is not null")
    return out.select("case_id", "row_idx", F.when(F.col("dt") > 0, F.round(F.col("m") / F.col("dt"), 4)).alias("mps"))


@query("f0 AS (SELECT *, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon, (t_us - lag(t_us) OVER w) / 1e6 AS dt FROM pt WHERE fix WINDOW w AS (PARTITION BY case_id ORDER BY row_idx)),"
       "f1 AS (SELECT *, CASE WHEN dt >= 0 AND dt <= 5 THEN 0 ELSE 1 END AS nw FROM f0), f2 AS (SELECT *, sum(nw) OVER (PARTITION BY case_id ORDER BY row_idx) AS run,"
       f" CASE WHEN track_deg IS NOT NULL AND speed_kmh >= 3 THEN fmod(track_deg, 360) WHEN speed_kmh >= 3 AND nw = 0 AND {HAV.format(**STEP)} >= 2 THEN {BEAR.format(**STEP)} END AS own FROM f1)"
       "SELECT case_id, row_idx, round(last_value(own IGNORE NULLS) OVER (PARTITION BY case_id, run ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS heading FROM f2")
def win_headings(p: DataFrame) -> DataFrame:
    return S.headings(p).select("case_id", "row_idx", F.round("heading", 6).alias("heading"))


@query("""c0 AS (SELECT *, sum(CASE WHEN syn OR (rec AND NOT coords) THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY row_idx) AS nb FROM pt),
c1 AS (SELECT *, lag(segment_index) OVER w AS ps, lag(nb) OVER w AS pb, (t_us - lag(t_us) OVER w) / 1e6 AS dt FROM c0 WHERE fix AND NOT syn AND speed_kmh >= 0 WINDOW w AS (PARTITION BY case_id ORDER BY row_idx)),
c2 AS (SELECT *, sum(CASE WHEN ps = segment_index AND pb = nb AND dt <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY case_id ORDER BY row_idx) AS run FROM c1)
SELECT case_id, CAST(run AS BIGINT) AS run_id, min(row_idx) AS first_idx, max(row_idx) AS last_idx, count(*) AS n_points FROM c2 GROUP BY case_id, run""")
def win_curve_runs(p: DataFrame) -> DataFrame:
    return S.curve_runs(p)


@query(EVENTS + """, q0 AS (SELECT *, sum(CASE WHEN recovery_state = 'damaged' THEN 1 ELSE 0 END) OVER w AS nd, sum(CASE WHEN rec AND NOT coords THEN 1 ELSE 0 END) OVER w AS no
  FROM pt WINDOW w AS (PARTITION BY case_id ORDER BY row_idx)),
q1 AS (SELECT case_id, row_idx, segment_index, nd, no, lag(row_idx) OVER w AS fr, lag(segment_index) OVER w AS ps, lag(nd) OVER w AS pd, lag(no) OVER w AS po FROM q0 WHERE fix WINDOW w AS (PARTITION BY case_id ORDER BY row_idx)),
ek AS (SELECT case_id, pos, arg_min(kind, prio) AS kind FROM (SELECT case_id, kind, prio, unnest(range(start_index + 1, end_index + 1)) AS pos FROM car) GROUP BY case_id, pos),
q2 AS (SELECT q1.case_id, row_idx, fr, CASE WHEN nd > pd THEN 'damaged' WHEN ek.kind IS NOT NULL THEN 'event:' || ek.kind WHEN no > po THEN 'dashed' ELSE 'solid' END AS style
  FROM q1 LEFT JOIN ek ON q1.case_id = ek.case_id AND q1.row_idx = ek.pos WHERE fr IS NOT NULL AND ps = segment_index),
q3 AS (SELECT *, CASE WHEN lag(style) OVER w = style AND lag(row_idx) OVER w = fr THEN 0 ELSE 1 END AS nw FROM q2 WINDOW w AS (PARTITION BY case_id ORDER BY row_idx)),
q4 AS (SELECT *, sum(nw) OVER (PARTITION BY case_id ORDER BY row_idx) AS run FROM q3)
SELECT case_id, CAST(run AS BIGINT) AS run_id, style, min(fr) AS first_idx, max(row_idx) AS last_idx, count(*) + 1 AS n_points FROM q4 GROUP BY case_id, run, style""")
def win_polyline_runs(p: DataFrame) -> DataFrame:
    return S.polyline_runs(p, E.detect(p).filter("vehicle = 'car'"))


@query(EVENTS + "SELECT case_id, vehicle, kind, s AS start_index, e AS end_index, rate FROM ht")
def fn_classify_speed_change(p: DataFrame) -> DataFrame:
    return E.hits(p)


@query(EVENTS + "SELECT * FROM evt")
def win_merge_hits(p: DataFrame) -> DataFrame:
    return E.merge_hits(E.hits(p))


@query(EVENTS + """SELECT evt.*, a.start_time_sec AS start_time, a.speed_kmh AS v_start, b.start_time_sec AS end_time, b.speed_kmh AS v_end FROM evt
 JOIN pt a ON evt.case_id = a.case_id AND start_index = a.row_idx JOIN pt b ON evt.case_id = b.case_id AND end_index = b.row_idx""")
def op_detect_driving_events(p: DataFrame) -> DataFrame:
    return E.detect(p)


@query(EVENTS + """, rw AS (SELECT DISTINCT case_id, kind, prio, unnest(range(start_index, end_index + 1)) AS row_idx FROM car)
SELECT case_id, row_idx, string_agg(kind, ',' ORDER BY prio) AS kinds FROM rw GROUP BY case_id, row_idx""")
def jn_event_rows(p: DataFrame) -> DataFrame:
    return E.event_rows(E.detect(p))


@query(EVENTS + """, rw AS (SELECT DISTINCT case_id, kind, prio, unnest(range(start_index + 1, end_index + 1)) AS row_idx FROM car)
SELECT case_id, row_idx, arg_min(kind, prio) AS kind FROM rw GROUP BY case_id, row_idx""")
def jn_event_color(p: DataFrame) -> DataFrame:
    return E.event_colors(E.detect(p))


@query(EVENTS + """, mk AS (SELECT car.case_id, kind, start_index, pt.row_idx, latitude, longitude, row_number() OVER (PARTITION BY car.case_id, kind, start_index ORDER BY pt.row_idx) AS rn,
  count(*) OVER (PARTITION BY car.case_id, kind, start_index) AS n FROM car JOIN pt ON car.case_id = pt.case_id AND pt.row_idx BETWEEN start_index AND end_index AND fix)
SELECT case_id, kind, start_index, row_idx, latitude, longitude FROM mk WHERE rn = n // 2 + 1""")
def jn_event_marker(p: DataFrame) -> DataFrame:
    return E.event_markers(p, E.detect(p))


@query(EVENTS + """SELECT c.case_id, k.kind, count(car.kind) AS n FROM (SELECT DISTINCT case_id FROM pt) c CROSS JOIN (VALUES ('accel'), ('start'), ('decel'), ('stop')) k(kind)
 LEFT JOIN car ON car.case_id = c.case_id AND car.kind = k.kind GROUP BY c.case_id, k.kind""")
def agg_event_counts(p: DataFrame) -> DataFrame:
    return E.event_counts(p, E.detect(p))


@query(EVENTS + """SELECT case_id, vehicle, kind, start_index, row_number() OVER (PARTITION BY case_id, vehicle ORDER BY start_index,
 CASE kind WHEN 'accel' THEN 0 WHEN 'start' THEN 1 WHEN 'decel' THEN 2 ELSE 3 END) AS place FROM evt""")
def srt_events(p: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    order = F.array_position(F.array(*[F.lit(k) for k in E.DISPLAY_ORDER]), F.col("kind"))
    w = Window.partitionBy("case_id", "vehicle").orderBy("start_index", order)
    return E.merge_hits(E.hits(p)).select("case_id", "vehicle", "kind", "start_index", F.row_number().over(w).alias("place"))


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return O
