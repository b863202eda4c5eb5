"""Queries over outliers, damage, reports and linkage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import damage as D
from ..operators import events as E
from ..operators import linkage as L
from ..operators import outliers as X
from ..operators import report as R
from ..operators import sequence as S
from . import queries_track as T
from .queries_track import EVENTS, HAV, PAIRS, SLOTS

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        T.query(sql)(f)
        Q[f.__name__] = T.Q.pop(f.__name__)
        if sql:
            O[f.__name__] = T.O.pop(f.__name__)
        return f

    return add


# --- outliers


@query("SELECT case_id, row_idx, CASE WHEN NOT (abs(latitude) >= 1e-6 OR abs(longitude) >= 1e-6) THEN 'coordinates' ELSE 'speed' END AS reason FROM pt WHERE NOT syn AND coords AND (NOT (abs(latitude) >= 1e-6 OR abs(longitude) >= 1e-6) OR speed_kmh > 300 OR speed_kmh < 0)")
def win_outlier_value(p: DataFrame) -> DataFrame:
    return X.value_outliers(p)


GROUPS = """
g0 AS (SELECT *, rkey || '/' || latitude || '/' || longitude AS gk FROM pt WHERE fix AND NOT syn),
g1 AS (SELECT *, CASE WHEN gk IS DISTINCT FROM lag(gk) OVER (PARTITION BY case_id ORDER BY row_idx) THEN 1 ELSE 0 END AS nw FROM g0),
g2 AS (SELECT *, sum(nw) OVER (PARTITION BY case_id ORDER BY row_idx) AS gid FROM g1),
gr AS (SELECT case_id, CAST(gid AS BIGINT) AS gid, min(row_idx) AS row_idx, max(row_idx) AS last_idx, arg_min(t_us, row_idx) AS t_us, arg_min(speed_kmh, row_idx) AS v FROM g2 GROUP BY case_id, gid)
"""


@query(GROUPS + """, b AS (SELECT g.*, a.t_us AS ta, a.v AS va FROM gr g ASOF JOIN gr a ON g.case_id = a.case_id AND g.t_us - 850000 >= a.t_us),
c AS (SELECT b.*, n.t_us AS tc, n.v AS vc FROM b ASOF JOIN gr n ON b.case_id = n.case_id AND b.t_us + 850000 <= n.t_us)
SELECT case_id, gid AS group_id, row_idx, last_idx FROM c WHERE abs((v - va) / ((t_us - ta) / 1e6)) > 60 AND abs((v - vc) / ((tc - t_us) / 1e6)) > 60
 AND ((v - va) / ((t_us - ta) / 1e6)) * ((v - vc) / ((tc - t_us) / 1e6)) > 0""")
def win_outlier_speed_spike(p: DataFrame) -> DataFrame:
    return X.spike_groups(S.record_groups(p))


#: Groups of a case as lists, for walks from position to position.
LISTS = GROUPS + """, gl AS (SELECT g2.case_id, CAST(gid AS BIGINT) AS gid, min(row_idx) AS row_idx, arg_min(start_time_sec, row_idx) AS t, arg_min(speed_kmh, row_idx) AS v,
 arg_min(latitude, row_idx) AS la, arg_min(longitude, row_idx) AS lo FROM g2 GROUP BY case_id, gid),
"""


@query(LISTS + """ls AS (SELECT case_id, list(t ORDER BY gid) AS t, list(v ORDER BY gid) AS v, list(gid ORDER BY gid) AS g, list(row_idx ORDER BY gid) AS r FROM gl WHERE v IS NOT NULL GROUP BY case_id),
wk(case_id, i, kept, bad) AS (SELECT case_id, CAST(1 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM ls
 UNION ALL
 SELECT case_id, CASE WHEN ok THEN i + 1 WHEN bk IS NOT NULL THEN bk + 1 ELSE i + 1 END,
  CASE WHEN ok THEN list_append(kept, i) WHEN bk IS NOT NULL THEN list_append(kept, bk) WHEN t[i] IS NOT NULL AND v[i] > v[b] THEN kept ELSE list_append(kept, i) END,
  CASE WHEN ok THEN bad WHEN bk IS NOT NULL THEN list_concat(bad, range(i, bk)) WHEN v[i] > v[b] THEN list_append(bad, i) ELSE bad END
 FROM (SELECT *, list_filter(range(i + 1, len(t) + 1), lambda j: t[j] - t[b] <= 5 AND abs(v[j] - v[b]) / (t[j] - t[b]) <= 40 AND abs(v[j] - v[b]) < abs(v[j] - v[i]))[1] AS bk
  FROM (SELECT *, b IS NULL OR abs(v[i] - v[b]) / (t[i] - t[b]) <= 40 AS ok
   FROM (SELECT wk.case_id, i, kept, bad, t, v, list_filter(kept, lambda j: t[i] - t[j] >= 0.85)[-1] AS b FROM wk JOIN ls ON wk.case_id = ls.case_id WHERE i <= len(t)))))
SELECT case_id, g[x] AS group_id, r[x] AS row_idx FROM (SELECT wk.case_id, g, r, unnest(bad) AS x FROM wk JOIN ls ON wk.case_id = ls.case_id WHERE i > len(t))""")
def win_outlier_rate_limit(p: DataFrame) -> DataFrame:
    return X.rate_groups(S.record_groups(p)).select("case_id", "group_id", "row_idx")


def _metres(i: str, j: str) -> str:
    return HAV.format(a=f"la[{i}]", b=f"la[{j}]", c=f"lo[{i}]", d=f"lo[{j}]")


@query(LISTS + f"""ls AS (SELECT case_id, list(t ORDER BY gid) AS t, list(la ORDER BY gid) AS la, list(lo ORDER BY gid) AS lo, list(gid ORDER BY gid) AS g, list(row_idx ORDER BY gid) AS r FROM gl GROUP BY case_id),
wk(case_id, i, good, bad) AS (SELECT case_id, CAST(1 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]) FROM ls
 UNION ALL
 SELECT case_id, i + 1, CASE WHEN mark THEN good ELSE i END, CASE WHEN mark THEN list_append(bad, i) ELSE bad END
 FROM (SELECT *, coalesce(CASE WHEN good IS NULL THEN i + 2 <= len(t) AND t[i + 1] > t[i] AND d1 / (t[i + 1] - t[i]) > 100 AND d1 > 150 AND t[i + 2] > t[i + 1] AND d2 < 0.5 * d1
    ELSE t[i] > t[good] AND dg / (t[i] - t[good]) > 100 AND dg > 150 AND (i = len(t) OR dn < 0.5 * dg) END, false) AS mark
  FROM (SELECT wk.case_id, i, good, bad, t, {_metres("i", "i + 1")} AS d1, {_metres("i + 1", "i + 2")} AS d2, {_metres("good", "i")} AS dg, {_metres("good", "i + 1")} AS dn
   FROM wk JOIN ls ON wk.case_id = ls.case_id WHERE i <= len(t))))
SELECT case_id, g[x] AS group_id, r[x] AS row_idx FROM (SELECT wk.case_id, g, r, unnest(bad) AS x FROM wk JOIN ls ON wk.case_id = ls.case_id WHERE i > len(t))""")
def win_outlier_position_jump(p: DataFrame) -> DataFrame:
    return X.jump_groups(S.record_groups(p)).select("case_id", "group_id", "row_idx")


# --- damage: one region of 1000 bytes around every damaged row


def regions(p: DataFrame) -> DataFrame:
    at = F.col("source_offset")
    kind = F.when(F.col("row_idx") % 2 == 0, "gap").otherwise("zero")
    return p.filter("recovery_state = 'damaged'").select("case_id", (at - 500).alias("a"), (at + 500).alias("b"), kind.alias("kind"))


def durations(p: DataFrame) -> DataFrame:
    return p.groupBy("case_id").agg((F.max("start_time_sec") + (F.col("case_id") % 5)).alias("duration_sec")).withColumn("truncated", F.lit(True))


REGIONS = """
rg AS (SELECT case_id, source_offset - 500 AS a, source_offset + 500 AS b, CASE WHEN row_idx % 2 = 0 THEN 'gap' ELSE 'zero' END AS kind FROM pt WHERE recovery_state = 'damaged'),
m0 AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY case_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM rg),
m1 AS (SELECT *, sum(nw) OVER (PARTITION BY case_id ORDER BY a, b) AS run FROM m0),
mr AS (SELECT case_id, min(a) AS a, max(b) AS b, CASE WHEN bool_or(kind = 'gap') THEN 'gap' ELSE 'zero' END AS kind FROM m1 GROUP BY case_id, run)
"""
SPACING = """,
ra AS (SELECT * FROM pt WHERE NOT syn),
gp AS (SELECT case_id, start_time_sec - lag(start_time_sec) OVER (PARTITION BY case_id ORDER BY start_time_sec) AS gap FROM ra),
ns AS (SELECT case_id, CASE WHEN count(*) FILTER (WHERE gap > 1e-6) < 2 THEN 1e0 ELSE list_sort(list(gap) FILTER (WHERE gap > 1e-6))[count(*) FILTER (WHERE gap > 1e-6) // 2 + 1] END AS nominal FROM gp GROUP BY case_id)
"""
INTERVALS = REGIONS + SPACING + """,
st AS (SELECT *, source_offset AS lo, lead(source_offset) OVER w AS hi, start_time_sec AS t0, lead(start_time_sec) OVER w AS t1 FROM ra WINDOW w AS (PARTITION BY case_id ORDER BY source_offset)),
i0 AS (SELECT st.case_id, round(t0, 3) AS start_sec, round(t1, 3) AS end_sec, arg_max(mr.kind, mr.a) AS kind FROM st JOIN ns ON st.case_id = ns.case_id
  JOIN mr ON mr.case_id = st.case_id AND mr.a < hi AND mr.b > lo WHERE t1 > t0 + (nominal * 1.5e0 + 1e-6) GROUP BY st.case_id, lo, t0, t1),
ea AS (SELECT case_id, arg_min(source_offset, source_offset) AS fo, arg_min(start_time_sec, source_offset) AS ft, max(source_offset) AS lof, arg_max(start_time_sec, source_offset) AS lt, max(start_time_sec) AS mt FROM ra GROUP BY case_id),
wh AS (SELECT case_id, min(a) AS a0, max(b) AS b1, arg_max(kind, a) AS lk FROM mr GROUP BY case_id),
du AS (SELECT case_id, max(start_time_sec) + case_id % 5 AS dur FROM pt GROUP BY case_id),
ed AS (SELECT ea.*, a0, b1, lk, dur, nominal * 1.5e0 + 1e-6 AS thr FROM ea JOIN ns ON ea.case_id = ns.case_id JOIN du ON ea.case_id = du.case_id LEFT JOIN wh ON ea.case_id = wh.case_id),
i1 AS (SELECT * FROM i0 UNION ALL SELECT case_id, 0e0, round(ft, 3), 'head' FROM ed WHERE a0 < fo AND ft > thr
  UNION ALL SELECT case_id, round(lt, 3), round(dur, 3), lk FROM ed WHERE b1 > lof AND dur - lt > thr
  UNION ALL SELECT case_id, round(mt, 3), round(dur, 3), 'truncated' FROM ed WHERE dur - mt >= greatest(2e0, thr) AND NOT coalesce(b1 > lof AND dur - lt > thr, false)),
i2 AS (SELECT *, CASE WHEN start_sec < max(end_sec) OVER (PARTITION BY case_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM i1),
i3 AS (SELECT *, sum(nw) OVER (PARTITION BY case_id ORDER BY start_sec, end_sec) AS run FROM i2),
iv AS (SELECT case_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, arg_min(kind, struct_pack(s := start_sec, e := end_sec)) AS kind FROM i3 GROUP BY case_id, run)
"""


@query(REGIONS + "SELECT case_id, a, b FROM mr")
def win_merge_regions(p: DataFrame) -> DataFrame:
    return D.merge_regions(regions(p).select("case_id", "a", "b"))


@query("""r0 AS (SELECT case_id, source_offset - 1500 AS a, source_offset + 1500 AS b FROM pt WHERE row_idx % 7 = 0),
m0 AS (SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY case_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM r0),
m1 AS (SELECT *, sum(nw) OVER (PARTITION BY case_id ORDER BY a, b) AS run FROM m0) SELECT case_id, min(a) AS a, max(b) AS b FROM m1 GROUP BY case_id, run""")
def win_merge_intervals(p: DataFrame) -> DataFrame:
    """Only strictly overlapping ranges merge."""
    at = F.col("source_offset")
    return D.merge_regions(p.filter("row_idx % 7 = 0").select("case_id", (at - 1500).alias("a"), (at + 1500).alias("b")), touching=False)


@query(REGIONS + "SELECT case_id, CAST(sum(b - a) AS BIGINT) AS damaged_bytes, count(*) FILTER (WHERE kind = 'gap') AS n_gaps FROM rg GROUP BY case_id")
def agg_damaged_bytes(p: DataFrame) -> DataFrame:
    return regions(p).groupBy("case_id").agg(F.sum(F.col("b") - F.col("a")).alias("damaged_bytes"), F.count_if(F.col("kind") == "gap").alias("n_gaps"))


@query(REGIONS + SPACING + "SELECT case_id, nominal FROM ns")
def agg_nominal_spacing(p: DataFrame) -> DataFrame:
    return D.nominal_spacing(D.real_timed(p))


@query(REGIONS + """, ru AS (SELECT case_id, 0 AS a, max(source_offset) + 1000 AS b FROM pt GROUP BY case_id),
pc AS (SELECT ru.case_id, ru.a AS ra, ru.b AS rb, mr.a AS x, mr.b AS y FROM ru JOIN mr ON mr.case_id = ru.case_id AND mr.a < ru.b AND mr.b > ru.a),
cu AS (SELECT case_id, coalesce(lag(y) OVER w, ra) AS a, x AS b FROM pc WINDOW w AS (PARTITION BY case_id ORDER BY x) UNION ALL SELECT case_id, max(y), max(rb) FROM pc GROUP BY case_id
 UNION ALL SELECT case_id, a, b FROM ru WHERE case_id NOT IN (SELECT case_id FROM pc)) SELECT case_id, a, b FROM cu WHERE b - a >= 2000""")
def jn_subtract_ranges(p: DataFrame) -> DataFrame:
    runs = p.groupBy("case_id").agg((F.max("source_offset") + 1000).alias("b")).withColumn("a", F.lit(0).cast("long"))
    return D.subtract_ranges(runs, regions(p).select("case_id", "a", "b"), least=2000)


@query(INTERVALS + "SELECT * FROM iv")
def win_intervals(p: DataFrame) -> DataFrame:
    return D.intervals(p, regions(p), durations(p))


OCC = INTERVALS + """,
ca AS (SELECT iv.*, unnest(range(CAST(floor(start_sec) AS BIGINT) + 1, CAST(ceil(end_sec) AS BIGINT))) AS t FROM iv),
fr AS (SELECT ca.*, least(0.5e0, coalesce(nominal, 1e0) / 2e0) AS w FROM ca LEFT JOIN ns ON ca.case_id = ns.case_id),
fs AS (SELECT * FROM fr WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.case_id = fr.case_id AND ra.start_time_sec >= fr.t - fr.w AND ra.start_time_sec < fr.t + fr.w))
"""


@query(OCC + "SELECT case_id, start_sec, end_sec, CAST(t AS BIGINT) AS t FROM fs")
def jn_occupied_anti(p: DataFrame) -> DataFrame:
    return D.free_seconds(p, D.intervals(p, regions(p), durations(p))).select("case_id", "start_sec", "end_sec", "t")


AROUND = OCC + """,
fx AS (SELECT * FROM pt WHERE fix AND NOT syn),
bf AS (SELECT iv.case_id, iv.start_sec, iv.end_sec, iv.kind, b.row_idx AS bi, b.start_time_sec AS bt, b.latitude AS blat, b.longitude AS blon, b.speed_kmh AS bv FROM iv ASOF LEFT JOIN fx b ON iv.case_id = b.case_id AND iv.start_sec >= b.start_time_sec),
af AS (SELECT bf.*, a.row_idx AS ai, a.start_time_sec AS at_, a.latitude AS alat, a.longitude AS alon FROM bf ASOF LEFT JOIN fx a ON bf.case_id = a.case_id AND bf.end_sec <= a.start_time_sec),
mv AS (SELECT af.*, m.start_time_sec AS mt, m.speed_kmh AS mv FROM af ASOF LEFT JOIN (SELECT * FROM fx WHERE speed_kmh >= 3) m ON af.case_id = m.case_id AND af.start_sec >= m.start_time_sec),
vr AS (SELECT *, CASE WHEN bv >= 3 THEN bv WHEN bt - mt <= 60 THEN mv ELSE 0e0 END AS v_ref FROM mv)
"""


@query(AROUND + "SELECT case_id, start_sec, end_sec, bi AS before_idx, ai AS after_idx FROM vr")
def jn_fix_before_after(p: DataFrame) -> DataFrame:
    out = D.fixes_around(p, D.intervals(p, regions(p), durations(p)))
    return out.select("case_id", "start_sec", "end_sec", F.col("before.row_idx").alias("before_idx"), F.col("after.row_idx").alias("after_idx"))


@query(AROUND + "SELECT case_id, start_sec, v_ref FROM vr")
def win_reference_speed(p: DataFrame) -> DataFrame:
    return D.fixes_around(p, D.intervals(p, regions(p), durations(p))).select("case_id", "start_sec", "v_ref")


JUDGED = AROUND + f""",
jd AS (SELECT *, v_ref / 3.6e0 * greatest(at_ - bt, 1e-3) AS expected, {HAV.format(a="blat", b="alat", c="blon", d="alon")} AS actual FROM vr),
jg AS (SELECT *, CASE WHEN bi IS NULL OR ai IS NULL OR start_sec - bt > 5 OR at_ - end_sec > 5 THEN 'no_anchor' WHEN actual > 1.5e0 * expected + 50 THEN 'implausible' ELSE 'interpolated' END AS outcome FROM jd)
"""


@query(JUDGED + "SELECT case_id, start_sec, end_sec, kind, outcome FROM jg")
def op_interval_text(p: DataFrame) -> DataFrame:
    """Outcome of every interval as a code."""
    out = D.judge(D.fixes_around(p, D.intervals(p, regions(p), durations(p))))
    return out.select("case_id", "start_sec", "end_sec", "kind", "outcome")


@query(JUDGED + """SELECT fs.case_id, CAST(fs.t AS DOUBLE) AS start_time_sec, CASE WHEN outcome = 'interpolated' THEN 'interpolated' ELSE 'damaged' END AS recovery_state,
 CASE WHEN outcome = 'interpolated' THEN round(blat + (alat - blat) * ((fs.t - bt) / (at_ - bt)), 9) END AS latitude, CASE WHEN outcome = 'interpolated' THEN round(blon + (alon - blon) * ((fs.t - bt) / (at_ - bt)), 9) END AS longitude
 FROM fs JOIN jg ON fs.case_id = jg.case_id AND fs.start_sec = jg.start_sec AND fs.end_sec = jg.end_sec""")
def op_apply_damage_marks(p: DataFrame) -> DataFrame:
    out = D.synthetic_rows(p, D.intervals(p, regions(p), durations(p)), budget=None)
    return out.select("case_id", "start_time_sec", "recovery_state", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"))


@query(JUDGED + """, al AS (SELECT case_id, start_time_sec, false AS syn, row_idx FROM ra UNION ALL SELECT case_id, CAST(t AS DOUBLE), true, NULL FROM fs)
SELECT case_id, start_time_sec, syn AS synthetic, row_number() OVER (PARTITION BY case_id ORDER BY start_time_sec, syn, row_idx) - 1 AS row_idx FROM al""")
def op_apply_damage(p: DataFrame) -> DataFrame:
    """Real and synthetic rows as one track (also set_union_rows)."""
    out = D.apply_marks(p, D.intervals(p, regions(p), durations(p)))
    return out.select("case_id", "start_time_sec", P.is_synthetic().alias("synthetic"), "row_idx")


@query(JUDGED + ", nn AS (SELECT case_id, start_sec, t, row_number() OVER (PARTITION BY case_id ORDER BY start_sec, t) AS n FROM fs) SELECT case_id, CAST(count(*) AS BIGINT) AS n_rows FROM nn WHERE n <= 3 GROUP BY case_id")
def top_placeholder_budget(p: DataFrame) -> DataFrame:
    out = D.synthetic_rows(p, D.intervals(p, regions(p), durations(p)), budget=3)
    return out.groupBy("case_id").agg(F.count("*").alias("n_rows"))


# --- reports


@query("""SELECT case_id, count(*) FILTER (WHERE NOT syn) AS real, count(*) FILTER (WHERE recovery_state = 'damaged') AS damaged, count(*) FILTER (WHERE recovery_state = 'interpolated') AS interpolated,
 count(*) FILTER (WHERE NOT syn AND fix) AS fix, CAST(0 AS BIGINT) AS outlier, count(*) FILTER (WHERE NOT syn AND rec AND NOT coords) AS dropout,
 count(*) FILTER (WHERE NOT syn AND (gps_checksum_ok = false OR gps_trusted = false) AND NOT (rec AND NOT coords)) AS failed, count(*) FILTER (WHERE NOT syn AND NOT rec AND NOT coords) AS unrecorded,
 count(*) FILTER (WHERE NOT syn AND coords AND gps_checksum_ok AND coalesce(gps_trusted, true)) AS ok, count(*) FILTER (WHERE NOT syn AND coords AND gps_checksum_ok IS NULL AND coalesce(gps_trusted, true)) AS unknown FROM pt GROUP BY case_id""")
def agg_report_counts(p: DataFrame) -> DataFrame:
    return R.report_counts(p)


@query("SELECT case_id, count(*) FILTER (WHERE fix AND NOT syn) AS fixes, count(*) FILTER (WHERE rec AND NOT coords) AS dropouts, CAST(0 AS BIGINT) AS outliers FROM pt GROUP BY case_id")
def agg_fix_count(p: DataFrame) -> DataFrame:
    """agg_fix_count and agg_dropout_outlier_counts."""
    return p.groupBy("case_id").agg(F.count_if(P.has_fix() & ~P.is_synthetic()).alias("fixes"), F.count_if(P.is_dropout()).alias("dropouts"), F.count_if("is_outlier").alias("outliers"))


@query(PAIRS + """SELECT r.case_id, avg_kmh, max_kmh, coalesce(n, 0) AS n_used, r.c - coalesce(n, 0) AS n_excluded FROM (SELECT case_id, count(*) AS c FROM pt GROUP BY case_id) r LEFT JOIN
 (SELECT case_id, CAST(sum(CAST(round(speed_kmh * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS avg_kmh, max(speed_kmh) AS max_kmh, count(*) AS n FROM uf GROUP BY case_id) u ON r.case_id = u.case_id""")
def agg_speed_stats(p: DataFrame) -> DataFrame:
    return R.speed_stats(p)


@query(PAIRS + "SELECT c.case_id, count(pr.case_id) FILTER (WHERE dt <= 1.5) AS judged FROM (SELECT DISTINCT case_id FROM pt) c LEFT JOIN pr ON c.case_id = pr.case_id GROUP BY c.case_id")
def agg_judged_pairs(p: DataFrame) -> DataFrame:
    return R.judged_pairs(p)


@query("SELECT case_id, round(max(g), 9) AS max_g, arg_min(start_time_sec, struct_pack(a := -g, b := row_idx)) AS at_sec, arg_min(row_idx, struct_pack(a := -g, b := row_idx)) + 1 AS row_no, count(*) FILTER (WHERE g >= 2) AS n_impacts FROM pt WHERE g IS NOT NULL GROUP BY case_id")
def agg_impact_summary(p: DataFrame) -> DataFrame:
    return R.impact_summary(p).withColumn("max_g", F.round("max_g", 9))


@query(SLOTS + """, gg AS (SELECT * FROM (SELECT case_id, t_us - lag(t_us) OVER (PARTITION BY case_id ORDER BY row_idx) AS us FROM sl WHERE NOT syn) WHERE us > 0),
md AS (SELECT case_id, median(us) AS mid FROM gg GROUP BY case_id), mn AS (SELECT gg.case_id, CAST(sum(us) AS DOUBLE) / count(*) / 1e6 AS mean FROM gg JOIN md ON gg.case_id = md.case_id WHERE abs(us - mid) <= 0.3e0 * mid GROUP BY gg.case_id),
sn AS (SELECT *, round_even(mean * 10, 0) / 10 AS s FROM mn)
SELECT c.case_id, coalesce(CASE WHEN mean IS NOT NULL THEN least(10e0, greatest(0.1e0, CASE WHEN s > 0 AND abs(mean - s) <= 0.03e0 * s THEN s ELSE mean END)) END, 1e0) AS interval_sec
FROM (SELECT DISTINCT case_id FROM pt) c LEFT JOIN sn ON c.case_id = sn.case_id""")
def agg_gps_interval(p: DataFrame) -> DataFrame:
    return R.gps_interval(p)


@query("SELECT case_id, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon FROM pt WHERE fix GROUP BY case_id")
def agg_bbox(p: DataFrame) -> DataFrame:
    return R.bounding_box(p)


@query("SELECT case_id, CAST(0 AS BIGINT) AS estimated, count(*) FILTER (WHERE syn) AS damaged, count(*) FILTER (WHERE rec AND NOT coords) AS dropout, CAST(0 AS BIGINT) AS outlier FROM pt GROUP BY case_id")
def agg_track_status(p: DataFrame) -> DataFrame:
    return R.track_status(p)


@query("""SELECT * FROM (SELECT case_id, segment_index, max(row_idx) AS row_idx, arg_max(latitude, row_idx) AS latitude, arg_max(longitude, row_idx) AS longitude FROM pt WHERE fix GROUP BY case_id, segment_index)
 WHERE case_id IN (SELECT case_id FROM pt WHERE fix GROUP BY case_id HAVING count(DISTINCT segment_index) > 1)""")
def agg_segment_ends(p: DataFrame) -> DataFrame:
    return R.segment_ends(p)


@query("SELECT case_id, segment_index, coalesce(max(coalesce(nullif(end_time_sec, 0), start_time_sec)), 0e0) AS span FROM pt GROUP BY case_id, segment_index")
def agg_segment_span(p: DataFrame) -> DataFrame:
    return R.segment_spans(p)


@query(EVENTS + SLOTS.replace("\ns0 AS", ", s0 AS", 1) + """, fd AS (SELECT r.case_id, coalesce(slots, 0) > 0 AND rr - slots >= 5 AND rr >= 1.5 * slots AS fd FROM (SELECT case_id, count(*) FILTER (WHERE NOT syn) AS rr FROM pt GROUP BY case_id) r
 LEFT JOIN (SELECT case_id, count(*) AS slots FROM sl WHERE NOT syn GROUP BY case_id) s ON r.case_id = s.case_id),
ei AS (SELECT DISTINCT case_id, unnest(range(start_index, end_index + 1)) AS row_idx FROM car),
po AS (SELECT pt.case_id, pt.row_idx, pt.g, coalesce(pt.g >= 2, false) AS imp, coalesce(pt.g >= 2, false) OR ei.row_idx IS NOT NULL AS flagged FROM pt JOIN fd ON pt.case_id = fd.case_id LEFT JOIN ei ON ei.case_id = pt.case_id AND ei.row_idx = pt.row_idx
 LEFT JOIN sl ON sl.case_id = pt.case_id AND sl.row_idx = pt.row_idx WHERE NOT coalesce(fd, false) OR sl.row_idx IS NOT NULL OR coalesce(pt.g >= 2, false)),
pa AS (SELECT *, count(*) OVER w AS np, count(*) FILTER (WHERE flagged) OVER w AS nf, row_number() OVER (PARTITION BY case_id ORDER BY imp DESC, g DESC NULLS LAST, row_idx) AS str FROM po WINDOW w AS (PARTITION BY case_id)),
pb AS (SELECT *, CASE WHEN nf >= 20 THEN imp AND str <= 5 ELSE flagged END AS fst FROM pa),
pc AS (SELECT *, NOT fst AND (nf < 20 OR flagged) AS rst FROM pb),
pd AS (SELECT *, 20 - count(*) FILTER (WHERE fst) OVER w AS cnt, count(*) FILTER (WHERE rst) OVER w AS nr, count(*) FILTER (WHERE rst) OVER (PARTITION BY case_id ORDER BY row_idx) - 1 AS pl FROM pc WINDOW w AS (PARTITION BY case_id)),
pk AS (SELECT DISTINCT case_id, cnt, nr, unnest(range(0, cnt)) AS i FROM pd WHERE cnt > 1),
pl AS (SELECT case_id, CAST(round_even(CAST(i * (nr - 1) AS DOUBLE) / (cnt - 1), 0) AS BIGINT) AS pl FROM pk)
SELECT case_id, row_idx, flagged FROM pd WHERE np <= 20 OR fst OR (rst AND ((cnt = 1 AND pl = 0) OR (cnt > 1 AND EXISTS (SELECT 1 FROM pl WHERE pl.case_id = pd.case_id AND pl.pl = pd.pl))))""")
def top_report_rows(p: DataFrame) -> DataFrame:
    return R.sampled_rows(p, E.detect(p).filter("vehicle = 'car'"), most=20)


# --- playback


@query("""fx AS (SELECT case_id, row_idx, start_time_sec FROM pt WHERE fix), pb AS (SELECT case_id, row_idx AS probe, start_time_sec + 0.35e0 AS s FROM pt)
SELECT pb.case_id, probe, fx.row_idx AS fix_idx, round(s - fx.start_time_sec, 6) AS age FROM pb ASOF LEFT JOIN fx ON pb.case_id = fx.case_id AND pb.s >= fx.start_time_sec""")
def jn_last_fix_asof(p: DataFrame) -> DataFrame:
    """Last fix at or before each cursor position, and its age."""
    cursor = p.select("case_id", (F.col("start_time_sec") + 0.35).alias("s"), F.col("row_idx").alias("probe"), F.lit(None).cast("struct<t:double,i:bigint>").alias("f"))
    fixes = p.filter(P.has_fix()).select("case_id", F.col("start_time_sec").alias("s"), F.lit(None).cast("bigint").alias("probe"), F.struct(F.col("start_time_sec").alias("t"), F.col("row_idx").alias("i")).alias("f"))
    w = Window.partitionBy("case_id").orderBy("s", F.col("probe").isNotNull())
    both = cursor.unionByName(fixes).withColumn("last", F.last("f", ignorenulls=True).over(w)).filter("probe is not null")
    return both.select("case_id", "probe", F.col("last.i").alias("fix_idx"), F.round(F.col("s") - F.col("last.t"), 6).alias("age"))


@query("""gs AS (SELECT case_id, row_idx, start_time_sec FROM pt WHERE rec), pb AS (SELECT case_id, row_idx AS probe, start_time_sec + 0.9e0 AS s FROM pt),
jj AS (SELECT pb.case_id, probe, s, gs.row_idx AS i, gs.start_time_sec AS t FROM pb ASOF LEFT JOIN gs ON pb.case_id = gs.case_id AND pb.s + 1e-6 >= gs.start_time_sec)
SELECT case_id, probe, CASE WHEN s - t <= 1.15e0 THEN i END AS slot_idx FROM jj""")
def jn_slot_lookup(p: DataFrame) -> DataFrame:
    """Row shown at each cursor position: the last GPS row, unless older than an interval (1 s) and 0.15 s."""
    cursor = p.select("case_id", (F.col("start_time_sec") + 0.9).alias("s"), (F.col("start_time_sec") + 0.9 + 1e-6).alias("o"), F.col("row_idx").alias("probe"), F.lit(None).cast("struct<t:double,i:bigint>").alias("f"))
    rows = p.filter(P.has_gps_record()).select("case_id", F.col("start_time_sec").alias("s"), F.col("start_time_sec").alias("o"), F.lit(None).cast("bigint").alias("probe"), F.struct(F.col("start_time_sec").alias("t"), F.col("row_idx").alias("i")).alias("f"))
    w = Window.partitionBy("case_id").orderBy("o", F.col("probe").isNotNull())
    both = cursor.unionByName(rows).withColumn("last", F.last("f", ignorenulls=True).over(w)).filter("probe is not null")
    return both.select("case_id", "probe", F.when(F.col("s") - F.col("last.t") <= 1.15, F.col("last.i")).alias("slot_idx"))


# --- linkage


@query("""SELECT case_id, segment_index, min(start_time_sec) AS start, max(end_time_sec) - min(start_time_sec) AS duration, count(*) AS n_rows, max(CASE WHEN fix THEN speed_kmh END) AS max_kmh,
 arg_min(latitude, row_idx) FILTER (WHERE fix) AS first_lat, arg_min(longitude, row_idx) FILTER (WHERE fix) AS first_lon, arg_min(speed_kmh, row_idx) FILTER (WHERE fix) AS first_kmh,
 arg_max(latitude, row_idx) FILTER (WHERE fix) AS last_lat, arg_max(longitude, row_idx) FILTER (WHERE fix) AS last_lon, arg_max(speed_kmh, row_idx) FILTER (WHERE fix) AS last_kmh FROM pt GROUP BY case_id, segment_index""")
def agg_clip_summary(p: DataFrame) -> DataFrame:
    return L.clip_summary(p)


CLIPS = """
cl AS (SELECT case_id, segment_index, min(start_time_sec) AS start, max(end_time_sec) - min(start_time_sec) AS duration,
 arg_min(latitude, row_idx) FILTER (WHERE fix) AS fa, arg_min(longitude, row_idx) FILTER (WHERE fix) AS fo, arg_min(speed_kmh, row_idx) FILTER (WHERE fix) AS fv,
 arg_max(latitude, row_idx) FILTER (WHERE fix) AS la, arg_max(longitude, row_idx) FILTER (WHERE fix) AS lo, arg_max(speed_kmh, row_idx) FILTER (WHERE fix) AS lv FROM pt GROUP BY case_id, segment_index),
"""


@query(CLIPS + f"""ch AS (SELECT *, lead(segment_index) OVER w AS ns, lead(start) OVER w - start - duration AS gap, lead(fa) OVER w AS na, lead(fo) OVER w AS no, lead(fv) OVER w AS nv FROM cl WINDOW w AS (PARTITION BY case_id ORDER BY start, segment_index)),
cm AS (SELECT *, CASE WHEN la IS NULL OR na IS NULL THEN NULL ELSE {HAV.format(a="la", b="na", c="lo", d="no")} END AS m, greatest(coalesce(lv, 0e0), coalesce(nv, 0e0), 10e0) / 3.6e0 * greatest(1e0, abs(gap)) + 50 AS reach FROM ch WHERE ns IS NOT NULL)
SELECT case_id, segment_index, ns AS n_segment_index, round(gap, 6) AS gap_sec, round(m, 4) AS meters, round(reach, 4) AS reach,
 CASE WHEN gap > 5 THEN 'gap' WHEN gap < -5 THEN 'overlap' WHEN m IS NULL THEN 'no_coordinates' WHEN m > reach THEN 'too_far' ELSE 'ok' END AS verdict FROM cm""")
def win_chain_check(p: DataFrame) -> DataFrame:
    out = L.chain_check(L.clip_summary(p))
    return out.select("case_id", "segment_index", "n_segment_index", F.round("gap_sec", 6).alias("gap_sec"), F.round("meters", 4).alias("meters"), F.round("reach", 4).alias("reach"), "verdict")


@query("""sg AS (SELECT case_id, segment_index, count(*) AS n, min(row_idx) AS base, min(start_time_sec) AS t0, max(end_time_sec) AS span FROM pt GROUP BY case_id, segment_index),
sh AS (SELECT *, coalesce(sum(span) OVER w, 0) AS off, coalesce(sum(n) OVER w, 0) AS rb FROM sg WINDOW w AS (PARTITION BY case_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT pt.case_id, pt.segment_index, CAST(row_idx - base + rb AS BIGINT) AS row_idx, round(start_time_sec - t0 + off, 6) AS start_time_sec FROM pt JOIN sh ON pt.case_id = sh.case_id AND pt.segment_index = sh.segment_index""")
def win_combine_segments(p: DataFrame) -> DataFrame:
    """Also set_concat_segments."""
    out = L.combine_segments(p, R.segment_spans(p))
    return out.select("case_id", "segment_index", "row_idx", F.round("start_time_sec", 6).alias("start_time_sec"))


@query("""sk AS (SELECT case_id, row_idx, CASE WHEN row_idx % 13 = 5 THEN NULL ELSE row_idx * 20 + CASE WHEN row_idx % 9 = 4 THEN 130 ELSE 0 END END AS utc FROM pt),
s1 AS (SELECT *, utc - lag(utc) OVER (PARTITION BY case_id ORDER BY utc, row_idx) AS gap FROM sk WHERE utc IS NOT NULL),
s2 AS (SELECT *, sum(CASE WHEN gap > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY utc, row_idx) AS seg, min(utc) OVER (PARTITION BY case_id) AS u0 FROM s1)
SELECT case_id, row_idx, CAST(seg AS BIGINT) AS segment, utc - u0 AS t FROM s2 UNION ALL
SELECT case_id, row_idx, coalesce((SELECT CAST(max(seg) AS BIGINT) FROM s2 WHERE s2.case_id = sk.case_id), 0) + 1, NULL FROM sk WHERE utc IS NULL""")
def win_slack_sessions(p: DataFrame) -> DataFrame:
    raw = p.select("case_id", "row_idx", F.expr("case when row_idx % 13 = 5 then null else row_idx * 20 + if(row_idx % 9 = 4, 130, 0) end").alias("utc"))
    return L.slack_sessions(raw).select("case_id", "row_idx", "segment", "t")


def _sides(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = p.withColumn("pair_id", F.expr("case_id div 2")).withColumn("key", F.expr("row_idx + if(case_id % 2 = 1, case_id % 5, 0)"))
    return rows.filter("case_id % 2 = 0"), rows.filter("case_id % 2 = 1")


@query(f"""pr AS (SELECT *, case_id // 2 AS pair_id, row_idx + CASE WHEN case_id % 2 = 1 THEN case_id % 5 ELSE 0 END AS key FROM pt WHERE rec),
f AS (SELECT * FROM pr WHERE case_id % 2 = 0), r AS (SELECT * FROM pr WHERE case_id % 2 = 1),
s AS (SELECT a.pair_id, f0 - r0 AS start_offset FROM (SELECT pair_id, arg_min(key, row_idx) AS f0 FROM f GROUP BY pair_id) a JOIN (SELECT pair_id, arg_min(key, row_idx) AS r0 FROM r GROUP BY pair_id) b ON a.pair_id = b.pair_id),
d AS (SELECT f.pair_id, CASE WHEN f.fix AND r.fix THEN {HAV.format(a="f.latitude", b="r.latitude", c="f.longitude", d="r.longitude")} END AS m FROM f JOIN r ON f.pair_id = r.pair_id AND f.key = r.key),
g AS (SELECT pair_id, count(*) AS matches, count(m) AS n_dist, median(m) AS mid, max(m) AS far FROM d GROUP BY pair_id)
SELECT s.pair_id, start_offset, coalesce(matches, 0) AS matches, coalesce(n_dist, 0) AS n_dist, CASE WHEN n_dist >= 3 THEN round(mid, 4) END AS median_m, CASE WHEN n_dist >= 3 THEN round(far, 4) END AS max_m,
 CASE WHEN abs(start_offset) > 3 THEN 'start_differs' WHEN coalesce(matches, 0) = 0 THEN 'no_common_time' WHEN n_dist >= 3 AND mid > 50 THEN 'too_far' ELSE 'ok' END AS verdict FROM s LEFT JOIN g ON s.pair_id = g.pair_id""")
def op_compare_gps(p: DataFrame) -> DataFrame:
    """Also jn_gps_pair and agg_pair_distance."""
    front, rear = _sides(p)
    out = L.pair_gps(front, rear, "key")
    return out.select("pair_id", "start_offset", "matches", "n_dist", F.round("median_m", 4).alias("median_m"), F.round("max_m", 4).alias("max_m"), "verdict")


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return O
