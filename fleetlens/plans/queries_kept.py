"""Queries over what is kept of cases: histories, documents, carved GPS, stored analyses opened again, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import curves
from ..operators import history as H
from ..operators import recordings as RC
from ..operators import reopen as RO
from ..operators import sequence as S
from ..operators.times import estimate_times
from ..sources import documents as DOC
from ..sources.shared import checkpointed, shared_path
from . import queries_damage as QD
from .adapter import ORACLE_CTE, track_points
from .queries_clips import marks_sql
from .queries_track import EVENTS

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str, table: str | None = None):
    def add(f: Callable[[DataFrame], DataFrame]):
        Q[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet") if table else track_points(spark, sf_dir))
        O[f.__name__] = sql if table else "WITH RECURSIVE " + ORACLE_CTE.strip() + ",\n" + sql
        return f

    return add


# --- playback times from the clock


def estimates_sql(src: str) -> str:
    """``te``: playback times of the rows of ``src(case_id, row_idx, key, anchor, rec)``, row by row."""
    return f"""
q0 AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY row_idx) AS n, arg_min(CASE WHEN anchor THEN key END, CASE WHEN anchor AND key IS NOT NULL THEN row_idx END) OVER (PARTITION BY case_id) AS k0 FROM {src}),
wq(case_id, n, latest, cur, begun, broken, lost, row_idx) AS (SELECT DISTINCT case_id, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), false, false, true, CAST(NULL AS BIGINT) FROM q0 WHERE k0 IS NOT NULL
 UNION ALL
 SELECT case_id, n, CASE WHEN anchor THEN coalesce(greatest(latest, key), key, latest) ELSE latest END, CASE WHEN own OR (rdg AND rel >= 0) THEN rel ELSE cur END, begun OR own, broken,
  CASE WHEN broken THEN true WHEN rel IS NOT NULL AND anchor THEN rel < 0 WHEN rel IS NOT NULL THEN NOT (begun OR own) OR (rdg AND rel < 0) ELSE NOT (begun OR own) AND rec AND NOT anchor END, row_idx
 FROM (SELECT *, NOT broken AND anchor AND coalesce(rel >= 0, false) AS own, NOT broken AND NOT anchor AND begun AND coalesce(rel - cur BETWEEN -5 AND 600, false) AS rdg
  FROM (SELECT wq.case_id, q0.n, latest, cur, begun, wq.broken OR coalesce(anchor AND (key < latest - 5 OR key > latest + 600), false) AS broken, key - k0 AS rel, key, anchor, rec, q0.row_idx
   FROM wq JOIN q0 ON q0.case_id = wq.case_id AND q0.n = wq.n + 1))),
te AS (SELECT case_id, row_idx, CASE WHEN NOT lost THEN cur END AS t, lost FROM wq WHERE n > 0)
"""


CLOCKED = """
es AS (SELECT case_id, row_idx, epoch(CAST({date} AS TIMESTAMP)) + CAST(substr(gps_utc_time, 3, 2) AS INTEGER) * 60 + CAST(substr(gps_utc_time, 5, 2) AS INTEGER) AS key,
  coalesce(gps_checksum_ok, true) AND coalesce(gps_trusted, true) AND gps_status IN ('', 'A') AS anchor, rec FROM pt {where}),
"""


@query(CLOCKED.format(date="gps_date", where="") + estimates_sql("es") + "SELECT pt.case_id, pt.row_idx, t AS start_time_sec, CASE WHEN t IS NULL THEN time_source ELSE 'gps_utc_estimated' END AS time_source, coalesce(te.lost, false) AS excluded FROM pt LEFT JOIN te ON pt.case_id = te.case_id AND pt.row_idx = te.row_idx")
def win_time_estimate(p: DataFrame) -> DataFrame:
    bare = p.withColumn("start_time_sec", F.lit(None).cast("double")).withColumn("end_time_sec", F.lit(None).cast("double"))
    return estimate_times(bare).select("case_id", "row_idx", "start_time_sec", "time_source", "excluded")


CARVED_DATE = "CASE WHEN case_id % 4 = 1 AND row_idx >= 40 THEN '2024-06-20' ELSE gps_date END"


@query(CLOCKED.format(date=CARVED_DATE, where="WHERE coords AND gps_utc_time IS NOT NULL AND case_id % 7 <> 3") + estimates_sql("es") + """,
en AS (SELECT case_id, row_idx, fix, start_time_sec FROM pt WHERE case_id % 3 = 2 OR (case_id % 3 = 1 AND row_idx < 20)),
nc AS (SELECT case_id, count(*) FILTER (WHERE NOT coalesce(lost, false)) AS n_carved, count(*) FILTER (WHERE lost) AS n_out, count(t) AS n_placed, max(t) AS last_sec FROM (SELECT es.case_id, t, lost FROM es LEFT JOIN te ON es.case_id = te.case_id AND es.row_idx = te.row_idx) GROUP BY case_id),
ne AS (SELECT case_id, count(*) AS n_engine, count(*) FILTER (WHERE fix) AS n_fixes, max(start_time_sec) AS last_sec FROM en GROUP BY case_id),
j AS (SELECT coalesce(nc.case_id, ne.case_id) AS case_id, coalesce(n_engine, 0) AS n_engine, coalesce(n_placed, 0) > 0 AND (coalesce(n_engine, 0) = 0 OR n_carved > n_fixes) AS adopted, n_carved, n_out, nc.last_sec AS cl, ne.last_sec AS el FROM nc FULL JOIN ne ON nc.case_id = ne.case_id)
SELECT case_id, CASE WHEN NOT adopted THEN 'engine' WHEN n_engine = 0 THEN 'carved' ELSE 'carved_over_engine' END AS outcome, CASE WHEN adopted THEN n_carved ELSE n_engine END AS n_rows,
 CASE WHEN adopted THEN n_out ELSE 0 END AS n_slack, CASE WHEN adopted THEN cl ELSE el END AS last_sec FROM j""")
def op_promote_carved(p: DataFrame) -> DataFrame:
    """Engines that found nothing, a part, or all, against what carving finds, in some cases with an older recording's residue."""
    engine = p.filter("case_id % 3 = 2 or (case_id % 3 = 1 and row_idx < 20)")
    carved = p.filter("case_id % 7 <> 3").withColumn("gps_date", F.expr(CARVED_DATE))
    points, _, outcomes = RO.promote_carved(engine, carved)
    ends = points.groupBy("case_id").agg(F.max("start_time_sec").alias("last_sec"))
    return outcomes.join(ends, "case_id", "left")


# --- curves


CURVES = """
bk AS (SELECT *, sum(CASE WHEN syn OR (rec AND NOT coords) THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY row_idx) AS b FROM pt),
us AS (SELECT *, lag(segment_index) OVER w = segment_index AND lag(b) OVER w = b AND (t_us - lag(t_us) OVER w) / 1e6 <= 5 AS same FROM bk WHERE fix AND NOT syn AND speed_kmh >= 0 WINDOW w AS (PARTITION BY case_id ORDER BY row_idx)),
rn AS (SELECT case_id, start_time_sec AS x, speed_kmh AS y, sum(CASE WHEN coalesce(same, false) THEN 0 ELSE 1 END) OVER (PARTITION BY case_id ORDER BY row_idx) AS run_id FROM us),
s0 AS (SELECT *, row_number() OVER w AS i, lead(x) OVER w AS x1, lead(y) OVER w AS y1, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS d FROM rn WINDOW w AS (PARTITION BY case_id, run_id ORDER BY x)),
s1 AS (SELECT *, CASE WHEN lag(d) OVER w IS NULL THEN d WHEN d IS NULL THEN lag(d) OVER w WHEN d * lag(d) OVER w > 0 THEN (d + lag(d) OVER w) / 2 ELSE 0 END AS m FROM s0 WINDOW w AS (PARTITION BY case_id, run_id ORDER BY x)),
s2 AS (SELECT *, lead(m) OVER (PARTITION BY case_id, run_id ORDER BY x) AS n FROM s1),
wc(case_id, run_id, i, m0, nxt) AS (SELECT case_id, run_id, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), m FROM s2 WHERE i = 1 AND x1 IS NOT NULL
 UNION ALL SELECT case_id, run_id, i, CASE WHEN d = 0 THEN 0 WHEN r > 3 THEN 3 * cur / r ELSE cur END, CASE WHEN d = 0 THEN 0 WHEN r > 3 THEN 3 * n / r ELSE n END
 FROM (SELECT s2.case_id, s2.run_id, s2.i, d, n, nxt AS cur, CASE WHEN d <> 0 THEN sqrt((nxt / d) * (nxt / d) + (n / d) * (n / d)) END AS r FROM wc JOIN s2 ON s2.case_id = wc.case_id AND s2.run_id = wc.run_id AND s2.i = wc.i + 1 AND x1 IS NOT NULL)),
s3 AS (SELECT s2.case_id, s2.run_id, x, y, x1, y1, m0, coalesce(lead(m0) OVER (PARTITION BY s2.case_id, s2.run_id ORDER BY s2.i), nxt) AS m1 FROM wc JOIN s2 ON s2.case_id = wc.case_id AND s2.run_id = wc.run_id AND s2.i = wc.i)
"""


@query(CURVES + "SELECT case_id, CAST(run_id AS BIGINT) AS run_id, x AS x0, round(y + m0 * ((x1 - x) / 3), 6) AS c1y, round(y1 - m1 * ((x1 - x) / 3), 6) AS c2y, x1 FROM s3")
def win_monotone_cubic(p: DataFrame) -> DataFrame:
    """Control points of the speed chart's curves."""
    points = S.curve_points(p).select("case_id", "run_id", F.col("start_time_sec").alias("x"), F.col("speed_kmh").alias("y"))
    return curves.monotone_segments(points).select("case_id", "run_id", "x0", F.round("c1y", 6).alias("c1y"), F.round("c2y", 6).alias("c2y"), "x1")


# --- histories


CHANGES = """
lg AS (SELECT o_custkey AS case_id, o_orderkey AS version, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'insert' WHEN o_orderkey % 13 = 0 THEN 'delete' WHEN o_orderkey % 5 = 0 THEN 'insert' ELSE 'update' END AS change, * FROM orders),
bo AS (SELECT case_id, max(version) FILTER (WHERE change = 'insert') AS born, max(version) FILTER (WHERE change = 'delete') AS gone FROM lg GROUP BY case_id),
al AS (SELECT lg.*, version % 4 AS r, change = 'insert' AS ins FROM lg JOIN bo ON lg.case_id = bo.case_id WHERE born > coalesce(gone, -1) AND version >= born)
"""


def changes(o: DataFrame) -> DataFrame:
    """Orders as a log of changes to customers' cases: all kinds of fields, documents that are damaged or of the wrong kind."""
    from pyspark.sql import Window

    first = F.col("o_orderkey") == F.min("o_orderkey").over(Window.partitionBy("o_custkey"))
    change = F.when(first, "insert").when(F.expr("o_orderkey % 13 = 0"), "delete").when(F.expr("o_orderkey % 5 = 0"), "insert").otherwise("update")
    fields = F.expr("""CASE WHEN change = 'delete' THEN map()
      WHEN change = 'insert' THEN map('case_number', concat('C', o_orderkey), 'examiner', o_orderpriority, 'settings', '{"k":1,"vehicle_type":"car"}')
      WHEN o_orderkey % 4 = 0 THEN map('memo', o_orderpriority, 'examiner', concat('E', o_orderkey))
      WHEN o_orderkey % 4 = 1 THEN map('analysis_status', o_orderstatus, 'memo', null)
      WHEN o_orderkey % 4 = 2 THEN map('segments', if(o_orderkey % 3 = 0, '[{"label":', '[{"label":"video1"}]'), 'damage', if(o_orderkey % 8 = 2, '{}', '{"mode":"none"}'))
      ELSE map('settings', if(o_orderkey % 8 = 3, '[1]', '{"vehicle_type":"bus"}')) END""")
    return o.withColumn("change", change).select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("version"), "change", fields.alias("fields"))


STATE = CHANGES + """,
st AS (SELECT case_id, max(version) AS version, arg_max('C' || version, version) FILTER (WHERE ins) AS case_number, arg_max(CASE WHEN ins THEN o_orderpriority ELSE 'E' || version END, version) FILTER (WHERE ins OR r = 0) AS examiner,
 arg_max(CASE WHEN r = 0 THEN o_orderpriority ELSE '' END, version) FILTER (WHERE NOT ins AND r IN (0, 1)) AS memo, arg_max(o_orderstatus, version) FILTER (WHERE NOT ins AND r = 1) AS analysis_status,
 arg_max(CASE WHEN ins THEN '{"k":1,"vehicle_type":"car"}' WHEN version % 8 = 3 THEN '{}' ELSE '{"vehicle_type":"bus"}' END, version) FILTER (WHERE ins OR r = 3) AS settings,
 arg_max(CASE WHEN version % 3 = 0 THEN '[]' ELSE '[{"label":"video1"}]' END, version) FILTER (WHERE NOT ins AND r = 2) AS segments, arg_max(CASE WHEN version % 8 = 2 THEN '' ELSE '{"mode":"none"}' END, version) FILTER (WHERE NOT ins AND r = 2) AS damage FROM al GROUP BY case_id)
SELECT case_id, version, case_number, examiner, coalesce(memo, '') AS memo, coalesce(analysis_status, '') AS analysis_status, settings, coalesce(segments, '[]') AS segments, nullif(damage, '') AS damage FROM st"""
SHOWN = ("case_id", "version", "case_number", "examiner", "memo", "analysis_status", "settings", "segments", "damage")


@query("WITH " + STATE.strip(), "orders")
def snk_history(o: DataFrame) -> DataFrame:
    """The log appended in three batches, one of them twice, and replayed."""
    path = shared_path(o.sparkSession, "changes")
    log = changes(o)
    for batch in (0, 1, 2, 1):
        H.append_changes(log.filter(F.col("version") % 3 == batch), path)
    return H.replay(H.read_changes(o.sparkSession, path)).select(*SHOWN)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders)
SELECT o_custkey AS case_id, o_orderkey AS version, 'C' || o_custkey AS case_number, o_orderpriority AS examiner, '' AS memo, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS analysis_status,
 CASE o_orderkey % 3 WHEN 0 THEN '{"a":1}' ELSE '{}' END AS settings, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN '[1]' ELSE '[]' END AS segments, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 7 = 0 THEN '{"m":2}' END AS damage FROM r WHERE n = 1""", "orders")
def src_history_db(o: DataFrame) -> DataFrame:
    """Snapshots of a case table, some from before three of its columns were added, with damaged documents."""
    spark, path = o.sparkSession, shared_path(o.sparkSession, "cases")
    k = F.col("o_orderkey")
    old = o.select(
        F.col("o_custkey").alias("case_id"), k.alias("version"), F.concat(F.lit("C"), "o_custkey").alias("case_number"), F.col("o_orderpriority").alias("examiner"),
        F.when(k % 3 == 0, '{"a":1}').when(k % 3 == 1, '{"a":').otherwise("7").alias("settings"), k.alias("_k"), F.col("o_orderstatus").alias("_s"),
    )
    old.filter("_k % 2 = 1").drop("_k", "_s").write.mode("append").parquet(path)
    segments, damaged = F.when(F.col("_k") % 5 == 0, "[1").otherwise("[1]"), F.when(F.col("_k") % 7 == 0, '{"m":2}').otherwise("{}")
    new = old.filter("_k % 2 = 0").withColumns({"analysis_status": F.col("_s"), "segments": segments, "damage": damaged})
    new.drop("_k", "_s").write.mode("append").parquet(path)
    return H.read_cases(spark, path).select(*SHOWN)


@query("""WITH r AS (SELECT conv_id, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'user') AS o, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'user') AS e FROM conversations GROUP BY conv_id)
SELECT conv_id // 4 AS case_id, conv_id AS run_id, 'extraction' AS script_name, '["extract","' || conv_id || '.mp4"]' AS argv_json, CAST(conv_id % 3 AS INTEGER) AS exit_code,
 'case/' || conv_id // 4 || '/_run_' || strftime(TIMESTAMP '2024-06-18 01:02:03' + to_seconds(CAST(conv_id % 86400 AS INTEGER)), '%H%M%S') || '000000.log' AS stdout_log_path,
 strftime(TIMESTAMP '2024-06-18 01:02:03' + to_seconds(CAST(conv_id % 86400 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS started_at, strftime(TIMESTAMP '2024-06-18 01:02:03' + to_seconds(CAST(conv_id % 86400 + n AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS finished_at,
 md5('ARGV: extract ' || conv_id || '.mp4' || chr(10) || CASE WHEN conv_id % 5 = 0 THEN 'NOTE: again' || chr(10) ELSE '' END || 'EXIT: ' || conv_id % 3 || chr(10) || chr(10) || '--- stdout ---' || chr(10) || coalesce(o, '') || chr(10) || '--- stderr ---' || chr(10) || coalesce(e, '')) AS log_md5 FROM r""", "conversations")
def op_engine_run_audit(c: DataFrame) -> DataFrame:
    """An audit row per run with the log that is kept of it (here its digest)."""
    stream = F.when(F.col("role") == "user", "stdout").otherwise("stderr")
    lines = c.select(F.col("conv_id").alias("run_id"), stream.alias("stream"), F.col("turn").alias("line_no"), F.col("text").alias("line"))
    start = F.lit("2024-06-18 01:02:03").cast("timestamp")
    runs = c.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        F.expr("conv_id div 4").alias("case_id"), F.col("conv_id").alias("run_id"), F.array(F.lit("extract"), F.concat("conv_id", F.lit(".mp4"))).alias("argv"), (F.col("conv_id") % 3).cast("int").alias("exit_code"),
        F.when(F.col("conv_id") % 5 == 0, "again").alias("note"), F.concat(F.lit("case/"), F.expr("conv_id div 4")).alias("output_dir"), (start + F.make_dt_interval(secs=F.col("conv_id") % 86400)).alias("started_at"),
        (start + F.make_dt_interval(secs=F.col("conv_id") % 86400 + F.col("n"))).alias("finished_at"),
    )
    return H.engine_runs(lines, runs).withColumn("log_md5", F.md5("log")).drop("log")


# --- documents


DOCUMENTS = """WITH d AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 8 = 5 THEN 'damaged' WHEN c_custkey % 6 = 3 THEN 'not_object' WHEN c_custkey % 4 = 1 THEN 'corrupt' WHEN c_custkey % 10 = 7 THEN 'absent' ELSE 'ok' END AS o FROM customer),
r AS (SELECT k AS case_id, CASE WHEN o = 'damaged' THEN 'ok' ELSE o END AS outcome, CASE o WHEN 'ok' THEN '{"case_id":' || k || ',"status":"ok"}' WHEN 'damaged' THEN '{"case_id":' || k || ',"damage":{"mode":"none"}}' ELSE '{}' END AS document FROM d)
"""


def committed(c: DataFrame) -> DataFrame:
    """Four batches of case documents, the later over the earlier, and one that was staged and never published."""
    k = F.col("c_custkey")
    root = shared_path(c.sparkSession, "case-documents")
    texts = (
        (k % 10 != 7, F.concat(F.lit('{"status": "ok", "case_id": '), k, F.lit("}"))), (k % 4 == 1, F.concat(F.lit('{"case_id": '), k, F.lit(', "sta'))), (k % 6 == 3, F.concat(F.lit("["), k, F.lit("]"))),
        (k % 8 == 5, F.concat(F.lit('{"case_id": '), k, F.lit(', "damage": {"mode": "none"}}'))),
    )
    for which, text in texts:
        DOC.commit(c.filter(which).select(k.alias("case_id"), text.alias("document")), root)
    DOC.stage(c.select(k.alias("case_id"), F.lit('{"lost": true}').alias("document")), root)
    return DOC.read(c.select(k.alias("case_id")), root)


@query(DOCUMENTS + "SELECT case_id, outcome, document FROM r", "customer")
def snk_case_json(c: DataFrame) -> DataFrame:
    """Documents committed by renaming and read back: there, absent, corrupt and not an object told apart."""
    return committed(c)


@query(DOCUMENTS + """SELECT case_id, outcome, CASE WHEN document LIKE '%status%' THEN 'ok' END AS status, CASE WHEN document LIKE '%damage%' THEN 'none' END AS damage_mode FROM r""", "customer")
def src_case_json(c: DataFrame) -> DataFrame:
    """What is read of a case's document: its status, and its damage where that is an object."""
    d = F.col("document")
    return committed(c).select("case_id", "outcome", DOC.field(d, "status").alias("status"), DOC.field(d, "damage.mode").alias("damage_mode"))


@query("""SELECT doc_id // 10 AS case_id, count(*) FILTER (WHERE doc_id % 7 <> 0) > 0 AS present, coalesce(bool_or(doc_id % 7 <> 0 AND doc_id % 11 = 0), false) AS avi_repaired FROM documents GROUP BY doc_id // 10""", "documents")
def op_artifacts_present(d: DataFrame) -> DataFrame:
    """Also op_avi_repaired."""
    path = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("engine_output/"), "doc_id", F.when(F.col("doc_id") % 11 == 0, "_WO_SLACK.avi").otherwise(".csv")))
    return RO.artifacts_present(d.select(F.expr("doc_id div 10").alias("case_id"), path.alias("path")))


@query("""SELECT o_orderkey AS case_id, o_orderkey % 5 IN (0, 4) AS may_delete FROM orders""", "orders")
def op_case_delete(o: DataFrame) -> DataFrame:
    """Which folders may go: only a case's own one right below the root."""
    k = F.col("o_orderkey")
    own = F.concat(F.lit("C_"), k)
    folder = F.when(k % 5 == 0, F.concat(F.lit("/data/cases/"), own)).when(k % 5 == 1, F.concat(F.lit("/data/cases/C_"), k + 1)).when(k % 5 == 2, F.concat(F.lit("/data/cases/x/"), own))
    folder = folder.when(k % 5 == 3, F.lit("/data/cases/..")).otherwise(F.concat(F.lit("/data/cases/"), own, F.lit("/")))
    return o.select(k.alias("case_id"), RO.may_delete(folder, F.lit("/data/cases/"), k).alias("may_delete"))


# --- analyses opened again


#: Marked tracks with the rows made for lost seconds, ``wo``.
REPLAYED = marks_sql("pt") + "," + QD.JUDGED.replace("FROM pt", "FROM mk") + """,
an AS (SELECT mk.* REPLACE (CAST(0 AS INTEGER) AS segment_index) FROM mk WHERE NOT syn
 UNION ALL BY NAME SELECT fs.case_id, CAST(fs.t AS DOUBLE) AS start_time_sec, CAST(fs.t AS BIGINT) * 1000000 AS t_us, CAST(0 AS INTEGER) AS segment_index, true AS syn, false AS fix, CASE WHEN outcome = 'interpolated' THEN 'interpolated' ELSE 'damaged' END AS recovery_state,
  CASE WHEN outcome = 'interpolated' THEN blat + (alat - blat) * ((fs.t - bt) / (at_ - bt)) END AS latitude, '' AS outlier_reason FROM fs JOIN jg ON fs.case_id = jg.case_id AND fs.start_sec = jg.start_sec AND fs.end_sec = jg.end_sec),
wo AS (SELECT * REPLACE (row_number() OVER (PARTITION BY case_id ORDER BY start_time_sec, syn, row_idx) - 1 AS row_idx) FROM an)
"""
ROWS = "case_id, row_idx, start_time_sec, recovery_state, round(latitude, 9) AS latitude, outlier_reason <> '' AS is_outlier"


def _rows(points: DataFrame) -> DataFrame:
    return points.select(
        "case_id", "row_idx", "start_time_sec", "recovery_state", F.round("latitude", 9).alias("latitude"), F.coalesce("is_outlier", F.lit(False)).alias("is_outlier")
    )


@query(REPLAYED + f"SELECT {ROWS} FROM wo WHERE case_id IN (SELECT case_id FROM mr) UNION ALL SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY row_idx) - 1, start_time_sec, recovery_state, round(latitude, 9), outlier_reason <> '' FROM mk WHERE NOT syn AND case_id NOT IN (SELECT case_id FROM mr)")
def op_reapply_damage(p: DataFrame) -> DataFrame:
    """Damage replayed from its stored report onto a track that already had it: the same rows again."""
    from ..operators import outliers

    marked = checkpointed(outliers.mark_outliers(p))
    reports = checkpointed(RO.report_of(QD.regions(p), QD.durations(p), "interpolate"))
    once = checkpointed(RO.apply_report(marked, reports))
    return _rows(RO.apply_report(once, reports))


def _reopened(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    path = shared_path(p.sparkSession, "case-store")
    case = F.col("case_id")
    reports = RO.report_of(QD.regions(p), QD.durations(p), "interpolate")
    known = checkpointed(p.select("case_id").distinct().join(reports, "case_id", "left"))
    good = F.to_json(F.struct(F.when(case % 4 == 1, "no_gps").otherwise("ok").alias("status"), F.parse_json("damage").alias("damage")))
    metadata = known.filter(case % 6 != 3).select("case_id", F.when(case % 6 == 4, F.substring(good, 1, 9)).otherwise(good).alias("document"))
    RO.store(p.filter(case % 9 != 7), metadata, path)
    rows = known.select("case_id", F.when(case % 5 == 0, "ok").when(case % 5 == 1, "analyzing").when(case % 5 == 2, "timed_out").otherwise("").alias("analysis_status"), F.when(case % 2 == 0, F.col("damage")).alias("damage"))
    return RO.reopen(rows, path)


REOPENED = REPLAYED + """,
kn AS (SELECT DISTINCT case_id, case_id IN (SELECT case_id FROM mr) AS hurt, case_id % 6 NOT IN (3, 4) AS doc, case_id % 2 = 0 AS copy, case_id % 9 <> 7 AS kept FROM pt),
ks AS (SELECT *, CASE WHEN hurt AND doc THEN 'document' WHEN hurt AND copy THEN 'history' ELSE 'none' END AS damage_source,
 CASE WHEN NOT kept THEN 'unknown' WHEN case_id % 5 = 0 THEN 'ok' WHEN case_id % 5 = 1 THEN 'engine_failed' WHEN case_id % 5 = 2 THEN 'timed_out' WHEN NOT doc THEN 'unknown' WHEN case_id % 4 = 1 THEN 'no_gps' ELSE 'ok' END AS status,
 CASE case_id % 6 WHEN 3 THEN 'absent' WHEN 4 THEN 'corrupt' ELSE 'ok' END AS outcome FROM kn),
re AS (SELECT wo.* FROM wo JOIN ks ON wo.case_id = ks.case_id WHERE kept AND damage_source <> 'none'
 UNION ALL BY NAME SELECT mk.* REPLACE (row_number() OVER (PARTITION BY mk.case_id ORDER BY row_idx) - 1 AS row_idx, CAST(0 AS INTEGER) AS segment_index) FROM mk JOIN ks ON mk.case_id = ks.case_id WHERE kept AND damage_source = 'none' AND NOT syn)
"""


@query(REOPENED + f"SELECT {ROWS} FROM re")
def op_reopen(p: DataFrame) -> DataFrame:
    """Rows of stored analyses opened again, equal to those of the first analysis."""
    return _rows(_reopened(p)[0])


@query(REOPENED + "," + EVENTS.replace("FROM pt)", "FROM re)", 1) + ", ce AS (SELECT case_id, count(*) AS n FROM car GROUP BY case_id) SELECT ks.case_id, status, outcome, damage_source, coalesce(n, 0) AS n_events FROM ks LEFT JOIN ce ON ks.case_id = ce.case_id")
def op_reopen_status(p: DataFrame) -> DataFrame:
    """Status, document and source of the damage of every case that is opened again, and its events of cars."""
    _, found, cases = _reopened(p)
    n = found.filter("vehicle = 'car'").groupBy("case_id").agg(F.count("*").alias("n_events"))
    return cases.join(n, "case_id", "left").fillna(0, ["n_events"])


#: A whole analysis: estimated times where a case has none are not needed here, all rows have one.
ANALYSED = marks_sql("pt") + "," + QD.JUDGED.replace("FROM pt", "FROM mk") + """,
an AS (SELECT mk.* FROM mk WHERE NOT syn
 UNION ALL BY NAME SELECT fs.case_id, CAST(fs.t AS DOUBLE) AS start_time_sec, true AS syn, false AS fix, coalesce(b.segment_index, a.segment_index, 0) AS segment_index, '' AS outlier_reason FROM fs JOIN jg ON fs.case_id = jg.case_id AND fs.start_sec = jg.start_sec AND fs.end_sec = jg.end_sec
  LEFT JOIN pt b ON b.case_id = jg.case_id AND b.row_idx = bi LEFT JOIN pt a ON a.case_id = jg.case_id AND a.row_idx = ai),
wo AS (SELECT * REPLACE (row_number() OVER (PARTITION BY case_id ORDER BY start_time_sec, syn, row_idx) - 1 AS row_idx) FROM an),
""" + EVENTS.replace("FROM pt)", "FROM wo)", 1) + """,
ce AS (SELECT case_id, count(*) FILTER (WHERE kind = 'start') AS n_start, count(*) FILTER (WHERE kind = 'stop') AS n_stop, count(*) FILTER (WHERE kind = 'accel') AS n_accel, count(*) FILTER (WHERE kind = 'decel') AS n_decel FROM car GROUP BY case_id),
cr AS (SELECT case_id, count(*) AS n_rows, count(*) FILTER (WHERE fix) AS n_fixes, count(*) FILTER (WHERE outlier_reason <> '') AS n_outliers, count(*) FILTER (WHERE syn) AS n_made FROM wo GROUP BY case_id)
"""


@query(ANALYSED + "SELECT cr.*, coalesce(n_start, 0) AS n_start, coalesce(n_stop, 0) AS n_stop, coalesce(n_accel, 0) AS n_accel, coalesce(n_decel, 0) AS n_decel FROM cr LEFT JOIN ce ON cr.case_id = ce.case_id")
def op_run_analysis(p: DataFrame) -> DataFrame:
    """A recording from rows to findings: times, outliers, damage, events, and what a report says of them."""
    return RC.analyse(p, QD.regions(p), QD.durations(p))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return Q


def oracle_sql() -> dict[str, str]:
    return O
