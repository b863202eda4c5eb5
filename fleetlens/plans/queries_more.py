"""Queries over sources, sinks, sets, slack and comparisons, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import times as TM
from ..operators import events, linkage, pairs
from ..operators import report as R
from ..operators import sequence as S
from ..operators.times import estimate_times
from ..sources import rows as SR
from ..sources.shared import shared_path
from .adapter import ORACLE_CTE, track_points
from .queries_track import EVENTS, SLOTS

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None, table: str | None = None):
    """Of a table, or of the adapter's track."""

    def add(f):
        Q[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet") if table else track_points(spark, sf_dir))
        if sql:
            O[f.__name__] = sql if table else "WITH " + ORACLE_CTE.strip() + ("," if not sql.lstrip().upper().startswith("SELECT") else "") + "\n" + sql
        return f

    return add


@query("SELECT case_id, start_time_sec, latitude, longitude, speed_kmh, gps_date, gps_utc_time, gps_checksum_ok, gps_trusted, coalesce(gps_status, '') AS gps_status, source_offset, recovery_state FROM tp")
def src_timeline_csv(p: DataFrame) -> DataFrame:
    """The track written under the CSV contract and read back (also snk_carved_timeline)."""
    path = shared_path(p.sparkSession, "timeline")
    SR.write_timeline(p, path)
    out = SR.load_timeline(p.sparkSession, path)
    return out.select(
        F.col("case_id").cast("long").alias("case_id"), "start_time_sec", "latitude", "longitude", "speed_kmh", "gps_date", "gps_utc_time", "gps_checksum_ok", "gps_trusted",
        F.coalesce("gps_status", F.lit("")).alias("gps_status"), "source_offset", "recovery_state",
    )


@query("SELECT case_id // 10 AS folder, arg_max(case_id, struct_pack(f := n, c := -case_id)) AS primary_case, max(n) AS fixes FROM (SELECT case_id, count(*) FILTER (WHERE fix) AS n FROM pt GROUP BY case_id) GROUP BY case_id // 10")
def src_pick_primary(p: DataFrame) -> DataFrame:
    """Of each folder of ten tracks the one with most fixes, the first of equals."""
    n = p.groupBy("case_id").agg(F.count_if(P.has_fix()).alias("n"))
    return n.groupBy(F.expr("case_id div 10").alias("folder")).agg(F.max_by("case_id", F.struct("n", -F.col("case_id"))).alias("primary_case"), F.max("n").alias("fixes"))


@query("SELECT case_id, max(end_time_sec) AS max_end FROM tp GROUP BY case_id")
def src_timeline_max_end(p: DataFrame) -> DataFrame:
    return p.groupBy("case_id").agg(F.max("end_time_sec").alias("max_end"))


@query("""sc AS (SELECT start_time_sec AS t, latitude AS a, longitude AS o, gps_date AS d, gps_utc_time AS u, bool_and(row_idx % 9 <> 0) AS trust FROM pt WHERE row_idx % 3 = 0 GROUP BY ALL)
SELECT case_id, row_idx, CASE WHEN gps_trusted IS NULL THEN trust WHEN trust IS NULL THEN gps_trusted ELSE gps_trusted AND trust END AS gps_trusted FROM pt LEFT JOIN sc
 ON start_time_sec IS NOT DISTINCT FROM t AND latitude IS NOT DISTINCT FROM a AND longitude IS NOT DISTINCT FROM o AND gps_date IS NOT DISTINCT FROM d AND gps_utc_time IS NOT DISTINCT FROM u""")
def jn_trust_sidecar(p: DataFrame) -> DataFrame:
    side = p.filter("row_idx % 3 = 0").withColumn("gps_trusted", F.expr("row_idx % 9 <> 0"))
    return SR.attach_trust(p, side).select("case_id", "row_idx", "gps_trusted")


@query("""WITH l AS (SELECT o_custkey AS run_id, o_orderkey AS line_no, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey * 2 END AS cut_at FROM orders WHERE o_orderkey % 4 <> 1)
SELECT run_id, max(line_no) AS line_no, arg_max(cut_at, line_no) AS cut_at FROM l WHERE cut_at IS NOT NULL GROUP BY run_id""", "orders")
def src_engine_damage_json(o: DataFrame) -> DataFrame:
    """The last readable DAMAGE_JSON line of every run."""
    text = F.when(F.expr("o_orderkey % 4 = 1"), "nothing").when(F.expr("o_orderkey % 3 = 0"), "DAMAGE_JSON [").otherwise(F.concat(F.lit('DAMAGE_JSON {"cut_at": '), (F.col("o_orderkey") * 2).cast("string"), F.lit("}")))
    lines = o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("line_no"), text.alias("line"))
    found = SR.tagged_json(lines, "DAMAGE_JSON", "cut_at long").filter("cut_at is not null")
    return found.groupBy("run_id").agg(F.max("line_no").alias("line_no"), F.max_by("cut_at", "line_no").alias("cut_at"))


@query("SELECT c_custkey AS path_id, c_custkey % 3 = 0 AS has_slack, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 ELSE 0 END AS n_regions FROM customer", "customer")
def src_detect_slack(c: DataFrame) -> DataFrame:
    """SLACK_JSON lines joined to the asked-for paths; a path without a line has no slack."""
    said = F.concat(F.lit('SLACK_JSON {"path_id": '), F.col("c_custkey").cast("string"), F.lit(', "has_slack": true, "n": '), (F.col("c_custkey") % 7).cast("string"), F.lit("}"))
    lines = c.filter("c_custkey % 3 = 0").select(F.lit(1).alias("run_id"), F.col("c_custkey").alias("line_no"), said.alias("line"))
    found = SR.tagged_json(lines, "SLACK_JSON", "path_id int, has_slack boolean, n int").select("path_id", "has_slack", "n")
    asked = c.select(F.col("c_custkey").alias("path_id"))
    return asked.join(found, "path_id", "left").select("path_id", F.coalesce("has_slack", F.lit(False)).alias("has_slack"), F.coalesce("n", F.lit(0)).alias("n_regions"))


@query("""sk AS (SELECT case_id, row_idx, row_idx * 20 + CASE WHEN row_idx % 9 = 4 THEN 130 ELSE 0 END AS utc FROM pt),
s1 AS (SELECT *, utc - lag(utc) OVER (PARTITION BY case_id ORDER BY utc, row_idx) AS gap FROM sk)
SELECT case_id, count(*) AS n_rows, count(*) FILTER (WHERE gap > 120) + 1 AS recordings, list_sort(list(DISTINCT CAST(CAST(TIMESTAMP '2024-06-18 14:50:00' + to_seconds(utc) + INTERVAL 9 HOURS AS DATE) AS VARCHAR))) AS dates FROM s1 GROUP BY case_id""")
def agg_slack_summary(p: DataFrame) -> DataFrame:
    """Rows, recordings and local dates of a slack set (also op_build_slack_set)."""
    raw = p.select("case_id", "row_idx", F.expr("row_idx * 20 + if(row_idx % 9 = 4, 130, 0)").alias("utc"))
    local = F.date_format(F.expr("timestamp_ntz'2024-06-18 14:50:00' + make_dt_interval(0, 9, 0, utc)"), "yyyy-MM-dd")
    out = linkage.slack_sessions(raw).withColumn("d", local)
    return out.groupBy("case_id").agg(F.count("*").alias("n_rows"), F.count_distinct("segment").alias("recordings"), F.array_sort(F.collect_set("d")).alias("dates"))


@query("""u0 AS (SELECT case_id, row_idx, gps_date, gps_utc_time FROM pt WHERE gps_utc_time IS NOT NULL)
SELECT case_id, row_idx, CAST(DATE '2024-06-18' - DATE '1970-01-01' AS DOUBLE) * 86400e0 + CAST(substr(gps_utc_time, 1, 2) AS DOUBLE) * 3600 + CAST(substr(gps_utc_time, 3, 2) AS DOUBLE) * 60 + CAST(substr(gps_utc_time, 5) AS DOUBLE) AS utc_key FROM u0""")
def win_utc_keys(p: DataFrame) -> DataFrame:
    key = TM.date_days(F.col("gps_date")) * F.lit(86400.0) + TM.utc_seconds(F.col("gps_utc_time"))
    return p.select("case_id", "row_idx", key.alias("utc_key")).filter("utc_key is not null")


@query("""g0 AS (SELECT case_id, segment_index, row_idx, CAST(substr(gps_utc_time, 3, 2) AS DOUBLE) * 60 + CAST(substr(gps_utc_time, 5) AS DOUBLE) - start_time_sec AS off, rkey FROM pt WHERE fix AND gps_utc_time IS NOT NULL),
g1 AS (SELECT *, row_number() OVER (PARTITION BY case_id, segment_index, rkey ORDER BY row_idx) AS d FROM g0),
g2 AS (SELECT *, row_number() OVER (PARTITION BY case_id, segment_index ORDER BY row_idx) AS n FROM g1 WHERE d = 1)
SELECT case_id, segment_index, round(list_sort(list(off))[len(list(off)) // 2 + 1], 6) AS gps_start FROM g2 WHERE n <= 7 GROUP BY case_id, segment_index""")
def agg_gps_start(p: DataFrame) -> DataFrame:
    """Clock at a clip's start: upper median of UTC minus playback time over its first seven distinct fixes (also top_first_n)."""
    clip = Window.partitionBy("case_id", "segment_index")
    rows = p.filter(P.has_fix()).withColumn("off", TM.utc_seconds(F.col("gps_utc_time")) - F.col("start_time_sec")).filter("off is not null").withColumn("k", P.record_key())
    rows = rows.withColumn("d", F.row_number().over(Window.partitionBy("case_id", "segment_index", "k").orderBy("row_idx"))).filter("d = 1")
    rows = rows.withColumn("n", F.row_number().over(clip.orderBy("row_idx"))).filter("n <= 7")
    by = rows.groupBy("case_id", "segment_index").agg(F.array_sort(F.collect_list("off")).alias("o"))
    return by.select("case_id", "segment_index", F.round(F.element_at("o", (F.floor(F.size("o") / 2) + 1).cast("int")), 6).alias("gps_start"))


@query("""SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 11 = 0 THEN ['same_file'] WHEN o_orderkey % 7 = 0 THEN ['same_content'] ELSE [x FOR x IN [CASE WHEN o_orderkey % 5 = 0 THEN 'brand' END,
 CASE WHEN o_orderkey % 10 > 3 THEN 'name_time' END, CASE WHEN abs(o_orderkey % 9) > greatest(2e0, 0.05e0 * (60 + o_orderkey % 9)) THEN 'duration' END] IF x IS NOT NULL] END AS problems FROM orders""", "orders")
def op_compare_pair(o: DataFrame) -> DataFrame:
    """Also op_same_file, op_signature_problems and op_check_pair_probes on made-up sides."""
    k = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp")

    def side(rear: bool):
        n = F.lit(int(rear))
        return F.struct(
            F.when(rear & (k % 11 != 0), "rear").otherwise("front").alias("path"), F.when(rear & (k % 7 != 0), "b").otherwise("a").alias("sha256") if rear else F.lit("a").alias("sha256"),
            (at + F.make_dt_interval(secs=n * (k % 10))).alias("name_time"), (F.lit(60.0) + n * (k % 9)).alias("duration"), F.lit(None).cast("timestamp").alias("recorded_at"), F.lit("mp4").alias("container"),
            F.when(rear & (k % 5 == 0), "x").otherwise("i").alias("brand") if rear else F.lit("i").alias("brand"), F.lit("").alias("udta"), F.lit("m").alias("model"), F.lit("h").alias("codec"),
        )

    rows = o.select(k.alias("pair_id"), side(False).alias("front"), side(True).alias("rear"))
    return pairs.compare_pairs(rows).select("pair_id", "problems")


@query("""WITH c AS (SELECT o_custkey AS case_id, o_orderkey AS clip, CASE WHEN o_orderkey % 20 <> 0 THEN o_orderkey * 1e0 END AS g, CASE WHEN o_orderkey % 50 <> 1 THEN o_orderkey * 2e0 END AS n FROM orders),
b AS (SELECT case_id, CASE WHEN bool_and(g IS NOT NULL) THEN 'gps' WHEN bool_and(n IS NOT NULL) THEN 'filename' ELSE 'none' END AS basis FROM c GROUP BY case_id)
SELECT c.case_id, clip, basis, CASE basis WHEN 'gps' THEN g WHEN 'filename' THEN n END AS start FROM c JOIN b ON c.case_id = b.case_id""", "orders")
def op_choose_basis(o: DataFrame) -> DataFrame:
    """Also op_start_of."""
    k = F.col("o_orderkey")
    clips = o.select(F.col("o_custkey").alias("case_id"), k.alias("clip"), F.when(k % 20 != 0, k * F.lit(1.0)).alias("gps_start"), F.when(k % 50 != 1, k * F.lit(2.0)).alias("name_start"))
    return pairs.choose_basis(clips).select("case_id", "clip", "basis", "start")


@query(EVENTS + """, ei AS (SELECT DISTINCT case_id, unnest(range(start_index, end_index + 1)) AS row_idx FROM car), im AS (SELECT case_id, row_idx FROM pt WHERE g >= 2),
fl AS (SELECT * FROM ei UNION SELECT * FROM im) SELECT pt.case_id, pt.row_idx FROM pt ANTI JOIN fl ON pt.case_id = fl.case_id AND pt.row_idx = fl.row_idx""")
def set_minus_flagged(p: DataFrame) -> DataFrame:
    """Rows that are neither in an event nor an impact (also set_union_impacts)."""
    found = events.detect(p).filter("vehicle = 'car'").select("case_id", F.explode(F.sequence("start_index", "end_index")).alias("row_idx"))
    impacts = p.filter(P.g_magnitude() >= R.IMPACT_G).select("case_id", "row_idx")
    return p.select("case_id", "row_idx").join(found.union(impacts).distinct(), ["case_id", "row_idx"], "left_anti")


@query(SLOTS + "SELECT case_id, row_idx FROM sl INTERSECT SELECT case_id, row_idx FROM pt WHERE g >= 2")
def set_intersect_flagged(p: DataFrame) -> DataFrame:
    return S.gps_slots(p).select("case_id", "row_idx").intersect(p.filter(P.g_magnitude() >= R.IMPACT_G).select("case_id", "row_idx"))


@query("SELECT case_id, row_idx, start_time_sec, 0 AS kind FROM pt WHERE NOT syn UNION ALL SELECT case_id, row_idx, start_time_sec, 1 AS kind FROM pt WHERE syn")
def set_union_slack(p: DataFrame) -> DataFrame:
    real = p.filter(~P.is_synthetic()).select("case_id", "row_idx", "start_time_sec", F.lit(0).alias("kind"))
    return real.unionByName(p.filter(P.is_synthetic()).select("case_id", "row_idx", "start_time_sec", F.lit(1).alias("kind")), allowMissingColumns=True)


@query("SELECT case_id, list_sort(list(DISTINCT segment_index % 2) FILTER (WHERE fix)) = list_sort(list(DISTINCT segment_index % 2)) AS equal_ids FROM pt GROUP BY case_id")
def set_chunkid_equality(p: DataFrame) -> DataFrame:
    part = F.col("segment_index") % 2
    by = p.groupBy("case_id").agg(F.array_sort(F.collect_set(F.when(P.has_fix(), part))).alias("a"), F.array_sort(F.collect_set(part)).alias("b"))
    return by.select("case_id", (F.col("a") == F.col("b")).alias("equal_ids"))


@query("SELECT case_id, count(*) FILTER (WHERE fix) AS n_points, md5(string_agg(CAST(row_idx AS VARCHAR), ',' ORDER BY row_idx) FILTER (WHERE fix)) AS rows_md5 FROM pt GROUP BY case_id HAVING count(*) FILTER (WHERE fix) > 0")
def snk_map_payload(p: DataFrame) -> DataFrame:
    """Points of a case for its map as one JSON text (here its size and the digest of its row numbers)."""
    unit = F.struct("row_idx", "latitude", "longitude", "speed_kmh", "segment_index")
    by = p.filter(P.has_fix()).groupBy("case_id").agg(F.array_sort(F.collect_list(unit)).alias("points"))
    payload = by.select("case_id", F.to_json(F.struct("points")).alias("json"))
    back = payload.select("case_id", F.from_json("json", "points array<struct<row_idx:bigint>>").alias("o"))
    ids = F.transform("o.points", lambda x: x["row_idx"].cast("string"))
    return back.select("case_id", F.size("o.points").cast("long").alias("n_points"), F.md5(F.array_join(ids, ",").cast("binary")).alias("rows_md5"))


@query(EVENTS + "SELECT case_id, string_agg(kind, ',' ORDER BY prio) AS kinds FROM (SELECT DISTINCT case_id, kind, prio FROM car) GROUP BY case_id")
def op_legends(p: DataFrame) -> DataFrame:
    """Kinds of events that a case's map has to explain, in order of precedence."""
    kinds = events.merge_hits(events.hits(p)).filter("vehicle = 'car'").select("case_id", "kind").distinct()
    by = kinds.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(S.event_rank("kind").alias("r"), "kind"))).alias("k"))
    return by.select("case_id", F.array_join(F.col("k.kind"), ",").alias("kinds"))


@query("SELECT case_id, 'composed' AS view, min(row_idx) AS first_idx, count(*) AS n_rows FROM pt GROUP BY case_id UNION ALL SELECT case_id, 'video' || (segment_index + 1), min(row_idx), count(*) FROM pt GROUP BY case_id, segment_index")
def op_dataset_views(p: DataFrame) -> DataFrame:
    whole = p.groupBy("case_id").agg(F.min("row_idx").alias("first_idx"), F.count("*").alias("n_rows")).select("case_id", F.lit("composed").alias("view"), "first_idx", "n_rows")
    clips = p.groupBy("case_id", "segment_index").agg(F.min("row_idx").alias("first_idx"), F.count("*").alias("n_rows"))
    return whole.unionByName(clips.select("case_id", F.concat(F.lit("video"), (F.col("segment_index") + 1).cast("string")).alias("view"), "first_idx", "n_rows"))


@query("SELECT case_id, row_idx, row_number() OVER (PARTITION BY case_id ORDER BY start_time_sec, row_idx) - 1 AS place FROM pt")
def srt_track(p: DataFrame) -> DataFrame:
    return S.with_row_idx(p.withColumn("_old", F.col("row_idx")), tie="_old").select("case_id", F.col("_old").alias("row_idx"), F.col("row_idx").alias("place"))


@query("""se AS (SELECT case_id, row_idx, t_us FROM pt WHERE g IS NOT NULL AND row_idx % 3 = 0), b AS (SELECT p.case_id, p.row_idx, p.t_us, s.row_idx AS bi, p.t_us - s.t_us AS bd FROM pt p ASOF LEFT JOIN se s ON p.case_id = s.case_id AND p.t_us >= s.t_us),
a AS (SELECT b.*, s.row_idx AS ai, s.t_us - b.t_us AS ad FROM b ASOF LEFT JOIN se s ON b.case_id = s.case_id AND b.t_us <= s.t_us)
SELECT case_id, row_idx, CASE WHEN least(coalesce(bd, 9e18), coalesce(ad, 9e18)) > 1000000 THEN NULL WHEN coalesce(bd, 9e18) <= coalesce(ad, 9e18) THEN bi ELSE ai END AS sensor_idx FROM a""")
def jn_sensor_nearest(p: DataFrame) -> DataFrame:
    """The nearest sensor row within a second of each row, the earlier of equals."""
    unit = F.when(P.g_magnitude().isNotNull() & (F.col("row_idx") % 3 == 0), F.struct("t_us", "row_idx"))
    w = Window.partitionBy("case_id").orderBy("t_us")
    rows = p.withColumn("u", unit).withColumn("b", F.last("u", ignorenulls=True).over(w)).withColumn("a", F.first("u", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    bd, ad = F.col("t_us") - F.col("b.t_us"), F.col("a.t_us") - F.col("t_us")
    near = F.when(F.coalesce(bd <= ad, ad.isNull()), F.struct(bd.alias("d"), F.col("b.row_idx").alias("i"))).otherwise(F.struct(ad.alias("d"), F.col("a.row_idx").alias("i")))
    return rows.select("case_id", "row_idx", near.alias("n")).select("case_id", "row_idx", F.when(F.col("n.d") <= 1_000_000, F.col("n.i")).alias("sensor_idx"))


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return O
