"""Queries over row contracts, small projections, scalar functions and whole analyses, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, texts
from ..functions import predicates as P
from ..functions import times as TM
from ..operators import damage as D
from ..operators import events as E
from ..operators import outliers as X
from ..operators import recordings as RC
from ..operators import sequence as S
from ..sources import rows as SR
from ..sources.shared import shared_path
from . import queries_damage as QD
from . import queries_more as QM
from .queries_track import HAV

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None, table: str | None = None):
    def add(f):
        QM.query(sql, table)(f)
        Q[f.__name__] = QM.Q.pop(f.__name__)
        if sql:
            O[f.__name__] = QM.O.pop(f.__name__)
        return f

    return add


# --- row contracts, written and read back


@query("""SELECT case_id, start_time_sec, latitude, longitude, speed_kmh, gps_date, gps_utc_time, gps_checksum_ok,
 CASE WHEN gps_status = 'V' THEN false ELSE gps_trusted END AS gps_trusted FROM tp""")
def src_coordinates_csv(p: DataFrame) -> DataFrame:
    """coordinates.csv: other names for some columns, and a status that overrules trust."""
    path = shared_path(p.sparkSession, "coordinates")
    out = p.select(
        "case_id", "start_time_sec", "end_time_sec", "time_source", "latitude", "longitude", "speed_kmh", "track_deg", F.col("gps_date").alias("date"), F.col("gps_utc_time").alias("utc_time"),
        F.col("gps_checksum_ok").alias("checksum_ok"), (F.col("gps_status") != "V").alias("status_valid"), F.col("gps_trusted").alias("trusted"), F.col("gps_status").alias("status"),
    )
    out.select(*[F.col(c).cast("string") for c in out.columns]).write.option("header", True).csv(path)
    rows = SR.normalize(SR.read_csv(p.sparkSession, path), SR.COORDINATES)
    names = ("start_time_sec", "latitude", "longitude", "speed_kmh", "gps_date", "gps_utc_time", "gps_checksum_ok", "gps_trusted")
    return rows.select(F.col("case_id").cast("long").alias("case_id"), *names)


@query("SELECT case_id, row_idx, min(time_source) OVER (PARTITION BY case_id) AS time_source, start_time_sec FROM tp")
def src_load_existing(p: DataFrame) -> DataFrame:
    """A stored timeline as a track again: order by time, and the first time source that is given."""
    path = shared_path(p.sparkSession, "existing")
    SR.write_timeline(p, path)
    track = RC.stored_track(SR.load_timeline(p.sparkSession, path))
    return track.select(F.col("case_id").cast("long").alias("case_id"), "row_idx", "time_source", "start_time_sec")


@query("SELECT CAST(p_partkey AS INTEGER) AS track FROM part WHERE (p_size % 4 IN (0, 1) OR p_size % 3 = 0) AND p_partkey % 5 <> 0", "part")
def src_pending_tracks(part: DataFrame) -> DataFrame:
    """Text tracks without an output, of a table in which a part stands for a track."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Text", "sbtl", "vide", "soun")]), F.col("p_size") % 4 + 1)
    table = part.select(F.col("p_partkey").cast("string").alias("track"), kind.alias("handler_type"), F.when(F.col("p_size") % 3 == 0, "yes").otherwise("no").alias("is_text_track"))
    done = part.filter("p_partkey % 5 = 0").select(F.col("p_partkey").cast("int").alias("track"))
    return SR.pending_tracks(table, done)


@query("SELECT count(*) FILTER (WHERE event_type = 'error') AS n FROM events", "events")
def src_out_of_range(events: DataFrame) -> DataFrame:
    return SR.out_of_range(events.select(F.when(F.col("event_type") == "error", " out_of_range ").otherwise("ok").alias("validation")))


# --- filters and projections


@query("SELECT case_id, row_idx FROM pt WHERE gps_status IS DISTINCT FROM 'V'")
def flt_map_points(p: DataFrame) -> DataFrame:
    """Of residue rows only those with a time go on the map."""
    residue = p.withColumn("start_time_sec", F.when(F.col("gps_status") == "V", F.lit(None).cast("double")).otherwise(F.col("start_time_sec")))
    return RC.map_points(residue).select("case_id", "row_idx")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'F, B' WHEN 1 THEN 'F' WHEN 2 THEN 'B' ELSE CASE WHEN user_id % 2 = 0 THEN 'F, B' ELSE '' END END AS view_tag,
 (event_id % 4 = user_id % 4) AS same_view FROM events""", "events")
def prj_view_tag(events: DataFrame) -> DataFrame:
    """Which views a recording has (also prj_same_view, where no mode is the empty one)."""

    def mode(c: str) -> Column:
        return F.element_at(F.array(F.lit("both"), F.lit("front"), F.lit("rear"), F.lit(None).cast("string")), (F.col(c) % 4 + 1).cast("int"))

    return events.select("event_id", texts.view_tag(mode("event_id"), F.col("user_id") % 2 == 0).alias("view_tag"), texts.same_view(mode("event_id"), mode("user_id")).alias("same_view"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'utc_estimated' WHEN 2 THEN 'estimated' WHEN 3 THEN 'utc_estimated' ELSE '' END AS tag FROM events", "events")
def prj_time_estimate_tag(events: DataFrame) -> DataFrame:
    source = F.element_at(F.array(*[F.lit(x) for x in ("stts", "gps_utc_estimated", "gps_elapsed_estimated", "", "gps")]), (F.col("event_id") % 5 + 1).cast("int"))
    return events.select("event_id", texts.time_estimate_tag(source, F.col("event_id") % 5 == 3).alias("tag"))


# --- scalar functions

LAGS = """lg AS (SELECT *, lag(speed_kmh) OVER w AS pv, lag(start_time_sec) OVER w AS pt0, lag(latitude) OVER w AS pla, lag(longitude) OVER w AS plo FROM pt WHERE fix WINDOW w AS (PARTITION BY case_id ORDER BY row_idx))
"""


def _lags(p: DataFrame) -> DataFrame:
    w = S.ordered()
    return p.filter(P.has_fix()).select("*", *[F.lag(c).over(w).alias(f"_{c}") for c in ("speed_kmh", "start_time_sec", "latitude", "longitude")])


@query(LAGS + "SELECT case_id, row_idx, coalesce(start_time_sec > pt0 AND abs(speed_kmh - pv) / (start_time_sec - pt0) <= 40, false) AS possible FROM lg")
def fn_rate_ok(p: DataFrame) -> DataFrame:
    possible = X.rate_ok(F.col("_speed_kmh"), F.col("_start_time_sec"), F.col("speed_kmh"), F.col("start_time_sec"))
    return _lags(p).select("case_id", "row_idx", possible.alias("possible"))


@query(LAGS + """SELECT case_id, row_idx, round(pla + (latitude - pla) * ((floor(pt0) + 1 - pt0) / (start_time_sec - pt0)), 9) AS latitude,
 round(plo + (longitude - plo) * ((floor(pt0) + 1 - pt0) / (start_time_sec - pt0)), 9) AS longitude FROM lg WHERE floor(pt0) + 1 < start_time_sec""")
def fn_linear_interp(p: DataFrame) -> DataFrame:
    """Places at the first whole second between two fixes."""
    at = F.floor("_start_time_sec") + 1
    between = [F.round(D.on_line(F.col(f"_{c}"), F.col(c), F.col("_start_time_sec"), F.col("start_time_sec"), at), 9).alias(c) for c in ("latitude", "longitude")]
    return _lags(p).filter(at < F.col("start_time_sec")).select("case_id", "row_idx", *between)


@query(LAGS + f"""SELECT case_id, row_idx, round(greatest(coalesce(pv, 0), coalesce(speed_kmh, 0), 10) / 3.6e0 * greatest(1e0, abs(start_time_sec - pt0)) + 50, 6) AS reach_m,
 {HAV.format(a="pla", b="latitude", c="plo", d="longitude")} <= greatest(coalesce(pv, 0), coalesce(speed_kmh, 0), 10) / 3.6e0 * greatest(1e0, abs(start_time_sec - pt0)) + 50 AS reached FROM lg WHERE pt0 IS NOT NULL""")
def fn_reach_m(p: DataFrame) -> DataFrame:
    rows = _lags(p).filter("_start_time_sec is not null")
    reach = geo.reach_m(F.col("_speed_kmh"), F.col("speed_kmh"), F.col("start_time_sec") - F.col("_start_time_sec"))
    metres = geo.haversine_m(F.col("_latitude"), F.col("_longitude"), F.col("latitude"), F.col("longitude"))
    return rows.select("case_id", "row_idx", F.round(reach, 6).alias("reach_m"), (metres <= reach).alias("reached"))


@query("SELECT case_id, row_idx, 'https://maps.example/?q=' || printf('%.6f', latitude) || ',' || printf('%.6f', longitude) AS url FROM pt WHERE fix")
def fn_external_map_url(p: DataFrame) -> DataFrame:
    return p.filter(P.has_fix()).select("case_id", "row_idx", texts.map_url(F.col("latitude"), F.col("longitude")).alias("url"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') || ' (UTC+9)' WHEN 1 THEN strftime(ts + INTERVAL 14 HOUR, '%Y-%m-%d %H:%M:%S') || ' (UTC+9)'
 WHEN 2 THEN 'soon' WHEN 3 THEN '-' ELSE strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') || ' (UTC+9)' END AS text FROM events""", "events")
def fn_format_local_iso(events: DataFrame) -> DataFrame:
    """With an offset, without one (the session's zone), and what cannot be read."""
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.concat(plain, F.lit("+00:00"))).when(k == 1, F.concat(F.replace(plain, F.lit("T"), F.lit(" ")), F.lit("-05:00")))
    text = text.when(k == 2, "soon").when(k == 3, F.lit(None).cast("string")).otherwise(F.concat(F.lit(" "), plain))
    return events.select("event_id", TM.format_local_iso(text).alias("text"))


@query("""WITH k AS (SELECT user_id, d, count(*) AS n FROM (SELECT user_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) % 3 AS d FROM events) WHERE d > 0 GROUP BY ALL)
SELECT user_id, round(CASE WHEN max(n) * 2 > sum(n) THEN 1000e0 / arg_max(d, n) ELSE sum(n) * 1000e0 / sum(d * n) END, 9) AS fps FROM k GROUP BY user_id""", "events")
def fn_nominal_rate(events: DataFrame) -> DataFrame:
    """Samples a second: of the length that most samples have, else of their mean length."""
    d = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)) % 3
    counts = events.select("user_id", d.alias("length")).groupBy("user_id", "length").agg(F.count("*").alias("n"))
    return RC.nominal_rate(counts, ["user_id"], F.lit(1000)).select("user_id", F.round("fps", 9).alias("fps"))


# --- sets, order


@query("""s AS (SELECT case_id, segment_index, list_sort(list_distinct(list(CAST(floor(track_deg / 10) AS BIGINT)) FILTER (WHERE track_deg IS NOT NULL))) AS ids FROM tp GROUP BY ALL)
SELECT a.case_id, a.segment_index, coalesce(a.ids, []) = coalesce(b.ids, []) AS equal_sets, list_has_all(coalesce(b.ids, []), coalesce(a.ids, [])) AS contained
FROM s a JOIN s b ON a.case_id = b.case_id AND a.segment_index + 1 = b.segment_index""")
def set_chunkid_subset(p: DataFrame) -> DataFrame:
    """Ids of a clip's chunks against the next clip's: the same set, or part of it."""
    ids = p.groupBy("case_id", "segment_index").agg(F.array_sort(F.collect_set(F.floor(F.col("track_deg") / 10))).alias("ids"))
    after = ids.select("case_id", (F.col("segment_index") - 1).alias("segment_index"), F.col("ids").alias("others"))
    met = ids.join(after, ["case_id", "segment_index"])
    return met.select("case_id", "segment_index", (F.col("ids") == F.col("others")).alias("equal_sets"), (F.size(F.array_except("ids", "others")) == 0).alias("contained"))


@query("""SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(event_id - first), 'EVT_' || event_id) AS rank
 FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS first FROM events) WHERE value >= 50) WHERE rank <= 5""", "events")
def top_candidates(events: DataFrame) -> DataFrame:
    """Reference files by how near their numbers are, then by name (srt_candidates), the first five that pass."""
    named = events.select("user_id", "event_id", "value", F.concat(F.lit("EVT_"), "event_id").alias("name"), F.min("event_id").over(Window.partitionBy("user_id")).alias("own"))
    ranked = RC.nearest_names(named.filter("value >= 50"), ["user_id"], F.col("own"), F.regexp_extract("name", "([0-9]+)", 1).cast("long"))
    return ranked.filter("rank <= 5").select("user_id", "event_id", "rank")


# --- recordings


@query(QD.REGIONS + """,
an AS (SELECT case_id, source_offset AS o, utc0 AS u FROM (SELECT *, epoch(CAST(gps_date AS TIMESTAMP)) + CAST(substr(gps_utc_time, 3, 2) AS INTEGER) * 60 + CAST(substr(gps_utc_time, 5, 2) AS INTEGER) AS utc0
  FROM pt WHERE NOT syn AND coalesce(gps_checksum_ok, true) AND coalesce(gps_trusted, true) AND gps_status = 'A')),
fi AS (SELECT case_id, min(o) AS o1, arg_min(u, o) AS u1 FROM an GROUP BY case_id),
be AS (SELECT m.case_id, m.a, m.b, m.kind, x.o AS bo, x.u AS bu FROM mr m ASOF LEFT JOIN an x ON m.case_id = x.case_id AND m.a - 1 >= x.o),
af AS (SELECT be.*, y.u AS au FROM be ASOF LEFT JOIN an y ON be.case_id = y.case_id AND be.b <= y.o),
jd AS (SELECT af.*, au - bu AS du, CASE WHEN bu > u1 AND bo > o1 THEN (b - a) / ((bo - o1) / (bu - u1)) END AS expected FROM af LEFT JOIN fi ON af.case_id = fi.case_id),
ct AS (SELECT *, CASE WHEN du < -1 THEN 'back' WHEN du > coalesce(expected * 3, 0) + 600 THEN 'jump' WHEN du IS NULL AND kind <> 'zero' THEN 'uncertain' END AS reason FROM jd)
SELECT case_id, min(a) AS cut_at, arg_min(reason, a) AS reason FROM ct WHERE reason IS NOT NULL GROUP BY case_id""")
def win_recording_cut(p: DataFrame) -> DataFrame:
    """The first damaged stretch after which the clock shows another recording."""
    regions = QD.regions(p)
    merged = D.merge_regions(regions.withColumn("gap", (F.col("kind") == "gap").cast("int")).select("case_id", "a", "b"))
    gaps = D.region_kinds(merged, regions)
    return RC.recording_cut(p, gaps)


@query("""SELECT case_id, segment_index, 'clip ' || (segment_index + 1) AS label, 'seg' || lpad(CAST(segment_index + 1 AS VARCHAR), 2, '0') AS output_subdir, min(start_time_sec) AS offset_sec,
 round(max(end_time_sec) - min(start_time_sec), 3) AS duration_sec, CASE WHEN bool_or(fix) THEN 'ok' WHEN bool_or(rec) THEN 'no_fix' ELSE 'no_gps' END AS status FROM pt GROUP BY case_id, segment_index""")
def op_segment_record(p: DataFrame) -> DataFrame:
    return RC.segment_records(p)


@query(QD.REGIONS + """, c AS (SELECT case_id, count(*) FILTER (WHERE kind = 'gap') AS ng, coalesce(sum(b - a) FILTER (WHERE kind = 'gap'), 0) AS bg, count(*) FILTER (WHERE kind = 'zero') AS nz,
 coalesce(sum(b - a) FILTER (WHERE kind = 'zero'), 0) AS bz FROM mr GROUP BY case_id),
l AS (SELECT case_id, 1 AS line_no, 'unreadable' AS code, ng AS n, bg AS bytes FROM c WHERE ng > 0 UNION ALL SELECT case_id, 2, 'zeroed', nz, bz FROM c WHERE nz > 0
 UNION ALL SELECT DISTINCT case_id, 1, 'none', 0, 0 FROM pt WHERE case_id NOT IN (SELECT case_id FROM c))
SELECT case_id, CAST(line_no AS INTEGER) AS line_no, code, CAST(n AS BIGINT) AS n, CAST(bytes AS BIGINT) AS bytes FROM l""")
def op_damage_summary(p: DataFrame) -> DataFrame:
    regions = QD.regions(p)
    merged = D.region_kinds(D.merge_regions(regions.select("case_id", "a", "b")), regions)
    return RC.damage_summary(p.select("case_id").distinct(), merged)


@query("""SELECT case_id, segment_index, CASE WHEN case_id % 2 = 1 THEN strftime(m - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') || ' (file name)' WHEN m IS NOT NULL THEN strftime(m, '%Y-%m-%d %H:%M:%S') ELSE '' END AS text FROM (
 SELECT case_id, segment_index, min(CAST(gps_date AS TIMESTAMP) + to_seconds(CAST(substr(gps_utc_time, 3, 2) AS INTEGER) * 60 + CAST(substr(gps_utc_time, 5, 2) AS INTEGER))) + INTERVAL 9 HOUR AS m
 FROM pt WHERE gps_date IS NOT NULL GROUP BY case_id, segment_index)""")
def op_slot_start_text(p: DataFrame) -> DataFrame:
    """When a clip began: by GPS in display time, or by its file's name."""
    utc = F.to_timestamp_ntz(F.concat_ws(" ", "gps_date", F.regexp_replace("gps_utc_time", r"^(\d\d)(\d\d)(\d\d).*", "$1:$2:$3")))
    began = p.filter("gps_date is not null").groupBy("case_id", "segment_index").agg(F.min(utc).alias("began"))
    basis = F.when(F.col("case_id") % 2 == 1, "filename").otherwise("gps")
    return began.select("case_id", "segment_index", RC.slot_start_text(basis, F.col("began")).alias("text"))


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return O
