"""Queries over cases, texts and times, built on orders, customer and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts as X
from ..functions import times as T
from ..operators import cases as C
from ..operators import events as E
from .adapter import track_points

Q: dict = {}
O: dict[str, str] = {}


def query(table: str, sql: str | None = None):
    def add(f):
        Q[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            O[f.__name__] = sql
        return f

    return add


ORDER = "o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, (o_orderkey * 37) % 86400 AS s FROM orders"
CLOCK = "lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || '{0}' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || '{0}' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')"


def _orders(o: DataFrame) -> DataFrame:
    rows = o.select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.expr("(o_orderkey * 37) % 86400").alias("s"))
    h, m, s = (F.lpad(F.expr(e).cast("string"), 2, "0") for e in ("s div 3600", "s % 3600 div 60", "s % 60"))
    iso = F.date_format("d", "yyyy-MM-dd")
    date = F.expr("k % 4")
    return rows.select(
        "*", F.when(date == 0, iso).when(date == 1, F.date_format("d", "ddMMyy")).when(date == 2, F.lit("31x199")).otherwise(F.concat(F.lit(" "), iso, F.lit(" "))).alias("date_text"),
        F.when(F.expr("k % 3") == 0, F.concat(h, m, s, F.lit(".25"))).when(F.expr("k % 3") == 1, F.concat_ws(":", h, m, s)).otherwise(F.lit("99:99:99")).alias("time_text"),
    )


@query("orders", f"SELECT k, CASE WHEN k % 4 <> 2 THEN d END AS parsed FROM (SELECT {ORDER})")
def fn_parse_date(o: DataFrame) -> DataFrame:
    return _orders(o).select("k", T.parse_date(F.col("date_text")).alias("parsed"))


@query("orders", f"SELECT k, CAST(CASE WHEN k % 3 <> 2 THEN s END AS BIGINT) AS parsed FROM (SELECT {ORDER})")
def fn_parse_time(o: DataFrame) -> DataFrame:
    return _orders(o).select("k", T.parse_time(F.col("time_text")).cast("long").alias("parsed"))


@query("orders", f"SELECT k, CASE k % 3 WHEN 0 THEN s + 0.25e0 WHEN 1 THEN s + 0e0 END AS parsed FROM (SELECT {ORDER})")
def fn_utc_seconds(o: DataFrame) -> DataFrame:
    return _orders(o).select("k", T.utc_seconds(F.col("time_text")).alias("parsed"))


@query("orders", f"SELECT k, CAST(CASE WHEN k % 4 <> 2 THEN d - DATE '1970-01-01' END AS BIGINT) AS days FROM (SELECT {ORDER})")
def fn_date_days(o: DataFrame) -> DataFrame:
    return _orders(o).select("k", T.date_days(F.col("date_text")).cast("long").alias("days"))


@query("orders", f"SELECT k, CASE WHEN k % 5 <> 0 THEN epoch(CAST(d AS TIMESTAMP)) + s + CASE WHEN k % 5 = 2 THEN 0.5e0 ELSE 0e0 END END AS seconds FROM (SELECT {ORDER})")
def fn_abs_time_seconds(o: DataFrame) -> DataFrame:
    h, m, s = (F.lpad(F.expr(e).cast("string"), 2, "0") for e in ("s div 3600", "s % 3600 div 60", "s % 60"))
    iso = F.date_format("d", "yyyy-MM-dd")
    clock = F.concat_ws(":", h, m, s)
    kind = F.expr("k % 5")
    text = F.when(kind == 0, "nothing").when(kind == 1, F.concat_ws("T", iso, clock)).when(kind == 2, F.concat(iso, F.lit(" "), clock, F.lit(".5"))).otherwise(F.concat_ws(" ", iso, clock))
    return _orders(o).select("k", T.abs_time_seconds(text).alias("seconds"))


@query("orders", f"""SELECT k, CASE WHEN k % 3 = 2 THEN '' WHEN k % 4 = 2 THEN strftime(TIMESTAMP '2000-01-01' + to_seconds(s + 32400), '%H:%M:%S') || ' (UTC+9)'
 ELSE strftime(CAST(d AS TIMESTAMP) + to_seconds(s + 32400), '%Y-%m-%d %H:%M:%S') || ' (UTC+9)' END AS shown FROM (SELECT {ORDER})""")
def fn_format_display(o: DataFrame) -> DataFrame:
    """Also fn_to_display."""
    return _orders(o).select("k", T.to_display(F.col("date_text"), F.col("time_text")).alias("shown"))


@query("orders", f"SELECT k, CASE WHEN k % 4 <> 3 THEN CAST(d AS TIMESTAMP) + to_seconds(s) END AS ts FROM (SELECT {ORDER} WHERE o_orderdate >= DATE '1900-01-01')")
def fn_filename_timestamp(o: DataFrame) -> DataFrame:
    ts = F.to_timestamp_ntz(F.concat_ws(" ", F.date_format("d", "yyyy-MM-dd"), F.concat_ws(":", *[F.lpad(F.expr(e).cast("string"), 2, "0") for e in ("s div 3600", "s % 3600 div 60", "s % 60")])))
    later = ts + F.expr("interval 20 years")  # names carry years of this century
    kind = F.expr("k % 4")
    name = (
        F.when(kind == 0, F.concat(F.lit("REC_"), F.date_format(later, "yyyyMMdd_HHmmss"), F.lit("_F.mp4"))).when(kind == 1, F.concat(F.date_format(later, "yyyyMMdd-HH'h'mm'm'ss's'"), F.lit(".avi")))
        .when(kind == 2, F.concat(F.lit("EVT"), F.date_format(later, "yyyy-MM-dd_HH-mm-ss"), F.lit("F.mp4"))).otherwise("clip.mp4")
    )
    out = _orders(o).select("k", T.filename_timestamp(name).cast("timestamp_ntz").alias("ts"))
    return out.withColumn("ts", F.col("ts") - F.expr("interval 20 years"))


@query("orders", "SELECT o_orderkey AS k, CASE WHEN o_orderkey * 1000003 - 2082844800 >= 0 THEN o_orderkey * 1000003 - 2082844800 END AS unix FROM orders")
def fn_mp4_epoch(o: DataFrame) -> DataFrame:
    return o.select(F.col("o_orderkey").alias("k"), T.mp4_epoch(F.col("o_orderkey") * 1000003).alias("unix"))


@query("orders", f"SELECT k, {CLOCK.format(':')} AS shown FROM (SELECT {ORDER})")
def fn_fmt_duration(o: DataFrame) -> DataFrame:
    return _orders(o).select("k", X.duration_parts(F.col("s") + 0.5).alias("shown"))


@query("customer", """SELECT c_custkey AS k, regexp_replace(lower(c_name || c_mktsegment), '[^a-z]', '', 'g') AS model, left(regexp_replace(c_name, '[^A-Za-z0-9_-]', '', 'g'), 48) || '_' || c_custkey AS folder,
 upper(regexp_extract(c_name, '^[A-Za-z_]+')) AS prefix, CAST(left(regexp_replace(c_name || '_4', '[^0-9]', '', 'g'), 14) AS BIGINT) AS digits, CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'r' END AS channel FROM customer""")
def fn_name_parts(c: DataFrame) -> DataFrame:
    """fn_normalize_model, fn_safe_folder, fn_name_prefix, fn_digits, fn_channel_tag."""
    file = F.concat("c_name", F.when(F.expr("c_custkey % 2 = 0"), "_f.mp4").otherwise("-R.m4v"))
    return c.select(
        F.col("c_custkey").alias("k"), X.normalize_model(F.concat("c_name", "c_mktsegment")).alias("model"), X.safe_folder(F.col("c_name"), F.col("c_custkey")).alias("folder"),
        X.name_prefix(F.col("c_name")).alias("prefix"), X.digits(F.concat("c_name", F.lit("_4"))).alias("digits"), X.channel_tag(file).alias("channel"),
    )


@query("customer", "SELECT c_custkey AS k, 'V' || c_custkey || '_R.mp4' AS first_choice FROM customer")
def fn_rear_candidates(c: DataFrame) -> DataFrame:
    name = F.concat(F.lit("V"), F.col("c_custkey").cast("string"), F.lit("_F.mp4"))
    return c.select(F.col("c_custkey").alias("k"), F.element_at(X.rear_candidates(name), 1).alias("first_choice"))


@query("customer", """WITH f AS (SELECT c_custkey AS id, 'V' || c_custkey || '_F.mp4' AS name FROM customer), r AS (SELECT c_custkey AS id, 'v' || c_custkey || '_r.MP4' AS name FROM customer WHERE c_custkey % 3 = 0)
SELECT f.id AS front_id, r.id AS rear_id FROM f JOIN r ON lower(r.name) = lower(replace(f.name, '_F.', '_R.'))""")
def jn_rear_by_name(c: DataFrame) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    front = c.select(F.col("c_custkey").alias("front_id"), F.explode(X.rear_candidates(F.concat(F.lit("V"), key, F.lit("_F.mp4")))).alias("name"))
    rear = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("rear_id"), F.lower(F.concat(F.lit("v"), key, F.lit("_r.MP4"))).alias("name"))
    return front.withColumn("name", F.lower("name")).join(rear, "name").select("front_id", "rear_id").distinct()


@query("pages", "SELECT page_id AS k, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def fn_html_escape(p: DataFrame) -> DataFrame:
    return p.select(F.col("page_id").alias("k"), X.html_escape(F.col("html")).alias("escaped"))


@query("orders", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderkey END AS byte_at FROM orders")
def fn_offset_parse(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("0x"), F.hex(k))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".0"))).otherwise("none")
    return o.select(k.alias("k"), X.parse_offset(text).alias("byte_at"))


@query("documents", """SELECT doc_id, CASE WHEN n_chars >= 1048576 THEN 'MB' WHEN n_chars >= 1024 THEN 'KB' ELSE 'B' END AS unit,
 round_even(n_chars / CASE WHEN n_chars >= 1048576 THEN 1048576e0 WHEN n_chars >= 1024 THEN 1024e0 ELSE 1e0 END * 100, 0) / 100 AS amount FROM documents""")
def fn_format_size(d: DataFrame) -> DataFrame:
    return d.select("doc_id", X.format_size(F.col("n_chars")).alias("s")).select("doc_id", "s.unit", "s.amount")


@query("orders", """SELECT o_orderkey AS k, CASE WHEN x <= 5 THEN 1 WHEN x <= 10 THEN 2 WHEN x <= 100 THEN 10 WHEN x <= 200 THEN 20 WHEN x <= 300 THEN 30 WHEN x <= 600 THEN 60 WHEN x <= 1200 THEN 120 WHEN x <= 3000 THEN 300 WHEN x <= 6000 THEN 600
 ELSE 900 END AS step FROM (SELECT o_orderkey, o_orderkey * 7 % 9000 AS x FROM orders)""")
def fn_tick_step(o: DataFrame) -> DataFrame:
    return o.select(F.col("o_orderkey").alias("k"), X.tick_step(F.expr("o_orderkey * 7 % 9000")).alias("step"))


@query("customer", "SELECT c_custkey AS k, round_even(c_acctbal / 1000 * 10000, 0) / 10000 AS rounded FROM customer")
def fn_cache_key(c: DataFrame) -> DataFrame:
    return c.select(F.col("c_custkey").alias("k"), (F.rint(F.col("c_acctbal") / 1000 * 10000) / 10000).alias("rounded"))


@query("customer", "SELECT c_custkey AS k, CASE WHEN v IN ('car', 'bus', 'truck') THEN v ELSE 'car' END AS vehicle FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'bus' WHEN 1 THEN 'truck' WHEN 2 THEN 'tram' WHEN 3 THEN NULL ELSE 'car' END AS v FROM customer)")
def prj_vehicle(c: DataFrame) -> DataFrame:
    rows = c.withColumn("v", F.expr("case c_custkey % 5 when 0 then 'bus' when 1 then 'truck' when 2 then 'tram' when 3 then null else 'car' end"))
    return rows.select(F.col("c_custkey").alias("k"), E.vehicle_or_car("v").alias("vehicle"))


FACTS = "o_orderkey % 17 = 0 AS timed_out, CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 0 END AS exit_code, CASE WHEN o_orderkey % 5 = 0 THEN 'error' END AS failure_line, o_orderkey % 4 AS fixes, o_orderkey % 7 AS coords, o_orderkey % 3 AS out_of_range, o_orderkey % 11 = 0 AS false_flags, o_orderkey % 2 = 0 AS ran, false AS no_gps_marker"
OUTCOME = """CASE WHEN timed_out THEN 'timed_out' WHEN exit_code <> 0 THEN 'engine_failed' WHEN failure_line IS NOT NULL THEN 'engine_failed' WHEN fixes > 0 THEN 'ok'
 WHEN out_of_range > 0 THEN 'engine_failed' WHEN coords > 0 OR false_flags THEN 'gps_untrusted' WHEN ran OR no_gps_marker THEN 'no_gps' ELSE 'engine_failed' END"""


def _facts(o: DataFrame) -> DataFrame:
    return o.selectExpr("o_orderkey", "o_custkey", *[f.strip() for f in FACTS.split(", ")])


@query("orders", f"SELECT o_orderkey AS k, {OUTCOME} AS status FROM (SELECT o_orderkey, {FACTS} FROM orders)")
def prj_status_outcome(o: DataFrame) -> DataFrame:
    return _facts(o).select(F.col("o_orderkey").alias("k"), C.status_outcome().alias("status"))


@query("orders", f"""WITH s AS (SELECT o_custkey, {OUTCOME} AS status FROM (SELECT o_orderkey, o_custkey, {FACTS} FROM orders))
SELECT o_custkey AS k, arg_min(status, list_position(['timed_out', 'engine_failed', 'unsupported', 'gps_untrusted', 'no_gps', 'unknown', 'ok'], status)) AS worst FROM s GROUP BY o_custkey""")
def prj_worst_status(o: DataFrame) -> DataFrame:
    return C.worst_status(_facts(o).withColumn("status", C.status_outcome()), ["o_custkey"]).withColumnRenamed("o_custkey", "k")


@query("orders", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'unknown' WHEN o_orderkey % 5 = 1 THEN 'engine_failed' WHEN o_orderkey % 5 = 2 THEN 'ok' WHEN o_orderkey % 2 = 0 THEN 'no_gps' ELSE 'unknown' END AS status FROM orders""")
def prj_reopen_status(o: DataFrame) -> DataFrame:
    db = F.expr("case o_orderkey % 5 when 1 then 'analyzing' when 2 then 'ok' when 3 then '' end")
    stored = F.expr("case when o_orderkey % 2 = 0 then 'no_gps' end")
    return o.select(F.col("o_orderkey").alias("k"), C.reopen_status(db, stored, F.expr("o_orderkey % 6 <> 0")).alias("status"))


@query("orders", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 AND m > 0 AND m <= 604800 AND abs(m - h) > 0.5e0 THEN m ELSE h END AS effective, CASE WHEN h > 0 AND h <= 604800 THEN h END AS plausible
 FROM (SELECT o_orderkey, (o_orderkey % 100) * 10e0 AS h, CASE WHEN o_orderkey % 7 = 0 THEN -1e0 ELSE (o_orderkey % 100) * 10e0 + (o_orderkey % 3) * 0.4e0 END AS m FROM orders)""")
def prj_effective_duration(o: DataFrame) -> DataFrame:
    """Also prj_plausible_duration."""
    rows = o.select(
        "o_orderkey", F.expr("(o_orderkey % 100) * 10e0").alias("h"), F.expr("case when o_orderkey % 7 = 0 then -1e0 else (o_orderkey % 100) * 10e0 + (o_orderkey % 3) * 0.4e0 end").alias("m"),
        F.expr("if(o_orderkey % 2 = 0, 'avi', 'mp4')").alias("c"),
    )
    return rows.select(F.col("o_orderkey").alias("k"), C.effective_duration(F.col("h"), F.col("m"), F.col("c")).alias("effective"), C.plausible_duration(F.col("h")).alias("plausible"))


# --- history and integrity


@query("orders", """SELECT o_orderkey AS case_id, o_orderpriority AS examiner, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders""")
def srt_history(o: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return o.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("examiner"), F.row_number().over(w).alias("place"))


@query("customer", "SELECT c_custkey AS case_id FROM customer WHERE lower(c_name) LIKE '%00001%' OR lower(c_mktsegment) LIKE '%build%'")
def fn_like_search(c: DataFrame) -> DataFrame:
    return c.filter(X.contains_ascii_ci(F.col("c_name"), "00001") | X.contains_ascii_ci(F.col("c_mktsegment"), "BUILD")).select(F.col("c_custkey").alias("case_id"))


@query("documents", """WITH h AS (SELECT doc_id AS case_id, sha256(text) AS sha FROM documents) SELECT h.case_id, first_case, n_same FROM h
 JOIN (SELECT sha, min(case_id) AS first_case, count(*) AS n_same FROM h GROUP BY sha HAVING count(*) > 1) f ON h.sha = f.sha""")
def jn_same_hash_cases(d: DataFrame) -> DataFrame:
    return C.same_content(d.select(F.col("doc_id").alias("case_id"), F.sha2("text", 256).alias("sha256")))


def _files(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = d.select((F.col("doc_id") % 20).alias("case_id"), F.concat(F.lit("out/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.sha2("text", 256).alias("sha256"))
    listed = rows.filter("doc_id % 40 <> 7").select("case_id", "path", F.when(F.expr("doc_id % 40 = 9"), "0").otherwise(F.col("sha256")).alias("sha256"))
    return listed, rows.filter("doc_id % 40 <> 11").select("case_id", "path", "sha256")


@query("documents", """SELECT doc_id % 20 AS case_id, count(*) FILTER (WHERE doc_id % 40 = 11) AS missing, count(*) FILTER (WHERE doc_id % 40 = 7) AS unlisted, count(*) FILTER (WHERE doc_id % 40 = 9) AS changed,
 count(*) FILTER (WHERE doc_id % 40 IN (7, 9, 11)) = 0 AS intact FROM documents GROUP BY doc_id % 20""")
def jn_manifest_verify(d: DataFrame) -> DataFrame:
    return C.verify_manifest(*_files(d))


@query("documents", "SELECT doc_id % 20 AS case_id, 'out/' || doc_id AS path FROM documents WHERE doc_id % 40 = 7")
def set_unlisted_files(d: DataFrame) -> DataFrame:
    listed, files = _files(d)
    return files.join(listed, ["case_id", "path"], "left_anti").select("case_id", "path")


@query("documents", "SELECT doc_id % 20 AS case_id, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY doc_id % 20")
def agg_size_sum(d: DataFrame) -> DataFrame:
    return d.groupBy((F.col("doc_id") % 20).alias("case_id")).agg(F.sum(F.octet_length("text")).alias("bytes"))


@query("documents", "SELECT doc_id, sha256(CAST(length(text) AS VARCHAR) || left(text, 64) || substr(text, CAST(greatest(0, length(text) // 2 - 32) AS BIGINT) + 1, 64) || substr(text, CAST(greatest(0, length(text) - 64) AS BIGINT) + 1, 64)) AS digest FROM documents")
def agg_sample_digest(d: DataFrame) -> DataFrame:
    """Digest of a text's length and its first, middle and last 64 characters."""
    n = F.length("text")
    t = F.col("text")
    parts = [t.substr(F.lit(1), F.lit(64)), t.substr(F.greatest(F.lit(0), F.floor(n / 2) - 32).cast("int") + 1, F.lit(64)), t.substr(F.greatest(F.lit(0), n - 64) + 1, F.lit(64))]
    return d.select("doc_id", F.sha2(F.concat(n.cast("string"), *parts), 256).alias("digest"))


@query("orders", """WITH h AS (SELECT o_custkey AS case_id, o_orderkey AS version, o_orderpriority AS examiner, o_orderkey % 5 = 0 AS deleted, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT case_id, version, examiner FROM h WHERE n = 1 AND NOT deleted""")
def op_case_crud(o: DataFrame) -> DataFrame:
    """Additions, updates and deletions replayed (also op_update_case_info)."""
    log = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("examiner"), (F.col("o_orderkey") % 5 == 0).alias("deleted"), F.col("o_orderdate").alias("at"))
    return C.latest_rows(log, "case_id", ["at", "version"]).select("case_id", "version", "examiner")


LINES = "conv_id AS run_id, turn AS line_no, CASE WHEN turn % 3 = 1 THEN 'SKIP a.mp4 exception: ' || role ELSE text END AS line FROM conversations"


def _log(c: DataFrame) -> DataFrame:
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("line_no"), F.when(F.col("turn") % 3 == 1, F.concat(F.lit("SKIP a.mp4 exception: "), "role")).otherwise(F.col("text")).alias("line"))


@query("conversations", f"SELECT run_id, arg_min(line, line_no) AS failure_line FROM (SELECT {LINES}) WHERE line LIKE 'SKIP a.mp4 exception: %' GROUP BY run_id")
def prj_failure_line(c: DataFrame) -> DataFrame:
    return C.failure_lines(_log(c))


@query("conversations", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS n FROM (SELECT {LINES}) WHERE trim(line) <> '')
SELECT run_id, n, left(line, 40) AS line FROM r WHERE n <= 2 UNION ALL SELECT run_id, 3, '+' || (count(*) - 2) || ' more' FROM r GROUP BY run_id HAVING count(*) > 2""")
def top_warnings(c: DataFrame) -> DataFrame:
    """Also src_warnings."""
    return C.warnings_shown(_log(c), most=2, width=40)


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return O
