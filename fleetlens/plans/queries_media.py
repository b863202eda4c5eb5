"""Queries over bytes of files and over tables of video files, with their SQL.

Files are written from the given tables into the shared folder and read back in ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sample_tables as ST
from ..sources import byte_ranges as BR
from ..sources.shared import checkpointed, shared_path
from . import queries_damage as QD
from .adapter import ORACLE_CTE, track_points

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str, table: str | None = None):
    def add(f: Callable[[DataFrame], DataFrame]):
        Q[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet") if table else track_points(spark, sf_dir))
        O[f.__name__] = sql if table else "WITH " + ORACLE_CTE.strip() + ",\n" + sql
        return f

    return add


# --- bytes


#: Rows whose lines make one file, about; a case's lines are in one file whatever their number.
ROWS_PER_FILE = 200_000


def _case_files(lines: DataFrame, name: str) -> DataFrame:
    """Writes the bytes of lines(case_id, line_no, line) case by case, many cases to a file, and gives members(path, name, begin, size): a case is a file in it."""
    spark = lines.sparkSession
    path = shared_path(spark, name)
    lines = checkpointed(lines)
    n = max(1, lines.count() // ROWS_PER_FILE)
    dealt = lines.withColumn("part", F.pmod(F.xxhash64("case_id"), F.lit(n)).cast("int"))
    ordered = dealt.repartition(n, "part").sortWithinPartitions("part", "case_id", "line_no")
    ordered.select("part", "line").write.option("maxRecordsPerFile", 0).partitionBy("part").text(path)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("part", F.col("path").alias("file"))
    # A line ends with one byte of its own.
    sizes = dealt.groupBy("part", "case_id").agg(F.sum(F.octet_length("line") + 1).alias("size"))
    before = Window.partitionBy("part").orderBy("case_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("begin", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return checkpointed(placed.join(found, "part").select(F.col("file").alias("path"), F.concat(F.lit("case_id="), F.col("case_id")).alias("name"), "begin", "size"))


CASE_OF = r"case_id=(\d+)"
#: A sentence's body; some have a wrong checksum, some no valid state, and every line is followed by other bytes.
BODY = "concat('GPRMC,00', lpad(cast(row_idx div 60 as string), 2, '0'), lpad(cast(row_idx % 60 div 2 * 2 as string), 2, '0'), '.00,', if(row_idx % 11 = 3, 'V', 'A'), ',37', lpad(cast(row_idx % 60 as string), 2, '0'), '.5000,N,12701.2500,E,', cast(row_idx % 90 as string), '.5,10.0,180624,,')"
SENTENCES = """
s0 AS (SELECT case_id, row_idx, 'GPRMC,00' || lpad(CAST(row_idx // 60 AS VARCHAR), 2, '0') || lpad(CAST(row_idx % 60 // 2 * 2 AS VARCHAR), 2, '0') || '.00,' || CASE WHEN row_idx % 11 = 3 THEN 'V' ELSE 'A' END || ',37' || lpad(CAST(row_idx % 60 AS VARCHAR), 2, '0') || '.5000,N,12701.2500,E,' || (row_idx % 90) || '.5,10.0,180624,,' AS body FROM pt),
s1 AS (SELECT *, length(body) + 4 + row_idx * 7 % 40 + 1 AS bytes FROM s0),
s2 AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY case_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s1),
s3 AS (SELECT case_id, min(row_idx) AS row_idx, min(pos) AS pos FROM s2 WHERE row_idx % 13 <> 5 AND row_idx % 11 <> 3 GROUP BY case_id, row_idx // 2)
SELECT case_id, CAST(pos AS BIGINT) AS "at", '180624' AS gps_date, '00' || lpad(CAST(row_idx // 60 AS VARCHAR), 2, '0') || lpad(CAST(row_idx % 60 // 2 * 2 AS VARCHAR), 2, '0') || '.00' AS gps_utc_time,
 round(37 + (row_idx % 60 + 0.5e0) / 60, 6) AS latitude, round(127 + 1.25e0 / 60, 6) AS longitude, round((row_idx % 90 + 0.5e0) * 1.852e0, 6) AS speed_kmh FROM s3"""


@query(SENTENCES)
def src_nmea_carve_file(p: DataFrame) -> DataFrame:
    """GPS sentences found in the bytes of a file per case, in ranges so small that many sentences lie over a border."""
    text = F.when(F.col("row_idx") % 13 == 5, F.concat(F.lit("$"), "body", F.lit("*00"))).otherwise(BR.sentence("body"))
    lines = p.withColumn("body", F.expr(BODY)).select("case_id", F.col("row_idx").alias("line_no"), F.concat(text, F.repeat(F.lit("x"), (F.col("row_idx") * 7 % 40).cast("int"))).alias("line"))
    ranges = BR.read_members(_case_files(lines, "sentences"), range_bytes=500, overlap=BR.SENTENCE_BYTES)
    found = BR.carve_sentences(ranges)
    number = [F.round(c, 6).alias(c) for c in ("latitude", "longitude", "speed_kmh")]
    return found.select(F.regexp_extract("path", CASE_OF, 1).cast("long").alias("case_id"), "at", "gps_date", "gps_utc_time", *number)


@query("""
z0 AS (SELECT case_id, row_idx, 1 + row_idx * 13 % 50 AS x, CASE WHEN recovery_state = 'damaged' OR row_idx % 17 = 4 THEN 300 + row_idx * 37 % 500 ELSE 0 END AS z FROM pt),
z1 AS (SELECT *, coalesce(sum(x + z) OVER (PARTITION BY case_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + x AS z0 FROM z0),
z2 AS (SELECT case_id, CAST((z0 + 63) // 64 * 64 AS BIGINT) AS a, CAST((z0 + z) // 64 * 64 AS BIGINT) AS b FROM z1)
SELECT case_id, a, b FROM z2 WHERE b - a >= 256""")
def win_zero_runs(p: DataFrame) -> DataFrame:
    """Runs of zeroed blocks in the bytes of a file per case, put together over the ranges' borders (also bin_scan_damage)."""
    zeros = F.when((F.col("recovery_state") == "damaged") | (F.col("row_idx") % 17 == 4), 300 + F.col("row_idx") * 37 % 500).otherwise(0)
    # The end of the line before is the first of the other bytes.
    other = F.col("row_idx") * 13 % 50 + (F.col("row_idx") == 0).cast("long")
    piece = F.concat(F.repeat(F.lit("x"), other.cast("int")), F.repeat(F.lit("\0"), zeros.cast("int")))
    lines = p.select("case_id", F.col("row_idx").alias("line_no"), piece.alias("line"))
    runs = BR.zero_runs(BR.read_members(_case_files(lines, "zeroed"), range_bytes=1024), block=64, least=256)
    return runs.select(F.regexp_extract("path", CASE_OF, 1).cast("long").alias("case_id"), "a", "b")


# --- clocks and frames


@query(QD.REGIONS + """,
ck AS (SELECT case_id, source_offset AS pos, CAST((CAST(substr(gps_utc_time, 3, 2) AS INTEGER) * 60 + CAST(substr(gps_utc_time, 5, 2) AS INTEGER) + CASE WHEN case_id % 3 = 0 THEN 86370 ELSE 0 END) % 86400 AS DOUBLE) AS utc FROM pt WHERE gps_utc_time IS NOT NULL),
fr AS (SELECT case_id, source_offset + 5 + 30 * unnest(range(0, 20 + row_idx * 7 % 11)) AS pos FROM pt),
c1 AS (SELECT * FROM (SELECT *, lag(utc) OVER (PARTITION BY case_id ORDER BY pos) AS was FROM ck) WHERE was IS NULL OR was <> utc),
c2 AS (SELECT *, lead(pos) OVER w AS at2, (lead(utc) OVER w - utc + 86400) % 86400 AS step FROM c1 WINDOW w AS (PARTITION BY case_id ORDER BY pos)),
c3 AS (SELECT case_id, pos, at2, step FROM c2 WHERE step > 0 AND step <= 5 AND NOT EXISTS (SELECT 1 FROM rg WHERE rg.case_id = c2.case_id AND rg.a >= c2.pos AND rg.a < c2.at2)),
c4 AS (SELECT c3.case_id, c3.pos, any_value(step) AS step, count(fr.pos) AS n FROM c3 LEFT JOIN fr ON fr.case_id = c3.case_id AND fr.pos >= c3.pos AND fr.pos < c3.at2 GROUP BY c3.case_id, c3.pos),
c5 AS (SELECT case_id, sum(n) AS frames, sum(step) AS seconds FROM c4 GROUP BY case_id),
sp AS (SELECT case_id, arg_max(utc, pos) - arg_min(utc, pos) AS s FROM c1 GROUP BY case_id)
SELECT sp.case_id, CASE WHEN s < 0 THEN s + 86400 ELSE s END AS span_sec, CAST(coalesce(frames, 0) AS BIGINT) AS frames, coalesce(seconds, 0e0) AS seconds, CASE WHEN seconds >= 5 AND frames > 0 THEN round(frames / seconds, 9) END AS fps FROM sp LEFT JOIN c5 ON sp.case_id = c5.case_id""")
def win_fps_evidence(p: DataFrame) -> DataFrame:
    """Frames between clock readings that pass midnight in a third of the cases (also win_midnight_wrap)."""
    clock = F.expr("(cast(substr(gps_utc_time, 3, 2) as int) * 60 + cast(substr(gps_utc_time, 5, 2) as int) + if(case_id % 3 = 0, 86370, 0)) % 86400")
    clocks = p.filter("gps_utc_time is not null").select("case_id", F.col("source_offset").alias("at"), clock.alias("utc"))
    return ST.clock_rates(clocks, _frames(p), QD.regions(p).select("case_id", F.col("a").alias("at"))).withColumn("fps", F.round("fps", 9))


def _frames(p: DataFrame) -> DataFrame:
    """20 to 30 frames after each record."""
    return p.select("case_id", F.explode(F.transform(F.sequence(F.lit(0), 19 + F.col("row_idx") * 7 % 11), lambda i: F.col("source_offset") + 5 + 30 * i)).alias("at"))


# --- tables of a video file


ORDERED = "SELECT o_custkey AS t, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS c FROM orders"


def _ordered(o: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("k"), n.alias("c"))


@query(f"""WITH o AS ({ORDERED}), pc AS (SELECT t, c, 1 + k % 4 AS n FROM o WHERE c % 3 = 1),
ch AS (SELECT o.t, o.c, k * 10000 AS off, pc.n FROM o ASOF JOIN pc ON o.t = pc.t AND o.c >= pc.c),
cf AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY t ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ch),
sm AS (SELECT t, c, off, before + unnest(range(1, n + 1)) AS s FROM cf), sz AS (SELECT *, 100 + (s * 7 + t) % 50 AS size FROM sm),
so AS (SELECT *, off + coalesce(sum(size) OVER (PARTITION BY t, c ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM sz),
du AS (SELECT t, unnest(list_transform(range(0, 1 + k % 3), lambda i: 10 + k % 7)) AS d, c FROM o), dn AS (SELECT t, d, row_number() OVER (PARTITION BY t ORDER BY c) AS s FROM du),
dt AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY t ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dts FROM dn),
cn AS (SELECT t, sh, row_number() OVER (PARTITION BY t ORDER BY c) AS s FROM (SELECT t, c, unnest(list_transform(range(0, 2), lambda i: k % 5)) AS sh FROM o WHERE c % 2 = 1))
SELECT so.t AS track_id, CAST(so.s AS BIGINT) AS sample_no, so.c AS chunk_no, CAST(so.pos AS BIGINT) AS "offset", CAST(size AS BIGINT) AS size, CAST(dts AS BIGINT) AS dts, CAST(dts + coalesce(sh, 0) AS BIGINT) AS pts
FROM so LEFT JOIN dt ON dt.t = so.t AND dt.s = so.s LEFT JOIN cn ON cn.t = so.t AND cn.s = so.s""", "orders")
def bin_mp4_track(o: DataFrame) -> DataFrame:
    """Sample tables of customers' tracks: an order is a chunk and a run of durations, every third begins another number of samples."""
    rows = _ordered(o)
    chunks = rows.select("track_id", F.col("c").cast("long").alias("chunk_no"), (F.col("k") * 10000).alias("offset"))
    per_chunk = rows.filter("c % 3 = 1").select("track_id", F.col("c").cast("long").alias("first_chunk"), (1 + F.col("k") % 4).alias("n"))
    durations = rows.select("track_id", F.col("c").alias("run_no"), (1 + F.col("k") % 3).alias("n"), (10 + F.col("k") % 7).alias("delta"))
    shifts = rows.filter("c % 2 = 1").select("track_id", F.col("c").alias("run_no"), F.lit(2).cast("long").alias("n"), (F.col("k") % 5).alias("shift"))
    most = rows.groupBy("track_id").agg((F.max("c") * 4).alias("n"))
    sizes = most.select("track_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("sample_no"))
    sizes = sizes.withColumn("size", 100 + (F.col("sample_no") * 7 + F.col("track_id")) % 50)
    return ST.samples(chunks, per_chunk, durations, shifts, sizes)


FRAGMENTS = f"""WITH o AS ({ORDERED}),
mo AS (SELECT t, k, c, c * 100000 AS pos, CASE WHEN k % 29 = 0 THEN NULL WHEN k % 23 = 0 THEN 1 WHEN k % 31 = 0 THEN c + 1 ELSE c END AS seq, k % 3 <> 0 AS intact, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 37 = 0 THEN 5 ELSE c * 1000 END AS base FROM o),
pa AS (SELECT t, k, c, pos, base, r, i, 50 + i * 3 AS size, 10 + i AS dur FROM (SELECT *, unnest(range(0, 1 + k % 4)) AS i FROM (SELECT *, unnest([1, 2]) AS r FROM mo))),
ru AS (SELECT t, k, c, pos, base, r, sum(size) AS bytes, sum(dur) AS ticks FROM pa GROUP BY ALL),
rb AS (SELECT *, CASE WHEN r = 1 THEN pos + 100 WHEN k % 2 = 0 THEN pos + 5000 ELSE pos + 100 + lag(bytes) OVER (PARTITION BY t, c ORDER BY r) END AS beg, CASE WHEN r = 1 THEN 0 ELSE lag(ticks) OVER (PARTITION BY t, c ORDER BY r) END AS tk FROM ru),
en AS (SELECT t, c, any_value(base) AS base, any_value(base) + sum(ticks) AS fin FROM ru GROUP BY t, c),
sq AS (SELECT *, last_value(seq IGNORE NULLS) OVER (PARTITION BY t ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM mo),
fi AS (SELECT t, arg_min(seq = was, c) AS idle FROM sq WHERE seq IS NOT NULL AND was IS NOT NULL GROUP BY t),
bk AS (SELECT sq.t, sq.c, sq.pos, 'sequence' AS reason FROM sq LEFT JOIN fi ON sq.t = fi.t WHERE NOT coalesce(idle, false) AND (seq <= was OR (intact AND seq <> was + 1))
 UNION ALL SELECT t, c, c * 100000, 'clock' FROM (SELECT *, last_value(CASE WHEN base IS NOT NULL THEN fin END IGNORE NULLS) OVER (PARTITION BY t ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM en) WHERE base < pe - 500),
le AS (SELECT t, min(pos) AS end_at, arg_min(reason, struct_pack(c := c, x := reason = 'clock')) AS reason FROM bk GROUP BY t)
"""


def _fragments(o: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = _ordered(o).withColumnRenamed("track_id", "file_id").withColumn("moof_no", F.col("c").cast("long"))
    sequence = F.expr("case when k % 29 = 0 then null when k % 23 = 0 then 1 when k % 31 = 0 then moof_no + 1 else moof_no end")
    fragments = rows.select("file_id", "moof_no", (F.col("moof_no") * 100000).alias("moof_at"), sequence.alias("sequence"), (F.col("k") % 3 != 0).alias("intact"))
    tracks = rows.select("file_id", "moof_no", F.lit(1).alias("track_id"), F.expr("case when k % 7 = 0 then null when k % 37 = 0 then 5 else moof_no * 1000 end").alias("base_time"), F.lit(1000).alias("timescale"))
    each = rows.withColumn("run_no", F.explode(F.array(F.lit(1), F.lit(2))))
    runs = each.select("file_id", "moof_no", F.lit(1).alias("track_id"), "run_no", F.expr("case when run_no = 1 then 100 when k % 2 = 0 then 5000 end").cast("long").alias("data_offset"))
    parts = each.select("file_id", "moof_no", "run_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") % 4)).alias("i"))
    parts = parts.withColumns({"size": 50 + F.col("i") * 3, "duration": 10 + F.col("i")})
    media = rows.select("file_id", (F.col("moof_no") * 100000 + 100).alias("a"), (F.col("moof_no") * 100000 + 5080).alias("b"))
    return ST.fragment_samples(fragments, tracks, runs, parts, media)


@query(FRAGMENTS + """, al AS (SELECT pa.t, pa.c, pa.r, pa.i, beg + coalesce(sum(size) OVER w, 0) AS pos, size, pa.base + tk + coalesce(sum(dur) OVER w, 0) AS dts, pa.pos AS moof_at FROM pa JOIN rb ON pa.t = rb.t AND pa.c = rb.c AND pa.r = rb.r
 WINDOW w AS (PARTITION BY pa.t, pa.c, pa.r ORDER BY pa.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT al.t AS file_id, c AS moof_no, 1 AS track_id, r AS run_no, i, CAST(pos AS BIGINT) AS "offset", size, CAST(dts AS BIGINT) AS dts, pos + size <= moof_at + 5080 AND (end_at IS NULL OR moof_at < end_at) AS kept FROM al LEFT JOIN le ON al.t = le.t""", "orders")
def bin_mp4_fragments(o: DataFrame) -> DataFrame:
    """Samples of customers' fragmented files, an order a fragment of two runs."""
    return _fragments(o)[0]


@query(FRAGMENTS + "SELECT t AS file_id, CAST(end_at AS BIGINT) AS end_at, reason FROM le", "orders")
def bin_mp4_recording_end(o: DataFrame) -> DataFrame:
    """Where an older recording's fragments begin, by their numbers or clock."""
    return _fragments(o)[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return Q


def oracle_sql() -> dict[str, str]:
    return O
