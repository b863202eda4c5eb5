"""Case history as a log of changes, and the tables that come of it.

A change is (case_id, version, change, fields): ``insert`` begins a case anew,
``update`` sets the fields it names (a name with a null sets null), ``delete`` ends
it. Versions are unique within a case. State is never written in place: it is
what replaying the log gives, so a late or repeated batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import strip

#: Columns of a case and what stands for a missing one; those with a JSON kind hold documents.
TEXTS = ("case_number", "examiner", "memo", "output_folder", "rear_video_filename", "track_mode", "analysis_status", "manifest_sha256")
DOCUMENTS = {"settings": "OBJECT", "segments": "ARRAY", "damage": "OBJECT"}
EMPTY = {"settings": "{}", "segments": "[]", "damage": None}
CHANGE = "case_id bigint, version bigint, change string, fields map<string,string>"


def document(text: Column, kind: str, empty: str | None) -> Column:
    """JSON text of the right kind, rewritten; ``empty`` where it is missing, damaged or of another kind."""
    parsed = F.try_parse_json(F.nullif(strip(text), F.lit("")))
    right = F.schema_of_variant(parsed).startswith(kind)
    good = F.when(right, F.to_json(parsed))
    if empty is None:
        good = F.when(good != "{}", good)
    return F.coalesce(good, F.lit(empty).cast("string"))


def append_changes(changes: DataFrame, path: str) -> None:
    """Adds a batch to the log; parts appear when the batch is committed."""
    changes.selectExpr("cast(case_id as bigint) AS case_id", "cast(version as bigint) AS version", "change", "fields").write.mode("append").parquet(path)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGE).parquet(path)


def replay(changes: DataFrame) -> DataFrame:
    """The cases that are there, with the latest value of every field since their last insert.

    One shuffle by case: lives are found in a window, values are aggregated under the same key.
    """
    case = Window.partitionBy("case_id")
    rows = changes.dropDuplicates(["case_id", "version"])
    rows = rows.withColumn("_born", F.max(F.when(F.col("change") == "insert", F.col("version"))).over(case))
    rows = rows.withColumn("_gone", F.max(F.when(F.col("change") == "delete", F.col("version"))).over(case))
    alive = rows.filter((F.col("_born") > F.coalesce("_gone", F.lit(-1))) & (F.col("version") >= F.col("_born")))

    def latest(name: str) -> Column:
        named = F.map_contains_key("fields", name)
        return F.max_by(F.col("fields")[name], F.when(named, F.col("version")))

    state = alive.groupBy("case_id").agg(F.max("version").alias("version"), *[latest(n).alias(n) for n in (*TEXTS, *DOCUMENTS)])
    return tolerant(state)


def tolerant(rows: DataFrame) -> DataFrame:
    """Stored cases of any age: columns that a table does not have yet are empty, and a damaged document costs that document alone."""

    def cell(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    texts = [F.coalesce(cell(n), F.lit("")).alias(n) for n in TEXTS]
    return rows.select("case_id", "version", *texts, *[document(cell(n), k, EMPTY[n]).alias(n) for n, k in DOCUMENTS.items()])


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of the case table, whatever columns they were written with; the latest version of each case."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    w = Window.partitionBy("case_id").orderBy(F.desc("version"))
    return tolerant(rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1"))


def engine_runs(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """An audit row and the log's text for every run.

    runs(case_id, run_id, argv, exit_code, note, output_dir, started_at, finished_at) and their output lines(run_id, stream, line_no, line).
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    per = lines.groupBy("run_id").pivot("stream", ["stdout", "stderr"]).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"))
    met = runs.join(per, "run_id", "left")
    argv = F.array_join("argv", " ")
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("NOTE: "), "note", F.lit("\n"))).otherwise("")
    log = F.concat(
        F.lit("ARGV: "), argv, F.lit("\n"), note, F.lit("EXIT: "), F.col("exit_code").cast("string"), F.lit("\n\n--- stdout ---\n"), F.coalesce("stdout", F.lit("")),
        F.lit("\n--- stderr ---\n"), F.coalesce("stderr", F.lit("")),
    )
    place = F.concat("output_dir", F.lit("/_run_"), F.date_format("started_at", "HHmmssSSSSSS"), F.lit(".log"))
    second = "yyyy-MM-dd'T'HH:mm:ss"
    return met.select(
        "case_id", "run_id", F.lit("extraction").alias("script_name"), F.to_json("argv").alias("argv_json"), "exit_code", place.alias("stdout_log_path"),
        F.date_format("started_at", second).alias("started_at"), F.date_format("finished_at", second).alias("finished_at"), log.alias("log"),
    )
