"""Case management: status of runs, manifests, history tables, duplicates by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import strip

#: Statuses from worst to best.
STATUS_ORDER = ("timed_out", "engine_failed", "unsupported", "gps_untrusted", "no_gps", "unknown")
MAX_DURATION_SEC = 7 * 86_400
#: Forms of the lines with which extraction says that it broke off.
FAILURE_LINES = (
    r"^(?:AVI|MP4) \d+개 -> (?:예외: |integration_\w+\.py가 종료 코드 )",
    r"^\[WARN\] (?:[^:\n]{1,200}: )?(?:예외 발생으로 처리 중단: |처리 중단 \(종료 코드 )",
    r"^SKIP \S.*?(?:\sexception: |처리 실패\()",
    r"^FAIL \S.*?(?:\s예외: |\s처리 중단 \()",
    r"이 파일은 처리할 수 없습니다\.$",
)


def status_outcome() -> Column:
    """Outcome of an extraction from its facts: timed_out, exit_code, failure_line, fixes, coords, out_of_range, false_flags, ran, no_gps_marker."""
    return (
        F.when(F.col("timed_out"), "timed_out").when(F.col("exit_code") != 0, "engine_failed")
        .when(F.col("failure_line").isNotNull(), "engine_failed").when(F.col("fixes") > 0, "ok").when(F.col("out_of_range") > 0, "engine_failed")
        .when((F.col("coords") > 0) | F.col("false_flags"), "gps_untrusted").when(F.col("ran") | F.col("no_gps_marker"), "no_gps").otherwise("engine_failed")
    )


def worst_status(rows: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """The worst status of each group; ok only where all are, unlisted ones after the listed."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col(status))
    rank = F.when(F.col(status) == "ok", len(STATUS_ORDER) + 2).when(place == 0, len(STATUS_ORDER) + 1).otherwise(place)
    return rows.groupBy(*keys).agg(F.min_by(status, F.struct(rank, F.col(status))).alias("worst"))


def reopen_status(db: Column, stored: Column, artifacts: Column) -> Column:
    """Status of a reopened case: the database's, else the file's; unknown without artefacts; an unfinished run has failed."""
    status = F.coalesce(F.nullif(db, F.lit("")), F.nullif(stored, F.lit("")))
    return F.when(~artifacts, "unknown").when(status == "analyzing", "engine_failed").otherwise(F.coalesce(status, F.lit("unknown")))


def effective_duration(header: Column, measured: Column, container: Column) -> Column:
    """AVI headers give way to a measured length that is plausible and half a second off."""
    better = (container == "avi") & (measured > 0) & (measured <= MAX_DURATION_SEC) & (F.abs(measured - header) > 0.5)
    return F.when(better, measured).otherwise(header)


def plausible_duration(d: Column) -> Column:
    return F.when((d > 0) & (d <= MAX_DURATION_SEC), d)


def failure_lines(lines: DataFrame) -> DataFrame:
    """First line of each run that reports a failure; lines(run_id, line_no, line)."""
    text = strip("line")
    found = lines.filter(text.rlike("|".join(f"(?:{p})" for p in FAILURE_LINES)))
    return found.groupBy("run_id").agg(F.min_by(F.substring(text, 1, 300), "line_no").alias("failure_line"))


def warnings_shown(lines: DataFrame, most: int = 300, width: int = 500) -> DataFrame:
    """The first ``most`` non-blank lines of a run, cut to ``width``, and how many more there are."""
    rows = lines.filter(strip("line") != "").withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("line_no")))
    shown = rows.filter(F.col("n") <= most).select("run_id", "n", F.substring("line", 1, width).alias("line"))
    more = rows.groupBy("run_id").agg((F.count("*") - most).alias("k")).filter("k > 0")
    return shown.unionByName(more.select("run_id", F.lit(most + 1).alias("n"), F.concat(F.lit("+"), F.col("k").cast("string"), F.lit(" more")).alias("line")))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Per case: whether every listed file is there unchanged and no other is; with counts of each fault."""
    m = manifest.select("case_id", "path", F.col("sha256").alias("want"))
    f = files.select("case_id", "path", F.col("sha256").alias("got"))
    met = m.join(f, ["case_id", "path"], "full_outer")
    out = met.groupBy("case_id").agg(
        F.count_if(F.col("got").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("unlisted"), F.count_if(F.col("want") != F.col("got")).alias("changed")
    )
    return out.withColumn("intact", (F.col("missing") == 0) & (F.col("unlisted") == 0) & (F.col("changed") == 0))


def same_content(cases: DataFrame, key: str = "sha256") -> DataFrame:
    """Cases that share their content with an earlier one: (case_id, first_case, n_same)."""
    by = cases.groupBy(key).agg(F.min("case_id").alias("first_case"), F.count("*").alias("n_same")).filter("n_same > 1")
    return cases.join(by, key).select("case_id", "first_case", "n_same")


def latest_rows(history: DataFrame, key: str, order: list[str], deleted: str = "deleted") -> DataFrame:
    """Upserts and deletions replayed: the latest row of each key that is not deleted."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return history.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) & ~F.col(deleted)).drop("_n", deleted)
