"""Cases kept and opened again: carved GPS adopted where it is better, artefacts stored, damage replayed from its stored report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..sources import documents
from ..sources import rows as R
from ..sources.shared import checkpointed
from . import cases, damage, events, outliers
from .times import estimate_times

REGION = "array<struct<a:bigint,b:bigint,kind:string>>"


def promote_carved(engine: DataFrame, carved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, slack, outcomes): per case the engine's rows, or carved ones where they have more fixes than it found.

    Carved rows have a place and a clock but no playback time; they get one from
    the clock, and what belongs to another recording goes to the slack. They replace
    the engine's rows only where there are more of them than fixes, so ties keep the
    engine's. Both sides are read once and counted in one window over the case.
    """
    bare = carved.filter(P.has_coords() & P.filled("gps_utc_time")).withColumns({"start_time_sec": F.lit(None).cast("double"), "end_time_sec": F.lit(None).cast("double")})
    timed = estimate_times(bare)
    both = engine.withColumns({"_carved": F.lit(False), "excluded": F.lit(False)}).unionByName(timed.withColumn("_carved", F.lit(True)), allowMissingColumns=True)
    case = Window.partitionBy("case_id")
    count = {
        "n_engine": F.count_if(~F.col("_carved")), "n_fixes": F.count_if(~F.col("_carved") & P.has_fix()), "n_placed": F.count_if(F.col("_carved") & F.col("start_time_sec").isNotNull()),
        "n_carved": F.count_if(F.col("_carved") & ~F.col("excluded")),
    }
    both = both.withColumns({k: c.over(case) for k, c in count.items()})
    better = (F.col("n_placed") > 0) & ((F.col("n_engine") == 0) | (F.col("n_carved") > F.col("n_fixes")))
    both = checkpointed(both.withColumn("_adopted", better))
    chosen = both.filter((F.col("_carved") == F.col("_adopted")) & ~F.col("excluded"))
    slack = both.filter(F.col("_adopted") & F.col("excluded"))
    rows = F.count_if((F.col("_carved") == F.col("_adopted")) & ~F.col("excluded"))
    outcomes = both.groupBy("case_id").agg(F.first("_adopted").alias("adopted"), F.first("n_engine").alias("n_engine"), rows.alias("n_rows"), F.count_if(F.col("_adopted") & F.col("excluded")).alias("n_slack"))
    outcome = F.when(~F.col("adopted"), "engine").when(F.col("n_engine") == 0, "carved").otherwise("carved_over_engine")
    extra = ("_carved", "_adopted", "excluded", *count)
    return chosen.drop(*extra), slack.drop(*extra), outcomes.select("case_id", outcome.alias("outcome"), "n_rows", "n_slack")


def report_of(regions: DataFrame, durations: DataFrame, mode: str, shift: int = 0) -> DataFrame:
    """(case_id, damage): what a later replay needs, as JSON: regions of the file, how far its media was moved, mode and length."""
    lists = regions.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "kind"))).alias("regions"))
    made = durations.join(lists, "case_id").select("case_id", F.to_json(F.struct("regions", F.lit(shift).alias("offset_shift"), F.lit(mode).alias("mode"), "duration_sec", "truncated")).alias("damage"))
    return made


def apply_report(points: DataFrame, reports: DataFrame) -> DataFrame:
    """Damage of stored reports(case_id, damage) put on tracks: the same regions, shift, mode and length give the same rows every time.

    Rows that an earlier replay made are dropped first, so a second replay changes nothing.
    """
    parsed = F.from_json("damage", f"regions {REGION}, offset_shift bigint, mode string, duration_sec double, truncated boolean")
    read = checkpointed(reports.select("case_id", parsed.alias("r")).select("case_id", "r.*"))
    move = F.coalesce("offset_shift", F.lit(0))
    regions = read.select("case_id", move.alias("s"), F.inline("regions")).select("case_id", (F.col("a") + F.col("s")).alias("a"), (F.col("b") + F.col("s")).alias("b"), "kind")
    lengths = read.select("case_id", "duration_sec", F.coalesce("truncated", F.lit(False)).alias("truncated"))
    real = points.filter(~P.is_synthetic())
    lost = damage.intervals(real, checkpointed(regions), lengths)
    made = damage.synthetic_rows(real, lost, read.filter("mode = 'interpolate'"), None)
    return damage.in_one_track(real, made)


def store(points: DataFrame, metadata: DataFrame, path: str) -> None:
    """Keeps what was extracted (never the rows made for lost seconds) as timelines, and a document per case."""
    R.write_timeline(points.filter(~P.is_synthetic()), f"{path}/engine_output")
    documents.commit(metadata, f"{path}/documents")


def reopen(case_rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, events, cases) of stored cases(case_id, analysis_status, damage) without extracting anything again.

    Outliers are marked anew, damage comes from the document, else from the
    history's copy, and events are detected on the result. Status: the history's, else
    the document's; without artefacts it is unknown, and an unfinished one has failed.
    """
    spark = case_rows.sparkSession
    stored = R.load_timeline(spark, f"{path}/engine_output").withColumn("case_id", F.col("case_id").cast(case_rows.schema["case_id"].dataType))
    order = Window.partitionBy("case_id").orderBy(F.col("start_time_sec").isNull(), "start_time_sec", "file_row")
    track = stored.join(case_rows.select("case_id"), "case_id", "left_semi").withColumn("row_idx", F.row_number().over(order).cast("long") - 1)
    track = track.withColumns({"t_us": F.round(F.col("start_time_sec") * 1_000_000).cast("long"), "segment_index": F.lit(0)}).drop("source_file", "file_row")
    marked = checkpointed(outliers.mark_outliers(track))
    read = documents.read(case_rows, f"{path}/documents").join(case_rows, "case_id")
    own = documents.field(F.col("document"), "damage", "string")
    source = F.when(own.isNotNull(), "document").when(F.col("damage").isNotNull(), "history").otherwise("none")
    read = read.withColumns({"source": source, "damage": F.coalesce(own, "damage"), "stored_status": documents.field(F.col("document"), "status")})
    read = checkpointed(read.join(marked.select("case_id").distinct().withColumn("present", F.lit(True)), "case_id", "left"))
    hurt = read.filter("damage is not null")
    whole = checkpointed(apply_report(marked, hurt.select("case_id", "damage")))
    found = events.detect(whole)
    status = cases.reopen_status(F.col("analysis_status"), F.col("stored_status"), F.coalesce("present", F.lit(False)))
    return whole, found, read.select("case_id", status.alias("status"), "outcome", F.col("source").alias("damage_source"))


def artifacts_present(files: DataFrame) -> DataFrame:
    """(case_id, present, avi_repaired) of files(case_id, path): any file at all, and whether one is an AVI without its slack."""
    listed = F.coalesce(F.col("path"), F.lit("")) != ""
    return files.groupBy("case_id").agg((F.count_if(listed) > 0).alias("present"), F.coalesce(F.bool_or(F.lower("path").endswith("_wo_slack.avi")), F.lit(False)).alias("avi_repaired"))


def may_delete(folder: Column, root: Column, case_id: Column) -> Column:
    """Whether a case's folder may be removed: right below the root, named by its case, and no way out of it."""
    below = F.regexp_replace(root, "/+$", "")
    name = F.regexp_extract(folder, r"([^/]+)/*$", 1)
    direct = F.regexp_replace(folder, "/+$", "") == F.concat(below, F.lit("/"), name)
    return F.coalesce(direct & ~name.isin(".", "..") & name.endswith(F.concat(F.lit("_"), case_id.cast("string"))), F.lit(False))
