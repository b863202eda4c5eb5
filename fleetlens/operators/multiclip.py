"""Several clips as one recording: which rear belongs to which front, whether the clips follow each other, and the whole they make.

A job is one choice of clips; ``probes`` has a row for each: job_id, clip_id, side
(front or rear), ord (its place in the choice), name, gps_start and name_start
(seconds since 1970), duration, the first and last fix (first_t, first_lat,
first_lon, last_t, ...), max_kmh, sha256, the parts of the signature, and error
where the file could not be read. Everything is keyed by job: no table of a job's
pairs is made, candidates come from equal names and from buckets of start times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, texts
from ..functions import predicates as P
from ..functions import times as TM
from ..sources import documents
from ..sources import rows as R
from ..sources.shared import checkpointed
from . import cases, events, linkage, matching, outliers, pairs, report
from .sequence import distinct_fixes

START_FIXES = 7
POSITION_SLACK_M = 50.0
MIN_REACH_KMH = 10.0


def clocked(points: DataFrame) -> DataFrame:
    """``points`` with ``_clock``, seconds since 1970 by the GPS; a table that is written with it reads the texts once."""
    if "_clock" in points.columns:
        return points
    return points.withColumn("_clock", TM.date_days(F.col("gps_date")) * TM.DAY + TM.utc_seconds(F.col("gps_utc_time")))


def clip_starts(points: DataFrame) -> DataFrame:
    """(clip_id, gps_start): upper median of clock minus playback time over the first seven different records of a clip with a fix."""
    rows = clocked(points).filter(P.has_fix() & P.not_false("gps_checksum_ok") & F.col("start_time_sec").isNotNull() & F.col("_clock").isNotNull())
    first = rows.groupBy("clip_id", "_clock").agg(F.min(F.struct("row_idx", (F.col("_clock") - F.col("start_time_sec")).alias("off"))).alias("r"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("clip_id").orderBy("r.row_idx"))).filter(F.col("n") <= START_FIXES)
    by = first.groupBy("clip_id").agg(F.array_sort(F.collect_list("r.off")).alias("o"))
    return by.select("clip_id", F.element_at("o", (F.floor(F.size("o") / 2) + 1).cast("int")).alias("gps_start"))


def probe_clips(clips: DataFrame, points: DataFrame) -> DataFrame:
    """``clips`` (job_id, clip_id, side, ord, name, duration, signature, error) with what their tracks (keyed by clip_id) say of start, ends and speed."""
    usable = distinct_fixes(points.withColumn("case_id", F.col("clip_id")))
    unit = F.struct("row_idx", "start_time_sec", "latitude", "longitude")
    ends = usable.groupBy("clip_id").agg(F.min(unit).alias("first"), F.max(unit).alias("last"), F.max("speed_kmh").alias("max_kmh"))
    names = (("start_time_sec", "t"), ("latitude", "lat"), ("longitude", "lon"))
    ends = ends.select("clip_id", *[F.col(f"{e}.{c}").alias(f"{e}_{s}") for e in ("first", "last") for c, s in names], "max_kmh")
    out = clips.join(clip_starts(points), "clip_id", "left").join(ends, "clip_id", "left")
    at = F.unix_micros(F.to_timestamp(TM.filename_timestamp(F.col("name")))) / 1e6
    return out.withColumn("name_start", at).withColumn("max_kmh", F.coalesce("max_kmh", F.lit(0.0)))


def candidates(probes: DataFrame, tolerance: float = linkage.MAX_START_OFFSET_SEC) -> DataFrame:
    """(job_id, front_id, rear_id): rears that by their name belong to a front, or start within ``tolerance`` seconds of it by either clock."""
    fronts, rears = probes.filter("side = 'front'"), probes.filter("side = 'rear' and error is null")
    by_name = fronts.select("job_id", F.col("clip_id").alias("front_id"), F.explode(texts.rear_candidates(F.col("name"))).alias("name")).withColumn("name", F.lower("name"))
    found = by_name.join(rears.select("job_id", F.col("clip_id").alias("rear_id"), F.lower("name").alias("name")), ["job_id", "name"]).select("job_id", "front_id", "rear_id")
    for clock in ("gps_start", "name_start"):
        f, r = (side.filter(F.col(clock).isNotNull()).select("job_id", F.col("clip_id"), F.col(clock).alias("start")) for side in (fronts, rears))
        found = found.unionByName(linkage.rear_by_time(f, r, tolerance, ["job_id"]).select("job_id", "front_id", "rear_id"))
    return found.distinct()


def checked(found: DataFrame, probes: DataFrame, points: DataFrame) -> DataFrame:
    """Candidates with ``problems``: differences of the files and devices, and of the GPS records at equal clock times."""
    side = F.struct(
        F.col("name").alias("path"), "sha256", F.timestamp_seconds("name_start").alias("name_time"), "duration", F.lit(None).cast("timestamp").alias("recorded_at"), *pairs.SIGNATURE
    )
    one = probes.select("job_id", "clip_id", "ord", F.coalesce("gps_start", "name_start", F.lit(0.0)).alias("at"), side.alias("side"))
    rows = found
    for p in ("front", "rear"):
        rows = rows.join(one.select("job_id", F.col("clip_id").alias(f"{p}_id"), F.col("ord").alias(f"{p}_ord"), F.col("at").alias(f"{p}_at"), F.col("side").alias(p)), ["job_id", f"{p}_id"])
    rows = rows.withColumn("pair_id", F.struct("job_id", "front_id", "rear_id"))
    files = pairs.compare_pairs(rows).select("pair_id", "problems")
    track = clocked(points).withColumnRenamed("_clock", "clock")
    members = [track.join(rows.select("pair_id", F.col(f"{p}_id").alias("clip_id")), "clip_id") for p in ("front", "rear")]
    by_gps = linkage.pair_gps(*members, "clock").select("pair_id", F.when(F.col("verdict") != "ok", F.col("verdict")).alias("gps"))
    out = rows.join(files, "pair_id").join(by_gps, "pair_id", "left")
    same = F.array_contains("problems", "same_file") | F.array_contains("problems", "same_content")
    problems = F.when(same, F.col("problems")).otherwise(F.array_compact(F.concat("problems", F.array("gps"))))
    return out.select("job_id", "front_id", "rear_id", "front_ord", "rear_ord", "front_at", "rear_at", problems.alias("problems"))


def paired(judged: DataFrame) -> DataFrame:
    """(job_id, front_id, rear_id): each rear in its order takes the first front in order that is free and has no problem with it."""
    fits = judged.filter(F.size("problems") == 0).withColumn("left_at", F.col("front_at")).withColumn("right_at", F.col("rear_at"))
    return matching.greedy(fits, ["job_id"], "front_id", "rear_id", ["rear_ord", "front_ord"])


def slots_of(probes: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slots (job_id, front_id, rear_id, clip_id of the leading clip, ord) and pairing problems (job_id, clip_id, code, detail).

    A rear whose candidates that were still free all differ from it is a problem; one without candidates has a slot of its own.
    """
    taken = checkpointed(paired(judged))
    by_front = taken.select("job_id", "front_id", F.col("rear_ord").alias("_when"))
    left = judged.join(taken.select("job_id", "rear_id"), ["job_id", "rear_id"], "left_anti").join(by_front, ["job_id", "front_id"], "left")
    failed = left.filter(F.col("_when").isNull() | (F.col("_when") > F.col("rear_ord"))).groupBy("job_id", "rear_id").agg(F.min_by(F.array_join("problems", ","), "front_ord").alias("detail"))
    failed = checkpointed(failed)
    rears = probes.filter("side = 'rear'")
    unreadable = rears.filter("error is not null").select("job_id", "clip_id", F.lit("unreadable").alias("code"), F.col("error").alias("detail"))
    problems = unreadable.unionByName(failed.select("job_id", F.col("rear_id").alias("clip_id"), F.lit("pair_differs").alias("code"), "detail"))
    fronts = probes.filter("side = 'front'").join(taken.select("job_id", F.col("front_id").alias("clip_id"), "rear_id"), ["job_id", "clip_id"], "left")
    slots = fronts.select("job_id", F.col("clip_id").alias("front_id"), "rear_id", "clip_id", F.struct(F.lit(0).alias("s"), "ord").alias("ord"))
    settled = taken.select("job_id", F.col("rear_id").alias("clip_id")).unionByName(problems.select("job_id", "clip_id"))
    alone = rears.join(settled, ["job_id", "clip_id"], "left_anti")
    none = F.lit(None).cast(probes.schema["clip_id"].dataType)
    return slots.unionByName(alone.select("job_id", none.alias("front_id"), F.col("clip_id").alias("rear_id"), "clip_id", F.struct(F.lit(1).alias("s"), "ord").alias("ord"))), problems


def _steps(leading: DataFrame) -> DataFrame:
    """Each clip of a job against the next one in time: problems (job_id, clip_id, code, detail)."""
    w = Window.partitionBy("job_id").orderBy("place")
    b = {c: F.lead(c).over(w) for c in ("clip_id", "start", "first_t", "first_lat", "first_lon", "max_kmh")}
    rows = leading.select("*", *[c.alias(f"n_{k}") for k, c in b.items()]).filter("n_clip_id is not null")
    gap = F.col("n_start") - F.col("start") - F.col("duration")
    apart = F.greatest(F.lit(1.0), F.abs(F.col("n_start") + F.col("n_first_t") - F.col("start") - F.col("last_t")))
    reach = F.greatest("max_kmh", "n_max_kmh", F.lit(MIN_REACH_KMH)) / 3.6 * apart + POSITION_SLACK_M
    metres = geo.haversine_m(F.col("last_lat"), F.col("last_lon"), F.col("n_first_lat"), F.col("n_first_lon"))
    code = (
        F.when(F.col("duration").isNull(), "no_duration").when(gap > linkage.MAX_CHAIN_GAP_SEC, "gap").when(gap < -linkage.MAX_CHAIN_GAP_SEC, "overlap")
        .when(metres.isNull(), "no_coordinates").when(metres > reach, "too_far")
    )
    return rows.withColumn("code", code).filter("code is not null").select("job_id", "clip_id", "code", F.lit("").alias("detail"))


def plan(probes: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slots in order (job_id, slot_no, front_id, rear_id, clip_id, basis, combined) and every problem of a job.

    A job is combined if nothing speaks against it. With a pairing problem, an
    unreadable clip or no common clock its slots stay in the order of choice.
    """
    slots, problems = slots_of(probes, judged)
    slots = checkpointed(slots)
    lead_names = ("clip_id", "name", "error", "gps_start", "name_start", "duration", "first_t", "first_lat", "first_lon", "last_t", "last_lat", "last_lon", "max_kmh", *pairs.SIGNATURE)
    leading = slots.join(probes.select("job_id", *lead_names), ["job_id", "clip_id"])
    blocked = problems.select("job_id").distinct()
    open_ = leading.join(blocked, "job_id", "left_anti")
    unreadable = open_.filter("error is not null").select("job_id", "clip_id", F.lit("unreadable").alias("code"), F.col("error").alias("detail"))
    open_ = checkpointed(open_.join(unreadable.select("job_id").distinct(), "job_id", "left_anti"))
    w = Window.partitionBy("job_id")
    again = open_.withColumn("_n", F.row_number().over(Window.partitionBy("job_id", "name").orderBy("ord"))).filter("_n > 1")
    again = again.select("job_id", "clip_id", F.lit("same_file").alias("code"), F.lit("").alias("detail"))

    based = pairs.choose_basis(open_.withColumnRenamed("job_id", "case_id")).withColumnRenamed("case_id", "job_id")
    lost = based.filter("basis = 'none'")
    bare = lost.filter("gps_start is null and name_start is null").select("job_id", "clip_id", F.lit("no_clock").alias("code"), F.lit("").alias("detail"))
    doubled = lost.join(again.select("job_id").distinct(), "job_id", "left_semi").select("job_id").distinct()
    mixed = lost.select("job_id").distinct().join(bare.select("job_id").unionByName(doubled).distinct(), "job_id", "left_anti")
    mixed = mixed.select("job_id", F.lit(None).cast(probes.schema["clip_id"].dataType).alias("clip_id"), F.lit("mixed_clocks").alias("code"), F.lit("").alias("detail"))

    placed = based.filter("basis <> 'none'").withColumn("place", F.row_number().over(w.orderBy("start", "ord")))
    placed = checkpointed(placed)
    devices = pairs.signature_problems(placed.select(F.col("job_id").alias("case_id"), F.col("place").alias("clip"), *pairs.SIGNATURE))
    devices = devices.join(placed.select(F.col("job_id").alias("case_id"), F.col("place").alias("clip"), "clip_id"), ["case_id", "clip"])
    devices = devices.select(F.col("case_id").alias("job_id"), "clip_id", F.lit("device").alias("code"), F.array_join("differs", ",").alias("detail"))
    for more in (unreadable, again, bare, mixed, devices, _steps(placed)):
        problems = problems.unionByName(more)
    problems = checkpointed(problems)

    order = placed.select("job_id", "clip_id", "basis", "place")
    whole = slots.join(order, ["job_id", "clip_id"], "left").join(problems.groupBy("job_id").agg(F.count("*").alias("n_problems")), "job_id", "left")
    number = F.row_number().over(w.orderBy("place", "ord"))
    whole = whole.select("job_id", number.alias("slot_no"), "front_id", "rear_id", "clip_id", F.coalesce("basis", F.lit("")).alias("basis"), F.col("n_problems").isNull().alias("combined"))
    return whole, problems


def spans(points: DataFrame, durations: DataFrame) -> DataFrame:
    """(clip_id, span): length of a clip, or where its track ends."""
    ends = report.segment_spans(points.withColumn("case_id", F.col("clip_id")).withColumn("segment_index", F.lit(0))).select(F.col("case_id").alias("clip_id"), F.col("span").alias("_end"))
    return durations.join(ends, "clip_id", "left").select("clip_id", F.coalesce(F.nullif("duration", F.lit(0.0)), "_end", F.lit(0.0)).alias("span"))


def run_sequence(points: DataFrame, slots: DataFrame, durations: DataFrame, statuses: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The combined track, its events and a record per clip of every combined job.

    Each leading clip is analysed on its own (outliers, events of cars), then times
    move by the lengths and rows by the rows of the clips before it; no event spans two clips.
    ``statuses`` (clip_id, status) says what extraction reported, ok where it is left out.
    """
    chosen = checkpointed(slots.filter("combined").select("job_id", "slot_no", "clip_id"))
    own = points.drop("job_id").join(chosen.select("clip_id").distinct(), "clip_id", "left_semi").withColumn("case_id", F.col("clip_id"))
    marked = checkpointed(outliers.mark_outliers(own))
    before = Window.partitionBy("job_id").orderBy("slot_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy("clip_id").agg(
        F.count("*").alias("n_rows"), F.count_if(P.has_fix() & ~P.is_synthetic()).alias("n_fixes"), F.count_if("is_outlier").alias("n_outliers"), F.min("row_idx").alias("_base")
    )
    records = chosen.join(spans(marked, durations), "clip_id", "left").join(counts, "clip_id", "left").fillna(0, ["n_rows", "n_fixes", "n_outliers"])
    records = records.withColumn("span", F.coalesce("span", F.lit(0.0)))
    status = F.lit("ok") if statuses is None else F.coalesce("status", F.lit("unknown"))
    records = records if statuses is None else records.join(statuses, "clip_id", "left")
    records = records.withColumn("status", F.when((status == "ok") & (F.col("n_fixes") == 0), "gps_untrusted").otherwise(status))
    records = checkpointed(records.withColumns({
        "segment_index": F.col("slot_no") - 1, "offset_sec": F.coalesce(F.sum("span").over(before), F.lit(0.0)), "row_base": F.coalesce(F.sum("n_rows").over(before), F.lit(0)),
        "label": F.concat(F.lit("video"), F.col("slot_no")), "output_subdir": F.concat(F.lit("seg"), F.lpad(F.col("slot_no").cast("string"), 2, "0")),
    }))
    shift = records.select("job_id", "clip_id", F.col("segment_index").alias("_segment"), "offset_sec", "row_base", F.coalesce("_base", F.lit(0)).alias("_base"))
    track = marked.join(shift, "clip_id").withColumns({
        "start_time_sec": F.col("start_time_sec") + F.col("offset_sec"), "end_time_sec": F.col("end_time_sec") + F.col("offset_sec"),
        "row_idx": F.col("row_idx") - F.col("_base") + F.col("row_base"), "segment_index": F.col("_segment"), "case_id": F.col("job_id"),
    }).drop("_segment", "_base", "offset_sec", "row_base")
    found = events.detect(marked).filter("vehicle = 'car'").withColumnRenamed("case_id", "clip_id").join(shift, "clip_id")
    moved = F.col("row_base") - F.col("_base")
    found = found.select(
        "job_id", F.col("_segment").alias("segment_index"), "kind", (F.col("start_index") + moved).alias("start_index"), (F.col("end_index") + moved).alias("end_index"), "peak",
        (F.col("start_time") + F.col("offset_sec")).alias("start_time"), (F.col("end_time") + F.col("offset_sec")).alias("end_time"),
    )
    return track, found, records.drop("_base")


SEGMENT = "array<struct<slot_no:int,clip_id:bigint,duration_sec:double,status:string,label:string,output_subdir:string>>"


def store_sequence(points: DataFrame, records: DataFrame, path: str) -> None:
    """Keeps the leading clips' tracks as timelines and each job's clips as a document."""
    kept = points.drop("job_id").join(records.select("clip_id").distinct(), "clip_id", "left_semi").filter(~P.is_synthetic())
    R.write_timeline(kept.withColumn("case_id", F.col("clip_id")), f"{path}/engine_output")
    unit = F.struct("slot_no", "clip_id", F.col("span").alias("duration_sec"), "status", "label", "output_subdir")
    lists = records.groupBy("job_id").agg(F.array_sort(F.collect_list(unit)).alias("segments"))
    documents.commit(lists.select(F.col("job_id").alias("case_id"), F.to_json(F.struct("segments")).alias("document")), f"{path}/documents")


def reopen_sequence(jobs: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Combined track, events and records of stored jobs(job_id), as ``run_sequence`` gave them, without extracting anything again.

    A clip whose timeline is gone has the status unknown; a job whose document is absent or damaged is left out.
    """
    read = documents.read(jobs.select(F.col("job_id").alias("case_id")), f"{path}/documents").filter("outcome = 'ok'")
    parsed = F.from_json("document", f"segments {SEGMENT}")
    clips = checkpointed(read.select(F.col("case_id").alias("job_id"), F.inline(parsed["segments"])))
    stored = R.load_timeline(jobs.sparkSession, f"{path}/engine_output").withColumn("clip_id", F.col("case_id").cast("long"))
    order = Window.partitionBy("clip_id").orderBy(F.col("start_time_sec").isNull(), "start_time_sec", "file_row")
    tracks = stored.withColumn("row_idx", F.row_number().over(order).cast("long") - 1)
    tracks = checkpointed(tracks.withColumns({"case_id": F.col("clip_id"), "t_us": F.round(F.col("start_time_sec") * 1_000_000).cast("long"), "segment_index": F.lit(0)}).drop("source_file", "file_row"))
    present = tracks.select("clip_id").distinct().withColumn("_there", F.lit(True))
    statuses = clips.join(present, "clip_id", "left").select("clip_id", F.when(F.col("_there"), F.col("status")).otherwise("unknown").alias("status"))
    slots = clips.select("job_id", "slot_no", "clip_id", F.lit(True).alias("combined"))
    return run_sequence(tracks, slots, clips.select("clip_id", F.col("duration_sec").alias("duration")), statuses)


def combined_cases(records: DataFrame) -> DataFrame:
    """(job_id, n_clips, duration_sec, status, status_detail): a job's clips as one case, its status the worst of theirs."""
    bad = F.when(F.col("status") != "ok", F.concat_ws(": ", "label", "status"))
    details = records.groupBy("job_id").agg(
        F.count("*").alias("n_clips"), F.sum("span").alias("duration_sec"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(bad.isNotNull(), F.struct("slot_no", bad.alias("t"))))), lambda x: x["t"]), "; ").alias("status_detail"),
    )
    return details.join(cases.worst_status(records, ["job_id"]), "job_id")
