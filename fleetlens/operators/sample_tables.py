"""Tables of a video file as relations: runs expanded to samples, frames counted between clock readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
MAX_STEP_SEC = 5
LEAST_SEC = 5
#: Rows that a task puts in order at a time, about 200 MB.
TASK_ROWS = 2_000_000


def as_of(rows: DataFrame, steps: DataFrame, key: str, at: str, value: Column) -> DataFrame:
    """``rows`` with ``value``: that of the last of ``steps`` whose ``at`` is not after the row's, within ``key``. One order of both, no join."""
    marks = steps.select(key, at, value.alias("_step"))
    both = rows.withColumn("_row", F.lit(1)).unionByName(marks.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_step", F.last("_step", ignorenulls=True).over(w)).filter("_row = 1").drop("_row")


def run_starts(runs: DataFrame, key: str, count: str, first: int, *sums: tuple[str, Column]) -> DataFrame:
    """Run-length entries in order of ``run_no`` with ``at``, the number of their first sample, and running sums of what came before."""
    before = Window.partitionBy(key).orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    out = runs.withColumn("at", F.coalesce(F.sum(count).over(before), F.lit(0)) + first)
    return out.withColumns({name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in sums})


def samples(chunks: DataFrame, per_chunk: DataFrame, durations: DataFrame, shifts: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per sample: (track_id, sample_no, chunk_no, offset, size, dts, pts), numbered from 1.

    chunks(track_id, chunk_no, offset); per_chunk(track_id, first_chunk, n) holds
    until the next entry; durations(track_id, run_no, n, delta) and
    shifts(track_id, run_no, n, shift) are run lengths; sizes(track_id, sample_no, size).
    Samples beyond the last run have no time, those without a shift are shown when they
    are decoded; a chunk before the first entry of per_chunk is empty.
    """
    sized = as_of(chunks.withColumnRenamed("chunk_no", "at"), per_chunk.withColumnRenamed("first_chunk", "at"), "track_id", "at", F.struct("n")).withColumnRenamed("at", "chunk_no")
    before = Window.partitionBy("track_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("n", F.coalesce("_step.n", F.lit(0))).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).filter("n > 0")
    listed = sized.select("track_id", "chunk_no", "offset", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("sample_no"))
    placed = listed.join(sizes, ["track_id", "sample_no"], "left")
    earlier = Window.partitionBy("track_id", "chunk_no").orderBy("sample_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.col("offset") + F.coalesce(F.sum("size").over(earlier), F.lit(0))).withColumnRenamed("sample_no", "at")

    timed = run_starts(durations, "track_id", "n", 1, ("start", F.col("n") * F.col("delta")))
    step = F.struct("at", "n", "delta", "start")
    rows = as_of(placed, timed, "track_id", "at", step)
    within = F.col("at") - F.col("_step.at")
    rows = rows.withColumn("dts", F.when(within < F.col("_step.n"), F.col("_step.start") + within * F.col("_step.delta"))).drop("_step")
    rows = as_of(rows, run_starts(shifts, "track_id", "n", 1), "track_id", "at", F.struct("at", "n", "shift"))
    shift = F.when(F.col("at") - F.col("_step.at") < F.col("_step.n"), F.col("_step.shift"))
    return rows.select("track_id", F.col("at").alias("sample_no"), "chunk_no", "offset", "size", "dts", (F.col("dts") + F.coalesce(shift, F.lit(0))).alias("pts"))


def recording_ends(fragments: DataFrame, ends: DataFrame) -> DataFrame:
    """(file_id, end_at, reason): the first fragment that an older recording has left behind.

    fragments(file_id, moof_no, moof_at, sequence, intact: nothing is missing between it and the one
    before); ends(file_id, moof_no, track_id, base_time, end_time, timescale). The sequence falls or stays,
    or skips where nothing is missing; or a track's clock falls by over half a second. A
    file whose first two numbers are equal does not count its fragments.
    """
    w = Window.partitionBy("file_id").orderBy("moof_no")
    rows = fragments.withColumn("_was", F.last("sequence", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    compared = F.col("sequence").isNotNull() & F.col("_was").isNotNull()
    first = F.min_by(F.col("sequence") == F.col("_was"), F.when(compared, F.col("moof_no"))).over(Window.partitionBy("file_id"))
    rows = rows.withColumn("_idle", F.coalesce(first, F.lit(False)))
    broken = compared & ~F.col("_idle") & ((F.col("sequence") <= F.col("_was")) | (F.col("intact") & (F.col("sequence") != F.col("_was") + 1)))
    numbers = rows.filter(broken).select("file_id", "moof_no", F.lit("sequence").alias("reason"))
    own = Window.partitionBy("file_id", "track_id").orderBy("moof_no").rowsBetween(Window.unboundedPreceding, -1)
    timed = ends.withColumn("_end", F.last(F.when(F.col("base_time").isNotNull(), F.col("end_time")), ignorenulls=True).over(own))
    back = timed.filter(F.col("base_time") < F.col("_end") - F.greatest(F.lit(1), F.floor(F.col("timescale") / 2)))
    found = numbers.unionByName(back.select("file_id", "moof_no", F.lit("clock").alias("reason")).distinct())
    return found.join(fragments.select("file_id", "moof_no", "moof_at"), ["file_id", "moof_no"]).groupBy("file_id").agg(
        F.min("moof_at").alias("end_at"), F.min_by("reason", F.struct("moof_no", F.col("reason") == "clock")).alias("reason")
    )


def fragment_samples(fragments: DataFrame, tracks: DataFrame, runs: DataFrame, parts: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples of a fragmented file (file_id, moof_no, track_id, run_no, i, offset, size, dts, kept), and where its recordings end.

    tracks(file_id, moof_no, track_id, base_time or null, timescale); runs(file_id, moof_no,
    track_id, run_no, data_offset or null), numbered through the fragment;
    parts(file_id, moof_no, run_no, i, size, duration); media(file_id, a, b) that has survived. A run
    begins at its data offset from the fragment, else where the run before it
    ended; offsets and times are running sums that start anew at every given value.
    A sample is kept if it lies in the media and its fragment before the end.
    """
    keys = ["file_id", "moof_no", "run_no"]
    lengths = runs.join(parts.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.sum("duration").alias("ticks")), keys, "left").fillna(0, ["bytes", "ticks"])
    lengths = lengths.join(fragments.select("file_id", "moof_no", "moof_at"), ["file_id", "moof_no"])
    in_moof = Window.partitionBy("file_id", "moof_no").orderBy("run_no")
    given = F.when(F.col("data_offset").isNotNull() | (F.row_number().over(in_moof) == 1), F.col("moof_at") + F.coalesce("data_offset", F.lit(0)))
    lengths = lengths.withColumn("_given", given).withColumn("_part", F.count("_given").over(in_moof))
    part = Window.partitionBy("file_id", "moof_no", "_part").orderBy("run_no")
    begin = F.first("_given").over(part) + F.coalesce(F.sum("bytes").over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_track = Window.partitionBy("file_id", "moof_no", "track_id").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.withColumns({"begin": begin, "_ticks": F.coalesce(F.sum("ticks").over(of_track), F.lit(0))})

    whole = lengths.groupBy("file_id", "moof_no", "track_id").agg(F.sum("ticks").alias("ticks"))
    ends = tracks.join(whole, ["file_id", "moof_no", "track_id"], "left").withColumn("end_time", F.col("base_time") + F.coalesce("ticks", F.lit(0)))
    last = recording_ends(fragments, ends)
    placed = lengths.select(*keys, "track_id", "moof_at", "begin", "_ticks").join(tracks.select("file_id", "moof_no", "track_id", "base_time"), ["file_id", "moof_no", "track_id"])
    in_run = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumns({"_size": F.coalesce(F.sum("size").over(in_run), F.lit(0)), "_time": F.coalesce(F.sum("duration").over(in_run), F.lit(0))}).join(placed, keys)
    rows = rows.select(*keys, "track_id", "moof_at", "i", (F.col("begin") + F.col("_size")).alias("at"), "size", (F.col("base_time") + F.col("_ticks") + F.col("_time")).alias("dts"))
    rows = as_of(rows, media.select("file_id", F.col("a").alias("at"), "b"), "file_id", "at", F.struct("b")).join(last, "file_id", "left")
    kept = F.coalesce(F.col("at") + F.col("size") <= F.col("_step.b"), F.lit(False)) & (F.col("end_at").isNull() | (F.col("moof_at") < F.col("end_at")))
    return rows.select("file_id", "moof_no", "track_id", "run_no", "i", F.col("at").alias("offset"), "size", "dts", kept.alias("kept")), last


def clock_rates(clocks: DataFrame, frames: DataFrame, gaps: DataFrame) -> DataFrame:
    """(case_id, span_sec, frames, seconds, fps): frames counted between neighbouring clock readings.

    clocks(case_id, at, utc in seconds of the day), frames(case_id, at) of the first
    video stream, gaps(case_id, at) where damage begins. A clock repeated from reading
    to reading counts once, a fall passes midnight, steps of over 5 s or with damage
    between do not count, and a rate needs 5 s. All three stand in one order of
    places with running counts; nothing is searched.
    """
    def marked(rows: DataFrame, utc: Column, kind: int) -> DataFrame:
        return rows.select("case_id", "at", utc.cast("double").alias("utc"), F.lit(kind).cast("byte").alias("kind"))

    kinds = {"clock": 0, "frame": 1, "gap": 2}
    marks = marked(clocks, F.col("utc"), 0).unionByName(marked(frames, F.lit(None), 1)).unionByName(marked(gaps, F.lit(None), 2))
    # Frames are many and small, and shuffled so well packed that a task by bytes would sort too many of them.
    n = max(int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-marks.count() // TASK_ROWS))
    marks = marks.repartition(n, "case_id")
    # A reading comes before what begins at its own place.
    order = Window.partitionBy("case_id").orderBy("at", F.col("kind") != kinds["clock"])
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = marks.withColumns({k: F.count_if(F.col("kind") == kinds[k]).over(so_far) for k in ("frame", "gap")}).filter(F.col("kind") == kinds["clock"])
    w = Window.partitionBy("case_id").orderBy("at")
    rows = rows.withColumn("_was", F.lag("utc").over(w)).filter("_was is null or _was <> utc")
    step = F.col("utc") - F.lag("utc").over(w)
    step = F.when(step < 0, step + DAY).otherwise(step)
    rows = rows.withColumns({"step": step, "n": F.col("frame") - F.lag("frame").over(w), "broken": F.col("gap") > F.lag("gap").over(w)})
    used = (F.col("step") > 0) & (F.col("step") <= MAX_STEP_SEC) & ~F.col("broken")
    out = rows.groupBy("case_id").agg(
        (F.max_by("utc", "at") - F.min_by("utc", "at")).alias("_span"), F.coalesce(F.sum(F.when(used, F.col("n"))), F.lit(0)).alias("frames"), F.coalesce(F.sum(F.when(used, F.col("step"))), F.lit(0.0)).alias("seconds")
    )
    fps = F.when((F.col("seconds") >= LEAST_SEC) & (F.col("frames") > 0), F.col("frames") / F.col("seconds"))
    return out.select("case_id", F.when(F.col("_span") < 0, F.col("_span") + DAY).otherwise(F.col("_span")).alias("span_sec"), "frames", "seconds", fps.alias("fps"))
