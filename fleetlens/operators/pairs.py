"""Row-wise comparison of two recordings that should belong together, and of the clips of a chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import normalize_model

MAX_NAME_OFFSET_SEC = 3
MAX_RECORDED_OFFSET_SEC = 10
SIGNATURE = ("container", "brand", "udta", "model", "codec")


def differs(a: Column, b: Column) -> Column:
    """Both known and different; what is missing is not compared."""
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return known & (a != b)


def _device(a, b) -> list[Column]:
    """Differences of two signatures: the container, or else model, brand, metadata and codec."""
    other = differs(a("container"), b("container"))
    model = differs(normalize_model(a("model")), normalize_model(b("model")))
    return [F.when(other, "container"), F.when(~other & model, "model"), *[F.when(~other & differs(a(k), b(k)), k) for k in ("brand", "udta", "codec")]]


def compare_pairs(pairs: DataFrame) -> DataFrame:
    """Problems of each row of pairs(pair_id, front struct, rear struct), in order, and whether there are none.

    A side has path, sha256, name_time, duration, recorded_at and the parts of
    its signature. The same file, or the same content, ends the comparison.
    """
    f, r = (lambda c: F.col(f"front.{c}")), (lambda c: F.col(f"rear.{c}"))
    allowed = F.greatest(F.lit(2.0), 0.05 * F.greatest(f("duration"), r("duration")))
    found = [
        *_device(f, r), F.when(F.abs(F.unix_timestamp(f("name_time")) - F.unix_timestamp(r("name_time"))) > MAX_NAME_OFFSET_SEC, "name_time"),
        F.when(F.abs(f("duration") - r("duration")) > allowed, "duration"),
        F.when(F.abs(F.unix_timestamp(f("recorded_at")) - F.unix_timestamp(r("recorded_at"))) > MAX_RECORDED_OFFSET_SEC, "recorded_at"),
    ]
    problems = F.when(f("path") == r("path"), F.array(F.lit("same_file"))).when(f("sha256") == r("sha256"), F.array(F.lit("same_content"))).otherwise(F.array_compact(F.array(*found)))
    return pairs.select("pair_id", problems.alias("problems")).withColumn("ok", F.size("problems") == 0)


def compare_in_full(quick: DataFrame, extracted: DataFrame, by_gps: DataFrame) -> DataFrame:
    """(pair_id, problems, code): files first, then how both extractions ended, then their GPS records.

    quick(pair_id, problems), extracted(pair_id, side, status, damaged), by_gps(pair_id, verdict). A step is only
    asked where the ones before it found nothing; a side that only has untrusted or no GPS can be compared.
    """
    fine = F.col("status").isin("ok", "no_gps", "gps_untrusted")
    failed = F.when(~fine, F.concat_ws(":", "side", F.when(F.col("damaged"), "damaged").otherwise(F.lit("engine_failed"))))
    ends = extracted.groupBy("pair_id").agg(F.array_sort(F.collect_list(failed)).alias("_ends"), F.bool_or(~fine & F.col("damaged")).alias("_damaged"))
    rows = quick.select("pair_id", "problems").join(ends, "pair_id", "left").join(by_gps.select("pair_id", "verdict"), "pair_id", "left")
    gps = F.when(F.col("verdict") != "ok", F.col("verdict"))
    none = F.array().cast("array<string>")
    ends_ = F.coalesce("_ends", none)
    problems = F.when(F.size("problems") > 0, F.col("problems")).when(F.size(ends_) > 0, ends_).otherwise(F.array_compact(F.array(gps)))
    code = F.when((F.size("problems") == 0) & (F.size(ends_) > 0), F.when(F.col("_damaged"), "damaged").otherwise("engine_failed")).otherwise("")
    return rows.select("pair_id", problems.alias("problems"), code.alias("code"))


def choose_basis(clips: DataFrame) -> DataFrame:
    """Per case the clock that every clip has: gps, else filename, else none; and the start of each clip by it."""
    by = clips.groupBy("case_id").agg(F.bool_and(F.col("gps_start").isNotNull()).alias("g"), F.bool_and(F.col("name_start").isNotNull()).alias("n"))
    basis = F.when(F.col("g"), "gps").when(F.col("n"), "filename").otherwise("none")
    out = clips.join(by.select("case_id", basis.alias("basis")), "case_id")
    return out.withColumn("start", F.when(F.col("basis") == "gps", F.col("gps_start")).when(F.col("basis") == "filename", F.col("name_start")))


def signature_problems(clips: DataFrame) -> DataFrame:
    """Clips whose signature differs from their case's first one, and in what."""
    first = clips.groupBy(F.col("case_id").alias("_c")).agg(F.min_by(F.struct(*SIGNATURE), "clip").alias("first"))
    met = clips.join(first, F.col("case_id") == F.col("_c"))
    wrong = F.array_compact(F.array(*_device(lambda k: F.col(f"first.{k}"), lambda k: F.col(k))))
    return met.select("case_id", "clip", wrong.alias("differs")).filter(F.size("differs") > 0)
