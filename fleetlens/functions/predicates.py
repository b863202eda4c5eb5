"""Row predicates of a track. Flags are three-valued: only an explicit false disqualifies a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SYNTHETIC_STATES
from .strings import strip


def not_false(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(True))


def finite(name: str) -> Column:
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def filled(name: str) -> Column:
    return F.coalesce(strip(F.col(name)), F.lit("")) != ""


def has_coords() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def in_range() -> Column:
    return finite("latitude") & finite("longitude") & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)


def has_fix() -> Column:
    return F.coalesce(
        in_range() & ~F.coalesce(F.col("is_outlier"), F.lit(False)) & not_false("gps_checksum_ok") & not_false("gps_trusted"), F.lit(False)
    )


def has_gps_record() -> Column:
    return filled("gps_utc_time") | filled("gps_date") | filled("gps_status") | filled("gps_abs_time") | F.col("gps_elapsed").isNotNull()


def is_synthetic() -> Column:
    return F.coalesce(F.col("recovery_state").isin(*SYNTHETIC_STATES), F.lit(False))


def is_recovered() -> Column:
    return F.coalesce(F.col("recovery_state") == "gap_carved", F.lit(False))


def is_dropout() -> Column:
    return has_gps_record() & ~has_coords()


def verification_failed() -> Column:
    return ~not_false("gps_checksum_ok") | ~not_false("gps_trusted")


def coords_valid() -> Column:
    """In range and not the (0, 0) that some devices write for no reception."""
    return F.coalesce(in_range() & ~((F.abs("latitude") < 1e-6) & (F.abs("longitude") < 1e-6)), F.lit(False))


def is_time_anchor() -> Column:
    status = F.upper(strip(F.coalesce("gps_status", F.lit(""))))
    return not_false("gps_checksum_ok") & not_false("gps_trusted") & status.isin("", "A")


def usable_speed() -> Column:
    return ~is_synthetic() & has_fix() & finite("speed_kmh") & (F.col("speed_kmh") >= 0) & finite("start_time_sec") & (F.col("start_time_sec") >= 0)


def record_key() -> Column:
    """What tells one GPS measurement from the next: UTC, else device time, else elapsed seconds, else the values."""
    s, d = F.lit(None).cast("string"), F.lit(None).cast("double")

    def key(kind: str, s1=s, s2=s, d1=d, d2=d, d3=d) -> Column:
        return F.struct(F.lit(kind).alias("kind"), s1.alias("s1"), s2.alias("s2"), d1.alias("d1"), d2.alias("d2"), d3.alias("d3"))

    return (
        F.when(filled("gps_utc_time"), key("utc", F.coalesce("gps_date", F.lit("")), strip("gps_utc_time")))
        .when(filled("gps_abs_time"), key("abs", strip("gps_abs_time")))
        .when(F.col("gps_elapsed").isNotNull(), key("elapsed", d1=F.col("gps_elapsed")))
        .otherwise(key("val", d1=F.col("latitude"), d2=F.col("longitude"), d3=F.col("speed_kmh")))
    )


def g_magnitude() -> Column:
    def size(suffix: str) -> Column:
        x, y, z = (F.col(f"{a}_g{suffix}") for a in "xyz")
        return F.sqrt(x * x + y * y + z * z)

    return F.coalesce(size("_cal"), size(""))
