"""Dates and times as devices write them. All expressions give null where a text cannot be read.

Two readers of UTC texts exist on purpose: ``parse_time`` for display drops
fractions and wants seconds up to 59; ``utc_seconds`` for time axes keeps
fractions and allows a minute over the day.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import strip

DAY = 86_400


def parse_date(c: Column) -> Column:
    """``yyyy-mm-dd`` or ``ddmmyy`` (80 and later are 19yy)."""
    t = strip(c)
    year = F.substring(t, 5, 2).try_cast("int")
    full = F.concat(F.when(year >= 80, "19").otherwise("20"), F.substring(t, 5, 2), F.lit("-"), F.substring(t, 3, 2), F.lit("-"), F.substring(t, 1, 2))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date")).when(t.rlike(r"^\d{6}$"), full.try_cast("date"))


def parse_time(c: Column) -> Column:
    """Seconds of the day of ``h:mm:ss[.f]`` or ``hhmmss[.f]``, without the fraction."""
    t = strip(c)
    plain = t.rlike(r"^\d{6}(\.\d+)?$")
    pattern = r"^(\d{1,2}):(\d{2}):(\d{2})(?:\.\d+)?$"
    h, m, s = (F.when(plain, F.substring(t, 2 * i + 1, 2)).otherwise(F.nullif(F.regexp_extract(t, pattern, i + 1), F.lit(""))).try_cast("int") for i in range(3))
    return F.when((h <= 23) & (m <= 59) & (s <= 59), h * 3600 + m * 60 + s)


def utc_seconds(c: Column) -> Column:
    """Seconds of the day with fraction, below a day and a minute."""
    d = F.replace(strip(c), F.lit(":"), F.lit(""))
    rest = F.substring(d, 5, 100)
    value = F.substring(d, 1, 2).try_cast("int") * 3600 + F.substring(d, 3, 2).try_cast("int") * 60 + F.when(rest == "", F.lit(0.0)).otherwise(rest.try_cast("double"))
    return F.when((value >= 0) & (value < DAY + 60), value.cast("double"))


def date_days(c: Column) -> Column:
    """Days since 1970-01-01."""
    t = strip(c)
    return F.datediff(parse_date(F.when(F.length(t) == 6, t).otherwise(F.substring(t, 1, 10))), F.lit("1970-01-01").cast("date"))


def abs_time_seconds(c: Column) -> Column:
    """Seconds of a device's local time text; only differences of these mean anything."""
    t = strip(c)
    ok = t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}(?: \d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?|T\d{1,2}:\d{1,2}:\d{1,2})$")
    whole = F.try_to_timestamp(F.replace(F.regexp_replace(t, r"\.\d+$", ""), F.lit("T"), F.lit(" ")), F.lit("y-M-d H:m:s"))
    part = F.coalesce(F.nullif(F.regexp_extract(t, r"(\.\d+)$", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.when(ok, F.unix_timestamp(whole) + part)


def to_display(date: Column, time: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` nine hours later, the time alone without a date, '' without a time."""
    d, s = parse_date(date), parse_time(time)
    local = s + 9 * 3600
    day = F.date_add(d, F.floor(local / DAY).cast("int"))
    clock = local % DAY
    text = F.when(s.isNotNull(), F.concat_ws(":", *[F.lpad(F.floor(x).cast("string"), 2, "0") for x in (clock / 3600, (clock % 3600) / 60, clock % 60)]))
    return F.coalesce(F.when(d.isNotNull(), F.concat(day.cast("string"), F.lit(" "), text, F.lit(" (UTC+9)"))), F.concat(text, F.lit(" (UTC+9)")), F.lit(""))


#: How recorders write a time into file names.
FILENAME_TIMES = (
    r"(\d{4})(\d{2})(\d{2})[_\-](\d{2})(\d{2})(\d{2})",
    r"(\d{4})_(\d{2})_(\d{2})_(\d{2})_(\d{2})_(\d{2})",
    r"(\d{4})(\d{2})(\d{2})-(\d{2})h(\d{2})m(\d{2})s",
    r"(\d{4})-(\d{2})-(\d{2})[_ T](\d{2})[-:.](\d{2})[-:.](\d{2})",
)


def filename_timestamp(name: Column) -> Column:
    """The time in a file's name by the first form that gives a valid one."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    found = []
    for pattern in FILENAME_TIMES:
        digits = F.concat(*[F.regexp_extract(stem, pattern, i) for i in range(1, 7)])
        found.append(F.try_to_timestamp(F.when(digits != "", digits), F.lit("yyyyMMddHHmmss")))
    return F.coalesce(*found)


def mp4_epoch(seconds_since_1904: Column) -> Column:
    """Unix seconds of an MP4 time, null before 1970."""
    s = seconds_since_1904 - 2_082_844_800
    return F.when(s >= 0, s)


def format_local_iso(c: Column) -> Column:
    """An ISO date and time, in the session's zone if it names none, as display time; what cannot be read stays, and nothing is '-'."""
    iso = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$"
    t = strip(c)
    shown = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("+09:00"), F.when(t.rlike(iso), t.try_cast("timestamp")).cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(F.concat(shown, F.lit(" (UTC+9)")), F.nullif(c, F.lit("")), F.lit("-"))
