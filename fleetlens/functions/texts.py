"""Small text functions: names, sizes, folders, links, offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import strip

#: Endings of front recordings' names and what rear ones have instead, likeliest first.
REAR_RULES = (
    (r"(?i)([_\-])F([_\-]\d+)$", ("$1R$2",)),
    (r"(?i)([_\-])F$", ("$1R",)),
    (r"(?i)([_\-])N$", ("$1R",)),
    (r"(?i)([_\-])(front|fr)$", ("$1rear", "$1Rear", "$1REAR", "$1R", "$1back")),
    (r"(?i)F$", ("R",)),
)


def rear_candidates(name: Column) -> Column:
    """Names that the rear recording may have, in order, each with the extension's cases, without the name itself."""
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    none = F.array().cast("array<string>")
    found = []
    for pattern, endings in REAR_RULES:
        made = [F.concat(F.regexp_replace(stem, pattern, e), x) for e in endings for x in (ext, F.lower(ext), F.upper(ext))]
        found.append(F.when(stem.rlike(pattern), F.array(*made)).otherwise(none))
    return F.array_except(F.array_distinct(F.concat(*found)), F.array(name))


def normalize_model(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def safe_folder(number: Column, case_id: Column) -> Column:
    """Letters, digits, '-' and '_' of a case number, 48 at most, and the id; 'case' where nothing is left."""
    kept = F.substring(F.regexp_replace(number, r"[^\p{L}\p{N}_-]", ""), 1, 48)
    return F.concat(F.when(kept == "", "case").otherwise(kept), F.lit("_"), case_id.cast("string"))


def _stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def name_prefix(c: Column) -> Column:
    """Letters and underscores that a file's name begins with, in capitals."""
    return F.upper(F.regexp_extract(F.regexp_extract(c, r"([^/\\]*)$", 1), "^[A-Za-z_]+", 0))


def digits(c: Column) -> Column:
    """The first 14 digits of a name as a number, 0 without any."""
    return F.coalesce(F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 14).try_cast("long"), F.lit(0))


def channel_tag(c: Column) -> Column:
    """Letters after the last digit of a name without its extension: f, r, rear ..."""
    return F.lower(F.regexp_replace(F.regexp_extract(_stem(c), r"([^0-9]*)$", 1), r"^[_\- ]+|[_\- ]+$", ""))


def html_escape(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def map_url(lat: Column, lon: Column) -> Column:
    return F.format_string("https://maps.example/?q=%.6f,%.6f", F.bround(lat, 6), F.bround(lon, 6))


def parse_offset(c: Column) -> Column:
    """Byte position from ``0x...`` or a number."""
    t = strip(c)
    return F.when(F.lower(t).startswith("0x"), F.conv(F.substring(t, 3, 40), 16, 10).try_cast("long")).otherwise(F.floor(t.try_cast("double")).cast("long"))


def contains_ascii_ci(c: Column, q: str) -> Column:
    return F.lower(c).contains(q.lower())


def format_size(c: Column) -> Column:
    """Bytes as a number with two decimals in its unit, and the unit."""
    power = F.when(c >= 1 << 40, 4).when(c >= 1 << 30, 3).when(c >= 1 << 20, 2).when(c >= 1 << 10, 1).otherwise(0)
    units = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")])
    return F.struct((F.rint(c / F.pow(F.lit(1024.0), power) * 100) / 100).alias("amount"), F.element_at(units, power + 1).alias("unit"))


def duration_parts(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.concat_ws(":", F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def clock_text(seconds: Column) -> Column:
    """Rounded to seconds: ``mm:ss``, with hours from one on."""
    t = F.rint(seconds).cast("long")
    h, short = F.floor(t / 3600), F.concat(_two(F.floor(t % 3600 / 60)), F.lit(":"), _two(t % 60))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), short)).otherwise(short)


def minutes_text(seconds: Column) -> Column:
    """``m min ss s``, without minutes below one."""
    t = F.rint(seconds).cast("long")
    m = F.floor(t / 60)
    return F.when(m > 0, F.concat(m.cast("string"), F.lit(" min "), _two(t % 60), F.lit(" s"))).otherwise(F.concat((t % 60).cast("string"), F.lit(" s")))


def gap_text(seconds: Column) -> Column:
    """A pause in the largest unit that fits: seconds below two minutes, minutes below two hours, hours below two days."""
    s = F.abs(seconds)
    return (
        F.when(s < 120, F.format_string("%.1f s", s)).when(s < 7200, F.format_string("%.0f min", F.rint(s / 60))).when(s < 172_800, F.format_string("%.1f h", s / 3600))
        .otherwise(F.format_string("%.0f d", F.rint(s / 86_400)))
    )


def offset_text(seconds: Column) -> Column:
    """How far two starts lie apart: seconds below two minutes, hours and minutes below a day, else days."""
    s = F.abs(seconds)
    t = F.rint(s).cast("long")
    h, m = F.floor(t / 3600), F.floor(t % 3600 / 60)
    long = F.when(h > 0, F.concat(h.cast("string"), F.lit(" h "), m.cast("string"), F.lit(" min"))).otherwise(F.concat(m.cast("string"), F.lit(" min")))
    return F.when(s < 120, F.format_string("%.0f s", F.rint(s))).when(s < 86_400, long).otherwise(F.format_string("%.0f d", F.rint(s / 86_400)))


def epoch_text(seconds: Column) -> Column:
    """Seconds since 1970, negative ones too, as UTC."""
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def tick_text(seconds: Column) -> Column:
    """A mark of a time axis: seconds, minutes, hours, and days from two on."""
    t = F.rint(seconds).cast("long")
    s, m, h = t % 60, F.floor(t / 60), F.floor(t / 3600)
    days = F.concat(F.floor(h / 24).cast("string"), F.lit("d "), _two(h % 24), F.lit(":"), _two(m % 60))
    hours = F.concat(h.cast("string"), F.lit(":"), _two(m % 60), F.lit(":"), _two(s))
    return F.when(t < 60, F.concat(t.cast("string"), F.lit("s"))).when(m < 60, F.concat(m.cast("string"), F.lit(":"), _two(s))).when(h < 48, hours).otherwise(days)


#: Steps of long time axes, in seconds.
TICK_STEPS = (20, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 14400, 43200, 86400, 172800, 604800)


def tick_step(span: Column) -> Column:
    """Seconds between ticks of a time axis: the smallest step with ten ticks at most."""
    out = TICK_STEPS[-1] * F.ceil(span / (TICK_STEPS[-1] * 10)).cast("long")
    for step in reversed(TICK_STEPS):
        out = F.when(span / step <= 10, step).otherwise(out)
    return F.when(span <= 5, 1).when(span <= 10, 2).when(span <= 100, 10).otherwise(out)


def view_tag(mode: Column, separate_rear: Column) -> Column:
    """Views of a recording: front and rear (``F, B``), one of them, or '' for a plain front file."""
    both = F.lit("F, B")
    return F.when(mode == "both", both).when(mode == "front", "F").when(mode == "rear", "B").when(separate_rear, both).otherwise("")


def same_view(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def time_estimate_tag(source: Column, estimated: Column) -> Column:
    """Whether a playback time is an estimate, and of which clock."""
    s = F.coalesce(source, F.lit(""))
    is_estimate = F.coalesce(estimated, F.lit(False)) | s.endswith("_estimated")
    return F.when(~is_estimate, "").when(s.isin("", "gps_utc_estimated"), "utc_estimated").otherwise("estimated")
