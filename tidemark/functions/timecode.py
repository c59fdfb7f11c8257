"""Times and spans as column expressions. Times are seconds (double); spans are half-open: [start, end)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAMES_PER_SECOND = 30


def duration(start: Column, end: Column) -> Column:
    return end - start


def contains(start: Column, end: Column, t: Column) -> Column:
    return (t >= start) & (t < end)


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Seconds that two spans share; 0 if none."""
    return F.greatest(F.lit(0.0), F.least(end, other_end) - F.greatest(start, other_start))


def parse_clock(text: Column) -> Column:
    """Seconds of "SS", "MM:SS" or "H:MM:SS" with an optional fraction; null where it isn't a time.

    With two fields the minutes may have any width. Seconds stay under 60 if minutes are given, minutes under 60
    if hours are. Null in, null out.
    """
    pattern = r"^(?:(\d+):)?(?:(\d{1,2}):)?(\d{1,2}(?:\.\d+)?)$"
    t = F.trim(text)
    first, second, secs = (F.regexp_extract(t, pattern, k) for k in (1, 2, 3))
    hours = F.when(second != "", first).otherwise("")
    minutes = F.when(second != "", second).otherwise(first)
    number = lambda c: F.coalesce(F.try_to_number(F.when(c != "", c), F.lit("9" * 18)).cast("double"), F.lit(0.0))
    s = F.when(secs != "", secs).cast("double")
    wrong = ((minutes != "") & (s >= 60)) | ((hours != "") & (number(minutes) >= 60))
    return F.when(t.rlike(pattern) & ~wrong, number(hours) * 3600 + number(minutes) * 60 + s)


def _rounded(seconds: Column, units: int) -> Column:
    """Non-negative whole units, halves away from zero."""
    return F.round(F.greatest(F.lit(0.0), seconds) * units).cast("long")


def clock(seconds: Column) -> Column:
    """For people: "2:03" or "1:02:03"."""
    t = _rounded(seconds, 1)
    h, m, s = F.floor(t / 3600), F.floor(t / 60) % 60, t % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def precise(seconds: Column) -> Column:
    """With hundredths: "1:02:03.45"; also the form of subtitle files with styles."""
    t = _rounded(seconds, 100)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(t / 360000), F.floor(t / 6000) % 60, F.floor(t / 100) % 60, t % 100)


def srt_stamp(seconds: Column) -> Column:
    """With milliseconds: "01:02:03,450"."""
    t = _rounded(seconds, 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3600000), F.floor(t / 60000) % 60, F.floor(t / 1000) % 60, t % 1000)


def argument(seconds: Column) -> Column:
    """Three decimals, exact halves to even: "1481.250"."""
    return F.format_string("%.3f", F.bround(seconds, 3))


def span_text(start: Column, end: Column) -> Column:
    return F.concat(clock(start), F.lit("–"), clock(end))


def frame_count(seconds: Column) -> Column:
    return F.floor(seconds * FRAMES_PER_SECOND + 0.5)


def override(start: Column, end: Column) -> Column:
    """Of a hand-set span: null if it is usable or absent, else why it isn't. Both or neither; the end after the start."""
    return override_parsed(start, end, parse_clock(start), parse_clock(end))


def override_parsed(start: Column, end: Column, a: Column, b: Column) -> Column:
    """``override`` of texts that are parsed already."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(given(start) != given(end), F.lit("start and end must be given together"))
        .when(given(start) & (a.isNull() | b.isNull()), F.lit("not a time"))
        .when(given(start) & (b <= a), F.lit("the end must be after the start"))
    )
