
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_day(published: Column) -> Column:
    """[FLT1] The day as published: the first ten characters, never converted."""
    return F.substring(published, 1, 10)


def on_days(published: Column, first: str | None, last: str | None) -> Column:
    """[FLT1, FLT2] Inclusive range of local days; a missing bound is none."""
    day = local_day(published)
    return (day >= first if first else F.lit(True)) & (day <= last if last else F.lit(True))


def instant(published: Column) -> Column:
    """[DT1] The instant of an ISO text with or without an offset (none: UTC)."""
    return F.to_timestamp(published)


def stamp(moment: Column) -> Column:
    """[DT2] Sortable UTC text."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def elapsed_hours(later: Column, earlier: Column) -> Column:
    """[DT3] Whole hours passed, rounded down."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 3_600_000_000).cast("long")


def clock(ms: Column, with_ms: bool = True) -> Column:
    """[DT6] HH:MM:SS.mmm or HH:MM:SS."""
    s = F.floor(ms / 1000)
    parts = [F.floor(s / 3600), F.floor(s / 60) % 60, s % 60]
    return F.format_string("%02d:%02d:%02d.%03d", *parts, ms % 1000) if with_ms else F.format_string("%02d:%02d:%02d", *parts)


#: The end of a text, before which a last line break may stand.
END = r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?\z"


def _parts(text: Column, pattern: str, n: int, value: Callable[[list[Column]], Column]) -> Column:
    """value(the pattern's n groups of digits as numbers, 0 where there is none); null where the text isn't of the pattern. The pattern is tried once."""
    told = F.split(F.regexp_replace(text, pattern, "=" + ",".join(f"${i}" for i in range(1, n + 1))), ",", -1)
    number = lambda x, i: F.concat(F.lit("0"), F.get(x, F.lit(i))).cast("long")
    kept = lambda x: F.when(F.startswith(x[0], F.lit("=")), value([F.concat(F.lit("0"), F.substr(x[0], F.lit(2))).cast("long"), *(number(x, i) for i in range(1, n))]))
    return F.when(~F.startswith(text, F.lit("=")), F.get(F.transform(F.array(told), kept), F.lit(0)))


def clock_ms(text: Column) -> Column:
    """[DT7] Milliseconds of HH:MM:SS.mmm or MM:SS.mmm; null for other texts."""
    return _parts(text, r"^(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})" + END, 4, lambda p: ((p[0] * 60 + p[1]) * 60 + p[2]) * 1000 + p[3])


def iso_seconds(text: Column) -> Column:
    """[DT5] Seconds of an ISO-8601 duration of days and below; null where it isn't one."""
    pattern = r"^P(?=\D*\d)(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?" + END
    return _parts(text, pattern, 4, lambda p: ((p[0] * 24 + p[1]) * 60 + p[2]) * 60 + p[3])


def due_day(moment: Column, zone: str, daily_at: str) -> Column:
    """[DT8, SM6] The local day that is due: today's once the local clock has passed `daily_at` (HH:mm), else none."""
    local = F.from_utc_timestamp(moment, zone)
    return F.when(F.date_format(local, "HH:mm") >= daily_at, F.to_date(local))


def next_midnight(moment: Column, zone: str = "America/Los_Angeles") -> Column:
    """[DT9] The instant of the next local midnight, when a day's quota begins anew."""
    return F.to_utc_timestamp(F.date_add(F.to_date(F.from_utc_timestamp(moment, zone)), 1).cast("timestamp"), zone)


def backoff_seconds(strikes: Column, base: float, cap: float) -> Column:
    """[DT11] Doubling waits under a cap."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(F.lit(0), strikes - 1)), F.lit(cap))


def transcription_timeout(seconds: Column) -> Column:
    """[DT12] One and a half times the length and ten minutes; an hour where the length isn't known."""
    return F.coalesce(seconds * 1.5 + 600, F.lit(3600.0))


def spoken_duration(seconds: Column) -> Column:
    """[DT17] 4h 43m, 4h or 43m; of seconds rounded half to even, none below nought."""
    total = F.greatest(F.lit(0), F.bround(seconds, 0)).cast("long")
    h, m = F.floor(total / 3600), F.floor(total / 60) % 60
    return F.when((h > 0) & (m > 0), F.format_string("%dh %dm", h, m)).when(h > 0, F.format_string("%dh", h)).otherwise(F.format_string("%dm", m))


def refusal(seconds: Column, size: Column, most_seconds: int, most_size: int) -> Column:
    """[FLT13] Which limit a capture breaks: length, else size, else null. An unknown length breaks none."""
    return F.when(seconds > most_seconds, "length").when(size > most_size, "size")


#: Words of the two status sources and the readiness they mean [FLT12].
BROADCAST = {"live": "live", "upcoming": "upcoming"}
LIVE_STATUS = {"is_upcoming": "upcoming", "is_live": "live", "was_live": "finished", "not_live": "finished"}


def readiness(broadcast: Column, seconds: Column, status: Column) -> Column:
    """[FLT12] upcoming, live, finished or unknown: the broadcast word decides (none needs a length), else the live status."""
    first = F.create_map(*[F.lit(x) for kv in BROADCAST.items() for x in kv])[broadcast]
    first = F.when(broadcast == "none", F.when(seconds > 0, "finished")).otherwise(first)
    return F.coalesce(first, F.create_map(*[F.lit(x) for kv in LIVE_STATUS.items() for x in kv])[status], F.lit("unknown"))


def state_word(provisional: Column, churn: Column) -> Column:
    """[FLT11]"""
    return F.when(provisional, "provisional").when(churn, "settled under churn").otherwise("settled")


def title_day(title: Column) -> Column:
    """[DT4] The one day that a title names (Month D, YYYY; D Month YYYY; M/D/YY), null for none or several."""
    month = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    named = F.transform(F.regexp_extract_all(title, F.lit(rf"({month}\s+\d{{1,2}},\s*\d{{4}})"), F.lit(1)), lambda t: F.try_to_date(F.regexp_replace(t, r"\s+", " "), "MMMM d, yyyy"))
    turned = F.transform(F.regexp_extract_all(title, F.lit(rf"\b(\d{{1,2}}\s+{month}\s+\d{{4}})"), F.lit(1)), lambda t: F.try_to_date(F.regexp_replace(t, r"\s+", " "), "d MMMM yyyy"))
    short = F.transform(F.regexp_extract_all(title, F.lit(r"\b(\d{1,2}/\d{1,2}/\d{2})\b"), F.lit(1)), lambda t: F.try_to_date(t, "M/d/yy"))
    days = F.array_distinct(F.array_compact(F.concat(named, turned, short)))
    return F.when(F.size(days) == 1, F.element_at(days, 1))
