"""Date and time expressions. Nothing reads the wall clock: callers pass ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from outings.functions.rules import SUNSET_HHMM


def ts(value) -> Column:
    """Timestamp literal from text, or the column itself."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def time_of_day(t: Column) -> Column:
    hour = F.hour(t)
    return F.when(hour < 12, "morning").when(hour < 17, "afternoon").otherwise("evening")


def season_of(t: Column) -> Column:
    month = F.month(t)
    return (
        F.when(month.between(3, 5), "spring")
        .when(month.between(6, 8), "summer")
        .when(month.between(9, 11), "fall")
        .otherwise("winter")
    )


def day_of_week(t: Column) -> Column:
    return F.lower(F.date_format(t, "EEEE"))


def week_bucket(t: Column) -> Column:
    return F.date_trunc("week", t)


def parse_ics_date(text: Column) -> Column:
    """YYYYMMDD[THHMM[SS]][Z] as local time; seconds and zone are ignored."""
    digits = F.split_part(F.regexp_replace(text, "[TZ]", ""), F.lit(";"), F.lit(1))
    n = F.length(digits)
    padded = F.rpad(F.substring(digits, 1, 12), 12, "0")
    return F.when(
        (n >= 12) | n.isin(8, 10), F.try_to_timestamp(padded, F.lit("yyyyMMddHHmm"))
    )


def parse_ics_date_zoned(text: Column, tzid: Column) -> Column:
    """Like ``parse_ics_date`` but a trailing Z or a zone id is honoured."""
    local = parse_ics_date(text)
    zone = F.when(F.trim(text).endswith("Z"), F.lit("UTC")).otherwise(tzid)
    return F.when(zone.isNull(), local).otherwise(F.to_utc_timestamp(local, zone))


def _month_day_year(text: Column, pattern: str, year: Column | None = None) -> Column:
    month = F.initcap(F.substring(F.regexp_extract(text, pattern, 1), 1, 3))
    day = F.regexp_extract(text, pattern, 2)
    year = F.regexp_extract(text, pattern, 3) if year is None else year
    return F.try_to_timestamp(F.concat_ws(" ", month, day, year), F.lit("MMM d yyyy"))


def parse_event_date(text: Column, published: Column) -> Column:
    """First date found in ``text``; without one the publication time."""
    slash = F.regexp_extract(text, r"(\d{1,2}/\d{1,2}/\d{4})", 1)
    found = F.coalesce(
        _month_day_year(text, r"([A-Za-z]{3,})\s+(\d{1,2}),?\s+(\d{4})"),
        F.try_to_timestamp(slash, F.lit("M/d/yyyy")),
        _month_day_year(text, r"([A-Za-z]{3,})\s+(\d{1,2})", F.date_format(published, "yyyy")),
        published,
    )
    return F.when(F.coalesce(text, F.lit("")) != "", found)


# Forms of a clock time, the more exact one first.
CLOCK_FORMS = (r"(?i)(\d{1,2}):(\d{2})\s*(am|pm)", r"(?i)(\d{1,2})\s*(am|pm)")


def extract_time(text: Column) -> Column:
    """First ``h:mm am/pm``, else first ``h am/pm``; the whole match."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, form, 0), F.lit("")) for form in CLOCK_FORMS])


def clamp_request_date(t: Column, as_of: Column) -> Column:
    """Past dates mean now (NULL); later than two weeks means two weeks ahead."""
    latest = as_of + F.expr("INTERVAL '14' DAY")
    return F.when(t < as_of, F.lit(None)).otherwise(F.least(t, latest))


def sunset_hhmm(t: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in SUNSET_HHMM]), F.month(t))
