"""Opening-hours expressions over the ``hours`` struct of ``outings.schemas``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from outings.functions.rules import SEASONAL_HOURS_WORDS, string_array
from outings.schemas import PERIODS_DDL

NOT_AVAILABLE = "Hours not available"
ALWAYS = "Open 24 hours"
SEE_MAPS = "See Google Maps for hours"


def _hhmm(point: Column) -> Column:
    """Clock time as an integer; both the text and the hour/minute form are read."""
    return F.coalesce(point["time"].try_cast("int"), point["hour"] * 100 + point["minute"])


def _always(hours: Column) -> Column:
    return F.coalesce(hours["always_open"], F.lit(False)) | F.coalesce(
        hours["type"] == "always_open", F.lit(False)
    )


def is_open(hours: Column, t: Column, strict: bool = False) -> Column:
    """Open at ``t``; unknown hours count as open.

    By default only periods that open today are looked at. ``strict`` instead
    keeps a period that opened yesterday running into the early morning and
    does not open today's overnight period before its start.
    """
    now = F.hour(t) * 100 + F.minute(t)
    today = F.dayofweek(t) - 1
    yesterday = F.pmod(today - 1, F.lit(7))
    periods = hours["periods"]

    def literal(p: Column) -> Column:
        start, end = _hhmm(p["open"]), F.coalesce(_hhmm(p["close"]), F.lit(2400))
        overnight = p["close"].isNotNull() & (p["close"]["day"] != today)
        inside = F.when(overnight, (now >= start) | (now < end)).otherwise(
            (now >= start) & (now < end)
        )
        return F.coalesce((p["open"]["day"] == today) & inside, F.lit(False))

    def exact(p: Column) -> Column:
        start, end = _hhmm(p["open"]), F.coalesce(_hhmm(p["close"]), F.lit(2400))
        overnight = p["close"].isNotNull() & (p["close"]["day"] != p["open"]["day"])
        same_day = (p["open"]["day"] == today) & (now >= start) & (overnight | (now < end))
        tail = (p["open"]["day"] == yesterday) & overnight & (now < end)
        return F.coalesce(same_day | tail, F.lit(False))

    inside_any = F.exists(periods, exact if strict else literal)
    known = F.coalesce(inside_any | (F.size(periods) == 0), F.lit(True))
    return _always(hours) | known


def week_minute(t: Column) -> Column:
    """Minutes since Sunday 00:00."""
    return (F.dayofweek(t) - 1) * 1440 + F.hour(t) * 60 + F.minute(t)


def open_spans(hours: Column) -> Column:
    """Spans [start, end) of the week's minutes in which ``is_open`` holds (not strict); NULL where it always does.

    An overnight period counts on the day it opens: from its opening to midnight, and before its close.
    """

    def minutes(hhmm: Column) -> Column:
        return (F.floor(hhmm / 100) * 60 + hhmm % 100).cast("int")

    def spans(p: Column) -> Column:
        day = p["open"]["day"] * 1440
        start, end = minutes(_hhmm(p["open"])), minutes(F.coalesce(_hhmm(p["close"]), F.lit(2400)))
        span = lambda a, b: F.struct((day + a).alias("start"), (day + b).alias("stop"))
        overnight = p["close"].isNotNull() & (p["close"]["day"] != p["open"]["day"])
        both = F.array(span(start, F.lit(1440)), span(F.lit(0), end))
        return F.when(overnight, both).otherwise(F.array(span(start, end)))

    known = F.filter(F.flatten(F.transform(hours["periods"], spans)), lambda s: s["start"] < s["stop"])
    return F.when(~_always(hours) & (F.size(hours["periods"]) > 0), F.array_sort(known))


def hours_status(hours: Column, t: Column) -> Column:
    return (
        F.when(hours.isNull() | hours["weekday_text"].isNull(), NOT_AVAILABLE)
        .when(F.coalesce(hours["always_open"], F.lit(False)), ALWAYS)
        .when(is_open(hours, t), "Open now")
        .otherwise("Closed now")
    )


def _after_colon(text: Column) -> Column:
    return F.nullif(F.split_part(text, F.lit(": "), F.lit(2)), F.lit(""))


def todays_hours(hours: Column, t: Column) -> Column:
    """Text of today's entry, found by weekday name."""
    name = F.date_format(t, "EEEE")
    entry = F.try_element_at(
        F.filter(hours["weekday_text"], lambda d: d.startswith(name)), F.lit(1)
    )
    return (
        F.when(hours.isNull() | hours["weekday_text"].isNull(), NOT_AVAILABLE)
        .when(F.coalesce(hours["always_open"], F.lit(False)), ALWAYS)
        .otherwise(F.coalesce(_after_colon(entry), entry, F.lit(NOT_AVAILABLE)))
    )


def hours_summary(hours: Column) -> Column:
    texts = hours["weekday_text"]
    first = _after_colon(F.try_element_at(texts, F.lit(1)))
    same = F.forall(texts, lambda d: d.contains(first))
    return (
        F.when(hours.isNull(), NOT_AVAILABLE)
        .when(F.coalesce(hours["always_open"], F.lit(False)), ALWAYS)
        .when(texts.isNull() | (F.size(texts) == 0), SEE_MAPS)
        .when(same, first)
        .otherwise(F.concat(first, F.lit(" (varies)")))
    )


def has_seasonal_hours(hours: Column) -> Column:
    text = F.lower(F.array_join(hours["weekday_text"], " "))
    return F.coalesce(text.rlike("|".join(SEASONAL_HOURS_WORDS)), F.lit(False))


def closes_early(hours: Column, before: int = 1800) -> Column:
    """More than half of the known closing times lie before ``before``."""
    closes = F.filter(
        F.transform(hours["periods"], lambda p: _hhmm(p["close"])), lambda c: c.isNotNull()
    )
    early = F.filter(closes, lambda c: c < before)
    majority = F.size(early) * 2 > F.size(closes)
    return F.when(F.coalesce(hours["always_open"], F.lit(False)), F.lit(False)).otherwise(
        F.coalesce(majority, F.lit(False))
    )


def format_hours(opening: Column) -> Column:
    """Stored form of a lookup's opening hours: unknown, always open or standard."""
    periods = opening["periods"]
    unknown = opening.isNull() | periods.isNull()
    always = (F.size(periods) == 1) & periods[0]["close"].isNull()
    none = F.lit(None)
    kept = (
        F.when(unknown, F.array().cast(PERIODS_DDL))
        .when(always, none.cast(PERIODS_DDL))
        .otherwise(periods)
    )
    return F.struct(
        F.when(unknown, "unknown").when(always, "always_open").otherwise("standard").alias("type"),
        F.coalesce(always & ~unknown, F.lit(False)).alias("always_open"),
        F.when(always & ~unknown, ALWAYS).alias("text"),
        kept.alias("periods"),
        F.when(
            ~unknown & ~always, F.coalesce(opening["weekday_text"], string_array(()))
        ).alias("weekday_text"),
    )
