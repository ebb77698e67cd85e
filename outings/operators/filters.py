"""Predicates on candidates. All are expressions, so they reach the scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from outings.functions.hours import is_open
from outings.functions.scoring import needed_minutes
from outings.functions.times import ts

INSIDE_FROM, OUTSIDE_TO = 0.6, 0.4


def is_operational() -> Column:
    status = F.col("business_status")
    return F.col("is_active") & (status.isNull() | (status == "OPERATIONAL"))


def location_matches(vibe_inside: Column, location: Column) -> Column:
    """Inside or outside wanted; an unknown vibe never matches a wish."""
    return (
        F.when(location == "inside", F.coalesce(vibe_inside >= INSIDE_FROM, F.lit(False)))
        .when(location == "outside", F.coalesce(vibe_inside <= OUTSIDE_TO, F.lit(False)))
        .otherwise(F.lit(True))
    )


def location_band(vibe_inside: Column) -> Column:
    """Which location wish a vibe satisfies, for grouping candidates."""
    return F.when(vibe_inside >= INSIDE_FROM, "inside").when(
        vibe_inside <= OUTSIDE_TO, "outside"
    )


def band_matches(band: Column, location: Column) -> Column:
    wanted = location.isin("inside", "outside")
    return F.when(F.coalesce(wanted, F.lit(False)), F.coalesce(band == location, F.lit(False))
                  ).otherwise(F.lit(True))


def kid_gate(wanted: Column) -> Column:
    return ~wanted | F.coalesce(F.col("kid_friendly"), F.lit(False))


def season_gate(season: Column) -> Column:
    return F.col("seasons").isNull() | F.array_contains(F.col("seasons"), season)


def fits_time(available: Column, type_: Column | None = None) -> Column:
    """Places with a walk must fit the time; everything else passes."""
    kind = F.col("type") if type_ is None else type_
    needed = needed_minutes(F.col("walk_minutes_from_center"))
    return (kind != "place") | needed.isNull() | (needed <= available)


def starts_by_request(requested: Column) -> Column:
    """Events that start before the requested time drop out."""
    return (F.col("type") != "event") | F.col("start_time").isNull() | (
        F.col("start_time") >= requested
    )


def open_at(t: Column, strict: bool = False) -> Column:
    return (F.col("type") != "place") | is_open(F.col("hours"), t, strict)


def in_time_range(start, end, available: Column) -> Column:
    """The documented filter: places, or events in a range; walk at most half the time."""
    inside = F.col("start_time").between(ts(start), ts(end))
    return ((F.col("type") == "place") | inside) & (
        F.col("walk_minutes_from_center") <= available / 2
    )


def search_by_name(places: DataFrame, term: str) -> DataFrame:
    return (
        places.filter(F.col("name").ilike(f"%{term}%"))
        .select(
            "id", "name",
            F.coalesce("business_status", F.lit("OPERATIONAL")).alias("status"),
            F.coalesce("external_place_id", F.lit("N/A")).alias("external_place_id"),
        )
        .orderBy("name", "id")
    )


def stale_places(places: DataFrame, as_of, sync_all: bool = False, limit: int | None = None):
    """Active places due for a details lookup, oldest id first."""
    due = (
        F.col("external_place_id").isNull()
        | F.col("last_synced_at").isNull()
        | (F.col("last_synced_at") < ts(as_of) - F.expr("INTERVAL '7' DAY"))
    )
    out = places.filter(F.col("is_active"))
    out = (out if sync_all else out.filter(due)).orderBy("id")
    return out.limit(limit) if limit else out


def embedding_backlog(df: DataFrame, embedding: str = "embedding", as_of=None, force=False):
    """Active rows without a vector; for events also only those still to come."""
    out = df.filter(F.col("is_active"))
    if as_of is not None:
        out = out.filter(F.col("start_time") > ts(as_of))
    return out if force else out.filter(F.col(embedding).isNull())


def activity_details(places: DataFrame, events: DataFrame, kind: str, id_: int) -> DataFrame:
    """One row by id from places, or from events for any other kind."""
    return (places if kind == "place" else events).filter(F.col("id") == id_)


def client_projection(acts: DataFrame) -> DataFrame:
    """Columns as the client shows them, with its defaults."""
    from outings.functions.rules import string_array
    from outings.functions.text import map_url

    none = string_array(())
    return acts.select(
        "id",
        F.col("title").alias("name"),
        "type",
        "neighborhood",
        F.col("vibe_quiet").cast("double").alias("vibe_quiet"),
        F.col("vibe_inside").cast("double").alias("vibe_inside"),
        F.coalesce("best_times", none).alias("best_times"),
        F.col("walk_minutes_from_center").alias("walk_minutes"),
        F.col("description").alias("story"),
        F.coalesce(F.nullif(F.col("nudge"), F.lit("")), F.lit("Enjoy your visit!")).alias("nudge"),
        F.coalesce("tags", none).alias("tags"),
        F.lit("Check website").alias("hours"),
        map_url(F.col("external_place_id"), F.col("lat"), F.col("lng")).alias("map_url"),
        "kid_friendly",
        "low_energy",
    )
