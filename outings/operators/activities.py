"""The unified candidate view: places and upcoming events, columns aligned."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from outings.functions.times import ts

# Columns of the view and their types; a source column that is missing reads as NULL.
VIEW = {
    "type": "string", "id": "bigint", "city_id": "int", "title": "string", "category": "string",
    "neighborhood": "string", "lat": "double", "lng": "double", "vibe_quiet": "double",
    "vibe_inside": "double", "vibe_active": "double", "description": "string", "nudge": "string",
    "kid_friendly": "boolean", "low_energy": "boolean", "tags": "array<string>",
    "best_times": "array<string>", "seasons": "array<string>", "walk_minutes_from_center": "int",
    "start_time": "timestamp", "end_time": "timestamp", "is_active": "boolean",
    "price_level": "int", "venue_name": "string", "source": "string",
    "external_place_id": "string", "rating": "double", "ratings_total": "int",
    "business_status": "string",
}
# Carried through when a side has them; the type comes from that side.
OPTIONAL = ("hours", "embedding", "vec_id")


def upcoming(events: DataFrame, as_of, grace: str = "2 hours") -> DataFrame:
    return events.filter(F.col("start_time") > ts(as_of) - F.expr(f"INTERVAL '{grace}'"))


def _aligned(df: DataFrame, fixed: dict[str, str]) -> DataFrame:
    """View columns as SQL text: fixed ones, those of ``df``, NULL for the rest."""
    have = set(df.columns)

    def column(name: str, kind: str) -> str:
        source = fixed.get(name) or (f"`{name}`" if name in have else "NULL")
        return f"CAST({source} AS {kind}) AS `{name}`"

    extra = [c for c in OPTIONAL if c in have]
    return df.selectExpr(*[column(n, k) for n, k in VIEW.items()], *extra)


def activities(places: DataFrame, events: DataFrame, as_of, default_active=0.5) -> DataFrame:
    """UNION ALL of places and events that start after ``as_of`` minus two hours."""
    place_side = _aligned(
        places,
        {
            "type": "'place'",
            "title": "name",
            "description": "story" if "story" in places.columns else "NULL",
            "source": "NULL",
            "start_time": "NULL",
            "end_time": "NULL",
            "venue_name": "NULL",
        },
    )
    not_for_events = (
        "category", "nudge", "best_times", "seasons", "walk_minutes_from_center", "price_level",
        "external_place_id", "rating", "ratings_total",
    )
    fixed = {"type": "'event'", "business_status": "'OPERATIONAL'"}
    fixed |= dict.fromkeys(not_for_events, "NULL")
    if "vibe_active" not in events.columns:
        fixed["vibe_active"] = f"{default_active}D"
    event_side = _aligned(upcoming(events, as_of), fixed)
    return place_side.unionByName(event_side, allowMissingColumns=True)
