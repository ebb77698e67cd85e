"""Scans, the candidate view, filters and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from outings.bindings import AS_OF, open_sql, with_model
from outings.functions.hours import is_open
from outings.functions.text import article_is_event, hours_unverified
from outings.functions.times import season_of, ts
from outings.operators import filters
from outings.operators.activities import upcoming
from outings.operators.quality import (
    PRICE_LEVELS, VIBE_RANGES, event_checks, out_of_range, rejected_rows, valid_rows,
)
from outings.plans.registry import query

CHECK_TIMES = (AS_OF, "2024-01-16 10:30:00", "2024-01-20 18:45:00", "2024-01-21 01:15:00")


@query(
    "scan_places",
    with_model("SELECT id, name, category, city_id, vibe_quiet, price_level FROM places "
               "WHERE is_active"),
)
def scan_places(t):
    return t.places.filter("is_active").select(
        "id", "name", "category", "city_id", "vibe_quiet", "price_level"
    )


@query(
    "activities",
    with_model(
        "SELECT type, id, city_id, title, category, neighborhood, vibe_quiet, vibe_inside, "
        "vibe_active, description, kid_friendly, low_energy, array_to_string(tags, ',') AS tags, "
        "array_to_string(best_times, ',') AS best_times, array_to_string(seasons, ',') AS seasons, "
        "walk_minutes_from_center, start_time, end_time, is_active, price_level, source, "
        "external_place_id, business_status FROM activities"
    ),
)
def activities_view(t):
    lists = ("tags", "best_times", "seasons")
    return t.activities().select(
        "type", "id", "city_id", "title", "category", "neighborhood", "vibe_quiet", "vibe_inside",
        "vibe_active", "description", "kid_friendly", "low_energy",
        *[F.array_join(c, ",").alias(c) for c in lists], "walk_minutes_from_center", "start_time",
        "end_time", "is_active", "price_level", "source", "external_place_id", "business_status",
    )


_ASKED_CITY = (
    "CASE {c} % 6 WHEN 0 THEN 'africa' WHEN 1 THEN 'america' WHEN 2 THEN 'asia' "
    "WHEN 3 THEN 'europe' WHEN 4 THEN 'middle east' ELSE 'nowhere' END"
)


@query(
    "city_by_slug",
    with_model(
        f"SELECT request_id, c.id AS city_id, c.timezone AS timezone FROM (SELECT request_id, "
        f"{_ASKED_CITY.format(c='request_id')} AS slug FROM requests) r "
        "JOIN cities c ON c.slug = r.slug"
    ),
)
def city_by_slug(t):
    asked = t.requests.select(
        "request_id", F.expr(_ASKED_CITY.format(c="request_id")).alias("slug")
    )
    cities = t.cities.select("slug", F.col("id").alias("city_id"), "timezone")
    return asked.join(cities, "slug").select("request_id", "city_id", "timezone")


@query(
    "active_filter",
    with_model("SELECT type, id FROM activities WHERE is_active AND (business_status IS NULL "
               "OR business_status = 'OPERATIONAL')"),
)
def active_filter(t):
    return t.activities().filter(filters.is_operational()).select("type", "id")


@query(
    "location_filter",
    with_model(
        "SELECT w.wish, type, id FROM activities, "
        "(SELECT unnest(['inside', 'outside', 'either']) AS wish) w WHERE "
        "(w.wish = 'inside' AND vibe_inside >= 0.6e0) OR (w.wish = 'outside' "
        "AND vibe_inside <= 0.4e0) OR w.wish = 'either'"
    ),
)
def location_filter(t):
    wishes = F.array(*[F.lit(w) for w in ("inside", "outside", "either")])
    return (
        t.activities()
        .select("type", "id", "vibe_inside", F.explode(wishes).alias("wish"))
        .filter(filters.location_matches(F.col("vibe_inside"), F.col("wish")))
        .select("wish", "type", "id")
    )


@query("kid_filter", with_model("SELECT type, id FROM activities WHERE kid_friendly"))
def kid_filter(t):
    return t.activities().filter(filters.kid_gate(F.lit(True))).select("type", "id")


@query(
    "season_filter",
    with_model("SELECT type, id FROM activities WHERE seasons IS NULL "
               "OR list_contains(seasons, 'winter')"),
)
def season_filter(t):
    return t.activities().filter(filters.season_gate(season_of(ts(AS_OF)))).select("type", "id")


@query(
    "time_budget_filter",
    with_model(
        "SELECT type, id FROM activities WHERE type <> 'place' OR walk_minutes_from_center IS NULL "
        "OR walk_minutes_from_center <= 0 OR walk_minutes_from_center * 2 + 30 <= 90"
    ),
)
def time_budget_filter(t):
    return t.activities().filter(filters.fits_time(F.lit(90))).select("type", "id")


@query(
    "event_date_filter",
    with_model("SELECT type, id FROM activities WHERE type <> 'event' OR start_time IS NULL "
               "OR start_time >= TIMESTAMP '2024-01-20 12:00:00'"),
)
def event_date_filter(t):
    return (
        t.activities()
        .filter(filters.starts_by_request(ts("2024-01-20 12:00:00")))
        .select("type", "id")
    )


@query(
    "open_now_filter",
    with_model(
        " UNION ALL ".join(
            f"SELECT '{c}' AS checked_at, type, id FROM activities WHERE type <> 'place' "
            f"OR {open_sql(c)}"
            for c in CHECK_TIMES
        )
    ),
)
def open_now_filter(t):
    checks = F.array(*[F.lit(c) for c in CHECK_TIMES])
    return (
        t.activities()
        .withColumn("checked_at", F.explode(checks))
        .filter(filters.open_at(F.col("checked_at").cast("timestamp")))
        .select("checked_at", "type", "id")
    )


@query(
    "search_by_name",
    with_model(
        "SELECT id, name, coalesce(business_status, 'OPERATIONAL') AS status, "
        "coalesce(external_place_id, 'N/A') AS external_place_id FROM places "
        "WHERE name ILIKE '%ring%'"
    ),
)
def search_by_name(t):
    return filters.search_by_name(t.places, "RING")


_ARTICLE_TITLE = (
    "concat(p_name, ' ', CASE p_type WHEN 'PROMO' THEN 'Show' WHEN 'LARGE' THEN 'Farmers Market' "
    "WHEN 'SMALL' THEN 'FESTIVAL' ELSE p_brand END)"
)
_ARTICLE_CATEGORY = (
    "CASE p_size % 5 WHEN 0 THEN 'Local Events' WHEN 1 THEN NULL ELSE 'Food' END"
)


@query(
    "article_is_event",
    f"SELECT p_partkey AS id, {_ARTICLE_TITLE} AS title FROM part WHERE "
    f"lower(coalesce({_ARTICLE_CATEGORY}, '')) LIKE '%event%' OR regexp_matches("
    f"lower({_ARTICLE_TITLE}), 'event|happening|festival|concert|show|market')",
)
def article_filter(t):
    articles = t.raw("part").selectExpr(
        "p_partkey AS id", f"{_ARTICLE_TITLE} AS title", f"{_ARTICLE_CATEGORY} AS category"
    )
    return articles.filter(article_is_event(F.col("title"), F.col("category"))).select(
        "id", "title"
    )


_STALE = (
    "SELECT id, name FROM places WHERE is_active AND (external_place_id IS NULL "
    f"OR last_synced_at IS NULL OR last_synced_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)"
)


@query("stale_places", with_model(_STALE))
def stale_places(t):
    return filters.stale_places(t.places, AS_OF).select("id", "name")


@query("stale_places_limited", with_model(f"{_STALE} ORDER BY id LIMIT 50"))
def stale_places_limited(t):
    return filters.stale_places(t.places, AS_OF, limit=50).select("id", "name")


@query(
    "embedding_backlog",
    with_model(
        "SELECT 'place' AS type, id FROM places WHERE is_active AND vec_id IS NULL UNION ALL "
        "SELECT 'event', id FROM acts_events WHERE is_active AND vec_id IS NULL "
        f"AND start_time > TIMESTAMP '{AS_OF}'"
    ),
)
def embedding_backlog(t):
    places = filters.embedding_backlog(t.places, "vec_id")
    events = filters.embedding_backlog(t.events, "vec_id", AS_OF)
    return places.select(F.lit("place").alias("type"), "id").unionAll(
        events.select(F.lit("event").alias("type"), "id")
    )


@query(
    "upcoming_events",
    with_model("SELECT id, title, start_time FROM acts_events WHERE start_time > "
               f"TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR"),
)
def upcoming_events(t):
    return upcoming(t.events, AS_OF).select("id", "title", "start_time")


_BATCH = [
    "id",
    "CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN '' ELSE title END AS title",
    "CASE WHEN id % 23 = 0 THEN NULL ELSE start_time END AS start_time",
]
_BATCH_SQL = f", batch AS (SELECT {', '.join(_BATCH)} FROM acts_events) "


@query(
    "valid_rows",
    with_model(_BATCH_SQL + "SELECT id, title, start_time FROM batch WHERE title <> '' "
               "AND start_time IS NOT NULL"),
)
def valid(t):
    return valid_rows(t.events.selectExpr(*_BATCH), event_checks())


@query(
    "rejected_rows",
    with_model(
        _BATCH_SQL + "SELECT id, CASE WHEN coalesce(title, '') = '' THEN 'missing title' "
        "ELSE 'missing start_time' END AS reason FROM batch WHERE coalesce(title, '') = '' "
        "OR start_time IS NULL"
    ),
)
def rejected(t):
    return rejected_rows(t.events.selectExpr(*_BATCH), event_checks()).select("id", "reason")


_RANGED = "CASE WHEN id % 10 = 0 THEN 1.5e0 WHEN id % 10 = 1 THEN NULL ELSE vibe_quiet END"


@query(
    "range_rejected",
    with_model(
        f"SELECT id, CASE WHEN quiet NOT BETWEEN 0 AND 1 THEN 'vibe_quiet out of range' ELSE 'price_level out of range' "
        f"END AS reason FROM (SELECT id, {_RANGED} AS quiet, id % 6 AS price FROM places) p "
        "WHERE quiet NOT BETWEEN 0 AND 1 OR price NOT BETWEEN 1 AND 4"
    ),
)
def range_rejected(t):
    """Rows outside the value ranges that the stored tables allow; NULL passes."""
    rows = t.places.withColumns({"vibe_quiet": F.expr(_RANGED), "price_level": F.col("id") % 6})
    checks = {**out_of_range(**VIBE_RANGES), **out_of_range(**PRICE_LEVELS)}
    return rejected_rows(rows, checks).select("id", "reason")


_AVAILABILITY = (
    "CASE WHEN id % 7 = 0 THEN 'by appointment' WHEN id % 11 <> 0 THEN concat('{open:0', "
    "CAST(id % 10 AS STRING), ':00, kind:', category_word, ',\\n            note: \"', name, ', grill, pub\", "
    "hours_verified:', CASE WHEN id % 3 = 0 THEN 'true' ELSE 'false' END, '}') END"
)


@query(
    "hours_unverified",
    with_model("SELECT id FROM places WHERE id % 7 <> 0 AND id % 11 <> 0 AND id % 3 <> 0"),
)
def unverified(t):
    sheet = t.places.select("id", "name", F.lit("regular").alias("category_word")).withColumn(
        "availability", F.expr(_AVAILABILITY)
    )
    return sheet.filter(hours_unverified(F.col("availability"))).select("id")


@query(
    "activity_details",
    with_model("SELECT 'place' AS type, id, name AS title FROM places WHERE id = 7 UNION ALL "
               "SELECT 'event', id, title FROM acts_events WHERE id = 11"),
)
def activity_details(t):
    place = filters.activity_details(t.places, t.events, "place", 7)
    event = filters.activity_details(t.places, t.events, "event", 11)
    return place.select(F.lit("place").alias("type"), "id", F.col("name").alias("title")).unionAll(
        event.select(F.lit("event").alias("type"), "id", "title")
    )


@query(
    "event_time_range",
    with_model(
        "SELECT type, id FROM activities WHERE (type = 'place' OR start_time BETWEEN "
        "TIMESTAMP '2024-01-18 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00') "
        "AND walk_minutes_from_center <= 90 / 2e0"
    ),
)
def event_time_range(t):
    keep = filters.in_time_range("2024-01-18 00:00:00", "2024-01-20 00:00:00", F.lit(90))
    return t.activities().filter(keep).select("type", "id")


@query(
    "client_projection",
    with_model(
        "SELECT id, title AS name, type, neighborhood, vibe_quiet, vibe_inside, "
        "coalesce(array_to_string(best_times, ','), '') AS best_times, "
        "walk_minutes_from_center AS walk_minutes, description AS story, "
        "'Enjoy your visit!' AS nudge, array_to_string(tags, ',') AS tags, "
        "'Check website' AS hours, CASE WHEN external_place_id IS NOT NULL THEN "
        "concat('https://www.google.com/maps/place/?q=place_id:', external_place_id) "
        "WHEN lat IS NULL OR lng IS NULL THEN NULL ELSE "
        "concat('https://www.google.com/maps/search/?api=1&query=', CAST(lat AS VARCHAR), ',', "
        "CAST(lng AS VARCHAR)) END AS map_url, kid_friendly, low_energy FROM activities"
    ),
)
def client_projection(t):
    cards = filters.client_projection(t.activities())
    return cards.withColumns({c: F.array_join(c, ",") for c in ("best_times", "tags")})


@query(
    "map_url",
    with_model(
        "SELECT id, CASE WHEN external_place_id IS NOT NULL THEN "
        "concat('https://www.google.com/maps/place/?q=place_id:', external_place_id) "
        "WHEN lat IS NULL THEN NULL ELSE concat("
        "'https://www.google.com/maps/search/?api=1&query=', CAST(lat AS VARCHAR), ',', "
        "CAST(lng AS VARCHAR)) END AS map_url FROM places"
    ),
)
def map_links(t):
    from outings.functions.text import map_url

    return t.places.select(
        "id", map_url(F.col("external_place_id"), F.col("lat"), F.col("lng")).alias("map_url")
    )


@query(
    "places_sorted",
    with_model(
        "SELECT id, category, name, CASE WHEN seasons = ['winter'] THEN 1 "
        "WHEN seasons = ['summer'] THEN 2 ELSE 3 END AS season_rank FROM places"
    ),
)
def places_sorted(t):
    season = (
        F.when((F.size("seasons") == 1) & F.array_contains("seasons", "winter"), 1)
        .when((F.size("seasons") == 1) & F.array_contains("seasons", "summer"), 2)
        .otherwise(3)
    )
    return t.places.select("id", "category", "name", season.alias("season_rank")).orderBy(
        "season_rank", "category", "name", "id"
    )


@query(
    "is_open",
    with_model(
        " UNION ALL ".join(
            f"SELECT '{c}' AS checked_at, id, {open_sql(c)} AS is_open FROM places"
            for c in CHECK_TIMES
        )
    ),
)
def open_flags(t):
    checks = F.array(*[F.lit(c) for c in CHECK_TIMES])
    return t.places.select("id", "hours", F.explode(checks).alias("checked_at")).select(
        "checked_at", "id",
        is_open(F.col("hours"), F.col("checked_at").cast("timestamp")).alias("is_open"),
    )


