"""Explicit schemas of the model as DDL text; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_PERIOD_POINT = "STRUCT<day: INT, time: STRING, hour: INT, minute: INT>"
PERIODS_DDL = f"ARRAY<STRUCT<open: {_PERIOD_POINT}, close: {_PERIOD_POINT}>>"
HOURS_DDL = (
    "STRUCT<type: STRING, always_open: BOOLEAN, text: STRING, "
    f"periods: {PERIODS_DDL}, weekday_text: ARRAY<STRING>>"
)

CITIES = (
    "id INT, name STRING, slug STRING, state STRING, country STRING, timezone STRING, "
    "center_lat DECIMAL(10,8), center_lng DECIMAL(11,8), created_at TIMESTAMP"
)

PLACES = (
    "id BIGINT, city_id INT, name STRING, slug STRING, category STRING, neighborhood STRING, "
    "address STRING, lat DECIMAL(10,8), lng DECIMAL(11,8), walk_minutes_from_center INT, "
    "vibe_quiet DECIMAL(3,2), vibe_inside DECIMAL(3,2), vibe_active DECIMAL(3,2), "
    f"story STRING, nudge STRING, hours {HOURS_DDL}, best_times ARRAY<STRING>, "
    "kid_friendly BOOLEAN, low_energy BOOLEAN, wheelchair_accessible BOOLEAN, price_level INT, "
    "tags ARRAY<STRING>, website STRING, phone STRING, embedding ARRAY<FLOAT>, "
    "external_place_id STRING, last_synced_at TIMESTAMP, rating DECIMAL(2,1), ratings_total INT, "
    "business_status STRING, seasons ARRAY<STRING>, is_active BOOLEAN, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)

EVENTS = (
    "id BIGINT, city_id INT, place_id BIGINT, title STRING, slug STRING, description STRING, "
    "start_time TIMESTAMP, end_time TIMESTAMP, is_recurring BOOLEAN, recurrence_rule STRING, "
    "venue_name STRING, venue_address STRING, lat DECIMAL(10,8), lng DECIMAL(11,8), "
    "neighborhood STRING, vibe_quiet DECIMAL(3,2), vibe_inside DECIMAL(3,2), "
    "vibe_active DECIMAL(3,2), primary_category STRING, categories ARRAY<STRING>, "
    "tags ARRAY<STRING>, kid_friendly BOOLEAN, low_energy BOOLEAN, wheelchair_accessible BOOLEAN, "
    "is_free BOOLEAN, price_min DECIMAL(10,2), price_max DECIMAL(10,2), price_description STRING, "
    "website STRING, rsvp_link STRING, ticket_link STRING, image_url STRING, source STRING, "
    "source_id STRING, source_url STRING, embedding ARRAY<FLOAT>, is_active BOOLEAN, "
    "scraped_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
)

RECOMMENDATIONS = (
    "id BIGINT, city_id INT, time_available INT, quiet_social DECIMAL(3,2), "
    "inside_outside DECIMAL(3,2), kid_friendly BOOLEAN, low_energy BOOLEAN, "
    "requested_at TIMESTAMP, time_of_day STRING, day_of_week STRING, results STRING, "
    "selected_id BIGINT, selected_type STRING, feedback_rating INT, created_at TIMESTAMP"
)

STAGED = (
    "id BIGINT, source STRING, source_id STRING, raw_data STRING, scraped_at TIMESTAMP, "
    "processed BOOLEAN, processed_at TIMESTAMP, event_id BIGINT"
)

DETAILS_PAYLOAD_DDL = (
    "displayName STRUCT<text: STRING>, formattedAddress STRING, internationalPhoneNumber STRING, "
    "websiteUri STRING, regularOpeningHours STRUCT<openNow: BOOLEAN, "
    f"periods: {PERIODS_DDL}, weekdayDescriptions: ARRAY<STRING>>, rating DOUBLE, "
    "userRatingCount INT, location STRUCT<latitude: DOUBLE, longitude: DOUBLE>, "
    "priceLevel STRING, businessStatus STRING"
)

LOOKUP_PAYLOAD_DDL = (
    "places ARRAY<STRUCT<id: STRING, displayName: STRUCT<text: STRING>, formattedAddress: STRING, "
    "location: STRUCT<latitude: DOUBLE, longitude: DOUBLE>>>"
)

WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

VERIFIED_HOURS_DDL = (
    "verified_date STRING, places ARRAY<STRUCT<name: STRING, address: STRING, hours: STRUCT<"
    + ", ".join(f"{d}: STRING" for d in WEEKDAYS)
    + ">, notes: STRING, source: STRING>>"
)

WORKLIST_DDL = (
    "breweries_to_verify ARRAY<STRUCT<name: STRING, location: STRING, "
    "search_query: STRING, notes: STRING>>"
)

PLACES_CSV = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "ID", "Name", "Type", "Neighborhood", "Story", "Nudge", "Vibe: Quiet", "Vibe: Inside",
            "Vibe: Active", "Tags", "Price Level", "Has Embedding", "Active", "Created At",
        )
    ]
)
