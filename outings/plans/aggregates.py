"""Monitoring aggregates, popularity and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from outings.bindings import AS_OF, LOG_AS_OF, with_model
from outings.functions.hours import closes_early
from outings.functions.text import parse_price
from outings.operators import stats
from outings.operators.recommend import recommend_many, vibe_model
from outings.plans.ranking import VIBE_SQL
from outings.plans.registry import query

_COMING = f"is_active AND start_time > TIMESTAMP '{AS_OF}'"


@query(
    "stats_counts",
    with_model(
        "SELECT (SELECT count(*) FROM places WHERE is_active) AS places, "
        f"(SELECT count(*) FROM acts_events WHERE {_COMING}) AS events, "
        "(SELECT count(*) FROM orders) AS recommendations"
    ),
)
def stats_counts(t):
    return stats.stats_counts(t.places, t.events, t.raw("orders"), AS_OF)


@query(
    "events_by_source",
    with_model(f'SELECT source, count(*) AS "count" FROM acts_events WHERE {_COMING} '
               "GROUP BY source"),
)
def events_by_source(t):
    return stats.events_by_source(t.events, AS_OF)


@query(
    "upcoming_by_week",
    with_model(
        "SELECT CAST(date_trunc('week', start_time) AS TIMESTAMP) AS week, count(*) AS \"count\" "
        f"FROM acts_events WHERE {_COMING} GROUP BY 1 ORDER BY 1 LIMIT 4"
    ),
)
def upcoming_by_week(t):
    return stats.upcoming_by_week(t.events, AS_OF)


@query(
    "scrape_health",
    with_model(
        "SELECT source, count(*) AS events, max(scraped_at) AS last_scrape, "
        f"CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(date_trunc('second', max(scraped_at))) AS BIGINT) "
        "AS seconds_since FROM acts_events GROUP BY source"
    ),
)
def scrape_health(t):
    return stats.scrape_health(t.events, AS_OF)


@query(
    "latest_event_by_source",
    with_model("SELECT source, count(*) AS events, max(start_time) AS latest_event "
               "FROM acts_events WHERE is_active GROUP BY source"),
)
def latest_event_by_source(t):
    return stats.latest_event_by_source(t.events)


@query(
    "embedding_coverage",
    with_model(
        "SELECT count(*) AS total, count(vec_id) AS with_embeddings, "
        "floor(count(vec_id) * 10000e0 / count(*) + 0.5e0) / 100e0 AS coverage_percent "
        "FROM activities"
    ),
)
def embedding_coverage(t):
    return stats.embedding_coverage(t.activities(), "vec_id")


@query(
    "embedding_counts",
    with_model(
        "SELECT 'places' AS table_name, count(vec_id) AS with_embeddings, "
        "count(*) FILTER (WHERE is_active) AS total FROM places UNION ALL SELECT 'events', "
        "count(vec_id), count(*) FILTER (WHERE is_active) FROM acts_events "
        f"WHERE start_time > TIMESTAMP '{AS_OF}'"
    ),
)
def embedding_counts(t):
    return stats.embedding_counts(t.places, t.events, AS_OF, "vec_id")


@query(
    "places_by_type",
    with_model('SELECT category, count(*) AS "count" FROM places GROUP BY category'),
)
def places_by_type(t):
    return stats.places_by_type(t.places)


@query(
    "tag_distribution",
    with_model('SELECT tag, count(*) AS "count" FROM (SELECT unnest(tags) AS tag FROM places) '
               "GROUP BY tag"),
)
def tag_distribution(t):
    return stats.tag_distribution(t.places)


@query(
    "neighborhood_spread",
    with_model(
        VIBE_SQL
        + "SELECT neighborhood, count(*) AS results, count(DISTINCT request_id) AS requests "
        "FROM ranked k JOIN activities a ON a.type = k.type AND a.id = k.id WHERE rank <= 3 "
        "GROUP BY neighborhood"
    ),
)
def neighborhood_spread(t):
    best = recommend_many(t.requests, t.activities(), vibe_model(AS_OF))
    return stats.neighborhood_spread(best, t.activities())


_PRICE = (
    "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Free entry' WHEN 2 THEN 'ask at the door' "
    "ELSE concat('$', CAST(user_id AS STRING), '.50 - $', CAST(event_id % 40 AS STRING)) END"
)


@query(
    "price_bounds",
    "SELECT event_id AS id, CASE WHEN event_id % 5 > 2 THEN least(user_id + 0.5e0, event_id % 40) "
    "END AS lowest, CASE WHEN event_id % 5 > 2 THEN greatest(user_id + 0.5e0, event_id % 40) END "
    "AS highest FROM events",
)
def price_bounds(t):
    parsed = t.raw("events").select(
        F.col("event_id").alias("id"), parse_price(F.expr(_PRICE)).alias("p")
    )
    return parsed.select("id", F.col("p.min").alias("lowest"), F.col("p.max").alias("highest"))


@query(
    "parse_price",
    f"SELECT event_id AS id, event_id % 5 < 2 AS is_free, "
    "CASE WHEN event_id % 5 > 2 THEN least(user_id + 0.5e0, event_id % 40) END AS price_min, "
    "CASE WHEN event_id % 5 > 2 THEN greatest(user_id + 0.5e0, event_id % 40) END AS price_max, "
    f"coalesce({_PRICE}, 'Free') AS price_description FROM events",
)
def prices(t):
    parsed = t.raw("events").select(
        F.col("event_id").alias("id"), parse_price(F.expr(_PRICE)).alias("p")
    )
    return parsed.select(
        "id", F.col("p.is_free").alias("is_free"), F.col("p.min").alias("price_min"),
        F.col("p.max").alias("price_max"), F.col("p.description").alias("price_description"),
    )


_CLOSES = (
    "NOT (coalesce(always_open, FALSE) OR no_hours) AND close_hhmm < 1800"
)


def _early(t):
    return t.places.select("id", closes_early(F.col("hours")).alias("closes_early"))


@query(
    "closes_early_majority",
    with_model(
        "SELECT id, NOT (coalesce(always_open, FALSE) OR no_hours) AND id % 8 >= 4 AS closes_early "
        "FROM places"
    ),
)
def early_majority(t):
    """Mixed weeks of six open days: the first ``id % 8`` of them close at 17:00, the others at 21:00."""
    time = lambda i: F.when(i < F.col("id") % 8, "1700").otherwise("2100")
    week = F.transform(F.col("hours.periods"), lambda p, i: p.withField("close.time", time(i)))
    hours = F.col("hours").withField("periods", week)
    return t.places.select("id", closes_early(hours).alias("closes_early"))


query("closes_early", with_model(f"SELECT id, {_CLOSES} AS closes_early FROM places"))(_early)


@query(
    "popular_recommendations",
    with_model(
        "SELECT 'place' AS type, p.name AS title, count(*) AS recommended_count FROM rec_log l "
        f"JOIN places p ON p.id = l.id WHERE l.requested_at > TIMESTAMP '{LOG_AS_OF}' - "
        "INTERVAL 7 DAY GROUP BY p.name ORDER BY recommended_count DESC, type, title LIMIT 10"
    ),
)
def popular(t):
    """The logged lines are first put into both stored JSON forms, then read from them.

    An order has a handful of lines, so the collected list stays short.
    """
    item = F.struct("type", "id", "rank")
    per_request = t.rec_log.groupBy("recommendation_id", "requested_at").agg(
        F.collect_list(item).alias("items")
    )
    as_object = F.to_json(F.struct(F.col("items").alias("results")))
    log = per_request.select(
        "requested_at",
        F.when(F.col("recommendation_id") % 2 == 0, as_object)
        .otherwise(F.to_json("items"))
        .alias("results"),
    )
    titles = t.places.select(F.lit("place").alias("type"), "id", F.col("name").alias("title"))
    return stats.popular_recommendations(log, titles, LOG_AS_OF)
