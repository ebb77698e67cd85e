"""Monitoring aggregates and popularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from outings.functions.times import ts, week_bucket

_RESULT = "array<struct<type: string, id: bigint>>"


def coming(events: DataFrame, as_of) -> DataFrame:
    return events.filter(F.col("is_active") & (F.col("start_time") > ts(as_of)))


def stats_counts(places: DataFrame, events: DataFrame, log: DataFrame, as_of) -> DataFrame:
    """One row: active places, active future events, logged recommendations."""
    counts = [
        places.agg(F.count_if("is_active").alias("places")),
        coming(events, as_of).agg(F.count(F.lit(1)).alias("events")),
        log.agg(F.count(F.lit(1)).alias("recommendations")),
    ]
    tagged = [
        df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("bigint")).alias(c)
                    for c in ("places", "events", "recommendations")])
        for df in counts
    ]
    rows = tagged[0].unionAll(tagged[1]).unionAll(tagged[2])
    return rows.agg(*[F.max(c).alias(c) for c in ("places", "events", "recommendations")])


def events_by_source(events: DataFrame, as_of) -> DataFrame:
    return coming(events, as_of).groupBy("source").agg(F.count(F.lit(1)).alias("count"))


def upcoming_by_week(events: DataFrame, as_of, weeks: int = 4) -> DataFrame:
    return (
        coming(events, as_of)
        .groupBy(week_bucket(F.col("start_time")).alias("week"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("week")
        .limit(weeks)
    )


def scrape_health(events: DataFrame, as_of) -> DataFrame:
    last = F.max("scraped_at")
    return events.groupBy("source").agg(
        F.count(F.lit(1)).alias("events"),
        last.alias("last_scrape"),
        (F.unix_timestamp(ts(as_of)) - F.unix_timestamp(F.date_trunc("second", last))).alias(
            "seconds_since"
        ),
    )


def latest_event_by_source(events: DataFrame) -> DataFrame:
    return (
        events.filter("is_active")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("events"), F.max("start_time").alias("latest_event"))
    )


def embedding_coverage(acts: DataFrame, embedding: str = "embedding") -> DataFrame:
    n, known = F.count(F.lit(1)), F.count(F.col(embedding))
    percent = F.when(n > 0, F.floor(known * 10000.0 / n + 0.5) / 100.0)
    return acts.agg(
        n.alias("total"), known.alias("with_embeddings"), percent.alias("coverage_percent")
    )


def embedding_counts(places: DataFrame, events: DataFrame, as_of, embedding="embedding"):
    """Per table: active rows and rows with a vector; of events only those to come."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.lit(name).alias("table_name"),
            F.count(F.col(embedding)).alias("with_embeddings"),
            F.count_if("is_active").alias("total"),
        )

    future = events.filter(F.col("start_time") > ts(as_of))
    return counted(places, "places").unionAll(counted(future, "events"))


def places_by_type(places: DataFrame) -> DataFrame:
    counted = places.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "category")


def tag_distribution(places: DataFrame) -> DataFrame:
    return (
        places.select(F.explode("tags").alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def neighborhood_spread(results: DataFrame, acts: DataFrame) -> DataFrame:
    """How ranked results cluster: results and distinct requests per neighborhood."""
    where = acts.select("type", "id", "neighborhood")
    return (
        results.join(where, ["type", "id"])
        .groupBy("neighborhood")
        .agg(F.count(F.lit(1)).alias("results"),
             F.count_distinct("request_id").alias("requests"))
    )


def log_items(log: DataFrame) -> DataFrame:
    """One row per logged result; the JSON may be a list or an object with ``results``."""
    stored = F.try_parse_json("results")
    items = F.coalesce(
        F.try_variant_get(stored, "$.results", _RESULT), F.try_variant_get(stored, "$", _RESULT)
    )
    return log.select("*", F.inline(items)) if "type" not in log.columns else log


def popular_recommendations(
    log: DataFrame, acts: DataFrame, as_of, days: int = 7, limit: int = 10
) -> DataFrame:
    """Most often recommended titles of the last days.

    Results are counted per (type, id) before the join, so a very popular item
    reaches it as one row.
    """
    recent = log.filter(F.col("requested_at") > ts(as_of) - F.expr(f"INTERVAL '{days}' DAY"))
    items = log_items(recent.select("requested_at", "results") if "results" in log.columns
                      else recent)
    counted = items.groupBy("type", "id").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.join(acts.select("type", "id", "title"), ["type", "id"])
        .groupBy("type", "title")
        .agg(F.sum("n").alias("recommended_count"))
        .orderBy(F.desc("recommended_count"), "type", "title")
        .limit(limit)
    )
