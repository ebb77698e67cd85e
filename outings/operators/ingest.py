"""From parsed source rows to event rows of the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from outings.functions.rules import (
    ARTICLE_CATEGORIES, ARTICLE_DEFAULT_CATEGORY, CALENDAR_CATEGORIES,
    infer_kid_friendly, infer_vibe_2d, infer_vibe_3d, infer_vibe_jsonld,
    map_categories, match_text, string_array, text_categories, text_user_tags, union_tags,
)
from outings.functions.text import (
    extract_location, parse_price, slugify_words, source_id_article, source_id_card, source_id_ics,
    source_id_jsonld,
)
from outings.functions.times import extract_time, parse_event_date, ts
from outings.operators.quality import event_checks, rejected_rows, valid_rows
from outings.operators.upsert import outcome_rows, upsert
from outings.sources.buckets import IN_BUCKET, BucketedTable

KEYS = ["source", "source_id"]

# Columns a calendar run overwrites on a known event.
CALENDAR_UPDATES = [
    "title", "description", "start_time", "end_time", "vibe_quiet", "vibe_inside", "vibe_active",
    "tags", "venue_address", "source_url",
]
# Columns the structured-page and article runs overwrite.
PAGE_UPDATES = ["title", "description", "start_time", "end_time", "venue_name"]
ARTICLE_UPDATES = ["title", "description"]


def calendar_events(
    parsed: DataFrame, source: str, city_id: int, rich: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(event rows, rejected rows) of parsed feeds.

    ``rich`` adds user tags, energy and unique tags; the plain form keeps
    category tags with their repeats.
    """
    checked = valid_rows(parsed, event_checks())
    # a column of its own, so that a row's text is put together once for all rules
    texts = checked.withColumn("_text", match_text(F.col("title"), F.col("description")))
    tagged = texts.withColumn("_legacy", text_categories(F.col("_text")))
    if rich:
        tags = union_tags(text_user_tags(F.col("_text")), F.col("_legacy"))
        vibe = infer_vibe_3d(F.col("_legacy"))
    else:
        tags, vibe = F.col("_legacy"), infer_vibe_2d(F.col("_legacy"))
    rows = tagged.withColumns(
        {"tags": tags, "_vibe": vibe, "slug": slugify_words(F.col("title"))}
    ).withColumns(
        {
            "vibe_quiet": F.col("_vibe")["quiet"],
            "vibe_inside": F.col("_vibe")["inside"],
            "vibe_active": F.col("_vibe")["active"] if rich else F.lit(0.5),
            "venue_address": F.col("location"),
            "source_url": F.col("url"),
            "source": F.lit(source),
            "source_id": source_id_ics(
                F.col("uid"), F.col("url"), F.col("slug"), F.col("start_time"), source
            ),
            "city_id": F.lit(city_id),
            "is_active": F.lit(True),
        }
    )
    return rows.drop("_text", "_legacy", "_vibe", "location", "url", "uid"), rejected_rows(
        parsed, event_checks()
    )


def jsonld_event_rows(matched: DataFrame, source: str, city_id: int, as_of, *carried: str) -> DataFrame:
    """Event rows of structured events with their matched card; ``carried`` columns stay."""
    card = F.col("card")

    def first(*options: Column) -> Column:
        return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])

    rows = matched.withColumns(
        {
            "title": first(F.col("name"), card["title"]),
            "_text": first(F.col("description"), card["description"]),
            "categories": F.coalesce(card["categories"], string_array(())),
            "start_time": F.col("start_text").try_cast("timestamp"),
            "end_time": F.col("end_text").try_cast("timestamp"),
            "source_url": F.coalesce(first(F.col("url"), card["url"]), F.lit("")),
        }
    ).withColumns(
        {
            "slug": slugify_words(F.col("title")),
            "tags": map_categories(F.col("categories"), CALENDAR_CATEGORIES),
            "_price": parse_price(F.col("price_text")),
        }
    )
    vibe = infer_vibe_jsonld(F.col("tags"))
    return rows.select(
        F.lit(city_id).alias("city_id"), "title", "slug", F.col("_text").alias("description"),
        "start_time", "end_time",
        first(F.col("venue_name"), card["location"]).alias("venue_name"),
        first(F.col("venue_address"), card["location"]).alias("venue_address"),
        "lat", "lng", vibe["quiet"].alias("vibe_quiet"), vibe["inside"].alias("vibe_inside"),
        "categories", "tags", infer_kid_friendly(F.col("categories")).alias("kid_friendly"),
        F.col("_price")["is_free"].alias("is_free"), F.col("_price")["min"].alias("price_min"),
        F.col("_price")["max"].alias("price_max"),
        F.col("_price")["description"].alias("price_description"),
        F.col("url").alias("website"), "source_url",
        first(F.col("image_url"), card["image"]).alias("image_url"),
        F.lit(source).alias("source"),
        source_id_jsonld(
            F.col("at_id"), F.col("identifier"), F.col("source_url"), F.col("slug"),
            F.col("start_text"),
        ).alias("source_id"),
        ts(as_of).alias("scraped_at"), *carried,
    )


def article_event_rows(articles: DataFrame, source: str, city_id: int, as_of, *carried: str) -> DataFrame:
    """Event rows of articles; they start when the article was published. ``carried`` columns stay."""
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(ARTICLE_DEFAULT_CATEGORY))
    clock = extract_time(F.col("excerpt"))
    published = F.col("published").try_cast("timestamp")
    slug = slugify_words(F.col("title"))
    return articles.select(
        F.lit(city_id).alias("city_id"), "title", slug.alias("slug"),
        F.col("excerpt").alias("description"), clock.alias("clock_text"),
        parse_event_date(clock, published).alias("start_time"),
        extract_location(F.col("excerpt")).alias("venue_name"),
        F.lit(0.5).alias("vibe_quiet"), F.lit(0.5).alias("vibe_inside"),
        F.array(category).alias("categories"),
        map_categories(F.array(category), ARTICLE_CATEGORIES).alias("tags"),
        F.col("url").alias("website"), F.col("url").alias("source_url"),
        F.col("image").alias("image_url"), F.lit(source).alias("source"),
        source_id_article(F.col("url"), slug).alias("source_id"),
        ts(as_of).alias("scraped_at"), *carried,
    )


def card_event_rows(cards: DataFrame, source: str, city_id: int, as_of) -> DataFrame:
    """Event rows of plain cards; the start is a placeholder one day ahead."""
    slug = slugify_words(F.col("title"))
    now = ts(as_of)
    return cards.select(
        F.lit(city_id).alias("city_id"), "title", slug.alias("slug"), "description",
        (now + F.expr("INTERVAL '1' DAY")).alias("start_time"),
        F.col("location").alias("venue_name"), F.col("url").alias("source_url"),
        F.col("image").alias("image_url"), F.lit(source).alias("source"),
        source_id_card(slug, now).alias("source_id"), now.alias("scraped_at"),
        F.lit(True).alias("is_active"),
    )


def upsert_calendar(
    target: DataFrame | None, rows: DataFrame, seq: str, as_of, deal_by: list[str] | None = None
) -> DataFrame:
    """Merge calendar rows into the events; ``deal_by`` as in ``upsert``."""
    rows = rows.withColumn("updated_at", ts(as_of))
    if target is None:
        target = rows.limit(0)
    keys = [*(deal_by or []), *KEYS]
    return upsert(target, rows, keys, CALENDAR_UPDATES, seq, as_of=as_of, deal_by=deal_by)


def run_into(
    table: BucketedTable, rows: DataFrame, update_cols: list[str], seq: str, as_of
) -> DataFrame:
    """The end of a page or article run: merge its event rows into the stored events.

    Known events get ``update_cols`` and ``updated_at``, new ones all columns; rows without title or start are
    skipped. Returns the run's counts (outcome, n), observed in the merge itself.
    """
    counts = Observation()
    rows = rows.withColumn("updated_at", ts(as_of))

    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        return upsert(
            old, new, [IN_BUCKET, *KEYS], update_cols, seq, as_of=as_of, checks=event_checks(), counts=counts,
            deal_by=[IN_BUCKET],
        )

    touched = table.merge(rows, change, dealt=True)
    return outcome_rows(rows.sparkSession, counts if touched else None)
