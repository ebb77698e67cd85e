"""CSV, JSON documents and lookup payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from outings.functions.hours import format_hours
from outings.functions.text import fix_json, parse_float, parse_int_or, split_tags
from outings.functions.rules import string_array
from outings.schemas import (
    DETAILS_PAYLOAD_DDL, LOOKUP_PAYLOAD_DDL, PLACES_CSV, VERIFIED_HOURS_DDL, WEEKDAYS, WORKLIST_DDL,
)

# One record per line: a line break inside quotes ends the record.
CSV_OPTIONS = {
    "escape": '"',
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "multiLine": "false",
    "mode": "PERMISSIVE",
    "nullValue": "",
}


def scan(spark: SparkSession, path: str, schema, columns=None, where=None) -> DataFrame:
    """Read a stored table with its schema; projection and filter reach the files."""
    out = spark.read.schema(schema).parquet(path)
    out = out if where is None else out.filter(where)
    return out if columns is None else out.select(*columns)


def read_places_csv(spark: SparkSession, path: str, schema=PLACES_CSV) -> DataFrame:
    """Records of the exported sheet as text columns; missing values are ''."""
    return spark.read.csv(path, schema=schema, header=True, **CSV_OPTIONS).fillna("")


def csv_places(records: DataFrame) -> DataFrame:
    """Typed place columns of the text records; loose numbers, tags split."""
    tags = F.col("Tags")
    return records.select(
        parse_int_or(F.col("ID"), 0).cast("bigint").alias("id"),
        F.col("Name").alias("name"),
        F.lower("Type").alias("category"),
        F.col("Neighborhood").alias("neighborhood"),
        F.col("Story").alias("story"),
        F.col("Nudge").alias("nudge"),
        parse_float(F.col("`Vibe: Quiet`")).alias("vibe_quiet"),
        parse_float(F.col("`Vibe: Inside`")).alias("vibe_inside"),
        parse_float(F.col("`Vibe: Active`")).alias("vibe_active"),
        F.when(tags == "", string_array(())).otherwise(split_tags(tags)).alias("tags"),
        parse_int_or(F.col("`Price Level`"), 1).alias("price_level"),
    )


def read_verified_hours(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Documents of hours: one per file, or one per line without ``multi_line``."""
    return spark.read.schema(VERIFIED_HOURS_DDL).json(path, multiLine=multi_line)


def verified_hours(docs: DataFrame) -> DataFrame:
    """One row per place and weekday: name, weekday, open_text ('Closed' kept)."""
    pairs = ", ".join(f"'{d}', hours.{d}" for d in WEEKDAYS)
    return docs.select("verified_date", F.inline("places")).selectExpr(
        "verified_date", "name", "address", "source",
        f"stack({len(WEEKDAYS)}, {pairs}) AS (weekday, open_text)",
    )


def hours_worklist(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(WORKLIST_DDL).json(path, multiLine=True)
    return docs.select(F.inline("breweries_to_verify"))


def place_details(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Details payloads in the stored shape; ``rejected_details`` has the ones without a name."""
    kept = [c for c in payloads.columns if c != text]
    p = F.col("_p")
    hours = p["regularOpeningHours"]
    opening = F.when(
        hours.isNotNull(),
        F.struct(
            hours["openNow"].alias("open_now"), hours["periods"].alias("periods"),
            hours["weekdayDescriptions"].alias("weekday_text"),
        ),
    )
    return (
        payloads.select(*kept, F.from_json(text, DETAILS_PAYLOAD_DDL).alias("_p"))
        .filter(p["displayName"].isNotNull())
        .select(
            *kept,
            p["displayName"]["text"].alias("name"),
            p["formattedAddress"].alias("address"),
            p["internationalPhoneNumber"].alias("phone"),
            p["websiteUri"].alias("website"),
            opening.alias("opening_hours"),
            format_hours(opening).alias("hours"),
            p["rating"].alias("rating"),
            p["userRatingCount"].alias("ratings_total"),
            p["location"]["latitude"].alias("lat"),
            p["location"]["longitude"].alias("lng"),
            p["priceLevel"].alias("price_level"),
            F.coalesce(p["businessStatus"], F.lit("OPERATIONAL")).alias("business_status"),
        )
    )


def rejected_details(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Payloads that cannot be read or have no name, with the ``reason``."""
    readable = F.try_parse_json(text).isNotNull()
    named = F.from_json(text, DETAILS_PAYLOAD_DDL)["displayName"].isNotNull()
    reason = F.when(~readable, "unreadable payload").when(~named, "missing name")
    return payloads.withColumn("reason", reason).filter("reason IS NOT NULL")


def place_lookup(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """First hit of each lookup payload; empty lists give no row."""
    kept = [c for c in payloads.columns if c != text]
    first = F.try_element_at(F.from_json(text, LOOKUP_PAYLOAD_DDL)["places"], F.lit(1))
    hit = F.col("_first")
    return (
        payloads.select(*kept, first.alias("_first"))
        .filter(hit.isNotNull())
        .select(
            *kept,
            hit["id"].alias("external_place_id"),
            hit["displayName"]["text"].alias("name"),
            hit["formattedAddress"].alias("address"),
            hit["location"]["latitude"].alias("lat"),
            hit["location"]["longitude"].alias("lng"),
        )
    )


def availability(text: Column) -> Column:
    """The JSON-like availability text as a variant, NULL when it cannot be read."""
    return F.try_parse_json(fix_json(text))
