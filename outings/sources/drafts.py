"""Markdown drafts: numbered place entries with labelled lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from outings.functions.rules import string_array, type_from_filename
from outings.functions.text import parse_int_or, parse_vibe_triple, split_tags
from outings.sources.rows import explode_computed


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Draft files as (file, value), one row per file."""
    return spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))


def _labelled(entry: Column, label: str) -> Column:
    """Text behind the last line that starts with the label; NULL when there is none."""
    found = F.regexp_extract_all(
        entry, F.lit(rf"(?m)^[ \t]*\*\*{label}\*\*:([^\n]*)$"), F.lit(1)
    )
    return F.trim(F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"\r", ""))


def markdown_places(drafts: DataFrame, text: str = "value", file: str = "file") -> DataFrame:
    """One row per entry: name, story, nudge, tags, vibes, location, price, category."""
    pieces = F.split(F.col(text), r"(?m)^## \d+\. ")
    entries = F.filter(pieces, lambda _, i: i > 0)
    kept = [c for c in drafts.columns if c != text]
    entry = F.col("_entry")
    vibe = parse_vibe_triple(_labelled(entry, "Vibe"))
    tags = _labelled(entry, "Tags")
    return explode_computed(drafts, kept, entries, "_entry").select(
        *kept,
        "position",
        F.trim(F.regexp_extract(F.trim(entry), r"^([^\r\n]*)", 1)).alias("name"),
        F.coalesce(_labelled(entry, "Story"), F.lit("")).alias("story"),
        F.coalesce(_labelled(entry, "Nudge"), F.lit("")).alias("nudge"),
        F.when(tags.isNull(), string_array(())).otherwise(split_tags(tags)).alias("tags"),
        F.coalesce(vibe["quiet"], F.lit(0.5)).alias("vibe_quiet"),
        F.coalesce(vibe["inside"], F.lit(0.5)).alias("vibe_inside"),
        F.coalesce(vibe["active"], F.lit(0.5)).alias("vibe_active"),
        F.coalesce(_labelled(entry, "Location"), F.lit("")).alias("location"),
        F.coalesce(parse_int_or(_labelled(entry, "Price"), 2), F.lit(2)).alias("price"),
        type_from_filename(F.col(file)).alias("category"),
    )
