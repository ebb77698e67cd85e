"""Calendar feeds: one row per event of every feed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from outings.functions.times import parse_ics_date, parse_ics_date_zoned
from outings.sources.rows import explode_computed

PROPERTIES = ("SUMMARY", "DESCRIPTION", "LOCATION", "URL", "UID")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Feed files as (feed, value), one row per file."""
    return spark.read.text(path, wholetext=True).withColumn("feed", F.col("_metadata.file_path"))


def _last(properties: Column, name: str, prefix: bool = False) -> Column:
    """Last property of a name; a repeated property overwrites the earlier one."""
    same = F.filter(
        properties, lambda p: p["name"].startswith(name) if prefix else p["name"] == name
    )
    return F.try_element_at(same, F.lit(-1))


def _unescape(text: Column, rfc: bool) -> Column:
    out = F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\,"), F.lit(","))
    return F.replace(out, F.lit("\\;"), F.lit(";")) if rfc else out


def ics_events(feeds: DataFrame, text: str = "value", rfc: bool = False) -> DataFrame:
    """Events of the feeds: title, description, start_time, end_time, location, url, uid.

    By default continuation lines lose their leading blanks, only the start and
    end may carry parameters, a nested component's properties count as the
    event's, and zones are ignored. ``rfc`` follows the calendar standard.
    """
    if rfc:
        unfolded = F.regexp_replace(F.col(text), r"\r?\n[ \t]", "")
    else:
        unfolded = F.regexp_replace(F.col(text), r"[ \t]*\r?\n[ \t]+", "")
    pieces = F.split(unfolded, r"(?m)^[ \t]*BEGIN:VEVENT[ \t]*\r?$")
    blocks = F.filter(pieces, lambda _, i: i > 0)
    closed = F.transform(blocks, lambda b: F.split(b, r"(?m)^[ \t]*END:VEVENT[ \t]*\r?$"))
    complete = F.filter(closed, lambda b: F.size(b) > 1)

    def entry(line: Column) -> Column:
        at = F.instr(line, ":")
        full = F.substr(line, F.lit(1), at - 1)
        name = F.split_part(full, F.lit(";"), F.lit(1)) if rfc else full
        zone = [F.nullif(F.regexp_extract(full, r"TZID=([^;:]+)", 1), F.lit("")).alias("tzid")] * rfc
        return F.struct(name.alias("name"), F.substr(line, at + 1).alias("value"), *zone)

    def properties(closed_block: Column) -> Column:
        block = closed_block[0]
        if rfc:
            block = F.regexp_replace(block, r"(?ms)^BEGIN:(\w+)\r?$.*?^END:\1\r?$", "")
        # a one-character separator is no pattern that is compiled anew for every text
        lines = F.transform(F.split(F.replace(block, F.lit("\r\n"), F.lit("\n")), "\n"), lambda s: F.trim(s))
        return F.transform(F.filter(lines, lambda s: F.instr(s, ":") > 1), entry)

    def event(props: Column) -> Column:
        text_of = {n: _last(props, n)["value"] for n in PROPERTIES}
        commas = F.replace(text_of["LOCATION"], F.lit("\\,"), F.lit(","))
        title = text_of["SUMMARY"]
        return F.struct(
            (_unescape(title, rfc) if rfc else title).alias("title"),
            _unescape(text_of["DESCRIPTION"], rfc).alias("description"),
            _last(props, "DTSTART", prefix=not rfc).alias("start"),
            _last(props, "DTEND", prefix=not rfc).alias("end"),
            (_unescape(text_of["LOCATION"], rfc) if rfc else commas).alias("location"),
            text_of["URL"].alias("url"),
            text_of["UID"].alias("uid"),
        )

    # The events are built inside the generator: a later filter on their fields
    # then reads finished values instead of repeating the parse below it.
    events = F.transform(F.transform(complete, properties), event)
    kept = [c for c in feeds.columns if c != text]

    def when(point: Column) -> Column:
        if rfc:
            return parse_ics_date_zoned(point["value"], point["tzid"])
        return parse_ics_date(point["value"])

    e = F.col("_e")
    return explode_computed(feeds, kept, events, "_e").select(
        *kept, "position", e["title"].alias("title"), e["description"].alias("description"),
        when(e["start"]).alias("start_time"), when(e["end"]).alias("end_time"),
        e["location"].alias("location"), e["url"].alias("url"), e["uid"].alias("uid"),
    )
