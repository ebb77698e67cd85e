"""Column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from outings.bindings import AS_OF, with_model
from outings.functions import hours as H
from outings.functions import text as X
from outings.functions import times as T
from outings.functions.rules import SUNSET_HHMM
from outings.plans.registry import query

_EV = "SELECT id, {x} AS {n} FROM acts_events"


def _over_events(name: str, sql: str, column):
    @query(name, with_model(_EV.format(x=sql, n=name)))
    def build(t):
        return t.events.select("id", column().alias(name))


_start = lambda: F.col("start_time")
_over_events(
    "time_of_day",
    "CASE WHEN hour(start_time) < 12 THEN 'morning' WHEN hour(start_time) < 17 THEN 'afternoon' "
    "ELSE 'evening' END",
    lambda: T.time_of_day(_start()),
)
_over_events("day_of_week", "lower(dayname(start_time))", lambda: T.day_of_week(_start()))
_over_events("week_bucket", "CAST(date_trunc('week', start_time) AS TIMESTAMP)",
             lambda: T.week_bucket(_start()))
_over_events(
    "clamp_request_date",
    f"CASE WHEN start_time < TIMESTAMP '{AS_OF}' THEN NULL ELSE "
    f"least(start_time, TIMESTAMP '{AS_OF}' + INTERVAL 14 DAY) END",
    lambda: T.clamp_request_date(_start(), T.ts(AS_OF)),
)


@query(
    "season_of",
    "SELECT o_orderkey AS id, CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'spring' "
    "WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'summer' "
    "WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 'fall' ELSE 'winter' END AS season FROM orders",
)
def season(t):
    return t.raw("orders").select(
        F.col("o_orderkey").alias("id"), T.season_of(F.col("o_orderdate")).alias("season")
    )


@query(
    "sunset_hhmm",
    f"SELECT o_orderkey AS id, ({list(SUNSET_HHMM)})[month(o_orderdate)] AS sunset FROM orders",
)
def sunset(t):
    return t.raw("orders").select(
        F.col("o_orderkey").alias("id"), T.sunset_hhmm(F.col("o_orderdate")).alias("sunset")
    )


# Calendar date texts: with seconds and zone, with minutes, date only, too short.
@query(
    "parse_ics_date",
    "SELECT event_id AS id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN "
    "CAST(date_trunc('day', ts) AS TIMESTAMP) ELSE CAST(date_trunc('minute', ts) AS TIMESTAMP) END "
    "AS parsed FROM events",
)
def ics_dates(t):
    start = F.col("start_time")
    text = (
        F.when(F.col("id") % 4 == 0, F.date_format(start, "yyyyMMdd'T'HHmmss'Z'"))
        .when(F.col("id") % 4 == 1, F.date_format(start, "yyyyMMdd'T'HHmm"))
        .when(F.col("id") % 4 == 2, F.date_format(start, "yyyyMMdd"))
        .otherwise(F.date_format(start, "yyyyMM"))
    )
    return t.events.select("id", T.parse_ics_date(text).alias("parsed"))


@query(
    "parse_event_date",
    "SELECT event_id AS id, CASE event_id % 5 WHEN 3 THEN CAST(ts AS TIMESTAMP) WHEN 4 THEN NULL "
    "ELSE CAST(date_trunc('day', ts) AS TIMESTAMP) END AS parsed FROM events",
)
def event_dates(t):
    start = F.col("start_time")
    text = (
        F.when(F.col("id") % 5 == 0, F.date_format(start, "MMMM d, yyyy"))
        .when(F.col("id") % 5 == 1, F.date_format(start, "M/d/yyyy"))
        .when(F.col("id") % 5 == 2, F.date_format(start, "MMMM d"))
        .when(F.col("id") % 5 == 3, F.lit("7:30 pm"))
        .otherwise(F.lit(""))
    )
    return t.events.select("id", T.parse_event_date(text, start).alias("parsed"))


_CLOCK = (
    "CASE id % 4 WHEN 0 THEN concat('Doors ', CAST(id % 12 + 1 AS STRING), ' PM, show ', "
    "CAST(id % 12 + 1 AS STRING), ':30 pm') WHEN 1 THEN concat('from ', CAST(id % 12 + 1 AS STRING), "
    "'am until late') WHEN 2 THEN 'all day' ELSE NULL END"
)
_over_events(
    "extract_time",
    "CASE id % 4 WHEN 0 THEN concat(CAST(id % 12 + 1 AS VARCHAR), ':30 pm') "
    "WHEN 1 THEN concat(CAST(id % 12 + 1 AS VARCHAR), 'am') END",
    lambda: T.extract_time(F.expr(_CLOCK)),
)


# ---- hours -----------------------------------------------------------------------------------

_SPAN = (
    "concat(lpad(CAST(open_hhmm AS VARCHAR), 4, '0'), ' - ', "
    "lpad(CAST(close_hhmm AS VARCHAR), 4, '0'))"
)


@query(
    "hours_status",
    with_model(
        "SELECT id, CASE WHEN no_hours THEN 'Hours not available' WHEN always_open THEN "
        "'Open 24 hours' WHEN closed_day <> 2 AND CASE WHEN closes_next_day THEN 1030 >= open_hhmm "
        "OR 1030 < close_hhmm ELSE 1030 >= open_hhmm AND 1030 < close_hhmm END THEN 'Open now' "
        "ELSE 'Closed now' END AS status FROM places"
    ),
)
def status(t):
    return t.places.select(
        "id", H.hours_status(F.col("hours"), T.ts("2024-01-16 10:30:00")).alias("status")
    )


@query(
    "todays_hours",
    with_model(
        "SELECT id, CASE WHEN no_hours THEN 'Hours not available' WHEN always_open THEN "
        f"'Open 24 hours' WHEN closed_day = 2 THEN 'Closed' ELSE {_SPAN} END AS today FROM places"
    ),
)
def today(t):
    return t.places.select(
        "id", H.todays_hours(F.col("hours"), T.ts("2024-01-16 10:30:00")).alias("today")
    )


@query(
    "hours_summary",
    with_model(
        "SELECT id, CASE WHEN no_hours THEN 'See Google Maps for hours' WHEN always_open THEN "
        "'Open 24 hours' WHEN closed_day = 1 THEN 'Closed (varies)' "
        f"ELSE concat({_SPAN}, ' (varies)') END AS summary FROM places"
    ),
)
def summary(t):
    return t.places.select("id", H.hours_summary(F.col("hours")).alias("summary"))


@query(
    "has_seasonal_hours",
    with_model("SELECT id, NOT no_hours AND id % 4 = 1 AS seasonal FROM places"),
)
def seasonal(t):
    notes = F.when(F.col("id") % 4 == 1, F.array(F.lit("Closed for Season"))).otherwise(
        F.array(F.lit("Kitchen until nine"))
    )
    noted = t.places.select(
        "id",
        F.struct(F.concat(F.col("hours.weekday_text"), notes).alias("weekday_text")).alias("hours"),
    )
    return noted.select("id", H.has_seasonal_hours(F.col("hours")).alias("seasonal"))


@query(
    "format_hours",
    with_model(
        "SELECT id, CASE WHEN no_hours THEN 'unknown' WHEN always_open THEN 'always_open' ELSE "
        "'standard' END AS kind, coalesce(always_open AND NOT no_hours, FALSE) AS always_open, "
        "CASE WHEN no_hours THEN 0 WHEN always_open THEN NULL ELSE 6 END AS periods FROM places"
    ),
)
def formatted(t):
    one = F.array(
        F.struct(
            F.col("hours.periods")[0]["open"].alias("open"),
            F.lit(None).cast("struct<day:int,time:string,hour:int,minute:int>").alias("close"),
        )
    )
    opening = F.struct(
        F.when(F.col("always_open") & ~F.col("no_hours"), one)
        .otherwise(F.col("hours.periods"))
        .alias("periods"),
        F.col("hours.weekday_text").alias("weekday_text"),
    )
    out = t.places.select("id", H.format_hours(opening).alias("h"))
    return out.select(
        "id", F.col("h.type").alias("kind"), F.col("h.always_open").alias("always_open"),
        F.size("h.periods").alias("periods"),
    )


# ---- text ------------------------------------------------------------------------------------


def _over_documents(name: str, sql: str, column):
    @query(name, f"SELECT doc_id AS id, {sql} AS {name} FROM documents")
    def build(t):
        return t.raw("documents").select(F.col("doc_id").alias("id"), column().alias(name))


_text = lambda: F.col("text")
_SLUG_A = (
    "regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^0-9a-z_\\s-]', '', 'g'), "
    "'\\s+', '-', 'g'), '-+', '-', 'g')"
)
_SLUG_B = (
    "regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
)
_over_documents("slugify_words", _SLUG_A.format(c="text"), lambda: X.slugify_words(_text()))
_over_documents("slugify_alnum", _SLUG_B.format(c="text"), lambda: X.slugify_alnum(_text()))
_over_documents("snippet", "substring(text, 1, 100)", lambda: X.snippet(_text(), 100))
# The documents name few venues, so three quarters get one more form behind their own words.
_VENUE = (
    "concat(text, CASE doc_id % 4 WHEN 0 THEN '. Meet at Union Hall on the corner. ' WHEN 1 THEN "
    "'. LOCATION: Old Mill. ' WHEN 2 THEN '. Venue:  The Shed. ' ELSE '.' END)"
)


def _venue_sql(form: str) -> str:
    return f"nullif(trim(regexp_extract({_VENUE}, '{form}', 1)), '')"


_over_documents(
    "extract_location",
    "coalesce(" + _venue_sql(r"at\s+([A-Z][A-Za-z\s&]+?)(?:\s+on|\s+from|\.|,)") + ", "
    + _venue_sql(r"(?i)location:\s*([^.\n]+)") + ", " + _venue_sql(r"(?i)venue:\s*([^.\n]+)") + ")",
    lambda: X.extract_location(F.expr(_VENUE)),
)


@query(
    "absolute_url",
    "SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN "
    "concat('https://example.org', '/p/', CAST(page_id AS VARCHAR)) END AS link FROM pages",
)
def links(t):
    link = F.expr(
        "CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN concat('/p/', CAST(page_id AS STRING)) END"
    )
    return t.raw("pages").select(
        F.col("page_id").alias("id"), X.absolute_url(link, "https://example.org").alias("link")
    )


_UID = "CASE WHEN id % 3 = 0 THEN CAST(id AS STRING) ELSE '' END"
_LINK = "CASE WHEN id % 3 = 1 THEN concat('http://e.org/', CAST(id AS STRING)) END"
_over_events(
    "source_id_ics",
    "CASE id % 3 WHEN 0 THEN CAST(id AS VARCHAR) WHEN 1 THEN concat('http://e.org/', "
    f"CAST(id AS VARCHAR)) ELSE concat('cal-', {_SLUG_A.format(c='title')}, '-', "
    "strftime(start_time, '%Y-%m-%dT%H:%M:%S.%gZ')) END",
    lambda: X.source_id_ics(
        F.expr(_UID), F.expr(_LINK), X.slugify_words(F.col("title")), _start(), "cal"
    ),
)
_over_events(
    "source_id_jsonld",
    "CASE id % 4 WHEN 0 THEN concat('at', CAST(id AS VARCHAR)) WHEN 1 THEN concat('idf', "
    "CAST(id AS VARCHAR)) WHEN 2 THEN CAST(id AS VARCHAR) ELSE "
    f"concat({_SLUG_A.format(c='title')}, '-2024') END",
    lambda: X.source_id_jsonld(
        F.expr("CASE WHEN id % 4 = 0 THEN concat('at', CAST(id AS STRING)) END"),
        F.expr("CASE WHEN id % 4 = 1 THEN concat('idf', CAST(id AS STRING)) ELSE '' END"),
        F.expr("CASE id % 4 WHEN 2 THEN concat('http://e.org/x/', CAST(id AS STRING)) "
               "WHEN 3 THEN 'http://e.org/x/' ELSE '' END"),
        X.slugify_words(F.col("title")), F.lit("2024"),
    ),
)


@query(
    "source_id_article",
    "SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN "
    "list_filter(string_split(url, '/'), lambda x: x <> '')[-1] ELSE 'slug' END AS source_id "
    "FROM pages",
)
def article_ids(t):
    url = F.expr("CASE WHEN page_id % 2 = 0 THEN concat(url, '//') ELSE '/' END")
    return t.raw("pages").select(
        F.col("page_id").alias("id"), X.source_id_article(url, F.lit("slug")).alias("source_id")
    )


_over_events(
    "parse_int_or",
    "CASE id % 4 WHEN 0 THEN CAST(id % 90 AS INT) + 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE "
    "-(CAST(id % 9 AS INT) + 1) END",
    lambda: X.parse_int_or(
        F.expr("CASE id % 4 WHEN 0 THEN concat(' ', CAST(id % 90 + 1 AS STRING), '.9 USD') "
               "WHEN 1 THEN '0' WHEN 2 THEN 'none' ELSE concat('-', CAST(id % 9 + 1 AS STRING)) "
               "END"),
        2,
    ),
)


@query(
    "split_tags",
    "SELECT p_partkey AS id, array_to_string(string_split(p_name, ' '), '|') AS tags FROM part",
)
def tags_split(t):
    listed = F.replace(F.col("p_name"), F.lit(" "), F.lit(" ,  "))
    return t.raw("part").select(
        F.col("p_partkey").alias("id"), F.array_join(X.split_tags(listed), "|").alias("tags")
    )


@query(
    "parse_vibe_triple",
    "SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 0.5e0 ELSE (event_id % 11) / 10e0 END "
    "AS quiet, CASE WHEN event_id % 7 = 0 THEN 0.5e0 ELSE (user_id % 11) / 10e0 END AS inside, "
    "0.5e0 AS active FROM events",
)
def vibe_triples(t):
    text = F.when(F.col("event_id") % 7 == 0, "quiet and calm").otherwise(
        F.concat(
            ((F.col("event_id") % 11) / 10.0).cast("string"), F.lit(" (quiet), "),
            ((F.col("user_id") % 11) / 10.0).cast("string"), F.lit(" (in and out), 0.5"),
        )
    )
    parsed = t.raw("events").select(
        F.col("event_id").alias("id"), X.parse_vibe_triple(text).alias("v")
    )
    return parsed.select("id", "v.quiet", "v.inside", "v.active")


# Bare words, clock times, quoted text with commas, colons, brackets and quotes, null and no text at all.
@query(
    "fix_json",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 11 <> 0 THEN concat('{\"days\":\"', lower(p_type), "
    "'\", \"note\": \"bar, ', p_name, ', pub: {open, 08:30}\", \"said\":\"a \\\"', p_brand, ', x\\\"\", "
    "\"opens\":\"08:', CAST(p_size % 50 + 10 AS VARCHAR), '\",\"gone\": null,\"hours_verified\":', "
    "CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, '}') END AS fixed FROM part",
)
def json_fixed(t):
    raw = F.when(
        F.col("p_partkey") % 11 != 0,
        F.concat(
            F.lit("{days:"), F.lower("p_type"), F.lit(', note: "bar, '), F.col("p_name"),
            F.lit(', pub: {open, 08:30}", "said":"a \\"'), F.col("p_brand"), F.lit(', x\\"", opens:08:'),
            (F.col("p_size") % 50 + 10).cast("string"), F.lit(",gone: null,hours_verified:"),
            F.when(F.col("p_size") % 2 == 0, "true").otherwise("false"), F.lit("}"),
        ),
    )
    return t.raw("part").select(F.col("p_partkey").alias("id"), X.fix_json(raw).alias("fixed"))
