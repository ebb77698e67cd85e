"""Source jobs over documents that Spark derives from the tables.

Each query writes the rows of a table into the landed form (calendar text,
page, draft, sheet, payload) and reads them back with the source job, so the
values that must come out are known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from outings.bindings import with_model
from outings.operators.ingest import (
    ARTICLE_UPDATES, PAGE_UPDATES, article_event_rows, calendar_events, card_event_rows,
    jsonld_event_rows, run_into,
)
from outings.operators.quality import missing, valid_rows
from outings.plans.registry import query
from outings.bindings import AS_OF
from outings.session import shared_dir
from outings.sources import pages as P
from outings.sources.buckets import BucketedTable
from outings.sources.drafts import markdown_places
from outings.sources.ics import ics_events
from outings.sources.sinks import export_places_csv
from outings.sources.tables import (
    csv_places, place_details, read_places_csv, read_verified_hours, rejected_details, verified_hours,
)

# ---- calendar feeds ----------------------------------------------------------------------------


def feed_texts(events):
    """One feed per event: folded summary, escapes, a repeated and a nested property."""
    start = F.date_format("start_time", "yyyyMMdd'T'HHmmss'Z'")
    end = F.date_format("end_time", "yyyyMMdd'T'HHmmss")
    # The URL is kept away from events whose id is a multiple of 5, the UID from multiples of 3.
    lines = F.concat_ws(
        "\r\n",
        F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit("SUMMARY:not an event"),
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("SUMMARY:"), F.split_part("title", F.lit(" "), F.lit(1))),
        F.concat(F.lit("  "), F.split_part("title", F.lit(" "), F.lit(2))),
        F.lit("DESCRIPTION:first"),
        F.concat(F.lit("DESCRIPTION:live music\\, "), F.col("description"), F.lit("\\nend")),
        F.concat(F.lit("DTSTART;TZID=America/Chicago:"), start),
        F.concat(F.lit("DTEND:"), end),
        F.lit("LOCATION:Hall 1\\, Main St"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("URL:http://e.org/"), F.col("id"))),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("UID:u"), F.col("id"))),
        F.lit("END:VEVENT"), F.lit("END:VCALENDAR"),
    )
    return events.select("id", lines.alias("value"))


def spread(rows):
    """Narrow rows dealt to all tasks: a small file is read by few, and a row of it is a whole text to parse."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@query(
    "ics_events",
    with_model(
        "SELECT id, replace(title, ' ', '') AS title, concat('live music, ', description, chr(10), "
        "'end') AS description, CAST(date_trunc('minute', start_time) AS TIMESTAMP) AS start_time, "
        "CAST(date_trunc('minute', end_time) AS TIMESTAMP) AS end_time, 'Hall 1, Main St' AS "
        "location, CASE WHEN id % 5 <> 0 THEN concat('http://e.org/', CAST(id AS VARCHAR)) END AS "
        "url, CASE WHEN id % 3 <> 0 THEN concat('u', CAST(id AS VARCHAR)) END AS uid "
        "FROM acts_events"
    ),
)
def feeds(t):
    return ics_events(feed_texts(spread(t.events))).drop("position")


_SOURCE_ID = (
    "CASE WHEN id % 3 <> 0 THEN concat('u', CAST(id AS VARCHAR)) WHEN id % 5 <> 0 THEN "
    "concat('http://e.org/', CAST(id AS VARCHAR)) ELSE concat('cal-', replace(title, ' ', ''), '-', "
    "strftime(date_trunc('minute', start_time), '%Y-%m-%dT%H:%M:%S'), '.000Z') END"
)
CALENDAR_SQL = (
    f"SELECT {_SOURCE_ID} AS source_id, replace(title, ' ', '') AS title, "
    "replace(title, ' ', '') AS slug, 0.2e0 AS vibe_quiet, 0.5e0 AS vibe_inside, "
    "0.7e0 AS vibe_active, 'friend-hangout,music,live-music' AS tags, "
    "CAST(date_trunc('minute', start_time) AS TIMESTAMP) AS start_time FROM acts_events"
)


def calendar_rows(t, texts=None):
    texts = feed_texts(spread(t.events)) if texts is None else texts
    rows, _ = calendar_events(ics_events(texts), "cal", 1)
    return rows


@query("calendar_events", with_model(CALENDAR_SQL))
def calendar(t):
    return calendar_rows(t).select(
        "source_id", "title", "slug", "vibe_quiet", "vibe_inside", "vibe_active",
        F.array_join("tags", ",").alias("tags"), "start_time",
    )


# ---- pages -------------------------------------------------------------------------------------


def event_pages(t):
    """The stored pages, each with structured data and cards put before its own markup."""
    name = F.concat(F.lit("Evening Concert Number "), F.col("page_id").cast("string"))
    start = F.concat(F.lit("2024-02-0"), (F.col("page_id") % 9 + 1).cast("string"),
                     F.lit("T19:00:00"))
    body = F.to_json(
        F.struct(
            F.lit("Event").alias("@type"), name.alias("name"), start.alias("startDate"),
            F.struct(F.lit("Town Hall").alias("name")).alias("location"),
            F.struct((F.col("page_id") % 40).alias("price")).alias("offers"), F.col("url"),
        )
    )
    other = F.lit('{"@type":"Place","name":"x"}')
    blocks = (
        F.when(F.col("page_id") % 3 == 0, body)
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("["), body, F.lit(","), other, F.lit("]")))
        .otherwise(F.concat(F.lit("{broken "), body))
    )
    card = F.concat(
        F.lit('<div class="event-card"><h3>Other</h3></div><div class="event-card big"><h3> '),
        F.upper(name), F.lit("</h3><span class='venue'>Room <b>2</b></span>"
                             "<span class='category'>Music</span><span class='tag'>Kids &amp; "
                             "Family</span><a href='/e/1'>more</a><img src='i.png'></div>"
                             "<div class='event-card'><p>no title</p></div>"),
    )
    html = F.concat(
        F.lit("<script type=\"application/ld+json\">"), blocks, F.lit("</script>"), card,
        F.col("html"),
    )
    return t.raw("pages").select("page_id", html.alias("html"), "url")


_JSONLD_SQL = (
    "SELECT page_id, concat('Evening Concert Number ', CAST(page_id AS VARCHAR)) AS name, "
    "concat('2024-02-0', CAST(page_id % 9 + 1 AS VARCHAR), 'T19:00:00') AS start_text, "
    "'Town Hall' AS venue_name, CAST(page_id % 40 AS VARCHAR) AS price_text{extra} FROM pages "
    "WHERE page_id % 3 <> 2"
)


@query("jsonld_events", _JSONLD_SQL.format(extra=""))
def jsonld(t):
    return P.jsonld_events(event_pages(t).drop("url")).select(
        "page_id", "name", "start_text", "venue_name", "price_text"
    )


@query(
    "jsonld_card_match",
    _JSONLD_SQL.format(extra=", concat('EVENING CONCERT NUMBER ', CAST(page_id AS VARCHAR)) AS "
                             "card_title, 'Room 2' AS card_location"),
)
def card_match(t):
    return P.jsonld_card_match(event_pages(t).drop("url")).select(
        "page_id", "name", "start_text", "venue_name", "price_text",
        F.col("card.title").alias("card_title"), F.col("card.location").alias("card_location"),
    )


@query(
    "first_card",
    "SELECT page_id, concat('EVENING CONCERT NUMBER ', CAST(page_id AS VARCHAR)) AS title "
    "FROM pages",
)
def first(t):
    pages = P.with_cards(event_pages(t).drop("url"), P.EVENT_CARDS)
    found = P.first_card(F.col("cards"), F.lit("Evening Concert Numbers of the year"))
    return pages.select("page_id", found["title"].alias("title"))


@query(
    "jsonld_event_rows",
    "SELECT concat('Evening Concert Number ', CAST(page_id AS VARCHAR)) AS title, "
    "concat('evening-concert-number-', CAST(page_id AS VARCHAR)) AS slug, "
    "'music,live-music,family,kids' AS tags, 0.2e0 AS vibe_quiet, 0.5e0 AS vibe_inside, "
    "TRUE AS kid_friendly, FALSE AS is_free, CAST(page_id % 40 AS DOUBLE) AS price_min, "
    "coalesce(nullif(list_extract(string_split(url, '/'), -1), ''), "
    "concat('evening-concert-number-', CAST(page_id AS VARCHAR), '-2024-02-0', "
    "CAST(page_id % 9 + 1 AS VARCHAR), 'T19:00:00')) AS source_id FROM pages WHERE page_id % 3 <> 2",
)
def jsonld_rows(t):
    rows = jsonld_event_rows(P.jsonld_card_match(event_pages(t).drop("url")), "web", 1, AS_OF)
    return rows.select(
        "title", "slug", F.array_join("tags", ",").alias("tags"), "vibe_quiet", "vibe_inside",
        "kid_friendly", "is_free", "price_min", "source_id",
    )


@query(
    "html_cards",
    "SELECT page_id, unnest(['Other', concat('EVENING CONCERT NUMBER ', CAST(page_id AS VARCHAR))]) "
    "AS title, unnest([NULL, 'Room 2']) AS location, unnest([NULL, '/e/1']) AS url, "
    "unnest(['', 'Music,Kids & Family']) AS categories FROM pages",
)
def cards(t):
    found = P.html_cards(event_pages(t).drop("url"))
    return found.select(
        "page_id", "title", "location", "url",
        F.array_join("categories", ",").alias("categories"),
    )


@query(
    "simple_cards",
    f"SELECT concat('Film night ', CAST(page_id AS VARCHAR)) AS title, concat('film-night-', "
    "CAST(page_id AS VARCHAR)) AS slug, CASE page_id % 3 WHEN 0 THEN concat('https://example.org/e/', "
    "CAST(page_id AS VARCHAR)) WHEN 1 THEN 'http://other.org/x' END AS source_url, "
    "concat('film-night-', CAST(page_id AS VARCHAR), '-', CAST(epoch_ms(TIMESTAMP "
    f"'{AS_OF}') AS VARCHAR)) AS source_id, TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY AS start_time "
    "FROM pages",
)
def plain_cards(t):
    """The stored pages with a plain card before their own markup."""
    number = F.col("page_id").cast("string")
    link = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<a href='/e/"), number, F.lit("'>x</a>")))
        .when(F.col("page_id") % 3 == 1, F.lit("<a href='http://other.org/x'>x</a>"))
        .otherwise(F.lit("<p>no link"))
    )
    html = F.concat(
        F.lit("<div class='search-result'><h2>Film night "), number, F.lit("</h2>"), link,
        F.lit("<time>Friday</time></div>"), F.col("html"),
    )
    pages = t.raw("pages").select("page_id", html.alias("html"))
    found = P.simple_cards(pages, "https://example.org")
    return card_event_rows(found, "plain", 1, AS_OF).select(
        "title", "slug", "source_url", "source_id", "start_time"
    )


def article_pages(t):
    name = F.concat(
        F.when(F.col("page_id") % 4 == 0, "Winter Festival ").otherwise("Council notes "),
        F.col("page_id").cast("string"),
    )
    category = F.when(F.col("page_id") % 5 == 0, "Events").otherwise("Food")
    html = F.concat(
        F.lit("<article><h2>"), name, F.lit("</h2><time datetime='2024-01-0"),
        (F.col("page_id") % 9 + 1).cast("string"),
        F.lit("'>last week</time><span class='category'>"), category,
        F.lit("</span><p>Starts 7:30 pm at Union Hall, bring a friend.</p><a href='http://n.org/a/"),
        F.col("page_id").cast("string"), F.lit("/'>read</a></article>"),
    )
    return t.raw("pages").select("page_id", html.alias("html"))


_ARTICLES = "FROM pages WHERE page_id % 4 = 0 OR page_id % 5 = 0"


@query(
    "event_articles",
    "SELECT page_id, concat(CASE WHEN page_id % 4 = 0 THEN 'Winter Festival ' ELSE 'Council notes ' "
    "END, CAST(page_id AS VARCHAR)) AS title, CASE WHEN page_id % 5 = 0 THEN 'Events' ELSE 'Food' "
    f"END AS category, concat('http://n.org/a/', CAST(page_id AS VARCHAR), '/') AS url {_ARTICLES}",
)
def articles(t):
    return P.event_articles(article_pages(t)).select("page_id", "title", "category", "url")


@query(
    "article_event_rows",
    "SELECT CAST(page_id AS VARCHAR) AS source_id, '7:30 pm' AS clock_text, 'Union Hall' AS "
    "venue_name, CAST(concat('2024-01-0', CAST(page_id % 9 + 1 AS VARCHAR)) AS TIMESTAMP) AS "
    "start_time, CASE WHEN page_id % 5 = 0 THEN 'events' ELSE 'food,dining' END AS tags "
    + _ARTICLES,
)
def article_rows(t):
    rows = article_event_rows(P.event_articles(article_pages(t)), "news", 1, AS_OF)
    return rows.select(
        "source_id", "clock_text", "venue_name", "start_time",
        F.array_join("tags", ",").alias("tags"),
    )


# ---- runs into the stored events ---------------------------------------------------------------

# Every second page was there before, under another title; every seventh now has no title or no start.
_RUN_SQL = (
    ", page AS ({rows}), ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY page_id DESC) AS n, "
    "row_number() OVER (PARTITION BY source_id ORDER BY page_id) AS first FROM page WHERE page_id % 7 <> 0), "
    "old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY page_id DESC) AS k FROM page "
    "WHERE page_id % 2 = 0) o WHERE k = 1) "
    "SELECT coalesce(l.source_id, o.source_id) AS source_id, coalesce(l.title, 'Old ' || o.title) AS title, "
    "{start} AS start_time, {venue} AS venue_name, coalesce('old-' || o.slug, f.slug) AS slug, "
    f"CASE WHEN l.source_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at "
    "FROM old o FULL JOIN (SELECT * FROM ranked WHERE n = 1) l ON l.source_id = o.source_id "
    "LEFT JOIN (SELECT * FROM ranked WHERE first = 1) f ON f.source_id = l.source_id"
)


def _run(t, rows, updates: list[str]):
    """A first run under older titles, then the run proper; the stored table is the result."""
    keys = ["source", "source_id"]
    table = BucketedTable(t.spark, shared_dir(t.spark, "events"), keys, buckets=8)
    before = rows.filter("page_id % 2 = 0").withColumns(
        {
            "title": F.concat(F.lit("Old "), "title"), "slug": F.concat(F.lit("old-"), "slug"),
            "start_time": F.col("start_time") - F.expr("INTERVAL 1 DAY"), "venue_name": F.lit("Elsewhere"),
        }
    )
    run_into(table, before, updates, "page_id", "2024-01-01 00:00:00")
    now = rows.withColumn("title", F.when(F.col("page_id") % 14 != 0, F.col("title"))).withColumn(
        "start_time", F.when(F.col("page_id") % 14 != 7, F.col("start_time"))
    )
    run_into(table, now, updates, "page_id", AS_OF)
    return table.read().select("source_id", "title", "start_time", "venue_name", "slug", "updated_at")


@query(
    "page_run",
    "WITH none AS (SELECT 1)" + _RUN_SQL.format(
        rows="SELECT page_id, concat('Evening Concert Number ', CAST(page_id AS VARCHAR)) AS title, "
        "concat('evening-concert-number-', CAST(page_id AS VARCHAR)) AS slug, CAST(concat('2024-02-0', "
        "CAST(page_id % 9 + 1 AS VARCHAR), ' 19:00:00') AS TIMESTAMP) AS start_time, "
        "coalesce(nullif(list_extract(string_split(url, '/'), -1), ''), concat('evening-concert-number-', "
        "CAST(page_id AS VARCHAR), '-2024-02-0', CAST(page_id % 9 + 1 AS VARCHAR), 'T19:00:00')) AS source_id "
        "FROM pages WHERE page_id % 3 <> 2",
        start="coalesce(l.start_time, o.start_time - INTERVAL 1 DAY)",
        venue="CASE WHEN l.source_id IS NOT NULL THEN 'Town Hall' ELSE 'Elsewhere' END",
    ),
)
def page_run(t):
    """Structured pages, from their text to the stored events."""
    found = P.jsonld_card_match(event_pages(t).drop("url"))
    return _run(t, jsonld_event_rows(found, "web", 1, AS_OF, "page_id"), PAGE_UPDATES)


@query(
    "article_run",
    "WITH none AS (SELECT 1)" + _RUN_SQL.format(
        rows="SELECT page_id, concat(CASE WHEN page_id % 4 = 0 THEN 'Winter Festival ' ELSE 'Council notes ' END, "
        "CAST(page_id AS VARCHAR)) AS title, concat(CASE WHEN page_id % 4 = 0 THEN 'winter-festival-' ELSE "
        "'council-notes-' END, CAST(page_id AS VARCHAR)) AS slug, CAST(concat('2024-01-0', CAST(page_id % 9 + 1 AS "
        f"VARCHAR)) AS TIMESTAMP) AS start_time, CAST(page_id AS VARCHAR) AS source_id {_ARTICLES}",
        start="CASE WHEN o.source_id IS NOT NULL THEN o.start_time - INTERVAL 1 DAY ELSE f.start_time END",
        venue="CASE WHEN o.source_id IS NOT NULL THEN 'Elsewhere' ELSE 'Union Hall' END",
    ),
)
def article_run(t):
    """Articles, from their pages to the stored events; known ones keep their start and venue."""
    found = P.event_articles(article_pages(t))
    return _run(t, article_event_rows(found, "news", 1, AS_OF, "page_id"), ARTICLE_UPDATES)


# ---- drafts, sheets, documents -----------------------------------------------------------------


@query(
    "markdown_places",
    "SELECT p_name AS name, concat('Made by ', p_brand) AS story, replace(p_name, ' ', '|') AS tags, "
    "CASE WHEN p_partkey % 7 = 0 THEN 0.5e0 ELSE (p_partkey % 10) / 10e0 END AS vibe_quiet, "
    "CASE WHEN p_partkey % 7 = 0 THEN 0.5e0 ELSE (p_size % 10) / 10e0 END AS vibe_inside, "
    "p_brand AS location, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE p_partkey % 3 END AS price, "
    "CASE WHEN (p_partkey // 10) % 2 = 0 THEN 'café' ELSE 'other' END AS category FROM part",
)
def drafts(t):
    """Ten parts to a draft, so a draft has a fixed number of entries."""
    key = F.col("p_partkey")
    vibe = F.when(
        key % 7 != 0,
        F.concat(
            F.lit("**Vibe**: "), ((key % 10) / 10.0).cast("string"), F.lit(" (calm), "),
            ((F.col("p_size") % 10) / 10.0).cast("string"), F.lit(", 0.4"),
        ),
    ).otherwise(F.lit("**Vibe**: unsure"))
    entry = F.concat_ws(
        "\n",
        F.concat(F.lit("## "), (key % 10 + 1).cast("string"), F.lit(". "), F.col("p_name")),
        F.lit(""),
        F.concat(F.lit("**Story**: Made by "), F.col("p_brand")),
        F.concat(F.lit("**Tags**: "), F.replace(F.col("p_name"), F.lit(" "), F.lit(", "))),
        vibe,
        F.concat(F.lit("**Location**: "), F.col("p_brand")),
        F.concat(F.lit("**Price**: "), (key % 3).cast("string"), F.lit(" of 4")),
        F.lit("---"),
    )
    number = F.floor(key / 10)
    files = (
        t.raw("part")
        .select(number.alias("n"), key.alias("k"), entry.alias("entry"))
        .groupBy("n")
        .agg(F.array_sort(F.collect_list(F.struct("k", "entry"))).alias("e"))
        .select(
            F.concat(
                F.lit("batch"), F.when(F.col("n") % 2 == 0, "-coffee.md").otherwise("-misc.md")
            ).alias("file"),
            F.concat(
                F.lit("# Heading\n\n"),
                F.array_join(F.transform("e", lambda x: x["entry"]), "\n\n"),
            ).alias("value"),
        )
    )
    return markdown_places(files).select(
        "name", "story", F.array_join("tags", "|").alias("tags"), "vibe_quiet", "vibe_inside",
        "location", "price", "category",
    )


def _sheet(t):
    places = t.places.withColumns(
        {
            "name": F.concat(F.lit('The "'), F.col("name"), F.lit('", again')),
            "story": F.when(F.col("id") % 8 != 0, F.concat(F.lit("Near "), F.col("neighborhood"))),
            "nudge": F.lit("Go early, stay late"),
            "created_at": F.lit(AS_OF).cast("timestamp"),
        }
    )
    return places


def _sheet_files(t):
    """The sheet, exported as CSV files below the shared folder and read back."""
    path = shared_dir(t.spark, "sheet")
    export_places_csv(_sheet(t), path, "vec_id")
    return read_places_csv(t.spark, path)


_SHEET_NAME = "concat('The \"', name, '\", again')"


@query(
    "export_places_csv",
    with_model(
        f"SELECT CAST(id AS VARCHAR) AS \"ID\", {_SHEET_NAME} AS \"Name\", category AS \"Type\", "
        "neighborhood AS \"Neighborhood\", CASE WHEN id % 8 <> 0 THEN concat('Near ', neighborhood) "
        "ELSE '' END AS \"Story\", 'Go early, stay late' AS \"Nudge\", "
        "CASE WHEN coalesce(vibe_quiet, 0) = 0 THEN '' ELSE CAST(vibe_quiet AS VARCHAR) END AS "
        "\"Vibe: Quiet\", CASE WHEN vibe_inside = 0 THEN '' ELSE CAST(vibe_inside AS VARCHAR) END AS "
        "\"Vibe: Inside\", CASE WHEN vibe_active = 0 THEN '' ELSE CAST(vibe_active AS VARCHAR) END AS "
        "\"Vibe: Active\", array_to_string(tags, ', ') AS \"Tags\", CAST(price_level AS VARCHAR) AS "
        "\"Price Level\", CASE WHEN vec_id IS NULL THEN 'No' ELSE 'Yes' END AS \"Has Embedding\", "
        "CASE WHEN is_active THEN 'Yes' ELSE 'No' END AS \"Active\", '2024-01-15' AS \"Created At\" "
        "FROM places"
    ),
)
def export(t):
    return _sheet_files(t)


@query(
    "csv_places",
    with_model(
        f"SELECT id, {_SHEET_NAME} AS name, lower(category) AS category, concat('Near ', "
        "neighborhood) AS story, nullif(vibe_quiet, 0) AS vibe_quiet, array_to_string(tags, '|') AS "
        "tags, price_level FROM places WHERE id % 8 <> 0"
    ),
)
def sheet(t):
    """The exported files, read back; rows without a story are set aside."""
    return valid_rows(csv_places(_sheet_files(t)), missing("story", "nudge")).select(
        "id", "name", "category", "story", "vibe_quiet",
        F.array_join("tags", "|").alias("tags"), "price_level",
    )


@query(
    "verified_hours",
    with_model(
        "SELECT name, weekday, CASE WHEN closed_day = n THEN 'Closed' ELSE CAST(open_hhmm AS "
        "VARCHAR) END AS open_text FROM places, (SELECT unnest(['sunday', 'monday', 'tuesday', "
        "'wednesday', 'thursday', 'friday', 'saturday']) AS weekday, unnest([0, 1, 2, 3, 4, 5, 6]) "
        "AS n) d"
    ),
)
def verified(t):
    days = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
    hours = F.struct(
        *[
            F.when(F.col("closed_day") == i, "Closed")
            .otherwise(F.col("open_hhmm").cast("string"))
            .alias(d)
            for i, d in enumerate(days)
        ]
    )
    place = F.struct("name", F.lit("1 High St").alias("address"), hours.alias("hours"))
    docs = t.places.select(
        F.to_json(
            F.struct(F.lit("2024-01-01").alias("verified_date"), F.array(place).alias("places"))
        ).alias("doc")
    )
    path = shared_dir(t.spark, "hours")
    docs.select(F.col("doc").alias("value")).write.text(path)
    return verified_hours(read_verified_hours(t.spark, path, multi_line=False)).select(
        "name", "weekday", "open_text"
    )


@query(
    "place_details",
    with_model(
        "SELECT id, name, neighborhood AS address, coalesce(business_status, 'OPERATIONAL') AS "
        "business_status, CASE WHEN no_hours THEN 'unknown' ELSE 'standard' END AS hours_type, "
        "lat FROM places"
    ),
)
def details(t):
    return place_details(_details_payloads(t)).select(
        "id", "name", "address", "business_status", F.col("hours.type").alias("hours_type"), "lat"
    )


@query(
    "rejected_details",
    with_model(
        "SELECT id, CASE WHEN id % 9 = 0 THEN 'missing name' ELSE 'unreadable payload' END AS reason "
        "FROM places WHERE id % 9 IN (0, 1)"
    ),
)
def details_set_aside(t):
    """Payloads of which some lack a name and some are cut off."""
    text = F.col("payload")
    broken = F.when(F.col("id") % 9 == 0, F.replace(text, F.lit("displayName"), F.lit("other"))).when(
        F.col("id") % 9 == 1, F.substring(text, 1, 12)
    )
    payloads = _details_payloads(t).withColumn("payload", F.coalesce(broken, text))
    return rejected_details(payloads).select("id", "reason")


def _details_payloads(t):
    payload = F.to_json(
        F.struct(
            F.struct(F.col("name").alias("text")).alias("displayName"),
            F.col("neighborhood").alias("formattedAddress"),
            F.when(
                ~F.col("no_hours"),
                F.struct(
                    F.col("hours.periods").alias("periods"),
                    F.col("hours.weekday_text").alias("weekdayDescriptions"),
                ),
            ).alias("regularOpeningHours"),
            F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")).alias(
                "location"
            ),
            F.col("business_status").alias("businessStatus"),
        )
    )
    return t.places.select("id", payload.alias("payload"))
