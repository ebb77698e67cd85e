"""Source jobs over small texts of our own."""

import json
import time

import pytest
from pyspark.sql import functions as F

from outings.bindings import Tables
from outings.functions.text import article_is_event
from outings.operators.ingest import calendar_events
from outings.operators.upsert import upsert
from outings.sources import buckets
from outings.sources import pages as P
from outings.sources import tables as TB
from outings.sources.buckets import IN_BUCKET, BucketedTable, ConcurrentWrite
from outings.sources.drafts import markdown_places, read_drafts
from outings.sources.ics import ics_events, read_feeds
from outings.sources.sinks import SnapshotTable, append_log, export_places_csv, read_log

FEED = "\r\n".join(
    [
        "BEGIN:VCALENDAR", "SUMMARY:outside", "BEGIN:VEVENT", "SUMMARY:Open ", " Mic\\, late",
        "DESCRIPTION:old", "DESCRIPTION;LANG=en:ignored", "DESCRIPTION:line\\none\\, two\\; x",
        "DTSTART;TZID=America/Chicago:20240601T190000", "DTEND:20240601T210000Z",
        "LOCATION:Hall\\, Main", "UID:1", "BEGIN:VALARM", "DESCRIPTION:Reminder", "END:VALARM",
        "END:VEVENT", "BEGIN:VEVENT", "UID:2", "DTSTART:2024", "no colon here", "END:VEVENT",
        "BEGIN:VEVENT", "SUMMARY:never closed", "END:VCALENDAR",
    ]
)


def test_feed_literal(spark):
    rows = ics_events(spark.createDataFrame([(FEED,)], "value string")).orderBy("position").collect()
    assert len(rows) == 2
    first = rows[0]
    assert first.title == "OpenMic\\, late"  # folded blanks are lost, commas stay escaped
    assert first.description == "Reminder"  # the nested property overwrites
    assert first.location == "Hall, Main"
    assert str(first.start_time) == "2024-06-01 19:00:00"
    assert str(first.end_time) == "2024-06-01 21:00:00"
    assert rows[1].title is None and rows[1].start_time is None and rows[1].uid == "2"


def test_feed_standard(spark):
    df = ics_events(spark.createDataFrame([(FEED,)], "value string"), rfc=True)
    first = df.orderBy("position").first()
    assert first.title == "Open Mic, late"
    assert first.description == "line\none, two; x"
    assert str(first.start_time) == "2024-06-02 00:00:00"  # Chicago evening in UTC


def test_feed_files_and_rejects(spark, tmp_path):
    (tmp_path / "a.ics").write_text(FEED)
    parsed = ics_events(read_feeds(spark, str(tmp_path)))
    good, bad = calendar_events(parsed, "cal", 1)
    assert good.count() == 1 and bad.first().reason == "missing title"
    assert good.first().source_id == "1"


PAGE = """
<script type="application/ld+json">{"@type": "Event", "name": "Jazz at the Lake House tonight",
 "startDate": "2024-06-01", "offers": {"price": 12}, "location": {"name": "Lake",
 "address": {"streetAddress": "1 Pier"}, "geo": {"latitude": 43.1}}, "image": {"url": "p.png"}}</script>
<script type='application/ld+json'>[{"@type":"Event","name":"A"},{"@type":"Place"},
 {"@type":"Event","name":"B","location":{"address":"2 Quay"}}]</script>
<script type="application/ld+json">[{"@type":"Place"},{"@type":"Event","name":"hidden"}]</script>
<script type="application/ld+json">{broken</script>
<div class="event-card"><h3>JAZZ AT THE LAKE HOUSE</h3><span class="venue">Room <b>1</b> </span>
<span class="tag">Music</span><a href="/x"><img src="i.png"></a></div>
<div class="event-card"><p>no title</p></div>
"""


def test_structured_events(spark):
    df = spark.createDataFrame([(1, PAGE)], "page_id int, html string")
    rows = P.jsonld_events(df).orderBy("position").collect()
    assert [r.name for r in rows] == ["Jazz at the Lake House tonight", "A", "B"]
    assert rows[0].price_text == "12" and rows[0].lat == 43.1 and rows[0].image_url == "p.png"
    assert rows[0].venue_address == "1 Pier" and rows[2].venue_address == "2 Quay"
    matched = P.jsonld_card_match(df).orderBy("position").collect()
    assert matched[0].card.location == "Room 1" and matched[0].card.categories == ["Music"]
    assert matched[1].card.title == "JAZZ AT THE LAKE HOUSE"  # "a" is part of the title
    assert matched[2].card is None


def test_cards(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page_id int, html string")
    card = P.html_cards(df).collect()
    assert len(card) == 1 and card[0].url == "/x" and card[0].image == "i.png"


def test_articles(spark):
    html = ("<article><h2>Street Festival</h2><time datetime='2024-05-01'>May</time>"
            "<p>at noon</p><a href='http://n/a/'>x</a></article>"
            "<article><h2>Budget</h2><a href='/b'>x</a></article>"
            "<article><h2>Concert without link</h2></article>")
    df = P.event_articles(spark.createDataFrame([(1, html)], "page_id int, html string"))
    rows = df.collect()
    assert [(r.title, r.published, r.category) for r in rows] == [
        ("Street Festival", "2024-05-01", "Events")
    ]
    flags = spark.createDataFrame(
        [("Budget", "Local Events"), ("Budget", None), ("Farmers MARKET", "x")], "t string, c string"
    ).select(article_is_event(F.col("t"), F.col("c")))
    assert [r[0] for r in flags.collect()] == [True, False, True]


def test_drafts(spark, tmp_path):
    text = ("# Heading\nintro\n## 1. First Place\n\n**Story**: Good.\n**Nudge**: Go.\n"
            "**Tags**: a, b\n**Vibe**: 0.4 (calm), 0.8, 0.3\n**Location**: East\n**Price**: 3+\n---\n"
            "## 2. Second\n**Story**: Only story\n**Price**: free\n")
    (tmp_path / "batch-4-cocktail-bars.md").write_text(text)
    rows = markdown_places(read_drafts(spark, str(tmp_path))).orderBy("position").collect()
    assert [r.name for r in rows] == ["First Place", "Second"]
    assert rows[0].tags == ["a", "b"] and rows[0].price == 3 and rows[0].category == "bar"
    assert (rows[0].vibe_quiet, rows[0].vibe_inside, rows[0].vibe_active) == (0.4, 0.8, 0.3)
    assert rows[1].tags == [] and rows[1].price == 2 and rows[1].vibe_quiet == 0.5
    assert rows[1].nudge == "" and rows[1].story == "Only story"


def test_csv_round_trip(spark, data, tmp_path):
    places = Tables(spark, data).places.filter("id BETWEEN 1 AND 8").withColumns(
        {
            "name": F.concat(F.lit('The "'), F.col("name"), F.lit('", too')),
            "story": F.lit("told"), "nudge": F.lit("go"),
            "vibe_active": F.lit(0.0),
            "embedding": F.lit(None).cast("array<float>"),
            "created_at": F.lit("2024-01-15 10:00:00").cast("timestamp"),
        }
    )
    export_places_csv(places, str(tmp_path / "out"))
    records = TB.read_places_csv(spark, str(tmp_path / "out"))
    assert records.count() == 8
    assert {r["Vibe: Active"] for r in records.collect()} == {""}
    back = {r.id: r for r in TB.csv_places(records).collect()}
    first = places.filter("id = 1").first()
    assert back[1].name == first.name and back[1].vibe_active is None
    assert back[1].tags == first.tags


def test_documents(spark, tmp_path):
    day = {d: "9 - 5" for d in TB.WEEKDAYS} | {"sunday": "Closed"}
    doc = {"verified_date": "2024-01-01", "places": [{"name": "A", "hours": day}]}
    (tmp_path / "h.json").write_text(json.dumps(doc, indent=1))
    rows = TB.verified_hours(TB.read_verified_hours(spark, str(tmp_path / "h.json"))).collect()
    assert len(rows) == 7 and [r.open_text for r in rows if r.weekday == "sunday"] == ["Closed"]
    work = {"breweries_to_verify": [{"name": "B", "location": "x", "search_query": "q"}]}
    (tmp_path / "w.json").write_text(json.dumps(work))
    assert TB.hours_worklist(spark, str(tmp_path / "w.json")).first().name == "B"


def test_payloads(spark):
    payloads = spark.createDataFrame(
        [
            (1, '{"displayName": {"text": "A"}, "regularOpeningHours": {"periods": '
                '[{"open": {"day": 0, "hour": 0, "minute": 0}}]}}'),
            (2, '{"displayName": {"text": "B"}, "businessStatus": "CLOSED_PERMANENTLY"}'),
            (3, '{"error": 1}'),
        ],
        "id int, payload string",
    )
    rows = {r.id: r for r in TB.place_details(payloads).collect()}
    assert set(rows) == {1, 2}
    assert rows[1].hours.type == "always_open" and rows[1].business_status == "OPERATIONAL"
    assert rows[2].hours.type == "unknown" and rows[2].business_status == "CLOSED_PERMANENTLY"
    found = TB.place_lookup(
        spark.createDataFrame(
            [(1, '{"places": [{"id": "p1", "location": {"latitude": 1.5, "longitude": 2}}]}'),
             (2, '{"places": []}')], "id int, payload string")
    ).collect()
    assert [(r.id, r.external_place_id, r.lat) for r in found] == [(1, "p1", 1.5)]


def test_snapshots(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    table.write(spark.range(3))
    old = table.read()
    table.write(old.filter("id > 0"))
    assert old.count() == 3 and table.read().count() == 2
    # a version without its commit record stays invisible
    spark.range(9).write.parquet(str(tmp_path / "t" / "versions" / "9-lost"))
    assert table.read().count() == 2


def test_a_second_writer_is_refused(spark, tmp_path):
    table, late = SnapshotTable(spark, str(tmp_path / "t")), SnapshotTable(spark, str(tmp_path / "t"))
    base, _ = late.log.latest()
    table.write(spark.range(3))
    with pytest.raises(ConcurrentWrite):
        late.log.commit(base, {"folder": "mine"})
    assert table.read().count() == 3
    table.write(spark.range(4))
    assert table.expire(3600) == 0 and table.read().count() == 4
    time.sleep(0.1)
    assert table.expire(0) == 1 and table.read().count() == 4
    # a record that was never filled in is passed by
    (tmp_path / "t" / "commits" / "000000000003").touch()
    assert table.read().count() == 4
    table.write(spark.range(5))
    assert table.read().count() == 5 and table.log.latest()[0] == 4


def files(root):
    return {str(p) for p in root.rglob("part-*.parquet") if "data" in p.parts}


def add(old, new):
    return upsert(old, new, [IN_BUCKET, "k"], ["v"], "seq", deal_by=[IN_BUCKET])


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=16)
    ddl = "k long, v string, seq int"
    table.write(spark.createDataFrame([(i, "old", 0) for i in range(200)] + [(None, "null", 0)] * 20, ddl))
    before, first = files(tmp_path), table.read()
    assert len({p.split("in_bucket=")[1].split("/")[0] for p in before}) == 16
    touched = table.merge(spark.createDataFrame([(7, "new", 1)], ddl.replace("long", "int")), add, dealt=True)
    fresh = files(tmp_path) - before
    assert len(touched) == 1 and len(fresh) == 1 and before < files(tmp_path)
    rows = table.read().collect()
    assert {r.k: r.v for r in rows if r.v == "new"} == {7: "new"} and len(rows) == 220
    used = {p.removeprefix("file://").removeprefix("file:") for p in table.read().inputFiles()}
    replaced = before - used
    assert len(replaced) == 1 and used == (before - replaced) | fresh
    assert first.count() == 220 and table.expire(3600) == 0  # readers of the old version go on
    time.sleep(0.1)
    assert table.expire(0) == 2  # one part and one manifest
    assert files(tmp_path) == used and table.read().count() == 220
    assert table.merge(spark.createDataFrame([], ddl), add) == [] and table.version() == 2


def test_writers_of_one_version_of_a_bucketed_table(spark, tmp_path):
    """The second writer is refused though it touches other buckets, and nothing of it is visible."""
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    ddl = "k long, v string, seq int"
    table.write(spark.createDataFrame([(1, "a", 0)], ddl))

    def overtaken(old, new):
        BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=4).merge(spark.createDataFrame([(2, "b", 1)], ddl), add)
        return add(old, new)

    with pytest.raises(ConcurrentWrite):
        table.merge(spark.createDataFrame([(3, "c", 1)], ddl), overtaken)
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(1, "a"), (2, "b")]


def test_appends_keep_keys_once_and_parts_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "MOST_PARTS", 2)
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=2, equal_nulls=True)
    for i in range(6):
        rows = spark.createDataFrame([(k,) for k in [None, 0, *range(i * 5, i * 5 + 8)]], "k long")
        table.append_new(rows)
    assert table.append_new(rows) == []
    found = [r.k for r in table.read().collect()]
    assert len(found) == len(set(found)) == 34 and None in found
    parts = table._manifest(table.log.latest()[1]).groupBy(IN_BUCKET).count().collect()
    assert all(r["count"] <= 3 for r in parts)


def test_log_appends(spark, tmp_path):
    rows = spark.range(2).withColumn("log_date", F.lit("2024-01-01").cast("date"))
    append_log(rows, str(tmp_path / "log"))
    append_log(rows, str(tmp_path / "log"))
    assert read_log(spark, str(tmp_path / "log")).count() == 4


def test_scan_prunes(spark, data):
    schema = "p_partkey bigint, p_name string, p_brand string, p_size int"
    df = TB.scan(spark, f"{data}/part.parquet", schema, ["p_name"], "p_size > 40")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,40)" in plan and "p_brand" not in plan.split("ReadSchema")[1]
