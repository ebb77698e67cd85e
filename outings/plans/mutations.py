"""Upserts and updates.

What started before ``STORED_UNTIL`` is the stored table, one row per key. The
whole events table then arrives as a batch with changed titles, so keys repeat,
some are known and some are new.
"""

from __future__ import annotations

from pyspark.sql import Observation, functions as F

from outings.bindings import AS_OF, with_model
from outings.functions.times import ts
from outings.operators import upsert as U
from outings.operators.quality import event_checks
from outings.plans.registry import query
from outings.session import shared_dir
from outings.sources.buckets import IN_BUCKET, BucketedTable

KEYS = ["source", "source_id"]
UPDATES = ["title", "description", "start_time", "end_time"]
KEPT = ["id", "city_id"]
STORED_UNTIL = "2024-01-03 00:00:00"

_SPLIT = (
    ", stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_id "
    f"ORDER BY id DESC) AS n FROM acts_events WHERE start_time < TIMESTAMP '{STORED_UNTIL}') s "
    "WHERE n = 1), batch AS (SELECT *, concat(title, ' new') AS new_title FROM acts_events), "
    "last_of AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_id "
    "ORDER BY id DESC) AS n FROM batch) b WHERE n = 1), "
    "first_of AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_id "
    "ORDER BY id) AS n FROM batch) b WHERE n = 1) "
)


def _sides(t):
    columns = [*KEYS, *KEPT, *UPDATES]
    old = t.events.filter(F.col("start_time") < ts(STORED_UNTIL)).select(*columns)
    stored = U.dedupe_last(old, KEYS, "id")
    batch = t.events.withColumn("title", F.concat("title", F.lit(" new"))).select(*columns)
    return stored, batch


_UPSERT_SQL = (
    "SELECT coalesce(s.source, l.source) AS source, coalesce(s.source_id, l.source_id) AS source_id, "
    "coalesce(s.id, f.id) AS id, coalesce(s.city_id, f.city_id) AS city_id, "
    "coalesce(l.new_title, s.title) AS title, {description} AS description, "
    "coalesce(l.start_time, s.start_time) AS start_time, coalesce(l.end_time, s.end_time) AS "
    "end_time FROM stored s FULL JOIN {row} l ON l.source = s.source AND l.source_id = s.source_id "
    "LEFT JOIN first_of f ON f.source = l.source AND f.source_id = l.source_id"
)


@query(
    "upsert_events",
    with_model(
        _SPLIT + _UPSERT_SQL.format(
            row="last_of", description="coalesce(l.description, s.description)"
        )
    ),
)
def upsert_events(t):
    stored, batch = _sides(t)
    return U.upsert(stored, batch, KEYS, UPDATES, "id")


@query(
    "upsert_events_partial",
    with_model(
        _SPLIT
        + "SELECT coalesce(s.source, f.source) AS source, coalesce(s.source_id, f.source_id) AS "
        "source_id, coalesce(s.id, f.id) AS id, coalesce(f.new_title, s.title) AS title, "
        "coalesce(f.description, s.description) AS description, "
        "coalesce(s.start_time, f.start_time) AS start_time FROM stored s FULL JOIN first_of f "
        "ON f.source = s.source AND f.source_id = s.source_id"
    ),
)
def upsert_partial(t):
    stored, batch = _sides(t)
    out = U.upsert(stored, batch, KEYS, ["title", "description"], "id", keep="first")
    return out.select(*KEYS, "id", "title", "description", "start_time")


@query(
    "insert_new_events",
    with_model(
        _SPLIT
        + "SELECT source, source_id, id, title FROM stored UNION ALL SELECT source, source_id, id, "
        "new_title FROM first_of f WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE "
        "s.source = f.source AND s.source_id = f.source_id)"
    ),
)
def insert_new(t):
    stored, batch = _sides(t)
    return U.insert_new(stored, batch, KEYS, "id").select(*KEYS, "id", "title")


@query(
    "existing_keys",
    with_model(
        _SPLIT + "SELECT b.id FROM batch b WHERE EXISTS (SELECT 1 FROM stored s WHERE "
        "s.source = b.source AND s.source_id = b.source_id)"
    ),
)
def existing(t):
    stored, batch = _sides(t)
    return U.existing_keys(batch, stored, KEYS).select("id")


@query(
    "merge_lookup",
    with_model(
        _SPLIT + "SELECT b.id, s.id AS old_id, s.title AS old_title FROM batch b LEFT JOIN stored s "
        "ON s.source = b.source AND s.source_id = b.source_id"
    ),
)
def lookup(t):
    stored, batch = _sides(t)
    return U.merge_lookup(batch, stored, KEYS, ["id", "title"]).select(
        "id", "old_id", "old_title"
    )


@query(
    "dedupe_last",
    with_model(_SPLIT + "SELECT source, source_id, id, new_title AS title FROM last_of"),
)
def last_version(t):
    return U.dedupe_last(_sides(t)[1], KEYS, "id").select(*KEYS, "id", "title")


@query(
    "dedupe_first",
    with_model(_SPLIT + "SELECT source, source_id, id, new_title AS title FROM first_of"),
)
def first_version(t):
    return U.dedupe_first(_sides(t)[1], KEYS, "id").select(*KEYS, "id", "title")


@query(
    "stage_raw",
    with_model(
        _SPLIT + f"SELECT source, source_id, id, TIMESTAMP '{AS_OF}' AS scraped_at, "
        "FALSE AS processed FROM first_of"
    ),
)
def staged(t):
    batch = _sides(t)[1].withColumn("raw_data", F.to_json(F.struct("title", "description")))
    out = U.stage_raw(None, batch.select(*KEYS, "id", "raw_data"), "id", AS_OF)
    return out.select(*KEYS, "id", "scraped_at", "processed")


@query(
    "needs_embedding",
    with_model(
        _SPLIT + "SELECT b.id, (s.id IS NULL OR s.vec_id IS NULL OR b.title IS DISTINCT FROM s.title "
        "OR b.description IS DISTINCT FROM s.description) AS needs_embedding FROM batch b LEFT JOIN "
        "stored s ON s.source = b.source AND s.source_id = b.source_id"
    ),
)
def embedding_needed(t):
    columns = [*KEYS, "id", "title", "description", "vec_id"]
    stored = U.dedupe_last(t.events.filter(F.col("start_time") < ts(STORED_UNTIL)).select(*columns), KEYS, "id")
    return U.needs_embedding(t.events, stored, KEYS, "vec_id").select("id", "needs_embedding")


_DETAIL_SQL = (
    ", d AS (SELECT s_suppkey AS id, concat('x', CAST(s_suppkey AS VARCHAR)) AS ext, "
    "CASE WHEN s_nationkey < 5 THEN NULL ELSE concat('http://s.org/', CAST(s_suppkey AS VARCHAR)) "
    "END AS website, s_nationkey / 5e0 AS rating, s_nationkey + 0.5e0 AS lat FROM supplier) "
)


@query(
    "merge_place_details",
    with_model(
        _DETAIL_SQL
        + "SELECT p.id, coalesce(d.ext, p.external_place_id) AS external_place_id, "
        "CASE WHEN p.id % 2 = 0 THEN 'http://own.org' ELSE d.website END AS website, d.rating, "
        "CASE WHEN d.id IS NOT NULL AND p.lat IS NULL THEN d.lat ELSE p.lat END AS lat, "
        f"CASE WHEN d.id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE p.last_synced_at END "
        "AS last_synced_at, CASE WHEN d.id IS NOT NULL THEN 'OPERATIONAL' ELSE p.business_status "
        "END AS business_status FROM places p LEFT JOIN d ON d.id = p.id"
    ),
)
def details_merged(t):
    places = t.places.withColumns(
        {
            "website": F.when(F.col("id") % 2 == 0, "http://own.org"),
            "phone": F.lit(None).cast("string"),
            "address": F.lit("").cast("string"),
            "rating": F.lit(None).cast("double"),
            "ratings_total": F.lit(None).cast("int"),
        }
    )
    key = F.col("s_suppkey").cast("string")
    details = t.raw("supplier").select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("x"), key).alias("external_place_id"),
        F.lit(None).cast(dict(places.dtypes)["hours"]).alias("hours"),
        F.when(F.col("s_nationkey") >= 5, F.concat(F.lit("http://s.org/"), key)).alias("website"),
        F.lit(None).cast("string").alias("phone"),
        (F.col("s_nationkey") / 5.0).alias("rating"),
        F.lit(9).alias("ratings_total"),
        (F.col("s_nationkey") + 0.5).alias("lat"),
        F.lit(1.0).alias("lng"),
        F.lit(None).cast("string").alias("business_status"),
        F.lit("1 High St").alias("address"),
        F.lit(None).cast("double").alias("lookup_lat"),
        F.lit(None).cast("double").alias("lookup_lng"),
    )
    return U.merge_place_details(places, details, AS_OF).select(
        "id", "external_place_id", "website", "rating", "lat", "last_synced_at", "business_status"
    )


# Feedback: lineitem rows as clicks on a logged request; the last line of an order wins.
@query(
    "apply_feedback",
    "SELECT o_orderkey AS id, f.l_partkey AS selected_id, CASE WHEN f.l_orderkey IS NOT NULL THEN "
    "'place' END AS selected_type, nullif(f.l_linenumber % 6, 0) AS feedback_rating FROM orders "
    "LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY "
    "l_linenumber DESC, l_partkey DESC) AS n FROM lineitem WHERE l_orderkey <> 0 AND l_partkey <> 0 "
    "AND l_returnflag <> 'N') x WHERE n = 1) f ON f.l_orderkey = o_orderkey",
)
def feedback(t):
    log = t.raw("orders").select(
        F.col("o_orderkey").alias("id"),
        F.lit(None).cast("bigint").alias("selected_id"),
        F.lit(None).cast("string").alias("selected_type"),
        F.lit(None).cast("int").alias("feedback_rating"),
    )
    given = t.raw("lineitem").select(
        F.col("l_orderkey").alias("recommendation_id"),
        F.col("l_partkey").alias("selected_id"),
        F.when(F.col("l_returnflag") == "N", "").otherwise("place").alias("selected_type"),
        (F.col("l_linenumber") % 6).alias("rating"),
        F.struct("l_linenumber", "l_partkey").alias("seq"),
    )
    return U.apply_feedback(log, given, "seq")


@query(
    "expire_events",
    with_model(
        f"SELECT id, is_active AND NOT start_time < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS "
        "is_active FROM acts_events"
    ),
)
def expired(t):
    return U.expire_events(t.events, AS_OF).select("id", "is_active")


@query(
    "touch_updated_at",
    with_model(
        f"SELECT id, CASE WHEN is_active AND start_time < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN "
        f"TIMESTAMP '{AS_OF}' ELSE scraped_at END AS updated_at FROM acts_events"
    ),
)
def touched(t):
    before = t.events.select(
        "id", "title", "start_time", "is_active", F.col("scraped_at").alias("updated_at")
    )
    after = U.touch_updated_at(before, lambda rows: U.expire_events(rows, AS_OF), AS_OF)
    return after.select("id", "updated_at")


@query(
    "run_summary",
    with_model(
        _SPLIT
        + ", checked AS (SELECT * FROM batch WHERE id % 17 <> 0), per AS (SELECT b.source, "
        "b.source_id, count(*) AS n, count(s.id) > 0 AS known FROM checked b LEFT JOIN stored s ON "
        "s.source = b.source AND s.source_id = b.source_id GROUP BY b.source, b.source_id) "
        "SELECT 'inserted' AS outcome, CAST(count(*) FILTER (WHERE NOT known) AS BIGINT) AS n "
        "FROM per UNION ALL SELECT 'updated', CAST(sum(CASE WHEN known THEN n ELSE n - 1 END) AS "
        "BIGINT) FROM per UNION ALL SELECT 'skipped', count(*) FROM batch WHERE id % 17 = 0"
    ),
)
def run_counts(t):
    """The merge of a run, written as it would be; the counts come from that run."""
    stored, batch = _sides(t)
    batch = batch.withColumn("title", F.when(F.col("id") % 17 != 0, F.col("title")))
    counts = Observation("merge")
    merged = U.upsert(stored, batch, KEYS, UPDATES, "id", checks=event_checks(), counts=counts)
    merged.write.parquet(shared_dir(t.spark, "merged"))
    return U.outcome_rows(t.spark, counts)


@query(
    "snapshot_swap",
    with_model(
        _SPLIT + _UPSERT_SQL.format(
            row="last_of", description="coalesce(l.description, s.description)"
        )
    ),
)
def snapshot(t):
    """Stored rows are committed, then the buckets that the batch touches are replaced in one step."""
    stored, batch = _sides(t)
    table = BucketedTable(t.spark, shared_dir(t.spark, "events"), KEYS, buckets=8)
    table.write(stored)
    table.merge(
        batch, lambda old, new: U.upsert(old, new, [IN_BUCKET, *KEYS], UPDATES, "id", deal_by=[IN_BUCKET]), dealt=True
    )
    return table.read()


@query(
    "staged_links",
    with_model(
        _SPLIT + "SELECT f.source, f.source_id, f.id, s.id AS event_id, s.id IS NOT NULL AS processed "
        "FROM first_of f LEFT JOIN stored s ON s.source = f.source AND s.source_id = f.source_id"
    ),
)
def staged_links(t):
    """Staged rows with the id of the stored event that they became."""
    stored, batch = _sides(t)
    rows = U.stage_raw(None, batch.select(*KEYS, "id"), "id", AS_OF)
    return U.link_staged(rows, stored, KEYS).select(*KEYS, "id", "event_id", "processed")
