"""Streaming runs over the table files; each must equal its batch counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from outings.bindings import AS_OF, EVENT_COLUMNS, with_model
from outings.operators.ingest import KEYS
from outings.plans.landing import CALENDAR_SQL, feed_texts
from outings.plans.registry import query
from outings.session import shared_dir
from outings.sources.buckets import BucketedTable
from outings.sources.sinks import SnapshotTable
from outings.streaming import ingest as S

#: Enough for the test tables; a bucket should hold some hundred MB.
BUCKETS = 8


def _files(t, name: str) -> str:
    """A glob, so that a table may be one file or a folder of files."""
    return f"{t.path}/{{{name}}}.parquet"


def _event_stream(t):
    """The events table as a stream of its files, without vectors."""
    raw = S.table_stream(t.spark, _files(t, "events"), t.raw("events").schema)
    return raw.selectExpr(*[c for c in EVENT_COLUMNS if "{vectors}" not in c])


@query("stream_ingest", with_model(CALENDAR_SQL))
def stream_ingest(t):
    work = shared_dir(t.spark, "ingest")
    table = BucketedTable(t.spark, f"{work}/table", KEYS, BUCKETS)
    feeds = feed_texts(_event_stream(t))
    S.start_ingest(
        feeds, table, f"{work}/state", "cal", 1, AS_OF, f"{work}/rejected", seq="id"
    ).awaitTermination()
    return table.read().select(
        "source_id", "title", "slug", "vibe_quiet", "vibe_inside", "vibe_active",
        F.array_join("tags", ",").alias("tags"), "start_time",
    )


@query(
    "drain_staging",
    with_model(
        "SELECT source, source_id, id, title FROM (SELECT *, row_number() OVER (PARTITION BY source, "
        "source_id ORDER BY id DESC) AS n FROM acts_events) e WHERE n = 1"
    ),
)
def drain(t):
    work = shared_dir(t.spark, "drain")
    table = BucketedTable(t.spark, f"{work}/table", KEYS, BUCKETS)
    staged = _event_stream(t).select(
        *KEYS, "scraped_at",
        F.to_json(F.struct("id", "title", F.date_format("start_time", "yyyy-MM-dd").alias("day"))
                  ).alias("raw_data"),
    )

    def to_rows(batch):
        payload = F.from_json("raw_data", "id bigint, title string, day string")
        return batch.select(*KEYS, payload.alias("p")).select(*KEYS, "p.id", "p.title")

    S.drain_staging(
        staged, table, f"{work}/state", to_rows, ["id", "title"], "id", AS_OF, f"{work}/rejected"
    ).awaitTermination()
    return table.read().select(*KEYS, "id", "title")


@query("stream_dedupe", with_model("SELECT DISTINCT source, source_id FROM acts_events"))
def stream_dedupe(t):
    work = shared_dir(t.spark, "dedupe")
    stream = _event_stream(t).select(*KEYS, "start_time")
    table = BucketedTable(t.spark, f"{work}/rows", KEYS, BUCKETS, equal_nulls=True)
    S.dedupe_stream(stream, table, f"{work}/state").awaitTermination()
    return table.read().select(*KEYS)


@query(
    "stream_rejected",
    with_model("SELECT id, 'missing title' AS reason FROM acts_events WHERE id % 7 = 0"),
)
def stream_rejected(t):
    """What the ingest stream sets aside when every seventh event has no title."""
    work = shared_dir(t.spark, "rejected")
    events = _event_stream(t).withColumn("title", F.when(F.col("id") % 7 != 0, F.col("title")))
    table = BucketedTable(t.spark, f"{work}/table", KEYS, BUCKETS)
    S.start_ingest(
        feed_texts(events), table, f"{work}/state", "cal", 1, AS_OF, f"{work}/rejected", seq="id"
    ).awaitTermination()
    return t.spark.read.parquet(f"{work}/rejected").select("id", "reason")


@query(
    "stream_weekly",
    with_model(
        "SELECT CAST(date_trunc('week', start_time) AS TIMESTAMP) AS week, count(*) AS \"count\" "
        f"FROM acts_events WHERE is_active AND start_time > TIMESTAMP '{AS_OF}' GROUP BY 1"
    ),
)
def stream_weekly(t):
    work = shared_dir(t.spark, "weekly")
    table = SnapshotTable(t.spark, f"{work}/table")
    weekly = S.weekly_stream(_event_stream(t), AS_OF)
    S.write_complete(weekly, table, f"{work}/state").awaitTermination()
    return table.read()


@query(
    "stream_feedback",
    "SELECT o_orderkey AS id, f.l_partkey AS selected_id, nullif(f.l_linenumber % 6, 0) AS "
    "feedback_rating FROM orders LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION "
    "BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS n FROM lineitem WHERE "
    "l_orderkey <> 0 AND l_partkey <> 0) x WHERE n = 1) f ON f.l_orderkey = o_orderkey",
)
def stream_feedback(t):
    work = shared_dir(t.spark, "feedback")
    log = BucketedTable(t.spark, f"{work}/log", ["id"], BUCKETS)
    log.write(
        t.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.lit(None).cast("bigint").alias("selected_id"),
            F.lit(None).cast("string").alias("selected_type"),
            F.lit(None).cast("int").alias("feedback_rating"),
        )
    )
    clicks = S.table_stream(t.spark, _files(t, "lineitem"), t.raw("lineitem").schema).select(
        F.col("l_orderkey").alias("recommendation_id"),
        F.col("l_partkey").alias("selected_id"),
        F.lit("place").alias("selected_type"),
        (F.col("l_linenumber") % 6).alias("rating"),
        F.struct("l_linenumber", "l_partkey").alias("seq"),
    )
    S.feedback_stream(clicks, log, f"{work}/state", "seq").awaitTermination()
    return log.read().select("id", "selected_id", "feedback_rating")
