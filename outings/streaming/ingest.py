"""Streams over landing folders. Every run ends when the landed data is used up."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from outings.functions.times import ts
from outings.operators.ingest import calendar_events, upsert_calendar
from outings.operators.quality import missing, rejected_rows, valid_rows
from outings.operators.upsert import apply_feedback, upsert
from outings.sources.buckets import IN_BUCKET, BucketedTable
from outings.sources.ics import ics_events
from outings.sources.sinks import SnapshotTable


def feed_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Feed files as they land: (value, feed)."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path, wholetext=True).withColumn("feed", F.col("_metadata.file_path"))


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


@contextmanager
def kept(rows: DataFrame) -> Iterator[DataFrame]:
    """The parsed rows of a batch, stored while the merge reads them several times."""
    stored = rows.persist()
    try:
        yield stored
    finally:
        stored.unpersist()


def _set_aside(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def _run(stream: DataFrame, each: Callable, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_ingest(
    feeds: DataFrame, target: BucketedTable, checkpoint: str, source: str, city_id: int, as_of,
    rejected: str, seq: str = "position", rfc: bool = False,
) -> StreamingQuery:
    """New feed texts -> events -> tags and vibe -> upsert by (source, source_id).

    Only the buckets that hold a key of the batch are rewritten, in one pass. A batch that is replayed
    after a failure writes the same rows again, so the result does not change. Rows without title
    or start are written below ``rejected`` with their ``reason``, one folder per batch.
    """

    def merge(batch: DataFrame, number: int) -> None:
        with kept(ics_events(batch, rfc=rfc)) as parsed:
            rows, bad = calendar_events(parsed, source, city_id)
            _set_aside(bad, rejected, number)
            target.merge(
                rows, lambda old, new: upsert_calendar(old, new, seq, as_of, deal_by=[IN_BUCKET]),
                columns=rows.withColumn("updated_at", ts(as_of)), dealt=True,
            )

    return _run(feeds, merge, checkpoint)


def drain_staging(
    staged: DataFrame, target: BucketedTable, checkpoint: str, to_rows: Callable,
    update_cols: list[str], seq: str, as_of, rejected: str,
) -> StreamingQuery:
    """Process staged rows once each; the checkpoint takes the place of a processed flag.

    Versions of a key may arrive in any order: the stored ``seq``, one of ``update_cols``, decides which is the
    newest, so files in reversed order end as one batch would. Rows without one of the keys are written
    below ``rejected`` with their ``reason``.
    """
    keys = target.keys

    def merge(batch: DataFrame, number: int) -> None:
        checks = missing(*keys)
        with kept(to_rows(batch)) as rows:
            _set_aside(rejected_rows(rows, checks), rejected, number)
            target.merge(
                valid_rows(rows, checks), lambda old, new: upsert(
                    old, new, [IN_BUCKET, *keys], update_cols, seq, as_of=as_of, deal_by=[IN_BUCKET], guard=True
                ), dealt=True,
            )

    return _run(staged, merge, checkpoint)


def dedupe_stream(stream: DataFrame, table: BucketedTable, checkpoint: str) -> StreamingQuery:
    """Append rows whose key is not stored yet, one row per key.

    The stored keys take the place of state with a time limit: nothing is late, however far apart the
    rows' times are, and no state grows in memory. A batch reads the keys of the buckets that it
    touches and adds files to them; a replayed batch, or one after the checkpoint was lost, finds its keys stored.
    """
    return _run(stream, lambda batch, _: table.append_new(batch), checkpoint)


def weekly_stream(events: DataFrame, as_of, delay: str = "1 day") -> DataFrame:
    """Coming events per week (Monday start), updated as rows arrive."""
    from outings.operators.stats import coming

    return (
        coming(events, as_of)
        .withWatermark("start_time", delay)
        .groupBy(F.window("start_time", "7 days", startTime="4 days"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("window.start").alias("week"), "count")
    )


def feedback_stream(
    feedback: DataFrame, log: BucketedTable, checkpoint: str, seq: str
) -> StreamingQuery:
    """Merge arriving feedback into the log; only the buckets of its recommendations are rewritten."""

    def merge(batch: DataFrame, _: int) -> None:
        log.merge(batch, lambda old, new: apply_feedback(old, new, seq), keys=["recommendation_id"])

    return _run(feedback, merge, checkpoint)


def write_rows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to parquet files."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_complete(stream: DataFrame, target: SnapshotTable, checkpoint: str) -> StreamingQuery:
    """Keep an aggregate's full result as the current snapshot."""

    def replace(batch: DataFrame, _: int) -> None:
        target.write(batch)

    return _run(stream, replace, checkpoint, "complete")
