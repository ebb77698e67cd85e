"""Writers: recommendation log, CSV export, committed snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from outings.schemas import PLACES_CSV
from outings.sources.commits import CommitLog


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows, one folder per day."""
    rows.write.mode("append").partitionBy("log_date").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_rows(places: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The sheet's text columns in type and name order; NULL and 0 become ''."""

    def shown(c: str):
        value = F.col(c)
        return F.when(value.isNull() | (value == 0), "").otherwise(value.cast("string"))

    def text(c: str):
        return F.coalesce(F.col(c), F.lit(""))

    day = F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit(""))
    columns = {
        "ID": F.col("id").cast("string"),
        "Name": text("name"),
        "Type": text("category"),
        "Neighborhood": text("neighborhood"),
        "Story": text("story"),
        "Nudge": text("nudge"),
        "Vibe: Quiet": shown("vibe_quiet"),
        "Vibe: Inside": shown("vibe_inside"),
        "Vibe: Active": shown("vibe_active"),
        "Tags": F.coalesce(F.array_join("tags", ", "), F.lit("")),
        "Price Level": shown("price_level"),
        "Has Embedding": F.when(F.col(embedding).isNotNull(), "Yes").otherwise("No"),
        "Active": F.when(F.col("is_active"), "Yes").otherwise("No"),
        "Created At": day,
    }
    assert list(columns) == PLACES_CSV.fieldNames()
    return places.orderBy("category", "name", "id").select(
        *[c.alias(n) for n, c in columns.items()]
    )


def export_places_csv(places: DataFrame, path: str, embedding: str = "embedding") -> None:
    """Ordered part files: rows are range-sorted, never gathered in one task."""
    export_rows(places, embedding).write.mode("error").csv(
        path, header=True, escape='"', emptyValue=""
    )


class SnapshotTable:
    """A table that is replaced as a whole; versions become visible all at once.

    A version is written to its own folder, and a commit record makes it current. Of two
    writers the second is refused. ``BucketedTable`` is for large tables of which a batch changes little.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path)

    def current(self) -> dict | None:
        return self.log.latest()[1]

    def read(self) -> DataFrame | None:
        found = self.current()
        return None if found is None else self.spark.read.parquet(f"{self.log.path}/{found['folder']}")

    def write(self, df: DataFrame, *partition_by: str) -> None:
        base, _ = self.log.latest()
        folder = f"versions/{base + 1}-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.log.path}/{folder}")
        self.log.commit(base, {"folder": folder})

    def expire(self, seconds: float) -> int:
        """Remove versions that were replaced more than ``seconds`` ago."""
        return self.log.expire(seconds, lambda r: {r["folder"]} if r else self.log.folders("versions/*"))
