"""A stored table in hash buckets: a batch reads and rewrites only the buckets that hold its keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from outings.sources.commits import CommitLog, ConcurrentWrite

__all__ = ["IN_BUCKET", "BucketedTable", "ConcurrentWrite"]

IN_BUCKET, IN_PART = "in_bucket", "in_part"
#: A bucket of so many parts is rewritten as one by the next append.
MOST_PARTS = 16


class BucketedTable:
    """Rows by the hash of their ``keys`` in ``buckets`` folders, which hold parts.

    A version is a manifest: one row per bucket and part. A merge replaces the parts of the buckets that
    its batch touches, an append adds one part to each; all other files keep their names. The manifest
    becomes current by one commit record, and a writer that was overtaken is refused. ``expire`` removes what old
    versions alone use.

    Choose ``buckets`` so that one fits a task, some hundred MB: the driver handles bucket numbers and
    folder names, never rows. Rows with a NULL key are spread by all their columns, unless ``equal_nulls``
    says that NULL keys are equal.
    """

    _MANIFEST = "in_bucket INT, in_part STRING"

    def __init__(
        self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, equal_nulls: bool = False
    ):
        self.spark, self.keys, self.buckets, self.equal_nulls = spark, keys, buckets, equal_nulls
        self.log = CommitLog(spark, path)

    # ---- reading

    def version(self) -> int:
        return self.log.latest()[0]

    def _schema(self, record: dict) -> T.StructType:
        return T.StructType.fromJson(record["schema"])

    def _manifest(self, record: dict | None) -> DataFrame:
        if record is None:
            return self.spark.createDataFrame([], self._MANIFEST)
        return self.spark.read.schema(self._MANIFEST).parquet(f"{self.log.path}/{record['manifest']}")

    def _open(self, record: dict, only: list[int] | None = None) -> DataFrame:
        parts = self._manifest(record)
        if only is not None:
            parts = parts.filter(F.col(IN_BUCKET).isin(only))
        data = f"{self.log.path}/data"
        paths = [f"{data}/{IN_BUCKET}={r.in_bucket}/{IN_PART}={r.in_part}" for r in parts.collect()]
        schema = self._schema(record)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self) -> DataFrame | None:
        """The current version, or None before the first."""
        record = self.log.latest()[1]
        return None if record is None else self._open(record)

    # ---- writing

    def bucket(self, rows: DataFrame, keys: list[str], schema: T.StructType) -> Column:
        """Bucket of each row; key columns count in the stored types, so both sides of a merge agree."""
        typed = [F.col(k).cast(schema[own].dataType) for k, own in zip(keys, self.keys)]
        by_key = F.xxhash64(*typed)
        if not self.equal_nulls:
            null = [k.isNull() for k in typed]
            some_null = null[0]
            for n in null[1:]:
                some_null = some_null | n
            by_key = F.when(some_null, F.xxhash64(*rows.columns)).otherwise(by_key)
        return F.pmod(by_key, F.lit(self.buckets)).cast("int")

    def _store(self, rows: DataFrame, number: int) -> set[tuple[int, str]]:
        """Write rows that carry their bucket; returns the new (bucket, part)s."""
        part = f"{number:012d}-{uuid.uuid4().hex}"
        out = rows.withColumn(IN_PART, F.lit(part))
        out.write.mode("append").partitionBy(IN_BUCKET, IN_PART).parquet(f"{self.log.path}/data")
        found = self.log.folders(f"data/{IN_BUCKET}=*/{IN_PART}={part}")
        return {(int(f.split("/")[1].partition("=")[2]), part) for f in found}

    def _commit(self, base: int, kept: DataFrame | None, new: set, schema: T.StructType) -> None:
        rows = self.spark.createDataFrame(sorted(new), self._MANIFEST)
        rows = rows if kept is None else kept.unionByName(rows)
        folder = f"manifests/{base + 1:012d}-{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.log.path}/{folder}")
        self.log.commit(base, {"manifest": folder, "schema": schema.jsonValue(), "buckets": self.buckets})

    def write(self, rows: DataFrame) -> None:
        """Replace the whole table."""
        base, _ = self.log.latest()
        placed = rows.withColumn(IN_BUCKET, self.bucket(rows, self.keys, rows.schema))
        self._commit(base, None, self._store(placed.repartition(IN_BUCKET), base + 1), rows.schema)

    def merge(
        self, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame],
        keys: list[str] | None = None, columns: DataFrame | None = None, dealt: bool = False,
    ) -> list[int]:
        """Replace the touched buckets by ``change(their rows, batch)``; returns their numbers.

        Both sides carry ``IN_BUCKET``, and so must the result; ``dealt`` says that it is already dealt out by it.
        ``batch`` is evaluated twice: for its bucket numbers, and in ``change``. ``keys`` names
        the batch's columns if they differ from the table's, ``columns`` is a frame with the columns of a
        table that does not exist yet.
        """
        base, record = self.log.latest()
        schema = self._schema(record) if record else (batch if columns is None else columns).schema
        names = keys or self.keys
        placed = batch.withColumn(IN_BUCKET, self.bucket(batch, names, schema))
        touched = sorted(r[0] for r in placed.select(IN_BUCKET).distinct().collect())
        if not touched:
            return []
        old = self._open(record, touched) if record else self.spark.createDataFrame([], schema)
        old = old.withColumn(IN_BUCKET, self.bucket(old, self.keys, schema))
        rows = change(old, placed).select(*schema.names, IN_BUCKET)
        new = self._store(rows if dealt else rows.repartition(IN_BUCKET), base + 1)
        kept = self._manifest(record).filter(~F.col(IN_BUCKET).isin(touched))
        self._commit(base, kept, new, schema)
        return touched

    def append_new(self, batch: DataFrame) -> list[int]:
        """Add the rows whose key is not stored, one row per key; returns the buckets that grew.

        Only the touched buckets' key columns are read. A bucket of many parts is rewritten as one.
        """
        base, record = self.log.latest()
        schema = self._schema(record) if record else batch.schema
        placed = batch.dropDuplicates(self.keys).withColumn(IN_BUCKET, self.bucket(batch, self.keys, schema))
        if record:
            touched = [r[0] for r in placed.select(IN_BUCKET).distinct().collect()]
            stored = self._open(record, touched).select(*[F.col(k).alias(f"_{k}") for k in self.keys])
            same = F.lit(True)
            for k in self.keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            placed = placed.join(stored, same, "left_anti")
        new = self._store(placed.select(*schema.names, IN_BUCKET).repartition(IN_BUCKET), base + 1)
        if not new:
            return []
        kept = self._manifest(record)
        grown = sorted(b for b, _ in new)
        many = kept.filter(F.col(IN_BUCKET).isin(grown)).groupBy(IN_BUCKET).count()
        full = [r[0] for r in many.filter(F.col("count") >= MOST_PARTS).collect()]
        if full:
            old = self._open(record, full)
            old = old.withColumn(IN_BUCKET, self.bucket(old, self.keys, schema)).repartition(IN_BUCKET)
            new |= self._store(old, base + 1)
            kept = kept.filter(~F.col(IN_BUCKET).isin(full))
        self._commit(base, kept, new, schema)
        return grown

    def expire(self, seconds: float) -> int:
        """Remove the files of versions that were replaced more than ``seconds`` ago; returns how many folders."""

        def used(record: dict | None) -> set[str]:
            if record is None:
                return self.log.folders(f"data/{IN_BUCKET}=*/{IN_PART}=*", "manifests/*")
            parts = {f"data/{IN_BUCKET}={r.in_bucket}/{IN_PART}={r.in_part}" for r in self._manifest(record).collect()}
            return parts | {record["manifest"]}

        return self.log.expire(seconds, used)
