"""The embedding job: due rows in batches, each committed on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from outings.session import shared_dir, stored
from outings.sources.buckets import BucketedTable

BATCH = "in_batch"


def embed_due(
    due: DataFrame, results: BucketedTable, embed: Callable[[DataFrame], DataFrame], batches: int = 16
) -> dict[str, int]:
    """Give every due row a vector that ``results`` has no row for yet; returns how many were embedded and failed.

    ``embed`` adds the column ``embedding``, NULL where the model failed; such rows are kept, so that they are
    counted and not asked for again. The due list is written once, dealt into ``batches``. A batch is embedded,
    written and then committed to ``results``. A run that stops half way is simply run again: committed
    batches are not due any more, so only the batch it was in is embedded twice.
    """
    spark, keys = due.sparkSession, results.keys
    done = results.read()
    if done is not None:
        due = due.join(done.select(*keys), keys, "left_anti")
    path = shared_dir(spark, "due")
    due.withColumn(BATCH, F.pmod(F.xxhash64(*keys), F.lit(batches)).cast("int")).write.partitionBy(BATCH).parquet(path)
    schema = T.StructType([*due.schema, T.StructField(BATCH, T.IntegerType())])
    listed = spark.read.schema(schema).parquet(path)
    total = failed = 0
    for number in sorted(r[0] for r in listed.select(BATCH).distinct().collect()):
        rows = stored(embed(listed.filter(F.col(BATCH) == number).drop(BATCH)), "embedded")
        results.append_new(rows)
        counts = rows.agg(F.count("*").alias("n"), F.count("embedding").alias("known")).first()
        total, failed = total + counts.known, failed + counts.n - counts.known
    return {"embedded": total, "failed": failed}
