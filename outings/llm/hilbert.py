"""Shards along a Hilbert curve through several metadata dimensions.

Documents are ordered by the curve index of their quantised metadata and the order is cut into runs of
near equal bytes. Neighbours on the curve are close in every dimension, so a shard covers a compact box
and filters on any of the dimensions skip most shards.

Equal texts always share a shard: the index is that of their group, whose metadata are the smallest of
its members', and cuts fall between groups. A shard is thus off its equal share of the bytes by less than
one group. The size of a document is its text's UTF-8 bytes plus 1; a null text counts as empty. Nulls in
a metadata column are a bin of their own. Within a shard the order is curve index, text digest, id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outings.llm.tables import written

BITS = 5


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with coordinates below ``2**bits`` (Skilling's transformation)."""
    x = [a.astype(np.int64).copy() for a in axes]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where(x[n - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | ((x[i] ^ flip) >> bit & 1)
    return index


def _curve(columns: list, bits: int):
    @F.pandas_udf("long")
    def place(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy() for a in axes], bits))

    return place(*columns)


def _category(column, bits: int):
    """Bin of a category: 0 for null, else by hash, so that new values need no new bins."""
    spread = F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit((1 << bits) - 1)) + 1
    return F.coalesce(spread, F.lit(0)).cast("int")


def _magnitude(column, bits: int):
    """Bin of a size: half powers of two."""
    return F.least(F.lit((1 << bits) - 1), F.floor(2 * F.log2(F.greatest(column, F.lit(1))))).cast("int")


def _running(ordered: DataFrame, value: str, group: str | None, out: str) -> DataFrame:
    """Adds ``part`` (the task's number) and ``out``, the sum of ``value`` over the task's earlier rows of ``group``."""
    schema = ordered.select("*", F.lit(0).alias("part"), F.lit(0).cast("long").alias(out)).schema

    def run(batches):
        part, sums = TaskContext.get().partitionId(), {}
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            groups = (
                batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
                if group
                else np.zeros(len(values), np.int64)
            )
            before = np.zeros(len(values), np.int64)
            for g in np.unique(groups):
                own = groups == g
                total = np.cumsum(values[own]) + sums.get(g, 0)
                before[own] = total - values[own]
                sums[g] = int(total[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(values), part, np.int32)), pa.array(before)],
                [*batch.schema.names, "part", out],
            )

    return ordered.mapInArrow(run, schema)


def _with_base(rows: DataFrame, value: str, group: str | None, before: str) -> DataFrame:
    """Turns sums within a task into sums over all earlier tasks too. There is one total per task and group."""
    keys = ["part", *([group] if group else [])]
    totals = rows.groupBy(*keys).agg(F.sum(value).alias("total"))
    window = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("part")
    base = totals.select(*keys, (F.sum("total").over(window) - F.col("total")).alias("base"))
    return rows.join(base, keys).withColumn(before, F.col(before) + F.col("base")).drop("base", "part")


def assign(
    docs: DataFrame,
    shards: int,
    id: str = "doc_id",
    text: str = "text",
    categories: tuple[str, ...] = ("lang", "source"),
    bits: int = BITS,
) -> DataFrame:
    """Per document: ``doc_id``, ``size``, ``text_crc32``, the dimensions ``bin_*``, ``curve``, ``shard`` and ``slot``
    (its place in the shard, from 0). Categories that ``docs`` lacks count as null."""
    body = F.coalesce(F.col(text), F.lit(""))
    present = [c for c in categories if c in docs.columns]
    narrow = written(
        docs.select(
            F.col(id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"), F.md5(body.cast("binary")).alias("digest"),
            *[F.col(c).cast("string").alias(f"by_{c}") for c in present],
        ),
        "narrow",
    )
    groups = narrow.groupBy("digest").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("size"),
        *[F.min(f"by_{c}").alias(f"by_{c}") for c in present],
    )
    bins = [_category(F.col(f"by_{c}"), bits).alias(f"bin_{c}") for c in present]
    groups = groups.select("digest", "bytes", *bins, _magnitude(F.col("size"), bits).alias("bin_size"))
    names = [c for c in groups.columns if c.startswith("bin_")]
    curve = groups.withColumn("curve", _curve([F.col(c) for c in names], bits))
    ordered = curve.repartitionByRange("curve", "digest").sortWithinPartitions("curve", "digest")
    placed = _with_base(written(_running(ordered, "bytes", None, "before"), "groups"), "bytes", None, "before")
    total = placed.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first().n
    middle = F.col("before") * 2 + F.col("bytes")
    cut = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * max(1, total)))).cast("int"))
    rows = narrow.select("doc_id", "size", "text_crc32", "digest").join(cut.drop("bytes", "before"), "digest")
    order = ["shard", "curve", "digest", "doc_id"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("one", F.lit(1).cast("long"))
    rows = written(_running(rows, "one", "shard", "slot"), "rows")
    return _with_base(rows, "one", "shard", "slot").drop("one", "digest")


def write(docs: DataFrame, assigned: DataFrame, path: str, id: str = "doc_id") -> None:
    """The documents as Parquet below ``path``, one folder per shard, in slot order. Ids must be unique."""
    where = assigned.select(F.col("doc_id").alias(id), "shard", "slot")
    rows = docs.drop("shard", "slot").join(where, id).repartitionByRange("shard", "slot")
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
