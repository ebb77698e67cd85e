"""Vector codes: each vector is cut into parts, and a part is stored as the number of its nearest codebook entry.

Components become integers ``floor(SCALE * x)``. A part position's codebook starts as that part of the
vectors with the smallest ids; a round assigns all parts and moves every used entry to the floored mean of its
parts. The nearest entry is exact, by slicing and intersecting: in each dimension the entries' coordinates are
sorted and every prefix of that order carries a uint64 mask of its entries, so two binary searches give the
mask of the entries within a radius. The masks of all dimensions are ANDed; what is left lies in a box that
holds every entry within the radius, and only those are measured. The initial radius is the distance to
one good entry (see ``nearest``), so the box never misses the nearest one. Ties go to the
smaller number.

One round is one pass over the rows. Tasks send sums by part and entry (at most ``64 * dimensions`` numbers
each), Spark adds them, and the driver holds codebooks only, whose size does not depend on the rows.

Vectors that are null, or hold null or non-finite components, are dropped; so are vectors whose length
differs from that of the kept vector with the smallest id (of equal ids: the greatest length), or is not a
multiple of the parts. Null ids come after all others; rows of one id are ordered by vector. Repeated rows count as often
as they occur. With fewer vectors than entries the codebooks are smaller; an empty table has an empty result.
Components of 2**26 / SCALE or more in magnitude are an error: squared distances must stay within a long.
Columns other than the id, the vector and the label are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings.llm.tables import written

SCALE = 4096
LIMIT = 1 << 26
ROWS = 4096
#: Labels of more rows are summed once and sent to all tasks; there is at most one a million rows.
HOT_ROWS = 1_000_000


class Codebook:
    """Entries of one part position, at most 64, with sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        bits = np.uint64(1) << order.astype(np.uint64)
        self.prefix = np.zeros((len(entries) + 1, entries.shape[1]), np.uint64)
        self.prefix[1:] = np.bitwise_or.accumulate(bits, axis=0)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries within ``radius`` of each row in every dimension."""
        mask = np.full(len(x), ~np.uint64(0))
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            mask &= self.prefix[high, d] & ~self.prefix[low, d]
        return mask

    def distance(self, x: np.ndarray, entry: np.ndarray | int) -> np.ndarray:
        gap = x - self.entries[entry]
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry and its squared distance.

        The guess that sets the radius is the entry next in the dimension in which entries are widest spread.
        """
        spread = int(np.argmax(self.sorted[-1] - self.sorted[0]))
        middles = (self.sorted[1:, spread] + self.sorted[:-1, spread]) / 2
        by_rank = np.argsort(self.entries[:, spread], kind="stable")
        code = by_rank[np.searchsorted(middles, x[:, spread])]
        least = self.distance(x, code)
        radius = np.floor(np.sqrt(least.astype(np.float64))).astype(np.int64) + 1
        mask = self.candidates(x, radius)
        for entry in range(len(self.entries)):
            rows = np.flatnonzero(mask >> np.uint64(entry) & np.uint64(1))
            if len(rows) == 0:
                continue
            far = self.distance(x[rows], entry)
            better = (far < least[rows]) | ((far == least[rows]) & (entry < code[rows]))
            code[rows[better]], least[rows[better]] = entry, far[better]
        return code, least


def _matrices(batch: pa.RecordBatch, at: int, width: int):
    """Slices of a batch with their components as one integer matrix each."""
    for first in range(0, batch.num_rows, ROWS):
        part = batch.slice(first, ROWS)
        flat = part.column(at).flatten().to_numpy(zero_copy_only=False)
        yield part, flat.reshape(len(part), width)


def _scaled(vector: str, scale: int, limit: int):
    """The vector as integers, or null if it is to be dropped."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    large = F.exists(x, lambda v: F.abs(v) * scale >= limit)
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    refused = F.raise_error(F.lit(f"vector component of {limit / scale:g} or more")).cast("array<long>")
    return F.when(F.coalesce(bad, F.lit(True)), None).when(large, refused).otherwise(whole)


def _step(rows: DataFrame, books: list[np.ndarray], parts: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    width = books[0].shape[1]

    def run(batches):
        held = [Codebook(b) for b in books]
        sums = np.zeros((parts, len(books[0]), width), np.int64)
        counts = np.zeros((parts, len(books[0])), np.int64)
        for batch in batches:
            for _, x in _matrices(batch, 0, parts * width):
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    code, _ = held[p].nearest(own)
                    np.add.at(sums[p], code, own)
                    counts[p] += np.bincount(code, minlength=counts.shape[1])
        part, entry = np.nonzero(counts)
        each = np.repeat(np.arange(len(part)), width)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part[each]), pa.array(entry[each]), pa.array(np.tile(np.arange(width), len(part))),
                pa.array(sums[part, entry].ravel()), pa.array(counts[part, entry][each]),
            ],
            ["part", "entry", "place", "total", "n"],
        )

    summed = rows.select("x").mapInArrow(run, "part long, entry long, place long, total long, n long")
    summed = summed.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    moved = [b.copy() for b in books]
    for r in summed.collect():  # entries times dimensions
        moved[r.part][r.entry, r.place] = r.total // r.n
    return moved


def _encoded(rows: DataFrame, books: list[np.ndarray], parts: int) -> DataFrame:
    width = books[0].shape[1]
    at = rows.columns.index("x")
    kept = [c for c in rows.columns if c != "x"]
    places = [rows.columns.index(c) for c in kept]
    codes = [T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())]
    schema = T.StructType([*[rows.schema[c] for c in kept], *codes])

    def run(batches):
        held = [Codebook(b) for b in books]
        for batch in batches:
            for part, x in _matrices(batch, at, parts * width):
                code = np.empty((len(x), parts), np.int32)
                error = np.zeros(len(x), np.int64)
                for p in range(parts):
                    code[:, p], least = held[p].nearest(x[:, p * width : (p + 1) * width])
                    error += least
                bounds = np.arange(len(x) + 1, dtype=np.int32) * parts
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(code.ravel()))
                columns = [*[part.column(i) for i in places], lists, pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def fit_encode(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id: str = "vec_id",
    vector: str = "embedding", label: str = "label", scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``id``, ``label``, ``codes`` and ``error`` of each kept vector, and the codebooks by part."""
    if not 1 <= entries <= 64:
        raise ValueError("a codebook has 1 to 64 entries")
    rows = vectors.select(
        F.col(id).alias("id"), F.col(label).alias("label"), _scaled(vector, scale, LIMIT).alias("x")
    ).filter("x IS NOT NULL")
    order = [F.col("id").asc_nulls_last(), F.size("x").desc(), "x"]
    first = rows.orderBy(*order).select(F.size("x").alias("n")).first()
    if first is None or first.n == 0 or first.n % parts:
        nothing = [F.lit(None).cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")]
        return rows.limit(0).select("id", "label", *nothing), []
    rows = written(rows.filter(F.size("x") == first.n), "vectors")
    start = np.array([r.x for r in rows.orderBy(*order).limit(entries).collect()], np.int64)
    books = [np.ascontiguousarray(b) for b in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        books = _step(rows, books, parts)
    return _encoded(rows, books, parts), books


def with_label_error(coded: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``label_error``, the errors summed over equal labels (nulls together).

    Sums of labels with many rows are few and broadcast; the other labels are joined by a shuffle.
    """
    coded = written(coded, "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    sums = written(sums.withColumnRenamed("label", "of"), "label_sums")
    same = F.col("label").eqNullSafe(F.col("of"))
    hot = F.broadcast(sums.filter(F.col("n") > hot_rows).drop("n"))
    rest = coded.join(hot, same, "left_anti").join(sums.filter(F.col("n") <= hot_rows).drop("n"), same)
    return coded.join(hot, same).unionAll(rest).drop("of")
