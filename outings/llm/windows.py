"""Passages that repeat: every window of words is hashed and counted, and repeated windows are cut out.

A window is ``size`` consecutive words of one document; a word is a run of bytes other than space and the
control characters 9 to 13. Rabin-Karp hashes of all windows come from prefix sums of word hashes. Spark
deals windows by hash and numbers the occurrences of each in the order of id and place; every window but
the first marks its words, and the marks of a document merge into maximal intervals. Windows are judged on
the input, so a removed passage still counts as an earlier occurrence.

A passage found in a third of all documents would send its windows to a few tasks. Occurrences within one
run of texts (``RUN_BYTES``) are therefore compared before the shuffle: later ones are marked at once, and
leave as merged intervals, so a window is sent once per run. The text itself is shuffled once, to meet
its intervals.

Hashes have 64 bits: among n windows, two different ones share a hash with a chance of about n * n / 2**65.

Null and empty texts have no words and lose none; a text of fewer than ``size`` words loses none. Long texts are
one row and take memory in proportion to their length. A null id comes before all others. Rows of the
same id and text are one document: none is the copy of another, and each gets that document's result.
Texts of the same id that differ are ordered by a hash. Empty tables give empty results. Other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings.llm.tables import written
from outings.llm.textbytes import _IN_WORD, chunks, mix, powers, prefix_hash, span_hash, spans

RUN_BYTES = 1 << 22
FINAL_BYTES = 1 << 20
#: A place is the text's tie-breaking hash (31 bits) and the number of a word (32 bits).
_TIE = 32


def window_hashes(words: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every window of ``size`` words of one row."""
    if len(words) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
    p, inv = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[: len(words)], out=sums[1:])
    return mix((sums[first + size] - sums[first]) * inv[first]), first


def merged(start: np.ndarray, stop: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals of sorted ones (by row and start); intervals that touch are joined."""
    if len(start) == 0:
        return start, stop, row
    begins = np.ones(len(start), bool)
    reach = np.maximum.accumulate(stop + row * (1 << 33)) - row * (1 << 33)
    begins[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(begins)
    return start[at], np.maximum.reduceat(stop, at), row[at]


def _tie(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 33)


def occurrences(docs: DataFrame, size: int) -> DataFrame:
    """``hash``, ``at``, ``id`` and ``words`` of the first occurrence of each window in each run of texts.

    Rows with ``words`` above 0 are intervals of windows that occur earlier in the same run.
    """
    schema = T.StructType(
        [
            T.StructField("hash", T.LongType()), T.StructField("at", T.LongType()),
            T.StructField("id", docs.schema["id"].dataType), T.StructField("words", T.LongType()),
        ]
    )
    names = [f.name for f in schema]

    def found(batch: pa.RecordBatch):
        data, offsets = next(iter(chunks(batch.column(2), 1 << 62)))[2:]
        begin, end, row = spans(_IN_WORD[data], offsets)
        sums, inv = prefix_hash(data)
        hashes, first = window_hashes(span_hash(sums, inv, begin, end), row, size)
        if len(hashes) == 0:
            return
        tie = batch.column(1).to_numpy()
        word = np.arange(len(row)) - np.searchsorted(row, np.arange(batch.num_rows))[row]
        order = np.argsort(hashes, kind="stable")
        again = np.zeros(len(order), bool)
        ranked = hashes[order]
        again[order[1:]] = ranked[1:] == ranked[:-1]
        lone, start = first[~again], word[first[again]]
        start, stop, of = merged(start, start + size, row[first[again]])
        at = np.concatenate([(tie[row[lone]] << _TIE) + word[lone], (tie[of] << _TIE) + start])
        key = np.concatenate([hashes[~again], mix(at[len(lone) :].astype(np.uint64) + np.uint64(1))])
        span = np.concatenate([np.zeros(len(lone), np.int64), stop - start])
        ids = batch.column(0).take(pa.array(np.concatenate([row[lone], of])))
        for begin in range(0, len(at), 1 << 17):
            part = slice(begin, begin + (1 << 17))
            columns = [pa.array(key.view(np.int64)[part]), pa.array(at[part]), ids[part], pa.array(span[part])]
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        for batch in batches:
            for first, end, _, _ in chunks(batch.column(2), RUN_BYTES):
                yield from found(_one_each(batch.slice(first, end - first)))

    return docs.select("id", "tie", "text").mapInArrow(run, schema)


def _one_each(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows by id (null first) and tie, one of each."""
    keys = [("id", "ascending"), ("tie", "ascending")]
    batch = batch.take(pc.sort_indices(batch, sort_keys=keys, null_placement="at_start"))
    ids = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
    ties = batch.column(1).to_numpy()
    fresh = np.ones(len(ties), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])
    return batch.filter(pa.array(fresh))


def intervals(found: DataFrame, size: int) -> DataFrame:
    """``id``, ``tie`` and the maximal intervals (``starts``, ``stops``, in words) that repeat something earlier."""
    order = Window.partitionBy("hash", F.col("words") > 0).orderBy(F.col("id").asc_nulls_first(), "at")
    later = found.withColumn("place", F.rank().over(order)).filter("words > 0 OR place > 1")
    packed = F.shiftleft(F.col("at"), 64 - _TIE).bitwiseOR(F.when(F.col("words") > 0, F.col("words")).otherwise(size))
    marks = later.groupBy("id", F.shiftright("at", _TIE).alias("tie")).agg(F.collect_list(packed).alias("marks"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*marks.schema.fields[:2], T.StructField("starts", longs), T.StructField("stops", longs)])

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            marks = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            start, length = marks >> _TIE, marks & ((1 << _TIE) - 1)
            order = np.lexsort((start, row))
            start, stop, row = merged(start[order], (start + length)[order], row[order])
            bounds = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in (start, stop)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "tie", "starts", "stops"])

    return marks.mapInArrow(run, schema)


def _cut(text: pa.Array, starts: pa.Array, stops: pa.Array) -> list[pa.Array]:
    """Words, words removed and the kept words joined by one space, of each text."""
    data, offsets = next(iter(chunks(text, 1 << 62)))[2:]
    begin, end, row = spans(_IN_WORD[data], offsets)
    base = np.searchsorted(row, np.arange(len(text) + 1))
    step = np.zeros(len(row) + 1, np.int64)
    of = np.repeat(np.arange(len(text)), pc.list_value_length(starts).fill_null(0).to_numpy(zero_copy_only=False))
    np.add.at(step, starts.flatten().to_numpy(zero_copy_only=False) + base[of], 1)
    np.add.at(step, stops.flatten().to_numpy(zero_copy_only=False) + base[of], -1)
    kept = np.cumsum(step[:-1]) == 0
    begin, end, of = begin[kept], end[kept], row[kept]
    left = np.bincount(of, minlength=len(text))
    # each kept word and a space, then without the last space of a text
    size = end - begin + 1
    ahead = np.cumsum(size) - size
    source = np.arange(int(size.sum())) + np.repeat(begin - ahead, size)
    joined = np.append(data, np.uint8(0x20))[source]
    joined[ahead + size - 1] = 0x20
    last = np.zeros(len(joined), bool)
    last[(ahead + size - 1)[np.append(of[1:] != of[:-1], True)] if len(of) else []] = True
    length = np.zeros(len(text), np.int64)
    np.add.at(length, of, size)
    bounds = np.concatenate([[0], np.cumsum(length - (left > 0))]).astype(np.int32)
    words = np.diff(base)
    body = pa.StringArray.from_buffers(len(text), pa.py_buffer(bounds), pa.py_buffer(joined[~last].tobytes()))
    return [pa.array(words), pa.array(words - left), body]


def drop_repeats(docs: DataFrame, size: int = 20, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id``, ``n_words``, ``n_removed``, the removed ``starts`` and ``stops`` (null if none) and ``kept``."""
    rows = docs.select(F.col(id).alias("id"), _tie(F.col(text)).alias("tie"), F.col(text).alias("text"))
    cuts = written(intervals(occurrences(rows, size), size), "intervals")
    cuts = cuts.select(F.col("id").alias("cut_id"), F.col("tie").alias("cut_tie"), "starts", "stops")
    met = rows.join(cuts, F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("tie") == F.col("cut_tie")), "left")
    met = met.select("id", "starts", "stops", "text")
    whole = T.LongType()
    counts = [T.StructField("n_words", whole), T.StructField("n_removed", whole), T.StructField("kept", T.StringType())]
    schema = T.StructType([*met.schema.fields[:3], *counts])

    def run(batches):
        for batch in batches:
            for first, end, _, _ in chunks(batch.column(3), FINAL_BYTES):
                part = batch.slice(first, end - first)
                columns = [*part.columns[:3], *_cut(part.column(3), part.column(1), part.column(2))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return met.mapInArrow(run, schema)
