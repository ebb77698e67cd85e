"""Numpy views over the UTF-8 bytes of Arrow text columns: chunks, words and rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_K = 0x9E3779B97F4A7C15
_K_INV = pow(_K, -1, 1 << 64)
_powers = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64; kept per worker up to a few chunks."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        pair = []
        for base in (_K, _K_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        if size > 4 * CHUNK_BYTES:
            return pair[0], pair[1]
        _powers[size] = tuple(pair)
    return _powers[size]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: first row, end row, bytes, offsets from 0.

    A row longer than the limit is a run of its own.
    """
    data, offsets = text_buffer(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lowered(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Like ``chunks``, with the texts lower-cased; one run at a time."""
    for first, end, _, _ in chunks(column, limit):
        yield first, end, *text_buffer(pc.utf8_lower(column.slice(first, end - first)))


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which ``span_hash`` gives the hash of any span, and the inverse powers."""
    p, inv = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
    return sums, inv


def span_hash(sums: np.ndarray, inv: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the spans; equal bytes give equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs where ``inside`` holds, never across rows."""
    n = len(inside)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    begins = np.empty(n, bool)
    begins[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=begins[1:])
    ends = np.zeros(n + 1, bool)
    np.logical_and(inside[:-1], ~inside[1:], out=ends[1:n])
    ends[n] = inside[-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    joined = cut[inside[cut] & inside[cut - 1]]
    begins[joined] = True
    ends[joined] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(offsets, start, "right") - 1


#: Space and the five control characters 9 to 13 separate words.
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each white-space separated word, in order."""
    start, end, row = spans(_IN_WORD[data], offsets)
    sums, inv = prefix_hash(data)
    return span_hash(sums, inv, start, end), row


def map_text(docs, text: str, schema, make, keep: list[str] | None = None, limit: int = CHUNK_BYTES):
    """``docs`` with the columns of ``schema``, computed from the text column.

    ``make`` gets an Arrow column of whole texts (nulls as they are) of about ``limit`` bytes and gives
    the new columns. ``keep`` names the columns that stay (default: all); a new column replaces one of
    the same name.
    """
    from pyspark.sql import types as T

    new = [f.name for f in schema]
    kept = [f for f in docs.schema if f.name not in new and (keep is None or f.name in keep)]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            column = batch.column(names_in.index(text))
            for first, end, _, _ in chunks(column, limit):
                columns = make(column.slice(first, end - first))
                rest = [batch.column(names_in.index(n)).slice(first, end - first) for n in names]
                yield pa.RecordBatch.from_arrays([*rest, *columns], [*names, *new])

    source = docs.select(*dict.fromkeys([*names, text]))
    names_in = source.columns
    return source.mapInArrow(run, T.StructType([*kept, *schema]))


def keep_rows(docs, text: str, decide, limit: int = CHUNK_BYTES):
    """The rows of ``docs`` whose text ``decide`` keeps, with all their columns.

    ``decide`` gets an Arrow column of whole texts (nulls as they are) and gives one boolean per row.
    """
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for first, end, _, _ in chunks(batch.column(at), limit):
                rows = batch.slice(first, end - first)
                yield rows.filter(pa.array(decide(rows.column(at))))

    return docs.mapInArrow(run, docs.schema)
