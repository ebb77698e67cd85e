"""Benchmark passages in documents, found by the q-gram lemma and verified by banded alignment.

Texts are lower-cased and every run of bytes that are neither letters, digits nor part of a non-ASCII
character becomes one space. An item of ``n`` bytes occurs in a text where some region is at most
``k = rate * n`` edits (of bytes) away from it. Such a region keeps at least ``n - q + 1 - k * q`` of
the item's q-grams, on diagonals (place in the text less place in the item) that span no more than
``k``. Bands of ``2 * (k + 1)`` diagonals, each half over the next, thus hold all of them in one band:
bands with fewer shared q-grams are dropped without loss, the others are aligned.

``k`` is lowered where the bound would vanish. Items shorter than one q-gram must occur exactly, between
spaces or text ends. Null and empty texts and items have no occurrences; repeated rows count each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings.llm.textbytes import keep_rows, lowered, prefix_hash, span_hash

Q = 10
RATE = 0.08
#: Text of the items that is indexed at once and sent to every task; more items are searched in more passes.
PASS_BYTES = 32 << 20
_FILTER_BITS = 22

_PLAIN = np.zeros(256, bool)
for _first, _last in ((48, 57), (97, 122), (128, 255)):
    _PLAIN[_first : _last + 1] = True


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of lower-cased texts, their offsets, and the place each byte comes from."""
    plain = _PLAIN[data]
    keep = plain.copy()
    keep[1:] |= plain[:-1]
    first = offsets[:-1]
    first = first[first < len(data)]
    keep[first] = True
    source = np.flatnonzero(keep)
    place = np.concatenate(([0], np.cumsum(keep)))
    return np.where(plain[source], data[source], 32).astype(np.uint8), place[offsets], source


def edit_distance(item: np.ndarray, text: np.ndarray, first: int, last: int, k: int) -> tuple[int, int]:
    """Least edits between the item and any region of the text that begins on diagonals ``first..last``; its end.

    Only diagonals at most ``k`` outside that range are filled.
    """
    width = last - first + 1 + 2 * k
    shift = np.arange(width)
    padded = np.zeros(len(item) + width, np.int16) - 1
    lo = first - k
    begin, end = max(0, lo), min(len(text), lo + len(padded))
    padded[begin - lo : end - lo] = text[begin:end]
    cost = np.where((shift + lo >= 0) & (shift + lo <= len(text)), 0, k + 1)
    big = np.int64(len(item) + width)
    for i, byte in enumerate(item):
        new = cost + (padded[i : i + width] != byte)
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        new = np.minimum.accumulate(new - shift) + shift
        inside = (shift + lo + i + 1 >= 0) & (shift + lo + i + 1 <= len(text))
        cost = np.where(inside, new, big)
    at = int(cost.argmin())
    return int(cost[at]), at + lo + len(item)


@dataclass
class Index:
    """Q-grams of a pass of items."""

    ids: pa.Array
    items: list[np.ndarray]
    budget: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    table: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]
    q: int

    @classmethod
    def build(cls, ids: pa.Array | list, texts: list[str], q: int, rate: float) -> Index:
        items = []
        for _, _, data, offsets in lowered(pa.array(texts, pa.string())):
            plain, ends, _ = normalise(data, offsets)
            items += [_strip(plain[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        size = np.array([len(i) for i in items], np.int64)
        budget = np.minimum((rate * size).astype(np.int64), np.maximum(0, (size - q) // q))
        hashes, owner, place, short = [], [], [], {}
        for n, item in enumerate(items):
            sums, inv = prefix_hash(item)
            if len(item) >= q:
                at = np.arange(len(item) - q + 1)
                hashes.append(span_hash(sums, inv, at, at + q))
                owner.append(np.full(len(at), n))
                place.append(at)
            elif len(item):
                whole = span_hash(sums, inv, np.array([0]), np.array([len(item)]))[0]
                short.setdefault(len(item), []).append((whole, n))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        hashes, owner, place = join(hashes, np.uint64), join(owner, np.int64), join(place, np.int64)
        order = np.argsort(hashes, kind="stable")
        table = np.zeros(1 << _FILTER_BITS, bool)
        table[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        short = {n: tuple(map(np.array, zip(*sorted(found), strict=True))) for n, found in short.items()}
        return cls(pa.array(ids) if isinstance(ids, list) else ids, items, budget, hashes[order], owner[order], place[order], table, short, q)

    def regions(self, sums, inv, size: int, offsets: np.ndarray):
        """Text, item and first diagonal of the bands that meet the bound."""
        starts = np.arange(max(0, size - self.q + 1))
        h = span_hash(sums, inv, starts, starts + self.q)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        row = np.searchsorted(offsets, at, "right") - 1
        whole = at + self.q <= offsets[row + 1]
        at, row = at[whole], row[whole]
        first = np.searchsorted(self.hashes, h[at], "left")
        count = np.searchsorted(self.hashes, h[at], "right") - first
        hit = np.repeat(np.arange(len(at)), count)
        entry = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        item, place = self.owner[entry], self.place[entry]
        step = self.budget[item] + 1
        diagonal = at[hit] - offsets[row[hit]] - place
        band = diagonal // step  # a band covers steps ``band`` and ``band + 1``
        keys = np.stack([np.tile(row[hit], 2), np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(place, 2)])
        if not keys.shape[1]:
            return keys[:3]
        keys = keys[:, np.lexsort(keys[::-1])]
        new = np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))  # a place of the item counts once
        keys = keys[:3, new]
        begin = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
        shared = np.diff(np.append(begin, keys.shape[1]))
        keys = keys[:, begin]
        need = np.array([len(i) for i in self.items])[keys[1]] - self.q + 1 - self.budget[keys[1]] * self.q
        return keys[:, shared >= need]

    def search(self, data: np.ndarray, offsets: np.ndarray):
        """Occurrences in lower-cased texts: text, item, edits, first and end byte."""
        plain, ends, source = normalise(data, offsets)
        sums, inv = prefix_hash(plain)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, band in self.regions(sums, inv, len(plain), ends).T.tolist():
            text, wanted, k = plain[ends[row] : ends[row + 1]], self.items[item], int(self.budget[item])
            first = band * (k + 1)
            edits, stop = edit_distance(wanted, text, first, first + 2 * k + 1, k)
            if edits <= k and ((row, item) not in best or edits < best[row, item][0]):
                best[row, item] = (edits, max(0, stop - len(wanted)), stop)
        for size, (hashes, owner) in self.short.items():
            at = np.arange(max(0, len(plain) - size + 1))
            at = at[np.isin(span_hash(sums, inv, at, at + size), hashes)]
            for start in at.tolist():
                row = int(np.searchsorted(ends, start, "right")) - 1
                lo, hi = int(ends[row]), int(ends[row + 1])
                edge = (start == lo or plain[start - 1] == 32) and (start + size == hi or plain[start + size] == 32)
                if start + size <= hi and edge:
                    value = span_hash(sums, inv, np.array([start]), np.array([start + size]))[0]
                    for n in owner[hashes == value].tolist():
                        best.setdefault((row, n), (0, start - lo, start - lo + size))
        for (row, item), (edits, start, stop) in sorted(best.items()):
            base, last = int(ends[row]), int(ends[row + 1]) - 1
            lo = int(source[min(base + start, last)] - offsets[row])
            hi = int(source[min(max(base + stop - 1, base), last)] - offsets[row]) + 1
            yield row, item, edits, lo, hi


def _strip(item: np.ndarray) -> np.ndarray:
    inner = np.flatnonzero(item != 32)
    return item[inner[0] : inner[-1] + 1] if len(inner) else item[:0]


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    q: int = Q,
    rate: float = RATE,
) -> DataFrame:
    """One row per document and item that occurs in it: ``doc_id``, ``item_id``, ``edits`` (the fewest), and the bytes
    ``start`` to ``end`` of the lower-cased text where the occurrence was found."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id].dataType), T.StructField("item_id", benchmark.schema[item_id].dataType),
            T.StructField("edits", T.IntegerType()), T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
    out = None
    for index in _indexes(benchmark, item_id, item_text, q, rate):
        part = docs.select(id, text).mapInArrow(_searcher(index), schema)
        out = part if out is None else out.unionAll(part)
    return out


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    q: int = Q,
    rate: float = RATE,
) -> DataFrame:
    """The rows of ``docs`` in whose text no item occurs."""
    for index in _indexes(benchmark, item_id, item_text, q, rate):
        docs = keep_rows(docs, text, _cleaner(index))
    return docs


def _indexes(benchmark: DataFrame, item_id: str, item_text: str, q: int, rate: float):
    """Broadcast indexes of the passes."""
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    passes = max(1, -(-total // PASS_BYTES))
    for number in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("t"), F.lit(passes)) == number).sort("i", "t").toArrow()
        index = Index.build(rows.column("i").combine_chunks(), rows.column("t").to_pylist(), q, rate)
        yield benchmark.sparkSession.sparkContext.broadcast(index)


def _cleaner(shared):
    def decide(column):
        keep = np.ones(len(column), bool)
        for first, _, data, offsets in lowered(column):
            keep[[first + row for row, *_ in shared.value.search(data, offsets)]] = False
        return keep

    return decide


def _searcher(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            ids = batch.column(0)
            found = []
            for first, _, data, offsets in lowered(batch.column(1)):
                found += [(first + row, *rest) for row, *rest in index.search(data, offsets)]
            rows, items, edits, starts, ends = zip(*found, strict=True) if found else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows, pa.int64())), index.ids.take(pa.array(items, pa.int64())),
                    pa.array(edits, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()),
                ],
                ["doc_id", "item_id", "edits", "start", "end"],
            )

    return run
