"""Byte-level BPE encoding and decoding by a two-tier lookup.

The first tier is a minimal perfect hash over the vocabulary: a pre-token that is an entry as a
whole has its id at once. The second tier merges the bytes of the others: a heap holds the ranks of
adjacent pairs, and linked neighbours let a merge touch its surroundings only.

Null and empty texts have no ids. Rows stay as they are: repeated rows are encoded each, columns of
the input other than the text pass through unless an output column has the same name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from outings.llm.textbytes import map_text, mix, prefix_hash, span_hash

#: Results kept per Python worker in each of two tables. When the young one is full it becomes the old one, whose
#: entries are dropped unless they are asked for again, so frequent pre-tokens stay however long the run.
MEMO_ENTRIES = 200_000
#: Longest pre-token kept in that table, in characters.
MEMO_CHARS = 64
_loaded: dict = {}


class PerfectHash:
    """Minimal perfect hash of byte strings: as many slots as entries, one probe per lookup.

    Entries fall into buckets of about two. From the largest bucket on, each bucket takes the first
    displacement that sends all its entries to free slots; buckets of one entry take the slots that
    are left and note them directly, as ``-1 - slot``. A slot keeps the hash of its entry, so strings
    outside the set are recognised.
    """

    def __init__(self, entries: list[bytes]):
        n = self.n = len(entries)
        self.n_buckets = max(1, n // 2)
        self.key = np.zeros(n, np.uint64)
        self.value = np.zeros(n, np.int64)
        self.shift = np.zeros(self.n_buckets, np.int64)
        if not n:
            return
        h = _hashes(entries)
        if len(np.unique(h)) != n:
            raise ValueError("two entries are equal or share their hash")
        bucket = (h % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.n_buckets)
        first = np.cumsum(sizes) - sizes
        taken = np.zeros(n, bool)
        slot_of = np.zeros(n, np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[: int((sizes > 1).sum())]:
            own = order[first[b] : first[b] + sizes[b]]
            self.shift[b], slot = self._place(h[own], taken)
            taken[slot] = True
            slot_of[own] = slot
        alone = np.flatnonzero(sizes == 1)
        left = np.flatnonzero(~taken)
        self.shift[alone] = -1 - left
        slot_of[order[first[alone]]] = left
        self.key[slot_of] = h
        self.value[slot_of] = np.arange(n)

    def _place(self, h: np.ndarray, taken: np.ndarray, tries: int = 32) -> tuple[int, np.ndarray]:
        start = 0
        while True:
            slots = self._slot(h, np.arange(start, start + tries, dtype=np.int64)[:, None])
            for i in np.flatnonzero(~taken[slots].any(axis=1)):
                if len(set(slots[i].tolist())) == len(h):
                    return start + int(i), slots[i]
            start += tries

    def _slot(self, h: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        moved = mix(h + displacement.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        return np.where(displacement < 0, -1 - displacement, (moved % np.uint64(self.n)).astype(np.int64))

    def find(self, strings: list[bytes]) -> np.ndarray:
        """Index of each string among the entries, or -1."""
        if not self.n or not strings:
            return np.full(len(strings), -1, np.int64)
        h = _hashes(strings)
        slot = self._slot(h, self.shift[(h % np.uint64(self.n_buckets)).astype(np.int64)])
        return np.where(self.key[slot] == h, self.value[slot], -1)


def _hashes(strings: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(s) for s in strings])
    sums, inv = prefix_hash(np.frombuffer(b"".join(strings), np.uint8))
    return span_hash(sums, inv, np.concatenate(([0], ends[:-1])), ends)


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: always merge the adjacent pair of lowest rank, leftmost first."""
    n, rank_of, push = len(piece), ranks.get, heapq.heappush
    end = list(range(1, n + 1))  # end of the part that starts here
    before = list(range(-1, n - 1))
    pair = [rank_of(piece[i : i + 2]) for i in range(n - 1)]  # rank of the part here and the next one
    pair.append(None)
    heap = [rank * n + i for i, rank in enumerate(pair) if rank is not None]
    heapq.heapify(heap)
    while heap:
        rank, left = divmod(heapq.heappop(heap), n)
        if pair[left] != rank:
            continue  # one of the two parts has changed
        right = end[left]
        end[left] = stop = end[right]
        pair[left] = pair[right] = None
        if stop < n:
            before[stop] = left
            if (rank := rank_of(piece[left : end[stop]])) is not None:
                pair[left] = rank
                push(heap, rank * n + left)
        if (p := before[left]) >= 0:
            pair[p] = rank = rank_of(piece[p:stop])
            if rank is not None:
                push(heap, rank * n + p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class ByteBpe:
    """A vocabulary of ranks with its two lookups; ``load`` keeps one per worker and file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} single bytes have no rank")
        self.ranks = ranks
        self.entries = list(ranks)
        self.ids = list(ranks.values())
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.whole = PerfectHash(self.entries)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.decimal = {i: str(i) for i in self.ids}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        if (path, pattern) not in _loaded:
            with open(path, "rb") as f:
                pairs = (line.split() for line in f if line.strip())
                ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
            _loaded[path, pattern] = cls(ranks, pattern)
        return _loaded[path, pattern]

    def resolve(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each distinct pre-token."""
        out, new = {}, []
        young, old = self.young, self.old
        for p in pieces:
            if (known := young.get(p)) is None:
                if (known := old.get(p)) is None:
                    new.append(p)
                    continue
                self._remember(p, known)
                young, old = self.young, self.old
            out[p] = known
        raw = [p.encode("utf-8") for p in new]
        for p, b, at in zip(new, raw, self.whole.find(raw).tolist(), strict=True):
            out[p] = ids = (self.ids[at],) if at >= 0 else tuple(merge_bytes(b, self.ranks))
            if len(p) <= MEMO_CHARS:
                self._remember(p, ids)
        return out

    def _remember(self, piece: str, ids: tuple[int, ...]):
        if len(self.young) >= MEMO_ENTRIES:
            self.old, self.young = self.young, {}
        self.young[piece] = ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each whole text."""
        split = [self.pattern.findall(t) for t in texts]
        get = self.resolve(list(dict.fromkeys(chain.from_iterable(split)))).__getitem__
        return [list(chain.from_iterable(map(get, pieces))) for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the token ids of each whole text."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def make(column):
        ids = ByteBpe.load(path, pattern).encode([t or "" for t in column.to_pylist()])
        return [pa.array(ids, pa.list_(pa.int32()))]

    return map_text(docs, text, schema, make)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the bytes that the ids stand for."""
    kept = [f for f in docs.schema if f.name != "decoded"]
    names = [f.name for f in kept]

    def run(batches):
        bpe = ByteBpe.load(path, pattern)
        for batch in batches:
            out = [bpe.decode(row or []) for row in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(names).columns, pa.array(out, pa.binary())], [*names, "decoded"]
            )

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("decoded", T.BinaryType(), False)]))


def round_trip(
    docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with the number of ids, a digest of the ids and one of the bytes decoded from them.

    Encoding and decoding in one pass: ids and bytes never leave the worker. ``keep``: columns that stay.
    """
    schema = (
        T.StructType().add("n_tokens", "long", False).add("ids_sha256", "string", False)
        .add("decoded_sha256", "string", False)
    )

    def make(column):
        bpe = ByteBpe.load(path, pattern)
        counts, ids_hex, bytes_hex = [], [], []
        for ids in bpe.encode([t or "" for t in column.to_pylist()]):
            counts.append(len(ids))
            ids_hex.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
            bytes_hex.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(bytes_hex, pa.string())]

    return map_text(docs, text, schema, make, keep)
