"""Token ids in compressed files: an adaptive context-mixing range coder in independent blocks.

A block codes up to ``BLOCK`` ids and starts from nothing but its head, which tells how often each id occurs in it.
Three predictions are mixed for each id: orders 2 and 1 each name the id that last followed the same two ids or one
id, order 0 is the distribution of the head. The mixture is their weighted sum, in whole numbers, so an id is coded in
one step with the probability that all three give it together. The weights are kept per state (how often in a row
orders 2 and 1 were right); after each id a weight moves towards its prediction's part in that id's probability.

Within a block an id is known by its place among the block's sorted ids: that place is also the count of all smaller
ids, and the sorted ids themselves are the table in which order 0 looks a value up. So no step searches a tree. Many
blocks are coded side by side, one numpy lane each, so a block costs no loop of its own.

A file holds the magic, the number of ids in the vocabulary, an index (document ids and lengths, compressed) and
blocks, each with its length, its size and the CRC-32 of its ids. Reading a file with a damaged block raises an
error.

Ids must be below 65,536. The string of a special token in a text gives that token's id. Null texts are empty; each document ends with one end id. Documents are ordered by
id; rows of one id keep any order among themselves, rows without id come first. An empty table gives no file.
"""

from __future__ import annotations

import os
import posixpath
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outings.llm.tables import written
from outings.session import shared_dir

BLOCK = 16_384
#: Blocks coded side by side, and ids after which a task closes a file. A small file has shorter blocks, down to
#: ``LEAST``, to have at least ``BESIDE`` of them.
LANES, FILE_IDS = 512, 8 << 20
LEAST, BESIDE = 4096, 256
MAGIC = b"TOKIDS3\n"
_BITS2 = 14
#: Weights are parts of 2**16, of which a step uses the highest 8 bits; a weight moves by 2**-_PACE of the distance.
_ONE, _STEP, _PACE = 1 << 16, 256, 5
#: Parts of a mixture: every named id has one part more than its weight, so that none is impossible, and so has order 0.
_PARTS = _STEP + 3
_WORD, _U32, _LOW32 = np.uint64(1 << 32), np.uint64(32), np.uint64((1 << 32) - 1)
#: Spellings that the tokenizer remembers.
MEMO_WORDS = 1 << 17


class _Mixer:
    """The predictors of all lanes, longest block first. Both directions call the same steps, so they stay equal.

    Ids are places: the first among the block's sorted ids at which the id stands. ``first`` holds the id's place at
    each place, ``count`` at an id's place how often it occurs.
    """

    def __init__(self, lengths: np.ndarray):
        lanes, self.width = len(lengths), int(lengths.max())
        kind = np.uint16 if 4 * self.width <= 1 << 16 else np.uint32
        self.length = lengths.astype(np.int64)
        self.first, self.count = np.zeros((lanes, self.width), kind), np.zeros((lanes, self.width), kind)
        # by context: four times the id that followed it last, and how often in a row it was right; 0: not seen
        self.next2, self.next1 = np.zeros(lanes << _BITS2, kind), np.zeros(lanes * (self.width + 1), kind)
        self.share = np.full((2, lanes * 16), _ONE >> 2, np.int64)
        lane = np.arange(lanes)
        self.base, self.base2, self.base1 = lane * self.width, lane << _BITS2, lane * (self.width + 1)
        self.states = lane * 16
        self.last = self.before = np.full(lanes, self.width)

    def keep(self, lanes: int):
        """Goes on with the first lanes only."""
        for name in ("length", "base", "base2", "base1", "states", "last", "before"):
            setattr(self, name, getattr(self, name)[:lanes])

    def predict(self):
        """Takes the ids named by orders 2 and 1 and the weights for the next step."""
        self.at2 = self.base2 + ((self.last * 40503 + self.before * 30011 >> 2) & ((1 << _BITS2) - 1))
        self.at1 = self.base1 + self.last
        held2, held1 = self.next2.take(self.at2).astype(np.int64), self.next1.take(self.at1).astype(np.int64)
        self.named2, self.sure2 = held2 >> 2, held2 & 3
        self.named1, self.sure1 = held1 >> 2, held1 & 3
        self.state = self.states + (self.sure2 * 4 + self.sure1)
        self.own = self.share.take(self.state, axis=1)
        weight2, weight1 = (self.own >> 8) + 1
        weight2 *= self.sure2 > 0
        weight1 *= self.sure1 > 0
        self.order0 = _PARTS - weight2 - weight1
        self.order2, self.order1 = weight2 * self.length, weight1 * self.length

    def interval(self, ids: np.ndarray):
        """Begin and width of the ids in the mixture, whose size is ``_PARTS`` times the block's length."""
        self.right2, self.right1 = self.named2 == ids, self.named1 == ids
        self.part2, self.part1 = self.order2 * self.right2, self.order1 * self.right1
        begin = self.order0 * ids + self.order2 * (self.named2 < ids) + self.order1 * (self.named1 < ids)
        return begin, self.order0 * self.count.take(self.base + ids) + self.part2 + self.part1

    def locate(self, value: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold the values."""
        named2, named1, order2, order1, order0 = self.named2, self.named1, self.order2, self.order1, self.order0
        alike = named2 == named1
        begin2, begin1 = order0 * named2 + order1 * (named1 < named2), order0 * named1 + order2 * (named2 < named1)
        end2 = begin2 + order2 + order1 * alike + order0 * self.count.take(self.base + named2)
        end1 = begin1 + order1 + order2 * alike + order0 * self.count.take(self.base + named1)
        past2, past1 = value >= end2, value >= end1
        left = value - order2 * past2 - order1 * past1  # what the named ids add to order 0, taken out
        place = np.minimum((left / order0).astype(np.int64), self.length - 1)  # far below 2**53, so exact
        ids = self.first.take(self.base + place).astype(np.int64)
        ids = np.where((begin1 <= value) & ~past1, named1, ids)
        return np.where((begin2 <= value) & ~past2, named2, ids)

    def learn(self, ids: np.ndarray, width: np.ndarray):
        """Learns from the ids, whose ``interval`` was the last one asked for."""
        part = (np.stack([self.part2, self.part1]) * _ONE / width).astype(np.int64)
        self.share[:, self.state] = self.own + ((part - self.own) >> _PACE)
        self.next2[self.at2] = ids * 4 + 1 + self.right2 * np.minimum(self.sure2, 2)
        self.next1[self.at1] = ids * 4 + 1 + self.right1 * np.minimum(self.sure1, 2)
        self.before, self.last = self.last, ids


def _packed(values: np.ndarray) -> bytes:
    """Positive numbers: their lengths in bits, by Huffman's code, then their bits after the first."""
    bits = np.frexp(values)[1].astype(np.int64) - 1
    deflate = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    sizes = deflate.compress(bits.astype(np.uint8).tobytes()) + deflate.flush()
    shift = np.repeat(np.cumsum(bits), bits) - 1 - np.arange(bits.sum())
    return struct.pack("<I", len(sizes)) + sizes + np.packbits(np.repeat(values, bits) >> shift & 1).tobytes()


def _unpacked(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """What ``_packed`` has put at a place, and the place after it."""
    (size,) = struct.unpack_from("<I", data, at)
    bits = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + size], -15), np.uint8).astype(np.int64)
    at, total = at + 4 + size, int(bits.sum())
    end = at + (total + 7) // 8
    digits = np.unpackbits(np.frombuffer(data[at:end], np.uint8), count=total).astype(np.int64)
    shift = np.repeat(np.cumsum(bits), bits) - 1 - np.arange(total)
    rest = np.concatenate(([0], np.cumsum(digits << shift)))
    ends = np.cumsum(bits)
    return (1 << bits) + rest[ends] - rest[ends - bits], end


def _by_length(lengths: np.ndarray) -> tuple[list[int], np.ndarray, list[int]]:
    """Blocks from the longest to the shortest, their lengths, and how many of them have each step."""
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    steps = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), "right")
    return order.tolist(), sizes, steps.tolist()


def encode_blocks(blocks: list[np.ndarray], n_ids: int) -> list[bytes]:
    """Code of each block of ids."""
    if not blocks:
        return []
    order, sizes, steps = _by_length(np.array([len(b) for b in blocks]))
    mixer, heads = _Mixer(sizes), []
    ids, place = np.zeros((mixer.width, len(blocks)), mixer.count.dtype), np.zeros(n_ids, np.int64)
    for lane, number in enumerate(order):
        count = np.bincount(blocks[number], minlength=1)
        held = np.flatnonzero(count)
        count = count[held]
        heads.append(_packed(np.diff(held, prepend=-1)) + _packed(count))
        place[held] = first = np.cumsum(count) - count
        mixer.count[lane, first] = count
        ids[: sizes[lane], lane] = place[blocks[number]]
    lanes = len(order)
    total = (_PARTS * sizes).astype(np.uint64)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    out, used = np.zeros((lanes, mixer.width + 1), np.uint32), np.zeros(lanes, np.int64)
    low_on, size_on = low, size
    for on, own in zip(steps, ids, strict=True):
        if on < len(low_on):
            low_on, size_on, total = low[:on], size[:on], total[:on]
            mixer.keep(on)
        own = own[:on].astype(np.int64)
        mixer.predict()
        begin, width = mixer.interval(own)
        step = size_on // total
        low_on += step * begin.astype(np.uint64)
        np.multiply(step, width.astype(np.uint64), out=size_on)
        go, at = _full(low_on, size_on)
        out[go, used[go]] = at >> _U32
        used[go] += 1
        mixer.learn(own, width)
    out[np.arange(lanes), used] = (low + _LOW32) >> _U32
    codes = [b""] * lanes
    for lane, number in enumerate(order):
        codes[number] = heads[lane] + out[lane, : used[lane] + 1].astype("<u4").tobytes()
    return codes


def _full(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose highest word is settled, and their beginnings until now. A range that crosses the word's end is
    cut down to settle it."""
    go = np.flatnonzero(size < _WORD)
    at = low[go]
    size[go] = np.minimum(size[go], _WORD - (at & _LOW32)) << _U32
    low[go] = at << _U32
    return go, at


def decode_blocks(codes: list[bytes], lengths: np.ndarray, n_ids: int) -> list[np.ndarray]:
    """Ids of each block."""
    if not codes:
        return []
    order, sizes, steps = _by_length(lengths)
    mixer, lanes = _Mixer(sizes), len(order)
    data = np.zeros((lanes, max(map(len, codes)) // 4 + 3), np.uint32)
    table = np.zeros((lanes, mixer.width), np.uint16)
    for lane, number in enumerate(order):
        try:
            held, at = _unpacked(codes[number], 0)
            count, at = _unpacked(codes[number], at)
            words = np.frombuffer(codes[number][at:], "<u4")
        except (zlib.error, struct.error, IndexError) as error:
            raise ValueError(f"block {number} is damaged") from error
        held, first = np.cumsum(held) - 1, np.cumsum(count) - count
        if len(held) != len(count) or count.sum() != sizes[lane] or held[-1] >= n_ids:
            raise ValueError(f"block {number} is damaged")
        table[lane, : sizes[lane]] = np.repeat(held, count)
        mixer.first[lane, : sizes[lane]] = np.repeat(first, count)
        mixer.count[lane, first] = count
        data[lane, : len(words)] = words
    total = (_PARTS * sizes).astype(np.uint64)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    code, used = data[:, 0].astype(np.uint64) << _U32 | data[:, 1], np.full(lanes, 2)
    out = np.zeros((mixer.width, lanes), mixer.first.dtype)
    low_on, size_on, code_on = low, size, code
    for on, row in zip(steps, out, strict=True):
        if on < len(low_on):
            low_on, size_on, code_on, total = low[:on], size[:on], code[:on], total[:on]
            mixer.keep(on)
        mixer.predict()
        step = size_on // total
        own = mixer.locate(np.minimum((code_on - low_on) // step, total - np.uint64(1)).astype(np.int64))
        begin, width = mixer.interval(own)
        low_on += step * begin.astype(np.uint64)
        np.multiply(step, width.astype(np.uint64), out=size_on)
        go, _ = _full(low_on, size_on)
        code_on[go] = code_on[go] << _U32 | data[go, np.minimum(used[go], data.shape[1] - 1)]
        used[go] += 1
        mixer.learn(own, width)
        row[:on] = own
    ids = [np.zeros(0, np.int64)] * lanes
    for lane, number in enumerate(order):
        ids[number] = table[lane, out[: sizes[lane], lane]].astype(np.int64)
    return ids


def _side_by_side(n: int) -> list[tuple[int, int]]:
    """``n`` blocks in runs of about equal length, at most ``LANES`` in each."""
    cuts = np.linspace(0, n, -(-n // LANES) + 1).astype(int).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def to_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, n_ids: int) -> bytes:
    """A file of whole documents. ``ids``: all ids, end to end. Missing document ids are the smallest integer."""
    if n_ids > 1 << 16 or len(ids) and (ids.min() < 0 or ids.max() >= n_ids):
        raise ValueError("an id is outside the vocabulary")
    index = zlib.compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes())
    long = min(BLOCK, max(LEAST, -(-len(ids) // BESIDE)))
    blocks = [ids[i : i + long] for i in range(0, len(ids), long)]
    parts = [MAGIC, struct.pack("<IIII", n_ids, len(doc_ids), len(index), len(blocks)), index]
    for lo, hi in _side_by_side(len(blocks)):
        lanes = blocks[lo:hi]
        for block, code in zip(lanes, encode_blocks(lanes, n_ids), strict=True):
            parts += [struct.pack("<III", len(block), len(code), zlib.crc32(block.astype("<u4").tobytes())), code]
    return b"".join(parts)


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a file; every block is held against its checksum."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    at = len(MAGIC)
    n_ids, n_docs, n_index, n_blocks = struct.unpack_from("<IIII", data, at)
    at += 16
    index = np.frombuffer(zlib.decompress(data[at : at + n_index]), "<i8")
    at += n_index
    heads, codes = [], []
    for _ in range(n_blocks):
        head = struct.unpack_from("<III", data, at)
        at += 12
        heads.append(head)
        codes.append(data[at : at + head[1]])
        at += head[1]
    ids = []
    for lo, hi in _side_by_side(n_blocks):
        part = heads[lo:hi]
        for head, block in zip(part, decode_blocks(codes[lo:hi], np.array([h[0] for h in part]), n_ids), strict=True):
            if zlib.crc32(block.astype("<u4").tobytes()) != head[2]:
                raise ValueError(f"block {lo} or later is damaged")
            ids.append(block)
    return index[:n_docs], index[n_docs:], np.concatenate(ids) if ids else np.zeros(0, np.int64)


_NO_ID = np.iinfo(np.int64).min
_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        if hasattr(_tokenizers[path].model, "_resize_cache"):
            _tokenizers[path].model._resize_cache(MEMO_WORDS)
    return _tokenizers[path]


def write_files(docs: DataFrame, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of ``docs`` to files in the shared folder. Gives one row per file in document order: ``part``,
    ``number``, ``path``, ``n_docs``, ``n_tokens``, ``n_bytes``.

    A task writes each file under a name of its own; only the files named in the result count, so lost or repeated
    tasks leave nothing but unnamed files.
    """
    folder = shared_dir(docs.sparkSession, "tokens")

    def run(batches):
        encode = _tokenizer(tokenizer)
        n_ids = encode.get_vocab_size(with_added_tokens=True)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        names, parts = [], []

        def close():
            lengths = np.array([len(p) for p in parts], np.int64)
            data = to_bytes(np.array(names, np.int64), lengths, np.concatenate(parts), n_ids)
            path = posixpath.join(root, f"{part:06d}-{number:06d}-{uuid.uuid4().hex}")
            with store.open_output_stream(path) as out:
                out.write(data)
            row = [part, number, path, len(parts), int(lengths.sum()), len(data)]
            names.clear(), parts.clear()
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], columns)

        held = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = batch.slice(lo, 64)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                for name, own in zip(rows.column(0).to_pylist(), encode.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                    names.append(_NO_ID if name is None else name)
                    parts.append(np.array([*own.ids, end_id], np.uint32))
                    held += len(parts[-1])
                if held >= FILE_IDS:
                    yield close()
                    number, held = number + 1, 0
        if parts:
            yield close()

    columns = ["part", "number", "path", "n_docs", "n_tokens", "n_bytes"]
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    schema = "part int, number int, path string, n_docs long, n_tokens long, n_bytes long"
    files = written(rows.mapInArrow(run, schema), "manifest")
    return files.withColumn("path", F.concat(F.lit(folder + "/"), F.substring_index("path", "/", -1)))


def read_files(files: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    One row per file passes through the driver, for the files' first places.
    """
    spark = files.sparkSession
    rows, start = [], 0
    for row in files.select("path", "n_tokens").orderBy("part", "number").toLocalIterator():
        rows.append((row.path, start))
        start += row.n_tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as stream:
                    names, lengths, ids = from_bytes(stream.read())
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(own.astype("<u4").tobytes()) for own in np.split(ids, ends[:-1])]
                doc_ids = pa.array(names, pa.int64(), mask=names == _NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(first + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return spark.createDataFrame(rows, "path string, start long").repartition(len(rows)).mapInArrow(run, schema)
