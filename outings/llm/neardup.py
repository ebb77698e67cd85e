"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification.

A document's set holds the hashes of its distinct word shingles. The top bits of a hash choose one of
256 buckets; a bucket keeps its smallest remainder as a count of leading zeros and ten mantissa bits. An
empty bucket takes over the register of the filled bucket that comes first in its own fixed order, so
that small sets band as well as large ones. Six registers make a band; texts that share a band are
candidates. A candidate pair is verified on full sets unless its register matches, corrected for
accidental ones, put it at least six standard deviations below the threshold.

Equal sets are one class from the start. Candidates of a bucket are first compared with the bucket's
smallest class only (a star), which settles groups of near copies with as many comparisons as members.
Then all that is still unconnected within a bucket is compared: what is outside the bucket's largest
component with each other, and with every class of that component. Both happen in blocks of bounded
size, so no pair of unverified rows leaves a task and no group has to fit into one.

Words are separated by space and the control characters 9 to 13; A-Z is lower-cased. With fewer words
than a shingle has, the whole sequence is the set; without words or text the set is empty and linked
with nothing. Rows without id take no part (``component_id`` null, not kept). Rows that repeat an id are
the same document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outings.llm.tables import components, written
from outings.llm.textbytes import chunks, lower_ascii, map_text, mix, words

BUCKETS, MANTISSA = 256, 10
BAND = 6
BANDS = BUCKETS // BAND
#: Chance that different minima of a bucket have equal registers: equal zeros (1/3) and mantissa bits.
COLLISION = 2.0**-MANTISSA / 3
#: Rows of a block on either side of a comparison, and rows that one call compares.
LEFT_ROWS, RIGHT_ROWS, CALL_ROWS = 128, 256, 384

_order = np.argsort(np.random.default_rng(4).random((BUCKETS, BUCKETS)), axis=1).argsort(axis=1).astype(np.int16)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for first, end, data, offsets in chunks(column):
        h, row = words(lower_ascii(data), offsets)
        begin = np.searchsorted(row, np.arange(end - first + 1))
        shingle = h
        for k in range(1, size):
            shingle = mix(shingle[:-1] * np.uint64(3) + mix(h[k:] + np.uint64(k)))
        for lo, hi in zip(begin[:-1], begin[1:], strict=True):
            if hi - lo >= size:
                yield np.unique(shingle[lo : hi - size + 1])
            elif hi > lo:
                yield np.unique(mix(np.bitwise_xor.reduce(mix(h[lo:hi] + np.arange(hi - lo, dtype=np.uint64))[None], axis=1)))
            else:
                yield h[:0]


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted, non-empty set."""
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    filled, rest = bucket[at], hashes[at] << np.uint64(8)
    zeros = np.minimum(63 - np.floor(np.log2(np.maximum(rest, np.uint64(1)).astype(np.float64))), 56).astype(np.uint64)
    mantissa = (rest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = np.zeros(BUCKETS, np.uint16)
    out[filled] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    if len(filled) < BUCKETS:
        empty = np.setdiff1d(np.arange(BUCKETS), filled, assume_unique=True)
        out[empty] = out[filled[_order[empty][:, filled].argmin(axis=1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band; the band's number is part of it."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND):
        key = mix(key * np.uint64(31) + regs[k : BANDS * BAND : BAND].astype(np.uint64) + np.uint64(1))
    return key.view(np.int64)


def estimate(matches: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, without accidental matches."""
    return (matches / BUCKETS - COLLISION) / (1 - COLLISION)


def sketches(docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the set (null if empty) and its ``bands``."""

    def make(column):
        count, digest, bands = [], [], []
        for s in shingle_sets(column, size):
            count.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            bands.append(band_keys(registers(s)) if len(s) else [])
        return [pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_text(rows, "text", _schema("n_shingles long, digest binary, bands array<long>"), make, ["doc_id"])


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def _full_sets(docs: DataFrame, nodes: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """Sets and registers of the given classes."""

    def make(column):
        sets = list(shingle_sets(column, size))
        regs = [registers(s).tobytes() if len(s) else b"" for s in sets]
        return [
            pa.array([len(s) for s in sets], pa.int64()), pa.array(regs, pa.binary()),
            pa.array([s.tobytes() for s in sets], pa.binary()),
        ]

    rows = docs.select(F.col(id).cast("long").alias("node"), F.col(text).alias("text")).join(nodes, "node", "left_semi")
    return map_text(rows, "text", _schema("n long, regs binary, hashes binary"), make, ["node"])


def _verify(percent: int, first_band: bool):
    """Links between the left and right rows of each unit; one that would only close a circle may be left out."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            left, right = (side.sort_values("unit", kind="stable") for side in (left, right))
            regs_a, regs_b = (np.stack([np.frombuffer(r, np.uint16) for r in side["regs"]]) for side in (left, right))
            sets_a, sets_b = ([np.frombuffer(h, np.uint64) for h in side["hashes"]] for side in (left, right))
            n_a, n_b, node_a, node_b = (side[c].to_numpy() for c in ("n", "node") for side in (left, right))
            comp_a, comp_b, number = left["component"].tolist(), right["component"].tolist(), left["number"].to_numpy()
            root: dict[int, int] = {}

            def find(x):
                while (up := root.get(x, x)) != x:
                    root[x] = root.get(up, up)
                    x = up
                return x

            for i, j in _pairs(left["unit"].to_numpy(), right["unit"].to_numpy()):
                small, large = np.minimum(n_a[i], n_b[j]), np.maximum(n_a[i], n_b[j])
                near = (100 * small >= percent * large) & (node_a[i] != node_b[j])
                i, j, small = i[near], j[near], small[near]
                slack = 6 * np.sqrt(percent * (100 - percent) / 1e4 / np.minimum(BUCKETS, small))
                near = estimate((regs_a[i] == regs_b[j]).sum(axis=1)) >= percent / 100 - slack
                for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
                    one, two = find(comp_a[x]), find(comp_b[y])
                    if one == two or first_band and not _first_band(regs_a[x], regs_b[y], number[x]):
                        continue
                    both = len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True))
                    if 100 * both >= percent * (len(sets_a[x]) + len(sets_b[y]) - both):
                        root[max(one, two)] = min(one, two)
                        out.append((int(node_a[x]), int(node_b[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _pairs(left: np.ndarray, right: np.ndarray, limit: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the pairs of left and right rows with equal (sorted) units, some thousand at a time."""
    lo, hi = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
    count = hi - lo
    begin, ends = 0, np.cumsum(count)
    while begin < len(left):
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
        own = count[begin:end]
        i = np.repeat(np.arange(begin, end), own)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + lo[i]
        begin = end


def _first_band(a: np.ndarray, b: np.ndarray, key: int) -> bool:
    """Whether the band with this key is the first that the two share; each pair counts in one bucket."""
    shared = np.flatnonzero((a == b)[: BANDS * BAND].reshape(BANDS, BAND).all(axis=1))
    return len(shared) > 0 and band_keys(a)[shared[0]] == key


def _compare(left: DataFrame, right: DataFrame, sets: DataFrame, percent: int, first_band: bool = False) -> DataFrame:
    """Links between left and right rows (``number``, ``node``, ``component``) of the same number.

    Both sides of a number are dealt into blocks; a left and a right block are a unit. A call works on about
    ``CALL_ROWS`` rows of many small units or few large ones. (Should two units share their hash, some more pairs are
    verified.)
    """
    sizes = (
        left.groupBy("number").agg(F.count("*").alias("l"), F.lit(0).alias("r"))
        .unionAll(right.groupBy("number").agg(F.lit(0).alias("l"), F.count("*").alias("r")))
        .groupBy("number").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).filter("l > 0 AND r > 0")
        .withColumn("nl", F.ceil(F.col("l") / LEFT_ROWS).cast("int"))
        .withColumn("nr", F.ceil(F.col("r") / RIGHT_ROWS).cast("int"))
    )
    sizes = written(sizes, "sizes")
    rows = sizes.agg(F.coalesce(F.sum(F.expr("l * nr + r * nl")), F.lit(0)).alias("n")).first().n
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sizes = sizes.select("number", "nl", "nr")
    a = left.join(sizes, "number").withColumn("i", spot("nl")).withColumn("j", every("nr"))
    b = right.join(sizes, "number").withColumn("j", spot("nr")).withColumn("i", every("nl"))

    def side(rows_of):
        unit = F.xxhash64("number", "i", "j")
        out = rows_of.select("number", "node", "component", unit.alias("unit")).join(sets, "node")
        out = out.withColumn("call", F.pmod(F.col("unit"), F.lit(rows // CALL_ROWS + 1)))
        return out.toDF(*out.columns).groupBy("call")  # names of its own for either side

    return side(a).cogroup(side(b)).applyInPandas(_verify(percent, first_band), "a long, b long")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable over links
    of at least ``percent`` % Jaccard similarity) and ``kept`` (whether that is the row's own)."""
    sketch = written(sketches(docs, id, text, shingle), "sketches")
    full = sketch.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(full.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    leaders = full.join(classes.select("node"), F.col("doc_id") == F.col("node"), "left_semi")
    banded = leaders.select(F.col("doc_id").alias("node"), F.explode("bands").alias("number"))
    shared = banded.groupBy("number").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    member = written(banded.join(shared.select("number", "least"), "number"), "members")
    sets = written(_full_sets(docs, member.select("node").distinct(), id, text, shingle), "sets")

    star = member.filter("node > least").select(F.col("least").alias("number"), "node").distinct()
    centre = star.select("number").distinct().withColumn("node", F.col("number"))
    own = F.col("node").alias("component")
    links = written(_compare(centre.select("*", own), star.select("*", own), sets, percent), "star")
    joined = written(components(links), "components")

    labelled = member.join(joined, "node", "left").select(
        "number", "node", F.coalesce("component", "node").alias("component")
    )
    labelled = written(labelled, "labelled")
    per = labelled.groupBy("number", "component").agg(F.count("*").alias("n"))
    open_ = (
        per.groupBy("number").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"))
        .filter("parts > 1").select("number", F.col("top.component").alias("main"))
    )
    outside = written(labelled.join(open_, "number").filter("component != main"), "outside")
    among = outside.drop("main")
    with_main = outside.select(F.col("main").alias("number"), "node", "component").distinct()
    mains = with_main.select("number").distinct()
    whole = labelled.select("node", "component").distinct()
    inside = whole.join(mains, whole["component"] == mains["number"]).select("number", "node", "component")
    more = _compare(among, among, sets, percent, first_band=True).unionAll(_compare(with_main, inside, sets, percent))
    final = components(links.unionAll(more))

    class_of = classes.join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    rows = full.select("doc_id", "n_shingles", "digest").join(class_of, "digest").drop("digest")
    alone = sketch.filter("digest IS NULL OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component")
    )
    return rows.unionAll(alone).select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"),
    )
