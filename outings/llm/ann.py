"""Nearest vectors by inner product: probed lists scanned with adaptive dimensions.

Vectors are lifted onto a sphere by one more component, which turns the largest inner product into the
smallest distance, and grouped into lists around the leaves of a two-level k-means tree. A query probes the
lists whose centres are nearest. Small lists share a task, large ones are split. Within a list, vectors are rotated at random and stored in blocks of
columns. After each block of columns a test compares the distance extrapolated from the columns so far
with the query's current bound: a candidate that is farther with the confidence ``EPSILON`` is abandoned,
the rest goes on to the next columns. What remains after the last is scored exactly in double precision
on the original vectors.

Null vectors, zero vectors and vectors with null or non-finite components take no part, nor do vectors whose
length is not the most common one. A query probes more lists if the first ones hold too few vectors for a
full answer. Of equal vectors only the ``k + 1`` smallest ids can be among any answer, as ties go to the
smaller id; the others are left out before the search. Repeated rows of an id count as one if equal.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outings.llm.tables import written

EPSILON = 2.1
COLUMNS = 16
TILE = 512
#: Rows that meet in one task, on either side.
CANDIDATE_ROWS, QUERY_ROWS = 16_384, 4096
#: Vectors per list that the tree is fitted on.
SAMPLE_PER_LIST = 32
SEED = 7


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """``vec_id`` and ``vector`` of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size(v) == (size.n if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lift(x: np.ndarray, squared_radius: float) -> np.ndarray:
    """Points on the sphere: one component more, so that distances follow inner products."""
    rest = np.sqrt(np.maximum(0, squared_radius - (x * x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T)


def _centres(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means; empty clusters take over random points."""
    x = np.unique(x, axis=0)
    if len(x) <= n:
        return x
    centres = x[rng.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        own = _squared(x, centres).argmin(axis=1)
        count = np.bincount(own, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(1, count)[:, None], x[rng.integers(0, len(x), n)])
    return centres


class Tree:
    """Two levels of centres; the leaves are the lists."""

    def __init__(self, sample: np.ndarray, n_lists: int):
        rng = np.random.default_rng(SEED)
        self.top = _centres(sample, max(1, math.isqrt(n_lists)), rng)
        own = _squared(sample, self.top).argmin(axis=1)
        leaves, self.first = [], [0]
        for t in range(len(self.top)):
            part = sample[own == t]
            share = max(1, round(n_lists * len(part) / len(sample)))
            leaves.append(_centres(part, share, rng) if len(part) else self.top[t : t + 1])
            self.first.append(self.first[-1] + len(leaves[-1]))
        self.leaves = np.concatenate(leaves)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: the nearest leaf below the nearest centre of the first level."""
        out = np.zeros(len(x), np.int64)
        own = _squared(x, self.top).argmin(axis=1)
        for t in np.unique(own):
            rows = own == t
            leaves = self.leaves[self.first[t] : self.first[t + 1]]
            out[rows] = self.first[t] + _squared(x[rows], leaves).argmin(axis=1)
        return out

    def probe(self, x: np.ndarray, sizes: np.ndarray, n_probe: int, least: int) -> list[np.ndarray]:
        """Nearest non-empty lists of each vector: ``n_probe``, and on until they hold ``least`` vectors."""
        filled = np.flatnonzero(sizes)
        order = filled[np.argsort(_squared(x, self.leaves[filled]), axis=1, kind="stable")]
        held = np.cumsum(sizes[order], axis=1)
        need = np.maximum(n_probe, (held < least).sum(axis=1) + 1)
        return [row[:n] for row, n in zip(order, need, strict=True)]


def rotation(n: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(n, n)))
    return q * np.sign(np.diag(r))


def scan(
    query_ids: np.ndarray,
    queries: np.ndarray,
    probed: np.ndarray,
    ids: np.ndarray,
    vectors: np.ndarray,
    lists: np.ndarray,
    squared_radius: float,
    k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, candidate id and inner product of up to ``k`` best candidates of each query.

    ``lists`` numbers the list of each candidate, ``probed`` tells for each query which of them it visits.
    """
    turn = rotation(queries.shape[1] + 1)
    q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1) @ turn
    x = lift(vectors, squared_radius) @ turn
    width = x.shape[1]
    cuts = [*range(0, width, COLUMNS), width]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < COLUMNS // 2:
        del cuts[-2]
    blocks = [(np.ascontiguousarray(q[:, a:b]), np.ascontiguousarray(x[:, a:b]), b) for a, b in zip(cuts, cuts[1:], strict=False)]
    square = (q * q).sum(axis=1)
    room = 1e-9 * (squared_radius + square)
    bound = np.full(len(q), np.inf)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    fresh: list[tuple] = []

    def merge():
        row, id, score = (np.concatenate(c) for c in zip(best, *fresh, strict=True))
        fresh.clear()
        order = np.lexsort((id, -score, row))
        row, id, score = row[order], id[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row]
        last = row[rank == k - 1]
        bound[last] = square[last] + squared_radius - 2 * score[rank == k - 1]
        top = rank < k
        return row[top], id[top], score[top]

    def limit(seen: int) -> np.ndarray:
        """Distances from the first columns above which a candidate is abandoned."""
        certain = (1 + EPSILON / math.sqrt(seen)) ** 2 if seen < width else 1
        return (certain * bound + room) * (seen / width)

    order = np.argsort(lists, kind="stable")
    ends = np.cumsum(np.bincount(lists, minlength=probed.shape[1]))
    for number in range(probed.shape[1]):
        asking = np.flatnonzero(probed[:, number])
        own = order[ends[number - 1] if number else 0 : ends[number]]
        for lo in range(0, len(own) if len(asking) else 0, TILE):
            tile = own[lo : lo + TILE]
            part, alive = np.zeros((len(asking), len(tile))), None
            for n, (block_q, block_x, seen) in enumerate(blocks):
                part += _squared(block_q[asking], block_x[tile])
                alive = part <= limit(seen)[asking, None]
                if alive.mean() < 0.05:
                    break
            row, at = np.nonzero(alive)
            part = part[row, at]
            row, at = asking[row], tile[at]
            for block_q, block_x, seen in blocks[n + 1 :]:  # few are left: each on its own
                part = part + ((block_q[row] - block_x[at]) ** 2).sum(axis=1)
                stay = part <= limit(seen)[row]
                row, at, part = row[stay], at[stay], part[stay]
            other = ids[at] != query_ids[row]
            row, at = row[other], at[other]
            if len(row):
                fresh.append((row, ids[at], (queries[row] * vectors[at]).sum(axis=1)))
            if sum(len(f[0]) for f in fresh) > k * len(q):
                best = merge()
    return merge()


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    n_lists: int | None = None,
    probe: float = 0.75,
    id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest vectors found for each query, without the query's own id: ``query_id``, ``rank`` (from 1),
    ``vec_id``, ``score`` (inner product).

    ``n_lists``: default is the square root of the number of vectors. ``probe``: share of the lists that a query visits;
    clustered vectors need a small one, vectors without structure a large one. The tree is fitted on 32 vectors per list,
    chosen by a hash of the id; the tree and the sizes of the lists go to every task.
    """
    spark = vectors.sparkSession
    copies = Window.partitionBy("vector").orderBy("vec_id")
    own = usable(vectors, id, vector).withColumn("copy", F.dense_rank().over(copies)).filter(F.col("copy") <= k + 1)
    own = written(own.groupBy("vector", "vec_id").agg(F.lit(0)).select("vec_id", "vector"), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    facts = own.agg(F.count("*").alias("n"), F.max(square).alias("radius")).first()
    radius = facts.radius or 0.0
    n_lists = n_lists or max(1, math.isqrt(facts.n))
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_PER_LIST * n_lists).select("vector").toPandas()
    if sample.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(lift(np.stack(sample["vector"].to_numpy()), radius), n_lists)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                lists = shared.value.assign(lift(_matrix(batch.column(1)), radius))
                yield pa.RecordBatch.from_arrays([pa.array(lists), *batch.columns], ["list", "vec_id", "vector"])

    placed = written(own.mapInArrow(place, "list long, vec_id long, vector array<double>"), "placed")
    counted = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    sizes = np.array([counted.get(i, 0) for i in range(len(tree.leaves))])
    first, split = tasks_of_lists(sizes)
    known = spark.sparkContext.broadcast((sizes, first, split))
    n_probe = max(1, math.ceil(probe * np.count_nonzero(sizes)))

    def ask(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            sizes, first, split = known.value
            wanted = shared.value.probe(np.concatenate([x, np.zeros((len(x), 1))], axis=1), sizes, n_probe, k + 1)
            rows, tasks, lists = [], [], []
            for row, own in enumerate(wanted):
                copies = split[own]
                task = np.repeat(first[own], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                own = np.repeat(own, copies)
                order = np.argsort(task, kind="stable")
                names, begin = np.unique(task[order], return_index=True)
                rows += [row] * len(names)
                tasks += names.tolist()
                lists += np.split(own[order], begin[1:])
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tasks, pa.int64()), *taken.columns, pa.array(lists, pa.list_(pa.int64()))],
                ["task", "query_id", "vector", "lists"],
            )

    asked = usable(queries, id, vector).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = asked.filter(F.size("vector") == len(sample["vector"].iat[0]))
    asked = written(asked.mapInArrow(ask, "task long, query_id long, vector array<double>, lists array<long>"), "asked")
    per_task = asked.groupBy("task").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("nq"))
    spot = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    homes = spark.createDataFrame([(i, int(first[i]), int(split[i])) for i in range(len(sizes))], "list long, first long, split long")
    task = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("split"))
    right = placed.join(homes, "list").select(task.alias("task"), "list", "vec_id", "vector").join(per_task, "task")
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nq")
    left = asked.join(per_task, "task").withColumn("i", spot("query_id", F.col("nq"))).drop("nq")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if a.empty or b.empty:
            return empty
        here, number = np.unique(b["list"].to_numpy(), return_inverse=True)
        probed = np.zeros((len(a), len(here)), bool)
        for row, lists in enumerate(a["lists"]):
            probed[row] = np.isin(here, lists)
        asked = a["query_id"].to_numpy()
        row, found, score = scan(
            asked, np.stack(a["vector"]), probed, b["vec_id"].to_numpy(), np.stack(b["vector"]), number, radius, k
        )
        return pd.DataFrame({"query_id": asked[row], "vec_id": found, "score": score})

    right = right.toDF(*right.columns)
    found = left.groupBy("task", "i").cogroup(right.groupBy("task", "i")).applyInPandas(
        compare, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def tasks_of_lists(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First task of each list, and the number of tasks that share it. Neighbouring small lists share a task."""
    split = np.maximum(1, -(-sizes // CANDIDATE_ROWS))
    first, task, held = np.zeros(len(sizes), np.int64), 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > CANDIDATE_ROWS:
            task, held = task + 1, 0
        first[i] = task
        if split[i] > 1:
            task, held = task + int(split[i]), 0
        else:
            held += size
    return first, split
