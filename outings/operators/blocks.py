"""Top-k of a score over (query, item) pairs of a group without making pair rows.

Queries and items that share a group are cut into blocks of bounded size by a
hash. Each (query block, item block) meets in one task, where numpy scores the
block and only the best ``k`` per query leave it; a window merges the blocks.
A group of any size is spread over many tasks, and no task holds more than one
block of each side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# Least and most rows of a block of each side. A row is copied to every block of the other side that it meets, so the
# blocks of a large group grow until they reach the most; a small group is cut into about this many for the tasks.
QUERY_BLOCK, ITEM_BLOCK = (1024, 65536), (4096, 65536)
_CUTS = 8
# Rows scored at a time: keeps the matrices inside the processor cache.
_MATRIX_ROWS = 64
# So many groups with their sizes are sent to all tasks; more are joined by a shuffle.
FEW_GROUPS = 10_000

# Takes the items of a block, in the order that breaks ties, and the queries it meets, and returns the search of
# query rows in them: query number, item number and score of the k best of each, and further columns of these.
BlockSearch = Callable[[pd.DataFrame, pd.DataFrame], Callable[[pd.DataFrame, int], tuple]]


def best_per_row(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best finite scores per row; ties go to the first column."""
    n = scores.shape[1]
    if n > k:
        kth = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
        above = scores > kth
        level = scores == kth
        room = k - above.sum(axis=1, keepdims=True)
        keep = above | (level & (np.cumsum(level, axis=1) <= room))
    else:
        keep = np.ones_like(scores, dtype=bool)
    return np.nonzero(keep & np.isfinite(scores))


def _block_count(df: DataFrame, group: str, size: int | tuple[int, int], out: str) -> DataFrame:
    """Blocks per group: of ``size`` rows, or of a size between the two given ones that grows with the group."""
    least, most = size if isinstance(size, tuple) else (size, size)
    rows = F.count(F.lit(1))
    size = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(rows / _CUTS)))
    return df.groupBy(group).agg(F.ceil(rows / size).cast("int").alias(out))


def whole_search(scorer) -> BlockSearch:
    """Search by scoring all pairs: ``scorer(items)`` gives a function from query rows to a matrix of scores,
    -inf where a pair is not allowed."""

    def prepare(items: pd.DataFrame, queries: pd.DataFrame):
        score = scorer(items)

        def search(q: pd.DataFrame, k: int):
            scores = score(q)
            rows, cols = best_per_row(scores, k)
            return rows, cols, scores[rows, cols], {}

        return search

    return prepare


def pair_blocks(
    queries: DataFrame, items: DataFrame, group: str, query_id: str, item_order: list[str],
    query_block: int | tuple[int, int] = QUERY_BLOCK, item_block: int | tuple[int, int] = ITEM_BLOCK,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides cut into blocks, each copied to the blocks of the other side it meets.

    Returns the sides and the keys they meet on. Both sides are read twice, for the sizes and for the
    rows, so they should be tables. The number of partitions is fixed: small inputs must not be coalesced.
    """
    sizes = _block_count(queries, group, query_block, "_nq").join(
        _block_count(items, group, item_block, "_ni"), group
    )
    few = sizes.limit(FEW_GROUPS + 1).collect()
    if len(few) <= FEW_GROUPS:
        sizes = F.broadcast(queries.sparkSession.createDataFrame(few, sizes.schema))
    keys = [group, "_qb", "_ib"]
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = (
        queries.join(sizes, group)
        .withColumn("_qb", F.pmod(F.xxhash64(query_id), F.col("_nq")).cast("int"))
        .withColumn("_ib", F.explode(F.sequence(F.lit(0), F.col("_ni") - 1)))
        .drop("_nq", "_ni")
        .repartition(n, *keys)
    )
    right = (
        items.join(sizes, group)
        .withColumn("_ib", F.pmod(F.xxhash64(*item_order), F.col("_ni")).cast("int"))
        .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
        .drop("_nq", "_ni")
        .repartition(n, *keys)
    )
    return left, right, keys


def _plain(column: pd.Series) -> pd.Series:
    """Lists as text, so that rows can be put in order by them."""
    return column.map(lambda v: "\0".join(map(str, v)) if isinstance(v, (list, np.ndarray)) else v)


def in_blocks(
    left: DataFrame, right: DataFrame, keys: list[str], item_order: list[str], work, schema: str,
    chunk: int = _MATRIX_ROWS, alike: tuple[str, ...] = (),
) -> DataFrame:
    """``work(items, queries)(some query rows)`` on every pair of blocks; the items come in ``item_order``, the queries
    in chunks, put in order by the columns ``alike`` first."""
    names = [f.partition(" ")[0] for f in schema.split(", ")]

    def run(q: pd.DataFrame, it: pd.DataFrame) -> pd.DataFrame:
        if q.empty or it.empty:
            return pd.DataFrame(columns=names, dtype=object)
        each = work(it.sort_values(item_order, ignore_index=True), q)
        if alike:
            q = q.sort_values(list(alike), key=_plain)
        parts = [each(q.iloc[at : at + chunk]) for at in range(0, len(q), chunk)]
        return pd.concat(parts, ignore_index=True)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def blocked_topk(
    queries: DataFrame, items: DataFrame, group: str, query_id: str, item_order: list[str],
    search: BlockSearch, k: int, query_block: int | tuple[int, int] = QUERY_BLOCK,
    item_block: int | tuple[int, int] = ITEM_BLOCK, extra: tuple[str, ...] = (), chunk: int = _MATRIX_ROWS,
    alike: tuple[str, ...] = (),
) -> DataFrame:
    """Best ``k`` items per query: ``query_id``, ``item_order`` columns, score, rank, ``extra`` columns.

    ``item_order`` identifies an item and breaks ties. A query may appear in
    several groups (as when probing lists); results merge by ``query_id``.
    """
    left, right, keys = pair_blocks(
        queries, items, group, query_id, item_order, query_block, item_block
    )
    types = dict(queries.dtypes) | dict(items.dtypes)
    names = [query_id, *item_order]
    schema = ", ".join([*(f"{n} {types[n]}" for n in names), "score double", *(f"{n} double" for n in extra)])

    def work(it: pd.DataFrame, asked: pd.DataFrame):
        find = search(it, asked)

        def each(q: pd.DataFrame) -> pd.DataFrame:
            rows, cols, scores, more = find(q, k)
            best = it.iloc[cols][item_order].reset_index(drop=True)
            best.insert(0, query_id, q[query_id].to_numpy()[rows])
            return best.assign(score=scores, **{n: more[n] for n in extra})

        return each

    partial = in_blocks(left, right, keys, item_order, work, schema, chunk, alike)
    return rank_top(partial, [query_id], k, item_order)


def rank_top(
    scored: DataFrame, partition: list[str], k: int, tie_break: list[str],
    score: str | Column = "score",
) -> DataFrame:
    """Rank by score, then ``tie_break``; keep the first ``k``.

    Spark keeps at most ``k`` rows per key before the shuffle, so a hot key
    costs the shuffle no more than a cold one.
    """
    value = F.col(score) if isinstance(score, str) else score
    window = Window.partitionBy(*partition).orderBy(value.desc(), *tie_break)
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
