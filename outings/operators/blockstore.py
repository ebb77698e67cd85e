"""Top-k of a score over (query, item) pairs of a group, with every item written once.

``blocks`` copies a row to every block of the other side, so what it shuffles grows with the pairs. Here the items
of a group are put in order, alike ones side by side, and cut into blocks that go to files in the shared folder,
ready to be searched. A task holds a block of queries and opens the files of its group one after the other. Only
queries and names of files are dealt out, so shuffle and disk grow with the tables.

What a query has found so far is what the next file must beat. An outline of each file tells which queries may
find better ones in it; a file that none can use is not opened.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from outings.operators.blocks import FEW_GROUPS, _CUTS, _block_count, rank_top
from outings.session import shared_dir, stored

# Least and most queries of a task, and most items of a file.
QUERY_BLOCK, FILE_ITEMS = (1024, 32768), 65536
# Least partitions that the items are dealt to, so that tables of some ten million rows are put in order in memory,
# and most that the queries are dealt to.
LEAST_PARTITIONS, MOST_PARTITIONS = 64, 10_000

# Takes the items of a block in the order that breaks ties; returns an outline and the block as bytes.
Pack = Callable[[pd.DataFrame], tuple[bytes, bytes]]
# Takes queries, the outlines of files, and a function that reads the file with a number; returns what was found.
FileSearch = Callable[[pd.DataFrame, list[bytes], Callable[[int], bytes]], pd.DataFrame]


def write_blocks(items: DataFrame, group: str, alike: list[Column], item_order: list[str], pack: Pack, most: int) -> DataFrame:
    """Files of at most ``most`` items of one group, put in order by ``alike``: group, ``_path``, ``_outline``.

    A task writes each file under a name of its own; only the files named in the result count, so lost or repeated
    tasks leave nothing but unnamed files.
    """
    spark = items.sparkSession
    folder = shared_dir(spark, "blocks")
    keys = {f"_alike{i}": column for i, column in enumerate(alike)}

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, held, rows, number = TaskContext.get().partitionId(), [], 0, 0

        def close() -> pd.DataFrame:
            block = pd.concat(held, ignore_index=True).sort_values(item_order, ignore_index=True)
            outline, data = pack(block)
            name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}"
            with store.open_output_stream(posixpath.join(root, name)) as out:
                out.write(data)
            return pd.DataFrame({group: [block[group].iloc[0]], "_path": [f"{folder}/{name}"], "_outline": [outline]})

        for batch in batches:
            at = 0
            while at < len(batch):
                if held and (rows == most or batch[group].iloc[at] != held[-1][group].iloc[-1]):
                    yield close()
                    held, rows, number = [], 0, number + 1
                own = batch.iloc[at : at + most - rows]
                other = (own[group] != own[group].iloc[0]).to_numpy()
                own = own.iloc[: other.argmax()] if other.any() else own
                held.append(own)
                at, rows = at + len(own), rows + len(own)
        if held:
            yield close()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), LEAST_PARTITIONS)
    dealt = items.withColumns(keys).repartitionByRange(n, group, *keys).sortWithinPartitions(group, *keys).drop(*keys)
    schema = f"{group} {dict(items.dtypes)[group]}, _path string, _outline binary"
    return stored(dealt.mapInPandas(run, schema), "files")


def _few(sizes: DataFrame) -> tuple[DataFrame, list | None]:
    """A table with one row per group, sent to all tasks where it is short, and then its rows too."""
    rows = sizes.limit(FEW_GROUPS + 1).collect()
    if len(rows) > FEW_GROUPS:
        return sizes, None
    return F.broadcast(sizes.sparkSession.createDataFrame(rows, sizes.schema)), rows


def filed_topk(
    queries: DataFrame, items: DataFrame, group: str, query_id: str, item_order: list[str], alike: list[Column],
    pack: Pack, search: FileSearch, k: int, query_block: int | tuple[int, int] = QUERY_BLOCK,
    item_block: int | tuple[int, int] = FILE_ITEMS, extra: tuple[str, ...] = (),
) -> DataFrame:
    """Best ``k`` items per query: ``query_id``, ``item_order`` columns, score, rank, ``extra`` columns.

    ``queries`` are read twice, so they should be a table. ``search`` may return more than the best ``k``.
    """
    asked, _ = _few(_block_count(queries, group, query_block, "_nq"))
    most = item_block[1] if isinstance(item_block, tuple) else item_block
    files = write_blocks(items.join(asked.select(group), group, "left_semi"), group, alike, item_order, pack, most)
    # files are dealt out as well only where there are few blocks of queries
    parts = F.least(F.count(F.lit(1)), F.ceil(F.lit(_CUTS) / F.first("_nq"))).cast("int").alias("_nf")
    sizes, rows = _few(files.select(group).join(asked, group).groupBy(group).agg(F.first("_nq").alias("_nq"), parts))
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:  # twice as many partitions as tasks leave few that get several
        n = max(n, min(MOST_PARTITIONS, 2 * sum(r["_nq"] * r["_nf"] for r in rows)))
    keys = [group, "_qb", "_fb"]
    left = (
        queries.join(sizes, group)
        .withColumn("_qb", F.pmod(F.xxhash64(query_id), F.col("_nq")).cast("int"))
        .withColumn("_fb", F.explode(F.sequence(F.lit(0), F.col("_nf") - 1)))
        .drop("_nq", "_nf")
        .repartition(n, *keys)
    )
    nth = F.row_number().over(Window.partitionBy(group).orderBy("_path"))
    right = (
        files.withColumn("_nth", nth)
        .join(sizes, group)
        .withColumn("_fb", F.pmod("_nth", "_nf").cast("int"))
        .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
        .drop("_nq", "_nf", "_nth")
        .repartition(n, *keys)
    )
    types = dict(queries.dtypes) | dict(items.dtypes)
    names = [query_id, *item_order]
    schema = ", ".join([*(f"{c} {types[c]}" for c in names), "score double", *(f"{c} double" for c in extra)])

    def run(q: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        if q.empty or listed.empty:
            return pd.DataFrame(columns=[*names, "score", *extra], dtype=object)
        listed = listed.sort_values("_path")
        paths = listed["_path"].tolist()

        def read(number: int) -> bytes:
            store, path = fs.FileSystem.from_uri(paths[number])
            with store.open_input_stream(path) as stream:
                return stream.read()

        return search(q, listed["_outline"].tolist(), read)

    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)
    return rank_top(partial, [query_id], k, item_order)
