"""Vector search: exact for one query, exact for many, and by probing lists."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from outings.functions.vectors import cosine_similarity, norm, vector_literal
from outings.operators.blocks import blocked_topk, whole_search
from outings.operators.modelblock import unit_matrix

#: Share of the lists that a query probes: vectors without structure need it for a recall of 0.9.
PROBED = 0.75
#: Every pair is scored here, so the items of a block are as many as a small matrix takes.
ITEM_MATRIX = 4096
#: Queries of a list that meet its items in one task; lists are many, so they need no smaller cuts.
LIST_QUERIES = 16384
#: About so many vectors, drawn at random, fit the centres; every vector is then put into its list.
FITTED = 65536


def semantic_scores(items: DataFrame, vector, embedding: str = "embedding") -> DataFrame:
    """All items with a vector, with their ``similarity`` to one query vector."""
    length = math.sqrt(sum(float(v) ** 2 for v in vector))
    scored = items.filter(F.col(embedding).isNotNull())
    value = cosine_similarity(
        F.col(embedding), vector_literal(vector), norm(F.col(embedding)), F.lit(length)
    )
    return scored.withColumn("similarity", value)


def semantic_topk(items: DataFrame, vector, k: int = 20, embedding: str = "embedding") -> DataFrame:
    """The ``k`` most similar items; each task keeps only its own best ``k``."""
    return (
        semantic_scores(items, vector, embedding)
        .select("type", "id", "similarity")
        .orderBy(F.desc("similarity"), "type", "id")
        .limit(k)
    )


def _cosine_blocks(it: pd.DataFrame):
    items = unit_matrix(it["embedding"]).T

    def score(q: pd.DataFrame) -> np.ndarray:
        return unit_matrix(q["q_vector"], items.shape[0]) @ items

    return score


def nearest(
    queries: DataFrame, items: DataFrame, k: int, item_order: list[str], group: str | None = None,
    **blocks,
) -> DataFrame:
    """Exact ``k`` nearest items per query (query_id, q_vector), within ``group`` if given."""
    known = items.filter(F.col("embedding").isNotNull())
    asked = queries.filter(F.col("q_vector").isNotNull())
    if group is None:
        group = "_all"
        known, asked = known.withColumn(group, F.lit(0)), asked.withColumn(group, F.lit(0))
    blocks = {"item_block": ITEM_MATRIX} | blocks
    return blocked_topk(
        asked.select("query_id", group, "q_vector"),
        known.select(group, *item_order, "embedding"),
        group, "query_id", item_order, whole_search(_cosine_blocks), k, **blocks,
    ).withColumnRenamed("score", "similarity")


def list_count(n: int) -> int:
    """The square root of the rows. Every task holds all centres, 8 bytes a dimension."""
    return max(1, math.ceil(math.sqrt(n)))


def assign_lists(items: DataFrame, n_lists: int, seed: int = 1, iterations: int = 10):
    """Items with their ``list_id`` and the list centres (k-means on unit vectors, fitted on about ``FITTED`` of them)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    known = items.filter(F.col("embedding").isNotNull()).withColumn(
        "_raw", array_to_vector(F.col("embedding").cast("array<double>"))
    )
    unit = Normalizer(inputCol="_raw", outputCol="_unit").transform(known)
    n = known.count()
    some = unit.sample(FITTED / n, seed=seed) if n > FITTED else unit
    model = KMeans(
        k=n_lists, seed=seed, maxIter=iterations, featuresCol="_unit", predictionCol="list_id"
    ).fit(some)
    return model.transform(unit).drop("_raw", "_unit"), np.stack(model.clusterCenters())


def probes(queries: DataFrame, centres: np.ndarray, n_probe: int) -> DataFrame:
    """Each query with the ``n_probe`` lists whose centres are nearest."""
    shared = queries.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def nearest_lists(vectors: pd.Series) -> pd.Series:
        c = shared.value
        unit = unit_matrix(vectors, c.shape[1])
        distance = (c * c).sum(axis=1)[None, :] - 2.0 * unit @ c.T
        order = np.argsort(distance, axis=1, kind="stable")[:, :n_probe]
        return pd.Series(list(order.astype("int32")))

    return queries.withColumn("list_id", F.explode(nearest_lists("q_vector")))


def ivf_topk(
    items: DataFrame, queries: DataFrame, k: int, item_order: list[str],
    n_lists: int | None = None, n_probe: int | None = None, **blocks,
) -> DataFrame:
    """Approximate nearest items: probe the nearest lists, rank their members exactly.

    All members of a probed list are ranked; a list of any size is cut into
    blocks. With ``n_probe >= n_lists`` the result is exact. ``n_lists`` defaults to ``list_count``,
    ``n_probe`` to the share ``PROBED`` of the lists at any size.
    """
    n_lists = n_lists or list_count(items.filter(F.col("embedding").isNotNull()).count())
    members, centres = assign_lists(items, n_lists)
    n_probe = n_probe or math.ceil(PROBED * len(centres))
    asked = probes(
        queries.filter(F.col("q_vector").isNotNull()), centres, min(n_probe, len(centres))
    )
    return nearest(asked, members, k, item_order, group="list_id", **({"query_block": LIST_QUERIES} | blocks))


def recall(approximate: DataFrame, exact: DataFrame, item_order: list[str]) -> DataFrame:
    """Share of the exact results that the approximate search found."""
    keys = ["query_id", *item_order]
    found = approximate.select(*keys, F.lit(1).alias("found"))
    return exact.join(found, keys, "left").agg(
        (F.count("found") / F.count(F.lit(1))).alias("recall")
    )
