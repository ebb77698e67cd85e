"""Intermediate tables in the cluster's shared folder, and connected components on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outings.session import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def least_frequent(counts: DataFrame, most: int) -> int:
    """Smallest value of ``n`` such that at most ``most`` rows of ``counts`` reach it."""
    held, least = 0, None
    for row in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        held += row["count"]
        if held > most:
            break
        least = row["n"]
    return least if least is not None else 1 << 62


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, of all nodes in ``links`` (``a``, ``b``).

    Every node points to the smallest of itself and its neighbours; links are carried over to the nodes
    pointed at until none is left between different nodes. Each round at least halves the nodes of a
    component, and a star is done in one.
    """
    links = written(links.select("a", "b").filter("a != b"), "links")
    nodes = links.select(F.col("a").alias("node")).unionAll(links.select("b")).distinct()
    labels = written(nodes.withColumn("component", F.col("node")), "labels")
    while links.limit(1).count():
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "step")
        moved = labels.join(step, labels["component"] == step["a"], "left")
        labels = written(moved.select("node", F.coalesce("to", "component").alias("component")), "labels")
        onward = step.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        links = links.join(step, "a").join(onward, "b").filter("to != to_b")
        links = written(
            links.select(F.least("to", "to_b").alias("a"), F.greatest("to", "to_b").alias("b")).distinct(), "links"
        )
    smallest = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(smallest, "component").select("node", F.col("least").alias("component"))
