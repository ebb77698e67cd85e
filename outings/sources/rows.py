"""Rows out of computed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def explode_computed(df: DataFrame, kept: list, array: Column, name: str) -> DataFrame:
    """``kept`` columns, ``position`` and one element per row.

    A plain explode of a computed array makes the optimizer test the array's
    size below it, which computes the array again. The outer form computes it
    once; the rows of empty arrays are dropped afterwards.
    """
    out = df.select(*kept, F.posexplode_outer(array).alias("position", name))
    return out.filter(F.col("position").isNotNull())
