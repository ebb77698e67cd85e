"""Row checks: good rows go on, bad ones are set aside with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def missing(*names: str) -> dict[str, Column]:
    """A check per required column: absent means NULL or empty text."""
    return {
        f"missing {n}": F.col(n).isNull() | (F.col(n).cast("string") == "") for n in names
    }


def out_of_range(**bounds: tuple[float, float]) -> dict[str, Column]:
    """A check per column with bounds; NULL passes."""
    return {f"{n} out of range": ~F.col(n).between(lo, hi) for n, (lo, hi) in bounds.items()}


def too_long(**limits: int) -> dict[str, Column]:
    return {f"{n} too long": F.length(n) > limit for n, limit in limits.items()}


def event_checks() -> dict[str, Column]:
    return missing("title", "start_time")


# What the stored tables allow.
VIBE_RANGES = {"vibe_quiet": (0, 1), "vibe_inside": (0, 1), "vibe_active": (0, 1)}
PRICE_LEVELS = {"price_level": (1, 4)}
RATINGS = {"feedback_rating": (1, 5)}


def first_reason(checks: dict[str, Column]) -> Column:
    return F.coalesce(
        *[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]
    )


def valid_rows(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    return df.filter(first_reason(checks).isNull())


def rejected_rows(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    return df.withColumn("reason", first_reason(checks)).filter(F.col("reason").isNotNull())
