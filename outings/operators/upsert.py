"""Snapshot-in, snapshot-out mutations.

A merge is one pass: target and batch rows travel together and are reduced per
key in one exchange. Where the target is large and the batch small, the target is
a ``BucketedTable``, which hands in only the buckets that the batch touches.
A key with a NULL part never matches, as in SQL uniqueness.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import (
    Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T,
)

from outings.functions.times import ts
from outings.operators.quality import first_reason


def _keyed(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def _alone(keys: list[str]) -> Column:
    """A number of its own for each row whose key has a NULL, 0 for all others."""
    return F.when(_keyed(keys), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id() + 1)


def dedupe(df: DataFrame, keys: list[str], seq: str, keep: str) -> DataFrame:
    """First or last row per key by ``seq``; rows whose key has a NULL all stay.

    Spark keeps one row per key and task before the shuffle, so a key with very
    many copies does not load one task.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    order = F.col(seq).asc() if keep == "first" else F.col(seq).desc()
    window = Window.partitionBy(*keys, "_alone").orderBy(order)
    ranked = df.withColumn("_alone", _alone(keys)).withColumn("_n", F.row_number().over(window))
    return ranked.filter(F.col("_n") == 1).drop("_n", "_alone")


def dedupe_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return dedupe(df, keys, seq, "last")


def dedupe_first(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return dedupe(df, keys, seq, "first")


def existing_keys(batch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Batch rows whose key is in the target.

    The target's key columns are first cut to the batch's keys, so the large
    side is neither shuffled nor broadcast when the batch is small.
    """
    wanted = batch.select(*keys).distinct()
    hits = target.select(*keys).join(wanted, keys, "left_semi").distinct()
    return batch.join(hits, keys, "left_semi")


def new_keys(batch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    wanted = batch.select(*keys).distinct()
    hits = target.select(*keys).join(wanted, keys, "left_semi").distinct()
    return batch.join(hits, keys, "left_anti")


def merge_lookup(batch: DataFrame, target: DataFrame, keys: list[str], columns: list[str]):
    """Batch rows with the stored ``columns`` (prefixed ``old_``) where the key exists."""
    old = target.select(*keys, *[F.col(c).alias(f"old_{c}") for c in columns])
    return batch.join(old, keys, "left")


def insert_new(target: DataFrame, batch: DataFrame, keys: list[str], seq: str | None = None):
    """Target plus batch rows with a new key; with ``seq`` the first of repeats only, in one pass."""
    if seq:
        return upsert(target, batch, keys, [], seq, keep="first")
    return target.unionByName(new_keys(batch, target, keys).select(*target.columns))


def upsert(
    target: DataFrame, batch: DataFrame, keys: list[str], update_cols: list[str], seq: str,
    keep: str = "last", as_of=None, checks: dict[str, Column] | None = None,
    counts: Observation | None = None, deal_by: list[str] | None = None, guard: bool = False,
) -> DataFrame:
    """Insert new keys, overwrite ``update_cols`` of known ones; the target has one row per key.

    ``keep='last'`` treats batch repeats like row-by-row upserts: updated columns come from the last
    row by ``seq``, all others of a new key from the first. ``keep='first'`` takes the first row only, as
    an insert that drops conflicts inside its own batch. With ``as_of``, ``updated_at`` is set on every
    row that is touched.

    Both sides are one tagged union, reduced per key by partial aggregates, so repeats of a hot key
    shrink before the only exchange. ``deal_by`` names columns (a function of the keys, such as a bucket)
    by which the union is dealt out first; the reduction then needs no exchange of its own.
    ``guard`` leaves a known row alone if its stored ``seq`` is above all of the batch's, so versions may
    arrive in any order. Batch rows that fail ``checks`` are left out. ``counts`` observes, in the same run, the input rows
    ``inserted`` (the first row of a new key), ``updated`` (its repeats, and all rows of known keys) and
    ``skipped``; it counts behind the exchange, in the tasks that write the result.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    good = first_reason(checks).isNull() if checks else F.lit(True)
    kept = list(dict.fromkeys([*(c for c in target.columns if c in batch.columns), *update_cols]))
    old = target.select(
        *keys, F.struct(*target.columns).alias("_old"), F.lit(None).cast(_struct(batch, kept)).alias("_new"),
        F.lit(None).cast(batch.schema[seq].dataType).alias("_seq"), F.lit(False).alias("_bad"),
    )
    new = batch.select(
        *keys, F.lit(None).cast(_struct(target, target.columns)).alias("_old"),
        F.when(good, F.struct(*kept)).alias("_new"), F.col(seq).alias("_seq"), (~good).alias("_bad"),
    )
    both = old.unionByName(new)
    if deal_by:
        both = both.repartition(*deal_by)
    alone = F.when(F.col("_bad"), F.monotonically_increasing_id() + 1).otherwise(_alone(keys))
    is_new = F.col("_new").isNotNull()
    last = F.max_by("_new", F.struct(is_new, "_seq"))
    first = F.min_by("_new", F.struct(~is_new, "_seq"))
    reduced = both.withColumn("_alone", alone).groupBy(*keys, "_alone").agg(
        F.any_value("_old", F.lit(True)).alias("_old"), (last if keep == "last" else first).alias("_last"),
        first.alias("_first"), F.count("_new").alias("_n"), F.max("_bad").alias("_bad"),
        F.max(F.when(is_new, F.col("_seq"))).alias("_top"),
    )
    known, hit = F.col("_old").isNotNull(), F.col("_n") > 0
    if guard:
        hit = hit & F.coalesce(~(F.col("_top") < F.col(f"_old.{seq}")), F.lit(True))
    if counts is not None:
        fresh = F.when(known | ~hit, 0).otherwise(1)
        reduced = reduced.observe(
            counts, F.sum(fresh).alias("inserted"), F.sum(F.col("_n") - fresh).alias("updated"),
            F.sum(F.col("_bad").cast("long")).alias("skipped"),
        )
    columns = []
    for c in target.columns:
        if c in keys:
            value = F.col(c)
        elif c in update_cols:
            value = F.when(hit, F.col(f"_last.{c}")).otherwise(F.col(f"_old.{c}"))
        else:
            default = ts(as_of) if c == "updated_at" and as_of is not None else F.lit(None)
            value = F.when(known, F.col(f"_old.{c}"))
            if c == "updated_at" and as_of is not None:
                value = F.when(known, F.when(hit, ts(as_of)).otherwise(F.col("_old.updated_at")))
            value = value.otherwise(F.col(f"_first.{c}") if c in kept else default)
        columns.append(value.cast(target.schema[c].dataType).alias(c))
    return reduced.filter(known | hit).select(*columns)


def link_staged(staged: DataFrame, events: DataFrame, keys: list[str], id: str = "id") -> DataFrame:
    """Staged rows with ``event_id``, the stored event of their key, and ``processed`` where there is one."""
    known = events.select(*keys, F.col(id).alias("event_id"))
    return staged.drop("event_id", "processed").join(known, keys, "left").withColumn(
        "processed", F.col("event_id").isNotNull()
    )


def _struct(df: DataFrame, columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, df.schema[c].dataType) for c in columns])


def touch_updated_at(before: DataFrame, change: Callable[[DataFrame], DataFrame], as_of) -> DataFrame:
    """``before`` after ``change``, with ``updated_at`` set on the rows that it altered.

    The old values travel along in a column, so the table is read once and nothing is joined;
    ``change`` must pass columns through that it does not know.
    """
    others = F.struct(*[c for c in before.columns if c != "updated_at"])
    altered = ~others.eqNullSafe(F.col("_old"))
    return change(before.withColumn("_old", others)).withColumn(
        "updated_at", F.when(altered, ts(as_of)).otherwise(F.col("updated_at"))
    ).drop("_old")


def outcome_rows(spark: SparkSession, counts: Observation | None) -> DataFrame:
    """The counts of a finished merge as rows: outcome, n; all 0 without one."""
    seen = counts.get if counts else dict.fromkeys(("inserted", "updated", "skipped"), 0)
    rows = [(name, seen[name] or 0) for name in ("inserted", "updated", "skipped")]
    return spark.createDataFrame(rows, "outcome string, n long")


def needs_embedding(batch: DataFrame, target: DataFrame, keys: list[str], embedding="embedding"):
    """Batch rows with ``needs_embedding``: new, without a vector, or with changed text."""
    joined = merge_lookup(
        batch, target.withColumn("known", F.lit(True)), keys,
        ["known", embedding, "title", "description"],
    )
    changed = ~F.col("title").eqNullSafe(F.col("old_title")) | ~F.col("description").eqNullSafe(
        F.col("old_description")
    )
    flag = F.col("old_known").isNull() | F.col(f"old_{embedding}").isNull() | changed
    return joined.withColumn("needs_embedding", flag)


def stage_raw(staged: DataFrame | None, batch: DataFrame, seq: str, as_of) -> DataFrame:
    """Append a run's raw rows; inside the run the first row of a key wins."""
    first = dedupe_first(batch, ["source", "source_id"], seq)
    rows = first.withColumn("scraped_at", ts(as_of)).withColumn("processed", F.lit(False))
    return rows if staged is None else staged.unionByName(rows, allowMissingColumns=True)


def merge_place_details(places: DataFrame, details: DataFrame, as_of) -> DataFrame:
    """Details by place id: some columns overwrite, others only fill gaps.

    ``details`` has columns id, external_place_id, hours, website, phone, rating,
    ratings_total, lat, lng, business_status, address, lookup_lat, lookup_lng.
    """
    prefixed = details.select(
        "id", F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"new_{c}") for c in details.columns if c != "id"],
    )
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    no_point = F.col("lat").isNull() | F.col("lng").isNull()
    found_point = F.col("new_lookup_lat").isNotNull() & F.col("new_lookup_lng").isNotNull()
    looked_up = no_point & found_point
    new = {
        "hours": F.col("new_hours"),
        "external_place_id": F.coalesce("new_external_place_id", "external_place_id"),
        "rating": F.col("new_rating"),
        "ratings_total": F.col("new_ratings_total"),
        "business_status": F.coalesce("new_business_status", F.lit("OPERATIONAL")),
        "last_synced_at": ts(as_of),
        "website": F.coalesce("website", "new_website"),
        "phone": F.coalesce("phone", "new_phone"),
        "address": F.coalesce(F.nullif(F.col("address"), F.lit("")), F.col("new_address")),
        "lat": F.when(looked_up, F.col("new_lookup_lat")).otherwise(F.coalesce("lat", "new_lat")),
        "lng": F.when(looked_up, F.col("new_lookup_lng")).otherwise(F.coalesce("lng", "new_lng")),
    }
    return places.join(prefixed, "id", "left").select(
        *[
            F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
            for c in places.columns
        ]
    )


def apply_feedback(log: DataFrame, feedback: DataFrame, seq: str) -> DataFrame:
    """Latest valid feedback per log row; a rating of 0 counts as none."""

    def given(name: str) -> Column:
        kind = dict(feedback.dtypes)[name]
        empty = "" if kind == "string" else 0
        return F.coalesce(F.col(name) != empty, F.lit(False))

    valid = feedback.filter(
        given("recommendation_id") & given("selected_id") & given("selected_type")
    )
    last = dedupe_last(valid, ["recommendation_id"], seq).select(
        F.col("recommendation_id").alias("id"),
        F.lit(True).alias("_hit"),
        F.col("selected_id").alias("new_id"),
        F.col("selected_type").alias("new_type"),
        F.nullif(F.col("rating"), F.lit(0)).alias("new_rating"),
    )
    new = {"selected_id": "new_id", "selected_type": "new_type", "feedback_rating": "new_rating"}
    return log.join(last, "id", "left").select(
        *[
            F.when(F.col("_hit"), F.col(new[c])).otherwise(F.col(c)).alias(c)
            if c in new else F.col(c)
            for c in log.columns
        ]
    )


def expire_events(events: DataFrame, as_of) -> DataFrame:
    """Events that started over a week ago become inactive."""
    old = F.col("start_time") < ts(as_of) - F.expr("INTERVAL '7' DAY")
    return events.withColumn(
        "is_active", F.when(old & F.col("is_active"), F.lit(False)).otherwise(F.col("is_active"))
    )


def override_by_key(df: DataFrame, mapping: DataFrame, key: str, column: str) -> DataFrame:
    """Replace ``column`` where ``mapping`` (key, column) names the row."""
    new = mapping.select(key, F.col(column).alias("_new"))
    return df.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
