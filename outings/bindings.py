"""Binds the model onto the star-schema test tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from outings.operators.activities import activities
from outings.schemas import PERIODS_DDL

AS_OF = "2024-01-15 00:00:00"
LOG_AS_OF = "2000-01-01 00:00:00"

PLACE_COLUMNS = [
    "p_partkey AS id",
    "CAST(p_partkey % 5 + 1 AS INT) AS city_id",
    "p_name AS name",
    "CASE p_type WHEN 'ECONOMY' THEN 'café' WHEN 'PROMO' THEN 'bar' WHEN 'SMALL' THEN 'walk' "
    "WHEN 'LARGE' THEN 'market' WHEN 'MEDIUM' THEN 'bookstore' ELSE 'beach' END AS category",
    "p_brand AS neighborhood",
    "CASE WHEN p_partkey % 13 = 0 THEN NULL "
    "ELSE CAST(p_partkey % 11 AS DOUBLE) / 10 END AS vibe_quiet",
    "CAST(p_size % 11 AS DOUBLE) / 10 AS vibe_inside",
    "CAST((p_partkey * 7) % 11 AS DOUBLE) / 10 AS vibe_active",
    "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size END AS walk_minutes_from_center",
    "p_partkey % 2 = 0 AS kid_friendly",
    "p_partkey % 3 = 0 AS low_energy",
    "CAST(p_partkey % 4 + 1 AS INT) AS price_level",
    "split(p_name, ' ') AS tags",
    "CASE p_partkey % 3 WHEN 0 THEN split('morning,afternoon', ',') "
    "WHEN 1 THEN split('evening', ',') ELSE NULL END AS best_times",
    "CASE p_partkey % 5 WHEN 0 THEN split('summer', ',') "
    "WHEN 1 THEN split('winter,spring', ',') ELSE NULL END AS seasons",
    "CASE p_partkey % 10 WHEN 0 THEN 'CLOSED_TEMPORARILY' WHEN 1 THEN NULL "
    "ELSE 'OPERATIONAL' END AS business_status",
    "p_partkey % 19 <> 0 AS is_active",
    "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % {vectors} END AS vec_id",
    "CAST(p_partkey % 7 AS INT) AS closed_day",
    "CAST(700 + 100 * (p_partkey % 5) AS INT) AS open_hhmm",
    "CASE WHEN p_partkey % 6 = 0 THEN 200 "
    "ELSE CAST(1700 + 100 * (p_partkey % 5) AS INT) END AS close_hhmm",
    "p_partkey % 6 = 0 AS closes_next_day",
    "p_partkey % 23 = 0 AS no_hours",
    "p_partkey % 29 = 0 AS always_open",
    "CASE WHEN p_partkey % 11 = 0 THEN NULL "
    "ELSE CAST(40 + p_partkey % 50 AS DOUBLE) + 0.5e0 END AS lat",
    "CAST(0 - p_partkey % 90 AS DOUBLE) - 0.25e0 AS lng",
    "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('plc', CAST(p_partkey AS STRING)) END "
    "AS external_place_id",
    "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 "
    "THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-12 00:00:00' END "
    "AS last_synced_at",
]

EVENT_COLUMNS = [
    "event_id AS id",
    "CAST(user_id % 5 + 1 AS INT) AS city_id",
    "concat(event_type, ' ', CAST(user_id AS STRING)) AS title",
    "concat('k=', props) AS description",
    "CAST(ts AS TIMESTAMP) AS start_time",
    "CAST(ts AS TIMESTAMP) + INTERVAL 2 HOUR AS end_time",
    "CAST(ts AS TIMESTAMP) - INTERVAL 1 DAY AS scraped_at",
    "CAST(event_id % 11 AS DOUBLE) / 10 AS vibe_quiet",
    "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id % 11 AS DOUBLE) / 10 END "
    "AS vibe_inside",
    "CASE event_type WHEN 'click' THEN split('music,live-music', ',') "
    "WHEN 'view' THEN split('film,movies', ',') WHEN 'purchase' THEN split('food,drink', ',') "
    "WHEN 'signup' THEN split('outdoors,nature', ',') ELSE split('general', ',') END AS tags",
    "event_id % 4 = 0 AS low_energy",
    "value AS price_min",
    "concat('src', CAST(user_id % 4 AS STRING)) AS source",
    "concat(event_type, '-', CAST(user_id AS STRING)) AS source_id",
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % {vectors} END AS vec_id",
    "event_id % 19 <> 0 AS is_active",
]

REQUEST_COLUMNS = [
    "c_custkey AS request_id",
    "CAST(c_nationkey % 5 + 1 AS INT) AS city_id",
    "CAST(60 + 30 * (c_custkey % 5) AS INT) AS time_available",
    "CAST(c_custkey % 11 AS DOUBLE) / 10 AS quiet",
    "CAST((c_custkey * 3) % 11 AS DOUBLE) / 10 AS active",
    "CAST((c_custkey * 7) % 11 AS DOUBLE) / 10 AS inside",
    "CASE c_custkey % 3 WHEN 0 THEN 'inside' WHEN 1 THEN 'outside' ELSE 'either' END AS location",
    "CASE c_custkey % 4 WHEN 0 THEN split('small,ring', ',') "
    "WHEN 1 THEN split('music,food,hot', ',') ELSE split('bolt', ',') END AS tags",
    "c_custkey % 2 = 0 AS kid_friendly",
    "c_custkey % 3 = 0 AS low_energy",
    "c_custkey % {vectors} AS vec_id",
]

CITY_COLUMNS = [
    "CAST(r_regionkey + 1 AS INT) AS id",
    "r_name AS name",
    "lower(r_name) AS slug",
    "CASE r_regionkey WHEN 1 THEN 'America/Chicago' WHEN 2 THEN 'Europe/Berlin' WHEN 3 THEN 'Asia/Kolkata' "
    "WHEN 4 THEN 'Australia/Sydney' ELSE 'UTC' END AS timezone",
]

LOG_COLUMNS = [
    "l_orderkey AS recommendation_id",
    "CAST(o_orderdate AS TIMESTAMP) AS requested_at",
    "'place' AS type",
    "l_partkey AS id",
    "l_linenumber AS rank",
]


_DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def bound_hours() -> Column:
    """The ``hours`` struct from the scalar hour columns; its fields are NULL without hours.

    Written as SQL text: one call to the engine instead of hundreds.
    """
    opens = "lpad(CAST(open_hhmm AS STRING), 4, '0')"
    closes = "lpad(CAST(close_hhmm AS STRING), 4, '0')"

    def point(day: str, hhmm: str) -> str:
        return (
            f"named_struct('day', {day}, 'time', {hhmm}, 'hour', CAST(NULL AS INT), "
            "'minute', CAST(NULL AS INT))"
        )

    def period(d: int) -> str:
        ends = f"CASE WHEN closes_next_day THEN {(d + 1) % 7} ELSE {d} END"
        both = f"named_struct('open', {point(str(d), opens)}, 'close', {point(ends, closes)})"
        return f"CASE WHEN closed_day <> {d} THEN array({both}) ELSE CAST(array() AS {PERIODS_DDL}) END"

    def text(d: int) -> str:
        return (
            f"concat('{_DAYS[d]}: ', CASE WHEN closed_day = {d} THEN 'Closed' "
            f"ELSE concat({opens}, ' - ', {closes}) END)"
        )

    periods = ", ".join(period(d) for d in range(7))
    texts = ", ".join(text(d) for d in (1, 2, 3, 4, 5, 6, 0))
    return F.expr(
        "named_struct('type', CASE WHEN NOT no_hours THEN CASE WHEN always_open THEN 'always_open' "
        "ELSE 'standard' END END, 'always_open', CASE WHEN NOT no_hours THEN always_open END, "
        "'text', CAST(NULL AS STRING), "
        f"'periods', CASE WHEN NOT no_hours THEN concat({periods}) END, "
        f"'weekday_text', CASE WHEN NOT no_hours THEN array({texts}) END)"
    )


def bound(columns: list[str], vectors: str) -> list[str]:
    """Column expressions with the number of stored vectors put in, so that rows refer to all of them."""
    return [c.replace("{vectors}", vectors) for c in columns]


class Tables:
    """Model tables, bound lazily; only the columns a query uses are read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @property
    def vectors(self) -> str:
        """Number of stored vectors, at least one, as a subquery; nothing is counted where ``vec_id`` is not read."""
        return f"(SELECT greatest(1, count(*)) FROM parquet.`{self.path}/embeddings.parquet`)"

    @cached_property
    def cities(self) -> DataFrame:
        return self.raw("region").selectExpr(*CITY_COLUMNS)

    @cached_property
    def places(self) -> DataFrame:
        places = self.raw("part").selectExpr(*bound(PLACE_COLUMNS, self.vectors))
        return places.withColumn("hours", bound_hours())

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").selectExpr(*bound(EVENT_COLUMNS, self.vectors))

    @cached_property
    def requests(self) -> DataFrame:
        return self.raw("customer").selectExpr(*bound(REQUEST_COLUMNS, self.vectors))

    @cached_property
    def rec_log(self) -> DataFrame:
        items, orders = self.raw("lineitem"), self.raw("orders")
        return items.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(
            *LOG_COLUMNS
        )

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").select("vec_id", "embedding")

    def activities(self, as_of: str = AS_OF) -> DataFrame:
        return activities(self.places, self.events, as_of)


# ---- the same bindings as SQL, for the side-by-side check ------------------------------------


def _cte(name: str, columns, source: str) -> str:
    body = ",\n  ".join(bound(columns, "(SELECT greatest(1, count(*)) FROM embeddings)"))
    return f"{name} AS (SELECT {body}\nFROM {source})"


_ACTIVITIES_SQL = f"""activities AS (
SELECT 'place' AS type, id, city_id, name AS title, category, neighborhood, vibe_quiet, vibe_inside,
  vibe_active, CAST(NULL AS VARCHAR) AS description, kid_friendly, low_energy, tags, best_times,
  seasons, walk_minutes_from_center, CAST(NULL AS TIMESTAMP) AS start_time,
  CAST(NULL AS TIMESTAMP) AS end_time, vec_id, is_active, price_level, lat, lng,
  CAST(NULL AS VARCHAR) AS source, external_place_id, business_status, closed_day, open_hhmm,
  close_hhmm, closes_next_day, no_hours, always_open
FROM places
UNION ALL
SELECT 'event', id, city_id, title, NULL, NULL, vibe_quiet, vibe_inside, 0.5e0, description, NULL,
  low_energy, tags, NULL, NULL, NULL, start_time, end_time, vec_id, is_active, NULL, NULL, NULL, source, NULL,
  'OPERATIONAL', NULL, NULL, NULL, NULL, TRUE, NULL
FROM acts_events WHERE start_time > TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR)"""

PRELUDE = "WITH " + ",\n".join(
    [
        _cte("cities", CITY_COLUMNS, "region"),
        _cte("places", PLACE_COLUMNS, "part"),
        _cte("acts_events", EVENT_COLUMNS, "events"),
        _cte("requests", REQUEST_COLUMNS, "customer"),
        _cte("rec_log", LOG_COLUMNS, "lineitem JOIN orders ON o_orderkey = l_orderkey"),
        _ACTIVITIES_SQL,
    ]
)


def with_model(body: str) -> str:
    """``body`` behind the model's CTEs; it may go on with ', more AS (...)' first."""
    return f"{PRELUDE}\n{body}"


def open_sql(t: str, alias: str = "") -> str:
    """Open-at-``t`` rule over the scalar hour columns (literal timestamp text)."""
    p = f"{alias}." if alias else ""
    now = f"(hour(TIMESTAMP '{t}') * 100 + minute(TIMESTAMP '{t}'))"
    return (
        f"({p}no_hours OR {p}always_open OR ({p}closed_day <> dayofweek(TIMESTAMP '{t}') AND "
        f"CASE WHEN {p}closes_next_day THEN {now} >= {p}open_hhmm OR {now} < {p}close_hhmm "
        f"ELSE {now} >= {p}open_hhmm AND {now} < {p}close_hhmm END))"
    )
