"""Score models and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from outings.bindings import AS_OF, open_sql, with_model
from outings.functions.scoring import BLEND, availability_bonus, jitter, low_energy_penalty
from outings.functions.scoring import round1, tag_score, time_bonus, vibe_match
from outings.functions.times import time_of_day, ts
from outings.operators.recommend import (
    hybrid_model, in_city_time, local_model, log_rows, recommend, recommend_many, request_metadata,
    result_json, score_summary, vibe_model,
)
from outings.plans.registry import query

REQUEST = {
    "city_id": 3, "quiet": 0.3, "active": 0.6, "location": "either", "tags": ["small", "ring"],
    "time_available": 120,
}
TIME_OF_DAY = "morning"

# ---- SQL of the models: every request against every candidate of its city --------------------

_R1 = "floor(({x}) * 10e0 + 0.5e0) / 10e0"


def _match(vibe: str, wish: str) -> str:
    return f"(1e0 - abs(coalesce(a.{vibe}, 0.5e0) - r.{wish}))"


_TAGS = (
    "(CASE WHEN len(r.tags) > 0 THEN coalesce(len(list_filter(r.tags, lambda x: "
    "list_contains(a.tags, x))), 0) / CAST(len(r.tags) AS DOUBLE) ELSE 0e0 END * 30e0)"
)
_WALK = "a.walk_minutes_from_center"
_FIT = (
    f"(CASE WHEN {_WALK} > 0 AND ({_WALK} * 2 + 30) / CAST(r.time_available AS DOUBLE) <= 0.8e0 "
    f"THEN (1e0 - ({_WALK} * 2 + 30) / CAST(r.time_available AS DOUBLE)) * 10e0 ELSE 0e0 END)"
)


def _bonus(weight: str) -> str:
    return (
        f"(CASE WHEN coalesce(list_contains(a.best_times, '{TIME_OF_DAY}'), FALSE) "
        f"THEN {weight} ELSE 0e0 END)"
    )


_PENALTY = "(CASE WHEN r.low_energy AND NOT coalesce(a.low_energy, FALSE) THEN -15e0 ELSE 0e0 END)"
_FITS = (
    f"(a.type <> 'place' OR {_WALK} IS NULL OR {_WALK} <= 0 "
    f"OR {_WALK} * 2 + 30 <= r.time_available)"
)
_LOCATION = (
    "(CASE r.location WHEN 'inside' THEN coalesce(a.vibe_inside >= 0.6e0, FALSE) "
    "WHEN 'outside' THEN coalesce(a.vibe_inside <= 0.4e0, FALSE) ELSE TRUE END)"
)
_CANDIDATE = "a.is_active AND (a.business_status IS NULL OR a.business_status = 'OPERATIONAL')"
_HYBRID_GATE = (
    f"{_CANDIDATE} AND {_LOCATION} AND {_FITS} AND (a.type <> 'event' OR a.start_time >= "
    f"TIMESTAMP '{AS_OF}') AND (a.type <> 'place' OR {open_sql(AS_OF, 'a')})"
)
_HYBRID_SCORE = _R1.format(
    x=f"{_match('vibe_quiet', 'quiet')} * 20e0 + {_match('vibe_active', 'active')} * 20e0 "
    f"+ {_TAGS} + {_bonus('20e0')} + {_FIT}"
)
_VIBE_GATE = (
    "a.is_active AND (a.seasons IS NULL OR list_contains(a.seasons, 'winter')) "
    f"AND (NOT r.kid_friendly OR coalesce(a.kid_friendly, FALSE)) AND {_FITS}"
)
_VIBE_SCORE = _R1.format(
    x=f"{_match('vibe_quiet', 'quiet')} * 30e0 + {_match('vibe_inside', 'inside')} * 30e0 "
    f"+ {_bonus('20e0')} + {_PENALTY} + {_FIT}"
)
_LOCAL_GATE = (
    f"a.type = 'place' AND {_WALK} * 2 + 30 <= r.time_available "
    "AND (NOT r.kid_friendly OR a.kid_friendly)"
)
_LOCAL_SCORE = (
    f"(r.time_available - ({_WALK} * 2 + 30)) * 0.1e0 + {_match('vibe_quiet', 'quiet')} * 30e0 "
    f"+ {_match('vibe_inside', 'inside')} * 30e0 + {_bonus('20e0')} + {_PENALTY}"
)


def scored_sql(gate: str, score: str, keep: str, extra: str = "", joins: str = "") -> str:
    return (
        f", scored AS (SELECT * FROM (SELECT r.request_id, a.type, a.id, {score} AS score{extra} "
        f"FROM requests r JOIN activities a ON a.city_id = r.city_id {joins} WHERE {gate}) s "
        f"WHERE {keep}), ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id "
        "ORDER BY score DESC, type, id) AS rank FROM scored) "
    )


HYBRID_SQL = scored_sql(_HYBRID_GATE, _HYBRID_SCORE, "score > 0")
VIBE_SQL = scored_sql(_VIBE_GATE, _VIBE_SCORE, "score > 0")
LOCAL_SQL = scored_sql(_LOCAL_GATE, _LOCAL_SCORE, "score >= 0")
_TOP = "SELECT request_id, type, id, score, rank FROM ranked WHERE rank <= {k}"


# ---- rankings ------------------------------------------------------------------------------


@query(
    "recommend",
    with_model(
        f", r AS (SELECT {REQUEST['city_id']} AS city_id, {REQUEST['quiet']}e0 AS quiet, "
        f"{REQUEST['active']}e0 AS active, '{REQUEST['location']}' AS location, "
        f"['small', 'ring'] AS tags, {REQUEST['time_available']} AS time_available) "
        f"SELECT type, id, score FROM (SELECT a.type, a.id, {_HYBRID_SCORE} AS score FROM r JOIN "
        f"activities a ON a.city_id = r.city_id WHERE {_HYBRID_GATE}) s WHERE score > 0 "
        "ORDER BY score DESC, type, id LIMIT 3"
    ),
)
def recommend_one(t):
    return recommend(t.activities(), REQUEST, hybrid_model(AS_OF))


@query("topn_per_request", with_model(HYBRID_SQL + _TOP.format(k=3)))
def topn_per_request(t):
    return recommend_many(t.requests, t.activities(), hybrid_model(AS_OF))


# Requests for a date: events must start after it.
_DATED = f"TIMESTAMP '{AS_OF}' + (r.request_id % 240) * INTERVAL 1 HOUR"


@query(
    "topn_by_date",
    with_model(
        scored_sql(_HYBRID_GATE.replace(f"a.start_time >= TIMESTAMP '{AS_OF}'", f"a.start_time >= {_DATED}"), _HYBRID_SCORE, "score > 0")
        + _TOP.format(k=3)
    ),
)
def topn_by_date(t):
    at = F.expr(f"TIMESTAMP '{AS_OF}' + make_interval(0, 0, 0, 0, CAST(request_id % 240 AS INT))")
    asked = t.requests.withColumn("requested_date", at)
    return recommend_many(asked, t.activities(), hybrid_model(AS_OF, dated=True))


# Requests of four days around the change to daylight saving time in the second city.
_ASKED = "TIMESTAMP '2024-03-08 00:00:00' + (request_id % 97) * INTERVAL 1 HOUR"
_CITY_TIME = f""", asked AS (SELECT *, asked_at + minutes * INTERVAL 1 MINUTE AS there FROM (
  SELECT *, {_ASKED} AS asked_at, CASE city_id WHEN 1 THEN 0 WHEN 3 THEN 60 WHEN 4 THEN 330 WHEN 5 THEN 660
    ELSE CASE WHEN {_ASKED} < TIMESTAMP '2024-03-10 08:00:00' THEN -360 ELSE -300 END END AS minutes FROM requests))"""
_NOW = "(hour(r.there) * 100 + minute(r.there))"
_OPEN_THERE = (
    "(a.no_hours OR a.always_open OR (a.closed_day <> dayofweek(r.there) AND CASE WHEN a.closes_next_day THEN "
    f"{_NOW} >= a.open_hhmm OR {_NOW} < a.close_hhmm ELSE {_NOW} >= a.open_hhmm AND {_NOW} < a.close_hhmm END))"
)
_PART = "CASE WHEN hour(r.there) < 12 THEN 'morning' WHEN hour(r.there) < 17 THEN 'afternoon' ELSE 'evening' END"


@query(
    "topn_city_time",
    with_model(
        _CITY_TIME
        + scored_sql(
            _HYBRID_GATE.replace(open_sql(AS_OF, "a"), _OPEN_THERE), _HYBRID_SCORE.replace(f"'{TIME_OF_DAY}'", _PART), "score > 0"
        ).replace("FROM requests r", "FROM asked r")
        + _TOP.format(k=3)
    ),
)
def topn_city_time(t):
    """Hours and time of day by the clock of the city at the time of each request."""
    at = F.expr("TIMESTAMP '2024-03-08 00:00:00' + make_interval(0, 0, 0, 0, CAST(request_id % 97 AS INT))")
    asked = in_city_time(t.requests.withColumn("requested_at", at), t.cities)
    return recommend_many(asked, t.activities(), hybrid_model(AS_OF, local=True))


@query("rank_results", with_model(VIBE_SQL + _TOP.format(k=10)))
def rank_results(t):
    return recommend_many(t.requests, t.activities(), vibe_model(AS_OF), limit=10)


@query("score_vibe", with_model(VIBE_SQL + _TOP.format(k=3)))
def score_vibe(t):
    return recommend_many(t.requests, t.activities(), vibe_model(AS_OF))


_LOCAL_TOP = (
    "SELECT request_id, type, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 3"
)


@query("score_local", with_model(LOCAL_SQL + _LOCAL_TOP))
def score_local(t):
    best = recommend_many(t.requests, t.activities(), local_model(AS_OF))
    return best.withColumn("score", F.round("score", 6))


def _summary_sql(ctes: str) -> str:
    return ctes + (
        "SELECT q.request_id, count(s.score) AS qualified, max(s.score) AS best_score, "
        "min(s.score) AS worst_score FROM requests q LEFT JOIN scored s "
        "ON s.request_id = q.request_id GROUP BY q.request_id"
    )


@query("score_matrix", with_model(_summary_sql(HYBRID_SQL)))
def score_matrix(t):
    return score_summary(t.requests, t.activities(), hybrid_model(AS_OF))


@query("score_positive", with_model(_summary_sql(VIBE_SQL)))
def score_positive(t):
    return score_summary(t.requests, t.activities(), vibe_model(AS_OF))


@query(
    "request_metadata",
    with_model(
        HYBRID_SQL
        + f", total AS (SELECT r.request_id, count(a.id) AS n FROM requests r LEFT JOIN activities "
        f"a ON a.city_id = r.city_id AND {_CANDIDATE} AND {_LOCATION} GROUP BY r.request_id) "
        "SELECT t.request_id, 'morning' AS time_of_day, 'monday' AS day_of_week, "
        "t.n AS total_candidates, count(s.score) AS filtered_count, "
        "least(count(s.score), 3) AS returned_count FROM total t LEFT JOIN scored s "
        "ON s.request_id = t.request_id GROUP BY t.request_id, t.n"
    ),
)
def metadata(t):
    return request_metadata(t.requests, t.activities(), hybrid_model(AS_OF))


# ---- with vectors --------------------------------------------------------------------------

_SIM = "coalesce(list_cosine_similarity(CAST(qe.embedding AS DOUBLE[]), CAST(ae.embedding AS DOUBLE[])), 0e0)"
_VEC_JOINS = (
    "LEFT JOIN embeddings qe ON qe.vec_id = r.vec_id LEFT JOIN embeddings ae ON ae.vec_id = a.vec_id"
)


def _with_vectors(t):
    vectors = t.embeddings
    return (
        t.requests.join(vectors, "vec_id", "left"),
        t.activities().join(vectors, "vec_id", "left"),
    )


_FULL_SCORE = _R1.format(
    x=f"{_match('vibe_quiet', 'quiet')} * 20e0 + {_match('vibe_active', 'active')} * 20e0 "
    f"+ {_TAGS} + {_SIM} * 30e0 + {_bonus('20e0')} + {_FIT}"
)
_PARTS = {
    "quiet_score": f"{_match('vibe_quiet', 'quiet')} * 20e0",
    "active_score": f"{_match('vibe_active', 'active')} * 20e0",
    "tag_score": _TAGS,
    "semantic_score": f"{_SIM} * 30e0",
    "time_bonus": _bonus("20e0"),
    "availability_score": _FIT,
}


@query(
    "score_hybrid",
    with_model(
        scored_sql(
            _HYBRID_GATE, _FULL_SCORE, "score > 0",
            "".join(f", {_R1.format(x=x)} AS {n}" for n, x in _PARTS.items()), _VEC_JOINS,
        )
        + f"SELECT request_id, type, id, score, rank, {', '.join(_PARTS)} FROM ranked "
        "WHERE rank <= 3"
    ),
)
def score_hybrid(t):
    requests, acts = _with_vectors(t)
    return recommend_many(requests, acts, hybrid_model(AS_OF, with_vectors=True), explain=True)


_BLEND_SCORE = _R1.format(
    x=f"{_match('vibe_quiet', 'quiet')} * 15e0 + {_match('vibe_inside', 'inside')} * 15e0 "
    f"+ {_SIM} * 9e0 + {_bonus('2e0')}"
)


@query(
    "score_blend",
    with_model(scored_sql(_HYBRID_GATE, _BLEND_SCORE, "score > 0", "", _VEC_JOINS)
               + _TOP.format(k=3)),
)
def score_blend(t):
    requests, acts = _with_vectors(t)
    return recommend_many(requests, acts, hybrid_model(AS_OF, weights=BLEND, with_vectors=True))


# ---- single parts ----------------------------------------------------------------------------


def _part(name: str, sql: str, column, source: str = "activities"):
    @query(name, with_model(f"SELECT type, id, {sql} AS {name} FROM {source} a"))
    def build(t):
        return t.activities().select("type", "id", column().alias(name))

    return build


_part("vibe_match", "1e0 - abs(coalesce(vibe_quiet, 0.5e0) - 0.35e0)",
      lambda: vibe_match(F.col("vibe_quiet"), F.lit(0.35)))
_part(
    "tag_score",
    "coalesce(len(list_filter(['small', 'ring', 'music'], lambda x: list_contains(a.tags, x))), 0) "
    "/ 3e0 * 30e0",
    lambda: tag_score(F.array(F.lit("small"), F.lit("ring"), F.lit("music")), F.col("tags")),
)
_part("time_bonus", _bonus("20e0"),
      lambda: time_bonus(F.col("best_times"), time_of_day(ts(AS_OF))))
_part("availability_bonus", _FIT.replace("r.time_available", "100"),
      lambda: availability_bonus(F.col("walk_minutes_from_center"), F.lit(100)))
_part("low_energy_penalty", _PENALTY.replace("r.low_energy", "TRUE"),
      lambda: low_energy_penalty(F.lit(True), F.col("low_energy")))
# A product takes the place of the hash, which the other engine lacks.
_part(
    "jitter", "xor(12345, id * 7919 + length(type)) % 10000 / 10000e0 * 5e0",
    lambda: jitter(F.lit(12345).cast("long"), F.col("id") * 7919 + F.length("type"), 5.0),
)


@query("round1", "SELECT event_id AS id, floor((value - 50e0) * 10e0 + 0.5e0) / 10e0 AS rounded "
                 "FROM events")
def rounded(t):
    return t.events.select("id", round1(F.col("price_min") - 50.0).alias("rounded"))


# ---- log -----------------------------------------------------------------------------------


@query(
    "log_recommendations",
    with_model(
        HYBRID_SQL
        + "SELECT r.request_id AS id, r.city_id, r.time_available, r.quiet AS quiet_social, "
        "r.active AS inside_outside, list_contains(r.tags, 'kid-friendly') AS kid_friendly, "
        "(list_contains(r.tags, 'relaxing') OR r.active < 0.3e0) AS low_energy, "
        f"TIMESTAMP '{AS_OF}' AS requested_at, 'morning' AS time_of_day, 'monday' AS day_of_week, "
        "coalesce(x.listed, '') AS listed FROM requests r LEFT JOIN (SELECT request_id, "
        "string_agg(concat(rank, ':', type, ':', id), ',' ORDER BY rank) AS listed FROM ranked "
        "WHERE rank <= 3 GROUP BY request_id) x ON x.request_id = r.request_id"
    ),
)
def log_recommendations(t):
    """Rows go through an appended log table and are read back from it."""
    from outings.session import shared_dir
    from outings.sources.sinks import append_log, read_log

    best = recommend_many(t.requests, t.activities(), hybrid_model(AS_OF))
    path = shared_dir(t.spark, "log")
    append_log(log_rows(t.requests, best, AS_OF), path)
    items = F.try_variant_get(
        F.parse_json("results"), "$.results",
        "array<struct<type: string, id: bigint, score: double, rank: int>>",
    )
    listed = F.array_join(
        F.transform(items, lambda r: F.concat_ws(":", r["rank"], r["type"], r["id"])), ","
    )
    return read_log(t.spark, path).select(
        "id", "city_id", "time_available", "quiet_social", "inside_outside", "kid_friendly",
        "low_energy", "requested_at", "time_of_day", "day_of_week", listed.alias("listed"),
    )


@query(
    "log_low_energy",
    with_model(
        "SELECT request_id AS id, list_contains(tags, 'kid-friendly') AS kid_friendly, "
        "(list_contains(tags, 'relaxing') OR active < 0.3e0) AS low_energy FROM requests"
    ),
)
def log_low_energy(t):
    none = t.spark.createDataFrame(
        [], "request_id bigint, rank int, type string, id bigint, score double"
    )
    return log_rows(t.requests, none, AS_OF).select("id", "kid_friendly", "low_energy")


@query(
    "result_json",
    with_model(
        VIBE_SQL
        + ", listed AS (SELECT request_id, string_agg(concat('{\"type\":\"', type, '\",\"id\":', "
        "id, ',\"score\":', score, ',\"rank\":', rank, '}'), ',' ORDER BY rank) AS body "
        "FROM ranked WHERE rank <= 3 GROUP BY request_id) SELECT r.request_id, "
        "concat('{\"results\":[', coalesce(body, ''), ']') AS head FROM requests r LEFT JOIN "
        "listed l ON l.request_id = r.request_id"
    ),
)
def result_documents(t):
    best = recommend_many(t.requests, t.activities(), vibe_model(AS_OF))
    docs = result_json(t.requests, best, AS_OF)
    return docs.select(
        "request_id", F.substring_index("results", ',"preferences"', 1).alias("head")
    )


