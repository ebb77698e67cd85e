"""Vector search and embedding jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from outings.bindings import AS_OF, with_model
from outings.functions.scoring import round1
from outings.functions.times import ts
from outings.functions.vectors import activity_text, cosine_similarity, token_vector
from outings.operators.embedding import embed_due
from outings.operators.filters import embedding_backlog, is_operational
from outings.operators.similarity import ivf_topk, semantic_scores, semantic_topk
from outings.plans.inference import ACTIVITY_TEXT_SQL
from outings.plans.registry import query
from outings.session import shared_dir
from outings.sources.buckets import BucketedTable

# A fixed query vector, as a text model would return one.
QUERY_VECTOR = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_Q = "[" + ", ".join(f"{v!r}e0" for v in QUERY_VECTOR) + "]"
_SIM = f"list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), {_Q})"
_FROM = "FROM activities a JOIN embeddings e ON e.vec_id = a.vec_id"
_OK = "is_active AND (business_status IS NULL OR business_status = 'OPERATIONAL')"


def _vector_scores(t):
    """Similarity per stored vector; activities that share a vector share the number."""
    return semantic_scores(t.embeddings, QUERY_VECTOR).select("vec_id", "similarity")


@query(
    "cosine_similarity",
    "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), "
    "CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b "
    "ON b.vec_id = a.vec_id + 1",
)
def neighbours(t):
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"),
                                F.col("embedding").alias("other"))
    both = t.embeddings.join(other, "vec_id")
    value = cosine_similarity(F.col("embedding"), F.col("other"))
    return both.select("vec_id", F.round(value, 6).alias("similarity"))


@query(
    "semantic_topk",
    with_model(f"SELECT type, id, round({_SIM}, 6) AS similarity {_FROM} WHERE {_OK} "
               f"ORDER BY {_SIM} DESC, type, id LIMIT 20"),
)
def topk(t):
    acts = t.activities().filter(is_operational()).select("type", "id", "vec_id")
    found = semantic_topk(acts.join(t.embeddings, "vec_id"), QUERY_VECTOR)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    "semantic_scores",
    with_model(f"SELECT city_id, type, id, round({_SIM}, 6) AS similarity {_FROM} WHERE is_active"),
)
def scores(t):
    acts = t.activities().filter("is_active").select("city_id", "type", "id", "vec_id")
    return acts.join(_vector_scores(t), "vec_id").select(
        "city_id", "type", "id", F.round("similarity", 6).alias("similarity")
    )


@query(
    "join_semantic_scores",
    with_model(
        f"SELECT type, id, coalesce(floor({_SIM} * 30e0 * 10e0 + 0.5e0) / 10e0, 0e0) AS points "
        f"FROM activities a LEFT JOIN embeddings e ON e.vec_id = a.vec_id AND a.is_active WHERE {_OK}"
    ),
)
def points(t):
    acts = t.activities().filter(is_operational()).select("type", "id", "vec_id")
    value = F.coalesce(F.col("similarity"), F.lit(0.0)) * 30.0
    return acts.join(_vector_scores(t), "vec_id", "left").select(
        "type", "id", round1(value).alias("points")
    )


def _queries(t):
    """Every row whose id is divisible by 50 asks; all rows are searched."""
    return t.embeddings.filter(F.col("vec_id") % 50 == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vector")
    )


@query("ivf_topk")
def ivf(t):
    found = ivf_topk(t.embeddings, _queries(t), 5, ["vec_id"])
    return found.withColumn("similarity", F.round("similarity", 6))


_PLACE = "(instr('0123456789abcdef', substr(md5(w), {i}, 1)) - 1)"
_EMBED_SQL = (
    f", texts AS (SELECT type, id, {ACTIVITY_TEXT_SQL} AS body FROM activities WHERE is_active AND vec_id IS NULL "
    f"AND (type = 'place' OR start_time > TIMESTAMP '{AS_OF}')), counted AS (SELECT type, id, "
    "[len(list_filter(places, lambda p: p = i)) FOR i IN range(64)] AS counts FROM (SELECT type, id, "
    f"[({_PLACE.format(i=1)} * 16 + {_PLACE.format(i=2)}) % 64 FOR w IN string_split_regex(lower(body), '[^a-z0-9]+') IF w <> ''] "
    "AS places FROM texts) x) SELECT type, id, array_to_string([CAST(round(n / sqrt(list_sum([c * c FOR c IN counts])), 4) "
    "AS VARCHAR) FOR n IN counts], ',') AS embedding FROM counted"
)


@query("embed_backlog", with_model(_EMBED_SQL))
def embed(t):
    """The job over all rows without a vector; the committed results are read back."""
    wanted = ("title", "description", "tags", "vibe_quiet", "vibe_inside", "vibe_active")
    coming = (F.col("type") == "place") | (F.col("start_time") > ts(AS_OF))
    due = embedding_backlog(t.activities(), "vec_id").filter(coming)
    texts = due.select("type", "id", activity_text(*[F.col(c) for c in wanted]).alias("body"))
    results = BucketedTable(t.spark, shared_dir(t.spark, "vectors"), ["type", "id"], buckets=4)
    embed_due(texts, results, lambda rows: rows.withColumn("embedding", token_vector(F.col("body"))), batches=2)
    shown = F.transform("embedding", lambda x: F.round(x, 4).cast("string"))
    return results.read().select("type", "id", F.array_join(shown, ",").alias("embedding"))
