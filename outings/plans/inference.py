"""Tag, vibe and season rules, category mappings and texts to embed."""

from __future__ import annotations

from pyspark.sql import functions as F

from outings.bindings import AS_OF, with_model
from outings.functions import rules as R
from outings.functions.vectors import (
    activity_text, event_text, has_embedding, place_text, preference_text,
)
from outings.operators.upsert import override_by_key
from outings.plans.registry import query

# ---- tags from whole texts ---------------------------------------------------------------------

_WORDS = (
    "CASE doc_id % 12 WHEN 0 THEN 'Jazz Concert' WHEN 1 THEN 'Improv night' WHEN 2 THEN "
    "'Gallery exhibit' WHEN 3 THEN 'Ballet' WHEN 4 THEN 'Wine tasting' WHEN 5 THEN 'Kids workshop' "
    "WHEN 6 THEN 'Hiking trail' WHEN 7 THEN 'Quirky cinema' WHEN 8 THEN 'No cost yoga' "
    "ELSE source END"
)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _tags_sql(rules, default=()) -> str:
    parts = [
        f"CASE WHEN regexp_matches(body, '{'|'.join(words)}') THEN {_list(tags)} ELSE [] END"
        for words, tags in rules
    ]
    hits = parts[0]
    for p in parts[1:]:
        hits = f"list_concat({hits}, {p})"
    joined = f"coalesce(array_to_string({hits}, ','), '')"
    if default:
        return f"CASE WHEN {joined} = '' THEN '{','.join(default)}' ELSE {joined} END"
    return joined


_BODY = f"(SELECT doc_id AS id, lower(concat({_WORDS}, ' ', text)) AS body FROM documents)"


@query(
    "infer_categories",
    f"SELECT id, {_tags_sql(R.CATEGORY_RULES, R.CATEGORY_DEFAULT)} AS tags FROM {_BODY}",
)
def categories(t):
    tags = R.infer_categories(F.expr(_WORDS), F.col("text"))
    return t.raw("documents").select(
        F.col("doc_id").alias("id"), F.array_join(tags, ",").alias("tags")
    )


@query("infer_user_tags", f"SELECT id, {_tags_sql(R.USER_TAG_RULES)} AS tags FROM {_BODY}")
def user_tags(t):
    tags = R.infer_user_tags(F.expr(_WORDS), F.col("text"))
    return t.raw("documents").select(
        F.col("doc_id").alias("id"), F.array_join(tags, ",").alias("tags")
    )


# ---- lists -------------------------------------------------------------------------------------

_SECOND = "CASE WHEN id % 2 = 0 THEN split('kid-friendly,music,food', ',') ELSE split('nature', ',') END"


def _over_events(name: str, sql: str, column):
    @query(name, with_model(f"SELECT id, coalesce(array_to_string({sql}, ','), '') AS tags "
                            "FROM acts_events"))
    def build(t):
        return t.events.select("id", F.array_join(column(), ",").alias("tags"))


_over_events(
    "union_tags",
    f"list_concat(tags, list_filter({_SECOND}, lambda x: NOT list_contains(tags, x)))",
    lambda: R.union_tags(F.col("tags"), F.expr(_SECOND)),
)
_over_events(
    "matching_tags",
    f"list_filter({_SECOND}, lambda x: list_contains(tags, x))",
    lambda: R.matching_tags(F.expr(_SECOND), F.col("tags")),
)
_over_events(
    "user_tags_only",
    f"list_filter(list_concat(tags, {_SECOND}), lambda x: NOT list_contains("
    f"{_list(R.CATEGORY_STOP_TAGS)}, x))",
    lambda: R.user_tags_only(F.concat(F.col("tags"), F.expr(_SECOND))),
)

_LISTED = (
    "CASE id % 4 WHEN 0 THEN split('Music;Kids & Family', ';') WHEN 1 THEN "
    "split('Theater & Dance;Open House;Music', ';') WHEN 2 THEN split('Sports & Fitness', ';') "
    "ELSE NULL END"
)
_MAPPED = (
    "CASE id % 4 WHEN 0 THEN 'music,live-music,family,kids' WHEN 1 THEN "
    "'theater,performing-arts,open house,music,live-music' WHEN 2 THEN 'sports,fitness' ELSE '' END"
)


@query("map_categories", with_model(f"SELECT id, {_MAPPED} AS tags FROM acts_events"))
def mapped(t):
    tags = R.map_categories(F.expr(_LISTED), R.CALENDAR_CATEGORIES)
    return t.events.select("id", F.array_join(tags, ",").alias("tags"))


@query(
    "infer_kid_friendly",
    with_model("SELECT id, id % 4 = 0 AS kid_friendly FROM acts_events"),
)
def kid_friendly(t):
    return t.events.select(
        "id", R.infer_kid_friendly(F.expr(_LISTED)).alias("kid_friendly")
    )


# ---- vibes -------------------------------------------------------------------------------------

_TAGGED = (
    "CASE id % 6 WHEN 0 THEN split('sports,fitness', ',') WHEN 1 THEN split('art,culture', ',') "
    "WHEN 2 THEN split('theater,spa', ',') ELSE tags END"
)


def _any(words) -> str:
    return f"list_has_any(v, {_list(words)})"


_OUT3, _IN3 = ("outdoors", "nature", "sports"), ("theater", "film", "lectures", "art")
_VIBE_FROM = f"FROM (SELECT id, {_TAGGED} AS v FROM acts_events)"
_QUIET = f"CASE WHEN {_any(R.LOUD)} THEN 0.2e0 WHEN {_any(R.CALM)} THEN 0.7e0 ELSE 0.5e0 END"


@query(
    "infer_vibe_2d",
    with_model(
        f"SELECT id, {_QUIET} AS quiet, CASE WHEN {_any(('outdoors', 'nature'))} THEN 0.2e0 "
        f"WHEN {_any(_IN3)} THEN 0.9e0 ELSE 0.5e0 END AS inside {_VIBE_FROM}"
    ),
)
def vibe_2d(t):
    out = t.events.select("id", R.infer_vibe_2d(F.expr(_TAGGED)).alias("v"))
    return out.select("id", "v.quiet", "v.inside")


@query(
    "infer_vibe_3d",
    with_model(
        f"SELECT id, {_QUIET} AS quiet, CASE WHEN {_any(_OUT3)} THEN 0.2e0 WHEN {_any(_IN3)} "
        "THEN 0.9e0 ELSE 0.5e0 END AS inside, CASE WHEN array_to_string(v, ',') LIKE '%spa%' THEN "
        f"0.1e0 WHEN {_any(_OUT3)} THEN 0.6e0 WHEN {_any(_IN3)} THEN 0.3e0 WHEN {_any(R.LOUD)} THEN "
        f"0.7e0 WHEN {_any(R.CALM)} THEN 0.3e0 ELSE 0.5e0 END AS active {_VIBE_FROM}"
    ),
)
def vibe_3d(t):
    out = t.events.select("id", R.infer_vibe_3d(F.expr(_TAGGED)).alias("v"))
    return out.select("id", "v.quiet", "v.inside", "v.active")


@query(
    "infer_vibe_jsonld",
    with_model(
        f"SELECT id, CASE WHEN {_any(('music', 'dancing', 'nightlife', 'sports'))} THEN 0.2e0 WHEN "
        f"{_any(('art', 'lectures', 'film', 'reading'))} THEN 0.7e0 ELSE 0.5e0 END AS quiet, "
        f"CASE WHEN {_any(_OUT3)} THEN 0.2e0 WHEN {_any(('theater', 'film', 'lectures'))} THEN "
        f"0.9e0 ELSE 0.5e0 END AS inside {_VIBE_FROM}"
    ),
)
def vibe_jsonld(t):
    tags = F.transform(F.expr(_TAGGED), lambda x: F.upper(x))
    out = t.events.select("id", R.infer_vibe_jsonld(tags).alias("v"))
    return out.select("id", "v.quiet", "v.inside")


@query(
    "backfill_vibe_active",
    with_model(
        "SELECT id, CASE WHEN category IN ('bar', 'market') THEN 0.7e0 WHEN category IN ('café', "
        "'bookstore') THEN 0.3e0 WHEN category IN ('walk', 'nature', 'garden') THEN 0.6e0 "
        "WHEN vibe_quiet < 0.4e0 AND NOT low_energy THEN 0.8e0 WHEN low_energy THEN 0.2e0 "
        "ELSE 0.5e0 END AS vibe_active FROM places"
    ),
)
def backfilled(t):
    value = R.backfilled_vibe_active(
        F.col("category"), F.col("vibe_quiet"), F.col("low_energy")
    )
    return t.places.select("id", value.alias("vibe_active"))


_EVENT_TAGS = (
    "CASE id % 5 WHEN 0 THEN split('music,dance,sports,active,late', ',') WHEN 1 THEN "
    "split('lecture,workshop,meditation', ',') WHEN 2 THEN split('music,dance', ',') ELSE tags END"
)


@query(
    "event_vibe_active",
    with_model(
        "SELECT id, CASE WHEN low_energy THEN 0.3e0 WHEN id % 5 = 0 THEN 0.8e0 WHEN id % 5 = 1 "
        "THEN 0.4e0 ELSE 0.6e0 END AS vibe_active FROM acts_events"
    ),
)
def event_energy(t):
    value = R.event_vibe_active(F.expr(_EVENT_TAGS), F.col("low_energy"))
    return t.events.select("id", value.alias("vibe_active"))


# ---- seasons and overrides ---------------------------------------------------------------------

_STORY = (
    "CASE id % 9 WHEN 0 THEN 'Open SUMMER only' WHEN 1 THEN 'Seasonal menu, best in summer' "
    "WHEN 2 THEN 'From late summer on' WHEN 3 THEN 'Late summer or all year around' "
    "WHEN 4 THEN 'Ice Skating on the pond' WHEN 5 THEN 'When the snow falls' ELSE NULL END"
)
_SKI_TAGS = "CASE WHEN id % 9 = 6 THEN split('skiing', ',') ELSE tags END"


@query(
    "tag_seasons",
    with_model(
        "SELECT id, CASE WHEN category = 'beach' THEN 'summer' WHEN name ILIKE '%widget%' THEN "
        "'summer,fall' WHEN seasons IS NOT NULL THEN array_to_string(seasons, ',') "
        "WHEN id % 9 IN (0, 1, 2) THEN 'summer' WHEN id % 9 IN (4, 5, 6) THEN 'winter' END "
        "AS seasons FROM places"
    ),
)
def seasons(t):
    value = R.tagged_seasons(
        F.col("name"), F.col("category"), F.expr(_STORY), F.lit(None).cast("string"),
        F.expr(_SKI_TAGS), F.col("seasons"), "%widget%",
    )
    return t.places.select("id", F.array_join(value, ",").alias("seasons"))


# The explicit lists are a column of another table here; any mapping may be given.
@query(
    "override_seasons",
    with_model(
        "SELECT id, array_to_string(CASE WHEN s_suppkey IS NOT NULL AND s_nationkey < 12 THEN "
        "['winter'] WHEN s_suppkey IS NOT NULL THEN ['spring', 'summer', 'fall'] ELSE seasons END, "
        "',') AS seasons FROM places LEFT JOIN supplier ON s_suppkey = id"
    ),
)
def season_overrides(t):
    mapping = t.raw("supplier").select(
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_nationkey") < 12, R.string_array(("winter",)))
        .otherwise(R.string_array(("spring", "summer", "fall")))
        .alias("seasons"),
    )
    out = override_by_key(t.places.select("id", "seasons"), mapping, "id", "seasons")
    return out.withColumn("seasons", F.array_join("seasons", ","))


@query(
    "override_tags",
    with_model(
        "SELECT p.id, coalesce(m.tags, array_to_string(p.tags, ',')) AS tags FROM "
        "(SELECT *, concat('plc-', CAST(id AS VARCHAR)) AS slug FROM places) p LEFT JOIN "
        "(SELECT concat('plc-', CAST(s_suppkey AS VARCHAR)) AS slug, 'nature,free' AS tags "
        "FROM supplier) m ON m.slug = p.slug"
    ),
)
def tag_overrides(t):
    places = t.places.select(
        "id", F.concat(F.lit("plc-"), F.col("id").cast("string")).alias("slug"), "tags"
    )
    mapping = t.raw("supplier").select(
        F.concat(F.lit("plc-"), F.col("s_suppkey").cast("string")).alias("slug"),
        R.string_array(("nature", "free")).alias("tags"),
    )
    out = override_by_key(places, mapping, "slug", "tags")
    return out.select("id", F.array_join("tags", ",").alias("tags"))


@query(
    "type_from_filename",
    "SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN 'café' WHEN 'PROMO' THEN 'bar' "
    "WHEN 'SMALL' THEN 'trail' WHEN 'LARGE' THEN 'restaurant' ELSE 'other' END AS category "
    "FROM part",
)
def file_category(t):
    name = F.expr(
        "concat('batch-', CAST(p_size AS STRING), CASE p_type WHEN 'ECONOMY' THEN '-coffee-shops' "
        "WHEN 'PROMO' THEN '-cocktail-bars' WHEN 'SMALL' THEN '-nature-trails' WHEN 'LARGE' THEN "
        "'-restaurants-upscale' ELSE '-misc' END, '.md')"
    )
    return t.raw("part").select(
        F.col("p_partkey").alias("id"), R.type_from_filename(name).alias("category")
    )


# ---- texts to embed ----------------------------------------------------------------------------

_KEPT = f"list_filter(tags, lambda x: NOT list_contains({_list(R.CATEGORY_STOP_TAGS)}, x))"
_TAG_PART = (
    f"CASE WHEN len({_KEPT}) > 0 THEN concat('Tags: ', array_to_string({_KEPT}, ', ')) END"
)


ACTIVITY_TEXT_SQL = (
    f"concat_ws('. ', title, description, {_TAG_PART}, concat_ws(', ', "
    "CASE WHEN coalesce(vibe_quiet, 0e0) < 0.4e0 THEN 'lively atmosphere' ELSE "
    "'quiet atmosphere' END, CASE WHEN coalesce(vibe_inside, 0e0) > 0.6e0 THEN 'indoor space' "
    "ELSE 'outdoor space' END, CASE WHEN coalesce(vibe_active, 0e0) < 0.4e0 THEN "
    "'relaxing activity' ELSE 'active experience' END))"
)


@query(
    "activity_text",
    with_model(
        f"SELECT type, id, {ACTIVITY_TEXT_SQL} AS body FROM activities"
    ),
)
def activity_texts(t):
    body = activity_text(
        *[F.col(c) for c in ("title", "description", "tags", "vibe_quiet", "vibe_inside",
                             "vibe_active")]
    )
    return t.activities().select("type", "id", body.alias("body"))


@query(
    "preference_text",
    with_model(
        "SELECT request_id, concat_ws('. ', CASE WHEN quiet < 0.3e0 THEN "
        "'quiet, peaceful atmosphere' WHEN quiet > 0.7e0 THEN 'lively, social atmosphere' ELSE "
        "'moderate atmosphere' END, CASE WHEN active < 0.3e0 THEN 'active, energetic experience' "
        "WHEN active > 0.7e0 THEN 'relaxing, low-energy activity' ELSE 'moderate energy activity' "
        "END, CASE location WHEN 'inside' THEN 'indoor location' WHEN 'outside' THEN "
        "'outdoor location' END, CASE WHEN len(tags) > 0 THEN concat('Looking for: ', "
        "array_to_string(tags, ', ')) END) AS body FROM requests"
    ),
)
def preference_texts(t):
    body = preference_text(*[F.col(c) for c in ("quiet", "active", "location", "tags")])
    return t.requests.select("request_id", body.alias("body"))


@query(
    "place_text",
    "SELECT doc_id AS id, concat_ws(chr(10) || chr(10), nullif(source, ''), "
    "nullif(text, ''), 'small, ring') AS body FROM documents",
)
def place_texts(t):
    body = place_text(
        F.col("source"), F.col("text"), F.lit(None).cast("string"),
        R.string_array(("small", "ring")),
    )
    return t.raw("documents").select(F.col("doc_id").alias("id"), body.alias("body"))


@query(
    "event_text",
    with_model(
        "SELECT id, concat_ws(chr(10) || chr(10), title, description, "
        "array_to_string(tags, ', ')) AS body FROM acts_events"
    ),
)
def event_texts(t):
    body = event_text(
        F.col("title"), F.col("description"), R.string_array(()), F.col("tags")
    )
    return t.events.select("id", body.alias("body"))


@query(
    "has_embedding",
    with_model(
        "SELECT type, id, CASE WHEN e.vec_id IS NOT NULL AND len(e.embedding) = 64 THEN 'Yes' ELSE "
        "'No' END AS has_embedding FROM activities a LEFT JOIN embeddings e ON e.vec_id = a.vec_id"
    ),
)
def embedding_flags(t):
    joined = t.activities(AS_OF).join(t.embeddings, "vec_id", "left")
    return joined.select(
        "type", "id", has_embedding(F.col("embedding"), 64).alias("has_embedding")
    )
