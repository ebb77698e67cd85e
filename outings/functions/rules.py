"""Fixed keyword and category tables, and the expressions that read them.

The tables are fixed values of the data model. Their order matters: tags come
out in rule order, and first-match groups are tested top to bottom.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, functions as F

# Words of two categories.
MUSIC = ("music", "concert", "band", "jazz", "rock", "dj")
COMEDY = ("comedy", "comedian", "standup", "improv")

# Keywords -> category tags.
CATEGORY_RULES = (
    (MUSIC, ("music", "live-music")),
    (COMEDY, ("comedy", "entertainment")),
    (("art", "exhibit", "gallery", "painting", "sculpture"), ("art", "culture")),
    (("theater", "theatre", "play", "performance", "drama"), ("theater", "performing-arts")),
    (("film", "movie", "cinema", "screening"), ("film", "movies")),
    (("food", "drink", "beer", "wine", "restaurant", "dining"), ("food", "drink")),
    (("kids", "family", "children"), ("family", "kids")),
    (("outdoor", "nature", "park", "hiking", "garden"), ("outdoors", "nature")),
    (("dance", "dancing", "ballet"), ("music", "social", "nightlife")),
    (("lecture", "talk", "seminar", "discussion"), ("education", "lectures")),
    (("sports", "fitness", "yoga", "gym", "exercise"), ("sports", "fitness")),
)
CATEGORY_DEFAULT = ("general",)

# Keywords -> tags shown to users.
USER_TAG_RULES = (
    (("food", "dining", "restaurant", "meal", "cuisine", "chef"), ("food-focused",)),
    (("kids", "family", "children", "youth"), ("kid-friendly",)),
    (("date", "romantic", "couples", "wine", "intimate"), ("date-night",)),
    (("art", "creative", "craft", "workshop", "painting", "sculpture"), ("creative",)),
    (("lecture", "learn", "workshop", "education", "seminar", "class"), ("educational",)),
    (("nature", "outdoor", "park", "garden", "hiking", "trail"), ("nature",)),
    (("social", "community", "gathering", "meet", "group"), ("friend-hangout",)),
    (("unusual", "unique", "quirky", "weird", "different"), ("unusual-options",)),
    (("free admission", "no cost", "donation"), ("free",)),
    (MUSIC, ("friend-hangout",)),
    (COMEDY, ("friend-hangout", "date-night")),
)

# The tags a request may ask for.
USER_TAGS = (
    "dog-friendly", "food-focused", "kid-friendly", "date-night", "solo-friendly", "creative",
    "educational", "nature", "friend-hangout", "unusual-options", "outside-my-norm", "free",
    "cheap-eats",
)

# Category words left out of the text that is embedded.
CATEGORY_STOP_TAGS = (
    "music", "live-music", "comedy", "entertainment", "art", "culture", "theater",
    "performing-arts", "film", "movies", "food", "drink", "family", "kids", "outdoors", "nature",
    "social", "nightlife", "education", "lectures", "sports", "fitness", "general",
)

# Listing category -> tags.
CALENDAR_CATEGORIES = {
    "Music": ("music", "live-music"),
    "Dancing": ("music", "social", "nightlife"),
    "Kids & Family": ("family", "kids"),
    "Comedy": ("comedy", "entertainment"),
    "Food & Drink": ("food", "drink"),
    "Art Exhibits & Events": ("art", "culture"),
    "Lectures & Seminars": ("education", "lectures"),
    "Theater & Dance": ("theater", "performing-arts"),
    "Film": ("film", "movies"),
    "Sports & Fitness": ("sports", "fitness"),
    "Outdoors": ("outdoors", "nature"),
}
ARTICLE_CATEGORIES = {
    "Events": ("events",),
    "Play": ("entertainment", "recreation"),
    "Food": ("food", "dining"),
    "Culture": ("culture", "arts"),
    "Sports": ("sports",),
    "Music": ("music", "live-music"),
    "Arts": ("arts", "culture"),
}
ARTICLE_DEFAULT_CATEGORY = "Events"

# Words in a draft's file name -> place category.
FILE_CATEGORIES = (
    ("coffee", "café"),
    ("upscale", "restaurant"),
    ("casual", "restaurant"),
    ("cocktail", "bar"),
    ("breweries", "brewery"),
    ("brunch", "restaurant"),
    ("parks", "park"),
    ("nature", "trail"),
)

# Words that make an article an event.
ARTICLE_EVENT_WORDS = ("event", "happening", "festival", "concert", "show", "market")

# Words that mark opening hours as seasonal.
SEASONAL_HOURS_WORDS = (
    "seasonal", "weather permitting", "spring", "summer", "fall", "winter", "memorial day",
    "labor day", "may through", "april through", "closed for season",
)

# Sunset per month, January to December, as HHMM.
SUNSET_HHMM = (1630, 1700, 1800, 1900, 1945, 2015, 2015, 1945, 1845, 1745, 1645, 1615)

# Tags of winter activities.
WINTER_TAGS = ("ice-skating", "skiing", "winter-sports")


def string_array(values) -> Column:
    """Literal array of strings; typed also when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def has_any(tags: Column, values) -> Column:
    """TRUE when the arrays share an element; NULLs count as no match."""
    return F.coalesce(F.arrays_overlap(tags, string_array(values)), F.lit(False))


def has_keyword(text: Column, words, word_boundary: bool = False) -> Column:
    """Any of the words in the text; a plain substring search unless bounded."""
    if word_boundary:
        return text.rlike(rf"\b(?:{'|'.join(words)})\b")
    return reduce(operator.or_, [text.contains(w) for w in words])


def match_text(title: Column, description: Column) -> Column:
    return F.lower(F.concat(title, F.lit(" "), F.coalesce(description, F.lit(""))))


def infer_tags(text: Column, rules, default=(), dedupe=False, word_boundary=False) -> Column:
    """Tags of every matching rule in rule order; ``default`` when none match.

    The rules are a literal table: a hundred tests in one expression make a method that is too long to be compiled.
    The one-element array around the text has it, and the tags found in it, worked out once a row.
    """
    table = F.array(
        *[F.struct(string_array(words).alias("words"), string_array(tags).alias("tags")) for words, tags in rules]
    )

    def found(t: Column) -> Column:
        matched = F.filter(table, lambda rule: F.exists(rule["words"], lambda word: t.contains(word)))
        return F.flatten(F.transform(matched, lambda rule: rule["tags"]))

    def bounded(t: Column) -> Column:
        given = [F.when(has_keyword(t, words, True), string_array(tags)) for words, tags in rules]
        return F.concat(*[F.coalesce(tags, string_array(())) for tags in given])

    hits = F.transform(F.array(text), bounded if word_boundary else found)
    if dedupe:
        hits = F.transform(hits, F.array_distinct)
    if default:
        hits = F.transform(hits, lambda h: F.when(F.size(h) == 0, string_array(default)).otherwise(h))
    return hits[0]


def text_categories(text: Column, **options) -> Column:
    return infer_tags(text, CATEGORY_RULES, CATEGORY_DEFAULT, **options)


def infer_categories(title: Column, description: Column, **options) -> Column:
    return text_categories(match_text(title, description), **options)


def text_user_tags(text: Column, **options) -> Column:
    return infer_tags(text, USER_TAG_RULES, **options)


def infer_user_tags(title: Column, description: Column, **options) -> Column:
    return text_user_tags(match_text(title, description), **options)


def union_tags(first: Column, second: Column) -> Column:
    """Ordered set union: first occurrence kept."""
    return F.array_distinct(F.concat(first, second))


def matching_tags(requested: Column, tags: Column) -> Column:
    """Requested tags found in ``tags``: request order, repeats counted."""
    found = F.filter(requested, lambda x: F.coalesce(F.array_contains(tags, x), F.lit(False)))
    return F.coalesce(found, string_array(()))


def user_tags_only(tags: Column) -> Column:
    stop = string_array(CATEGORY_STOP_TAGS)
    return F.filter(tags, lambda x: ~F.array_contains(stop, x))


def map_categories(categories: Column, mapping) -> Column:
    """Flattened tag lists of the categories; unknown ones become lower case."""
    table = F.create_map(
        *[part for name, tags in mapping.items() for part in (F.lit(name), string_array(tags))]
    )
    return F.flatten(
        F.transform(
            F.coalesce(categories, string_array(())),
            lambda c: F.coalesce(F.try_element_at(table, c), F.array(F.lower(c))),
        )
    )


def _first_group(tags: Column, groups, default: float = 0.5) -> Column:
    out = None
    for words, value in groups:
        cond = has_any(tags, words)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default))


# Tags that set the vibe.
LOUD = ("music", "nightlife", "social", "sports")
CALM = ("art", "lectures", "film")


def infer_vibe_2d(tags: Column) -> Column:
    return F.struct(
        _first_group(tags, ((LOUD, 0.2), (CALM, 0.7))).alias("quiet"),
        _first_group(
            tags, ((("outdoors", "nature"), 0.2), (("theater", "film", "lectures", "art"), 0.9))
        ).alias("inside"),
    )


def infer_vibe_3d(tags: Column) -> Column:
    """Quiet, inside and active; the inside groups override the quiet groups' energy."""
    outdoor = ("outdoors", "nature", "sports")
    indoor = ("theater", "film", "lectures", "art")
    relaxed = F.exists(tags, lambda t: t.rlike("yoga|meditation|spa"))
    active = (
        F.when(F.coalesce(relaxed, F.lit(False)), F.lit(0.1))
        .when(has_any(tags, outdoor), F.lit(0.6))
        .when(has_any(tags, indoor), F.lit(0.3))
        .when(has_any(tags, LOUD), F.lit(0.7))
        .when(has_any(tags, CALM), F.lit(0.3))
        .otherwise(F.lit(0.5))
    )
    return F.struct(
        _first_group(tags, ((LOUD, 0.2), (CALM, 0.7))).alias("quiet"),
        _first_group(tags, ((outdoor, 0.2), (indoor, 0.9))).alias("inside"),
        active.alias("active"),
    )


def infer_vibe_jsonld(categories: Column) -> Column:
    cats = F.transform(categories, lambda c: F.lower(c))
    return F.struct(
        _first_group(
            cats,
            (
                (("music", "dancing", "nightlife", "sports"), 0.2),
                (("art", "lectures", "film", "reading"), 0.7),
            ),
        ).alias("quiet"),
        _first_group(
            cats,
            ((("outdoors", "nature", "sports"), 0.2), (("theater", "film", "lectures"), 0.9)),
        ).alias("inside"),
    )


def infer_kid_friendly(categories: Column) -> Column:
    hit = F.exists(categories, lambda c: F.lower(c).rlike("kid|family"))
    return F.coalesce(hit, F.lit(False))


def type_from_filename(name: Column) -> Column:
    out = None
    for word, kind in FILE_CATEGORIES:
        cond = name.contains(word)
        out = F.when(cond, F.lit(kind)) if out is None else out.when(cond, F.lit(kind))
    return out.otherwise(F.lit("other"))


def backfilled_vibe_active(category: Column, vibe_quiet: Column, low_energy: Column) -> Column:
    """Place energy from ordered rules, later ones winning: listed last to first."""
    return (
        F.when(category.isin("bar", "market"), F.lit(0.7))
        .when(category.isin("café", "bookstore"), F.lit(0.3))
        .when(category.isin("walk", "nature", "garden"), F.lit(0.6))
        .when((vibe_quiet < 0.4) & ~low_energy, F.lit(0.8))
        .when(low_energy, F.lit(0.2))
        .otherwise(F.lit(0.5))
    )


def _contains_all(tags: Column, wanted) -> Column:
    return F.size(F.array_except(string_array(wanted), tags)) == 0


def event_vibe_active(tags: Column, low_energy: Column) -> Column:
    return (
        F.when(low_energy, F.lit(0.3))
        .when(_contains_all(tags, ("music", "dance", "sports", "active")), F.lit(0.8))
        .when(_contains_all(tags, ("lecture", "workshop", "meditation")), F.lit(0.4))
        .otherwise(F.lit(0.6))
    )


def tagged_seasons(
    name: Column, category: Column, story: Column, nudge: Column, tags: Column, current: Column,
    summer_fall_pattern: str,
) -> Column:
    """Season list: category rule, then name rule, then what is set, then the text rules."""
    nothing = F.lit(False)
    summer_text = (
        F.coalesce(story.ilike("%summer only%"), nothing)
        | F.coalesce(nudge.ilike("%summer only%"), nothing)
        | F.coalesce(story.ilike("%seasonal%") & story.ilike("%summer%"), nothing)
        | F.coalesce(story.ilike("%late summer%") & ~story.ilike("%year%round%"), nothing)
    )
    winter_text = (
        F.coalesce(story.ilike("%ice skating%"), nothing)
        | F.coalesce(story.ilike("%cross-country ski%"), nothing)
        | F.coalesce(story.ilike("%snow%"), nothing)
        | has_any(tags, WINTER_TAGS)
    )
    return (
        F.when(category.isin("beach", "swimming-area"), string_array(("summer",)))
        .when(name.ilike(summer_fall_pattern), string_array(("summer", "fall")))
        .when(current.isNotNull(), current)
        .when(summer_text, string_array(("summer",)))
        .when(winter_text, string_array(("winter",)))
    )
