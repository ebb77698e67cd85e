"""Vector expressions and a stand-in text embedder."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from outings.functions.rules import string_array, user_tags_only


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def cosine_similarity(
    a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None
) -> Column:
    """Cosine similarity; pass stored norms to save recomputing them."""
    scale = (norm(a) if a_norm is None else a_norm) * (norm(b) if b_norm is None else b_norm)
    return F.when(scale > 0, dot(a, b) / scale)


def vector_literal(values) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def has_embedding(embedding: Column, dim: int) -> Column:
    return F.when(embedding.isNotNull() & (F.size(embedding) == dim), "Yes").otherwise("No")


# ---- texts to embed ------------------------------------------------------------------------


def _non_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def activity_text(
    title: Column, description: Column, tags: Column,
    vibe_quiet: Column | None = None, vibe_inside: Column | None = None,
    vibe_active: Column | None = None,
) -> Column:
    """Title, description, user tags and vibe phrases.

    A vibe given as a column but NULL in a row counts as 0; one not given at
    all adds no phrase.
    """
    kept = user_tags_only(tags)
    phrases = []
    if vibe_quiet is not None:
        low = F.coalesce(vibe_quiet, F.lit(0.0)) < 0.4
        phrases.append(F.when(low, "lively atmosphere").otherwise("quiet atmosphere"))
    if vibe_inside is not None:
        high = F.coalesce(vibe_inside, F.lit(0.0)) > 0.6
        phrases.append(F.when(high, "indoor space").otherwise("outdoor space"))
    if vibe_active is not None:
        low = F.coalesce(vibe_active, F.lit(0.0)) < 0.4
        phrases.append(F.when(low, "relaxing activity").otherwise("active experience"))
    parts = [
        _non_blank(title),
        _non_blank(description),
        F.when(F.size(kept) > 0, F.concat(F.lit("Tags: "), F.array_join(kept, ", "))),
    ]
    if phrases:
        parts.append(F.concat_ws(", ", *phrases))
    return F.concat_ws(". ", *parts)


def _band(slider: Column, low: str, high: str, middle: str) -> Column:
    return (
        F.when(slider.isNull(), None)
        .when(slider < 0.3, low)
        .when(slider > 0.7, high)
        .otherwise(middle)
    )


def preference_text(
    quiet: Column, active: Column, location: Column, tags: Column, invert_energy: bool = False
) -> Column:
    energy = 1 - active if invert_energy else active
    return F.concat_ws(
        ". ",
        _band(quiet, "quiet, peaceful atmosphere", "lively, social atmosphere",
              "moderate atmosphere"),
        _band(energy, "active, energetic experience", "relaxing, low-energy activity",
              "moderate energy activity"),
        F.when(location == "inside", "indoor location").when(
            location == "outside", "outdoor location"
        ),
        F.when(F.size(tags) > 0, F.concat(F.lit("Looking for: "), F.array_join(tags, ", "))),
    )


def _joined(*parts: Column, limit: int | None) -> Column:
    """Non-empty parts with blank lines between, cut at ``limit`` characters if the model has such a bound."""
    whole = F.concat_ws("\n\n", *[_non_blank(p) for p in parts])
    return whole if limit is None else F.substring(whole, 1, limit)


def place_text(
    name: Column, story: Column, nudge: Column, tags: Column, limit: int | None = None
) -> Column:
    return _joined(name, story, nudge, F.array_join(tags, ", "), limit=limit)


def event_text(
    title: Column, description: Column, categories: Column, tags: Column, limit: int | None = None
) -> Column:
    return _joined(
        title, description, F.array_join(categories, ", "), F.array_join(tags, ", "), limit=limit
    )


# ---- embedding -----------------------------------------------------------------------------


def hashed_embedding(df: DataFrame, text_col: str, out_col: str, dim: int = 64) -> DataFrame:
    """Deterministic hashed bag of words, unit length. A stand-in for a text model."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    blank = F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) == 0
    words = df.withColumn(
        "_words", F.filter(F.split(F.lower(F.col(text_col)), r"\W+"), lambda w: w != "")
    ).withColumn("_words", F.coalesce("_words", string_array(())))
    counts = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_counts").transform(words)
    unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counts)
    vector = vector_to_array("_unit", "float32")
    return unit.withColumn(out_col, F.when(~blank, vector)).drop("_words", "_counts", "_unit")


def token_vector(text: Column, dim: int = 64) -> Column:
    """Deterministic bag of words as a unit vector: a word counts in the dimension of its MD5's first two digits.

    NULL without a word. It stands in for a text model and can be written in any SQL.
    """
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int") % dim)

    def once(value: Column, then: Callable[[Column], Column]) -> Column:
        """``then(value)`` with the value worked out one time, however often it is used."""
        return F.transform(F.array(value), then)[0]

    def counted(places: Column) -> Column:
        each = F.sequence(F.lit(0), F.lit(dim - 1))
        return F.transform(each, lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))

    def unit(counts: Column) -> Column:
        length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda total, n: total + n * n))
        return once(length, lambda l: F.when(l > 0, F.transform(counts, lambda n: n / l)))  # noqa: E741

    return once(once(places, counted), unit)


Embedder = Callable[[pd.Series], list]


def model_embedding(
    df: DataFrame, text_col: str, out_col: str, make_embedder: Callable[[], Embedder], pause: float = 0.0
) -> DataFrame:
    """Embed with a model that lives in Python.

    ``make_embedder`` is called once per task and returns a function from a
    series of texts to a list of vectors (None where the model failed). A task waits ``pause`` seconds
    between two calls; a limit of r calls a second over n tasks at a time asks for n / r.
    """
    from pyspark.sql import types as T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make_embedder()
        for i, pdf in enumerate(batches):
            if i and pause:
                time.sleep(pause)
            pdf[out_col] = embed(pdf[text_col])
            yield pdf

    fields = [f for f in df.schema.fields if f.name != out_col]
    schema = T.StructType([*fields, T.StructField(out_col, T.ArrayType(T.FloatType()))])
    return df.drop(out_col).mapInPandas(run, schema)
