"""Ranking candidates for one request or for many.

One request becomes literals: filters reach the scans and the result is a
``TakeOrderedAndProject``. For many requests the work is cut down twice before
anything is paired, both times without losing a result:

* requests that ask for the same thing are scored once and joined back;
* candidates of a city that score the same for every request form a class.
  Equal scores are broken by (type, id), so only the first ``limit`` of a class
  can ever be returned and the others are dropped before the shuffle.

Classes then meet request profiles block by block, so that a city that holds a
large part of the rows is spread over many tasks. No pair becomes a row: a task
scores a block in numpy, best parts first, and skips the parts whose bound is
below what a request has already (``ModelBlock``). Scores that differ for every
single pair (vectors, jitter) have no classes; there, the blocks of candidates are
written to files once and opened by the tasks that hold the requests.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from outings.functions.hours import open_spans, week_minute
from outings.functions.rules import string_array
from outings.functions.scoring import (
    HYBRID, LOCAL, VIBE, Weights, availability_bonus, jitter, low_energy_penalty, needed_minutes,
    round1, tag_score, time_bonus, vibe_match,
)
from outings.functions.times import day_of_week, season_of, time_of_day, ts
from outings.operators.blocks import _plain, blocked_topk, in_blocks, pair_blocks
from outings.operators.blockstore import filed_topk
from outings.operators.filters import (
    band_matches, is_operational, kid_gate, location_band, open_at, season_gate,
)
from outings.operators.modelblock import CHUNK, OUTLINE_TAGS, Asked, ModelBlock, Outlines
from outings.session import stored

TIE_BREAK = ["type", "id"]
DAY_BITS = {"morning": 1, "afternoon": 2, "evening": 4}


def in_city_time(requests: DataFrame, cities: DataFrame, at: str = "requested_at") -> DataFrame:
    """Requests with the minute of the week and the part of the day where they ask for, by the city's zone at that
    time, so daylight saving counts."""
    zones = cities.select(F.col("id").alias("city_id"), "timezone")
    there = F.from_utc_timestamp(F.col(at), F.coalesce("timezone", F.lit("UTC")))
    part = F.create_map(*[F.lit(x) for pair in DAY_BITS.items() for x in pair])[time_of_day(there)]
    return requests.join(zones, "city_id", "left").withColumns(
        {"local_minute": week_minute(there), "local_part": part}
    ).drop("timezone")


@dataclass(frozen=True)
class ScoreModel:
    """A score over (request, candidate).

    ``eligible`` drops candidates no request may get. ``features`` are the
    candidate columns that decide gate and score, ``wishes`` the request columns
    that do. After pairing, request columns carry the prefix ``r_``.
    """

    weights: Weights
    eligible: Callable[[DataFrame], DataFrame]
    features: tuple[str, ...]
    wishes: tuple[str, ...]
    as_of: str
    rounded: bool = True
    keep_zero: bool = False
    vocabulary: tuple[str, ...] | None = None

    @property
    def per_pair(self) -> bool:
        return self.weights.jitter > 0 or "embedding" in self.features

    def candidates(self, acts: DataFrame) -> DataFrame:
        """Eligible rows with just the key and the features."""
        walk = F.col("walk_minutes_from_center")
        derived = {
            "band": location_band(F.col("vibe_inside")),
            "walk": F.when(walk > 0, walk),
            "needed": walk * 2 + 30,
            "bonus": time_bonus(
                F.col("best_times"), time_of_day(ts(self.as_of)), self.weights.time
            ),
            "kid_friendly": F.coalesce("kid_friendly", F.lit(False)),
            "low_energy": F.coalesce("low_energy", F.lit(False)),
            "tags": self._tag_set(),
            "starts": F.when(F.col("type") == "event", F.col("start_time")),
            "open_from": F.transform(self._spans(), lambda s: s["start"]),
            "open_to": F.transform(self._spans(), lambda s: s["stop"]),
            "times": self._times(),
        }
        columns = [derived[f].alias(f) if f in derived else F.col(f) for f in self.features]
        extra = []
        if self.weights.jitter:
            extra = [F.xxhash64(*TIE_BREAK).alias("item_hash")]
        return self.eligible(acts).select("city_id", *TIE_BREAK, *columns, *extra)

    @staticmethod
    def _spans() -> Column:
        return F.when(F.col("type") == "place", open_spans(F.col("hours")))

    @staticmethod
    def _times() -> Column:
        """The best times of day as bits."""
        bits = [F.coalesce(F.array_contains("best_times", n), F.lit(False)).cast("int") * b for n, b in DAY_BITS.items()]
        return bits[0] + bits[1] + bits[2]

    def _tag_set(self) -> Column:
        """Tags as a sorted set so that equal sets group together."""
        tags = F.sort_array(F.array_distinct("tags"))
        return F.array_intersect(tags, string_array(self.vocabulary)) if self.vocabulary else tags

    def order(self, words: list[str] | None) -> list[Column]:
        """What puts alike candidates side by side: gates first, then bonus, the tags that are asked for, and vibes."""
        vibes = [F.coalesce(F.col(f), F.lit(0.5)) for f in self.features if f.startswith("vibe_")]
        out = [F.col(f) for f in ("band", "kid_friendly", "low_energy", "times") if f in self.features]
        out += [-F.col("bonus")] if "bonus" in self.features else []
        out += [F.array_intersect("tags", string_array(words))] if words and "tags" in self.features else []
        return [*out, *(F.round(v * 4) for v in vibes), *vibes, F.xxhash64(*TIE_BREAK)]

    def asked(self, requests: DataFrame) -> DataFrame:
        extra = []
        if self.weights.jitter:
            extra = [F.xxhash64(F.lit(self.weights.seed), "request_id").alias("r_hash")]
        return requests.select(
            "request_id", "city_id", *[F.col(c).alias(f"r_{c}") for c in self.wishes], *extra
        )

    def gate(self) -> Column:
        available = F.col("r_time_available")
        needed = F.col("needed") if "needed" in self.features else needed_minutes(F.col("walk"))
        fits = needed <= available
        ok = fits if "needed" in self.features else needed.isNull() | fits
        if "location" in self.wishes:
            ok = ok & band_matches(F.col("band"), F.col("r_location"))
        if "kid_friendly" in self.wishes:
            ok = ok & kid_gate(F.col("r_kid_friendly"))
        if "requested_date" in self.wishes:
            starts = F.col("starts")
            ok = ok & (starts.isNull() | (starts >= F.col("r_requested_date")))
        if "local_minute" in self.wishes:
            now = F.col("r_local_minute")
            spans = F.arrays_zip("open_from", "open_to")
            ok = ok & (F.col("open_from").isNull() | F.exists(spans, lambda s: (s["open_from"] <= now) & (now < s["open_to"])))
        return F.coalesce(ok, F.lit(False))

    def score(self) -> Column:
        w, available = self.weights, F.col("r_time_available")
        parts = []
        if w.spare:
            parts.append((available - F.col("needed")) * F.lit(w.spare))
        for name in ("quiet", "active", "inside"):
            weight = getattr(w, name)
            if weight:
                parts.append(vibe_match(F.col(f"vibe_{name}"), F.col(f"r_{name}")) * weight)
        if w.tags:
            parts.append(tag_score(F.col("r_tags"), F.col("tags"), w.tags))
        if "times" in self.features:
            hit = F.col("times").bitwiseAND(F.col("r_local_part")) > 0
            parts.append(F.when(hit, F.lit(float(w.time))).otherwise(F.lit(0.0)))
        else:
            parts.append(F.col("bonus"))
        if w.low_energy:
            parts.append(
                low_energy_penalty(F.col("r_low_energy"), F.col("low_energy"), w.low_energy)
            )
        if w.fit:
            parts.append(availability_bonus(F.col("walk"), available, w.fit))
        if w.jitter:
            parts.append(jitter(F.col("r_hash"), F.col("item_hash"), w.jitter))
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return round1(total) if self.rounded else total

    def keeps(self, score: Column) -> Column:
        return score >= 0 if self.keep_zero else score > 0


def hybrid_model(
    as_of, weights: Weights = HYBRID, vocabulary=None, dated: bool = False,
    check_at: str | None = None, strict_hours: bool = False, with_vectors: bool = False, local: bool = False,
) -> ScoreModel:
    """Vibe 20 + 20, tags 30, time of day 20, fit 10; with vectors also semantic 30.

    ``dated`` requests carry ``requested_date``; otherwise all ask for ``as_of``.
    Opening hours are checked at ``as_of`` unless ``check_at`` names another time. ``local`` requests carry
    ``local_minute`` and ``local_part`` (see ``in_city_time``): hours and time of day are then those of each request.
    ``vocabulary`` lists the tags requests can ask for, where that set is known.
    """
    now = ts(as_of)

    def eligible(acts: DataFrame) -> DataFrame:
        out = acts.filter(is_operational())
        if not local:
            out = out.filter(open_at(ts(check_at or as_of), strict_hours))
        if dated:
            return out
        return out.filter((F.col("type") != "event") | (F.col("start_time") >= now))

    vibes = tuple(f"vibe_{n}" for n in ("quiet", "active", "inside") if getattr(weights, n))
    sliders = tuple(n for n in ("quiet", "active", "inside") if getattr(weights, n))
    vector = ("embedding",) * with_vectors
    tags = ("tags",) * bool(weights.tags)
    return ScoreModel(
        weights, eligible,
        (*vibes, "band", "walk", *tags, *(("open_from", "open_to", "times") if local else ("bonus",)),
         *(("starts",) * dated), *vector),
        (*sliders, "location", *tags, "time_available", *(("local_minute", "local_part") * local),
         *(("requested_date",) * dated), *vector),
        as_of, vocabulary=tuple(vocabulary) if vocabulary else None,
    )


def vibe_model(as_of, weights: Weights = VIBE) -> ScoreModel:
    """Vibe 30 + 30, time of day 20, fit 10, low-energy penalty 15; season and kid gates."""

    def eligible(acts: DataFrame) -> DataFrame:
        return acts.filter(F.col("is_active") & season_gate(season_of(ts(as_of))))

    return ScoreModel(
        weights, eligible,
        ("vibe_quiet", "vibe_inside", "walk", "kid_friendly", "low_energy", "bonus"),
        ("quiet", "inside", "time_available", "kid_friendly", "low_energy"),
        as_of,
    )


def local_model(as_of, weights: Weights = LOCAL) -> ScoreModel:
    """Places only: a tenth of the spare minutes, vibe 30 + 30, time of day 20, penalty 15.

    Too long a walk or a missing kid flag disqualifies; a score of 0 still counts.
    """

    def eligible(acts: DataFrame) -> DataFrame:
        return acts.filter(F.col("type") == "place")

    return ScoreModel(
        weights, eligible,
        ("vibe_quiet", "vibe_inside", "needed", "kid_friendly", "low_energy", "bonus"),
        ("quiet", "inside", "time_available", "kid_friendly", "low_energy"),
        as_of, rounded=False, keep_zero=True,
    )


# ---- one request ---------------------------------------------------------------------------


def recommend(acts: DataFrame, request: dict, model: ScoreModel, limit: int = 3) -> DataFrame:
    """Best ``limit`` candidates for one request given as plain values.

    A request with an ``embedding`` is compared block by block, like many requests.
    """
    if "embedding" in model.features:
        values = {"request_id": 0, **request}
        asked = {"request_id", "city_id", *model.wishes}
        one = acts.sparkSession.range(1).select(*[_literal(values.get(n)).alias(n) for n in asked])
        return recommend_many(one, acts, model, limit).select(*TIE_BREAK, "score")
    wishes = {f"r_{name}": _literal(request[name]) for name in model.wishes}
    if model.weights.jitter:
        wishes["r_hash"] = F.xxhash64(F.lit(model.weights.seed), F.lit(request["request_id"]))
    scored = (
        model.candidates(acts.filter(F.col("city_id") == request["city_id"]))
        .withColumns(wishes)
        .filter(model.gate())
        .select(*TIE_BREAK, model.score().alias("score"))
    )
    best = scored.orderBy(F.desc("score"), *TIE_BREAK).limit(limit)
    return best.filter(model.keeps(F.col("score")))


def _literal(value) -> Column:
    if not isinstance(value, (list, tuple)):
        return F.lit(value)
    if value and isinstance(value[0], float):
        return F.array(*[F.lit(v) for v in value]).cast("array<float>")
    return string_array(value)


# ---- many requests -------------------------------------------------------------------------


def candidate_classes(acts: DataFrame, model: ScoreModel, limit: int) -> DataFrame:
    """The first ``limit`` candidates of every class of equal features in a city."""
    window = Window.partitionBy("city_id", *model.features).orderBy(*TIE_BREAK)
    return (
        model.candidates(acts)
        .withColumn("_place", F.row_number().over(window))
        .filter(F.col("_place") <= limit)
        .drop("_place")
    )


def profile_key(model: ScoreModel) -> Column:
    """128-bit key of a request's wishes; JSON keeps NULLs and list ends apart, times to the microsecond."""
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return F.md5(F.to_json(F.struct("city_id", *model.wishes), exact))


def request_profiles(requests: DataFrame, model: ScoreModel) -> DataFrame:
    """Distinct wishes: their key, city, and the wishes prefixed ``r_``."""
    asked = model.asked(requests.withColumn("request_id", profile_key(model)))
    return asked.withColumnRenamed("request_id", "profile").dropDuplicates(["profile"])


def _for_requests(requests: DataFrame, found: DataFrame, model: ScoreModel, how: str) -> DataFrame:
    """Give each request what was found for its profile."""
    asked = requests.select("request_id", profile_key(model).alias("profile"))
    return asked.join(found, "profile", how).drop("profile")


def recommend_many(
    requests: DataFrame, acts: DataFrame, model: ScoreModel, limit: int = 3, explain: bool = False, **blocks
) -> DataFrame:
    """Best ``limit`` candidates for every request: request_id, type, id, score, rank.

    ``explain`` adds the parts of each score (``PARTS``), rounded to one decimal. Profiles and classes, or requests and
    candidates, are written once to the shared folder, because their sizes decide how they are cut into blocks.
    """
    extra = PARTS if explain else ()
    if model.per_pair:
        asked = stored(model.asked(requests), "asked")
        words = _few_asked_tags(model, asked)
        return filed_topk(
            asked, model.candidates(acts), "city_id", "request_id", TIE_BREAK, model.order(words), _pack(model, words),
            _file_search(model, limit, explain), limit, extra=extra, **blocks,
        )
    asked, items = request_profiles(requests, model), candidate_classes(acts, model, limit)
    best = blocked_topk(
        stored(asked, "asked"), stored(items, "candidates"), "city_id", "profile", TIE_BREAK, _search(model, explain), limit,
        extra=extra, chunk=CHUNK, alike=_alike(model), **blocks,
    )
    return _for_requests(requests, best, model, "inner")


#: The parts of the hybrid score.
PARTS = ("quiet_score", "active_score", "tag_score", "semantic_score", "time_bonus", "availability_score")


def _alike(model: ScoreModel) -> tuple[str, ...]:
    """Wishes that put alike requests together: gates and tags first, as they weigh most."""
    first = [n for n in ("location", "kid_friendly", "local_part", "tags") if n in model.wishes]
    return tuple(f"r_{n}" for n in [*first, *(n for n in model.wishes if n not in (*first, "embedding"))])


def _asked_tags(model: ScoreModel, q: pd.DataFrame) -> set[str] | None:
    return {t for row in q["r_tags"] if row is not None for t in row} if model.weights.tags else None


def _search(model: ScoreModel, explain: bool = False):
    model = replace(model, eligible=None)  # tasks score only

    def prepare(items: pd.DataFrame, asked: pd.DataFrame):
        block = ModelBlock(model, items, words=_asked_tags(model, asked))
        place = np.empty(len(items), int)
        place[block.at] = np.arange(len(items))

        def search(q: pd.DataFrame, k: int):
            asked = block.prepare(q)
            rows, cols, scores, _ = block.best(asked, k)
            return rows, cols, scores, block.parts(asked, rows, place[cols]) if explain else {}

        return search

    return prepare


def _few_asked_tags(model: ScoreModel, asked: DataFrame) -> list[str] | None:
    """The tags that requests ask for, if they are few."""
    if not model.weights.tags:
        return None
    rows = asked.select(F.explode("r_tags").alias("tag")).distinct().limit(OUTLINE_TAGS + 1).collect()
    return sorted(r.tag for r in rows if r.tag is not None) if len(rows) <= OUTLINE_TAGS else None


def _pack(model: ScoreModel, words: list[str] | None):
    model = replace(model, eligible=None)  # tasks score only
    words = None if words is None else {None, *words}

    def pack(items: pd.DataFrame) -> tuple[bytes, bytes]:
        block = ModelBlock(model, items, words=words)
        return block.outline(), pickle.dumps((items["type"].to_numpy(), items["id"].to_numpy(), block.packed()), protocol=5)

    return pack


def _file_search(model: ScoreModel, k: int, explain: bool):
    """Search of requests in files of ``_pack``: each request first in the file that promises most, then in all others
    that may hold better ones."""
    model, alike = replace(model, eligible=None), _alike(model)

    def search(q: pd.DataFrame, outlines: list[bytes], read) -> pd.DataFrame:
        q = q.sort_values(list(alike), key=_plain, ignore_index=True)
        words = {t: i for i, t in enumerate(_asked_tags(model, q) or ())}
        files = Outlines(model, outlines, words)
        asked = Asked(files, q)
        # a float32 that is not below the bound
        reach = np.full((len(q), len(outlines)), -np.inf, np.float32)
        for at in range(0, len(q), CHUNK):
            rows = np.arange(at, min(at + CHUNK, len(q)))
            reach[rows] = np.nextafter(files.bound(asked.some(files, rows)).astype(np.float32), np.float32(np.inf))
        top = np.full((len(q), k), -np.inf)  # the best scores so far
        names, found = q["request_id"].to_numpy(), []
        columns = [*TIE_BREAK, "score", *(PARTS if explain else ())]

        def visit(number: int, rows: np.ndarray) -> None:
            types, ids, data = pickle.loads(read(number))
            block = ModelBlock.opened(model, data, words)
            place = np.empty(len(ids), int)
            place[block.at] = np.arange(len(ids))
            for at in range(0, len(rows), CHUNK):
                own = rows[at : at + CHUNK]
                p = asked.some(block, own)
                r, c, scores, _ = block.best(p, k, top[own, -1])
                if len(r):
                    more = block.parts(p, r, place[c]) if explain else {}
                    found.append(pd.DataFrame({"at": own[r], "type": types[c], "id": ids[c], "score": scores, **more}))
                    new = np.full((len(own), k), -np.inf)
                    new[r, np.arange(len(r)) - np.searchsorted(r, r)] = scores
                    top[own] = -np.sort(-np.concatenate([top[own], new], axis=1), axis=1)[:, :k]

        first = reach.argmax(axis=1)
        some = np.isfinite(reach.max(axis=1))
        for number in np.unique(first[some]):
            visit(number, np.flatnonzero(some & (first == number)))
        for number in np.argsort(-reach.max(axis=0), kind="stable"):
            rows = np.flatnonzero(np.isfinite(reach[:, number]) & (reach[:, number] >= top[:, -1]) & (first != number))
            if len(rows):
                visit(number, rows)
            if sum(map(len, found)) > 4 * k * len(q):  # ties of many files
                found[:] = [_first_of_each(found, top)]
        if not found:
            return pd.DataFrame(columns=["request_id", *columns], dtype=object)
        best = _first_of_each(found, top)
        out = best[columns]
        out.insert(0, "request_id", names[best["at"].to_numpy()])
        return out

    return search


def _first_of_each(found: list[pd.DataFrame], top: np.ndarray) -> pd.DataFrame:
    """Of each request (``at``) as many rows as ``top`` has scores, by score and then type and id."""
    rows = pd.concat(found, ignore_index=True)
    rows = rows[rows["score"].to_numpy() >= top[rows["at"].to_numpy(), -1]]
    order = rows.assign(score=-rows["score"]).sort_values(["at", "score", *TIE_BREAK], na_position="first").index
    rows = rows.loc[order]
    return rows[rows.groupby("at").cumcount() < top.shape[1]].reset_index(drop=True)


def score_summary(
    requests: DataFrame, acts: DataFrame, model: ScoreModel, **blocks
) -> DataFrame:
    """Per request over all candidates of its city: how many qualify, best and worst score.

    Classes carry their size, so the counts cover every candidate. A task returns one row per profile
    of its block, not one per pair, and scores no part of a block that the profile may not have.
    """
    classes = (
        model.candidates(acts)
        .groupBy("city_id", *model.features)
        .agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(*TIE_BREAK)).alias("first"))
        .select("*", "first.*")
        .drop("first")
    )
    left, right, keys = pair_blocks(
        stored(request_profiles(requests, model), "asked"), stored(classes, "classes"), "city_id", "profile", TIE_BREAK,
        **blocks,
    )

    terms = replace(model, eligible=None)  # tasks score only

    def work(items: pd.DataFrame, asked: pd.DataFrame):
        block, members = ModelBlock(terms, items, words=_asked_tags(terms, asked)), items["members"].to_numpy()

        def each(q: pd.DataFrame) -> pd.DataFrame:
            count, best, worst = block.totals(block.prepare(q), members)
            out = pd.DataFrame({"profile": q["profile"].to_numpy(), "n": count, "high": best, "low": worst})
            return out[count > 0]

        return each

    found = in_blocks(
        left, right, keys, TIE_BREAK, work, "profile string, n bigint, high double, low double", CHUNK, _alike(model)
    )
    totals = found.groupBy("profile").agg(
        F.sum("n").alias("qualified"), F.max("high").alias("best_score"), F.min("low").alias("worst_score")
    )
    return _for_requests(requests, totals, model, "left").fillna(0, subset=["qualified"])


def candidate_counts(requests: DataFrame, acts: DataFrame) -> DataFrame:
    """Candidates per request before its own gates: counted per city and location band."""
    band = location_band(F.col("vibe_inside"))
    per_city = (
        acts.filter(is_operational())
        .groupBy("city_id")
        .agg(
            F.count(F.lit(1)).alias("n_any"),
            F.count_if(band == "inside").alias("n_inside"),
            F.count_if(band == "outside").alias("n_outside"),
        )
    )
    n = (
        F.when(F.col("location") == "inside", F.col("n_inside"))
        .when(F.col("location") == "outside", F.col("n_outside"))
        .otherwise(F.col("n_any"))
    )
    return requests.join(per_city, "city_id", "left").select(
        "request_id", F.coalesce(n, F.lit(0)).alias("total_candidates")
    )


def request_metadata(
    requests: DataFrame, acts: DataFrame, model: ScoreModel, limit: int = 3
) -> DataFrame:
    """Counts and clock labels that go with every response."""
    summary = score_summary(requests, acts, model)
    now = ts(model.as_of)
    return candidate_counts(requests, acts).join(summary, "request_id").select(
        "request_id",
        time_of_day(now).alias("time_of_day"),
        day_of_week(now).alias("day_of_week"),
        "total_candidates",
        F.col("qualified").alias("filtered_count"),
        F.least(F.col("qualified"), F.lit(limit)).cast("bigint").alias("returned_count"),
    )


# ---- the log -------------------------------------------------------------------------------

_RESULTS_DDL = "array<struct<rank:int,type:string,id:bigint,score:double>>"


def result_json(requests: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Per request its ranked results and preferences as one JSON object.

    A request has at most ``limit`` results, so the collected list is short.
    """
    ranked = results.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "type", "id", "score"))).alias("_ranked")
    )
    listed = F.transform(
        F.coalesce("_ranked", F.array().cast(_RESULTS_DDL)),
        lambda r: F.struct(*[r[c].alias(c) for c in ("type", "id", "score", "rank")]),
    )
    preferences = F.struct(
        F.col("quiet").alias("quietToLively"),
        F.col("active").alias("activeToRelaxing"),
        "location",
        "tags",
        F.date_format(ts(as_of), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("date"),
    )
    body = F.to_json(F.struct(listed.alias("results"), preferences.alias("preferences")))
    return requests.join(ranked, "request_id", "left").select(
        *requests.columns, body.alias("results")
    )


def log_rows(requests: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """One log row per request; the sliders are stored under their older names."""
    now = ts(as_of)
    tag = {t: F.coalesce(F.array_contains("tags", t), F.lit(False))
           for t in ("kid-friendly", "relaxing")}
    return result_json(requests, results, as_of).select(
        F.col("request_id").alias("id"),
        "city_id",
        "time_available",
        F.col("quiet").alias("quiet_social"),
        F.col("active").alias("inside_outside"),
        tag["kid-friendly"].alias("kid_friendly"),
        (tag["relaxing"] | (F.col("active") < 0.3)).alias("low_energy"),
        now.alias("requested_at"),
        time_of_day(now).alias("time_of_day"),
        day_of_week(now).alias("day_of_week"),
        "results",
        F.to_date(now).alias("log_date"),
    )
