"""Properties of the operators: idempotence, skew, plans, streams."""

import pickle
import re
from dataclasses import replace
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation, functions as F

from outings.bindings import AS_OF, Tables
from outings.functions.hours import is_open, open_spans, week_minute
from outings.functions.scoring import HYBRID, LOCAL, VIBE
from outings.functions.vectors import hashed_embedding, model_embedding
from outings.operators import recommend as RC
from outings.operators import similarity as SM
from outings.operators import stats
from outings.operators import upsert as U
from outings.operators.blocks import best_per_row
from outings.operators.embedding import embed_due
from outings.operators.ingest import calendar_events, upsert_calendar
from outings.operators.blocks import ITEM_BLOCK, QUERY_BLOCK, pair_blocks
from outings.operators.blockstore import LEAST_PARTITIONS, write_blocks
from outings.operators.modelblock import Asked, ModelBlock, Outlines
from outings.operators.quality import (
    PRICE_LEVELS, VIBE_RANGES, event_checks, out_of_range, rejected_rows, too_long, valid_rows,
)
from outings.plans import QUERIES
from outings.schemas import HOURS_DDL
from outings.sources.buckets import BucketedTable
from outings.sources.ics import ics_events
from outings.streaming import ingest as SI

REQUEST = {"city_id": 3, "quiet": 0.3, "active": 0.6, "location": "inside",
           "tags": ["small", "ring"], "time_available": 120, "request_id": 1}


@pytest.fixture(scope="module")
def t(spark, data):
    return Tables(spark, data)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


# ---- upsert --------------------------------------------------------------------------------

KEYS, UPDATES = ["k1", "k2"], ["v"]
SCHEMA = "k1 string, k2 string, v string, kept int, seq int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_upsert_rules(spark):
    target = frame(spark, [("a", "1", "old", 1, 0), ("a", None, "null", 2, 0)])
    batch = frame(spark, [("a", "1", "x", 9, 1), ("a", "1", "y", 8, 2), ("b", "1", "p", 5, 3),
                          ("b", "1", "q", 6, 4), ("a", None, "n", 7, 5), ("a", None, "m", 7, 6)])
    out = U.upsert(target, batch, KEYS, UPDATES, "seq")
    rows = sorted((r.k1, r.k2 or "", r.v, r.kept) for r in out.collect())
    # last repeat wins for v, first for the others; NULL keys never match
    assert rows == [("a", "", "m", 7), ("a", "", "n", 7), ("a", "", "null", 2),
                    ("a", "1", "y", 1), ("b", "1", "q", 5)]
    first = U.upsert(target, batch, KEYS, UPDATES, "seq", keep="first")
    assert ("b", "1", "p") in {(r.k1, r.k2, r.v) for r in first.collect()}


def test_upsert_counts_its_outcomes_and_skips(spark, tmp_path):
    target = frame(spark, [("a", "1", "old", 1, 0), ("z", "1", "same", 1, 0)])
    batch = frame(spark, [("a", "1", "x", 9, 1), ("a", "1", "y", 8, 2), ("b", "1", "p", 5, 3), ("b", "1", "q", 5, 4),
                          ("b", "1", None, 5, 5), (None, "1", "r", 5, 6), (None, None, None, 5, 7), ("c", "1", None, 5, 8)])
    counts = Observation("merge")
    out = U.upsert(target, batch, KEYS, UPDATES, "seq", checks={"missing v": F.col("v").isNull()}, counts=counts)
    out.write.parquet(str(tmp_path / "merged"))
    rows = sorted((r.k1 or "", r.v) for r in spark.read.parquet(str(tmp_path / "merged")).collect())
    assert rows == [("", "r"), ("a", "y"), ("b", "q"), ("z", "same")]
    assert {r.outcome: r.n for r in U.outcome_rows(spark, counts).collect()} == {
        "inserted": 2, "updated": 3, "skipped": 3
    }


def test_upsert_needs_two_scans_and_two_shuffles(spark, data):
    """The stored table is itself one scan and one shuffle in these queries."""
    for name in ("upsert_events", "upsert_events_partial", "insert_new_events"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 2, name
        assert "Join" not in plan


def test_guarded_versions_in_any_order(spark):
    v1, v2 = frame(spark, [("a", "1", "v1", 1, 1)]), frame(spark, [("a", "1", "v2", 1, 2)])
    results = []
    for first, second in ((v1, v2), (v2, v1)):
        table = U.upsert(first.limit(0), first, KEYS, ["v", "seq"], "seq", guard=True)
        out = U.upsert(table, second, KEYS, ["v", "seq"], "seq", guard=True)
        results.append([(r.v, r.seq) for r in out.collect()])
    assert results == [[("v2", 2)]] * 2


def test_upsert_is_idempotent_and_keys_stay_unique(spark, t):
    keys, cols = ["source", "source_id"], ["source", "source_id", "id", "title", "start_time"]
    batch = t.events.select(*cols)
    once = U.upsert(batch.limit(0), batch, keys, ["title", "start_time"], "id")
    twice = U.upsert(once, batch, keys, ["title", "start_time"], "id")
    assert same(once, twice)
    assert once.count() == once.select(*keys).distinct().count()


def test_one_key_holding_most_rows(spark):
    batch = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k1"),
        F.lit("1").alias("k2"), F.col("id").cast("string").alias("v"),
        F.col("id").cast("int").alias("kept"), F.col("id").cast("int").alias("seq"),
    )
    out = U.upsert(batch.limit(0), batch, KEYS, UPDATES, "seq").filter("k1 = 'hot'").collect()
    assert [(r.v, r.kept) for r in out] == [("19998", 0)]
    assert U.dedupe_first(batch, KEYS, "seq").count() == 20000 - 6666


def test_quarantine_splits_the_input(spark, t):
    batch = t.events.withColumn("title", F.when(F.col("id") % 3 != 0, F.col("title")))
    good, bad = valid_rows(batch, event_checks()), rejected_rows(batch, event_checks())
    assert same(good.select("id").union(bad.select("id")), batch.select("id"))
    rows = spark.createDataFrame([(1.5, 1, "x"), (0.5, 9, "x"), (None, 1, "xyz"), (0.1, 1, "x")],
                                 "vibe_quiet double, price_level int, name string")
    checks = out_of_range(vibe_quiet=VIBE_RANGES["vibe_quiet"], **PRICE_LEVELS) | too_long(name=2)
    assert rejected_rows(rows, checks).count() == 3


# ---- ranking -------------------------------------------------------------------------------


@pytest.mark.parametrize("make", [RC.hybrid_model, RC.vibe_model, RC.local_model])
def test_blocks_equal_classes(t, make):
    """A vanishing jitter turns the pair-wise path on without changing any score."""
    model = make(AS_OF)
    pairwise = replace(model, weights=replace(model.weights, jitter=1e-30))
    a = RC.recommend_many(t.requests, t.activities(), model)
    b = RC.recommend_many(t.requests, t.activities(), pairwise, query_block=16, item_block=64)
    near = lambda df: df.withColumn("score", F.round("score", 9))
    assert same(near(a), near(b))


def test_small_blocks_change_nothing(t):
    model = RC.hybrid_model(AS_OF)
    a = RC.recommend_many(t.requests, t.activities(), model)
    b = RC.recommend_many(t.requests.repartition(7), t.activities().repartition(5), model,
                          query_block=3, item_block=5)
    assert same(a, b)


def test_one_city_holding_everything(t):
    one = F.lit(1).alias("city_id")
    requests = t.requests.drop("city_id").select("*", one)
    acts = t.activities().drop("city_id").select("*", one)
    model = RC.hybrid_model(AS_OF)
    a = RC.recommend_many(requests, acts, model, query_block=8, item_block=32)
    pairwise = replace(model, weights=replace(HYBRID, jitter=1e-30))
    assert same(a, RC.recommend_many(requests, acts, pairwise))


def test_single_request_equals_batch(spark, t):
    model = RC.hybrid_model(AS_OF)
    one = RC.recommend(t.activities(), REQUEST, model)
    row = spark.createDataFrame([REQUEST])
    many = RC.recommend_many(
        row.withColumn("city_id", F.col("city_id").cast("int")), t.activities(), model
    )
    assert same(one, many.select("type", "id", "score"))


def test_requested_dates(spark, t):
    model = RC.hybrid_model(AS_OF, dated=True)
    requests = t.requests.withColumn(
        "requested_date",
        F.when(F.col("request_id") % 2 == 0, F.lit(AS_OF)).otherwise("2024-01-29").cast("timestamp"),
    )
    best = RC.recommend_many(requests, t.activities(), model, limit=5)
    starts = best.join(t.activities(), ["type", "id"]).join(
        requests.select("request_id", "requested_date"), "request_id")
    assert starts.filter("start_time < requested_date").count() == 0
    plain = RC.recommend_many(t.requests, t.activities(), RC.hybrid_model(AS_OF), limit=5)
    even = "request_id % 2 = 0"
    assert same(best.filter(even), plain.filter(even))


def test_one_request_with_a_vector_equals_many(t):
    model = RC.hybrid_model(AS_OF, with_vectors=True)
    requests = t.requests.join(t.embeddings, "vec_id", "left")
    acts = t.activities().join(t.embeddings, "vec_id", "left")
    many = RC.recommend_many(requests, acts, model)
    for row in requests.filter("embedding IS NOT NULL").orderBy("request_id").limit(2).collect():
        one = RC.recommend(acts, row.asDict(), model)
        assert same(one, many.filter(F.col("request_id") == row.request_id).select(one.columns))


def test_missing_wishes_rank_alike_on_both_paths(t):
    """NULL in any wish: the class path and the pair-wise path agree."""
    model = RC.hybrid_model(AS_OF)
    pairwise = replace(model, weights=replace(model.weights, jitter=1e-30))
    for wish in ("time_available", "location", "quiet", "tags"):
        asked = t.requests.withColumn(
            wish, F.when(F.col("request_id") % 2 == 0, F.col(wish)))
        a, b = (RC.recommend_many(asked, t.activities(), m) for m in (model, pairwise))
        assert same(a, b), wish


def test_jitter_is_repeatable_and_bounded(t):
    model = RC.hybrid_model(AS_OF, weights=replace(HYBRID, jitter=5.0, seed=7))
    a = RC.recommend_many(t.requests, t.activities(), model)
    assert same(a, RC.recommend_many(t.requests, t.activities(), model, item_block=50))
    plain = RC.recommend_many(t.requests, t.activities(), RC.hybrid_model(AS_OF))
    gap = a.alias("a").join(plain.alias("p"), ["request_id", "rank"]).select(
        (F.col("a.score") - F.col("p.score")).alias("d"))
    assert gap.filter("d < 0 OR d > 5.1").count() == 0


def test_vocabulary_changes_nothing(t):
    words = ["small", "ring", "music", "food", "hot", "bolt"]
    a = RC.recommend_many(t.requests, t.activities(), RC.hybrid_model(AS_OF))
    b = RC.recommend_many(t.requests, t.activities(), RC.hybrid_model(AS_OF, vocabulary=words))
    assert same(a, b)


def test_weights_are_the_documented_points():
    assert (HYBRID.quiet, HYBRID.active, HYBRID.tags, HYBRID.semantic) == (20, 20, 30, 30)
    assert (VIBE.quiet, VIBE.inside, VIBE.low_energy, LOCAL.spare) == (30, 30, 15, 0.1)


def test_best_per_row_breaks_ties_by_position():
    scores = np.array([[1.0, 3.0, 3.0, 3.0, -np.inf], [-np.inf] * 5])
    rows, cols = best_per_row(scores, 2)
    assert rows.tolist() == [0, 0] and cols.tolist() == [1, 2]


# ---- plans ---------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_of_one_request(t):
    plan = plan_of(RC.recommend(t.activities(), REQUEST, RC.hybrid_model(AS_OF)))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert "Python" not in plan and "embedding" not in plan
    assert plan.count("PushedFilters") == 2 and "GreaterThan(ts" in plan


@pytest.mark.parametrize("name", ["topn_per_request", "score_matrix", "score_hybrid"])
def test_plan_of_many_requests(spark, data, name):
    """Blocks meet in one cogroup; only their results, k rows a request, are shuffled again."""
    plan = plan_of(QUERIES[name](spark, data))
    assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("FlatMapCoGroupsInPandas") == 1
    assert plan.count("FileScan") <= 6 and "part.parquet" not in plan and "events.parquet" not in plan
    if name != "score_matrix":
        assert plan.count("WindowGroupLimit") == 2  # before and behind the shuffle


def random_block(make, items, requests, seed):
    """A block with two-decimal vibes, ties, gaps, tags and vectors, and what all pairs score."""
    rng = np.random.default_rng(seed)
    model = replace(make, eligible=None)
    vibe = lambda n: np.where(rng.random(n) < 0.05, np.nan, rng.integers(0, 101, n) / 100)
    words = [f"w{i}" for i in range(12)]
    pick = lambda n, most: [None if rng.random() < 0.1 else list(rng.choice(words, rng.integers(0, most))) for _ in range(n)]
    unit = lambda n: [None if rng.random() < 0.1 else rng.normal(size=8) for _ in range(n)]
    it = pd.DataFrame({
        **{f"vibe_{n}": vibe(items) for n in ("quiet", "active", "inside")}, "tags": pick(items, 5), "embedding": unit(items),
        "band": rng.choice(["inside", "outside", None], items), "walk": np.where(rng.random(items) < 0.2, np.nan, rng.integers(1, 60, items)),
        "bonus": rng.choice([0.0, 20.0], items), "kid_friendly": rng.random(items) < 0.5, "low_energy": rng.random(items) < 0.5,
    })
    it["needed"] = it["walk"] * 2 + 30
    q = pd.DataFrame({
        **{f"r_{n}": vibe(requests) for n in ("quiet", "active", "inside")}, "r_tags": pick(requests, 4), "r_embedding": unit(requests),
        "r_location": rng.choice(["inside", "outside", "either", None], requests), "r_time_available": rng.choice([60, 90, 150], requests),
        "r_kid_friendly": rng.choice([True, False, None], requests), "r_low_energy": rng.choice([True, False, None], requests),
    })
    block = ModelBlock(model, it, part=16)
    asked = block.prepare(q)
    scores = np.full((requests, items), -np.inf)
    scores[:, block.at] = block.score(asked, np.arange(requests), 0, items)
    return block, asked, scores


def block_requests(make, items, requests, seed):
    """The requests of ``random_block``."""
    held = []
    prepare = ModelBlock.prepare
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ModelBlock, "prepare", lambda block, q: held.append(q) or prepare(block, q))
        random_block(make, items, requests, seed)
    return held[0]


MODELS = {
    "hybrid": lambda: RC.hybrid_model(AS_OF), "vectors": lambda: RC.hybrid_model(AS_OF, with_vectors=True),
    "vibe": lambda: RC.vibe_model(AS_OF), "local": lambda: RC.local_model(AS_OF),
}


@pytest.mark.parametrize("name", MODELS)
@pytest.mark.parametrize("items", [1, 16, 700])
def test_bounds_lose_nothing(spark, name, items):
    block, asked, scores = random_block(MODELS[name](), items, 40, items)
    bound = block.bound(asked)
    for s, (low, high) in enumerate(zip(block.starts, block.stops)):
        assert (scores[:, block.at[low:high]].max(axis=1) <= bound[:, s]).all()
    for k in (1, 3, 10):
        rows, cols, found, _ = block.best(asked, k)
        want = [(r, c, scores[r, c]) for r in range(40) for c in sorted(range(items), key=lambda c: (-scores[r, c], c))[:k]
                if np.isfinite(scores[r, c])]
        assert list(zip(rows, cols, found)) == want
    members = np.arange(items) % 3 + 1
    count, best, worst = block.totals(asked, members)
    ok = np.isfinite(scores)
    assert (count == ok @ members).all() and (best == scores.max(axis=1)).all()
    assert (worst == np.where(ok, scores, np.inf).min(axis=1)).all()


def test_large_groups_are_copied_to_few_blocks(spark):
    """Each row goes to every block of the other side, so blocks grow with the group up to a bound."""
    queries = spark.range(100_000).select(F.lit(1).alias("g"), F.col("id").alias("q"))
    items = spark.range(300_000).select(F.lit(1).alias("g"), "id")
    left, right, keys = pair_blocks(queries, items, "g", "q", ["id"])
    assert left.count() <= 8 * 100_000 and right.count() <= 8 * 300_000
    for side, most in ((left, QUERY_BLOCK[1]), (right, ITEM_BLOCK[1])):
        assert side.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 1.1 * most


def test_bounds_work_out_few_similarities(spark):
    """Similarities are worked out for the parts that could win at the largest similarity, not for the block."""
    block, asked, scores = random_block(MODELS["vectors"](), 4000, 64, 9)
    assert "near" not in asked
    assert block.best(asked, 3)[3] < 0.25 * scores.size


def test_bounds_skip_most_pairs(spark):
    """Two-decimal vibes leave hardly two candidates alike; still most parts are never scored."""
    for name, most in (("hybrid", 0.35), ("vibe", 0.35), ("local", 0.35), ("vectors", 0.6)):
        block, asked, scores = random_block(MODELS[name](), 4000, 64, 9)
        assert block.best(asked, 3)[3] < most * scores.size, (name, block.best(asked, 3)[3] / scores.size)


def rows_dealt(df):
    """Rows of both sides that the tasks of a ranking meet."""
    spark, at = df.sparkSession, df._jdf.queryExecution().analyzed()
    while at.nodeName() != "FlatMapCoGroupsInPandas":
        at = at.children().head()
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    return [rows(spark._jsparkSession, at.children().apply(i)).count() for i in (0, 1)]


def with_vectors(spark, requests, items, seed=3, cities=1):
    """Requests and candidates that each have a vector of their own, and some that have none."""
    rng = np.random.default_rng(seed)
    vector = lambda i: None if i % 7 == 3 else [float(x) for x in rng.normal(size=6)]
    asked = [(i, i % cities + 1, float(rng.random()), float(rng.random()), ["inside", "outside", "either"][i % 3],
              [["a", "b"], ["c"], None, []][i % 4], 60 + 30 * (i % 4), vector(i)) for i in range(requests)]
    had = [("place" if i % 2 else "event", i // 2, i % cities + 1, float(rng.random()), float(rng.random()), [0.1, 0.5, 0.9, None][i % 4],
            [["a"], ["b", "z"], ["c", "a", "y"], None, []][i % 5], [None, 10, 20, 50][i % 4], vector(i)) for i in range(items)]
    acts = spark.createDataFrame(
        had, "type string, id long, city_id int, vibe_quiet double, vibe_active double, vibe_inside double, "
        "tags array<string>, walk_minutes_from_center int, embedding array<float>"
    ).select(
        "*", F.lit(True).alias("is_active"), F.lit("OPERATIONAL").alias("business_status"),
        F.when(F.col("type") == "event", F.lit("2024-02-01").cast("timestamp")).alias("start_time"),
        F.lit(None).cast("array<string>").alias("best_times"), F.lit(None).cast("boolean").alias("kid_friendly"),
        F.lit(None).cast("boolean").alias("low_energy"), F.lit(None).cast(HOURS_DDL).alias("hours"),
    )
    return spark.createDataFrame(
        asked, "request_id long, city_id int, quiet double, active double, location string, tags array<string>, "
        "time_available int, embedding array<float>"
    ), acts


def test_candidates_with_vectors_are_not_copied(spark):
    """A task is told the files of its city; no candidate is dealt out, and each request once."""
    requests, acts = with_vectors(spark, 300, 500)
    best = RC.recommend_many(requests, acts, RC.hybrid_model(AS_OF, with_vectors=True), query_block=20, item_block=25)
    left, right = rows_dealt(best)
    files = 500 // 25 + max(LEAST_PARTITIONS, 4)  # of every partition one that is not full
    assert left == 300 and right <= 15 * files


def test_files_hold_every_candidate_once(spark):
    _, acts = with_vectors(spark, 1, 700, cities=3)
    model = RC.hybrid_model(AS_OF, with_vectors=True)
    items, words = model.candidates(acts), ["a", "b", "c"]
    files = write_blocks(items, "city_id", model.order(words), RC.TIE_BREAK, RC._pack(model, words), 50).collect()
    held = []
    for row in files:
        types, ids, data = pickle.loads(Path(row["_path"].removeprefix("file:")).read_bytes())
        assert 1 <= len(ids) <= 50 and len(ModelBlock.opened(model, data, {}).at) == len(ids)
        held += [(row["city_id"], *key) for key in zip(types, ids.tolist())]
    assert sorted(held) == sorted(tuple(r) for r in items.select("city_id", "type", "id").collect())


@pytest.mark.parametrize("cities", [1, 3])
def test_files_give_what_all_pairs_give(spark, cities):
    requests, acts = with_vectors(spark, 60, 400, cities=cities)
    model = RC.hybrid_model(AS_OF, with_vectors=True)
    q = model.asked(requests).toPandas()
    want = []
    for city, it in model.candidates(acts).toPandas().groupby("city_id"):
        it = it.sort_values(RC.TIE_BREAK, ignore_index=True)
        asked = q[q["city_id"] == city]
        block = ModelBlock(replace(model, eligible=None), it)
        scores = np.empty((len(asked), len(it)))
        scores[:, block.at] = block.score(block.prepare(asked), np.arange(len(asked)), 0, len(it))
        for request, row in zip(asked["request_id"], scores):
            first = [i for i in np.argsort(-row, kind="stable")[:3] if np.isfinite(row[i])]
            want += [(request, it["type"][i], it["id"][i], row[i], n + 1) for n, i in enumerate(first)]
    for sizes in ({}, {"query_block": 7, "item_block": 9}, {"item_block": 1}):
        found = RC.recommend_many(requests, acts, model, **sizes)
        assert sorted(map(tuple, found.collect())) == sorted(want), sizes


def test_ties_over_many_files_keep_the_first(spark):
    """All candidates score the same, so that every file has as good ones as the file before."""
    requests, acts = with_vectors(spark, 5, 200)
    alike = acts.withColumns({"vibe_quiet": F.lit(0.5), "vibe_active": F.lit(0.5), "vibe_inside": F.lit(0.5), "tags": F.array().cast("array<string>"),
                              "walk_minutes_from_center": F.lit(None).cast("int"), "embedding": F.lit(None).cast("array<float>")})
    found = RC.recommend_many(requests.withColumn("location", F.lit("either")), alike, RC.hybrid_model(AS_OF, with_vectors=True), item_block=3)
    assert {(r.type, r.id) for r in found.collect()} == {("event", 0), ("event", 1), ("event", 2)}


@pytest.mark.parametrize("name", MODELS)
def test_opened_blocks_and_outlines(spark, name):
    """An opened block scores as the packed one; no member exceeds the bound of its block's outline."""
    block, asked, scores = random_block(MODELS[name](), 300, 40, 5)
    model, q = block.model, block_requests(MODELS[name](), 300, 40, 5)
    words = {t: i for i, t in enumerate(sorted({t for r in q["r_tags"] if r is not None for t in r} | {"other"}))}
    outlines = Outlines(model, [block.outline()] * 2, words)
    some = Asked(outlines, q)
    again, rows = ModelBlock.opened(model, block.packed(), words), np.array([5, 3, 38])
    found = np.empty((3, 300))
    found[:, again.at] = again.score(some.some(again, rows), np.arange(3), 0, 300)
    assert (found == scores[rows]).all()
    assert (outlines.bound(some.some(outlines, rows)) >= scores[rows].max(axis=1, keepdims=True)).all()
    floor = scores[rows].max(axis=1)
    request, place, value, _ = again.best(some.some(again, rows), 3, floor)
    assert (value == floor[request]).all() and set(request) == set(np.flatnonzero(np.isfinite(floor)))
    assert all(scores[rows[r], c] == floor[r] for r, c in zip(request, place))


def test_calendar_texts_are_parsed_by_all_tasks(spark, data):
    """A small file is read by few tasks; its rows are dealt to all before they become texts."""
    plan = plan_of(QUERIES["calendar_events"](spark, data))
    assert "RoundRobinPartitioning(4)" in plan


def test_rule_tables_stay_compiled_code(t, capsys):
    """The virtual machine does not compile methods of more than 8,000 bytes."""
    t.spark.conf.set("spark.sql.adaptive.enabled", "false")  # shows the code of all stages before they run
    try:
        QUERIES["calendar_events"].build(t).explain("codegen")
    finally:
        t.spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_feed_lines_may_end_either_way(spark):
    feed = "BEGIN:VEVENT\r\nSUMMARY:Jazz\nUID:a\r\r\nDTSTART:20240203T190000\nEND:VEVENT\r\n"
    row = ics_events(spark.createDataFrame([(feed,)], "value string")).first()
    assert (row.title, row.uid, str(row.start_time)) == ("Jazz", "a\r", "2024-02-03 19:00:00")


def test_type_filter_drops_a_branch(t):
    plan = plan_of(t.activities().filter("type = 'event'").select("id"))
    assert plan.count("FileScan") == 1 and "events.parquet" in plan


# ---- vectors -------------------------------------------------------------------------------


def queries_of(t):
    return t.embeddings.select(F.col("vec_id").alias("query_id"),
                               F.col("embedding").alias("q_vector"))


def test_nearest_equals_numpy(t):
    found = SM.nearest(queries_of(t), t.embeddings, 3, ["vec_id"], query_block=64, item_block=100)
    pdf = t.embeddings.orderBy("vec_id").toPandas()
    m = np.stack(pdf.embedding).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-(m @ m.T), axis=1, kind="stable")[:, :3]
    got = found.orderBy("query_id", "rank").toPandas().vec_id.to_numpy().reshape(-1, 3)
    assert (pdf.vec_id.to_numpy()[want] == got).all()


def test_probing_lists(t):
    exact = SM.nearest(queries_of(t), t.embeddings, 5, ["vec_id"])
    full = SM.ivf_topk(t.embeddings, queries_of(t), 5, ["vec_id"], n_lists=10, n_probe=10)
    assert SM.recall(full, exact, ["vec_id"]).first().recall == 1.0
    some = SM.ivf_topk(t.embeddings, queries_of(t), 5, ["vec_id"], n_lists=10, n_probe=4)
    assert SM.recall(some, exact, ["vec_id"]).first().recall > 0.5
    assert SM.list_count(95) == 10 and SM.list_count(0) == 1


def test_registered_probing_finds_nine_of_ten(t):
    exact = SM.nearest(queries_of(t).filter("query_id % 50 = 0"), t.embeddings, 5, ["vec_id"])
    found = QUERIES["ivf_topk"].build(t)
    others = [df.filter("query_id != vec_id") for df in (found, exact)]
    assert SM.recall(*others, ["vec_id"]).first().recall >= 0.9
    assert SM.list_count(1_000_000) == 1_000


def test_registered_probing_asks_for_every_fiftieth_row(t):
    """A search of all rows with all rows grows with their square."""
    asked = {r.query_id for r in QUERIES["ivf_topk"].build(t).select("query_id").distinct().collect()}
    assert asked == {r.vec_id for r in t.embeddings.filter("vec_id % 50 = 0").collect()}


def test_centres_from_a_sample_still_place_every_vector(t, monkeypatch):
    monkeypatch.setattr(SM, "FITTED", 60)
    members, centres = SM.assign_lists(t.embeddings, 8)
    assert members.count() == t.embeddings.count() and len(centres) <= 8
    found = SM.ivf_topk(t.embeddings, queries_of(t), 5, ["vec_id"], n_lists=8)
    exact = SM.nearest(queries_of(t), t.embeddings, 5, ["vec_id"])
    assert SM.recall(found, exact, ["vec_id"]).first().recall >= 0.85


def test_embedders(spark):
    df = spark.createDataFrame([(1, "jazz at noon"), (2, " "), (3, None)], "id int, body string")
    rows = {r.id: r.v for r in hashed_embedding(df, "body", "v", 16).collect()}
    assert abs(sum(x * x for x in rows[1]) - 1) < 1e-6 and rows[2] is None and rows[3] is None

    def make():
        return lambda texts: [None if t is None else [float(len(t))] for t in texts]

    out = {r.id: r.v for r in model_embedding(df, "body", "v", make).collect()}
    assert out == {1: [12.0], 2: [1.0], 3: None}


# ---- log and statistics ----------------------------------------------------------------------


def test_popularity_reads_both_forms(spark):
    rows = [('{"results":[{"type":"place","id":1},{"type":"place","id":2}]}',),
            ('[{"type":"place","id":1,"score":3.5,"rank":1}]',), ("broken",)]
    log = spark.createDataFrame(rows, "results string").withColumn(
        "requested_at", F.lit(AS_OF).cast("timestamp"))
    acts = spark.createDataFrame([("place", 1, "A"), ("place", 2, "B")],
                                 "type string, id bigint, title string")
    out = stats.popular_recommendations(log, acts, AS_OF).collect()
    assert [(r.title, r.recommended_count) for r in out] == [("A", 2), ("B", 1)]


def test_empty_tables(spark, t):
    none = t.activities().limit(0)
    assert stats.embedding_coverage(none, "vec_id").first().coverage_percent is None
    assert RC.recommend_many(t.requests, none, RC.hybrid_model(AS_OF)).count() == 0


# ---- streams -------------------------------------------------------------------------------


def feed(n):
    return (f"BEGIN:VEVENT\nSUMMARY:Jazz {n}\nDTSTART:2024060{n}T190000\nUID:u{n % 2}\nEND:VEVENT\n"
            f"BEGIN:VEVENT\nDTSTART:20240601\nEND:VEVENT\n")


def test_stream_equals_batch_and_reruns_are_harmless(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    table = BucketedTable(spark, str(tmp_path / "table"), ["source", "source_id"], buckets=4)
    batch = None
    for n in range(1, 5):
        (landing / f"{n}.ics").write_text(feed(n))
        stream = SI.feed_stream(spark, str(landing), 1)
        for _ in range(2):  # the second run finds nothing new
            SI.start_ingest(
                stream, table, str(tmp_path / "state"), "cal", 1, AS_OF, str(tmp_path / "rejected")
            ).awaitTermination()
        one = spark.createDataFrame([(feed(n),)], "value string")
        rows, _ = calendar_events(ics_events(one), "cal", 1)
        batch = upsert_calendar(batch, rows, "position", AS_OF)
    columns = ["source_id", "title", "slug", "start_time", "updated_at"]
    assert same(table.read().select(*columns), batch.select(*columns))
    titles = {r.source_id: (r.title, r.slug) for r in table.read().collect()}
    assert titles == {"u1": ("Jazz 3", "jazz-1"), "u0": ("Jazz 4", "jazz-2")}
    rejected = spark.read.parquet(str(tmp_path / "rejected"))
    assert [r.reason for r in rejected.collect()] == ["missing title"] * 4


def test_drain_in_reversed_file_order(spark, tmp_path):
    ddl = "source string, source_id string, scraped_at int, title string"
    versions = [("s", "1", 2, "new"), ("s", "1", 1, "old"), ("s", "2", 1, "only"), (None, "3", 1, "no source")]
    for i, row in enumerate(versions):
        spark.createDataFrame([row], ddl).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    tables = []
    for name, order in (("a", range(4)), ("b", [3, 2, 1, 0])):
        table = BucketedTable(spark, str(tmp_path / name), ["source", "source_id"], buckets=4)
        for i in order:
            staged = spark.readStream.schema(ddl).parquet(str(tmp_path / f"in{i}"))
            SI.drain_staging(
                staged, table, str(tmp_path / f"{name}-state{i}"), lambda rows: rows, ["scraped_at", "title"], "scraped_at",
                AS_OF, str(tmp_path / f"{name}-rejected{i}"),
            ).awaitTermination()
        tables.append(sorted((r.source_id, r.title) for r in table.read().collect()))
        assert spark.read.parquet(str(tmp_path / f"{name}-rejected3")).first().reason == "missing source"
    assert tables == [[("1", "new"), ("2", "only")]] * 2


def test_stream_dedupe_keeps_every_key_in_any_order(spark, tmp_path):
    landing = str(tmp_path / "landing")
    rows = [("a", 1, "2024-09-01"), ("a", 2, "2024-08-20"), ("b", 3, "2024-01-20"),
            ("b", 4, "2024-01-21"), ("a", 1, "2024-01-22"), (None, 5, "2024-01-22"),
            (None, 5, "2030-01-01")]
    ddl = "source string, source_id long, start_time string"
    table = BucketedTable(spark, str(tmp_path / "out"), ["source", "source_id"], buckets=3, equal_nulls=True)
    for row in rows:
        spark.createDataFrame([row], ddl).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(landing)
        SI.dedupe_stream(stream, table, str(tmp_path / "state")).awaitTermination()
    SI.dedupe_stream(stream, table, str(tmp_path / "lost")).awaitTermination()  # all rows again
    out = table.read().select("source", "source_id").collect()
    assert len(out) == 5 and {tuple(r) for r in out} == {(r[0], r[1]) for r in rows}


# ---- embedding job -------------------------------------------------------------------------


def test_embedding_job_goes_on_where_it_stopped(spark, tmp_path):
    """The third batch fails at first; after the second run no row of the first two was embedded again."""
    calls = tmp_path / "calls"
    calls.mkdir()
    texts = spark.createDataFrame([(i, None if i == 5 else f"text {i}") for i in range(40)], "id long, body string")
    results = BucketedTable(spark, str(tmp_path / "vectors"), ["id"], buckets=3)
    state = {"batch": 0, "broken": True}

    def embed(rows):
        state["batch"] += 1
        broken, folder = state["broken"] and state["batch"] == 3, str(calls)

        def make():
            def run(batch):
                if broken:
                    raise ValueError("model is down")
                for text in batch:
                    with open(f"{folder}/{text}", "a") as out:
                        out.write("x")
                return [None if text is None else [float(len(text))] for text in batch]
            return run

        return model_embedding(rows, "body", "embedding", make)

    with pytest.raises(Exception, match="model is down"):
        embed_due(texts, results, embed, batches=4)
    first = results.read().count()
    assert 0 < first < 40
    state["broken"] = False
    counts = embed_due(texts, results, embed, batches=4)
    assert counts["embedded"] + counts["failed"] == 40 - first and results.read().count() == 40
    assert results.read().filter("embedding IS NULL").count() == 1
    assert all(len(p.read_text()) == 1 for p in calls.iterdir())  # one call a text
    assert embed_due(texts, results, embed, batches=4) == {"embedded": 0, "failed": 0}


def test_city_time_counts_daylight_saving(spark):
    cities = spark.createDataFrame([(1, "America/Chicago"), (2, "Asia/Kolkata"), (3, None)], "id int, timezone string")
    asked = spark.createDataFrame(
        [(1, "2024-03-10 07:59:00"), (1, "2024-03-10 08:01:00"), (2, "2024-03-09 19:00:00"), (3, "2024-03-09 19:00:00"), (9, "2024-03-09 05:00:00")],
        "city_id int, at string",
    ).withColumn("requested_at", F.col("at").cast("timestamp"))
    rows = {(r.city_id, r["at"][-8:-3]): (r.local_minute, r.local_part) for r in RC.in_city_time(asked, cities).collect()}
    assert rows == {(1, "07:59"): (119, 1), (1, "08:01"): (181, 1), (2, "19:00"): (30, 1), (3, "19:00"): (6 * 1440 + 1140, 4),
                    (9, "05:00"): (6 * 1440 + 300, 1)}


def test_open_spans_are_is_open(t):
    """Every half hour of a week: the spans hold exactly where the plain rule says open."""
    hours = t.places.limit(60).select("id", "hours")
    at = F.expr("timestamp '2024-01-14 00:00:00' + make_interval(0, 0, 0, 0, 0, step * 30)")
    steps = hours.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(335)))).withColumn("at", at)
    spans, now = open_spans(F.col("hours")), week_minute(F.col("at"))
    inside = spans.isNull() | F.exists(spans, lambda s: (s["start"] <= now) & (now < s["stop"]))
    assert steps.filter(inside != is_open(F.col("hours"), F.col("at"))).count() == 0
    assert steps.filter(inside).count() not in (0, 60 * 336)
