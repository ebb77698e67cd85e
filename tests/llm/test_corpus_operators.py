"""Near duplicates, vectors, token files, shards, scores, chat formatting and the pipeline."""

import collections
import hashlib
import itertools
import math
import pickle
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import connect, rows as as_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from outings.llm import ann, attention, chat, hilbert, lmscore, neardup, tables, tokenfile
from outings.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, path, name):
    return spark.read.parquet(f"{path}/{name}.parquet")


# ---- near duplicates


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) >= size:
        return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return frozenset([tuple(words)] if words else [])


def brute_components(texts, size, percent=80):
    """Component of each id over all pairs."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    label = {i: i for i in texts}
    links = [
        (a, b) for a, b in itertools.combinations(sorted(texts), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return sets, label


def check_components(out, texts, size):
    sets, label = brute_components(texts, size)
    for r in out:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)


def test_op4_equals_all_pairs(spark, data):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    out = QUERIES["op4_near_duplicates"](spark, data).collect()
    assert len(out) == len(texts)
    check_components(out, texts, 2)


def test_groups_that_are_split_into_blocks(spark, monkeypatch):
    """A large group of near copies, chains and unrelated texts, with blocks of a few rows."""
    for name, rows in (("LEFT_ROWS", 3), ("RIGHT_ROWS", 5), ("CALL_ROWS", 8)):
        monkeypatch.setattr(neardup, name, rows)
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    texts = {}
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(60)] = f"v{rng.randrange(500)}"
        texts[i] = " ".join(words)
    for i in range(40, 60):  # a chain: each differs a little from the one before
        words = texts[i - 1].split()
        words[(3 * i) % 60] = f"c{i}"
        texts[i] = " ".join(words)
    for i in range(60, 75):
        texts[i] = " ".join(f"u{rng.randrange(40)}" for _ in range(rng.randint(1, 12)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = neardup.near_duplicates(docs, shingle=2).collect()
    assert len(out) == len(texts)
    check_components(out, texts, 2)


def test_near_duplicates_over_odd_rows(odd, none):
    out = neardup.near_duplicates(odd, shingle=2).collect()
    assert len(out) == odd.count()
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert all(r.component_id is None and not r.kept for r in by[None])
    assert [r.component_id for r in by[2]] == [1] and [r.component_id for r in by[10]] == [9]
    assert [r.component_id for r in by[7]] == [6] and len(by[14]) == 2
    assert all(by[i][0].n_shingles == 0 and by[i][0].kept for i in (3, 4, 5))
    assert neardup.near_duplicates(none).count() == 0


def test_register_estimate():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        draw = lambda n: rng.integers(0, 2**64 - 1, n, dtype=np.uint64)
        both = draw(4000)
        n = int(4000 * share)
        a = np.unique(np.concatenate([both[:n], draw((4000 - n) // 2)]))
        b = np.unique(np.concatenate([both[:n], draw((4000 - n) // 2)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = neardup.estimate((neardup.registers(a) == neardup.registers(b)).sum())
        assert abs(got - true) < 0.15


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=25))
@settings(deadline=None, max_examples=4)
def test_components(spark, links):
    label = {n: n for pair in links for n in pair if pair[0] != pair[1]}
    for _ in range(40):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    out = tables.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in out.collect()} == label


# ---- vectors


def test_op2_recall_and_scores(spark, data):
    path = data.replace("sf0.001", "sf0.01")
    rows = table(spark, path, "embeddings").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows])
    got = collections.defaultdict(list)
    for r in QUERIES["op2_nearest_vectors"](spark, path).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    found = []
    for q, hits in got.items():
        score = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -score))].tolist() if i != q][:20]
        found.append(len(set(best) & {h.vec_id for h in hits}) / 20)
        assert [h.rank for h in hits] == list(range(1, 21))
        assert all(math.isclose(h.score, score[ids == h.vec_id][0], abs_tol=1e-12) for h in hits)
        assert hits == sorted(hits, key=lambda h: (-h.score, h.vec_id))
    assert np.mean(found) >= 0.9


def test_vectors_with_ties_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [nan, 1.0, 0.0, 0.0]), (104, [inf, 1.0, 0.0, 0.0]),
           (105, [1.0, 2.0]), (None, [1.0, 0.0, 0.0, 0.0]), (106, [])]
    rng = np.random.default_rng(2)
    same = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]  # a group of equal vectors
    rest = [(i, rng.normal(size=4).tolist()) for i in range(60, 100)]
    vectors = spark.createDataFrame(same + rest + odd + same[:1], "vec_id long, embedding array<double>")
    out = collections.defaultdict(list)
    for r in ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=5, probe=1.0).orderBy("rank").collect():
        out[r.query_id].append(r.vec_id)
    x = {i: np.array(v) for i, v in same + rest}
    assert set(out) == {0, 20, 40, 60, 80}
    for q, hits in out.items():
        order = sorted((i for i in x if i != q), key=lambda i: (-(x[i] * x[q]).sum(), i))
        assert hits == order[:5]
    few = ann.nearest(vectors.filter("vec_id in (60, 61, 62)"), vectors.filter("vec_id = 60"), k=5, n_lists=3, probe=0.01)
    assert {r.vec_id for r in few.collect()} == {61, 62}
    assert ann.nearest(vectors.limit(0), vectors, k=5).count() == 0
    assert ann.nearest(vectors, vectors.limit(0), k=5).count() == 0


def test_lists_are_dealt_into_tasks(monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATE_ROWS", 10)
    first, split = ann.tasks_of_lists(np.array([4, 4, 4, 35, 0, 3]))
    assert split.tolist() == [1, 1, 1, 4, 1, 1]
    assert first[0] == first[1] != first[2] and first[3] > first[2] and first[5] >= first[3] + 4


# ---- token files


@given(st.lists(st.integers(0, 300), max_size=400), st.integers(1, 7))
@settings(deadline=None, max_examples=25)
def test_file_round_trip(ids, pieces):
    ids = np.array(ids, np.int64)
    lengths = np.bincount(np.arange(len(ids)) % pieces, minlength=pieces)
    names, got, back = tokenfile.from_bytes(tokenfile.to_bytes(np.arange(pieces), lengths, ids, 301))
    assert names.tolist() == list(range(pieces)) and got.tolist() == lengths.tolist() and back.tolist() == ids.tolist()


def test_damage_is_noticed_and_repeats_compress():
    ids = np.tile(np.arange(50), 300)
    data = tokenfile.to_bytes(np.array([1]), np.array([len(ids)]), ids, 50_257)
    assert len(data) < len(ids) // 2
    broken = bytearray(data)
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        tokenfile.from_bytes(bytes(broken))
    with pytest.raises(ValueError):
        tokenfile.from_bytes(b"something else")
    with pytest.raises(ValueError):
        tokenfile.to_bytes(np.array([1]), np.array([1]), np.array([70_000]), 50_257)


@pytest.mark.parametrize("n_ids", [1, 2, 17, 300, 65_536])
def test_blocks_of_any_length_and_vocabulary(n_ids):
    rng = np.random.default_rng(n_ids)
    blocks = [rng.integers(0, n_ids, k) for k in (1, 2, 777)]
    blocks += [np.minimum(rng.zipf(1.3, 1500) - 1, n_ids - 1), np.arange(900) % n_ids, np.full(50, n_ids - 1)]
    codes = tokenfile.encode_blocks(blocks, n_ids)
    back = tokenfile.decode_blocks(codes, np.array([len(b) for b in blocks]), n_ids)
    assert [b.tolist() for b in back] == [b.tolist() for b in blocks]


def test_blocks_of_texts_take_fewer_bits_than_deflate_and_order_0(spark, data):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in table(spark, data, "documents").orderBy("doc_id").limit(200).collect() if r.text]
    ids = np.concatenate([np.array(e.ids, np.int64) for e in library.encode_batch(texts, add_special_tokens=False)])
    blocks = [ids[i : i + tokenfile.BLOCK] for i in range(0, len(ids), tokenfile.BLOCK)]
    code = sum(map(len, tokenfile.encode_blocks(blocks, 50_257)))
    assert code < 0.9 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)
    bits = 0.0
    for block in blocks:
        count = collections.Counter()
        for i, own in enumerate(block.tolist()):
            bits -= math.log2((1 + tokenfile._STEP * count[own]) / (50_257 + tokenfile._STEP * i))
            count[own] += 1
    assert code < bits / 8


def test_a_lane_holds_tables_of_its_block_not_of_the_vocabulary():
    def held(length):
        mixer = tokenfile._Mixer(np.full(64, length))
        return sum(v.nbytes for v in vars(mixer).values() if isinstance(v, np.ndarray)) / 64

    assert held(4096) < 64 << 10 and held(tokenfile.BLOCK) < 160 << 10  # 340 KB a lane with counts of 65,536 ids


def test_small_files_have_short_blocks_and_runs_are_equal(monkeypatch):
    runs = []
    plain = tokenfile.encode_blocks
    monkeypatch.setattr(tokenfile, "encode_blocks", lambda b, n: runs.append([*map(len, b)]) or plain(b, n))
    monkeypatch.setattr(tokenfile, "LANES", 20)
    ids = np.minimum(np.random.default_rng(3).zipf(1.3, 100_000) - 1, 50_256)
    data = tokenfile.to_bytes(np.array([1]), np.array([len(ids)]), ids, 50_257)
    assert [*map(len, runs)] == [12, 13] and runs[0][0] == tokenfile.LEAST
    assert tokenfile.from_bytes(data)[2].tolist() == ids.tolist()


def test_numbers_in_a_block_head():
    rng = np.random.default_rng(1)
    for values in (np.array([1]), np.array([65_536, 1, 2]), rng.integers(1, 5, 3000), rng.integers(1, 60_000, 500)):
        data = b"xy" + tokenfile._packed(values) + b"z"
        back, at = tokenfile._unpacked(data, 2)
        assert back.tolist() == values.tolist() and at == len(data) - 1


def test_every_damaged_byte_is_noticed():
    ids = np.random.default_rng(2).integers(0, 300, 200)
    data = tokenfile.to_bytes(np.array([7]), np.array([200]), ids, 301)
    head = len(data) - len(tokenfile.encode_blocks([ids], 301)[0])
    for at in range(head, len(data) - 4):
        broken = bytearray(data)
        broken[at] ^= 0x10
        try:
            assert tokenfile.from_bytes(bytes(broken))[2].tolist() == ids.tolist()  # a bit that no id needs
        except ValueError:
            pass


def plain_ids(text):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*own.encode(text or "", add_special_tokens=False).ids, 2]


def check_token_rows(rows, texts):
    start = 0
    for r, text in zip(rows, texts, strict=True):
        ids = plain_ids(text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_op3_equals_the_library(spark, data, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_IDS", 20_000)
    docs = table(spark, data, "documents").filter("length(text) < 2000").orderBy("doc_id").limit(60)
    files = tokenfile.write_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    check_token_rows(tokenfile.read_files(files).orderBy("doc_id").collect(), [r.text for r in docs.collect()])


def test_token_files_over_odd_rows(odd, none):
    docs = odd.filter("doc_id is null or doc_id not in (9, 10)")
    files = tokenfile.write_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    rows = tokenfile.read_files(files).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 14, 14, 15]
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_token_rows(rows, [texts[r.doc_id] for r in rows])
    assert tokenfile.read_files(tokenfile.write_files(none, public_tokenizers.path("byte_bpe_50k.json"), 2)).count() == 0


# ---- shards


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (3, 3), (4, 2)])
def test_curve_visits_neighbours(n, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
    index = hilbert.hilbert_index(list(points.T), bits)
    assert sorted(index.tolist()) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def check_shards(rows, texts, shards):
    size = lambda t: len((t or "").encode()) + 1
    slots, sizes, where = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    group = collections.Counter()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r["size"], r.text_crc32) == (size(text), zlib.crc32(text.encode()))
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        where[text].add(r.shard)
        group[text] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    fair = sum(sizes.values()) / shards
    assert all(abs(sizes[s] - fair) <= max(group.values()) for s in range(shards))


def test_op7_law(spark, data):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    rows = QUERIES["op7_hilbert_shards"](spark, data).collect()
    assert len(rows) == len(texts)
    check_shards(rows, texts, 8)


def test_shards_over_odd_rows(spark, odd, none, tmp_path):
    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = hilbert.assign(docs, 3).collect()
    check_shards(rows, {r.doc_id: r.text for r in docs.collect()}, 3)
    assert len(hilbert.assign(odd, 3).collect()) == odd.count()
    assert hilbert.assign(none, 8).count() == 0
    assert hilbert.assign(docs.drop("lang", "source"), 2).count() == docs.count()
    hilbert.write(docs, hilbert.assign(docs, 3), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()


# ---- scores


def test_windows_score_every_position_once():
    for lengths in ([1], [32, 33], [5, 100, 31, 57], [0, 3]):
        lengths = np.array(lengths)
        at, mark = attention.windows(lengths)
        seen = np.bincount(at[mark], minlength=lengths.sum())
        assert (seen == 1).all() and len(seen) == lengths.sum()


def small_model(n_ids=40):
    rng = np.random.default_rng(0)
    class_of = rng.integers(0, attention.SINGLE + attention.CLUSTERS, n_ids)
    pairs = rng.integers(0, 5, (attention.SINGLE + attention.CLUSTERS, n_ids)).astype(np.float32)
    return attention.start(n_ids, class_of, attention.within_class(pairs, class_of))


def test_gradients_match_differences():
    model = small_model()
    for name in attention._PARTS:
        setattr(model, name, getattr(model, name).astype(np.float64))
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40, (2, attention.WINDOW))
    wanted = rng.integers(0, 60, ids.shape)
    mark = rng.random(ids.shape) < 0.7
    _, g = attention.gradients(model, ids, wanted, mark)
    for name in ("wq", "wk", "wv", "wo", "head", "bias", "place"):
        value = getattr(model, name)
        at = tuple(rng.integers(0, s) for s in value.shape)
        old, step = value[at], 1e-5
        value[at] = old + step
        up, _ = attention.gradients(model, ids, wanted, mark)
        value[at] = old - step
        down, _ = attention.gradients(model, ids, wanted, mark)
        value[at] = old
        assert math.isclose((up - down) / (2 * step), g[name][at], rel_tol=2e-2, abs_tol=1e-6)


def test_next_ids_share_the_probability_one_and_see_no_future():
    model = small_model()
    used = np.unique(model.class_of)
    inputs = np.array([3, 7, 7, 9, 2])
    total = 0.0
    for target in range(40):
        total += math.exp(model.log_probability(inputs, np.array([1, 1, 1, 1, target]), np.array([5]))[4])
    h = model.hidden(np.pad(inputs, (0, attention.WINDOW - 5))[None])[-1][0, 4] @ model.head + model.bias
    p = np.exp(h - h.max())
    assert math.isclose(total, p[used].sum() / p.sum(), rel_tol=1e-4)
    one = model.log_probability(inputs, np.ones(5, int), np.array([5]))
    other = model.log_probability(np.array([3, 7, 7, 1, 1]), np.ones(5, int), np.array([5]))
    assert np.allclose(one[:3], other[:3])


def test_training_lowers_the_loss():
    model = small_model()
    inputs = np.tile([1, 2, 3, 4], 200)
    targets = np.roll(inputs, -1)
    before = model.log_probability(inputs, targets, np.array([800])).mean()
    attention.train(model, inputs, targets, np.array([800]), 60)
    assert model.log_probability(inputs, targets, np.array([800])).mean() > before + 0.5


def scored(docs, learn, monkeypatch, frequent):
    monkeypatch.setattr(lmscore, "FREQUENT", frequent)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return lmscore.score(docs, learn, ranks, public_tokenizers.PATTERN, steps=20).collect()


def check_base(rows, texts, learned):
    words = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in texts.items()}
    count = collections.Counter(w for i in words if learned(i) for w in words[i])
    n, v = sum(count.values()), len(count)
    for r in rows:
        own = words[r.doc_id]
        want = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, want, rel_tol=1e-9, abs_tol=1e-9) and r.score <= 0


@pytest.mark.parametrize("frequent", [1_000_000, 50])
def test_base_scores_with_and_without_shuffled_words(spark, data, monkeypatch, frequent):
    docs = table(spark, data, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    rows = scored(docs, learn, monkeypatch, frequent)
    assert len(rows) == len(texts)
    check_base(rows, texts, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)


def test_scores_over_odd_rows(odd, none, monkeypatch):
    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_base(scored(docs, F.col("doc_id") < 8, monkeypatch, 3), texts, lambda i: i < 8)
    check_base(scored(docs, F.lit(False), monkeypatch, 3), texts, lambda i: False)
    assert scored(none, F.lit(True), monkeypatch, 3) == []
    assert len(scored(odd, F.lit(None).cast("boolean"), monkeypatch, 3)) == odd.count()


def trained_on(rows, monkeypatch, steps=1, at_once=64):
    """Ids of the distinct texts, classes, and ids whose vectors the training has moved."""
    monkeypatch.setattr(lmscore, "TASK_WINDOWS", at_once)
    own = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = tables.written(lmscore._distinct(rows, "text", *own), "ids")
    class_of = lmscore._classes(texts, *own)
    pairs = tables.written(lmscore._counts(rows, "text", *own, class_of), "counts").filter("kind = 1")
    model = lmscore._fitted(pairs.select("key", "n"), class_of)
    before = model.embed.copy()
    model = lmscore._trained(texts, model, steps)
    ids = [r.ids for r in texts.collect()]
    return ids, class_of, set(np.flatnonzero((model.embed != before).any(axis=1)).tolist())


def test_attention_learns_from_every_text(spark, monkeypatch):
    rng = np.random.default_rng(3)
    letters = rng.integers(97, 123, (1_700, 40)).astype(np.uint8)
    rows = [(" ".join(bytes(w).decode() for w in t.reshape(8, 5)),) for t in letters]
    ids, class_of, moved = trained_on(spark.createDataFrame(rows, "text string").repartition(5), monkeypatch)
    inputs = {i for t in ids for i in t}
    assert len(ids) == 1_700 and moved == inputs
    often = collections.Counter(i for t in ids for i in t)
    single = {i for i, _ in often.most_common(attention.SINGLE)}
    rest = [class_of[i] for i, n in often.items() if n >= 4 and i not in single]
    assert len(set(rest)) > attention.CLUSTERS // 2


class CountedSpelling:
    """The encoding, counting how often each word is spelled."""

    def __init__(self, encoding):
        self.encoding, self.times = encoding, collections.Counter()

    def encode_ordinary(self, word):
        self.times[word] += 1
        return self.encoding.encode_ordinary(word)


def test_spellings_kept_are_bounded_and_right(monkeypatch):
    monkeypatch.setattr(lmscore, "MEMO_WORDS", 300)
    speller = lmscore.Speller(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    plain = speller.encoding
    speller.encoding = CountedSpelling(plain)
    for number in range(30):
        size = 2_000 if number == 20 else 100
        words = [*[f"common{i}" for i in range(20)], *[f"w{number}x{i}é" for i in range(size)], "common3"]
        data = " ".join(words).encode()
        *_, targets, lengths = lmscore._sequences(speller, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        want = [i for w in words for i in plain.encode_ordinary(" " + w)] + [speller.end]
        assert targets.tolist() == want and lengths.tolist() == [len(want)]
        held = {name: value for name, value in vars(speller).items() if name != "encoding"}
        assert len(pickle.dumps(held)) < 2 * 300 * (3 * 8 + 12 * 4) + 2_000
    assert all(speller.encoding.times[f" common{i}"] <= 2 for i in range(20))


def test_shares_within_classes_stay_out_of_the_driver(spark):
    n_ids, n_classes = 3_000, attention.SINGLE + attention.CLUSTERS
    rng = np.random.default_rng(4)
    class_of, keys = rng.integers(0, n_classes, n_ids), rng.choice(n_classes * n_ids, 5_000, replace=False)
    counts = rng.integers(1, 9, 5_000)
    pairs = spark.createDataFrame(list(zip(keys.tolist(), counts.tolist(), strict=True)), "key long, n long")
    model = lmscore._fitted(pairs, class_of)
    assert len(pickle.dumps(model)) < n_ids * 200
    table = np.zeros(n_classes * n_ids, np.float32)
    table[keys] = counts
    want = attention.within_class(table.reshape(n_classes, n_ids), class_of)
    assert np.array_equal(lmscore._complete(model).within, want)


# ---- chat


@given(st.lists(st.tuples(st.text(max_size=8), st.text(max_size=30)), max_size=5), st.lists(st.sampled_from(chat.CONTROL), max_size=3))
@settings(deadline=None, max_examples=120)
def test_template_is_reversible(turns, extra):
    turns = [(r, "".join([t, *extra, "\\", t])) for r, t in turns] + [(c, c + "\\u003c") for c in extra]
    formatted = "".join(chat.render(r, t)[0] for r, t in turns)
    assert chat.parse(formatted) == turns
    for _, text in turns:
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_events_fold_into_messages(spark, monkeypatch):
    log = [
        (1, 0, 0, "start", "user", None), (1, 0, 1, "delta", None, "Hel"), (1, 0, 2, "delta", None, "lo"),
        (1, 1, 3, "start", "assistant", None), (1, 1, 4, "delta", None, "bad"), (1, 1, 5, "regenerate", None, None),
        (1, 1, 6, "delta", None, "good"), (1, 0, 7, "edit", None, "Hi"), (1, 2, 8, "start", "user", None),
        (1, 2, 9, "delete", None, None), (1, 3, 10, None, None, "x"), (1, 3, 11, "start", None, None),
        (2, 0, 0, "start", "user", None), (2, 0, 1, "delete", None, None), (None, 0, 0, "delta", None, "y"),
    ]
    events = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    for chars in (1 << 20, 1):
        monkeypatch.setattr(chat, "SEGMENT_CHARS", chars)
        formatted = chat.format_log(events.orderBy(F.rand(3)))
        turns = collections.defaultdict(list)
        for r in formatted.orderBy("conv_id", "segment").collect():
            turns[r.conv_id] += chat.parse(r.formatted)
            assert [r.formatted[s.start : s.end] for s in r.loss] == [t for role, t in chat.parse(r.formatted) if role == "assistant"]
        assert turns == {1: [("user", "Hi"), ("assistant", "good"), ("", "")], None: [("", "y")]}
    digest = {r.conv_id: r for r in chat.read_back(formatted).collect()}[1]
    assert digest.n_turns == 3 and digest.loss_chars == 4
    assert digest.turns_sha256 == hashlib.sha256(b"user\nHi\nassistant\ngood\n\n\n").hexdigest()
    assert chat.format_log(events.limit(0)).count() == 0 and chat.read_back(formatted.limit(0)).count() == 0


def test_repeated_and_odd_conversation_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (1, None, None, "first"), (None, 0, "user", "a" * 3000)]
    out = chat.read_back(chat.format_log(chat.rows_to_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    got = {r.conv_id: r for r in out.collect()}
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(b"\nfirst\nuser\n\nassistant\n\nassistant\n\n").hexdigest()
    assert got[None].n_turns == 1 and got[None].formatted_chars > 3000


def test_op9_equals_sql(spark, data):
    df = QUERIES["op9_chat_format"](spark, data)
    cursor = connect(data).execute(ORACLE_SQL["op9_chat_format"])
    assert as_rows(df.columns, df.collect()) == as_rows([c[0] for c in cursor.description], cursor.fetchall())


# ---- pipeline


def test_pipeline_stages(spark, data):
    docs = table(spark, data, "documents").withColumn("extra", F.lit(1)).withColumn("kept", F.lit("mine"))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = tables.written(stage(spark, docs, data), name)
        sizes.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == before.columns and docs.exceptAll(before).count() == 0
        if name == "near_duplicates":
            texts = {r.doc_id: r.text for r in before.collect()}
            _, label = brute_components(texts, 5)
            assert {r.doc_id for r in docs.collect()} == {i for i in texts if label[i] == i}
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0


def test_pipeline_over_odd_rows(spark, odd, none, data):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = tables.written(stage(spark, docs, data), "odd")
    kept = [r.doc_id for r in docs.collect()]
    assert sorted(kept, key=str) == sorted([1, 6, 9, 11, 12, None, 14, 15], key=str)
    for _, stage in corpus_pipeline.STAGES:
        none = tables.written(stage(spark, none, data), "none")
    assert none.count() == 0
