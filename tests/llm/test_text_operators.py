"""Language ID, toxicity, decontamination, byte-level BPE and the byte helpers."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from outings.llm import bpe, decontaminate, langid, textbytes, toxicity
from outings.llm.queries import QUERIES


def reference_encoding(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---- byte helpers


@given(st.lists(st.text(alphabet="ab \né", max_size=12), min_size=1, max_size=6))
@settings(deadline=None, max_examples=60)
def test_words_equal_plain_splitting(texts):
    want, seen = [], {}
    for row, text in enumerate(texts):
        for word in text.split():
            want.append((row, word))
    got = []
    for first, _, data, offsets in textbytes.chunks(pa.array(texts), 8):
        h, row = textbytes.words(data, offsets)
        got += [(first + r, x) for r, x in zip(row.tolist(), h.tolist(), strict=True)]
    assert [r for r, _ in got] == [r for r, _ in want]
    for (_, word), (_, h) in zip(want, got, strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sliced_and_null_columns():
    column = pa.array(["aa b", None, "", "c"]).slice(1)
    data, offsets = textbytes.text_buffer(column)
    assert bytes(data) == b"c" and offsets.tolist() == [0, 0, 0, 1]


# ---- byte-level BPE


@given(st.text(max_size=80))
@settings(deadline=None, max_examples=150)
def test_bpe_equals_the_library(text):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    own = bpe.ByteBpe.load(path, pattern)
    (ids,) = own.encode([text])
    assert ids == reference_cached(path).encode_ordinary(text)
    assert own.decode(ids) == text.encode()


_cached = {}


def reference_cached(path):
    return _cached.setdefault(path, reference_encoding(path))


def test_perfect_hash_is_minimal_and_knows_strangers(bpe_file):
    own = bpe.ByteBpe.load(*bpe_file)
    assert sorted(own.whole.find(own.entries).tolist()) == list(range(len(own.entries)))
    known = set(own.entries)
    strange = [s for s in (bytes([random.Random(i).randrange(256) for _ in range(5)]) for i in range(2000)) if s not in known]
    assert (own.whole.find(strange) == -1).all()
    assert bpe.PerfectHash([]).find([b"x"]).tolist() == [-1]


def test_bpe_long_run_without_spaces(bpe_file):
    own = bpe.ByteBpe.load(*bpe_file)
    text = "abcabd" * 4000
    assert own.encode([text])[0] == reference_cached(bpe_file[0]).encode_ordinary(text)


def test_bpe_with_small_tables_of_remembered_pieces(bpe_file, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 5)
    own = bpe.ByteBpe(bpe.ByteBpe.load(*bpe_file).ranks, bpe_file[1])
    library = reference_cached(bpe_file[0])
    for i in range(40):
        text = " usual qxzvw" + "".join(f" q{i}x{j}zw" for j in range(i % 7))
        assert own.encode([text])[0] == library.encode_ordinary(text)
        assert len(own.young) <= 5 and len(own.old) <= 5
    assert " qxzvw" in own.young or " qxzvw" in own.old


def test_bpe_over_odd_rows(odd, none, bpe_file):
    rows = bpe.round_trip(odd, *bpe_file).collect()
    library = reference_cached(bpe_file[0])
    assert len(rows) == odd.count() and set(rows[0].asDict()) == {*odd.columns, "ids_sha256", "decoded_sha256"}
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.lang_pred == "mine"
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.round_trip(none, *bpe_file).count() == 0
    coded = bpe.decode(bpe.encode(odd, *bpe_file), *bpe_file).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in coded)


def test_op10_equals_the_library(spark, data, bpe_file):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    library = reference_cached(bpe_file[0])
    rows = QUERIES["op10_byte_bpe"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


# ---- language ID


def plain_vector(text, dimensions):
    """The same bundle, letter by letter."""
    out = np.zeros(dimensions)
    text = "".join(c if c.isalpha() else " " for c in text.lower())
    for word in text.split():
        padded = f" {word} "
        for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
            x, y, z = (langid.letter_vector(ord(s), dimensions).astype(float) for s in (a, b, c))
            out += np.roll(x, 2) * np.roll(y, 1) * z
    return out


def test_bundle_equals_letter_by_letter(monkeypatch):
    texts = ["Hello, wide World!", None, "", "a", "été 123 français", "the the the"]
    for grams, limit in ((2048, 1 << 19), (3, 7)):
        monkeypatch.setattr(langid, "GRAMS", grams)
        monkeypatch.setattr(langid, "CHARS", limit if grams == 3 else 1 << 19)
        if grams == 3:
            texts = ["Hello wide", None, "the the the", "ab cd ef gh ij"]
        vectors, count = langid.bundle(texts, 256)
        for v, n, t in zip(vectors, count, texts, strict=True):
            assert np.allclose(v, plain_vector(t or "", 256)) and (n > 0) == any(c.isalpha() for c in t or "")


def test_language_over_odd_rows(odd, none):
    profiles = langid.fit(odd, "lang", dimensions=512)
    rows = langid.predict(odd, profiles).collect()
    assert len(rows) == odd.count() and set(rows[0].asDict()) == set(odd.columns)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred == ("en" if letters else "und") and 0 <= r.score <= 1
    kept = langid.keep_identified(odd, profiles)
    assert kept.columns == odd.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)
    assert langid.fit(none, "lang") == {} and langid.predict(none, profiles).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}
    assert langid.fit(odd.selectExpr("text", "cast(null as string) as lang"), "lang") == {}


def test_op1_held_out_accuracy(spark, data):
    path = data.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = QUERIES["op1_language_id"](spark, path).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(right) > 0.97


def test_language_stage_rejects_unlike_texts(spark, data):
    from corpus_pipeline import identify_language

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(6)
    noise = [(-i, " ".join("".join(rng.choices("qxzjvkwy", k=6)) for _ in range(60)), None) for i in range(1, 21)]
    foreign = [(-100, "съешь же ещё этих мягких французских булок да выпей чаю " * 4, None)]
    kept = {r.doc_id for r in identify_language(spark, docs.unionAll(spark.createDataFrame(noise + foreign, docs.schema)), data).collect()}
    assert not any(i < 0 for i in kept)
    assert len(kept) >= 0.99 * docs.count()


# ---- toxicity


def tox_rows(n=400):
    rng = random.Random(3)
    syllables = ["ba", "ko", "li", "ra", "mi", "tu", "se", "no"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        toxic = int(i % 4 == 0)
        if toxic:
            words.insert(rng.randrange(len(words)), "grumz" + "".join(rng.choices(syllables, k=rng.randint(0, 2))))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_learns_stems_and_keeps_clean_texts(spark):
    rows = tox_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.filter("doc_id < 300").select("doc_id", "toxic"))
    scored = {r.doc_id: r for r in toxicity.predict(docs, model).filter("doc_id >= 300").collect()}
    wrong = [r for r in scored.values() if (r.score >= 0.5) != bool(r.toxic)]
    assert len(wrong) <= 3
    assert toxicity.keep_ordinary(docs, model).columns == docs.columns


def test_curve_sees_a_rare_class(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CURVE_TEXTS", 8)
    rng = random.Random(4)
    words = ["garden", "window", "river", "market", "letter", "summer"]
    rows = [(i, " ".join(rng.choices(words, k=12) + ["vilescum"] * (i % 50 == 0)), int(i % 50 == 0)) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    assert model.slope > 0
    scored = toxicity.predict(docs, model).collect()
    assert min(r.score for r in scored if r.toxic) > 0.5 > max(r.score for r in scored if not r.toxic)


def test_toxicity_over_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (9, None), (None, 1), (6, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    one_class = toxicity.fit(odd, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.predict(odd, one_class).collect()} == {0.0}
    assert {r.score for r in toxicity.predict(odd, toxicity.fit(none, labels.limit(0))).collect()} == {0.0}
    assert toxicity.predict(none, model).count() == 0


def test_probabilities_add_up():
    """With one class's counts only, a context's next bytes share the probability one (up to the unseen rest)."""
    words = b"banana band ban"
    data = np.frombuffer(words, np.uint8)
    start, stop, _ = textbytes.spans(toxicity._LETTER[data], np.array([0, len(data)]))
    key, begin = toxicity.word_grams(data, start, stop)
    assert begin.tolist() == [0, 7, 12] and len(key) == 7 + 5 + 4
    grams, count = np.unique(key, return_counts=True)
    same = toxicity.build(grams, count, count)
    assert np.allclose(same.gram_value, 0) and np.allclose(same.context_value, 0)


def test_op5_held_out(spark, data):
    path = data.replace("sf0.001", "sf0.1")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op5_toxicity"](spark, path).collect() if r.held_out and r.doc_id in toxic]
    hits = [r.predicted for r in rows if toxic[r.doc_id] == 1]
    false = [r.predicted for r in rows if toxic[r.doc_id] == 0]
    assert np.mean(hits) > 0.75 and np.mean(false) < 0.02


# ---- decontamination


def plain_distance(item, text):
    """Least edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(25))
def test_passages_equal_full_alignment(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcd", k=rng.randint(2, 6)))
    items = [" ".join(word() for _ in range(rng.randint(12, 30))) for _ in range(4)]
    index = decontaminate.Index.build(list(range(4)), items, 6, 0.1)
    texts = []
    for _ in range(6):
        chars = list(rng.choice(items))
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(chars))
            kind = rng.random()
            if kind < 0.4:
                chars[at] = rng.choice("abcd")
            elif kind < 0.7:
                del chars[at]
            else:
                chars.insert(at, rng.choice("abcd"))
        texts.append(" ".join([word() for _ in range(5)] + ["".join(chars)] + [word() for _ in range(5)]))
    got = {}
    for first, _, data, offsets in textbytes.lowered(pa.array(texts)):
        for row, item, edits, start, end in index.search(data, offsets):
            got[first + row, item] = edits
            assert 0 <= start < end <= len(texts[first + row])
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            best = plain_distance(item, " ".join(text.split()))
            if best <= index.budget[i]:
                assert got[t, i] == best
            else:
                assert (t, i) not in got


def test_passages_over_odd_rows(spark, odd, none):
    bench = spark.createDataFrame(
        [(1, "THE cat sat, on the MAT and looked at the dog"), (2, None), (3, ""), (4, "word"), (5, "!!"), (6, "nowhere to be found in it")],
        "item_id long, text string",
    )
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_passages(odd, bench).collect()}
    assert found == {(1, 1), (2, 1), (6, 4), (7, 4)}
    kept = decontaminate.keep_clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert decontaminate.find_passages(none, bench).count() == 0
    assert decontaminate.keep_clean(odd, bench.limit(0)).count() == odd.count()


def test_passes_find_the_same(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(i, f"looked at the dog {i}" if i else "sat on the mat and looked") for i in range(5)], "item_id long, text string")
    one = {tuple(r) for r in decontaminate.find_passages(odd, bench).collect()}
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 20)
    assert {tuple(r) for r in decontaminate.find_passages(odd, bench).collect()} == one and one


def test_op6_finds_all_verbatim_items(spark, data):
    items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    texts = spark.read.parquet(f"{data}/documents.parquet").collect()
    verbatim = {(d.doc_id, i.item_id) for d in texts for i in items if i.text and i.text in (d.text or "")}
    assert verbatim <= {(r.doc_id, r.item_id) for r in QUERIES["op6_decontaminate"](spark, data).collect()}
