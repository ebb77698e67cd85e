"""Vector codes, repeated windows and the Merkle manifest."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from compare import connect, rows as as_rows
from pyspark.sql import functions as F

from outings.llm import merkle, pqcodes, windows
from outings.llm.queries import DOCUMENT, ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_repeated_windows", "op13_merkle_manifest"])
def test_equals_sql(spark, data, name):
    got = QUERIES[name](spark, data)
    cursor = connect(data).execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert as_rows(got.columns, got.collect()) == as_rows(names, cursor.fetchall())


# ---- vector codes


def test_nearest_entry_equals_brute_force():
    rng = np.random.default_rng(3)
    for size, width, span in ((1, 1, 3), (2, 3, 2), (16, 8, 3000), (64, 4, 2), (64, 2, 1 << 25)):
        book = pqcodes.Codebook(rng.integers(-span, span + 1, (size, width)))
        x = rng.integers(-span, span + 1, (500, width))
        far = ((x[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
        code, least = book.nearest(x)
        assert (code == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()  # argmin: the first of ties
        mask = book.candidates(x, np.full(len(x), span // 2))
        inside = (np.abs(x[:, None, :] - book.entries[None]) <= span // 2).all(axis=2)
        assert (mask == (inside.astype(np.uint64) << np.arange(size, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).all()


def plain_codes(rows, parts, entries, rounds):
    kept = [
        (i, [math.floor(4096 * v) for v in x], label) for i, x, label in rows
        if x is not None and all(v is not None and math.isfinite(v) for v in x)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, -len(r[1]), r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = lambda x: [tuple(x[p * width : (p + 1) * width]) for p in range(parts)]
    books = [[cut(x)[p] for _, x, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    near = lambda a, book: min(range(len(book)), key=lambda e: (far(a, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, x, _ in kept:
                groups.setdefault(near(cut(x)[p], book), []).append(cut(x)[p])
            for e, members in groups.items():
                book[e] = tuple(sum(v) // len(members) for v in zip(*members))
    out = []
    for i, x, label in kept:
        codes = [near(a, book) for a, book in zip(cut(x), books)]
        out.append((i, label, codes, sum(far(a, book[e]) for a, book, e in zip(cut(x), books, codes))))
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    return sorted(((*r, sums[r[1]]) for r in out), key=repr), books


VECTOR_ROWS = [
    (1, [0.5, -0.25, 0.125, 1.0], 1), (2, None, 1), (3, [0.5, None, 0.1, 0.2], 1), (4, [float("nan"), 0.0, 0.0, 0.0], 2),
    (5, [float("inf"), 0.0, 0.0, 0.0], 2), (6, [], 2), (7, [1.0, 2.0], 3), (8, [-0.0001, 0.3, -0.7, 0.2], None),
    (8, [-0.0001, 0.3, -0.7, 0.2], None), (9, [0.5, -0.25, 0.125, 1.0], 1), (None, [3.0, 3.0, 3.0, 3.0], 1),
    *[(20 + i, [math.sin(i * k) for k in (1.0, 2.0, 3.0, 5.0)], i % 3) for i in range(60)],
]


@pytest.mark.parametrize("hot_rows", [0, 15, 1_000_000])
def test_codes_of_odd_vectors(spark, hot_rows):
    frame = spark.createDataFrame(
        [(*r, "mine", 7, 3) for r in VECTOR_ROWS],
        "vec_id long, embedding array<double>, label int, code string, error int, n int",
    )
    coded, books = pqcodes.fit_encode(frame, parts=2, entries=5, rounds=3)
    out = pqcodes.with_label_error(coded, hot_rows).collect()
    want, want_books = plain_codes(VECTOR_ROWS, 2, 5, 3)
    assert [b.tolist() for b in books] == [[list(e) for e in b] for b in want_books]
    assert sorted([(r.id, r.label, r.codes, r.error, r.label_error) for r in out], key=repr) == want


def test_codes_of_few_and_no_vectors(spark):
    ddl = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(2, [1.0, 2.0], 1), (1, [0.0, 0.0], None)], ddl)
    coded, books = pqcodes.fit_encode(few, parts=2)
    assert [len(b) for b in books] == [2, 2]
    assert sorted((r.id, r.codes, r.error) for r in coded.collect()) == [(1, [0, 0], 0), (2, [1, 1], 0)]
    for rows in ([], [(1, None, 1)], [(1, [], 1)], [(1, [1.0, 2.0, 3.0], 1)]):
        coded, books = pqcodes.fit_encode(spark.createDataFrame(rows, ddl), parts=2)
        assert books == [] and pqcodes.with_label_error(coded).collect() == []


def test_a_component_out_of_range_is_an_error(spark):
    rows = spark.createDataFrame([(1, [1e30, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="vector component"):
        pqcodes.fit_encode(rows, parts=2)[0].collect()


# ---- repeated windows


def plain_windows(rows, size):
    """Result of each distinct document (id, text), by counting windows as tuples."""
    tie = {t: h for _, t, h in rows}
    order = sorted({(i is not None, i or 0, tie[t], i, t) for i, t, _ in rows}, key=lambda r: r[:3])
    seen, out = set(), {}
    for _, _, _, i, t in order:
        words = WORD.findall(t or "")
        gone = set()
        for a in range(len(words) - size + 1):
            window = tuple(words[a : a + size])
            if window in seen:
                gone.update(range(a, a + size))
            seen.add(window)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i, t or ""] = (len(words), len(gone), kept)
    return out


def check_windows(spark, docs, size):
    out = windows.drop_repeats(docs, size).collect()
    with_tie = docs.select("doc_id", "text", windows._tie(F.col("text")).alias("tie")).collect()
    want = plain_windows([(r.doc_id, r.text, r.tie) for r in with_tie], size)
    got = sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in out), key=repr)
    assert got == sorted(((r.doc_id, *want[r.doc_id, r.text or ""]) for r in with_tie), key=repr)
    for r in out:
        spans = list(zip(r.starts or [], r.stops or []))
        assert sum(b - a for a, b in spans) == r.n_removed
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))  # maximal: they never touch


@pytest.mark.parametrize("size", [1, 2, 5, 20])
def test_windows_of_odd_texts(spark, odd, size):
    check_windows(spark, odd, size)


def test_windows_of_no_texts(spark, none):
    assert windows.drop_repeats(none).collect() == []


@pytest.mark.parametrize("run", [1, 300, 1 << 22])
def test_shared_passages_in_runs_of_any_size(spark, monkeypatch, run):
    """Passages in many documents, within one and at the edges, copies, and ids out of order and repeated."""
    monkeypatch.setattr(windows, "RUN_BYTES", run)
    rng = random.Random(run)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            a = rng.randrange(25)
            words[at:at] = passage[a : a + rng.randrange(4, 30)]
        rows.append((rng.randrange(50), rng.choice([" ", "\n", "  \t"]).join(words)))
    rows += rows[:5] + [(1000 + i, "the same line again " * 4) for i in range(40)] + [(None, "p1 p2 p3 p4 p5 p6"), (None, None)]
    check_windows(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4)


# ---- Merkle manifest


def plain_hash(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return plain_hash("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_tree(leaves, arity):
    """Root, and per leaf the (before, after) hashes of each level."""
    steps = [[] for _ in leaves]
    level, place = leaves, list(range(len(leaves)))
    while len(level) > 1:
        for k, at in enumerate(place):
            first = at // arity * arity
            run = level[first : first + arity]
            steps[k].append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        level = [plain_hash(level[i : i + arity]) for i in range(0, len(level), arity)]
        place = [at // arity for at in place]
    return level[0], steps


def plain_manifest(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"], plain_leaf([r[c] for c in DOCUMENT]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        members = sorted(groups[s], key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        trees[s] = (members, *plain_tree([m[1] for m in members], arity))
    root, tops = plain_tree([trees[s][1] for s in order], arity)
    out = []
    for s, top in zip(order, tops):
        members, subroot, steps = trees[s]
        for (i, leaf, r), own in zip(members, steps):
            path = own + top
            later = dict(r, text=r["text"] and r["text"].upper())
            h = plain_leaf([later[c] for c in DOCUMENT])
            for before, after in path:
                h = plain_hash([before, h, after])
            out.append((i, leaf, subroot, root, plain_hash(b + a for b, a in path), h, h == root))
    return sorted(out, key=repr)


def check_manifest(docs, arity):
    upper = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    out = merkle.manifest(docs, DOCUMENT, "source", "doc_id", {"text": upper}, arity)
    out = out.withColumn("proof", merkle.proof_digest(F.col("steps")))
    got = [(r.id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in out.collect()]
    assert sorted(got, key=repr) == plain_manifest([r.asDict() for r in docs.collect()], arity)


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_manifest_equals_plain_trees(spark, arity):
    """One large group, small ones, a null one, an empty name, nulls in every column, repeated ids and rows."""
    rows = [(i * 7 % 101, f"t{i} Ä", "de" if i % 3 else None, "big", i) for i in range(90)]
    rows += [(i, "x", "en", "mid", None) for i in range(17)] + [(5, None, "en", "", 1), (6, "", "en", "Zo", 1)]
    rows += [(None, "no id", None, None, None), (7, "12", "fr", None, 3), (7, "12", "fr", None, 3), (8, "A", "fr", "é", 4)]
    rows = [(*r, "mine", 1, 2) for r in rows]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, leaf string, index long, n int"
    check_manifest(spark.createDataFrame(rows, ddl), arity)


def test_manifest_of_odd_texts(spark, odd):
    odd = odd.withColumn("text", F.regexp_replace("text", "[^\\x00-\\x7f]", "?"))
    check_manifest(odd, 16)


def test_manifest_of_one_row_and_none(spark, odd, none):
    one = spark.createDataFrame([(1, "A b", None, "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    row = merkle.manifest(one, DOCUMENT, "source", "doc_id", {"text": F.lower("text")}).first()
    assert row.leaf == row.subroot == row.root and row.steps == [] and not row.verified
    assert merkle.manifest(none, DOCUMENT, "source", "doc_id").collect() == []
