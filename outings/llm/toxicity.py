"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary text.

The models predict the bytes of a word from up to six bytes before them. Each class has its own
discounted counts; what a class has not seen, it takes from one backoff distribution shared by both,
which interpolates pooled counts and, in lower orders, numbers of distinct predecessors. A rare
expression therefore moves the comparison only as far as one class has evidence of its own.

A word's evidence is the difference of its log-likelihoods under both models. The evidence of a text
is the largest one of its windows of ``WINDOW`` words, normalised by the window's length, so that a
long text hides nothing. A logistic curve, fitted on labelled texts that the models have not seen,
turns it into a score.

Words are runs of letters of the lower-cased text. A text that is null or without words scores like a
text without evidence. With labels of one class or none, every score is that class's share (0 without
labels).
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings.llm.tables import least_frequent, written
from outings.llm.textbytes import keep_rows, lowered, map_text, mix, prefix_hash, span_hash, spans

ORDER = 7
#: Discounts of counts of one, two and more (modified Kneser-Ney). They are higher than those that predict best:
#: what stands in one or two texts of a class says little about the class.
DISCOUNTS = (1.0, 1.9, 2.5)
WINDOW = 2
#: Labelled texts of each class that are used, for the models and for the curve. The rest of the labels is not needed.
MODEL_TEXTS, CURVE_TEXTS = 8_000, 4_000
#: Most byte n-grams in the model (the most frequent), about 12 bytes each in every task.
MAX_GRAMS = 4_000_000

_BEGIN, _END = 1, 2
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def word_grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of the words, packed into integers with the predicted byte lowest, and where each word begins."""
    length = end - start + 2
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    source = np.repeat(start - 1, length) + place
    padded = data[np.clip(source, 0, max(0, len(data) - 1))].astype(np.uint64)
    padded[first], padded[first + length - 1] = _BEGIN, _END
    key = padded.copy()
    for back in range(1, ORDER):
        key[back:] |= np.where(place[back:] >= back, padded[:-back], 0).astype(np.uint64) << np.uint64(8 * back)
    return key[place > 0], first - np.arange(len(first))


def _words(column: pa.Array):
    """Chunks of the column: rows, and the bytes and spans of the words with the row of each."""
    for first, end, data, offsets in lowered(column):
        start, stop, row = spans(_LETTER[data], offsets)
        yield first, end, data, start, stop, row


def _distinct(data, start, stop):
    """First place of each distinct word, and which one each word is."""
    _, at, which = np.unique(_hashes(data, start, stop), return_index=True, return_inverse=True)
    return at, which


def _hashes(data, start, stop):
    sums, inv = prefix_hash(data)
    return span_hash(sums, inv, start, stop)


@dataclass
class Model:
    """Differences of log-probabilities: of seen n-grams, and of contexts for n-grams not seen after them."""

    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    gram_value: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    context_value: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    slope: float = 0.0
    offset: float = -np.inf

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Evidence of each text; 0 where there is no word."""
        out = np.zeros(len(column))
        for lo, hi, data, start, stop, row in _words(column):
            if len(start) == 0:
                continue
            at, which = _distinct(data, start, stop)
            key, begin = word_grams(data, start[at], stop[at])
            value = np.add.reduceat(self._value(key), begin)[which]
            total, size = np.cumsum(value), np.cumsum(stop - start + 1)
            best = np.full(hi - lo, -np.inf)
            for n in range(1, WINDOW + 1):  # windows that start in the row, cut at its end
                if len(row) < n:
                    break
                inside = row[n - 1 :] == row[: len(row) - n + 1]
                got = total[n - 1 :] - np.concatenate(([0], total[: len(total) - n]))
                letters = size[n - 1 :] - np.concatenate(([0], size[: len(size) - n]))
                np.maximum.at(best, row[n - 1 :][inside], (got / np.sqrt(letters))[inside])
            out[lo:hi] = np.where(np.isfinite(best), best, 0)
        return out

    def _value(self, key: np.ndarray) -> np.ndarray:
        def find(table, values, wanted, other):
            if not len(table):
                return other
            at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
            return np.where(table[at] == wanted, values[at], other)

        unseen = find(self.contexts, self.context_value, key >> np.uint64(8), np.zeros(len(key)))
        return find(self.grams, self.gram_value, key, unseen)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return 1 / (1 + np.exp(-(self.slope * evidence + self.offset)))


def _begins(key: np.ndarray) -> np.ndarray:
    """Whether a new context begins at each of the sorted n-grams."""
    context = key >> np.uint64(8)
    return np.concatenate(([True], context[1:] != context[:-1]))


def _per_context(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sum over the context of each n-gram."""
    begin = _begins(key)
    return np.add.reduceat(value, np.flatnonzero(begin))[np.cumsum(begin) - 1]


def _discounted(key, count, backoff):
    off = np.choose(np.clip(count, 0, 3).astype(int), (0.0, *DISCOUNTS))
    total, taken = _per_context(key, count), _per_context(key, off)
    seen = np.maximum(total, 1e-300)
    share = np.where(total > 0, taken / seen, 1)
    return np.maximum(count - off, 0) / seen * (total > 0) + share * backoff, share


def build(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """The model from n-grams and their counts in both classes."""
    order = np.argsort(grams)
    grams, toxic, ordinary = grams[order], toxic[order].astype(float), ordinary[order].astype(float)
    if not len(grams):
        return Model()
    levels = [(grams, toxic + ordinary, None)]
    for size in range(ORDER - 1, 0, -1):  # lower orders count distinct predecessors
        mask = np.uint64((1 << (8 * size)) - 1)
        key, up, count = np.unique(levels[-1][0] & mask, return_inverse=True, return_counts=True)
        levels.append((key, count.astype(float), up))
    shared = np.full(len(levels[-1][0]), 1 / 257)
    for depth in range(len(levels) - 1, -1, -1):
        key, count, up = levels[depth]
        shared, _ = _discounted(key, count, shared)
        shared = shared[up] if up is not None else shared
    p_toxic, rest_toxic = _discounted(grams, toxic, shared)
    p_ordinary, rest_ordinary = _discounted(grams, ordinary, shared)
    begin = np.flatnonzero(_begins(grams))
    return Model(
        grams,
        (np.log(p_toxic) - np.log(p_ordinary)).astype(np.float32),
        (grams >> np.uint64(8))[begin],
        (np.log(rest_toxic) - np.log(rest_ordinary))[begin].astype(np.float32),
    )


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, lightly regularised."""
    centre, scale = x.mean(), x.std() or 1.0
    a = np.stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ a, -35, 35)))
        gradient = a @ (weight * (p - y)) + 1e-3 * w
        step = np.linalg.solve((a * (weight * p * (1 - p))) @ a.T + 1e-3 * np.eye(2), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(0.0, w[0] / scale)
    return slope, w[1] - slope * centre


def _builder(batches):
    columns = [[], [], []]
    for batch in batches:
        for held, name in zip(columns, ("gram", "toxic", "ordinary"), strict=True):
            held.append(batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False))
    if columns[0]:
        grams, toxic, ordinary = map(np.concatenate, columns)
        model = build(grams.view(np.uint64), toxic, ordinary)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def gram_counts(docs: DataFrame, text: str, label: str) -> DataFrame:
    """Counts of each n-gram in toxic and ordinary texts: ``gram``, ``toxic``, ``ordinary``.

    Tasks add up chunk by chunk before anything is shuffled.
    """

    def run(batches):
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for first, _, data, start, stop, row in _words(batch.column(0)):
                if not len(start):
                    continue
                _, at = np.unique(_hashes(data, start, stop) + mix(row.astype(np.uint64)), return_index=True)
                start, stop, row = start[at], stop[at], row[at]  # a word counts once in a text
                key, begin = word_grams(data, start, stop)
                toxic = np.repeat(labels[first + row] == 1, np.diff(np.append(begin, len(key))))
                gram, which = np.unique(key, return_inverse=True)
                ones = np.bincount(which, toxic, len(gram)).astype(np.int64)
                zeros = np.bincount(which, minlength=len(gram)) - ones
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(ones), pa.array(zeros)], ["gram", "toxic", "ordinary"]
                )

    parts = docs.select(text, F.col(label).cast("int")).mapInArrow(run, "gram long, toxic long, ordinary long")
    return parts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows that depend on the ids alone."""
    return rows.orderBy("order", "id").limit(n)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Model from labelled texts. ``labels``: id and label (1 toxic, 0 ordinary; the larger of several).

    At most ``MODEL_TEXTS`` texts of each class and ``CURVE_TEXTS`` others of each are read, chosen by a hash of
    the id. In the curve each class has the weight of its share of the labels.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull())
        .groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("label"))
        .withColumn("order", F.xxhash64("id", F.lit(17)))
        .withColumn("curve", F.pmod(F.xxhash64("id", F.lit(29)), F.lit(4)) == 0)
    )
    shares = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        share = shares.get(1, 0) / max(1, total)
        return Model(offset=np.inf if share else -np.inf)
    parts = [
        _smallest(known.filter((F.col("curve") == curve) & (F.col("label") == value)), most)
        for curve, most in ((True, CURVE_TEXTS), (False, MODEL_TEXTS))
        for value in (0, 1)
    ]
    sample = reduce(DataFrame.unionAll, parts).select("id", "label", "curve")
    picked = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")
    counts = gram_counts(picked.filter(~F.col("curve")), "text", "label")
    counts = written(counts, "grams")
    both = F.col("toxic") + F.col("ordinary")
    counts = counts.filter(both >= least_frequent(counts.select(both.alias("n")), MAX_GRAMS))
    made = counts.repartition(1).mapInArrow(_builder, "model binary").first()  # at most MAX_GRAMS rows
    model = pickle.loads(made.model) if made else Model()
    unseen = map_text(
        picked.filter("curve"), "text", T.StructType().add("evidence", "double"),
        lambda column: [pa.array(model.evidence(column))], ["label"],
    ).toPandas()
    y = unseen["label"].to_numpy(float)
    if len(set(y)) < 2:
        model.offset = float(np.log(shares[1] / shares[0]))
        return model
    share = shares[1] / total
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.slope, model.offset = _curve(unseen["evidence"].to_numpy(), y, weight)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score``, the chance that the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType().add("score", "double", False)
    return map_text(
        docs, text, schema, lambda column: [pa.array(shared.value.score(shared.value.evidence(column)))], keep
    )


def keep_ordinary(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(
        docs, text, lambda column: shared.value.score(shared.value.evidence(column)) < threshold
    )
