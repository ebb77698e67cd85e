"""Language-model scores of whole texts, next to a word-count baseline.

Texts are sequences of words (runs of bytes other than space and the control characters 9 to 13, A-Z
lower-cased) and one end. The baseline adds up add-one log-probabilities of words, learned from the training
texts. The model spells each word, with one space before it, in subword ids and predicts ids and the end
with causal self-attention (``attention``): windows of ids overlap, and each id is scored once.

The attention weights are fitted on all windows of all distinct training texts: one task starts with about
``steps`` batches of windows (small inputs are repeated), then tasks go on with the others, each on texts
of its own, and their weights are averaged ``ROUNDS`` times. The classes of ids come from the neighbours of
each id in all distinct training texts. Words, and pairs of a class and the id after it, are counted over
all training rows. The ``FREQUENT`` most frequent
words go to every task; the counts of the others are joined by a shuffle, so no word is lost and the
vocabulary may be of any size.

Null and empty texts are one end. Repeated rows are scored each and counted each; the attention weights and
classes learn from one of equal texts, so that copies do not take the place of others.
"""

from __future__ import annotations

import base64
import math
import pickle
import posixpath
import uuid
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings.llm import attention
from outings.llm.tables import least_frequent, written
from outings.llm.textbytes import chunks, lower_ascii, map_text, prefix_hash, span_hash, spans
from outings.session import shared_dir

#: Times that the tasks' weights are averaged at most, and windows that a task trains on before it takes more.
ROUNDS, TASK_WINDOWS = 8, 1 << 15
#: Ids whose neighbours a task counts at once.
IDS = 1 << 18
#: Words whose counts every task holds, 16 bytes each.
FREQUENT = 500_000
#: Spellings kept in each of a Python worker's two tables.
MEMO_WORDS = 150_000
_END_WORD = -1
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_spellers: dict[tuple[str, str], Speller] = {}
_shares: dict[str, np.ndarray] = {}


@dataclass
class _Spelled:
    """Words' hashes in ascending order, and where their ids stand in ``pool``."""

    known: np.ndarray
    first: np.ndarray
    count: np.ndarray
    pool: np.ndarray

    @classmethod
    def of(cls, known: np.ndarray, count: np.ndarray, pool: np.ndarray) -> _Spelled:
        return cls(known, np.cumsum(count) - count, count, pool)

    @classmethod
    def none(cls) -> _Spelled:
        return cls.of(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes are known."""
        if not len(self.known):
            return np.zeros(len(hashes), bool)
        at = np.searchsorted(self.known, hashes)
        return self.known[np.minimum(at, len(self.known) - 1)] == hashes

    def only(self, hashes: np.ndarray) -> _Spelled:
        """These known words alone."""
        at = np.searchsorted(self.known, hashes)
        count = self.count[at]
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return _Spelled.of(hashes, count, self.pool[np.repeat(self.first[at], count) + inner])

    def with_those_of(self, other: _Spelled) -> _Spelled:
        """The words of both, none of which both have."""
        if not len(other.known):
            return self
        if not len(self.known):
            return other
        at = np.searchsorted(self.known, other.known)
        insert = lambda name, more: np.insert(getattr(self, name), at, more)
        return _Spelled(
            insert("known", other.known), insert("first", other.first + len(self.pool)), insert("count", other.count),
            np.concatenate([self.pool, other.pool]),
        )


class Speller:
    """Subword ids of words, remembered by the words' hashes.

    Words asked for lately stand in one table, those before in another. A full table takes the place of the older
    one, so words that keep coming stay and the others go.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.n_ids = self.end + 1
        self.late = self.early = _Spelled.none()

    def spell(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> _Spelled:
        """Ids of distinct words, sorted by hash."""
        found = self.late.among(hashes)
        missing = np.flatnonzero(~found)
        old = self.early.among(hashes[missing])
        fresh = missing[~old]
        raw = data.tobytes() if len(fresh) else b""
        words = [" " + raw[a:b].decode("utf-8", "replace") for a, b in zip(start[fresh].tolist(), end[fresh].tolist(), strict=True)]
        ids = [self.encoding.encode_ordinary(w) for w in words]
        own = _Spelled.of(hashes[fresh], np.array([len(i) for i in ids], np.int64), np.array([i for w in ids for i in w], np.int32))
        new = own.with_those_of(self.early.only(hashes[missing[old]]))
        asked = new.with_those_of(self.late.only(hashes[found]))
        if len(self.late.known) + len(new.known) > MEMO_WORDS:
            self.early, self.late = self.late, new if len(new.known) <= MEMO_WORDS else _Spelled.none()
        else:
            self.late = self.late.with_those_of(new)
        return asked

    @classmethod
    def load(cls, path: str, pattern: str) -> Speller:
        if (path, pattern) not in _spellers:
            _spellers[path, pattern] = cls(path, pattern)
        return _spellers[path, pattern]


def _sequences(speller: Speller, data: np.ndarray, offsets: np.ndarray):
    """Words of a chunk (hash of the distinct ones, which one each is, row of each), and per row the ids with the end."""
    data = lower_ascii(data)
    start, stop, row = spans(_IN_WORD[data], offsets)
    sums, inv = prefix_hash(data)
    hashes, at, which = np.unique(span_hash(sums, inv, start, stop), return_index=True, return_inverse=True)
    spelled = speller.spell(hashes, data, start[at], stop[at])
    per_word = spelled.count[which]
    lengths = np.bincount(row, per_word, len(offsets) - 1).astype(np.int64) + 1
    total = int(per_word.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(per_word) - per_word, per_word)
    targets = np.full(total + len(lengths), speller.end, np.int64)
    targets[np.arange(total) + np.repeat(row, per_word)] = spelled.pool[np.repeat(spelled.first[which], per_word) + inner]
    inputs = np.concatenate(([speller.end], targets[:-1]))
    return hashes, which, row, inputs, targets, lengths


def _distinct(docs: DataFrame, text: str, path: str, pattern: str) -> DataFrame:
    """Ids and number of windows of each distinct text, with a hash of it."""

    def make(column):
        ids, windows = [], []
        speller = Speller.load(path, pattern)
        for _, _, data, offsets in chunks(column):
            *_, targets, lengths = _sequences(speller, data, offsets)
            ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            ids.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(targets.astype(np.int32))))
            windows.append(attention.n_windows(lengths))
        return [pa.concat_arrays(ids), pa.array(np.concatenate(windows))]

    schema = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("windows", "long")
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    texts = texts.withColumn("order", F.xxhash64("text"))
    return map_text(texts, "text", schema, make, ["order"])


def _parts(batches):
    """Id lists (the first column) of the batches in runs of about ``IDS`` ids."""
    for batch in batches:
        column = batch.column(0)
        group = np.cumsum(column.value_lengths().to_numpy().astype(np.int64)) // IDS
        cuts = (np.flatnonzero(np.diff(group)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(group)], strict=True):
            if lo < hi:
                yield column.slice(lo, hi - lo)


def _laid_out(column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and lengths of id lists, end to end."""
    targets = column.flatten().to_numpy().astype(np.int64)
    lengths = column.value_lengths().to_numpy().astype(np.int64)
    inputs = np.concatenate(([end], targets[:-1]))[: len(targets)]
    inputs[np.cumsum(lengths)[:-1]] = end
    return inputs, targets, lengths


def _classes(texts: DataFrame, path: str, pattern: str) -> np.ndarray | None:
    """Class of each id, from counts over all of ``texts``; None without any text."""
    n_bins = attention.NEAR + 1

    def count(batches):
        last = Speller.load(path, pattern).end  # so that the counts tell the number of ids
        for column in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([0])], ["key", "n"])
            ids, n = np.unique(column.flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(n)], ["key", "n"])

    counted = texts.select("ids").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    held = _unpacked(counted.repartition(1).mapInArrow(_columns, "packed binary"))
    if held is None:
        return None

    def beside(batches):
        end = Speller.load(path, pattern).end
        rank = shared.value[1]
        for column in _parts(batches):
            inputs, targets, _ = _laid_out(column, end)
            key = np.concatenate([targets * 2 * n_bins + rank[inputs], inputs * 2 * n_bins + n_bins + rank[targets]])
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    def make(batches):
        seen = shared.value[0]
        feature = np.zeros((len(seen), 2 * n_bins), np.float32)
        for batch in batches:
            bins = batch.column(1)
            at = np.repeat(batch.column(0).to_numpy(), bins.value_lengths().to_numpy())
            pair = bins.flatten()
            feature[at, pair.field("bin").to_numpy()] = pair.field("n").to_numpy()
        yield _packed(attention.classes(seen, feature))

    seen = np.zeros(int(held[0].max()) + 1, np.int64)
    seen[held[0]] = held[1]
    shared = texts.sparkSession.sparkContext.broadcast((seen, attention.nearest_ranks(seen)))
    pairs = texts.select("ids").mapInArrow(beside, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = pairs.select(
        F.expr(f"key div {2 * n_bins}").alias("id"),
        F.struct((F.col("key") % (2 * n_bins)).alias("bin"), F.col("n").cast("float").alias("n")).alias("pair"),
    )
    per_id = pairs.groupBy("id").agg(F.collect_list("pair").alias("bins"))  # at most 2 * n_bins of an id
    return _unpacked(per_id.repartition(1).mapInArrow(make, "packed binary"))


def _packed(value) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(value)], pa.binary())], ["packed"])


def _unpacked(rows: DataFrame):
    """What one task has made; None if it had no partition to work on."""
    row = rows.first()
    return pickle.loads(row.packed) if row else None


def _counts(docs: DataFrame, text: str, path: str, pattern: str, class_of: np.ndarray) -> DataFrame:
    """Counts over all texts: of words (``kind`` 0) and of pairs of a class and the id after it (``kind`` 1)."""

    def run(batches):
        speller = Speller.load(path, pattern)
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(0)):
                hashes, which, _, inputs, targets, _ = _sequences(speller, data, offsets)
                pair, n = np.unique(class_of[inputs] * speller.n_ids + targets, return_counts=True)
                key = np.concatenate([hashes.view(np.int64), [_END_WORD], pair])
                count = np.concatenate([np.bincount(which, minlength=len(hashes)), [end - first], n])
                kind = np.repeat([0, 1], [len(hashes) + 1, len(pair)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind.astype(np.int32)), pa.array(key), pa.array(count)], ["kind", "key", "n"]
                )

    rows = docs.select(F.col(text)).mapInArrow(run, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def score(
    docs: DataFrame,
    learn: Column,
    path: str,
    pattern: str,
    id: str = "doc_id",
    text: str = "text",
    steps: int = attention.STEPS,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``learned`` (whether ``learn`` holds), ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score`` (both logarithms to base 10 of the text's probability)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learned"), F.col(text).alias("text"))
    training = rows.filter("learned")
    texts = written(_distinct(training, "text", path, pattern), "ids")
    class_of = _classes(texts, path, pattern)
    if class_of is None:  # no text to learn from
        class_of = np.zeros(Speller.load(path, pattern).n_ids, np.int64)
    counts = written(_counts(training, "text", path, pattern, class_of), "counts")
    words = counts.filter("kind = 0").select("key", "n")
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    model = _fitted(counts.filter("kind = 1").select("key", "n"), class_of)
    model = _trained(texts, model, steps)
    frequent = words.filter(F.col("n") >= least_frequent(words, FREQUENT)).repartition(1).sortWithinPartitions("key")
    known = _unpacked(frequent.mapInArrow(_columns, "packed binary")) or (np.zeros(0, np.int64),) * 2
    shared = spark.sparkContext.broadcast((model, *known))
    total, scale = int(facts.n), math.log10(facts.n + facts.v + 1)

    def make(column):
        model, known, number = shared.value
        model = _complete(model)
        speller = Speller.load(path, pattern)
        n_tokens, n_known, base, result, rare = [], [], [], [], []
        for first, end, data, offsets in chunks(column):
            hashes, which, row, inputs, targets, lengths = _sequences(speller, data, offsets)
            size = end - first
            held = np.zeros(len(hashes) + 1, np.int64)
            keys = np.append(hashes.view(np.int64), _END_WORD)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                held = np.where(known[at] == keys, number[at], 0)
            own = held[:-1][which]
            value = np.where(own > 0, np.log10(own + 1.0) - scale, 0)
            tail = held[-1]
            n_tokens.append(np.bincount(row, minlength=size) + 1)
            n_known.append(np.bincount(row, own > 0, size).astype(np.int64) + int(tail > 0))
            base.append(np.bincount(row, value, size) + math.log10(tail + 1.0) - scale)
            log = model.log_probability(inputs, targets, lengths) / math.log(10)
            result.append(np.add.reduceat(log, np.cumsum(lengths) - lengths))
            other = np.flatnonzero(own == 0)
            cuts = np.searchsorted(row[other], np.arange(size + 1))
            rare += [keys[which[other[a:b]]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        join = lambda parts: pa.array(np.concatenate(parts))
        return [join(n_tokens), join(n_known), join(base), join(result), pa.array(rare, pa.list_(pa.int64()))]

    schema = (
        T.StructType().add("n_tokens", "long").add("n_known", "long").add("base_score", "double")
        .add("score", "double").add("rare", T.ArrayType(T.LongType()))
    )
    scored = map_text(rows, "text", schema, make, ["doc_id", "learned"])
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    asked = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    counted = asked.join(words, "key", "left").groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - scale)).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    return scored.join(counted, "row", "left").select(
        "doc_id", "learned", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def _columns(batches):
    """Both columns of at most ``FREQUENT`` rows as arrays."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        yield _packed(tuple(np.concatenate(c) for c in zip(*held, strict=True)))


def _fitted(pairs: DataFrame, class_of: np.ndarray) -> attention.Model:
    """The untrained model with the counted pairs, at most classes times ids of them.

    One task makes the shares within the classes and writes them to the shared folder, where ``within`` names the
    file: they do not pass through the driver.
    """
    spark = pairs.sparkSession
    shared, folder = spark.sparkContext.broadcast(class_of), shared_dir(spark, "within")
    n_classes = attention.SINGLE + attention.CLUSTERS

    def make(batches) -> str:
        class_of = shared.value
        table = np.zeros((n_classes, len(class_of)), np.float32)
        for batch in batches:
            table.reshape(-1)[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        with store.open_output_stream(posixpath.join(root, name)) as out:
            out.write(attention.within_class(table, class_of))
        return f"{folder}/{name}"

    def run(batches):
        yield _packed(make(batches))

    path = _unpacked(pairs.repartition(1).mapInArrow(run, "packed binary")) or make([])
    return attention.start(len(class_of), class_of, path)


def _complete(model: attention.Model) -> attention.Model:
    """The model with the shares that its file holds; a worker keeps the last one read."""
    path = model.within
    if path not in _shares:
        _shares.clear()
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_stream(name) as stream:
            _shares[path] = np.frombuffer(stream.read(), np.float32).reshape(-1, len(model.class_of))
    return replace(model, within=_shares[path])


def _trained(texts: DataFrame, model: attention.Model, steps: int) -> attention.Model:
    """The model with weights fitted on all windows of ``texts``."""
    total = texts.agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("n")).first().n
    if not total:
        return model
    slots = 1 << 30
    cut = math.ceil(min(1, steps * attention.BATCH / total) * slots)
    rest = max(0, total - steps * attention.BATCH)
    rounds = min(ROUNDS, -(-rest // TASK_WINDOWS))
    tasks = max(1, rest // max(1, rounds) // TASK_WINDOWS)
    slot = F.pmod(F.xxhash64("order", F.lit(5)), F.lit(slots))
    local = rest / max(1, rounds * tasks) / attention.BATCH
    begin = steps / (steps + rounds * local)
    first = texts.filter(slot < cut).select("order", "ids").repartition(1)
    model = _averaged(first, model, steps, 1 << 62, 0.0, begin)
    for number in range(rounds):
        share = texts.filter((slot >= cut) & (slot % rounds == number)).select("order", "ids").coalesce(tasks)
        done = [begin + (1 - begin) * (number + more) / rounds for more in (0, 1)]
        model = _averaged(share, model, 0, TASK_WINDOWS, *done)
    return model


def _averaged(
    texts: DataFrame, model: attention.Model, least: int, at_once: int, begin: float, end: float
) -> attention.Model:
    """The model after each task has trained it on all windows of its texts, ``at_once`` of them at a time.

    ``least``: batches at least. A weight is the mean over the tasks that moved it, by how often they did.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    names = [f"v{i}" for i in range(attention.WIDTH)]

    def run(batches):
        own, held, size = pickle.loads(pickle.dumps(shared.value)), [], 0
        n_ids = len(own.embed)
        moved = np.zeros(len(attention.flat(own)))

        def learn():
            column = pa.concat_arrays([a for _, a in held])
            column = column.take(pa.array(np.argsort(np.concatenate([o for o, _ in held]), kind="stable")))
            inputs, targets, lengths = _laid_out(column, n_ids - 1)
            n = int(attention.n_windows(lengths).sum())
            attention.train(own, inputs, targets, lengths, max(least, -(-n // attention.BATCH)), begin, end)
            moved[:n_ids] += np.bincount(inputs, minlength=n_ids)
            moved[n_ids:] += n

        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            group = np.cumsum(attention.n_windows(lengths)) // at_once
            cuts = (np.flatnonzero(np.diff(group)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(group)], strict=True):
                if lo == hi:
                    continue
                held.append((batch.column(0).slice(lo, hi - lo).to_numpy(), batch.column(1).slice(lo, hi - lo)))
                size += int(attention.n_windows(lengths[lo:hi]).sum())
                if size >= at_once:
                    learn()
                    held, size = [], 0
        if held:
            learn()
        rows = np.flatnonzero(moved)
        values = attention.flat(own)[rows] * moved[rows][:, None]
        columns = [pa.array(rows), pa.array(moved[rows]), *map(pa.array, np.ascontiguousarray(values.T))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "n", *names])

    def gather(batches):
        rows, values = [], []
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            rows.append(columns[0])
            values.append((np.stack(columns[2:], axis=1) / columns[1][:, None]).astype(np.float32))
        if rows:
            yield _packed((np.concatenate(rows), np.concatenate(values)))

    moved = texts.mapInArrow(run, f"row long, n double, {', '.join(f'{n} double' for n in names)}")
    sums = moved.groupBy("row").agg(*[F.sum(n).alias(n) for n in ("n", *names)])
    made = _unpacked(sums.repartition(1).mapInArrow(gather, "packed binary"))
    if made is None:
        return model
    rows = attention.flat(model)
    rows[made[0]] = made[1]
    return attention.assign(model, rows)
