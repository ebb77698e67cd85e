"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is the product (binding) of its
letters' vectors, each shifted (permuted) by its place. A text is the sum (bundle) of its trigrams, a
language the sum of its training texts, each at equal weight. The language of a text is that of the
prototype with the largest cosine.

Texts are lower-cased and brought to NFC; all but letters counts as a space, and trigrams stay within
words padded by one space on both sides. A text that is null or has no letter is ``und`` with score 0,
as is every text if nothing could be learned. Ties go to the smaller language name. Training rows
without language or without letters teach nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outings.llm.textbytes import chunks, keep_rows, map_text

DIMENSIONS = 2048
SEED = 20_240
#: Texts and characters that are bundled at once, and trigrams that are bound at once.
TEXTS, CHARS, GRAMS = 256, 1 << 19, 2048
#: Prototypes are held by the driver and every task: 16 KB a language.
MAX_LANGUAGES = 4096
UNKNOWN = "und"
#: A text is unlike all languages below ``SHARE`` of the cosine that all but ``LOW`` of the learned texts of its
#: length reach. Texts of fewer than ``LEAST`` trigrams have no bound: their cosines spread down to those of noise.
LOW, SHARE, LEAST = 0.01, 0.5, 8
_STEPS = 1000

_SPACE = 32
_tables: dict[str, np.ndarray] = {}
_letters: dict[tuple[int, int], np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if "letter" not in _tables:
        _tables["letter"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _tables["letter"]


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The random vector of a letter; it depends on the letter alone."""
    if (code, dimensions) not in _letters:
        if len(_letters) > 20_000:
            _letters.clear()
        bits = np.random.default_rng([SEED, code]).integers(0, 2, dimensions, dtype=np.int8)
        _letters[code, dimensions] = bits * np.int8(2) - np.int8(1)
    return _letters[code, dimensions]


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Groups of texts, with their row numbers. A text longer than a group is cut at spaces.

    No group has two pieces of one text.
    """
    rows, group, size = [], [], 0
    for row, text in enumerate(texts):
        text = (text or "").lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        at = 0
        while at < len(text):
            end = min(len(text), at + CHARS)
            if end < len(text):
                end = text.rfind(" ", at + 1, end) if " " in text[at + 1 : end] else end
            if group and (size + end - at > CHARS or len(group) == TEXTS or rows[-1] == row):
                yield np.array(rows), group
                rows, group, size = [], [], 0
            rows.append(row)
            group.append(text[at:end])
            size += end - at
            at = end
    if group:
        yield np.array(rows), group


def trigrams(group: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and trigram number of each trigram, and the letters of the distinct trigrams."""
    joined = " " + " ".join(group) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(group), dtype=np.int32), [len(t) + 1 for t in group])
    owner = np.append(owner, np.int32(len(group) - 1))
    codes = np.where(_is_letter()[codes], codes, _SPACE)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
    codes, owner = codes[keep], owner[keep]
    alphabet = np.flatnonzero(np.bincount(codes))
    number = np.zeros(alphabet[-1] + 1, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    n, place = len(alphabet), number[codes]
    inner = np.flatnonzero(codes[1:-1] != _SPACE)
    key = (place[inner] * n + place[inner + 1]) * n + place[inner + 2]
    if n**3 <= 1 << 22:  # a table of all possible trigrams is quicker than sorting
        distinct = np.flatnonzero(np.bincount(key, minlength=1))
        rank = np.zeros(n**3, np.int64)
        rank[distinct] = np.arange(len(distinct))
        index = rank[key]
    else:
        distinct, index = np.unique(key, return_inverse=True)
    letters = np.stack([distinct // (n * n), distinct // n % n, distinct % n])
    return owner[inner + 1], index, alphabet[letters]


def _bind(letters: np.ndarray, dimensions: int) -> np.ndarray:
    """Vectors of trigrams: the letters' vectors, shifted by their place, multiplied."""
    alphabet, index = np.unique(letters, return_inverse=True)
    index = index.reshape(letters.shape)
    own = np.stack([letter_vector(int(c), dimensions) for c in alphabet])
    return np.roll(own, 2, 1)[index[0]] * np.roll(own, 1, 1)[index[1]] * own[index[2]]


def bundle(texts: list[str | None], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Vector and number of trigrams of each text."""
    out, count = np.zeros((len(texts), dimensions), np.float32), np.zeros(len(texts), np.int64)
    for rows, group in _pieces(texts):
        owner, index, letters = trigrams(group)
        np.add.at(count, rows, np.bincount(owner, minlength=len(group)))
        for lo in range(0, letters.shape[1], GRAMS):
            part = letters[:, lo : lo + GRAMS]
            n = part.shape[1]
            own = slice(None) if letters.shape[1] <= GRAMS else (index >= lo) & (index < lo + n)
            cells = owner[own].astype(np.int64) * n + (index[own] - lo)
            weight = np.bincount(cells, minlength=len(group) * n).reshape(len(group), n)
            out[rows] += weight.astype(np.float32) @ _bind(part, dimensions).astype(np.float32)
    return out, count


def _sum_by_label(texts: list[str | None], labels: list[str], dimensions: int) -> dict[str, np.ndarray]:
    """Sum of each label's texts, every text scaled to one trigram in all (every piece of a very long one)."""
    names = sorted(set(labels))
    number = np.searchsorted(names, labels)
    sums = np.zeros((len(names), dimensions))
    for rows, group in _pieces(texts):
        owner, index, letters = trigrams(group)
        share = 1 / np.maximum(1, np.bincount(owner, minlength=len(group)))[owner]
        label = number[rows][owner]
        for lo in range(0, letters.shape[1], GRAMS):
            part = letters[:, lo : lo + GRAMS]
            n = part.shape[1]
            own = (index >= lo) & (index < lo + n)
            weight = np.bincount(label[own] * n + index[own] - lo, share[own], minlength=len(names) * n)
            sums += weight.reshape(len(names), n).astype(np.float32) @ _bind(part, dimensions).astype(np.float32)
    return dict(zip(names, sums, strict=True))


def fit(docs: DataFrame, label: str, text: str = "text", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of each language. Tasks bundle their own texts; one row per task, language and dimension is shuffled."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0)
            for first, end, _, _ in chunks(batch.column(1)):
                labels = names.slice(first, end - first).to_pylist()
                texts = batch.column(1).slice(first, end - first).to_pylist()
                for name, total in _sum_by_label(texts, labels, dimensions).items():
                    sums[name] = sums.get(name, 0) + total
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(total)],
                ["label", "dimension", "total"],
            )

    known = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    parts = known.select(F.col(label).cast("string"), F.col(text)).mapInArrow(
        run, "label string, dimension int, total double"
    )
    sums = parts.groupBy("label", "dimension").agg(F.sum("total").alias("total"))
    gathered = sums.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dimension", "total"))).alias("v"))
    rows = gathered.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = {}
    for row in sorted(rows, key=lambda r: r.label):
        vector = np.array([x.total for x in row.v])
        if norm := float(np.linalg.norm(vector)):
            out[row.label] = np.round(vector / norm, 9)  # sums of tasks arrive in any order
    return out


def predict(
    docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with that language's prototype (0 to 1)."""
    schema = T.StructType().add("lang_pred", "string", False).add("score", "double", False)
    classify = _classifier(prototypes)
    return map_text(docs, text, schema, lambda column: [pa.array(x) for x in classify(column)[:2]], keep)


def _length_class(count: np.ndarray) -> np.ndarray:
    """Powers of two of the number of trigrams."""
    return np.log2(np.maximum(1, count)).astype(np.int64)


def least_cosines(
    docs: DataFrame, prototypes: dict[str, np.ndarray], label: str, text: str = "text"
) -> np.ndarray:
    """Least cosine by length class, from the cosines of all learned texts. A class without texts has that of the
    next shorter one with texts, and none if there is no such class."""
    classify = _classifier(prototypes)

    def run(batches):
        for batch in batches:
            for first, end, _, _ in chunks(batch.column(0)):
                _, score, count = classify(batch.column(0).slice(first, end - first))
                cell = _length_class(count) * (_STEPS + 1) + np.floor(np.array(score) * _STEPS).astype(np.int64)
                cell, n = np.unique(cell[count >= LEAST], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    known = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    cells = known.select(F.col(text)).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros((64, _STEPS + 1), np.int64)
    for row in cells.toLocalIterator():  # at most a cell a length class and step
        table.reshape(-1)[row.cell] = row.n
    least, last = np.zeros(64), 0.0
    for number, own in enumerate(table):
        if own.sum():
            last = SHARE * int(np.searchsorted(np.cumsum(own), LOW * own.sum(), "right")) / _STEPS
        least[number] = last
    return least


def keep_identified(
    docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", least: np.ndarray | None = None
) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with a cosine not under ``least`` of its length class."""
    classify = _classifier(prototypes)

    def decide(column: pa.Array) -> np.ndarray:
        names, score, count = classify(column)
        found = np.array(names, object) != UNKNOWN
        if least is None:
            return found
        return found & ((count < LEAST) | (np.array(score) >= least[_length_class(count)]))

    return keep_rows(docs, text, decide)


def _classifier(prototypes: dict[str, np.ndarray]):
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else None

    def classify(column: pa.Array) -> tuple[list[str], list[float], np.ndarray]:
        if matrix is None:
            return [UNKNOWN] * len(column), [0.0] * len(column), np.zeros(len(column), np.int64)
        vectors, count = bundle(column.to_pylist(), matrix.shape[1])
        norm = np.linalg.norm(vectors, axis=1)
        cosine = (vectors @ matrix.T).astype(np.float64) / np.where(norm > 0, norm, 1)[:, None]
        best = np.round(cosine, 6).argmax(axis=1)
        found = count > 0
        score = np.where(found, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
        return [names[b] if f else UNKNOWN for b, f in zip(best, found, strict=True)], score.tolist(), count

    return classify
