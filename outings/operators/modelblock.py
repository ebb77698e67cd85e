"""A score model over one block of candidates, in numpy, with bounds that skip most of it.

The candidates are put in an order that keeps alike ones together and cut into parts. Of each part the
extremes of every feature are kept; with a request's wishes they give a score that no member exceeds.
Parts are visited best first, and a part whose bound is below a request's k-th score so far is left out,
so the result is that of scoring every pair.

A block can be packed into bytes and opened again, without building it anew; ``Outlines`` bounds whole blocks
by the extremes of each, before they are opened.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd

PART = 128
#: Requests that are scored together.
CHUNK = 256
#: An outline names so many tags of its block at most; of a block with more, any tag may be had.
OUTLINE_TAGS = 1000


def unit_matrix(column: pd.Series, dim: int | None = None) -> np.ndarray:
    """Unit vectors as rows of a matrix; zero rows where there is no vector."""
    known = column.notna().to_numpy()
    dim = dim or next((len(v) for v in column[known]), 1)
    return _units(known, np.stack(column[known].to_numpy()) if known.any() else None, dim)


def _units(known: np.ndarray, vectors: np.ndarray | None, dim: int) -> np.ndarray:
    out = np.zeros((len(known), dim))
    if vectors is not None:
        out[known] = vectors.astype(float)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        np.divide(out, length, out=out, where=length > 0)
    return out


def _floats(column: pd.Series, missing: float) -> np.ndarray:
    return column.astype("float64").fillna(missing).to_numpy()


def _flags(column: pd.Series) -> np.ndarray:
    """TRUE where the value is true; NULL counts as false."""
    return np.array([v is not None and v == True for v in column], bool)  # noqa: E712


def _round1(x):
    return np.floor(x * 10.0 + 0.5) / 10.0


class ModelBlock:
    """The candidates of a block, and what requests ``prepare``d against it score."""

    def __init__(self, model, items: pd.DataFrame, part: int = PART, words: set[str] | None = None):
        """``words`` are the tags that requests of the block ask for; others give no points and are left out."""
        self.model, self.w = model, model.weights
        w, features, wishes = self.w, model.features, model.wishes
        self.strict = "needed" in features
        needed = _floats(items["needed"], np.nan) if self.strict else _floats(items["walk"], np.nan) * 2 + 30
        vibes = {n: _floats(items[f"vibe_{n}"], 0.5) for n in ("quiet", "active", "inside") if getattr(w, n)}
        times = items["times"].to_numpy(int) if "times" in features else None
        bonus = items["bonus"].to_numpy(dtype=float) if times is None else np.zeros(len(items))
        band = items["band"].map({"inside": 1, "outside": 2}).fillna(0).to_numpy(int) if "location" in wishes else None
        kid = items["kid_friendly"].to_numpy(bool) if "kid_friendly" in wishes else None
        calm = items["low_energy"].to_numpy(bool) if w.low_energy else None
        mark = None
        if w.tags:
            known, row, code = self._tag_cells(items["tags"].to_numpy(), words)
            # a number for the set of known tags; sets that share one by chance only stand together
            mark = np.zeros(len(items), np.int64)
            np.add.at(mark, row, np.random.default_rng(1).integers(1, 1 << 40, len(known))[code])
        spans = self._spans(items) if "open_from" in features else None
        # alike candidates stand together: by gate, then bonus and tags, then a coarse grid of the vibes
        coarse = [np.round(v * 4) for v in vibes.values()]
        fine = list(vibes.values())
        order = [a for a in (band, kid, calm, times) if a is not None]
        order += [-bonus, *([mark] if mark is not None else []), *coarse, np.isnan(needed), *fine]
        self.at = at = np.lexsort(order[::-1])
        self.starts = np.arange(0, max(len(at), 1), part)
        self.stops = np.minimum(self.starts + part, len(at))
        cut = lambda a: a[at] if a is not None else None
        self.needed, self.bonus, self.band, self.kid, self.calm = map(cut, (needed, bonus, band, kid, calm))
        self.vibes = {n: v[at] for n, v in vibes.items()}
        if w.tags:
            place = np.empty(len(at), np.int64)
            place[at] = np.arange(len(at))
            self.tag_cells = known, place[row].astype(np.int32), code.astype(np.int32)
        self.raw, self.vectors = None, None
        if "embedding" in features and items["embedding"].notna().any():
            there = items["embedding"].notna().to_numpy()[at]
            self.raw = there, np.stack(items["embedding"].to_numpy()[at][there])
        self.hash = items["item_hash"].to_numpy()[at] if w.jitter else None
        self.begins = items["starts"].to_numpy()[at] if "requested_date" in wishes else None
        self.times = cut(times)
        self.spans = spans[:, at] if spans is not None else None
        self._extremes()
        self._ready(None)

    def _ready(self, words: dict[str, int] | None) -> None:
        """What is worked out anew when a block is opened: unit vectors, and which row has which of the ``words``."""
        if self.raw is not None:
            self.vectors = _units(*self.raw, self.raw[1].shape[1])
        if self.w.tags:
            known, row, code = self.tag_cells
            words = {t: i for i, t in enumerate(known)} if words is None else words
            mine = np.array([words.get(t, -1) for t in known], np.int64)
            there = np.flatnonzero(mine >= 0)
            self.words = {known[i]: n for n, i in enumerate(there)}
            # for each of the ``words`` the column that has it, -1 where no candidate does; the last is for other tags
            self.column = np.full(len(words) + 1, -1)
            self.column[mine[there]] = np.arange(len(there))
            self.has = np.zeros((len(self.at), len(there)), bool)
            own = self.column[mine][code]
            self.has[row[own >= 0], own[own >= 0]] = True
            self.any_tag = self._each(np.logical_or, self.has)

    def packed(self) -> bytes:
        made_anew = ("model", "w", "words", "column", "has", "any_tag", "vectors")
        return pickle.dumps({n: v for n, v in vars(self).items() if n not in made_anew}, protocol=5)

    @classmethod
    def opened(cls, model, data: bytes, words: dict[str, int]) -> ModelBlock:
        """A packed block of the same model, for requests that ask for the ``words``."""
        block = cls.__new__(cls)
        vars(block).update(pickle.loads(data), model=model, w=model.weights, vectors=None)
        block._ready(words)
        return block

    def outline(self) -> bytes:
        """The extremes over the whole block."""
        def least(a):
            return np.fmin.reduce(a)

        def most(a):
            return np.fmax.reduce(a)

        out = {
            "least_needed": least(self.least_needed), "least_walk": least(self.least_walk), "most_bonus": most(self.most_bonus),
            "vibe_range": {n: (least(low), most(high)) for n, (low, high) in self.vibe_range.items()},
            "dim": self.raw[1].shape[1] if self.raw is not None else 0,
        }
        if self.times is not None:
            out["any_time"] = np.bitwise_or.reduce(self.times)
        for name in ("kid", "calm"):
            if getattr(self, name) is not None:
                out[f"any_{name}"] = bool(getattr(self, name).any())
        if self.band is not None:
            out["any_band"] = {b: bool((self.band == b).any()) for b in (1, 2)}
        if self.w.tags:
            known = self.tag_cells[0]
            out["tags"] = known if len(known) <= OUTLINE_TAGS else None
        return pickle.dumps(out, protocol=5)

    @staticmethod
    def _spans(items: pd.DataFrame):
        """Opening spans side by side, filled up with empty ones; NULL is the whole week."""
        rows = [((0,), (10080,)) if a is None else (a, b) for a, b in zip(items["open_from"].to_numpy(), items["open_to"].to_numpy())]
        spans = np.zeros((2, len(rows), max((len(a) for a, _ in rows), default=0)), np.int64)
        for i, (a, b) in enumerate(rows):
            spans[0, i, : len(a)], spans[1, i, : len(b)] = a, b
        return spans

    @staticmethod
    def _tag_cells(tags, words: set[str] | None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Known words, and the pairs of a row and a number of a word that it has."""
        at: dict[str, int] = {}
        cells = {(i, at.setdefault(t, len(at))) for i, row in enumerate(tags) for t in (row if row is not None else ())
                 if words is None or t in words}
        row, code = np.array(sorted(cells), np.int64).reshape(-1, 2).T
        return list(at), row, code

    def _each(self, reduce, values):
        return reduce.reduceat(values, self.starts, axis=0) if len(self.at) else values

    def _extremes(self) -> None:
        free = np.where(np.isnan(self.needed), -np.inf if not self.strict else np.inf, self.needed)
        self.least_needed = self._each(np.minimum, free)
        walks = np.where(np.isnan(self.needed), np.inf, self.needed)
        self.least_walk = self._each(np.minimum, walks)
        self.most_bonus = self._each(np.maximum, self.bonus)
        self.any_time = self._each(np.bitwise_or, self.times) if self.times is not None else None
        self.vibe_range = {n: (self._each(np.minimum, v), self._each(np.maximum, v)) for n, v in self.vibes.items()}
        self.any_kid = self._each(np.logical_or, self.kid) if self.kid is not None else None
        self.any_calm = self._each(np.logical_or, self.calm) if self.calm is not None else None
        if self.band is not None:
            self.any_band = {b: self._each(np.logical_or, self.band == b) for b in (1, 2)}

    def prepare(self, q: pd.DataFrame) -> dict[str, np.ndarray]:
        """The wishes of some requests as arrays."""
        p = self.wishes(q)
        if self.w.tags:
            wanted, n = np.zeros((len(q), len(self.words))), np.ones((len(q), 1))
            for i, row in enumerate(q["r_tags"]):
                if row is not None and len(row):
                    n[i] = len(row)
                    for t in row:
                        if t in self.words:
                            wanted[i, self.words[t]] += 1.0
            p["tags"], p["n_tags"] = wanted, n
        return p

    def wishes(self, q: pd.DataFrame) -> dict[str, np.ndarray]:
        """The wishes but tags, which are the same for every block."""
        w, wishes = self.w, self.model.wishes
        p = {"available": q["r_time_available"].to_numpy(dtype=float)[:, None]}
        for name in self.vibes:
            p[name] = q[f"r_{name}"].to_numpy(dtype=float)[:, None]
        if self.vectors is not None:
            p["unit"] = unit_matrix(q["r_embedding"], self.vectors.shape[1])
        if w.low_energy:
            p["low"] = _flags(q["r_low_energy"])[:, None]
        if w.jitter:
            p["hash"] = q["r_hash"].to_numpy()[:, None]
        if "location" in wishes:
            p["band"] = q["r_location"].map({"inside": 1, "outside": 2}).fillna(0).to_numpy(int)[:, None]
        if "kid_friendly" in wishes:
            p["kid"] = np.array([v is None or bool(v) for v in q["r_kid_friendly"]])[:, None]
        if self.spans is not None:
            p["minute"] = q["r_local_minute"].to_numpy(dtype=float)[:, None]
            p["part"] = q["r_local_part"].fillna(0).to_numpy(int)[:, None]
        if "requested_date" in wishes:
            p["date"] = q["r_requested_date"].to_numpy()[:, None]
        return p

    def bound(self, p: dict) -> np.ndarray:
        """Requests by parts: a score that no member of the part exceeds, -inf where none may be had."""
        total = self._bound(p)
        return _round1(total) if self.model.rounded else total

    def _bound(self, p: dict) -> np.ndarray:
        """The bound before rounding; of vectors it takes the largest similarity there is."""
        w, available = self.w, p["available"]
        total = np.zeros((len(available), len(self.starts)))
        with np.errstate(invalid="ignore", divide="ignore"):
            if w.spare:
                total = total + (available - self.least_needed) * w.spare
            for name, (low, high) in self.vibe_range.items():
                gap = np.maximum(0.0, np.maximum(low - p[name], p[name] - high))
                total += (1.0 - gap) * getattr(w, name)
            if w.tags:
                total += (p["tags"] @ self.any_tag.T) / p["n_tags"] * w.tags
            if self.vectors is not None:
                total += self._nearest(p) * w.semantic
            total += self.most_bonus
            if self.times is not None:
                total += ((self.any_time & p["part"]) > 0) * w.time
            if w.low_energy:
                total -= (p["low"] & ~self.any_calm) * w.low_energy
            if w.fit:
                ratio = self.least_walk / available
                total += np.where(ratio <= 0.8, (1.0 - ratio) * w.fit, 0.0)
            total += w.jitter
            total += 1e-9  # sums of doubles in another order
            ok = (self.least_needed <= available) | (~np.isfinite(self.least_needed) & (not self.strict))
            if self.band is not None:
                for b, there in self.any_band.items():
                    ok = ok & ((p["band"] != b) | there)
            if self.any_kid is not None:
                ok = ok & (~p["kid"] | self.any_kid)
            # a missing wish gives no score, and the pair test then drops the pair
            return np.where(ok & ~np.isnan(total), total, -np.inf)

    @staticmethod
    def _nearest(p: dict) -> np.ndarray:
        """A similarity that none exceeds: 1 for a request with a vector, else 0."""
        return p["unit"].any(axis=1, keepdims=True).astype(float)

    def score(self, p: dict, rows, low: int, high: int, near: np.ndarray | None = None) -> np.ndarray:
        """Score of some requests with the candidates from ``low`` to ``high``, -inf where a pair is not allowed.

        ``near`` are their similarities, where these are known already.
        """
        w, s = self.w, slice(low, high)
        available, needed = p["available"][rows], self.needed[s]
        with np.errstate(invalid="ignore", divide="ignore"):
            total = np.zeros((len(available), high - low))
            if w.spare:
                total = total + (available - needed) * w.spare
            for name, vibe in self.vibes.items():
                total += (1.0 - np.abs(vibe[s] - p[name][rows])) * getattr(w, name)
            if w.tags:
                total += (p["tags"][rows] @ self.has[s].T.astype(float)) / p["n_tags"][rows] * w.tags
            if self.vectors is not None:
                total += (p["unit"][rows] @ self.vectors[s].T if near is None else near) * w.semantic
            total += self.bonus[s] if self.times is None else ((self.times[s] & p["part"][rows]) > 0) * w.time
            if w.low_energy:
                total -= (p["low"][rows] & ~self.calm[s]) * w.low_energy
            if w.fit:
                ratio = needed / available
                total += np.where(ratio <= 0.8, (1.0 - ratio) * w.fit, 0.0)
            if w.jitter:
                total += np.mod(p["hash"][rows] ^ self.hash[s], 10000) / 10000.0 * w.jitter
            if self.model.rounded:
                total = _round1(total)
            ok = total >= 0 if self.model.keep_zero else total > 0
            ok &= (needed <= available) if self.strict else np.isnan(needed) | (needed <= available)
            if self.band is not None:
                wanted = p["band"][rows]
                ok &= (wanted == 0) | (self.band[s] == wanted)
            if self.kid is not None:
                ok &= ~p["kid"][rows] | self.kid[s]
            if self.spans is not None:
                now = p["minute"][rows]
                opened = np.zeros(ok.shape, bool)
                for start, stop in zip(self.spans[0, s].T, self.spans[1, s].T):
                    opened |= (start <= now) & (now < stop)
                ok &= opened
            if self.begins is not None:
                starts = self.begins[s][None, :]
                ok &= pd.isna(starts) | (starts >= p["date"][rows])
        return np.where(ok, total, -np.inf)

    def parts(self, p: dict, rows: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """What makes up the scores of the pairs (``rows``, ``at``), each rounded to one decimal."""
        w, available = self.w, p["available"][rows, 0]
        out = {f"{n}_score": (1.0 - np.abs(v[at] - p[n][rows, 0])) * getattr(w, n) for n, v in self.vibes.items()}
        if w.tags:
            out["tag_score"] = np.einsum("ij,ij->i", p["tags"][rows], self.has[at]) / p["n_tags"][rows, 0] * w.tags
        near = np.einsum("ij,ij->i", p["unit"][rows], self.vectors[at]) if self.vectors is not None else np.zeros(len(rows))
        out["semantic_score"] = near * w.semantic
        timely = self.times is not None and (self.times[at] & p["part"][rows, 0]) > 0
        out["time_bonus"] = self.bonus[at] + timely * w.time
        with np.errstate(invalid="ignore", divide="ignore"):
            ratio = self.needed[at] / available
            out["availability_score"] = np.where(ratio <= 0.8, (1.0 - ratio) * w.fit, 0.0)
        return {n: _round1(v) for n, v in out.items()}

    def best(self, p: dict, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(request, candidate, score) of the k best per request, and the pairs scored.

        Candidates are numbers into the given order, which breaks ties. What scores below a request's ``floor`` is left out.
        """
        loose = self._bound(p)
        bound = _round1(loose) if self.model.rounded else loose
        top = np.full((len(bound), k), -np.inf)
        place = np.full((len(bound), k), len(self.at))
        floor = np.full(len(bound), -np.inf) if floor is None else floor
        least = floor.copy()  # what a candidate must reach
        scored = 0
        for s in np.argsort(-bound.max(axis=0), kind="stable") if bound.size else ():
            rows = np.flatnonzero((bound[:, s] >= least) & np.isfinite(bound[:, s]))
            if len(rows) == 0:
                continue
            low, high = self.starts[s], self.stops[s]
            near = None
            if self.vectors is not None:  # the similarities alone leave out most of what the bound let through
                near = p["unit"][rows] @ self.vectors[low:high].T
                tight = loose[rows, s] + (np.fmax.reduce(near, axis=1) - self._nearest(p)[rows, 0]) * self.w.semantic
                keep = (_round1(tight) if self.model.rounded else tight) >= least[rows]
                rows, near = rows[keep], near[keep]
                if len(rows) == 0:
                    continue
            found = self.score(p, rows, low, high, near)
            scored += found.size
            better = ((found >= least[rows, None]) & np.isfinite(found)).any(axis=1)
            rows, found = rows[better], found[better]
            if len(rows) == 0:
                continue
            both = np.concatenate([top[rows], found], axis=1)
            where = np.concatenate([place[rows], np.broadcast_to(self.at[low:high], found.shape)], axis=1)
            kth = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k]
            r, c = np.nonzero((both >= kth[:, None]) & np.isfinite(both))
            order = np.lexsort((where[r, c], -both[r, c], r))
            r, c = r[order], c[order]
            rank = np.arange(len(r)) - np.searchsorted(r, np.arange(len(rows)))[r]
            r, c, rank = r[rank < k], c[rank < k], rank[rank < k]
            top[rows], place[rows] = -np.inf, len(self.at)
            top[rows[r], rank], place[rows[r], rank] = both[r, c], where[r, c]
            least[rows] = np.maximum(top[rows, -1], floor[rows])
        request, rank = np.nonzero(np.isfinite(top) & (top >= floor[:, None]))
        return request, place[request, rank], top[request, rank], scored

    def totals(self, p: dict, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per request how many qualify, the best and the worst score; a candidate stands for its members."""
        n, sizes = len(p["available"]), members[self.at]
        count, best, worst = np.zeros(n, np.int64), np.full(n, -np.inf), np.full(n, np.inf)
        bound = self.bound(p)
        for s, (low, high) in enumerate(zip(self.starts, self.stops)):
            rows = np.flatnonzero(np.isfinite(bound[:, s]))
            if len(rows) == 0 or high == low:
                continue
            found = self.score(p, rows, low, high)
            ok = np.isfinite(found)
            count[rows] += ok @ sizes[low:high]
            best[rows] = np.maximum(best[rows], found.max(axis=1))
            worst[rows] = np.minimum(worst[rows], np.where(ok, found, np.inf).min(axis=1))
        return count, best, worst


class Outlines(ModelBlock):
    """Blocks, not opened, as the parts of one; ``words`` are the tags that the requests ask for."""

    def __init__(self, model, outlines: list[bytes], words: dict[str, int]):
        self.model, self.w, self.strict = model, model.weights, "needed" in model.features
        each = [pickle.loads(o) for o in outlines]
        self.starts = np.arange(len(each))

        def side(name: str, of=lambda o: o):
            return np.array([of(o[name]) for o in each]) if name in each[0] else None

        self.least_needed, self.least_walk, self.most_bonus = side("least_needed"), side("least_walk"), side("most_bonus")
        self.vibe_range = {n: (side("vibe_range", lambda v: v[n][0]), side("vibe_range", lambda v: v[n][1])) for n in each[0]["vibe_range"]}  # noqa: B023
        self.vibes = self.vibe_range
        self.times = self.any_time = side("any_time")
        self.any_kid, self.any_calm = side("any_kid"), side("any_calm")
        self.band = self.any_band = None
        if "any_band" in each[0]:
            self.band = self.any_band = {b: side("any_band", lambda v: v[b]) for b in (1, 2)}  # noqa: B023
        dim = max(o["dim"] for o in each)
        self.vectors = np.zeros((0, dim)) if dim else None
        self.spans = True if "open_from" in model.features else None
        if self.w.tags:
            self.words, self.column = words, np.arange(len(words))
            self.any_tag = np.zeros((len(each), len(words)), bool)
            for i, o in enumerate(each):
                if o["tags"] is None:
                    self.any_tag[i] = True
                else:
                    self.any_tag[i, [words[t] for t in o["tags"] if t in words]] = True


class Asked:
    """Requests as arrays, of which some are handed to one block after the other."""

    def __init__(self, outlines: Outlines, q: pd.DataFrame):
        self.arrays, self.words = outlines.wishes(q), outlines.words if outlines.w.tags else None
        if self.words is not None:
            rows = [r if r is not None else () for r in q["r_tags"]]
            self.lengths = np.array([len(r) for r in rows], np.int64)
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.codes = np.array([self.words[t] for r in rows for t in r], np.int64)

    def some(self, block: ModelBlock, rows: np.ndarray) -> dict[str, np.ndarray]:
        """Some of the requests, as ``block`` wants them."""
        p = {n: v[rows] for n, v in self.arrays.items()}
        if self.words is not None:
            lengths = self.lengths[rows]
            request = np.repeat(np.arange(len(rows)), lengths)
            nth = np.arange(len(request)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            column = block.column[self.codes[np.repeat(self.starts[rows], lengths) + nth]]
            p["tags"] = np.zeros((len(rows), block.any_tag.shape[1]))
            np.add.at(p["tags"], (request[column >= 0], column[column >= 0]), 1.0)
            p["n_tags"] = np.maximum(lengths, 1).astype(float)[:, None]
        return p
