"""A small causal self-attention model in numpy: one head over a window of subword ids, classes as output.

The model reads ids and predicts the class of the next one. Frequent ids are classes of their own, the others
are clustered by their neighbours. Within its class an id has its share of the corpus counts after the class
of the id before, smoothed by its share of all counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Positions in a window, new positions per later window, width of the vectors, classes of one id, and of several.
WINDOW, STRIDE, WIDTH, SINGLE, CLUSTERS = 32, 24, 24, 80, 48
STEPS, BATCH, RATE = 2500, 64, 6e-3
#: Most frequent ids by which neighbours are told apart.
NEAR = 256
#: Windows that are scored at once.
RUN = 128
#: Counts that the share of all counts stands for.
SMOOTHING = 5.0
SEED = 11
_PARTS = ("embed", "place", "wq", "wk", "wv", "wo", "head", "bias")


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows over sequences laid end to end, and which of them each window scores.

    Every position is scored once: a first window scores all of its positions, each later one its last ``STRIDE``.
    Positions beyond a sequence's end repeat its last one and are not scored.
    """
    per = n_windows(lengths)
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    inside = number[:, None] * STRIDE + np.arange(WINDOW)
    fresh = (number[:, None] == 0) | (np.arange(WINDOW) >= WINDOW - STRIDE)
    scored = fresh & (inside < lengths[owner][:, None])
    return first[owner][:, None] + np.minimum(inside, lengths[owner][:, None] - 1), scored


@dataclass
class Model:
    embed: np.ndarray
    place: np.ndarray
    wq: np.ndarray
    wk: np.ndarray
    wv: np.ndarray
    wo: np.ndarray
    head: np.ndarray
    bias: np.ndarray
    class_of: np.ndarray
    within: np.ndarray | str  # natural logarithm of each id's share of its class, by the class of the id before, or its file

    def hidden(self, ids: np.ndarray):
        x = self.embed[ids] + self.place
        q, k, v = x @ self.wq, x @ self.wk, x @ self.wv
        s = q @ k.transpose(0, 2, 1)
        s *= np.float32(1 / np.sqrt(WIDTH))
        s += _future()
        np.exp(np.minimum(s, 60, out=s), out=s)
        s /= s.sum(axis=2, keepdims=True)
        o = s @ v
        return x, q, k, v, s, o, x + o @ self.wo

    def log_probability(self, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target, for sequences laid end to end."""
        out = np.zeros(len(targets))
        at, scored = windows(lengths)
        wq = self.wq * np.float32(1 / np.sqrt(WIDTH))
        wkv = np.concatenate([self.wk, self.wv], axis=1)
        first = scored[:, 0]
        for own, skip in ((first, 0), (~first, WINDOW - STRIDE)):  # later windows score no position before ``skip``
            future, own = _future()[skip:], np.flatnonzero(own)
            for lo in range(0, len(own), RUN):
                place, mark = at[own[lo : lo + RUN]], scored[own[lo : lo + RUN], skip:]
                x = self.embed[inputs[place]] + self.place
                k, v = np.split((x.reshape(-1, WIDTH) @ wkv).reshape(len(place), WINDOW, 2 * WIDTH), 2, axis=2)
                x = x[:, skip:]
                s = (x.reshape(-1, WIDTH) @ wq).reshape(x.shape) @ k.transpose(0, 2, 1)
                s += future
                np.exp(np.minimum(s, 60, out=s), out=s)
                o = (s @ v) / s.sum(axis=2, keepdims=True)
                logits = (x[mark] + o[mark] @ self.wo) @ self.head
                logits += self.bias
                np.minimum(logits, 80, out=logits)
                chosen = place[:, skip:][mark]
                picked = logits[np.arange(len(chosen)), self.class_of[targets[chosen]]]
                out[chosen] = picked - np.log(np.exp(logits, out=logits).sum(axis=1))
        return out + self.within[self.class_of[inputs], targets]


def _future() -> np.ndarray:
    return np.triu(np.full((WINDOW, WINDOW), -1e4, np.float32), 1)


def nearest_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each of the ``NEAR`` most frequent ids; ``NEAR`` for all others."""
    rank = np.full(len(counts), NEAR)
    order = np.argsort(-counts, kind="stable")[:NEAR]
    rank[order] = np.arange(len(order))
    return rank


def classes(counts: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Class of each id from its count and its neighbours (which this overwrites).

    A row of ``feature`` counts the ranks of the ids before, then those of the ids after.
    """
    rng = np.random.default_rng(SEED)
    order = np.argsort(-counts, kind="stable")
    class_of = np.full(len(counts), SINGLE + CLUSTERS - 1)
    class_of[order[:SINGLE]] = np.arange(SINGLE)
    size = feature.sum(axis=1)
    seen = np.flatnonzero((size >= 4) & (class_of >= SINGLE))
    if len(seen) < CLUSTERS:
        return class_of
    x = feature[seen]
    x /= size[seen][:, None]
    np.sqrt(x, out=x)
    centres = x[rng.choice(len(x), CLUSTERS - 1, replace=False)]
    for _ in range(15):
        own = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        size = np.bincount(own, minlength=len(centres))
        sums = (own == np.arange(len(centres))[:, None]).astype(np.float32) @ x
        centres = np.where(size[:, None] > 0, sums / np.maximum(1, size)[:, None], centres)
    class_of[seen] = SINGLE + own
    return class_of


def within_class(pairs: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """Log share of each id in its class, after each class. ``pairs``: counts by class before and id."""
    total = pairs.sum(axis=0, dtype=np.float64) + 0.5
    share = total / np.bincount(class_of, total, minlength=SINGLE + CLUSTERS)[class_of]
    out = np.empty(pairs.shape, np.float32)
    for before, own in enumerate(pairs):
        mass = np.bincount(class_of, own, minlength=SINGLE + CLUSTERS)[class_of]
        out[before] = np.log((own + SMOOTHING * share) / (mass + SMOOTHING))
    return out


def start(n_ids: int, class_of: np.ndarray, within: np.ndarray | str) -> Model:
    rng = np.random.default_rng(SEED)
    n_classes = SINGLE + CLUSTERS
    normal = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    square = lambda: normal(WIDTH, WIDTH, scale=WIDTH**-0.5)
    return Model(
        normal(n_ids, WIDTH, scale=0.3), normal(WINDOW, WIDTH, scale=0.1), square(), square(), square(), square(),
        normal(WIDTH, n_classes, scale=0.3), np.zeros(n_classes, np.float32), class_of, within,
    )


def gradients(model: Model, ids: np.ndarray, wanted: np.ndarray, mark: np.ndarray) -> tuple[float, dict]:
    """Mean loss over the marked positions and its gradient. ``wanted``: class at each position."""
    x, q, k, v, a, o, h = model.hidden(ids)
    logits = h[mark] @ model.head + model.bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    own, n = wanted[mark], int(mark.sum())
    loss = -np.log(np.maximum(p[np.arange(n), own], 1e-30)).mean()
    p[np.arange(n), own] -= 1
    p /= n
    g = {"head": h[mark].T @ p, "bias": p.sum(axis=0)}
    dh = np.zeros_like(h)
    dh[mark] = p @ model.head.T
    flat = lambda m: m.reshape(-1, m.shape[-1])
    g["wo"] = flat(o).T @ flat(dh)
    do = dh @ model.wo.T
    da = do @ v.transpose(0, 2, 1)
    dv = a.transpose(0, 2, 1) @ do
    ds = a * (da - (da * a).sum(axis=2, keepdims=True)) * np.float32(1 / np.sqrt(WIDTH))
    dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
    for name, d in (("wq", dq), ("wk", dk), ("wv", dv)):
        g[name] = flat(x).T @ flat(d)
    dx = dh + dq @ model.wq.T + dk @ model.wk.T + dv @ model.wv.T
    g["place"] = dx.sum(axis=0)
    g["embed"] = dx
    return float(loss), g


def n_windows(lengths: np.ndarray) -> np.ndarray:
    """Number of windows over each sequence."""
    return np.where(lengths > 0, np.maximum(0, -(-(lengths - WINDOW) // STRIDE)) + 1, 0)


def flat(model: Model) -> np.ndarray:
    """All weights in rows of ``WIDTH``: the embeddings first, the rest padded to whole rows."""
    rest = np.concatenate([getattr(model, n).reshape(-1) for n in _PARTS[1:]])
    rest = np.append(rest, np.zeros(-len(rest) % WIDTH, np.float32))
    return np.concatenate([model.embed, rest.reshape(-1, WIDTH)])


def assign(model: Model, rows: np.ndarray) -> Model:
    """The model with the weights of ``flat``."""
    at = 0
    rows = rows.astype(np.float32).reshape(-1)
    for name in _PARTS:
        shape = getattr(model, name).shape
        size = int(np.prod(shape))
        setattr(model, name, rows[at : at + size].reshape(shape).copy())
        at += size
    return model


def train(
    model: Model, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray, steps: int = STEPS,
    begin: float = 0.0, end: float = 1.0,
) -> Model:
    """Adam on the windows in random order, all of them before any comes again.

    Of the embeddings only the rows of a batch move. ``begin`` and ``end``: share of the whole training
    that is done before and after, which sets the rate.
    """
    rng = np.random.default_rng(SEED)
    at, mark = windows(lengths)
    if not len(at):
        return model
    wanted = model.class_of[targets]
    first = {n: np.zeros_like(getattr(model, n)) for n in _PARTS}
    second = {n: np.zeros_like(getattr(model, n)) for n in _PARTS}
    rounds = -(-steps * BATCH // len(at))
    drawn = np.concatenate([rng.permutation(len(at)) for _ in range(rounds)])
    for step in range(1, steps + 1):
        pick = drawn[(step - 1) * BATCH : step * BATCH]
        place = at[pick]
        _, g = gradients(model, inputs[place], wanted[place], mark[pick])
        rate = RATE * min(1, step / 50) * (0.05 + 0.95 * (1 - begin - (end - begin) * step / steps))
        rows, which = np.unique(inputs[place], return_inverse=True)
        order = np.argsort(which, axis=None, kind="stable")
        begins = np.searchsorted(which.reshape(-1)[order], np.arange(len(rows)))
        g["embed"] = np.add.reduceat(g["embed"].reshape(-1, WIDTH)[order], begins)
        for name in _PARTS:
            part = rows if name == "embed" else slice(None)
            value, m, s = getattr(model, name), first[name], second[name]
            m[part] = 0.9 * m[part] + 0.1 * g[name]
            s[part] = 0.98 * s[part] + 0.02 * g[name] ** 2
            value[part] -= rate * (m[part] / (1 - 0.9**step)) / (np.sqrt(s[part] / (1 - 0.98**step)) + 1e-6)
    return model
