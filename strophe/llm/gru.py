"""A gated recurrent language model in numpy with a class-factored softmax."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

END, OTHER = 0, 1  # the first words of the vocabulary; both are in class 0


class Model(NamedTuple):
    """embed (word, e); wi (e, 3h), bi (3h); wh (h, 3h); classes: uc (h, class), bc; words: uw (word, h), bw (word).

    Gates come in the order reset, update, new. Word w is in class cls[w]; the words of class c are first[c]:first[c + 1].
    """

    embed: np.ndarray
    wi: np.ndarray
    bi: np.ndarray
    wh: np.ndarray
    uc: np.ndarray
    bc: np.ndarray
    uw: np.ndarray
    bw: np.ndarray
    first: np.ndarray
    cls: np.ndarray


PARAMETERS = Model._fields[:8]


def new(counts: np.ndarray, hidden: int, embed: int, seed: int = 3) -> Model:
    """A model whose output starts as the unigram shares of `counts` (by word; END, OTHER, then words by frequency).

    Class 0 is END and OTHER; the others hold about the square root of the number of words each.
    """
    n = len(counts)
    per = max(1, int(np.ceil(np.sqrt(max(1, n - 2)))))
    first = np.unique(np.concatenate([[0, 2], np.arange(2, n, per), [n]]))
    cls = np.searchsorted(first, np.arange(n), side="right") - 1
    p = (counts + 0.5) / (counts + 0.5).sum()
    mass = np.add.reduceat(p, first[:-1])
    r = np.random.default_rng(seed)
    draw = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
    small = lambda *shape: draw(*shape) * np.float32(0.1)
    return Model(
        draw(n, embed), draw(embed, 3 * hidden), np.zeros(3 * hidden, np.float32), draw(hidden, 3 * hidden),
        small(hidden, len(mass)), np.log(mass).astype(np.float32), small(n, hidden), np.log(p / mass[cls]).astype(np.float32), first, cls,
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def cell(xw: np.ndarray, h: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step: new state, gates, candidate, and the state's part of the candidate. xw is the input's part."""
    k = h.shape[1]
    hw = h @ wh
    gates = sigmoid(xw[:, : 2 * k] + hw[:, : 2 * k])
    new_ = 2 * sigmoid(2 * (xw[:, 2 * k :] + gates[:, :k] * hw[:, 2 * k :])) - 1
    return new_ + gates[:, k:] * (h - new_), gates, new_, hw[:, 2 * k :]


def output(m: Model, h: np.ndarray, target: np.ndarray, grad: bool = False):
    """Natural log-probabilities of the targets after states h: that of the class times that in the class.

    With grad, also the loss's gradients by h and by uc, bc, uw, bw.
    """
    c = m.cls[target].astype(np.int16)  # sorted by digits
    order = np.argsort(c, kind="stable")
    c, y, own = c[order], target[order], np.ascontiguousarray(h[order].T)  # a column per target
    columns = np.arange(len(h))
    z = m.uc.T @ own + m.bc[:, None]
    z -= z.max(axis=0)
    e = np.exp(z)
    total = e.sum(axis=0)
    sorted_logs = z[c, columns] - np.log(total)
    if grad:
        e /= total
        e[c, columns] -= 1
        sorted_dh, duc, dbc = m.uc @ e, own @ e.T, e.sum(axis=1)
        duw, dbw = np.zeros_like(m.uw), np.zeros_like(m.bw)
    bounds = np.searchsorted(c, np.arange(len(m.first)))
    for k in np.flatnonzero(np.diff(bounds)):
        at, a, b = slice(bounds[k], bounds[k + 1]), m.first[k], m.first[k + 1]
        if b - a == 1:
            continue
        z = m.uw[a:b] @ own[:, at] + m.bw[a:b, None]
        z -= z.max(axis=0)
        e = np.exp(z)
        total = e.sum(axis=0)
        i, j = y[at] - a, columns[: len(total)]
        sorted_logs[at] += z[i, j] - np.log(total)
        if grad:
            e /= total
            e[i, j] -= 1
            sorted_dh[:, at] += m.uw[a:b].T @ e
            duw[a:b], dbw[a:b] = e @ own[:, at].T, e.sum(axis=1)
    logs = np.empty_like(sorted_logs)
    logs[order] = sorted_logs
    if not grad:
        return logs
    dh = np.empty_like(h)
    dh[order] = sorted_dh.T
    return logs, dh, {"uc": duc, "bc": dbc, "uw": duw, "bw": dbw}


def window(m: Model, h0: np.ndarray, before: np.ndarray, target: np.ndarray, fresh: np.ndarray):
    """Gradients over one window (time, stream), back to its start only; `fresh` marks where a document begins."""
    steps, k = len(before), h0.shape[1]
    x = m.embed[before]
    xw = x @ m.wi + m.bi
    h, kept, states = h0, [], []
    for t in range(steps):
        h = np.where(fresh[t][:, None], np.float32(0), h)
        after, gates, new_, inner = cell(xw[t], h, m.wh)
        kept.append((h, gates, new_, inner))
        states.append(after)
        h = after
    flat = np.concatenate(states)
    logs, dflat, grads = output(m, flat, target.ravel(), grad=True)
    dstates = dflat.reshape(steps, -1, k)
    dxw, dwh, dh = np.zeros_like(xw), np.zeros_like(m.wh), np.zeros_like(h0)
    for t in reversed(range(steps)):
        was, gates, new_, inner = kept[t]
        dh = dh + dstates[t]
        r, z = gates[:, :k], gates[:, k:]
        dn = dh * (1 - z) * (1 - new_ * new_)
        dz = dh * (was - new_) * z * (1 - z)
        dr = dn * inner * r * (1 - r)
        dhw = np.concatenate([dr, dz, dn * r], axis=1)
        dxw[t] = np.concatenate([dr, dz, dn], axis=1)
        dwh += was.T @ dhw
        dh = np.where(fresh[t][:, None], np.float32(0), dh * z + dhw @ m.wh.T)
    flatx, flatd = x.reshape(-1, x.shape[2]), dxw.reshape(-1, 3 * k)
    dx, n = flatd @ m.wi.T, len(m.embed)
    dembed = np.stack([np.bincount(before.ravel(), weights=column, minlength=n) for column in dx.T], axis=1).astype(m.embed.dtype)
    return logs.sum(), h, grads | {"embed": dembed, "wi": flatx.T @ flatd, "bi": flatd.sum(axis=0), "wh": dwh}


class Adam:
    """Moments of all parameters, and steps taken."""

    def __init__(self, m: Model):
        self.means, self.squares = ({p: np.zeros_like(getattr(m, p)) for p in PARAMETERS} for _ in range(2))
        self.step = 0

    def move(self, m: Model, grads: dict[str, np.ndarray], scale: float, rate: float) -> None:
        """Changes m in place by the gradients times scale."""
        self.step += 1
        speed = rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for p in PARAMETERS:
            g = grads[p] * np.float32(scale)
            self.means[p] += np.float32(0.1) * (g - self.means[p])
            self.squares[p] += np.float32(0.001) * (g * g - self.squares[p])
            getattr(m, p)[...] -= np.float32(speed) * self.means[p] / (np.sqrt(self.squares[p]) + np.float32(1e-8))


def train(m: Model, documents: list[np.ndarray], rounds: int = 2, streams: int = 32, steps: int = 16, rate: float = 0.01, adam: Adam | None = None) -> Model:
    """Truncated backpropagation by Adam over whole documents (arrays of words that end in END), dealt to streams.

    The rate falls to 0 unless adam is given, whose steps then go on. Streams have one length: the last is filled up with the first words.
    """
    if not documents:
        return m
    falls, adam = adam is None, adam or Adam(m)
    text = np.concatenate(documents)
    starts = np.zeros(len(text), bool)
    starts[np.cumsum([0, *map(len, documents[:-1])])] = True
    streams = max(1, min(streams, len(text) // (32 * steps)))  # 32 windows at least
    long = -(-len(text) // streams)
    take = (np.arange(streams)[None, :] * long + np.arange(long)[:, None]) % len(text)
    target, fresh = text[take], starts[take]
    fresh[0] = True  # what came before a stream's start is another's
    before = np.concatenate([np.full((1, streams), END), target[:-1]])
    before = np.where(fresh, END, before)
    step, total = 0, rounds * -(-long // steps)
    for _ in range(rounds):
        h = np.zeros((streams, m.wh.shape[0]), np.float32)
        for at in range(0, long, steps):
            part = slice(at, at + steps)
            _, h, grads = window(m, h, before[part], target[part], fresh[part])
            step += 1
            n = target[part].size
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values())) / n
            adam.move(m, grads, 1 / n / max(1, norm), rate * (1 - step / (total + 1)) if falls else rate)
    return m


def train_all(m: Model, documents: Iterable[np.ndarray], rate: float, streams: int = 1024, tokens: int = 1_048_576) -> int:
    """One round of train() over all the documents, about `tokens` words at a time; how many words there were."""
    adam, some, size, total = Adam(m), [], 0, 0
    for d in documents:
        some.append(d)
        size += len(d)
        if size >= tokens:
            train(m, some, 1, streams, rate=rate, adam=adam)
            some, size, total = [], 0, total + size
    train(m, some, 1, streams, rate=rate, adam=adam)
    return total + size


class Scorer:
    """Log-likelihoods of whole documents, many at once; a document's state is carried from window to window.

    Documents of like length go together, and a window has as many steps as give about `tokens` tokens, but `steps` at
    least, so that the few very long documents share their steps and their outputs are computed in bulk.
    """

    def __init__(self, m: Model, together: int = 512, steps: int = 1, tokens: int = 16_384):
        self.m, self.together, self.steps, self.tokens = m, together, steps, tokens
        self.xw = m.embed @ m.wi + m.bi

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each document (an array of words that ends in END)."""
        out = np.zeros(len(documents))
        order = np.argsort([-len(d) for d in documents], kind="stable")
        for at in range(0, len(order), self.together):
            own = order[at : at + self.together]
            out[own] = self._group([documents[i] for i in own])
        return out

    def _group(self, documents: list[np.ndarray]) -> np.ndarray:
        """documents: the longest first, so those still going are always the first ones."""
        m, lengths = self.m, np.array([len(d) for d in documents])
        sums = np.zeros(len(documents))
        h = np.zeros((len(documents), m.wh.shape[0]), np.float32)
        before = np.full(len(documents), END)
        at = 0
        while at < lengths[0]:
            going = int((lengths > at).sum())
            long = min(max(self.steps, self.tokens // going), lengths[0] - at)
            words = np.zeros((going, long), np.int64)
            for i in range(going):
                d = documents[i][at : at + long]
                words[i, : len(d)] = d
            states, targets, whose = [], [], []
            active = going - np.searchsorted(np.sort(lengths[:going]), at + np.arange(long), side="right")
            for t in range(long):
                n = active[t]
                h = cell(self.xw[before[:n]], h[:n], m.wh)[0]
                states.append(h)
                before = words[:n, t]
                targets.append(before)
                whose.append(np.arange(n))
            logs = output(m, np.concatenate(states), np.concatenate(targets))
            sums[:going] += np.bincount(np.concatenate(whose), weights=logs, minlength=going)
            at += long
        return sums
