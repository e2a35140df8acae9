"""A gated recurrent language model in numpy, with a class-factored softmax.

The vocabulary has side * side ids of frequent words (and the text's end) in `side` classes, by
falling count, and REST classes that stand for all other words, each for those of some endings.
A frequent word's probability is that of its class times that of the word in it; a rest class is
one id, whose words share its probability by their counts (lm_score.py).

For training, documents follow one another in a stream that is cut into lanes of equal length;
the state is carried from window to window of a lane and reset where a document starts, and
gradients stop at a window's start (truncated backpropagation). For scoring, each document stays
whole in one lane, so its state is carried through all of it; lanes are read from one flat array,
so a very long document costs its own length only. States and weights are rounded for that, so that
sums of their products are exact: a document's score does not depend on what it is batched with.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

HIDDEN = 16
#: Classes for words outside the vocabulary.
REST = 32
#: Most classes of frequent words, and most words in one.
SIDE = 64
WINDOW = 32
#: Lanes of training, at most, and of scoring.
LANES, SCORE_LANES = 256, 512
#: In scoring, states and weights are multiples of 1 / GRID and weights at most LIMIT: a sum of HIDDEN products then is a
#: multiple of GRID**-2 below 2**24 of these, which 32-bit floats hold exactly, in whatever order it is summed.
GRID, LIMIT = 256, 8
_NAMES = ("inputs", "u", "c", "cb", "d", "db")

Params = dict[str, np.ndarray]


def side_of(words: int) -> int:
    """Classes for so many frequent words and the end: their square root, SIDE at most."""
    return min(SIDE, max(4, math.ceil(math.sqrt(words + 1))))


def _shapes(side: int) -> dict[str, tuple[int, ...]]:
    h = HIDDEN
    return {"inputs": (side * side + REST, 3 * h), "u": (h, 3 * h), "c": (h, side + REST), "cb": (side + REST,), "d": (side, h, side), "db": (side, side)}


def initial(counts: np.ndarray, seed: int = 0) -> Params:
    """Small random weights; output biases that give the counts' unigram distribution. counts: of
    the side * side ids (negative: no such id), then of the REST classes."""
    rng = np.random.default_rng(seed)
    side = math.isqrt(len(counts) - REST)
    p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in _shapes(side).items()}
    mass = np.where(counts >= 0, counts + 0.1, 0)
    share = mass / mass.sum() + 1e-30
    inner = share[: side * side].reshape(side, side)
    p["cb"] = np.log(np.concatenate([inner.sum(1), share[side * side :]])).astype(np.float32)
    p["db"] = np.log(inner / inner.sum(1, keepdims=True)).astype(np.float32)
    return p


def side_in(p: Params) -> int:
    return len(p["db"])


def flatten(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _NAMES]).astype(np.float32)


def unflatten(flat: np.ndarray) -> Params:
    side = next(s for s in range(1, SIDE + 1) if sum(math.prod(x) for x in _shapes(s).values()) == len(flat))
    out, at = {}, 0
    for k in _NAMES:
        shape = _shapes(side)[k]
        n = math.prod(shape)
        out[k] = np.array(flat[at : at + n], np.float32).reshape(shape)
        at += n
    return out


def _gridded(x: np.ndarray) -> np.ndarray:
    return np.rint(x * np.float32(GRID)) * np.float32(1 / GRID)


def _exact(p: Params) -> Params:
    """Parameters whose products with states are summed exactly."""
    return p | {k: _gridded(np.clip(p[k], -LIMIT, LIMIT)).astype(np.float32) for k in ("u", "c", "d")}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.negative(x)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _states(p: Params, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool, gridded: bool = False):
    """States of a window (rows, lanes, hidden), and what the gradients need (keep: training); gridded:
    the matrix sees them rounded."""
    n, k = HIDDEN, len(ids)
    a = p["inputs"][ids]
    out = np.empty((k, ids.shape[1], n), np.float32)
    starts = fresh.any(1)
    trace = []
    for t in range(k):
        if starts[t]:
            h = np.where(fresh[t][:, None], np.float32(0), h)
        g = (_gridded(h) if gridded else h) @ p["u"]
        rz = _sigmoid(a[t, :, : 2 * n] + g[:, : 2 * n])
        r, z = rz[:, :n], rz[:, n:]
        new = np.tanh(a[t, :, 2 * n :] + r * g[:, 2 * n :])
        if keep:
            trace.append((h, g[:, 2 * n :], r, z, new))
        h = new + z * (h - new)
        out[t] = h
    return out, h, trace


def _choice(x: np.ndarray, rows: np.ndarray, chosen: np.ndarray, slope: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(log-probability of each row's choice, its slope by x) under a softmax of x's rows, which are used up.
    States are within -1 and 1 and gradients clipped, so exp can't overflow."""
    logp = x[rows, chosen]
    e = np.exp(x, out=x)
    z = np.einsum("ij->i", e)
    logp -= np.log(z)
    if not slope:
        return logp, None
    e /= z[:, None]
    e[rows, chosen] -= 1
    return logp, e


def _output(p: Params, h: np.ndarray, target: np.ndarray, weight: np.ndarray | None):
    """Log-probability of each target; with weights (0 or 1) also the gradients of their sum."""
    side = side_in(p)
    inner = target < side * side
    cls = np.where(inner, target // side, target - side * side + side)
    # Rows stand by class, so that each class's are one slice; they are put back at the end.
    order = np.argsort(cls.astype(np.int16), kind="stable")
    cls, word, h = cls[order], (target % side)[order], h[order]
    cut = np.searchsorted(cls, np.arange(side + 1)).tolist()
    slope = weight is not None
    partial = slope and not weight.all()
    weight = weight[order][:, None] if partial else None
    rows = np.arange(len(h))
    x = h @ p["c"]
    x += p["cb"]
    logp, dc = _choice(x, rows, cls, slope)
    grads, dh = None, None
    if slope:
        if partial:
            dc *= weight
        grads = {"c": h.T @ dc, "cb": np.ones(len(h), dc.dtype) @ dc, "d": np.zeros_like(p["d"]), "db": np.zeros_like(p["db"])}
        dh = dc @ p["c"].T
    for c in range(side):
        a, b = cut[c], cut[c + 1]
        if a == b:
            continue
        x = h[a:b] @ p["d"][c]
        x += p["db"][c]
        got, dw = _choice(x, rows[: b - a], word[a:b], slope)
        logp[a:b] += got
        if slope:
            if partial:
                dw *= weight[a:b]
            grads["d"][c], grads["db"][c] = h[a:b].T @ dw, np.ones(b - a, dw.dtype) @ dw
            dh[a:b] += dw @ p["d"][c].T
    back = np.empty_like(order)
    back[order] = rows
    return logp[back], grads, dh[back] if slope else None


def log_probabilities(p: Params, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-likelihood of each document (arrays of ids, none empty)."""
    if not docs:
        return np.empty(0)
    p = _exact(p)
    sizes = np.array([len(d) for d in docs], np.int64)
    heap = [(0, k) for k in range(min(SCORE_LANES, len(docs)))]
    held: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-sizes, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        held[k].append(i)
        heapq.heappush(heap, (n + int(sizes[i]), k))
    held.sort(key=lambda ids: -int(sizes[ids].sum()))
    flow = [i for ids in held for i in ids]
    target = np.concatenate([docs[i] for i in flow]).astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes[flow])[:-1]])
    fresh = np.zeros(len(target), bool)
    fresh[starts] = True
    given = np.concatenate([[end], target[:-1]]).astype(np.int32)
    given[starts] = end
    lengths = np.array([int(sizes[ids].sum()) for ids in held])
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    logp = np.zeros(len(target), np.float32)
    h = np.zeros((len(held), HIDDEN), np.float32)
    for t in range(0, int(lengths[0]), WINDOW):
        n = int((lengths > t).sum())
        # A lane that ends in the window reads on into the next, and that is thrown away.
        at = np.minimum(base[:n] + t + np.arange(WINDOW)[:, None], len(target) - 1)
        states, h, _ = _states(p, given[at], fresh[at], h[:n], False, gridded=True)
        got, _, _ = _output(p, _gridded(states.reshape(-1, HIDDEN)), target[at].reshape(-1), None)
        own = t + np.arange(WINDOW)[:, None] < lengths[:n]
        logp[at[own]] = got.reshape(at.shape)[own]
    out = np.zeros(len(docs))
    out[flow] = np.add.reduceat(logp.astype(np.float64), starts)
    return out


class Trainer:
    """Adam over windows; state goes from window to window, gradients don't.

    The rate falls to a tenth by the time that `expected` ids have been seen.
    """

    def __init__(self, p: Params, rate: float = 0.02, expected: float = math.inf):
        self.p, self.rate, self.step, self.seen, self.expected = p, rate, 0, 0, expected
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, grads: Params) -> None:
        self.step += 1
        rate = self.rate * (1 - 0.9 * min(1.0, self.seen / self.expected))
        scale = rate * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            self.m[k] += np.float32(0.1) * (g - self.m[k])
            self.v[k] += np.float32(0.01) * (g * g - self.v[k])
            self.p[k] -= np.float32(scale) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-6))

    def gradients(self, ids, fresh, target, weight, h) -> tuple[Params, np.ndarray, float]:
        p, n = self.p, HIDDEN
        states, last, trace = _states(p, ids, fresh, h, True)
        flat = states.reshape(-1, n)
        logp, grads, dh = _output(p, flat, target.reshape(-1), weight.reshape(-1))
        total = max(1.0, float(weight.sum()))
        dh = dh.reshape(states.shape)
        da = np.empty((len(ids), ids.shape[1], 3 * n), np.float32)
        dg = np.empty_like(da)
        was, gn, r, z, new = (np.stack(x) for x in zip(*trace, strict=True))
        # What the step's gradient is multiplied by: by itself for z and the new state, through that for r.
        by_new = (1 - z) * (1 - new * new)
        by_z = (was - new) * z * (1 - z)
        by_r = gn * r * (1 - r)
        carry = np.zeros_like(last)
        ut = np.ascontiguousarray(p["u"].T)
        starts = fresh.any(1)
        for t in range(len(ids) - 1, -1, -1):
            d = dh[t] + carry
            dn = d * by_new[t]
            now = dg[t]
            np.multiply(dn, by_r[t], out=now[:, :n])
            np.multiply(d, by_z[t], out=now[:, n : 2 * n])
            np.multiply(dn, r[t], out=now[:, 2 * n :])
            da[t, :, 2 * n :] = dn
            carry = d * z[t] + now @ ut
            if starts[t]:
                carry = np.where(fresh[t][:, None], np.float32(0), carry)
        da[:, :, : 2 * n] = dg[:, :, : 2 * n]
        du = was.reshape(-1, n).T @ dg.reshape(-1, 3 * n)
        grads["u"] = du
        order = np.argsort(ids.reshape(-1), kind="stable")
        seen, start = np.unique(ids.reshape(-1)[order], return_index=True)
        grads["inputs"] = np.zeros_like(p["inputs"])
        grads["inputs"][seen] = np.add.reduceat(da.reshape(-1, 3 * n)[order], start, axis=0)
        return {k: np.clip(g / np.float32(total), -1, 1) for k, g in grads.items()}, last, float((logp * weight.reshape(-1)).sum())

    def run(self, docs: list[np.ndarray], end: int) -> float:
        """One pass over documents (or parts of them); the summed log-likelihood met on the way.

        All lanes are as long, so no window is thin: only the last lane may be short of some ids.
        """
        target = np.concatenate(docs).astype(np.int32)
        fresh = np.zeros(len(target), bool)
        fresh[np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]]).astype(np.int64)] = True
        given = np.concatenate([[end], target[:-1]]).astype(np.int32)
        given[fresh] = end
        lanes = max(1, min(LANES, len(target) // (4 * WINDOW)))
        deep = -(-len(target) // lanes)
        base = np.arange(lanes) * deep
        h = np.zeros((lanes, HIDDEN), np.float32)
        likelihood = 0.0
        for t in range(0, deep, WINDOW):
            rows = np.arange(t, min(t + WINDOW, deep))[:, None]
            real = base + rows < len(target)
            at = np.where(real, base + rows, 0)
            grads, h, got = self.gradients(given[at], fresh[at], target[at], real.astype(np.float32), h)
            self.seen += int(real.sum())
            self.update(grads)
            likelihood += got
        return likelihood
