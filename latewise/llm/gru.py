"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation through time."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

Params = dict[str, np.ndarray]


@dataclass(frozen=True)
class Shape:
    """``classes`` x ``members`` words are predicted one by one; class number ``classes`` stands for all others.

    Inputs are those words, ``hashed`` buckets for the others, and one mark for the begin of a text.
    """

    classes: int = 48
    members: int = 48
    hidden: int = 16
    hashed: int = 512

    @classmethod
    def of(cls, distinct: int, total: int, most: int = 48, occurrences: int = 500) -> Shape:
        """As many classes as members, about the square root of the distinct words, ``most`` at most: a token costs their sum.

        There is one own word for every ``occurrences`` training tokens at most, so that each is learnt from enough of them.
        """
        words = max(1, min(distinct, total // occurrences))
        side = min(most, max(4, math.isqrt(words - 1) + 1))
        return cls(classes=side, members=side)

    @property
    def words(self) -> int:
        return self.classes * self.members

    @property
    def begin(self) -> int:
        return self.words + self.hashed


def initial(shape: Shape, shares: np.ndarray, rest: float) -> Params:
    """Starts at the given word shares, so training begins at the quality of single-word counts."""
    rng, h = np.random.default_rng(11), shape.hidden
    own = np.maximum(np.resize(shares, shape.words) if len(shares) else np.ones(shape.words), 1e-9)
    own[len(shares) :] = 1e-9
    own = own.reshape(shape.classes, shape.members)
    mass = np.append(own.sum(axis=1), max(rest, 1e-9))
    return {k: v.astype(np.float32) for k, v in {
        "table": rng.normal(0, 0.1, (shape.begin + 1, 3 * h)), "recur": rng.normal(0, h**-0.5, (h, 3 * h)),
        "to_class": np.zeros((h, shape.classes + 1)), "class_bias": np.log(mass / mass.sum()),
        "to_word": np.zeros((shape.classes, shape.members, h)),
        "word_bias": np.log(own / own.sum(axis=1, keepdims=True)),
    }.items()}


def flat(params: Params) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unflat(values: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def lanes(sizes: np.ndarray, n_lanes: int) -> list[list[int]]:
    """Whole texts dealt to lanes of nearly equal length, longest lane first."""
    n = max(1, min(n_lanes, len(sizes)))
    heap, out = [(0, i) for i in range(n)], [[] for _ in range(n)]
    total = np.zeros(n, dtype=np.int64)
    for doc in np.argsort(-sizes, kind="stable").tolist():
        size, lane = heapq.heappop(heap)
        out[lane].append(doc)
        total[lane] = size + int(sizes[doc])
        heapq.heappush(heap, (int(total[lane]), lane))
    return [out[i] for i in np.argsort(-total, kind="stable")]


def windows(
    texts: list[np.ndarray], shape: Shape, n_lanes: int, steps: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(lanes still running, inputs, targets, text of each step), ``steps`` by lanes; lanes end in input -1.

    A text is its input codes with the begin mark before; targets are the same codes moved by one, the end mark last.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    dealt = lanes(sizes, n_lanes)
    length = int(sizes[dealt[0]].sum()) if dealt[0] else 0
    length += -length % steps
    inputs = np.full((len(dealt), length), -1, dtype=np.int32)
    targets, owner = inputs.copy(), inputs.copy()
    for lane, docs in enumerate(dealt):
        at = 0
        for d in docs:
            end = at + len(texts[d])
            targets[lane, at:end], owner[lane, at:end] = texts[d], d
            inputs[lane, at], inputs[lane, at + 1 : end] = shape.begin, texts[d][:-1]
            at = end
    for at in range(0, length, steps):
        running = int((inputs[:, at] >= 0).sum())  # lanes are sorted by length
        part = slice(at, at + steps)
        yield running, inputs[:running, part].T, targets[:running, part].T, owner[:running, part].T


def _steps(p: Params, inputs: np.ndarray, begin: int, h: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states of a window; ``keep`` collects what backpropagation needs."""
    n = h.shape[1]
    given = p["table"][inputs]  # input -1 reads the begin mark's row and is never scored
    out = np.empty((len(inputs), *h.shape), dtype=np.float32)
    carried = (inputs != begin).astype(np.float32)[:, :, None]
    for t in range(len(inputs)):
        h = h * carried[t]
        g = h @ p["recur"]
        zr = given[t, :, : 2 * n] + g[:, : 2 * n]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :n], zr[:, n:]
        new = r * g[:, 2 * n :]
        new += given[t, :, 2 * n :]
        np.tanh(new, out=new)
        if keep is not None:
            keep.append((carried[t], h, g, z, r, new))
        h = np.subtract(h, new, out=out[t])
        h *= z
        h += new
    return out


def _exp(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, in place of the logits, and their sums by row. No logit comes near the bound; it only keeps float32 finite."""
    e = np.exp(np.minimum(logits, 60, out=logits), out=logits)
    return e, e @ np.ones(e.shape[1], dtype=e.dtype)


def _by_class(shape: Shape, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice, np.ndarray]]]:
    """The class of each target; the rows sorted by class; and for each class of own words its part of them and the members."""
    group = np.minimum(y // shape.members, shape.classes)
    order = np.argsort(group.astype(np.int16), kind="stable")
    edges = np.searchsorted(group[order], np.arange(shape.classes + 1))
    order = order[: edges[-1]]
    member = y[order] - group[order] * shape.members
    parts = [slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return group, order, [(c, at, member[at]) for c, at in enumerate(parts) if at.start < at.stop]


def _log_shares(p: Params, shape: Shape, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of each target (of its class alone for other words)."""
    group, order, parts = _by_class(shape, y)
    logits = h @ p["to_class"] + p["class_bias"]
    score = logits[np.arange(len(y)), group] - np.log(_exp(logits)[1])
    own, inside = h[order], np.empty(len(order), dtype=score.dtype)
    for c, at, member in parts:
        logits = own[at] @ p["to_word"][c].T
        logits += p["word_bias"][c]
        inside[at] = logits[np.arange(len(member)), member] - np.log(_exp(logits)[1])
    score[order] += inside
    return score


def _output_gradient(p: Params, shape: Shape, h: np.ndarray, y: np.ndarray, grad: Params) -> np.ndarray:
    """d loss / d h; the gradients of the output parameters are put into ``grad``."""
    group, order, parts = _by_class(shape, y)
    share, total = _exp(h @ p["to_class"] + p["class_bias"])
    share /= total[:, None]
    share[np.arange(len(y)), group] -= 1
    dh = share @ p["to_class"].T
    grad["to_class"], grad["class_bias"] = h.T @ share, share.sum(axis=0)
    grad["to_word"], grad["word_bias"] = np.zeros_like(p["to_word"]), np.zeros_like(p["word_bias"])
    sorted_h = h[order]
    inside = np.empty_like(sorted_h)
    for c, at, member in parts:
        own = sorted_h[at]
        logits = own @ p["to_word"][c].T
        logits += p["word_bias"][c]
        share, total = _exp(logits)
        share /= total[:, None]
        share[np.arange(len(member)), member] -= 1
        np.matmul(share, p["to_word"][c], out=inside[at])
        grad["to_word"][c], grad["word_bias"][c] = share.T @ own, share.sum(axis=0)
    dh[order] += inside
    return dh


def score_texts(p: Params, shape: Shape, texts: list[np.ndarray], n_lanes: int = 512, steps: int = 16) -> np.ndarray:
    """Sum of natural log probabilities of each text; the state is carried from window to window."""
    total = np.zeros(len(texts))
    h = np.zeros((0, shape.hidden), dtype=np.float32)
    for running, x, y, owner in windows(texts, shape, n_lanes, steps):
        h = np.zeros((running, shape.hidden), np.float32) if not len(h) else h[:running]
        states = _steps(p, x, shape.begin, h, None)
        h = states[-1]
        real = owner >= 0
        score = _log_shares(p, shape, states[real], y[real])
        total += np.bincount(owner[real], weights=score, minlength=len(texts))
    return total


class Trainer:
    """Adagrad on windows of ``steps``; the state goes on, gradients stop at the window's begin.

    The first ``warm_up`` updates are smaller, as the squares of few gradients say little. The state is carried through
    every text, however long.
    """

    warm_up, least_lanes, most_steps = 20, 16, 64

    def __init__(self, p: Params, shape: Shape, rate: float = 0.2, n_lanes: int = 512, steps: int = 16) -> None:
        self.p = {k: v.copy() for k, v in p.items()}
        self.seen = {k: np.full_like(v, 1e-6) for k, v in p.items()}
        self.shape, self.rate, self.n_lanes, self.steps, self.tokens = shape, rate, n_lanes, steps, 0
        self.updates, self.full = 0, n_lanes * steps

    def learn(self, texts: list[np.ndarray]) -> None:
        # So many lanes that they end nearly together: a long text must not go on alone. Fewer lanes take longer windows.
        sizes = [len(t) for t in texts]
        n_lanes = min(self.n_lanes, max(self.least_lanes, sum(sizes) // max(sizes, default=1)))
        steps = min(self.most_steps, max(self.steps, self.n_lanes * self.steps // n_lanes))
        self.full = n_lanes * steps
        h = np.zeros((0, self.shape.hidden), dtype=np.float32)
        for running, x, y, owner in windows(texts, self.shape, n_lanes, steps):
            h = np.zeros((running, self.shape.hidden), np.float32) if not len(h) else h[:running]
            h = self._window(x, y, owner >= 0, h)

    def _window(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, h: np.ndarray) -> np.ndarray:
        p, grad, keep = self.p, {}, []
        self.updates += 1
        states = _steps(p, x, self.shape.begin, h, keep)
        dh_real = _output_gradient(p, self.shape, states[real], y[real], grad)
        full = self.full  # windows in which few lanes still run count for less
        self.tokens += len(dh_real)
        d_states = np.zeros_like(states)
        d_states[real] = dh_real
        n = self.shape.hidden
        d_given = np.empty((*x.shape, 3 * n), dtype=np.float32)
        back = np.zeros_like(h)
        carried, before, g, z, r, new = map(np.stack, zip(*keep))
        # What does not wait for the later steps is taken out of the loop; products keep their order, and so their rounding.
        new_z, new_sq, moved, new_r, gated = 1 - z, 1 - new * new, before - new, 1 - r, g[:, :, 2 * n :].copy()
        recur, back_by = np.zeros_like(p["recur"]), p["recur"].T
        d_gates = np.empty_like(d_given)
        for t in range(len(x) - 1, -1, -1):
            dh = d_states[t]
            dh += back
            dg, d_new = d_gates[t], dh * new_z[t]
            d_new *= new_sq[t]
            d_z = dh * moved[t]
            d_z *= z[t]
            np.multiply(d_z, new_z[t], out=dg[:, :n])
            d_r = d_new * gated[t]
            d_r *= r[t]
            np.multiply(d_r, new_r[t], out=dg[:, n : 2 * n])
            np.multiply(d_new, r[t], out=dg[:, 2 * n :])
            d_given[t, :, 2 * n :] = d_new
            recur += before[t].T @ dg
            back = dg @ back_by
            dh *= z[t]
            back += dh
            back *= carried[t]
        d_given[:, :, : 2 * n] = d_gates[:, :, : 2 * n]
        grad["recur"] = recur
        for k, g in grad.items():
            self._step(k, slice(None), g / full)
        order = np.argsort(x, axis=None, kind="stable")
        rows = x.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        sums = np.add.reduceat(d_given.reshape(-1, 3 * n)[order], first, axis=0)
        self._step("table", rows[first], sums / full)
        return states[-1]

    def _step(self, name: str, at, g: np.ndarray) -> None:
        self.seen[name][at] += g * g
        rate = self.rate * min(1.0, self.updates / self.warm_up)
        self.p[name][at] -= rate * g / np.sqrt(self.seen[name][at])
