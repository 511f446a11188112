"""A gated recurrent network with a class-factored output layer, in numpy."""

from __future__ import annotations

import numpy as np

F32 = np.float32
_PARTS = ("table", "recur", "classes", "class_bias", "words", "word_bias")


#: Rows whose outputs are held at once, so that they stay in a core's cache.
_ROWS = 2048
#: Below this no float32 exponential overflows, so that a row's maximum needn't be taken off.
_SAFE = 80.0


def _chosen(h: np.ndarray, weights: np.ndarray, target: np.ndarray, shift: bool, grad: bool) -> tuple:
    """log softmax(h weights') at each row's target; with `grad` the gradients of the negated sum, by weights and by h."""
    s = h @ weights.T
    if shift:
        s -= s.max(axis=1, keepdims=True)
    at = (np.arange(len(h)), target)
    out = s[at].astype(np.float64)
    np.exp(s, out=s)
    total = s @ np.ones(s.shape[1], F32)
    out -= np.log(total)
    if not grad:
        return out, None, None
    s *= (1 / total)[:, None]
    s[at] -= 1
    return out, s.T @ h, s @ weights[:, :-1]


def _order(numbers: np.ndarray, below: int) -> np.ndarray:
    """Stable order of numbers from 0 to below-1; numpy sorts 16 bits by radix."""
    return np.argsort(numbers.astype(np.uint16) if below <= 1 << 16 else numbers, kind="stable")


class Recurrent:
    """log P(symbol | symbols before) = log P(class | state) + log P(word | class, state).

    Input symbols 0 to len(word_class)-1 are words that have an output of their own within their class;
    the symbols after these stand for the classes of all other words and for the end, whose class
    alone is predicted. `word_class` gives each word's class (ascending); class_mass and word_mass are the
    counts that the biases start from, so that an untrained network gives class and word frequencies.
    """

    def __init__(self, word_class: np.ndarray, word_mass: np.ndarray, class_mass: np.ndarray, inputs: int, hidden: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.word_class, self.hidden = word_class, hidden
        self.cuts = np.searchsorted(word_class, np.arange(len(class_mass) + 1))
        self.table = (rng.standard_normal((inputs, 3 * hidden)) * 0.3).astype(F32)
        self.recur = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(F32)
        self.classes = np.zeros((len(class_mass), hidden), F32)
        self.class_bias = np.log(class_mass + 0.1).astype(F32)
        self.words = np.zeros((len(word_class), hidden), F32)
        self.word_bias = np.log(word_mass + 0.1).astype(F32)

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).ravel() for p in _PARTS])

    def load(self, flat: np.ndarray) -> Recurrent:
        at = 0
        for p in _PARTS:
            a = getattr(self, p)
            setattr(self, p, flat[at : at + a.size].reshape(a.shape).astype(F32))
            at += a.size
        return self

    def states(self, symbols: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None, kept: list | None = None) -> np.ndarray:
        """States after each of `symbols` (time, lane), from h (lane, hidden); where `fresh`, from nothing.

        Inside, lanes come last, so that each gate is one block. `kept` gets the states before, both gates, the
        candidates, and the candidates' recurrent part, as (time, unit, lane) each.
        """
        n, (steps, lanes) = self.hidden, symbols.shape
        half = np.repeat(np.array([0.5, 1], F32), [2 * n, n])  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        x = np.ascontiguousarray((self.table * half)[symbols].transpose(0, 2, 1))
        recur, h = np.ascontiguousarray((self.recur * half).T), np.ascontiguousarray(h.T)
        old = None if fresh is None else (~fresh).astype(F32)
        out = np.empty((steps, n, lanes), F32)
        if kept is not None:
            kept += [np.empty((steps, k * n, lanes), F32) for k in (1, 2, 1, 1)]
        for t in range(steps):
            if old is not None and fresh[t].any():
                h = h * old[t]
            g = recur @ h
            gates, c = g[: 2 * n], g[2 * n :]
            gates += x[t, : 2 * n]
            np.tanh(gates, out=gates)
            gates *= F32(0.5)
            gates += F32(0.5)
            if kept is not None:
                kept[0][t], kept[1][t], kept[3][t] = h, gates, c
            c *= gates[n:]
            c += x[t, 2 * n :]
            np.tanh(c, out=c)
            if kept is not None:
                kept[2][t] = c
            c -= h
            c *= gates[:n]
            h = np.add(h, c, out=out[t])
        return out.transpose(0, 2, 1)

    def log_probability(self, h: np.ndarray, classes: np.ndarray, words: np.ndarray, grad: dict | None = None) -> np.ndarray:
        """Natural log P of each target's class and, where words >= 0, of the word in it, from states h (rows).

        `grad` gets the gradients of the summed negative log-likelihood, of `h` too.
        """
        n, some = len(h), grad is not None
        h = np.concatenate((h, np.ones((n, 1), F32)), axis=1, dtype=F32)
        by_class, by_word = (np.concatenate((w, b[:, None]), axis=1) for w, b in ((self.classes, self.class_bias), (self.words, self.word_bias)))
        largest = np.abs(h).max(initial=1) * max(np.abs(w).sum(axis=1).max(initial=0) for w in (by_class, by_word))
        shift = not largest < _SAFE
        out = np.empty(n)
        dh, d_class, d_word = (np.zeros(a, F32) if some else None for a in ((n, self.hidden), by_class.shape, by_word.shape))
        for lo in range(0, n, _ROWS):
            rows = slice(lo, lo + _ROWS)
            out[rows], d, back = _chosen(h[rows], by_class, classes[rows], shift, some)
            if some:
                d_class += d
                dh[rows] = back
        own = np.flatnonzero(words >= 0)
        own = own[_order(words[own], len(self.words))]  # by class, too
        sorted_h, word, found = h[own], words[own], np.zeros(len(own))
        ends = np.searchsorted(word, self.cuts)
        sorted_dh = np.zeros((len(own), self.hidden), F32) if some else None
        for k in np.flatnonzero(np.diff(ends)):
            b, e = self.cuts[k : k + 2]
            if e - b == 1:
                continue
            for lo in range(ends[k], ends[k + 1], 4 * _ROWS):
                rows = slice(lo, min(lo + 4 * _ROWS, ends[k + 1]))
                found[rows], d, back = _chosen(sorted_h[rows], by_word[b:e], word[rows] - b, shift, some)
                if some:
                    d_word[b:e] += d
                    sorted_dh[rows] = back
        out[own] += found
        if some:
            dh[own] += sorted_dh
            grad |= {"classes": d_class[:, :-1], "class_bias": d_class[:, -1], "words": d_word[:, :-1], "word_bias": d_word[:, -1], "h": dh}
        return out

    def gradients(self, symbols, fresh, classes, words, real, h) -> tuple[dict, np.ndarray, float]:
        """Backpropagation through one window (time, lane) that begins with states h, as if these were given."""
        kept: list = []
        states = self.states(symbols, h, fresh, kept)
        grad: dict = {}
        loss = -self.log_probability(states[real], classes[real], words[real], grad).sum()
        d_states = np.zeros(states.shape, F32)
        d_states[real] = grad.pop("h")
        d_states = np.ascontiguousarray(d_states.transpose(0, 2, 1))
        n, (before, gates, c, g) = self.hidden, kept
        z, r, old = gates[:, :n], gates[:, n:], (~fresh).astype(F32)
        stay = 1 - z
        to_c, to_z, to_r = z * (1 - c * c), (c - before) * z * stay, g * r * (1 - r)
        d_in, d_last = np.empty((len(symbols), 3 * n, symbols.shape[1]), F32), np.empty_like(before)
        d_next = np.zeros_like(before[0])
        first, last = np.ascontiguousarray(self.recur[:, : 2 * n]), np.ascontiguousarray(self.recur[:, 2 * n :])
        for t in range(len(symbols) - 1, -1, -1):
            d = d_next
            d += d_states[t]
            d_c = np.multiply(d, to_c[t], out=d_in[t, 2 * n :])
            np.multiply(d, to_z[t], out=d_in[t, :n])
            np.multiply(d_c, to_r[t], out=d_in[t, n : 2 * n])
            np.multiply(d_c, r[t], out=d_last[t])
            d_next = first @ d_in[t, : 2 * n]
            d_next += last @ d_last[t]
            d *= stay[t]
            d_next += d
            if fresh[t].any():
                d_next *= old[t]
        grad["recur"] = np.concatenate([(before @ d.transpose(0, 2, 1)).sum(axis=0) for d in (d_in[:, : 2 * n], d_last)], axis=1)
        flat, rows = symbols.ravel(), d_in.transpose(0, 2, 1).reshape(-1, 3 * n)
        order = _order(flat, len(self.table))
        begins = np.flatnonzero(np.diff(flat[order], prepend=-1))
        grad["table"] = np.zeros_like(self.table)
        grad["table"][flat[order[begins]]] = np.add.reduceat(rows[order], begins, axis=0)
        return grad, states[-1], loss


class Adam:
    def __init__(self, net: Recurrent, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {p: np.zeros_like(getattr(net, p)) for p in _PARTS}
        self.v = {p: np.zeros_like(getattr(net, p)) for p in _PARTS}

    def step(self, grad: dict, scale: float, longest: float = 5.0) -> None:
        self.t += 1
        norm = scale * np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale *= min(1.0, longest / max(norm, 1e-12))
        rate = F32(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for p, g in grad.items():
            m, v, g = self.m[p], self.v[p], g * F32(scale)
            m *= F32(0.9)
            m += g * F32(0.1)
            v *= F32(0.999)
            g *= g
            g *= F32(0.001)
            v += g
            np.sqrt(v, out=g)
            g += F32(1e-8)
            np.divide(m, g, out=g)
            g *= rate
            getattr(self.net, p)[...] -= g


def train(net: Recurrent, adam: Adam, symbols: np.ndarray, classes: np.ndarray, words: np.ndarray, bounds: np.ndarray, lanes: int = 64, window: int = 32) -> tuple[float, int]:
    """Truncated backpropagation over texts that follow each other (each token's input, class and word; text i is
    bounds[i] to bounds[i+1]), dealt to equal lanes.

    A lane's state is carried from window to window and forgotten where a text begins. Gives the summed
    negative log-likelihood and the number of tokens.
    """
    n = len(symbols)
    if not n:
        return 0.0, 0
    lanes = max(1, min(lanes, n // window))
    steps = -(-n // lanes)
    fresh, real = np.zeros(lanes * steps, bool), np.arange(lanes * steps) < n
    fresh[bounds[:-1][np.diff(bounds) > 0]] = True
    grid = [np.concatenate((a, np.zeros(lanes * steps - n, a.dtype))).reshape(lanes, steps).T for a in (symbols, classes, words)]
    fresh, real = fresh.reshape(lanes, steps).T, real.reshape(lanes, steps).T
    h, loss = np.zeros((lanes, net.hidden), F32), 0.0
    for t in range(0, steps, window):
        part = slice(t, t + window)
        grad, h, own = net.gradients(*(a[part] for a in (grid[0], fresh, grid[1], grid[2], real)), h)
        adam.step(grad, 1 / max(1, real[part].sum()))
        loss += own
    return loss, n


def score(net: Recurrent, symbols: np.ndarray, classes: np.ndarray, words: np.ndarray, bounds: np.ndarray, lanes: int = 1024, window: int = 32) -> np.ndarray:
    """Natural log-likelihood of each whole text; texts of like length go side by side, the state is carried across windows."""
    size = np.diff(bounds)
    out = np.zeros(len(size))
    order = np.argsort(-size, kind="stable")
    for lo in range(0, len(order), lanes):
        own = order[lo : lo + lanes]
        left, start, h = size[own], bounds[own], np.zeros((len(own), net.hidden), F32)
        for t in range(0, int(left[0]), window):
            n = int(np.searchsorted(-left, -t, "left"))  # texts longer than t
            step = np.arange(t, min(t + window, int(left[0])))[:, None]
            real = step < left[:n]
            at = np.where(real, start[:n] + step, 0)
            states = net.states(symbols[at], h[:n])
            found = np.zeros(real.shape)
            found[real] = net.log_probability(states[real], classes[at[real]], words[at[real]])
            out[own[:n]] += found.sum(axis=0)
            h = states[-1]
    return out
