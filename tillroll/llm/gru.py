"""A gated recurrent language model in numpy.

The hidden state is a GRU whose input projection is a table (one row per
word), so a step is one product with the recurrent matrix.  The output is
class-factored: words are dealt by frequency into ``classes`` classes of
``per_class`` words, p(w) = p(class) p(w | class).  Training is truncated
backpropagation: gradients stay within a window of ``WINDOW`` tokens, the
state is carried on from window to window to the end of the text.  Scoring
carries the state the same way, so a text of any length is scored whole.
"""

from __future__ import annotations

import numpy as np

HIDDEN, WINDOW, RATE, LANES = 16, 32, 0.06, 1024
#: Tokens behind one step of the optimiser.
STEP = 1024
#: Rows of logits taken at once, so that they stay in a core's cache.
ROWS = 1 << 12
#: Tokens that scoring gathers from narrow windows before it takes their outputs.
GROUP = 1 << 14
#: Steps over which the rate rises.
WARM = 24


def initial(counts: np.ndarray, classes: int, per_class: int, hidden: int = HIDDEN,
            seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters; the output starts at the unigram frequencies ``counts``
    (one per word, padded to classes * per_class)."""
    rng = np.random.default_rng(seed)
    c = np.zeros(classes * per_class)
    c[: len(counts)] = counts
    c = c.reshape(classes, per_class) + 0.5
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    return {"emb": small(classes * per_class, 3 * hidden), "rec": small(hidden, 3 * hidden),
            "bias": np.zeros(3 * hidden, np.float32), "wc": small(hidden, classes),
            "bc": np.log(c.sum(1) / c.sum()).astype(np.float32), "ww": small(classes, hidden, per_class),
            "bw": np.log(c / c.sum(1, keepdims=True)).astype(np.float32)}


def _softmax(z: np.ndarray, y: np.ndarray, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of ``y`` in each row of logits, the rows' sums); ``z``
    becomes its exponentials.  Rows are shifted only where they could leave
    the range of single precision; with no logit above ``bound`` in size they
    need not be searched for that."""
    if len(z) and not bound < 79 and (z.max() > 80 or z.min() < -80):
        z -= z.max(axis=1, keepdims=True)
    out = z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + y]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    return out - np.log(total), total


def _down(z: np.ndarray, total: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient of the log probability by the logits, from ``_softmax``."""
    z *= (-1 / total)[:, None]
    z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + y] += 1
    return z


class Lanes:
    """Texts laid end to end on ``LANES`` lanes of nearly equal length, so
    that every step works on a full batch.  The state starts anew with each
    text; the end token of the text before is its first input."""

    def __init__(self, texts: list[np.ndarray], end: int):
        import heapq
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        n = max(1, min(LANES, len(texts), int(size.sum()) // 1024))
        heap = [(0, j) for j in range(n)]
        start, lane = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        for i in order.tolist():
            used, j = heapq.heappop(heap)
            start[i], lane[i] = used, j
            heapq.heappush(heap, (used + int(size[i]), j))
        long_ = np.zeros(n, np.int64)
        for used, j in heap:
            long_[j] = used
        rank = np.argsort(-long_, kind="stable")         # longest lane first: what runs at any step is a prefix
        self.length = long_[rank]
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        lane = place[lane]
        self.steps = int(self.length[0])
        flat = np.concatenate(texts)
        owner = np.repeat(np.arange(len(texts)), size)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + start[owner]
        # lane after lane, so that memory follows the tokens, however long one lane is
        self.base = np.cumsum(self.length) - self.length
        self.end = end
        at += self.base[lane[owner]]
        self.y = np.empty(len(flat), np.int32)
        self.y[at] = flat
        self.owner = np.empty(len(flat), np.int32)
        self.owner[at] = owner
        self.new = np.zeros(len(flat), bool)
        self.new[self.base[lane] + start] = True
        self.texts = len(texts)

    def windows(self):
        """(inputs, targets, mask, owner, starts), all (time, lane)."""
        for lo in range(0, self.steps, WINDOW):
            n = int(np.searchsorted(-self.length, -lo, "left"))
            step = np.arange(lo, lo + WINDOW)[:, None]
            mask = step < self.length[:n]
            at = np.minimum(self.base[:n] + step, len(self.y) - 1)
            y = np.where(mask, self.y[at], -1)
            x = np.where(step <= self.length[:n], self.y[at - (step > 0)], 0)
            if lo == 0:
                x[0] = self.end
            yield x, y, mask, np.where(mask, self.owner[at], -1), self.new[at] & mask


def _ready(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Input and recurrent weights by gate, (3, ..., hidden) each, so that what
    a step does to a gate runs over one block of memory; those of the two
    sigmoids with the sign that the exponential takes."""
    both = tuple(np.ascontiguousarray(np.moveaxis(m.reshape(len(m), 3, -1), 1, 0)) for m in (p["emb"] + p["bias"], p["rec"]))
    for m in both:
        np.negative(m[:2], out=m[:2])
    return both


def _steps(ready: tuple, x: np.ndarray, new_text: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
    """States after each of the (time, lane) inputs ``x``; with ``keep`` also
    the states before them, the gates with the candidate, and the candidate's
    recurrent part."""
    table, weights = ready
    out = np.empty((len(x), *h.shape), h.dtype)
    given = np.take(table, x, axis=1)
    rec, part = np.empty((3, *h.shape), h.dtype), np.empty(h.shape, h.dtype)
    rec_n = np.empty_like(out) if keep else None
    starts = new_text.any(axis=1).tolist()
    last = h
    for t in range(len(x)):
        if starts[t]:
            last = last * ~new_text[t][:, None]
        np.matmul(last, weights, out=rec)
        gates, new = given[:2, t], given[2, t]
        gates += rec[:2]
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        new += np.multiply(gates[1], rec[2], out=part)
        np.tanh(new, out=new)
        if keep:
            rec_n[t] = rec[2]
        after = np.subtract(last, new, out=out[t])
        after *= gates[0]
        after += new
        last = after
    if not keep:
        return out, ()
    before = np.concatenate([h[None], out[:-1]])
    before[new_text] = 0
    return out, (before, given, rec_n)


def _outputs(p: dict, h: np.ndarray, y: np.ndarray, grads: dict | None = None):
    """Log probabilities (natural) of words ``y`` after states ``h``; with
    ``grads`` also adds the output's gradients and returns that of ``h``."""
    per, n = p["bw"].shape[1], h.shape[1]
    cls, word = y // per, y % per
    order = np.argsort(cls.astype(np.int16), kind="stable")
    cls, word = cls[order], word[order]
    one = np.empty((len(y), n + 1), h.dtype)              # a column of ones carries the biases
    one[:, :n], one[:, n] = h[order], 1
    wc = np.vstack([p["wc"], p["bc"]])
    ww = np.concatenate([p["ww"], p["bw"][:, None, :]], axis=1)
    most = max(1.0, float(np.abs(h).max(initial=0)))
    bounds = most * float(np.abs(wc).sum(0).max()), most * float(np.abs(ww).sum(1).max())
    out = np.empty(len(y), h.dtype)
    dh = None
    if grads is not None:
        dh = np.empty_like(h)
        wc_t, ww_t = np.ascontiguousarray(p["wc"].T), np.ascontiguousarray(p["ww"].transpose(0, 2, 1))
    for lo in range(0, len(y), ROWS):
        rows = slice(lo, lo + ROWS)
        a, c = one[rows], cls[rows]
        z = a @ wc
        out[rows], total = _softmax(z, c, bounds[0])
        if grads is not None:
            d = _down(z, total, c)
            g = a.T @ d
            grads["wc"] += g[:n]
            grads["bc"] += g[n]
            np.matmul(d, wc_t, out=dh[rows])
        # words of one class lie together; only the products are taken class by class
        edge = np.flatnonzero(np.diff(c, prepend=-1, append=-1))
        parts = [(k, slice(i, j)) for k, i, j in zip(c[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist())]
        z = np.empty((len(a), per), h.dtype)
        for k, cut in parts:
            np.matmul(a[cut], ww[k], out=z[cut])
        got, total = _softmax(z, word[rows], bounds[1])
        out[rows] += got
        if grads is not None:
            d = _down(z, total, word[rows])
            for k, cut in parts:
                g = a[cut].T @ d[cut]
                grads["ww"][k] += g[:n]
                grads["bw"][k] += g[n]
                dh[rows][cut] += d[cut] @ ww_t[k]
    back = np.empty_like(order)
    back[order] = np.arange(len(y))
    return out[back].astype(np.float64), None if dh is None else dh[back]


def log_probs(p: dict, texts: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log probability of each text (ids that close with ``end``)."""
    if not texts:
        return np.zeros(0)
    lanes = Lanes(texts, end)
    total = np.zeros(len(texts))
    h = np.zeros((len(lanes.length), p["rec"].shape[0]), p["rec"].dtype)
    ready = _ready(p)
    held, size = [], 0

    def finish():
        states, y, owner = map(np.concatenate, zip(*held))
        return np.bincount(owner, _outputs(p, states, y)[0], len(texts))

    for x, y, mask, owner, new in lanes.windows():
        states, _ = _steps(ready, x, new, h[: x.shape[1]], False)
        h = states[-1]
        held.append((states[mask], y[mask], owner[mask]))
        size += len(held[-1][1])
        if size >= GROUP:                                # narrow windows share their outputs
            total += finish()
            held, size = [], 0
    return total + finish() if held else total


class Trainer:
    """Adagrad for one replica's texts, from a given state of the optimiser.  Gradients of successive windows are
    summed until they stand for ``STEP`` tokens, so that the few texts that
    are longer than all others do not make most of the steps."""

    def __init__(self, p: dict, end: int, rate: float = RATE, square: dict | None = None, steps: int = 0):
        self.p = {k: v.copy() for k, v in p.items()}
        self.square = {k: np.full(v.shape, 1e-6, np.float32) if square is None else square[k].copy() for k, v in p.items()}
        self.grad = {k: np.zeros_like(v) for k, v in p.items()}
        self.pending, self.tokens, self.steps = 0, 0, steps
        self.rate, self.end = rate, end

    def step(self) -> None:
        scale = np.float32(1.0 / max(self.pending, STEP))
        self.steps += 1
        rate = self.rate * min(1.0, self.steps / WARM)
        for k, g in self.grad.items():
            g *= scale
            self.square[k] += g * g
            self.p[k] += rate * g / np.sqrt(self.square[k])
            g[:] = 0
        self.pending = 0

    def learn(self, texts: list[np.ndarray]) -> None:
        if not texts:
            return
        lanes = Lanes(texts, self.end)
        h = np.zeros((len(lanes.length), self.p["rec"].shape[0]), self.p["rec"].dtype)
        held, ready = [], None
        for x, y, mask, _, new in lanes.windows():
            ready = ready or _ready(self.p)
            states, kept = _steps(ready, x, new, h[: x.shape[1]], True)
            h = states[-1]
            held.append((x, y, mask, new, states, *kept))
            self.pending += int(mask.sum())
            if self.pending >= STEP:
                self._learn_from(held)
                held, ready = [], None
        if held:
            self._learn_from(held)

    def _learn_from(self, held: list[tuple]) -> None:
        """One step from windows that the same parameters were run over.
        Gradients end at a window's start, so the windows lie side by side."""
        p, g = self.p, self.grad
        x, y, mask, new, states, before, gates, rec_n = (
            part[0] if len(part) == 1 else np.concatenate(part, axis=2 if part[0].ndim == 4 else 1) for part in zip(*held))
        n = states.shape[2]
        dh_out = np.zeros_like(states)
        _, dh_out[mask] = _outputs(p, states[mask], y[mask], g)
        z, r, cand = gates
        # by what a state's gradient goes on to the candidate's recurrent part,
        # the three gates' inputs and the state before
        d = np.empty((5, *states.shape), states.dtype)
        np.multiply(cand, cand, out=d[3])
        np.subtract(1, d[3], out=d[3])
        np.subtract(1, z, out=d[4])
        d[3] *= d[4]
        np.multiply(d[3], r, out=d[0])
        np.subtract(before, cand, out=d[1])
        d[1] *= z
        d[1] *= d[4]
        np.subtract(1, r, out=d[2])
        d[2] *= rec_n
        d[2] *= d[0]
        d[4] = z
        back = np.ascontiguousarray(np.moveaxis(p["rec"].reshape(n, 3, n), 1, 0)[[2, 0, 1]].transpose(0, 2, 1))
        dh = np.zeros(states.shape[1:], states.dtype)
        to = np.empty((3, *dh.shape), states.dtype)
        starts = new.any(axis=1)
        for t in range(len(x) - 1, -1, -1):
            dh += dh_out[t]
            now = d[:, t]
            now *= dh
            np.matmul(now[:3], back, out=to)
            np.add(now[4], to[0], out=dh)
            dh += to[1]
            dh += to[2]
            if starts[t]:
                dh[new[t]] = 0
        of_rec = before.reshape(-1, n).T @ d[:3].reshape(3, -1, n)
        g["rec"] += np.hstack(of_rec[[1, 2, 0]])
        flat, words = np.concatenate(d[1:4].reshape(3, -1, n), axis=1), x.ravel()
        g["bias"] += flat.sum(0)
        order = np.argsort(words.astype(np.int16 if len(p["emb"]) < 1 << 15 else np.int32), kind="stable")
        ranked = words[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        g["emb"][ranked[first]] += np.add.reduceat(flat[order], first, axis=0)
        self.tokens += self.pending
        self.step()
