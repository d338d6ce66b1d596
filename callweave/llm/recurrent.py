"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

Symbols 0 .. shortlist - 1 are frequent tokens; the symbols after them are bands of rarer tokens. The output factors
into a class given the state and a token given class and state. Classes are runs of ``CLASS`` shortlist symbols, so a
probability costs two small softmaxes; a band is a class of its own, whose members the caller tells apart.

Documents lie one after another in lanes, and all lanes advance together. A document starts from a zero state, which is
then carried over the windows to its last token. Arrays of a step are (features, lanes): gates are contiguous rows.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, CLASS, WINDOW, LANES = 16, 64, 16, 512
#: Logits below this can't overflow in float32, so that no maximum need be taken off first.
SAFE = 80.0
F = np.float32
ONES = np.ones(1 << 12, F)


class Gru:
    NAMES = ("wx", "uzr", "un", "wc", "wo")

    def __init__(self, unigram: np.ndarray, shortlist: int, hidden: int = HIDDEN, seed: int = 7):
        """unigram: the probability of each symbol, with which the output starts."""
        rng, n = np.random.default_rng(seed), len(unigram)
        self.hidden, self.shortlist, self.symbols = hidden, shortlist, n
        self.full = -(-shortlist // CLASS)
        self.classes = self.full + n - shortlist
        self.class_of = np.concatenate((np.arange(shortlist) // CLASS, self.full + np.arange(n - shortlist))).astype(np.uint16)
        p = np.maximum(unigram, 1e-12)
        mass = np.bincount(self.class_of, p, self.classes)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(F)
        self.wx, self.uzr, self.un = small(n, 3 * hidden), small(2 * hidden, hidden), small(hidden, hidden)
        # the last row of wc and wo is the bias: states come with a one at their end
        self.wc, self.wo = small(hidden + 1, self.classes) * F(0.1), small(self.full, hidden + 1, CLASS) * F(0.1)
        self.wc[-1] = np.log(mass / mass.sum())
        bias = np.full(self.full * CLASS, -30, F)
        bias[:shortlist] = np.log(p[:shortlist] / mass[self.class_of[:shortlist]])
        self.wo[:, -1] = bias.reshape(-1, CLASS)
        self.past: list[np.ndarray] | None = None

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, k) for k in self.NAMES]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, w in zip(self.NAMES, self.weights(), strict=True):
            setattr(self, k, flat[at : at + w.size].astype(F).reshape(w.shape))
            at += w.size

    def states(self, x: np.ndarray, start: np.ndarray, h: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(state after each step, last state), states (steps, hidden, lanes), for inputs x (steps, lanes); start marks
        the first token of a document. ``keep`` takes what the way back needs."""
        k, (steps, lanes) = self.hidden, x.shape
        a = np.ascontiguousarray(self.wx[x].transpose(0, 2, 1))
        out, starts = np.empty((steps, k, lanes), F), start.any(axis=1)
        if keep is not None:
            keep.update({name: np.empty((steps, k, lanes), F) for name in ("h", "z", "r", "n", "rh")})
        for t in range(steps):
            if starts[t]:
                h = h * ~start[t]
            g = self.uzr @ h
            g += a[t, : 2 * k]
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += F(1)
            np.reciprocal(g, out=g)
            z, r = g[:k], g[k:]
            rh = r * h
            n = self.un @ rh
            n += a[t, 2 * k :]
            np.tanh(n, out=n)
            if keep is not None:
                keep["h"][t], keep["z"][t], keep["r"][t], keep["n"][t], keep["rh"][t] = h, z, r, n, rh
            n = n - h
            n *= z
            h = np.add(h, n, out=out[t])
        return out, h

    def _softmax(self, s: np.ndarray, w: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
        """(exponentials of the logits, their sums) of states s (positions, hidden + 1)."""
        e = s @ w
        if not safe:
            e -= e.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        return e, e @ ONES[: e.shape[1]]

    def _safe(self) -> bool:
        """Whether no logit can overflow: states lie within -1 .. 1."""
        return max(float(np.abs(w).sum(axis=-2).max(initial=0)) for w in (self.wc, self.wo)) < SAFE

    def _groups(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(classes, positions in order of their class, end of each full class among them)."""
        c = self.class_of[y]
        order = np.argsort(c, kind="stable")  # 16 bits: a radix sort
        return c, order, np.searchsorted(c[order], np.arange(self.full + 1))

    def _places(self, y: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For y in order of class: the place of each among the flat logits of its class."""
        at = np.arange(len(y))
        return (at - np.repeat(np.append(ends[:-1], ends[-1]), np.diff(np.append(ends, len(y))))) * CLASS + y % CLASS

    def log_probabilities(self, s: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each symbol y given the state before it, s (positions, hidden + 1)."""
        safe = self._safe()
        c, order, ends = self._groups(y)
        e, total = self._softmax(s, self.wc, safe)
        p = np.maximum(e.ravel()[np.arange(len(y)) * self.classes + c], 1e-37) / total
        so, place = s[order], self._places(y[order], ends)
        inner = np.ones(len(y), F)
        for k in range(self.full):
            a, b = ends[k], ends[k + 1]
            if a < b:
                e, total = self._softmax(so[a:b], self.wo[k], safe)
                inner[a:b] = np.maximum(e.ravel()[place[a:b]], 1e-37) / total
        out = np.log(p)
        out[order] += np.log(inner)
        return out

    def score(self, docs: list[np.ndarray], lanes: int = LANES, window: int = 64) -> np.ndarray:
        """The natural log probability of each whole document (its symbols, the end included)."""
        total = np.zeros(len(docs), np.float64)
        for x, y, doc in _lanes(docs, lanes):
            h = np.zeros((self.hidden, x.shape[1]), F)
            width = (doc >= 0).sum(axis=0)  # lanes are sorted, longest first
            for t in range(0, len(x), window):
                live = int((width > t).sum())
                xs, ys, ds = x[t : t + window, :live], y[t : t + window, :live], doc[t : t + window, :live]
                s, h = self.states(xs, _first(doc, t, ds), np.ascontiguousarray(h[:, :live]))
                at = ds >= 0
                total += np.bincount(ds[at], self.log_probabilities(_ended(s)[at], ys[at]), len(docs))
        return total

    def train(self, docs: list[np.ndarray], rate: float = 0.1, lanes: int = LANES, window: int = WINDOW) -> int:
        """One pass of truncated backpropagation with Adagrad over ``docs``; returns the number of tokens. Adagrad's sums
        go on from call to call."""
        k, seen, held = self.hidden, 0, 0
        if not docs:
            return 0
        if self.past is None:
            self.past = [np.full(w.shape, 1e-2, F) for w in self.weights()]
        due = [np.zeros(w.shape, F) for w in self.weights()]
        gwx, guzr, gun, gwc, gwo = due
        touched = np.zeros(self.symbols, bool)

        def descend(w: np.ndarray, g: np.ndarray, past: np.ndarray, scale: F) -> None:
            g = np.clip(g * scale, -1, 1)
            past += g * g
            w -= F(rate) * g / np.sqrt(past)

        def step(n: int) -> None:
            scale = F(window / max(1, n))
            rows = np.flatnonzero(touched)
            w, g, p = self.wx[rows], gwx[rows], self.past[0][rows]
            descend(w, g, p, scale)
            self.wx[rows], self.past[0][rows], gwx[rows] = w, p, 0
            touched[rows] = False
            for w, g, p in zip(self.weights()[1:], due[1:], self.past[1:], strict=True):
                descend(w, g, p, scale)
                g.fill(0)

        for x, y, doc in _lanes(docs, lanes, late=True):  # the last steps are those with all lanes, not the longest document's
            h = np.zeros((k, x.shape[1]), F)
            begin = len(x) - (doc >= 0).sum(axis=0)
            for t0 in range(0, len(x), window):
                live = int((begin < t0 + window).sum())
                xs, ys, ds = x[t0 : t0 + window, :live], y[t0 : t0 + window, :live], doc[t0 : t0 + window, :live]
                first, kept = _first(doc, t0, ds), {}
                s, h[:, :live] = self.states(xs, first, np.ascontiguousarray(h[:, :live]), kept)
                at = ds >= 0
                full = bool(at.all())
                ended = _ended(s)
                flat_s, flat_y = (ended.reshape(-1, k + 1), ys.ravel()) if full else (ended[at], ys[at])
                n = len(flat_y)
                seen += n
                got = self._output_gradients(flat_s, flat_y, gwc, gwo)
                if full:
                    d = got.reshape(len(xs), live, k)
                else:
                    d = np.zeros((len(xs), live, k), F)
                    d[at] = got
                d = np.ascontiguousarray(d.transpose(0, 2, 1))
                hp, z, r, m, rh = (kept[name] for name in ("h", "z", "r", "n", "rh"))
                # what the gradient of a state is multiplied by does not depend on it: one product for the whole window
                stay = F(1) - z
                to_n, to_z, to_r = z * (F(1) - m * m), (m - hp) * z * stay, hp * r * (F(1) - r)
                ends = first.any(axis=1)
                gx, un_t, uzr_t = np.empty((len(xs), 3 * k, live), F), self.un.T, self.uzr.T
                back = np.zeros((k, live), F)
                for t in range(len(xs) - 1, -1, -1):
                    g, dh = gx[t], d[t]
                    dh += back
                    dan = np.multiply(dh, to_n[t], out=g[2 * k :])
                    drh = un_t @ dan
                    np.multiply(dh, to_z[t], out=g[:k])
                    np.multiply(drh, to_r[t], out=g[k : 2 * k])
                    back = uzr_t @ g[: 2 * k]
                    dh *= stay[t]
                    back += dh
                    drh *= r[t]
                    back += drh
                    if ends[t]:
                        back *= ~first[t]
                gun += np.matmul(gx[:, 2 * k :], rh.transpose(0, 2, 1)).sum(axis=0)
                guzr += np.matmul(gx[:, : 2 * k], hp.transpose(0, 2, 1)).sum(axis=0)
                flat_x = xs.ravel()
                order = np.argsort(flat_x, kind="stable")
                sorted_x = flat_x[order]
                begins = np.flatnonzero(np.concatenate(([True], sorted_x[1:] != sorted_x[:-1])))
                rows = sorted_x[begins]
                gwx[rows] += np.add.reduceat(gx.transpose(0, 2, 1).reshape(-1, 3 * k)[order], begins, axis=0)
                touched[rows] = True
                held += n
                if held >= lanes * window // 2 or t0 + window >= len(x):  # where few lanes are left, gradients gather
                    step(held)
                    held = 0
        return seen

    def _output_gradients(self, s: np.ndarray, y: np.ndarray, gwc: np.ndarray, gwo: np.ndarray) -> np.ndarray:
        """The gradient of the states s (positions, hidden + 1); those of the output's weights are added to gwc, gwo."""
        safe, k = self._safe(), self.hidden
        c, order, ends = self._groups(y)
        p, total = self._softmax(s, self.wc, safe)
        p *= np.reciprocal(total)[:, None]
        p.ravel()[np.arange(len(y)) * self.classes + c] -= 1
        gwc += s.T @ p
        d = p @ self.wc[:k].T
        so, place = s[order], self._places(y[order], ends)
        inner = np.zeros((len(y), k), F)
        for j in range(self.full):
            a, b = ends[j], ends[j + 1]
            if a < b:
                p, total = self._softmax(so[a:b], self.wo[j], safe)
                p *= np.reciprocal(total)[:, None]
                p.ravel()[place[a:b]] -= 1
                gwo[j] += so[a:b].T @ p
                np.matmul(p, self.wo[j, :k].T, out=inner[a:b])
        d[order] += inner
        return d


def _ended(s: np.ndarray) -> np.ndarray:
    """States (steps, hidden, lanes) as (steps, lanes, hidden + 1) with a one at the end of each."""
    out = np.ones((s.shape[0], s.shape[2], s.shape[1] + 1), F)
    out[:, :, :-1] = s.transpose(0, 2, 1)
    return out


def _first(doc: np.ndarray, t: int, ds: np.ndarray) -> np.ndarray:
    """Where a document begins in the window ``ds``, which starts at step t of ``doc``."""
    first = np.empty(ds.shape, bool)
    first[1:] = ds[1:] != ds[:-1]
    first[0] = True if t == 0 else ds[0] != doc[t - 1, : ds.shape[1]]
    return first


def _lanes(docs: list[np.ndarray], lanes: int, late: bool = False):
    """(inputs, targets, document numbers), each (steps, lanes); -1 marks unused places. The input of a document's first
    token is symbol 0. Longest documents are dealt first, each to the shortest lane; lanes come longest first."""
    if not docs:
        return
    lanes = min(lanes, len(docs))
    heap, dealt = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        n, k = heapq.heappop(heap)
        dealt[k].append(i)
        heapq.heappush(heap, (n + len(docs[i]), k))
    size = [sum(len(docs[i]) for i in d) for d in dealt]
    order = sorted(range(lanes), key=lambda k: -size[k])
    steps = max(size)
    x, y, doc = np.zeros((steps, lanes), np.uint16), np.zeros((steps, lanes), np.uint16), np.full((steps, lanes), -1, np.int32)
    for col, k in enumerate(order):
        at = steps - size[k] if late else 0
        for i in dealt[k]:
            n = len(docs[i])
            y[at : at + n, col], doc[at : at + n, col] = docs[i], i
            x[at + 1 : at + n, col] = docs[i][:-1]
            at += n
    yield x, y, doc
