"""A character-level bidirectional LSTM with CRF transitions in numpy: training, emissions and joint decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters: printable ASCII one by one, then white space, other letters and the rest.
N_CHARS = 95 + 3 + 1
PAD = N_CHARS - 1
_TABLE = np.array([0x5F if c in (9, 10, 11, 12, 13) else c - 32 if 32 <= c < 127 else 0x61 for c in range(128)], np.int16)


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], 0x60).astype(np.int16)  # 0x60: beyond ASCII


@dataclass
class Tagger:
    """Weights: e embeds characters; w, u, b are the gates (i, f, o, g) of both directions, forward first; v, c give tag scores;
    trans[a, b] scores tag b after tag a. The two directions run side by side."""

    p: dict[str, np.ndarray]
    n_tags: int

    def _run(self, x: np.ndarray, keep: bool):
        """States of both directions, each in its own order, from 2 x n x t x dim."""
        w, u, b = self.p["w"], self.p["u"], self.p["b"]
        _, n, t, d = x.shape
        h = u.shape[1]
        z = np.ascontiguousarray((x.reshape(2, n * t, d) @ w + b[:, None]).reshape(2, n, t, 4 * h).transpose(2, 0, 1, 3))
        hs, cs, gates = np.zeros((t + 1, 2, n, h), x.dtype), np.zeros((t + 1, 2, n, h), x.dtype), []
        for i in range(t):
            a = z[i]
            a += hs[i] @ u
            s = 0.5 + 0.5 * np.tanh(0.5 * a[..., : 3 * h])
            g = np.tanh(a[..., 3 * h :])
            cs[i + 1] = s[..., h : 2 * h] * cs[i] + s[..., :h] * g
            tc = np.tanh(cs[i + 1])
            hs[i + 1] = s[..., 2 * h :] * tc
            if keep:
                gates.append((s, g, tc))
        return hs, cs, gates

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """Tag scores of each character of equally long windows (n x t -> n x t x tags)."""
        x = self.p["e"][ids]
        x = np.stack([x, x[:, ::-1]])
        states = self._run(x, keep)
        hs = states[0][1:]
        both = np.concatenate([hs[:, 0], hs[::-1, 1]], axis=2).transpose(1, 0, 2)
        out = both @ self.p["v"] + self.p["c"]
        return (out, (x, states, both)) if keep else out

    def _back(self, x, states, dh_out, grads):
        """Gradients from those of the states (t x 2 x n x h); returns those of x."""
        hs, cs, gates = states
        w, u = self.p["w"], self.p["u"]
        h = u.shape[1]
        _, n, t, d = x.shape
        dz = np.zeros((t, 2, n, 4 * h), x.dtype)
        dh, dc = np.zeros((2, n, h), x.dtype), np.zeros((2, n, h), x.dtype)
        ut = np.ascontiguousarray(u.transpose(0, 2, 1))
        for i in reversed(range(t)):
            s, g, tc = gates[i]
            si, sf, so = s[..., :h], s[..., h : 2 * h], s[..., 2 * h :]
            dh = dh + dh_out[i]
            dc = dc + dh * so * (1 - tc * tc)
            da = dz[i]
            da[..., :h] = dc * g * si * (1 - si)
            da[..., h : 2 * h] = dc * cs[i] * sf * (1 - sf)
            da[..., 2 * h : 3 * h] = dh * tc * so * (1 - so)
            da[..., 3 * h :] = dc * si * (1 - g * g)
            dh, dc = da @ ut, dc * sf
        flat = dz.transpose(1, 0, 2, 3).reshape(2, t * n, 4 * h)
        before = hs[:-1].transpose(1, 0, 2, 3).reshape(2, t * n, h)
        grads["u"] = before.transpose(0, 2, 1) @ flat
        by_time = x.transpose(0, 2, 1, 3).reshape(2, t * n, d)
        grads["w"] = by_time.transpose(0, 2, 1) @ flat
        grads["b"] = flat.sum(1)
        return (flat @ w.transpose(0, 2, 1)).reshape(2, t, n, d).transpose(0, 2, 1, 3)

    def _step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients."""
        em, (x, states, both) = self.emissions(ids, keep=True)
        n, t, k = em.shape
        alpha, beta, logz = self.sums(em, np.full(n, t))
        rows, trans = np.arange(n), self.p["trans"]
        gold = em[rows[:, None], np.arange(t), tags].sum(1) + trans[tags[:, :-1], tags[:, 1:]].sum(1)
        grads: dict[str, np.ndarray] = {}
        dem = np.exp(alpha + beta - logz[None, :, None]).transpose(1, 0, 2)
        dem[rows[:, None], np.arange(t), tags] -= 1
        before = np.exp(alpha[:-1] - alpha[:-1].max(2, keepdims=True))
        after = em.transpose(1, 0, 2)[1:] + beta[1:]
        after = np.exp(after - after.max(2, keepdims=True))
        share = 1 / (((before @ np.exp(trans)) * after).sum(2, keepdims=True) + 1e-30)
        grads["trans"] = np.exp(trans) * np.einsum("tni,tnj->ij", before * share, after, optimize=True)
        np.add.at(grads["trans"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        dem /= n
        grads["trans"] /= n
        grads["v"] = both.reshape(n * t, -1).T @ dem.reshape(n * t, -1)
        grads["c"] = dem.sum((0, 1))
        dboth = (dem @ self.p["v"].T).transpose(1, 0, 2)
        h = self.p["u"].shape[1]
        dx = self._back(x, states, np.stack([dboth[:, :, :h], dboth[::-1, :, h:]], 1), grads)
        dx = (dx[0] + dx[1][:, ::-1]).reshape(n * t, -1)
        one = np.zeros((len(self.p["e"]), n * t), dx.dtype)
        one[ids.ravel(), np.arange(n * t)] = 1
        grads["e"] = one @ dx
        return float((logz - gold).mean()), grads

    def sums(self, em: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums (t x n x tags) of rows of n x t x tags over their own lengths, and each row's
        log of the sum over all tag sequences."""
        n, t, k = em.shape
        et = np.exp(self.p["trans"])
        alpha, beta = np.zeros((t, n, k), em.dtype), np.zeros((t, n, k), em.dtype)
        alpha[0] = em[:, 0]
        for i in range(1, t):
            m = alpha[i - 1].max(1, keepdims=True)
            alpha[i] = np.where((i < lengths)[:, None], em[:, i] + m + np.log(np.exp(alpha[i - 1] - m) @ et + 1e-30), alpha[i - 1])
        for i in reversed(range(t - 1)):
            y = beta[i + 1] + em[:, i + 1]
            m = y.max(1, keepdims=True)
            beta[i] = np.where((i + 1 < lengths)[:, None], m + np.log(np.exp(y - m) @ et.T + 1e-30), 0)
        m = alpha[-1].max(1)
        return alpha, beta, m + np.log(np.exp(alpha[-1] - m[:, None]).sum(1))

    def span_probability(self, em: np.ndarray, alpha: np.ndarray, beta: np.ndarray, logz: float, start: int, end: int, first: int) -> float:
        """Probability, over all tag sequences of one row (t x tags each), that just start:end is a span whose first tag
        is `first` and whose others are the next one."""
        trans = self.p["trans"]
        inside = first + 1
        score = float(alpha[start, first])
        if end - start > 1:
            score += float(trans[first, inside] + em[start + 1 : end, inside].sum() + (end - start - 2) * trans[inside, inside])
        last = inside if end - start > 1 else first
        if end < len(em):  # and doesn't go on
            after = trans[last] + em[end] + beta[end]
            after = np.delete(after, inside)
            m = after.max()
            score += float(m + np.log(np.exp(after - m).sum()))
        return float(np.exp(min(0.0, score - logz)))

    def decode(self, em: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The best tag sequence of each row of n x t x tags, over its own length."""
        n, t, k = em.shape
        trans = self.p["trans"]
        score = em[:, 0].copy()
        back = np.zeros((t, n, k), np.int8)
        for i in range(1, t):
            s = score[:, :, None] + trans
            best = s.argmax(1)
            new = np.take_along_axis(s, best[:, None, :], 1)[:, 0] + em[:, i]
            live = i < lengths
            back[i] = np.where(live[:, None], best, np.arange(k))
            score = np.where(live[:, None], new, score)
        tag = score.argmax(1)
        out = np.zeros((n, t), np.int8)
        rows = np.arange(n)
        for i in reversed(range(t)):
            out[:, i] = tag
            tag = back[i, rows, tag]
        return [out[i, : lengths[i]] for i in range(n)]


def spans_of(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans that a tag sequence holds: tag 1 + 2k begins kind k, 2 + 2k goes on."""
    out, s = [], 0
    while s < len(path):
        if path[s] % 2 == 1:
            end = s + 1
            while end < len(path) and path[end] == path[s] + 1:
                end += 1
            out.append(((int(path[s]) - 1) // 2, s, end))
            s = end
        else:
            s += 1
    return out


def fit(ids: np.ndarray, tags: np.ndarray, n_tags: int, hidden: int = 20, dim: int = 12, epochs: int = 6, batch: int = 64, rate: float = 0.012, seed: int = 5) -> Tagger:
    """Adam on windows of equal length; deterministic."""
    rng = np.random.default_rng(seed)
    f = np.float32
    g = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(f)
    p = {"e": (rng.normal(0, 0.5, (N_CHARS, dim))).astype(f), "v": g(2 * hidden, n_tags), "c": np.zeros(n_tags, f), "trans": np.zeros((n_tags, n_tags), f)}
    p |= {"w": np.stack([g(dim, 4 * hidden), g(dim, 4 * hidden)]), "u": np.stack([g(hidden, 4 * hidden), g(hidden, 4 * hidden)]), "b": np.zeros((2, 4 * hidden), f)}
    p["b"][:, hidden : 2 * hidden] = 1
    model = Tagger(p, n_tags)
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            _, grads = model._step(ids[rows], tags[rows])
            norm = np.sqrt(sum(float((v**2).sum()) for v in grads.values()))
            step += 1
            lr = rate * (0.4 if epoch >= epochs - 2 else 1)
            for k, v in grads.items():
                v = v * min(1.0, 5 / (norm + 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                p[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(f)
    return model
