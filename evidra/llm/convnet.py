"""A character convolutional network in numpy: embedding, one convolution, maximum over places, one dense layer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class ConvNet:
    """p: e embeds characters; k, b is the convolution over `width` characters; v, c the dense layer. scale, shift
    calibrate its score; threshold is the probability from which a candidate counts as found."""

    p: dict[str, np.ndarray]
    width: int
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def _forward(self, ids: np.ndarray):
        x = self.p["e"][ids]
        n, t, d = x.shape
        places = t - self.width + 1
        cols = np.concatenate([x[:, i : i + places] for i in range(self.width)], axis=2)
        z = cols @ self.p["k"] + self.p["b"]
        best = z.argmax(1)
        top = np.maximum(np.take_along_axis(z, best[:, None, :], 1)[:, 0], 0)
        return cols, best, top, top @ self.p["v"] + self.p["c"][0]

    def raw(self, ids: np.ndarray) -> np.ndarray:
        parts = [self._forward(ids[i : i + 1024])[3] for i in range(0, len(ids), 1024)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def probability(self, ids: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.raw(ids).astype(float) + self.shift)))


def fit(ids: np.ndarray, y: np.ndarray, n_chars: int, recall: float, dim: int = 8, filters: int = 24, width: int = 7, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 3) -> ConvNet:
    """Adam on three quarters; the last quarter calibrates the score (Platt) and sets the threshold: the highest that
    still finds `recall` of its labelled findings, and no more than 0.5."""
    rng = np.random.default_rng(seed)
    f = np.float32
    p = {"e": rng.normal(0, 0.5, (n_chars, dim)).astype(f), "k": (rng.normal(0, 1, (dim * width, filters)) / np.sqrt(dim * width)).astype(f), "b": np.zeros(filters, f), "v": (rng.normal(0, 1, filters) / np.sqrt(filters)).astype(f), "c": np.zeros(1, f)}
    net = ConvNet(p, width)
    order = rng.permutation(len(ids))
    held, train = order[: len(order) // 4], order[len(order) // 4 :]
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        train = rng.permutation(train)
        for at in range(0, len(train), batch):
            rows = train[at : at + batch]
            cols, best, top, score = net._forward(ids[rows])
            ds = ((1 / (1 + np.exp(-score)) - y[rows]) / len(rows)).astype(f)
            dtop = ds[:, None] * p["v"] * (top > 0)
            chosen = cols[np.arange(len(rows))[:, None], best]  # n x filters x (dim * width)
            dcol = dtop[:, :, None] * p["k"].T[None]
            de = np.zeros_like(p["e"])
            at_ids = ids[rows][np.arange(len(rows))[:, None, None], best[:, :, None] + np.arange(width)]
            np.add.at(de, at_ids.ravel(), dcol.reshape(-1, dim))
            grads = {"v": top.T @ ds, "c": ds.sum(keepdims=True), "k": np.einsum("nf,nfd->df", dtop, chosen), "b": dtop.sum(0), "e": de}
            step += 1
            for key, v in grads.items():
                m1[key] = 0.9 * m1[key] + 0.1 * v
                m2[key] = 0.99 * m2[key] + 0.01 * v * v
                p[key] -= (rate * (m1[key] / (1 - 0.9**step)) / (np.sqrt(m2[key] / (1 - 0.99**step)) + 1e-6)).astype(f)
    s, t = net.raw(ids[held]).astype(float), y[held]
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt scaling by gradient descent
        q = 1 / (1 + np.exp(-(a * s + b)))
        a, b = a - 0.05 * float(((q - t) * s).mean()), b - 0.05 * float((q - t).mean())
    net.scale, net.shift = max(a, 1e-3), b
    found = net.probability(ids[held])[t > 0]
    net.threshold = min(0.5, float(np.quantile(found, 1 - recall))) if len(found) else 0.5
    return net
