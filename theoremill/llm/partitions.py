"""Learned partitions of a vector space: fitted on a bounded sample, applied to every vector.

The neighbour graph of the sample is cut into parts of equal size by median splits along principal
directions, refined by moving nodes to the part that holds most of their neighbours while sizes allow. A
linear softmax classifier then learns, for each vector, in which parts its neighbours lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` as float32 of unit length."""
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def top(similarity: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` greatest entries of each row, in no order."""
    k = min(k, similarity.shape[1])
    return np.argpartition(similarity, similarity.shape[1] - k, axis=1)[:, similarity.shape[1] - k :]


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """The ``k`` nearest other rows of each row of ``x`` (unit vectors), by brute force in blocks."""
    out = []
    for s in range(0, len(x), block):
        sim = x[s : s + block] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -2
        out.append(top(sim, k))
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.15, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """A part for each row, none larger than ``slack`` times the mean; ``parts`` is a power of two."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(x), np.int64)
    width = 1
    while width < parts:
        halves = np.zeros_like(part)
        for p in range(width):
            rows = np.flatnonzero(part == p)
            y = x[rows] - x[rows].mean(0)
            v = rng.standard_normal(x.shape[1]).astype(np.float32)
            for _ in range(6):  # power iteration
                v = y.T @ (y @ v)
                v /= np.linalg.norm(v) + 1e-12
            halves[rows] = np.argsort(np.argsort(y @ v, kind="stable")) >= len(rows) / 2
        part = part * 2 + halves
        width *= 2
    limit, sizes = slack * len(x) / parts, np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(part[graph[i]], minlength=parts)
            votes[sizes >= limit] = -1
            best = int(votes.argmax())
            if best != part[i] and votes[best] > np.count_nonzero(part[graph[i]] == part[i]):
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if moved < len(x) / 200:
            break
    return part


@dataclass
class Router:
    """Scores of the parts for vectors: x @ weights + bias."""

    weights: np.ndarray
    bias: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def fit_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, epochs: int = 12, batch: int = 512, rate: float = 0.02, seed: int = 0) -> Router:
    """Softmax regression on the parts of each row and its neighbours, by Adam."""
    rng = np.random.default_rng(seed)
    w = np.stack([unit(x[part == p].mean(0, keepdims=True))[0] if (part == p).any() else np.zeros(x.shape[1]) for p in range(parts)], 1).astype(np.float32) * 8
    b = np.zeros(parts, np.float32)
    targets = np.zeros((len(x), parts), np.float32)
    np.add.at(targets, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
    targets[np.arange(len(x)), part] += 1
    targets /= targets.sum(1, keepdims=True)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, b)]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), batch):
            rows = order[s : s + batch]
            z = x[rows] @ w + b
            z = np.exp(z - z.max(1, keepdims=True))
            error = (z / z.sum(1, keepdims=True) - targets[rows]) / len(rows)
            step += 1
            for p, g, (m, v) in zip((w, b), (x[rows].T @ error + 1e-5 * w, error.sum(0)), moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (0.5 ** (epoch // 4)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Router(w, b)
