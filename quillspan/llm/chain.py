"""A linear-chain conditional random field with two tags, and Viterbi decoding.

Positions carry sets of named features. The score of a tagging is the sum of the
weights of the features at positions tagged 1, and of a weight for each pair of
neighbouring tags. Weights are fitted on the driver by the penalised likelihood
of a bounded sample (forward-backward and Adam), and the fitted chain, a small
dictionary, is sent to the workers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Chain:
    """``weight[f]`` speaks for tag 1; ``move[a][b]`` for tag b after tag a; ``start[a]`` for tag a at the first position."""

    weight: dict[str, float] = field(default_factory=dict)
    move: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    start: list[float] = field(default_factory=lambda: [0.0, 0.0])

    def score(self, features: list[str]) -> float:
        get = self.weight.get
        return sum(get(f, 0.0) for f in features)

    def viterbi(self, scores: list[float]) -> list[int]:
        """The best tags for positions with these scores for tag 1 (tag 0 scores 0); ties go to 0."""
        if not scores:
            return []
        (m00, m01), (m10, m11) = self.move
        zero, one = self.start[0], self.start[1] + scores[0]
        back: list[tuple[int, int]] = []
        for s in scores[1:]:
            a, b = zero + m00, one + m10
            c, d = zero + m01, one + m11
            back.append((int(b > a), int(d > c)))
            zero, one = max(a, b), max(c, d) + s
        tag = int(one > zero)
        tags = [tag]
        for pair in reversed(back):
            tag = pair[tag]
            tags.append(tag)
        return tags[::-1]

    def tag(self, sequence: list[list[str]]) -> list[int]:
        return self.viterbi([self.score(f) for f in sequence])


def fit(sequences: list[list[list[str]]], tags: list[list[int]], *, rounds: int = 120, rate: float = 0.15, penalty: float = 1e-3, least: int = 1, longest: int = 64) -> Chain:
    """Fit a chain. Sequences longer than ``longest`` are cut; features seen fewer than ``least`` times get no weight.

    An empty sample gives a chain without weights, which tags everything 0.
    """
    parts = [(s[i : i + longest], t[i : i + longest]) for s, t in zip(sequences, tags) for i in range(0, len(s), longest)]
    if not parts:
        return Chain()
    counts: dict[str, int] = {}
    for s, _ in parts:
        for features in s:
            for f in features:
                counts[f] = counts.get(f, 0) + 1
    names = sorted(f for f, n in counts.items() if n >= least)
    number = {f: k for k, f in enumerate(names)}
    parts.sort(key=lambda p: -len(p[0]))
    size, steps = len(parts), len(parts[0][0])
    live = [sum(len(s) > i for s, _ in parts) for i in range(steps)]  # parts are sorted: the first live[i] reach position i
    y = np.zeros((size, steps), dtype=np.int64)
    cells, columns = [], []
    for r, (s, t) in enumerate(parts):
        y[r, : len(t)] = t
        for i, features in enumerate(s):
            own = [number[f] for f in features if f in number]
            cells += [r * steps + i] * len(own)
            columns += own
    cell, column = np.array(cells, dtype=np.int64), np.array(columns, dtype=np.int64)
    mask = np.arange(steps)[None, :] < np.array([len(s) for s, _ in parts])[:, None]
    theta = np.zeros(len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    target_move = np.zeros((2, 2))
    np.add.at(target_move, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
    target_start = np.bincount(y[:, 0], minlength=2).astype(float)
    total = mask.sum()
    for k in range(1, rounds + 1):
        w, move, start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        unary = np.zeros((size, steps, 2))
        unary[:, :, 1] = np.bincount(cell, weights=w[column], minlength=size * steps).reshape(size, steps)
        forward, backward = np.full((size, steps, 2), -np.inf), np.zeros((size, steps, 2))
        forward[:, 0] = start + unary[:, 0]
        for i in range(1, steps):
            n = live[i]
            x = forward[:n, i - 1, :, None] + move[None]
            forward[:n, i] = np.logaddexp(x[:, 0], x[:, 1]) + unary[:n, i]
        for i in range(steps - 2, -1, -1):
            n = live[i + 1]
            x = move[None] + (unary[:n, i + 1] + backward[:n, i + 1])[:, None, :]
            backward[:n, i] = np.logaddexp(x[:, :, 0], x[:, :, 1])
        both = forward + backward
        z = np.logaddexp(both[:, 0, 0], both[:, 0, 1])
        one = np.where(mask, np.exp(np.where(mask, both[:, :, 1], -np.inf) - z[:, None]), 0.0)
        grad = np.zeros_like(theta)
        grad[:-6] = np.bincount(column, weights=(y * mask - one).reshape(-1)[cell], minlength=len(names))
        expected = np.zeros((2, 2))
        for i in range(1, steps):
            n = live[i]
            x = forward[:n, i - 1, :, None] + move[None] + (unary[:n, i] + backward[:n, i])[:, None, :] - z[:n, None, None]
            expected += np.exp(x).sum(axis=0)
        grad[-6:-2] = (target_move - expected).reshape(-1)
        grad[-2:] = target_start - np.array([(1 - one[:, 0]).sum(), one[:, 0].sum()])
        grad = grad / total - penalty / total * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-10)
    return Chain({f: float(theta[k]) for f, k in number.items()}, theta[-6:-2].reshape(2, 2).tolist(), theta[-2:].tolist())
