"""Weak supervision shared by the quality and personal-data operators: expectation-maximisation
over vote patterns and a small logistic scorer on hashed features."""
from __future__ import annotations

import zlib

import numpy as np


class LabelModel:
    """Accuracies of overlapping labellers without true labels.

    Each labeller votes -1, 1 or 0 (abstains, which says nothing). ``accuracy[j]`` is the
    probability that a vote of labeller j names the true class; given the class, votes are
    independent. Expectation: posterior classes from accuracies and the class prior of the
    pattern's group. Maximisation: accuracies and priors from the posteriors. Patterns come as
    counts, so the work depends on the number of different patterns, not of rows. Accuracies start
    well above one half and are held by pseudo-counts, which fixes which class is which."""

    def __init__(self, n_labellers: int, prior: float = 0.5, accuracy: float = 0.9,
                 strength: float = 10.0):
        self.accuracy = np.full(n_labellers, accuracy)
        self.at_first, self.strength = accuracy, strength
        self.prior: dict = {}
        self.start = prior

    def fit(self, votes: np.ndarray, counts: np.ndarray, groups, rounds: int = 40) -> LabelModel:
        """``votes`` (patterns x labellers), their ``counts`` and a group (own class prior) each."""
        votes, counts = np.asarray(votes, int), np.asarray(counts, float)
        groups = list(groups)
        if not len(counts):
            return self
        for _ in range(rounds):
            p = self.posterior(votes, groups)
            right = (votes == 1) * p[:, None] + (votes == -1) * (1 - p[:, None])
            cast = (votes != 0) * counts[:, None]
            self.accuracy = np.clip(
                ((right * counts[:, None]).sum(axis=0) + self.at_first * self.strength)
                / (cast.sum(axis=0) + self.strength), 0.55, 0.995)
            for g in set(groups):
                own = np.array([x == g for x in groups])
                self.prior[g] = float(np.clip(
                    ((p * counts)[own].sum() + self.strength * self.start)
                    / (counts[own].sum() + self.strength), 0.02, 0.98))
        return self

    def posterior(self, votes: np.ndarray, groups) -> np.ndarray:
        """Probability of class 1 for each pattern."""
        votes = np.asarray(votes, int).reshape(-1, len(self.accuracy))
        prior = np.array([self.prior.get(g, self.start) for g in groups], dtype=float)
        weight = np.log(self.accuracy / (1 - self.accuracy))
        logit = np.log(prior / (1 - prior)) + votes @ weight if len(prior) else prior
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def hashed(feature: str, buckets: int) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % buckets


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 2.0,
                 decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias for rows ``x`` and soft labels ``y``, both classes weighing the same.
    Full gradients with a per-feature step size, so the result does not depend on any order."""
    w, b = np.zeros(x.shape[1]), 0.0
    if not len(x):
        return w, b
    pos, neg = max(y.sum(), 1e-9), max((1 - y).sum(), 1e-9)
    weight = y * (len(y) / (2 * pos)) + (1 - y) * (len(y) / (2 * neg))
    seen, seen_b = np.full(x.shape[1], 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype) + b, -50, 50)))
        err = weight * (p - y) / len(y)
        g, gb = err.astype(x.dtype) @ x + decay * w, float(err.sum())
        seen, seen_b = seen + g * g, seen_b + gb * gb
        w, b = w - rate * 0.1 * g / np.sqrt(seen), b - rate * 0.1 * gb / np.sqrt(seen_b)
    return w, b
