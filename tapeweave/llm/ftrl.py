"""Follow-the-regularised-leader (proximal) for sparse logistic models."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate rates alpha / (beta + sqrt(sum of squared gradients)), L1 and L2 penalties.

    classes 1: a binary model with soft labels. More: one weight column a class, softmax.
    The last feature is the intercept, which carries no L1 penalty.
    """

    def __init__(self, features: int, classes: int = 1, alpha=0.3, beta=1.0, l1=1.0, l2=0.1):
        self.z = np.zeros((features + 1, classes), dtype=np.float32)
        self.n = np.zeros((features + 1, classes), dtype=np.float32)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)[:, None]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def fit(self, at: np.ndarray, values: np.ndarray, label) -> np.ndarray:
        """One example: distinct features, their values, and the label (a share, or class number)."""
        at = np.append(at, len(self.z) - 1)
        values = np.append(values, 1.0).astype(np.float32)
        w = self.weights(at)
        logits = values @ w
        if w.shape[1] == 1:
            error = probability(logits) - label
        else:
            error = softmax(logits[None])[0]
            error[label] -= 1.0
        gradient = values[:, None] * error[None]
        old = self.n[at]
        new = old + gradient**2
        self.z[at] += gradient - (np.sqrt(new) - np.sqrt(old)) / self.alpha * w
        self.n[at] = new
        return logits

    def all_weights(self) -> np.ndarray:
        out = np.zeros(self.z.shape)
        touched = np.flatnonzero((self.n > 0).any(axis=1))
        out[touched] = self.weights(touched)
        return out


def probability(logits: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(logits, -40, 40)))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
