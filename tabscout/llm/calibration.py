"""Isotonic calibration of scores by pooling adjacent violators."""

from __future__ import annotations

import numpy as np


class Isotonic:
    """A non-decreasing function of a score, the weighted least-squares fit to labels.

    Values between two fitted scores are interpolated; outside, the nearest one holds. Without any
    point every score gives `default`.
    """

    def __init__(self, scores: np.ndarray, labels: np.ndarray, weights: np.ndarray, default: float = 0.5) -> None:
        order = np.argsort(scores, kind="stable")
        blocks: list[list[float]] = []
        for x, y, w in zip(scores[order].tolist(), labels[order].tolist(), weights[order].tolist()):
            if w <= 0:
                continue
            blocks.append([x * w, y * w, w])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                top = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
        self.at = np.array([b[0] / b[2] for b in blocks] or [0.0])
        self.value = np.array([b[1] / b[2] for b in blocks] or [default])

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(scores, self.at, self.value), 0.0, 1.0)
