"""Isotonic calibration of one score on a bounded sample (pool adjacent violators)."""

from __future__ import annotations

import numpy as np


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the non-decreasing least-squares fit of ``y`` over ``x``; ties are pooled first.

    A block of equal fit gives two knots, its lowest and highest score, a
    thousandth apart from its mean so that the order of scores is kept.
    """
    values, group = np.unique(np.asarray(x, float), return_inverse=True)
    mass = np.bincount(group).astype(float)
    mean = np.bincount(group, np.asarray(y, float)) / mass
    blocks: list[tuple[float, float, float, float]] = []  # mean, mass, lowest and highest score
    for v, m, w in zip(values, mean, mass):
        block = (m, w, v, v)
        while blocks and blocks[-1][0] >= block[0]:
            m1, w1, lo, _ = blocks.pop()
            block = ((m1 * w1 + block[0] * block[1]) / (w1 + block[1]), w1 + block[1], lo, block[3])
        blocks.append(block)
    knots = [(v, m + d) for m, _, lo, hi in blocks for v, d in ((lo, -1e-3 * m), (hi, 1e-3 * (1 - m)))]
    return np.array([k[0] for k in knots]), np.maximum.accumulate([k[1] for k in knots])


def applied(knots: tuple[np.ndarray, np.ndarray], x):
    """The fitted probability at ``x``, linear between knots and flat beyond them."""
    return np.interp(x, knots[0], knots[1])
