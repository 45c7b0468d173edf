"""Logistic regression on a bounded matrix, by accelerated proximal gradient steps."""

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def fit_logistic(x, y, weight=None, l1=0.0, l2=1e-3, steps=300):
    """(coefficients, intercept) of weighted logistic loss + l1 |w| + l2/2 |w|^2.

    The mean loss is taken, so penalties do not depend on the number of rows. y may hold
    probabilities. Without rows, or with one class only, coefficients are zero.
    """
    x, y = np.asarray(x, np.float32), np.asarray(y, np.float64)
    n, m = x.shape
    weight = np.ones(n) if weight is None else np.asarray(weight, np.float64)
    if not n or weight.sum() <= 0:
        return np.zeros(m), 0.0
    weight = weight / weight.sum()
    mean = float(np.clip((weight * y).sum(), 1e-4, 1 - 1e-4))
    w, b = np.zeros(m), float(np.log(mean / (1 - mean)))
    if not m or y.min() == y.max():
        return w, b
    v = np.random.default_rng(0).normal(size=m + 1)
    for _ in range(20):  # the largest eigenvalue bounds the step
        z = weight * (x @ v[:-1].astype(np.float32) + v[-1])
        u = np.append(x.T @ z.astype(np.float32), z.sum())
        v = u / (np.linalg.norm(u) or 1.0)
    step = 1.0 / (0.3 * float(np.linalg.norm(u)) + l2 + 1e-9)
    wk, bk, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = weight * (sigmoid(x @ wk.astype(np.float32) + bk) - y)
        nw = wk - step * (x.T @ r.astype(np.float32) + l2 * wk)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0.0)
        nb = bk - step * r.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wk, bk = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)
