"""Robust autoregression with iterative additive-outlier and level-shift tests, on one numeric series."""

from __future__ import annotations

import numpy as np


def fit_ar(z: np.ndarray, order: int = 2, rounds: int = 4) -> tuple[np.ndarray, float]:
    """Coefficients (constant last) of a Huber-weighted autoregression and the robust scale of its residuals."""
    n = len(z)
    y = z[order:]
    x = np.column_stack([z[order - 1 - i : n - 1 - i] for i in range(order)] + [np.ones(n - order)])
    b = np.zeros(order + 1)
    b[0] = 1.0
    for _ in range(rounds):
        e = y - x @ b
        s = max(1.4826 * float(np.median(np.abs(e))), 1e-9)
        w = np.minimum(1.0, 1.5 * s / np.maximum(np.abs(e), 1e-9))
        xw = x * w[:, None]
        b = np.linalg.solve(xw.T @ x + 1e-6 * np.eye(order + 1), xw.T @ y)
    return b, 1.4826 * float(np.median(np.abs(y - x @ b)))


def fit_steps(y: np.ndarray) -> tuple[float, float]:
    """The robust autoregression of successive differences, free of level: (coefficient, residual scale).

    As an autoregression of the values it has order 2 and the coefficients 1 + c and -c.
    """
    b, s = fit_ar(np.diff(y), 1)
    return float(np.clip(b[0], -0.95, 0.95)), s


def additive_outliers(
    y: np.ndarray, may_start: np.ndarray | None = None, cut: float = 5.0, floor: float = 1.0, longest: int = 24, order: int = 2, rounds: int = 6, model: tuple[float, float] | None = None
) -> list[tuple[int, int, float]]:
    """Patches (start, end, largest jump) of additive outliers of ``y``.

    One-step residuals of the cleaned series above ``cut`` scales start a test, where ``may_start`` allows it. The
    patch is an additive outlier if the series comes back to the level before within ``longest`` values and leaves
    the patch as abruptly as it entered it; it is then interpolated. Else the jump is a level shift, lasting
    or fading, and the new level is kept. Fit and tests repeat on the cleaned series until nothing new is found.
    With a ``model`` (see ``fit_steps``) nothing is fitted and only the tests repeat: parts of a series are then judged
    as the whole is.
    """
    n, pad = len(y), 5
    if n < 4:
        return []
    near = min(n, 40)
    z = np.concatenate([np.full(pad, np.median(y[:near])), y, np.full(pad, np.median(y[-near:]))])
    allowed = np.zeros(len(z), bool)
    allowed[pad : pad + n] = True if may_start is None else may_start
    if not allowed.any():
        return []
    found: dict[int, tuple[int, float]] = {}
    shifts: set[int] = set()
    for _ in range(rounds):
        if model is None:
            b, s = fit_ar(z, order)
        else:
            b, s = np.array([1 + model[0], -model[0]] + [0.0] * (order - 1)), model[1]
        s = max(s, floor)
        x = np.column_stack([z[order - 1 - i : len(z) - 1 - i] for i in range(order)])
        e = np.abs(z[order:] - x @ b[:order] - b[order])
        new, end = False, 0
        for i in (np.flatnonzero((e > cut * s) & allowed[order:]) + order).tolist():
            if i < end or i in shifts or i in found:
                continue
            pre = sorted(z[i - 5 : i].tolist())[2]
            jump = z[i] - pre
            if abs(jump) <= cut * s / 2:
                continue
            back = np.flatnonzero((z[i + 1 : i + longest + 1] - pre) * np.sign(jump) <= abs(jump) / 2)
            if not len(back):
                shifts.add(i)
                continue
            stop = i + 1 + int(back[0])
            top = z[i:stop] - pre
            most = float(top[np.argmax(np.abs(top))])
            if min(abs(z[i] - z[i - 1]), abs(z[stop - 1] - z[stop])) < abs(most) / 2 or abs(z[stop] - pre) > abs(most) / 2:
                shifts.add(i)
                continue
            end = stop
            found[i] = (end, most)
            z[i:end] = np.interp(np.arange(i, end), [i - 1, end], [z[i - 1], z[end]])
            new = True
        if not new:
            break
    return [(i - pad, min(e - pad, n), j) for i, (e, j) in sorted(found.items())]


def runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the length of the run of equal values it belongs to, and the number of that run."""
    if not len(v):
        return np.zeros(0, int), np.zeros(0, int)
    number = np.cumsum(np.concatenate([[True], v[1:] != v[:-1]])) - 1
    return np.bincount(number)[number], number
