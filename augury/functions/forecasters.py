"""Forecasters ``fn(history, h)`` over one series: small numpy models, picked on the end of their own history."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BLOCK = 64  # values that a smoothing takes at once


def drift(y: np.ndarray, h: int) -> np.ndarray:
    slope = (y[-1] - y[0]) / (len(y) - 1) if len(y) > 1 else 0.0
    return y[-1] + slope * np.arange(1, h + 1)


@lru_cache(64)
def _blocks(kind: str, factors: tuple, period: int, length: int) -> tuple[np.ndarray, ...]:
    """Matrices that carry a smoothing through ``length`` values at once, for each of ``factors``.

    A smoothing is linear in its state (level, slope, seasons with the next one first) and the new value.  With a state s and
    values v the one-step guesses are ``seen @ s + mixed @ v`` and the next state is ``carried @ s + taken @ v``.
    """
    steps = []
    for factor in factors:
        if kind == "level":
            guess, stay, gain = np.ones(1), np.ones((1, 1)), np.array([factor])
        else:
            alpha, beta, gamma = (*factor, 0.3 if period > 1 else 0.0)
            size = 2 + (period if period > 1 else 0)
            guess, stay, gain = np.zeros(size), np.zeros((size, size)), np.zeros(size)
            guess[:2] = stay[0, :2] = stay[1, 1] = 1.0
            # All that a value changes is its error's share: what the guess lacked goes to level, slope and season.
            gain[:2] = alpha, alpha * beta
            if period > 1:
                guess[2] = 1.0
                stay[2:-1, 3:] = np.eye(period - 1)
                stay[-1, 2] = 1.0
                gain[-1] = gamma * (1 - alpha)
        steps.append((guess, stay - np.outer(gain, guess), gain))
    guess, step, gain = (np.array(x) for x in zip(*steps, strict=True))
    n, size = len(factors), guess.shape[1]
    seen, mixed = np.zeros((n, length, size)), np.zeros((n, length, length))
    carried, taken = np.tile(np.eye(size), (n, 1, 1)), np.zeros((n, size, length))
    for t in range(length):
        seen[:, t], mixed[:, t] = (guess[:, None] @ carried)[:, 0], (guess[:, None] @ taken)[:, 0]
        carried, taken = step @ carried, step @ taken
        taken[:, :, t] = gain
    return seen, mixed, carried, taken


def _smoothed(kind: str, factors: tuple, period: int, start: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared one-step error and last state under each factor, by blocks of ``_BLOCK`` values."""
    state, loss = np.tile(start, (len(factors), 1))[..., None], np.zeros(len(factors))
    for k in range(0, len(y), _BLOCK):
        part = y[k : k + _BLOCK]
        seen, mixed, carried, taken = _blocks(kind, factors, period, len(part))
        loss += ((part - (seen @ state)[..., 0] - mixed @ part) ** 2).sum(1)
        state = carried @ state + (taken @ part)[..., None]
    return loss, state[..., 0]


def _first_best(loss: np.ndarray, y: np.ndarray) -> int:
    """Place of the least loss; the first of those that differ by rounding alone."""
    return int(np.argmax(loss <= loss.min() * (1 + 1e-9) + 1e-20 * (y @ y)))


def smoothing(y: np.ndarray, h: int) -> np.ndarray:
    """Simple exponential smoothing; the factor with the least one-step error of a few."""
    loss, state = _smoothed("level", (0.1, 0.2, 0.35, 0.5, 0.75, 0.9), 1, y[:1], y[1:])
    return np.full(h, state[_first_best(loss, y), 0])


def holt(y: np.ndarray, h: int, period: int = 1) -> np.ndarray:
    """Exponential smoothing of level and slope, and of additive seasons if there are two of ``period`` or more; the factors with
    the least one-step error of a few."""
    n = len(y)
    period = period if n >= 2 * period else 1
    start = y[:period].mean()
    slope = (y[period : 2 * period].mean() - start) / period if period > 1 else y[min(1, n - 1)] - y[0]
    seasons = y[:period] - start if period > 1 else np.zeros(0)
    factors = tuple((alpha, beta) for alpha in (0.2, 0.5, 0.8) for beta in (0.05, 0.2))
    loss, state = _smoothed("slope", factors, period, np.array([start, slope, *seasons]), y[period:])
    level, trend, *season = state[_first_best(loss, y)]
    ahead = np.arange(1, h + 1)
    return level + ahead * trend + (np.array(season)[(ahead - 1) % period] if period > 1 else 0.0)


def _calendar(t: np.ndarray, n: int, period: int) -> np.ndarray:
    columns = [np.ones(len(t)), t / max(1, n)]
    if period > 1:
        columns += [(t % period == k).astype(float) for k in range(1, period)]
    return np.column_stack(columns)


def seasonal_trend(y: np.ndarray, h: int, period: int = 7) -> np.ndarray:
    """Linear trend with a level for each place in the season, by ridge least squares."""
    n = len(y)
    period = period if n >= 2 * period else 1
    x = _calendar(np.arange(n), n, period)
    beta = np.linalg.solve(x.T @ x + 1e-6 * np.eye(x.shape[1]), x.T @ y)
    return _calendar(np.arange(n, n + h), n, period) @ beta


def lags(y: np.ndarray, h: int, width: int = 7) -> np.ndarray:
    """Ridge regression on the last ``width`` values, applied step by step."""
    if len(y) < 3 * width:
        return np.full(h, y[-1])
    mean, scale = y.mean(), y.std() or 1.0
    z = (y - mean) / scale
    x = np.column_stack([z[width - k - 1 : len(z) - k - 1] for k in range(width)])
    beta = np.linalg.solve(x.T @ x + np.eye(width), x.T @ z[width:])
    recent, out = list(z[::-1][:width]), []
    for _ in range(h):
        out.append(float(np.dot(beta, recent)))
        recent = [out[-1], *recent[:-1]]
    return np.array(out) * scale + mean


SEASONS = {"H": 24, "D": 7, "W": 52, "M": 12, "Q": 4, "Y": 1}  # periods of a season by frequency


def candidates(period: int) -> dict:
    return {
        "drift": drift, "smoothing": smoothing, "holt": holt, "holt_winters": lambda y, h: holt(y, h, period), "seasonal_trend": lambda y, h: seasonal_trend(y, h, period), "lags": lambda y, h: lags(y, h, max(2, period)),
        "mean": lambda y, h: np.full(h, y.mean()),
    }


def auto(y: np.ndarray, h: int, period: int = 7) -> np.ndarray:
    """The candidate with the least mean absolute error on the last ``h`` values of the history, fitted again on all of it."""
    y = np.asarray(y, float)
    if np.isnan(y).any():
        raise ValueError("the history has missing values")
    if len(y) <= 2 * h or len(y) < 8:
        return np.full(h, y[-1])
    known = candidates(period)
    loss = {name: np.abs(fn(y[:-h], h) - y[-h:]).mean() for name, fn in known.items()}
    return known[min(loss, key=lambda k: (loss[k], k))](y, h)
