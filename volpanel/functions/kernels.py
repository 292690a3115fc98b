"""Numerical kernels: arrays in, arrays out, no Spark."""

from __future__ import annotations

import math

import numpy as np

from volpanel.sources.schema import EXPECTED_ABS_NORMAL

LOG_TOP = math.log(np.finfo(np.float64).max) - 0.1
LOG_BOTTOM = math.log(1e-300)


def egarch_step(log_variance: float, r: float, omega_raw: float, alpha: float, gamma: float, beta: float) -> float:
    """Next log variance of returns times 100, kept within the range of doubles."""
    z = 100.0 * r / math.exp(0.5 * log_variance)
    value = omega_raw + alpha * (abs(z) - EXPECTED_ABS_NORMAL) + gamma * z + beta * log_variance
    return min(max(value, LOG_BOTTOM), LOG_TOP)


def garch_variances(theta: np.ndarray, r: np.ndarray, model: str, start: float) -> np.ndarray:
    """Conditional variances for many candidate parameters at once: (candidates, rows)."""
    theta = np.atleast_2d(theta)
    out = np.empty((len(theta), len(r)))
    if model == "EGARCH":
        omega, alpha, gamma, beta = theta.T
        state = np.full(len(theta), math.log(start))
        for t in range(len(r)):
            if t:
                z = r[t - 1] / np.exp(0.5 * state)
                state = np.clip(omega + alpha * (np.abs(z) - EXPECTED_ABS_NORMAL) + gamma * z + beta * state, -690, 690)
            out[:, t] = np.exp(state)
        return out
    omega, alpha, beta = theta[:, 0], theta[:, 1], theta[:, -1]
    gamma = theta[:, 2] if model == "GJR-GARCH" else np.zeros(len(theta))
    state = np.full(len(theta), start)
    for t in range(len(r)):
        if t:
            state = omega + (alpha + gamma * (r[t - 1] < 0)) * r[t - 1] ** 2 + beta * state
        out[:, t] = state
    return out


def log_likelihood(theta: np.ndarray, r: np.ndarray, model: str, start: float) -> np.ndarray:
    """Gaussian log-likelihood of each candidate; -inf outside the admissible set."""
    theta = np.atleast_2d(theta)
    if model == "EGARCH":
        good = np.abs(theta[:, 3]) < 1
    else:
        gamma = theta[:, 2] if model == "GJR-GARCH" else 0.0
        good = (theta[:, 0] > 0) & (theta[:, 1] >= 0) & (theta[:, -1] >= 0) & (theta[:, 1] + gamma >= 0) & (theta[:, 1] + 0.5 * gamma + theta[:, -1] < 1)
    value = np.full(len(theta), -np.inf)
    if good.any():
        s = garch_variances(theta[good], r, model, start)
        with np.errstate(all="ignore"):
            ll = -0.5 * (math.log(2 * math.pi) + np.log(s) + r**2 / s).sum(1)
        value[good] = np.where(np.isfinite(ll), ll, -np.inf)
    return value


def grid(model: str, variance: float) -> np.ndarray:
    """Coarse starts around typical parameters."""
    out = []
    for alpha in (0.03, 0.08, 0.15):
        for beta in (0.5, 0.8, 0.9):
            if model == "EGARCH":
                out += [[(1 - beta) * math.log(variance), 2 * alpha, gamma, beta] for gamma in (-0.1, 0.0, 0.05)]
            elif model == "GJR-GARCH":
                out += [[variance * max(1 - alpha - gamma / 2 - beta, 0.01), alpha, gamma, beta] for gamma in (0.0, 0.08)]
            else:
                out.append([variance * max(1 - alpha - beta, 0.01), alpha, beta])
    return np.array(out)


def maximise(r: np.ndarray, model: str, rounds: int = 60, known: np.ndarray | None = None) -> tuple[np.ndarray, float, bool]:
    """Parameters of the greatest likelihood: the best of a grid (and of ``known`` ones), then shrinking pattern search.

    All moves of a round are scored at once; the parameters never score below the grid.
    """
    start = float(np.mean(r**2)) or 1e-12
    starts = grid(model, start)
    if known is not None:
        starts = np.concatenate([starts, known[None]])
    values = log_likelihood(starts, r, model, start)
    best, value = starts[values.argmax()], float(values.max())
    step = np.maximum(np.abs(best) * 0.25, 0.02)
    eye = np.eye(len(best))
    pairs = np.array([a * x + b * y for i, x in enumerate(eye) for y in eye[i + 1 :] for a in (-1, 1) for b in (-1, 1)])
    moves = np.concatenate([eye, -eye, pairs])
    for _ in range(rounds):
        tries = best + moves * step
        values = log_likelihood(tries, r, model, start)
        if values.max() > value + 1e-10:
            best, value = tries[values.argmax()], float(values.max())
        else:
            step = step / 2
            if step.max() < 1e-6:
                return best, value, True
    return best, value, bool(step.max() < 1e-3)
