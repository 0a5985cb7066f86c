"""Many weighted logistic regressions in one job a step: bootstrap ensembles and the models of folds.

All replicates share each pass over the rows. A row's weight in a replicate comes from its key wherever the row is read: a draw for a
resample (`poisson_copies`), 0 or 1 for a fold, so neither is ever written. A task turns its rows into each replicate's gradient and Hessian;
tasks that hold a replicate each add these up and solve its system, so the driver gets R x (3 + k) numbers a step, however many tasks there are.
Steps are Newton's on the penalised likelihood, halved where one does not improve it, until no coefficient moves by more than `STILL`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import FACTOR, PRIME
from .shared import ship

STILL = 1e-9
STEPS = 100


def _sums(features: np.ndarray, label: np.ndarray, copies: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """For each replicate: its copies, those of class 1, log-likelihood, gradient and Hessian, one after another."""
    x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    k = x.shape[1]
    out = np.empty((len(beta), 3 + k + k * k))
    for r, b in enumerate(beta):
        w = copies[:, r]
        on = np.flatnonzero(w)
        xs, ys, ws = x[on], label[on], w[on]
        z = xs @ b
        p = 0.5 * (1 + np.tanh(z / 2))
        out[r, :3] = ws.sum(), ws @ ys, np.sum(ws * (ys * z - np.logaddexp(0, z)))
        out[r, 3 : 3 + k] = xs.T @ (ws * (ys - p))
        out[r, 3 + k :] = ((xs * (ws * p * (1 - p))[:, None]).T @ xs).ravel()
    return out


def poisson_copies(keys: np.ndarray, replicates: int, seed: int = 0) -> np.ndarray:
    """Copies [rows, replicates] of each row: the same draws as `sampling.bootstrap_rows` makes for these keys."""
    limits = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    h = (np.int64(seed * FACTOR) + keys.astype(np.int64)) % PRIME
    h = (h * h + 12345) % PRIME
    out = np.empty((len(keys), replicates))
    for r in range(replicates):
        g = (h * FACTOR + r) % PRIME
        g = (g * g + 12345) % PRIME
        out[:, r] = np.searchsorted(limits, (g + 0.5) / float(PRIME), "left")
    return out


def _directions(parts: DataFrame, k: int, beta: np.ndarray, ridge: np.ndarray) -> DataFrame:
    """replicate, values: its copies, those of class 1, log-likelihood and Newton's step, from the sums (replicate, values) that tasks leave."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, values in zip(batch["replicate"], batch["values"], strict=True):
                v = np.frombuffer(values, np.float64)
                total[r] = total[r] + v if r in total else v
        out = []
        for r, v in total.items():
            step = np.zeros(k)
            if 0 < v[1] < v[0]:
                gradient = v[3 : 3 + k] / v[0] - ridge * beta[r]
                step = np.linalg.lstsq(v[3 + k :].reshape(k, k) / v[0] + np.diag(ridge), gradient, rcond=None)[0]
            out.append((r, np.concatenate([v[:3], step]).tobytes()))
        yield pd.DataFrame(out, columns=["replicate", "values"])

    return parts.repartition("replicate").mapInPandas(add, "replicate int, values binary")


def fit_logistic(rows: DataFrame, features: list[str], key: str, replicates: int, weights: Callable[[np.ndarray], np.ndarray], penalty: float, label: str = "label") -> np.ndarray:
    """Coefficients [replicates, features + 1], the intercept last.

    `weights` gives the weight [rows, replicates] of each row in each replicate from its `key`. Each replicate minimises the mean negative
    log-likelihood by its weights + penalty / 2 x the coefficients' squares (the intercept is free), as the library's own regression
    without standardisation does. Rows with a missing feature, label or key are left out. A
    replicate without both classes has NaN.
    """
    ship(rows.sparkSession)
    k = len(features) + 1
    used = rows.dropna(subset=[*features, label, key]).select(*(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)), F.col(label).cast("double").alias("y"), F.col(key).cast("long").alias("key"))
    xs = [f"x{i}" for i in range(k - 1)]
    beta, step, tried = (np.zeros((replicates, k)) for _ in range(3))
    best, ridge = np.full(replicates, -np.inf), np.full(k, float(penalty))
    ridge[-1] = 0.0
    for _ in range(STEPS):
        sent = tried.copy()

        def task(batches: Iterator[pd.DataFrame], sent: np.ndarray = sent) -> Iterator[pd.DataFrame]:
            total = np.zeros((replicates, 3 + k + k * k))
            for batch in batches:
                if len(batch):
                    total += _sums(batch[xs].to_numpy(np.float64), batch["y"].to_numpy(np.float64), weights(batch["key"].to_numpy()), sent)
            yield pd.DataFrame({"replicate": np.arange(replicates, dtype=np.int32), "values": [t.tobytes() for t in total]})

        found = np.zeros((replicates, 3 + k))
        for r in _directions(used.mapInPandas(task, "replicate int, values binary"), k, sent, ridge).collect():  # a short row a replicate
            found[r["replicate"]] = np.frombuffer(r["values"], np.float64)
        size, ones = found[:, 0], found[:, 1]
        moving = np.zeros(replicates, bool)
        for r in np.flatnonzero((ones > 0) & (ones < size)):
            worth = found[r, 2] / size[r] - 0.5 * float(ridge @ tried[r] ** 2)
            if worth < best[r] - 1e-13:  # the step went too far
                step[r] /= 2
            else:
                beta[r], best[r] = tried[r], worth
                step[r] = found[r, 3:]
            moving[r] = np.abs(step[r]).max() > STILL
            tried[r] = beta[r] + step[r] if moving[r] else beta[r]
        if not moving.any():
            beta[(ones <= 0) | (ones >= size)] = np.nan
            return beta
    raise RuntimeError(f"coefficients still move after {STEPS} steps")


def bootstrap_fits(rows: DataFrame, features: list[str], key: str, replicates: int, penalty: float, seed: int = 0) -> np.ndarray:
    """Coefficients of Poisson resamples."""
    return fit_logistic(rows, features, key, replicates, lambda keys: poisson_copies(keys, replicates, seed), penalty)


def fold_fits(rows: DataFrame, features: list[str], fold: str, folds: list[int], penalty: float) -> np.ndarray:
    """For each fold the coefficients of the rows outside it."""
    others = np.array(folds, np.int64)
    return fit_logistic(rows, features, fold, len(folds), lambda at: (at.astype(np.int64)[:, None] != others[None, :]).astype(np.float64), penalty)


def fold_scores(features: list[str], fold: str, folds: list[int], beta: np.ndarray) -> Column:
    """The probability of class 1 of each row by the coefficients of its own fold; NULL for a fold without coefficients."""
    place = {f: k for k, f in enumerate(folds)}

    @F.pandas_udf("double")
    def scores(at: pd.Series, *columns: pd.Series) -> pd.Series:
        x, own = np.stack([c.to_numpy(np.float64) for c in columns], axis=1), beta[at.map(place).to_numpy(np.int64)]
        return pd.Series(0.5 * (1 + np.tanh(((x * own[:, :-1]).sum(axis=1) + own[:, -1]) / 2)))

    return scores(F.col(fold), *(F.col(f).cast("double") for f in features))


def ensemble_spread(features: list[str], beta: np.ndarray) -> Column:
    """Population deviation over the replicates of the probability of class 1, in Arrow batches: one matrix product a batch."""

    @F.pandas_udf("double")
    def spread(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(np.float64) for c in columns], axis=1)
        return pd.Series((0.5 * (1 + np.tanh((x @ beta[:, :-1].T + beta[:, -1]) / 2))).std(axis=1))

    return spread(*(F.col(f).cast("double") for f in features))
