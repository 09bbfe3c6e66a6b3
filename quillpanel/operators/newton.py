"""Logistic regressions by Newton's method, many over the same rows at once.

A pass over the rows gives every regression its loss, gradient and curvature;
batches are added up as they come, so nothing but the sums is held. Some eight
passes reach the minimum, however many regressions there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Part:
    """Rows placed before ``upto`` that have all of ``columns``, scaled; ``weights`` are those of the classes 0 and 1."""

    columns: tuple[int, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    upto: float
    weights: tuple[float, float] = (1.0, 1.0)

    def of(self, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x[:, self.columns]
        use = (at < self.upto) & ~np.isnan(y) & ~np.isnan(x).any(1)
        z = np.column_stack([(x[use] - self.mean) / self.std, np.ones(int(use.sum()))])
        return z, y[use]


def _batches(batches: Iterator[pa.RecordBatch], n_columns: int) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        c = [b.column(k).to_numpy(zero_copy_only=False) for k in range(n_columns + 2)]  # nulls become NaN
        yield np.column_stack(c[:n_columns]) if n_columns else np.empty((b.num_rows, 0)), c[-2], c[-1]


def _row(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"out": pa.array([values.tobytes()], pa.binary())})


def _sizes(batches: Iterator[pa.RecordBatch], n_columns: int, parts: Sequence[Part]) -> Iterator[pa.RecordBatch]:
    out = np.zeros((len(parts), 2))
    for x, y, at in _batches(batches, n_columns):
        for k, p in enumerate(parts):
            _, own = p.of(x, y, at)
            out[k] += len(own) - own.sum(), own.sum()
    yield _row(out)


def _sums(batches: Iterator[pa.RecordBatch], n_columns: int, parts: Sequence[Part], at_: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    out = [np.zeros((len(w), w.shape[1] ** 2 + w.shape[1] + 1)) for w in at_]
    for x, y, at in _batches(batches, n_columns):
        for p, w, total in zip(parts, at_, out):
            z, own = p.of(x, y, at)
            d, each = z.shape[1], np.where(own == 1, p.weights[1], p.weights[0])
            margin = z @ w.T
            prob = np.exp(-np.logaddexp(0, -margin))
            total[:, 0] += each @ (np.logaddexp(0, margin) - own[:, None] * margin)
            total[:, 1 : d + 1] += (each[:, None] * (prob - own[:, None])).T @ z
            curve = each[:, None] * prob * (1 - prob)
            for k in range(len(w)):
                total[k, d + 1 :] += ((z * curve[:, k : k + 1]).T @ z).ravel()
    yield _row(np.concatenate([o.ravel() for o in out]))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers, means and sums of squares about the mean of two sets, last axis, put together."""
    n = a[..., 0] + b[..., 0]
    share, far = b[..., 0] / np.maximum(n, 1), b[..., 1] - a[..., 1]
    return np.stack([n, a[..., 1] + far * share, a[..., 2] + b[..., 2] + far * far * a[..., 0] * share], -1)


def _moments(batches: Iterator[pa.RecordBatch], n_columns: int, uptos: Sequence[float]) -> Iterator[pa.RecordBatch]:
    out = np.zeros((len(uptos), n_columns, 3))
    for x, _, at in _batches(batches, n_columns):
        for k, upto in enumerate(uptos):
            own = x[at < upto]
            have = ~np.isnan(own)
            n = have.sum(0)
            mean = np.where(have, own, 0).sum(0) / np.maximum(n, 1)
            out[k] = _joined(out[k], np.stack([n, mean, np.where(have, (own - mean) ** 2, 0).sum(0)], -1))
    yield _row(out)


def moments(rows: DataFrame, uptos: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each column, without nulls, over the rows placed before each of ``uptos``; 0 for no values."""
    d = len(rows.columns) - 2
    total = np.zeros((len(uptos), d, 3))
    for r in rows.mapInArrow(partial(_moments, n_columns=d, uptos=uptos), "out binary").collect():  # a row per task
        total = _joined(total, np.frombuffer(r["out"]).reshape(total.shape))
    return total[..., 1], np.sqrt(total[..., 2] / np.maximum(total[..., 0], 1))


def _added(rows: DataFrame, run) -> np.ndarray:
    """Sums over the tasks: a row from each, so ``rows`` has few partitions."""
    return np.sum([np.frombuffer(r["out"]) for r in rows.mapInArrow(run, "out binary").collect()], 0)


def _scored(batches: Iterator[pa.RecordBatch], n_columns: int, tests: Sequence[tuple[Part, float, list]]) -> Iterator[pa.RecordBatch]:
    for x, y, at in _batches(batches, n_columns):
        by = 0
        for p, since, models in tests:
            use = (at >= since) & (at < p.upto) & ~np.isnan(y) & ~np.isnan(x[:, p.columns]).any(1)
            z = [(x[use, k] - m) / s for k, m, s in zip(p.columns, p.mean, p.std)]
            for w, b in models:
                with np.errstate(over="ignore"):  # column by column: equal rows get equal values
                    prob = 1 / (1 + np.exp(-sum((v * c for v, c in zip(w, z)), np.full(int(use.sum()), b))))
                yield pa.RecordBatch.from_pydict({"_by": pa.array(np.full(len(prob), by), pa.int32()), "_y": y[use], "_p": prob})
                by += 1


def scored(rows: DataFrame, tests: Sequence[tuple[Part, float, list[tuple[np.ndarray, float]]]]) -> DataFrame:
    """``(_by, _y, _p)``: the probability of each model for the rows placed from the second value of its test to the part's end; models are numbered on."""
    return rows.mapInArrow(partial(_scored, n_columns=len(rows.columns) - 2, tests=tests), "_by int, _y double, _p double")


def fitted(rows: DataFrame, parts: Sequence[Part], grid: Sequence[float], balanced: bool, max_iter: int, tol: float = 1e-10) -> list[list[tuple[np.ndarray, float]]]:
    """Coefficients and intercept per part and strength: least ``|w|^2 / 2 + c * loss``.

    ``rows`` are stored: the columns, the target, the place, all doubles. A part
    with one class gets zero coefficients and an infinite intercept.
    """
    n_columns = len(rows.columns) - 2
    sizes = _added(rows, partial(_sizes, n_columns=n_columns, parts=parts)).reshape(-1, 2)
    if not sizes.sum(1).all():
        raise ValueError("nothing to train on")
    c = np.array(grid, float)
    out: list = [[(np.zeros(len(p.columns)), float("inf") if n[1] else -float("inf"))] * len(c) if not n.all() else None for p, n in zip(parts, sizes)]
    todo = [k for k, o in enumerate(out) if o is None]
    own = [Part(parts[k].columns, parts[k].mean, parts[k].std, parts[k].upto, tuple(sizes[k].sum() / (2 * sizes[k])) if balanced else (1.0, 1.0)) for k in todo]
    now = [np.zeros((len(c), len(p.columns) + 1)) for p in own]
    was, step = [w.copy() for w in now], [np.zeros_like(w) for w in now]
    least = [np.full(len(c), np.inf) for _ in own]
    done = [np.zeros(len(c), bool) for _ in own]
    for _ in range(max_iter):
        if all(x.all() for x in done):
            break
        got = np.split(_added(rows, partial(_sums, n_columns=n_columns, parts=own, at_=now)), np.cumsum([len(c) * (w.shape[1] ** 2 + w.shape[1] + 1) for w in now])[:-1])
        for i, sums in enumerate(got):
            d = now[i].shape[1]
            ridge = np.diag([1.0] * (d - 1) + [0.0])
            for k, s in enumerate(sums.reshape(len(c), -1)):
                if done[i][k]:
                    continue
                w = now[i][k]
                loss = c[k] * s[0] + w[:-1] @ w[:-1] / 2
                if loss > least[i][k] * (1 + 1e-12) and np.abs(step[i][k]).max() > tol:  # too far: half the step
                    step[i][k] /= 2
                else:
                    was[i][k], least[i][k] = w, loss
                    step[i][k] = -np.linalg.lstsq(c[k] * s[d + 1 :].reshape(d, d) + ridge, c[k] * s[1 : d + 1] + ridge @ w, rcond=None)[0] if np.isfinite(s).all() else np.nan
                now[i][k] = was[i][k] + step[i][k]
                done[i][k] = not np.abs(step[i][k]).max() > tol * (1 + np.abs(now[i][k]).max())
    for i, k in enumerate(todo):
        out[k] = [(w[:-1], float(w[-1])) for w in now[i]]
    return out
