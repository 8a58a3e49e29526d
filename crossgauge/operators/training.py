"""A trainer whose passes are distributed sums, with early stop; and path-integrated attribution of a trained model.

Each evaluation is one pass: tasks sum losses and gradients of their rows in Arrow batches, Spark adds the sums up number
by number, and only loss, count and gradient, as many numbers as the model has, reach the driver.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps that L-BFGS remembers, and the least drop of the loss for a step, as a part of what the gradient promises.
MEMORY, ARMIJO = 10, 1e-4


@dataclass
class Logistic:
    """p(1) = sigmoid(w . x + b); weights come as one vector with b last."""

    weights: np.ndarray

    def value(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)))

    def value_and_gradient(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p of every row, and its gradient with respect to the row."""
        p = self.value(x)
        return p, (p * (1 - p))[:, None] * self.weights[:-1]

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed log loss and its gradient with respect to the weights."""
        z = x @ self.weights[:-1] + self.weights[-1]
        miss = self.value(x) - y
        return float((np.logaddexp(0, z) - y * z).sum()), np.append(x.T @ miss, miss.sum())


@dataclass
class Tanh:
    """One hidden layer: u . tanh(x w + b) + c."""

    w: np.ndarray
    b: np.ndarray
    u: np.ndarray
    c: float = 0.0

    def value(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w + self.b) @ self.u + self.c

    def value_and_gradient(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.w + self.b)
        return h @ self.u + self.c, ((1 - h * h) * self.u) @ self.w.T


@dataclass
class Fit:
    weights: np.ndarray
    stopped: str  # converged, early or limit
    overfit: bool
    history: list[tuple[int, float, float]] = field(default_factory=list)  # round, training loss, validation loss


def _stack(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def evaluate(rows: DataFrame, model: type, weights: np.ndarray) -> dict[str, tuple[float, float, np.ndarray]]:
    """part -> (rows, summed loss, summed gradient) of rows (x array, y, part)."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def sums(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, y, part = _stack(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(float), np.array(b.column(2).to_pylist())
            for p in np.unique(part):
                loss, gradient = model(shared.value).loss(x[part == p], y[part == p])
                total[p] = total.get(p, 0) + np.concatenate(([(part == p).sum(), loss], gradient))
        for p, v in total.items():
            yield pa.record_batch([pa.array([p] * len(v)), pa.array(np.arange(len(v))), pa.array(v)], names=["part", "i", "v"])

    found = rows.select("x", "y", "part").mapInArrow(sums, "part string, i long, v double").groupBy("part", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in found.collect():  # a part's numbers: the model's size and two
        out.setdefault(r["part"], np.zeros(len(weights) + 2))[r["i"]] = r["v"]
    return {p: (v[0], v[1], v[2:]) for p, v in out.items()}


def _direction(gradient: np.ndarray, steps: deque) -> np.ndarray:
    """Two-loop L-BFGS."""
    q, back = gradient.copy(), []
    for s, y in reversed(steps):
        a = (s @ q) / (s @ y)
        back.append(a)
        q -= a * y
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(back), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def train(rows: DataFrame, size: int, model: type = Logistic, l2: float = 1e-3, rounds: int = 100, patience: int = 5, tolerance: float = 1e-8, gap: float = 0.1) -> Fit:
    """L-BFGS on the mean loss of the `train` part plus l2 |w|^2 / 2 (the last weight is free); rows: x, y, part (train or val).

    Stops when the gradient is under the tolerance, when the validation loss hasn't fallen for `patience` rounds (the
    best weights are kept), or at the limit. overfit: validation loss over training loss by more than `gap`. Rows are read
    once an evaluation: pass a stored table. Without a validation part there is no early stop.
    """
    free = np.append(np.ones(size - 1), 0.0)

    def at(w):
        found = evaluate(rows, model, w)
        n, loss, gradient = found["train"]
        val = found.get("val")
        return loss / n + l2 * (free * w * w).sum() / 2, gradient / n + l2 * free * w, loss / n, val[1] / val[0] if val else None

    w = np.zeros(size)
    value, gradient, loss, val = at(w)
    best = (val if val is not None else value, w, loss)
    fit, steps, since = Fit(w, "limit", False, [(0, loss, val)]), deque(maxlen=MEMORY), 0
    for k in range(1, rounds + 1):
        if np.abs(gradient).max() <= tolerance:
            fit.stopped = "converged"
            break
        d = _direction(gradient, steps)
        if d @ gradient >= 0:
            d, steps = -gradient, deque(maxlen=MEMORY)
        t = 1.0
        while True:
            new = at(w + t * d)
            if new[0] <= value + ARMIJO * t * (d @ gradient) or t < 1e-10:
                break
            t /= 2
        s, y = t * d, new[1] - gradient
        if s @ y > 1e-12 * (y @ y):
            steps.append((s, y))
        w, (value, gradient, loss, val) = w + s, new
        fit.history.append((k, loss, val))
        mark = val if val is not None else value
        if mark < best[0]:
            best, since = (mark, w, loss), 0
        else:
            since += 1
        if t < 1e-10:  # no step lowers the loss: as far as doubles go
            fit.stopped = "converged"
            break
        if val is not None and since >= patience:
            fit.stopped = "early"
            break
    # at an early stop the best validation counts, else where the loss is least
    fit.weights = best[1] if fit.stopped == "early" or val is None else w
    fit.overfit = bool(val is not None and (best[0] - best[2] if fit.stopped == "early" else val - loss) > gap)
    return fit


def integrated_gradients(df: DataFrame, features: str, model, baseline: np.ndarray | None = None, steps: int = 32) -> DataFrame:
    """df with attribution (array), delta and residual: the model's gradient along the straight path from the baseline (zeros) to each row.

    Midpoints of `steps` equal parts are averaged and multiplied by row less baseline. delta: f(row) - f(baseline);
    residual: what the attributions' sum lacks of it (completeness). Null features have null results.
    """
    shared = df.sparkSession.sparkContext.broadcast((model, baseline))
    at = df.columns.index(features)

    def run(batches):
        import pyarrow as pa

        f, base = shared.value
        for b in batches:
            there = b.column(at).is_valid()
            x = _stack(b.column(at).filter(there)) if there.true_count else np.zeros((0, 1))
            x0 = np.zeros(x.shape[1]) if base is None else base
            mean = np.zeros_like(x)
            for k in range(steps):
                mean += f.value_and_gradient(x0 + (k + 0.5) / steps * (x - x0))[1] / steps if len(x) else 0
            attribution = mean * (x - x0)
            delta = f.value(x) - f.value(x0[None, :]) if len(x) else np.zeros(0)
            where = np.full(b.num_rows, -1)
            where[np.flatnonzero(there.to_numpy(zero_copy_only=False))] = np.arange(len(x))
            pick = pa.array(where, mask=where < 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(attribution.ravel()))
            more = [lists.take(pick), pa.array(delta).take(pick), pa.array(delta - attribution.sum(1)).take(pick)]
            yield pa.record_batch([*b.columns, *more], names=[*b.schema.names, "attribution", "delta", "residual"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", attribution array<double>, delta double, residual double"
    return df.mapInArrow(run, schema)


def dealt(key: Column, val_percent: int = 20) -> Column:
    """train or val, by a hash of the key."""
    return F.when(F.pmod(F.xxhash64(key), F.lit(100)) < val_percent, "val").otherwise("train")
