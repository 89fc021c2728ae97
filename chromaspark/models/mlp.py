"""Perceptron with any number of hidden layers, trained on packed rows: squared loss or softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from chromaspark.functions.columns import zero_filled
from chromaspark.functions.descent import lbfgs, solved
from chromaspark.functions.reuse import hot
from chromaspark.models.base import Model, stacked
from chromaspark.operators.moments import Scaler, fit_scaler


def layers_of(hidden) -> tuple[int, ...]:
    """Widths of the hidden layers; a single number is one layer."""
    return tuple(int(h) for h in hidden) if isinstance(hidden, (list, tuple)) else (int(hidden),)


def _shapes(d: int, hidden, out: int) -> list[tuple[int, ...]]:
    sizes = (d, *layers_of(hidden), out)
    return [shape for a, b in zip(sizes, sizes[1:]) for shape in ((a, b), (b,))]


def unpack(w: np.ndarray, d: int, hidden, out: int) -> list[np.ndarray]:
    """Matrix and offset of each layer in turn."""
    parts, at = [], 0
    for shape in _shapes(d, hidden, out):
        size = int(np.prod(shape))
        parts.append(w[at : at + size].reshape(shape))
        at += size
    return parts


def forward(x: np.ndarray, w: np.ndarray, d: int, hidden, out: int) -> tuple[list[np.ndarray], np.ndarray]:
    """What enters each layer, and what leaves the last one."""
    parts = unpack(w, d, hidden, out)
    enters = [x]
    for m, b in zip(parts[:-2:2], parts[1:-2:2]):
        enters.append(np.maximum(enters[-1] @ m + b, 0.0))
    return enters, enters[-1] @ parts[-2] + parts[-1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(x, y, weight, w, d, hidden, out, classify) -> np.ndarray:
    """Weighted loss sum followed by its gradient (no penalty)."""
    enters, z = forward(x, w, d, hidden, out)
    if classify:
        p = softmax(z)
        code = y.astype(np.int64)
        loss = -np.sum(weight * np.log(np.maximum(p[np.arange(len(x)), code], 1e-300)))
        delta = p
        delta[np.arange(len(x)), code] -= 1.0
        delta = delta * weight[:, None]
    else:
        r = z[:, 0] - y
        loss = 0.5 * np.sum(weight * r * r)
        delta = (weight * r)[:, None]
    slopes: list[np.ndarray] = []
    for enter, m in zip(reversed(enters), reversed(unpack(w, d, hidden, out)[::2])):
        slopes = [(enter.T @ delta).ravel(), delta.sum(0), *slopes]
        delta = (delta @ m.T) * (enter > 0)
    return np.concatenate([[loss], *slopes])


@dataclass
class MlpModel(Model):
    scaler: Scaler | None = None
    hidden: tuple[int, ...] = (50,)
    weights: list[float] = field(default_factory=list)
    history: list[float] = field(default_factory=list)
    kind = "mlp"

    def _apply(self, schema: str, finish):
        std = np.array(self.scaler.std)
        inv = np.where(std > 0, 1.0 / np.where(std > 0, std, 1.0), 0.0)
        mean, w = np.array(self.scaler.mean), np.array(self.weights)
        d, hidden, out = len(self.features), self.hidden, self.n_labels if self.task == "classification" else 1

        @pandas_udf(schema)
        def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for cols in batches:
                x = (stacked(cols) - mean) * inv
                yield finish(forward(x, w, d, hidden, out)[1])

        return apply(*[zero_filled(f) for f in self.features])

    def predict(self, df: DataFrame) -> DataFrame:
        if self.task == "regression":
            return df.withColumn("prediction", self._apply("double", lambda z: pd.Series(z[:, 0])))
        p = self._apply("array<double>", lambda z: pd.Series(list(softmax(z))))
        scored = df.withColumn("probability", p)
        best = F.array_position("probability", F.array_max("probability")) - 1
        return scored.withColumn("prediction", best.cast("int"))

    def state(self) -> dict:
        s = self.scaler
        return {"mean": s.mean, "std": s.std, "hidden": list(self.hidden), "weights": self.weights}


def fit_mlp(
    packed: DataFrame, features: list[str], params: dict, task: str, n_labels: int = 0, name: str = "MLP", seed: int = 42
) -> MlpModel:
    """Full-batch fit with an L2 penalty and early stopping on a tenth of the runs.

    A packed row of ``w`` runs gives a tenth of them to the hold-out, a remainder by the hash of its vector
    and target, so a vector repeated very often is in both parts. Where that leaves no run on one side (a few
    runs in all), nothing is held out. In regression both parts of a packed row share its mean target. Only
    the gradient sum (one number a weight) and the weights travel each step.
    """
    classify = task == "classification"
    hidden = layers_of(params.get("hidden_layer_sizes", (50,)))
    alpha, rounds, tol = float(params.get("alpha", 1e-3)), int(params.get("max_iter", 500)), float(params.get("tol", 1e-4))
    out, d = (n_labels if classify else 1), len(features)
    scaler = fit_scaler(packed, features, weight="w")
    unit = F.pmod(F.xxhash64(*[zero_filled(f) for f in features], F.col("y").cast("double"), F.lit(seed)), F.lit(10))
    tenth = F.floor(F.col("w") / 10)
    held = tenth + F.when(unit < F.col("w") - 10 * tenth, 1.0).otherwise(0.0)
    data = hot(packed.select(
        *[F.expr(t).alias(f"x{i}") for i, t in enumerate(scaler.texts())], F.col("y").cast("double").alias("y"),
        F.col("w"), held.cast("double").alias("held"),
    ))
    sums = data.agg(
        F.sum(F.col("w") - F.col("held")).alias("n"), F.sum("held").alias("nv"),
        (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("m"),
    ).first()
    n, n_held = float(sums["n"] or 0.0), float(sums["nv"] or 0.0)
    early = n_held > 0 and n > 0
    if not early:
        data, n = data.withColumn("held", F.lit(0.0)), n + n_held
    xs = [f"x{i}" for i in range(d)]
    size = sum(int(np.prod(s)) for s in _shapes(d, hidden, out))
    rng = np.random.default_rng(seed)
    sizes, begin = (d, *hidden, out), []
    for a, b in zip(sizes, sizes[1:]):
        bound = np.sqrt(6.0 / (a + b))
        begin += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    begin[-1] = np.zeros(out) if classify else np.full(out, sums["m"] or 0.0)
    start = np.concatenate(begin)

    def solve(sums):
        seen: dict[bytes, float] = {}

        def value_and_grad(w: np.ndarray) -> tuple[float, np.ndarray]:
            def part(b: dict) -> np.ndarray:
                x = np.column_stack([b[c] for c in xs]).astype(np.float64)
                train = loss_and_gradient(x, b["y"], b["w"] - b["held"], w, d, hidden, out, classify)
                use = b["held"] > 0
                valid = loss_and_gradient(x[use], b["y"][use], b["held"][use], w, d, hidden, out, classify)[0] if early and use.any() else 0.0
                return np.append(train, valid)

            s = sums(part)
            seen[w.tobytes()] = s[-1] / max(n_held, 1.0)
            parts = unpack(w, d, hidden, out)
            penalty = 0.5 * alpha * sum(np.sum(m * m) for m in parts[::2]) / n
            shrink = np.concatenate([p.ravel() if i % 2 == 0 else np.zeros(p.size) for i, p in enumerate(parts)]) * alpha / n
            return float(s[0] / n + penalty), s[1:-1] / n + shrink

        best = {"loss": np.inf, "w": start, "since": 0}

        def watch(w: np.ndarray, value: float) -> bool:
            loss = seen[w.tobytes()] if early else value
            seen.clear()
            if loss < best["loss"] - tol:
                best.update(loss=loss, w=w.copy(), since=0)
            else:
                best["since"] += 1
                if loss < best["loss"]:
                    best.update(loss=loss, w=w.copy())
            return best["since"] >= 10

        w, history, _ = lbfgs(value_and_grad, start, rounds=rounds, tol=tol * 1e-2, watch=watch)
        return (best["w"] if early and np.isfinite(best["loss"]) else w), history

    chosen, history = solved(data, [*xs, "y", "w", "held"], solve)
    data.unpersist()
    return MlpModel(name, task, list(features), dict(params), n_labels, scaler, hidden, chosen.tolist(), history)
