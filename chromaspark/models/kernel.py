"""RBF-kernel models through random Fourier features (Rahimi & Recht, 2007)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from chromaspark.functions.columns import features_as, zero_filled
from chromaspark.functions.descent import is_wide, lbfgs, row_sums
from chromaspark.functions.reuse import hot
from chromaspark.models.base import Model, TrainingTable, stacked
from chromaspark.operators.moments import Scaler, fit_scaler
from chromaspark.schema import quoted

N_FEATURES = 128
MAX_STEPS = 1000  # of the optimiser, which ends earlier where the value settles
EPSILON = 0.1
LOCAL_TARGETS = 4_000_000  # targets that one task fits by itself, some 60 bytes each
SMOOTH = 0.01  # half-width of the quadratic corner of the epsilon-insensitive loss


@dataclass
class FourierMap:
    """Random cosine features of standardised inputs; gamma is 1 / (d * variance of all cells)."""

    scaler: Scaler
    gamma: float
    omega: np.ndarray
    phase: np.ndarray

    def numpy(self, x: np.ndarray) -> np.ndarray:
        std = np.array(self.scaler.std)
        z = (x - np.array(self.scaler.mean)) * np.where(std > 0, 1.0 / np.where(std > 0, std, 1.0), 0.0)
        return np.sqrt(2.0 / len(self.phase)) * np.cos(z @ self.omega + self.phase)

    def state(self) -> dict:
        return {
            "mean": self.scaler.mean, "std": self.scaler.std, "features": self.scaler.features,
            "gamma": self.gamma, "omega": self.omega.tolist(), "phase": self.phase.tolist(),
        }

    @staticmethod
    def from_state(s: dict) -> "FourierMap":
        return FourierMap(Scaler(s["features"], s["mean"], s["std"]), s["gamma"], np.array(s["omega"]), np.array(s["phase"]))


def scale_gamma(scaler: Scaler) -> float:
    """1 / (d * variance of all scaled cells): constant columns scale to 0 and add no variance."""
    live = sum(1 for s in scaler.std if s > 0)
    return 1.0 / max(live, 1)


def fourier_map(scaler: Scaler, n: int = N_FEATURES, seed: int = 42, gamma: float | str = "scale") -> FourierMap:
    g = scale_gamma(scaler) if gamma == "scale" else float(gamma)
    rng = np.random.default_rng(seed)
    omega = rng.normal(0.0, np.sqrt(2.0 * g), (len(scaler.features), n))
    return FourierMap(scaler, g, omega, rng.uniform(0.0, 2.0 * np.pi, n))


def margins(features: list[str], fmap: FourierMap, coef: np.ndarray, bias: np.ndarray) -> Column:
    """One linear form per class over the Fourier features, as ``array<double>``."""

    @pandas_udf("array<double>")
    def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            x = stacked(cols)
            yield pd.Series(list(fmap.numpy(x) @ coef.T + bias))

    return apply(*[zero_filled(f) for f in features])


def linear_on_map(features: list[str], fmap: FourierMap, coef: np.ndarray, bias: float) -> Column:
    @pandas_udf("double")
    def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            x = stacked(cols)
            yield pd.Series(fmap.numpy(x) @ coef + bias)

    return apply(*[zero_filled(f) for f in features])


@dataclass
class SvrModel(Model):
    fmap: FourierMap | None = None
    coef: list[float] = field(default_factory=list)
    bias: float = 0.0
    history: list[float] = field(default_factory=list)
    converged: bool | None = None  # None for a loaded model
    kind = "svr"

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", linear_on_map(self.features, self.fmap, np.array(self.coef), self.bias))

    def state(self) -> dict:
        return {"map": self.fmap.state(), "coef": self.coef, "bias": self.bias}


def _vector_blocks(rows: DataFrame, features: list[str], y: str) -> DataFrame:
    """Blocks ``(x, n, y)`` of packed doubles: distinct feature vectors, their numbers of rows, and the targets one by one.

    A vector's rows lie side by side in a few partitions (a hot vector is spread by its targets).
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = b[features].to_numpy(dtype=np.float64)
                first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)]))
                n = np.diff(np.append(first, len(x))).astype(np.float64)
                target = b[y].to_numpy(dtype=np.float64)
                yield pd.DataFrame({"x": [x[first].tobytes()], "n": [n.tobytes()], "y": [target.tobytes()]})

    names = [quoted(f) for f in features]
    spread = F.pmod(F.xxhash64(quoted(y)), F.lit(16))
    base = rows.selectExpr(*features_as(features), quoted(y))
    return base.repartition(*names, spread).sortWithinPartitions(*names).mapInPandas(pack, "x binary, n binary, y binary")


@dataclass
class SortedTargets:
    """Targets in order within each distinct feature vector, with running sums, so a vector's loss takes a few look-ups, not a pass."""

    x: np.ndarray  # distinct vectors
    first: np.ndarray
    last: np.ndarray  # behind the vector's targets
    y: np.ndarray
    sums: np.ndarray  # of the targets, and of their squares, before each place
    squares: np.ndarray
    center: float  # taken off the targets

    @staticmethod
    def of(x: np.ndarray, times: np.ndarray, y: np.ndarray) -> SortedTargets:
        """From vectors that may come more than once, the numbers of their targets, and the targets one by one."""
        vectors, which = np.unique(x, axis=0, return_inverse=True)
        owner = np.repeat(which.ravel(), times)
        center = float(y.mean()) if len(y) else 0.0
        order = np.lexsort((y, owner))
        y = y[order] - center
        last = np.cumsum(np.bincount(owner, minlength=len(vectors)))
        sums, squares = (np.concatenate(([0.0], np.cumsum(v))) for v in (y, y * y))
        return SortedTargets(vectors, np.append(0, last[:-1]), last, y, sums, squares, center)

    def below(self, bounds: np.ndarray) -> np.ndarray:
        """Place of the first target of each vector that is not below its bound; one bound a vector in each row."""
        low, high = np.tile(self.first, (len(bounds), 1)), np.tile(self.last, (len(bounds), 1))
        for _ in range(int(np.max(self.last - self.first, initial=0)).bit_length()):
            middle = (low + high) // 2
            less = (middle < high) & (self.y[np.minimum(middle, len(self.y) - 1)] < bounds)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        return low

    def loss_and_slope(self, p: np.ndarray, eps: float) -> tuple[float, np.ndarray]:
        """Sum of the rounded epsilon-insensitive loss for predictions ``p`` of the vectors, and its slope by vector; ``eps`` is no less than ``SMOOTH``."""
        p = p - self.center
        a, b, c, d = self.below(np.stack((p - eps - SMOOTH, p - eps + SMOOTH, p + eps - SMOOTH, p + eps + SMOOTH)))

        def corner(i: np.ndarray, j: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n, s, q = j - i, self.sums[j] - self.sums[i], self.squares[j] - self.squares[i]
            return (n * edge * edge - 2 * edge * s + q) / (4 * SMOOTH), (n * edge - s) / (2 * SMOOTH)

        high, low = a - self.first, self.last - d  # targets far below and far above the prediction
        near_low, slope_low = corner(a, b, p - eps + SMOOTH)
        near_high, slope_high = corner(c, d, p + eps - SMOOTH)
        loss = high * (p - eps) - (self.sums[a] - self.sums[self.first]) + (self.sums[self.last] - self.sums[d]) - low * (p + eps)
        return float((loss + near_low + near_high).sum()), high - low + slope_low + slope_high


def fit_svr(rows: DataFrame, features: list[str], params: dict, y: str = "y", n_features: int = N_FEATURES) -> SvrModel:
    """1/2 |w|^2 + C * sum max(0, |r| - epsilon), with the corner rounded so L-BFGS applies.

    Up to ``LOCAL_TARGETS`` targets the fit runs in one task over sorted targets; more stay where they are and each step is a job.
    Runs until the value settles; ``converged`` tells whether ``max_iter`` steps were enough.
    """
    scaler = fit_scaler(rows, features)
    fmap = fourier_map(scaler, n_features, gamma=params.get("gamma", "scale"))
    c, eps = float(params.get("C", 1.0)), float(params.get("epsilon", EPSILON))
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("m")).first()
    n, blocks = head["n"], hot(_vector_blocks(rows, features, y))
    wide = is_wide(blocks)

    def solve(sums):
        def value_and_grad(w: np.ndarray) -> tuple[float, np.ndarray]:
            coef, bias = w[:-1], w[-1]
            s = sums(coef, bias)
            value = (0.5 * coef @ coef + c * s[0]) / n
            grad = np.concatenate([(coef + c * s[1:-1]) / n, [c * s[-1] / n]])
            return float(value), grad

        return lbfgs(value_and_grad, start, rounds=int(params.get("max_iter", MAX_STEPS)), tol=1e-3)

    def far(coef: np.ndarray, bias: float) -> np.ndarray:
        def part(b: dict) -> np.ndarray:
            x, times, target = (np.frombuffer(b"".join(b[c])) for c in ("x", "n", "y"))
            h, times = fmap.numpy(x.reshape(-1, len(features))), times.astype(np.int64)
            r = np.repeat(h @ coef + bias, times) - target
            over = np.abs(r) - eps
            t = np.clip((over + SMOOTH) / (2 * SMOOTH), 0.0, 1.0)
            loss = np.where(over >= SMOOTH, over, np.where(over <= -SMOOTH, 0.0, (over + SMOOTH) ** 2 / (4 * SMOOTH)))
            slope = t * np.sign(r)
            slope = np.add.reduceat(slope, np.cumsum(times) - times)
            return np.concatenate([[loss.sum()], h.T @ slope, [slope.sum()]])

        return row_sums(blocks, ["x", "n", "y"], part, wide)

    def here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        x, times, target = (np.frombuffer(b"".join(v for b in frames for v in b[c])) for c in ("x", "n", "y"))
        sorted_ = SortedTargets.of(x.reshape(-1, len(features)), times.astype(np.int64), target)
        h = fmap.numpy(sorted_.x)

        def sums(coef: np.ndarray, bias: float) -> np.ndarray:
            loss, slope = sorted_.loss_and_slope(h @ coef + bias, eps)
            return np.concatenate([[loss], h.T @ slope, [slope.sum()]])

        yield pd.DataFrame({"r": [cloudpickle.dumps(solve(sums))]})

    start = np.concatenate([np.zeros(n_features), [head["m"] or 0.0]])
    if 0 < n <= LOCAL_TARGETS and eps >= SMOOTH:
        blocks.count()  # packed by many tasks, then fitted by one
        w, history, converged = cloudpickle.loads(blocks.coalesce(1).mapInPandas(here, "r binary").first()["r"])
    else:
        w, history, converged = solve(far)
    blocks.unpersist()
    return SvrModel("SVR", "regression", list(features), dict(params), 0, fmap, w[:-1].tolist(), float(w[-1]), history, converged)


def svr_from_table(table: TrainingTable, params: dict) -> SvrModel:
    return fit_svr(table.rows, table.features, params)
