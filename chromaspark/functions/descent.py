"""L-BFGS where each function value and gradient is one distributed sum over the rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from chromaspark.functions.reuse import fits_rows

FEW_PARTITIONS = 64
LOCAL_ROWS = 50_000  # packed rows that one task fits by itself


def is_wide(data: DataFrame) -> bool:
    """Whether partial sums of ``data`` are worth adding up in parallel first."""
    return data.rdd.getNumPartitions() > FEW_PARTITIONS


def row_sums(data: DataFrame, columns: list[str], part: Callable[[dict], np.ndarray], wide: bool = False) -> np.ndarray:
    """Sum of ``part`` (a fixed-length vector) over all batches of ``data``.

    Partial sums are formed inside the tasks; with many partitions they are summed once more in
    parallel, so the driver sees a bounded number of short vectors.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for b in batches:
            if len(b):
                v = part({c: b[c].to_numpy() for c in columns})
                acc = v if acc is None else acc + v
        if acc is not None:
            yield pd.DataFrame({"s": [acc]})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for b in batches:
            for v in b["s"]:
                acc = np.array(v) if acc is None else acc + v
        if acc is not None:
            yield pd.DataFrame({"s": [acc]})

    sums = data.select(*columns).mapInPandas(local, "s array<double>")
    if wide:
        sums = sums.repartition(FEW_PARTITIONS // 2).mapInPandas(again, "s array<double>")
    return np.sum([r["s"] for r in sums.collect()], axis=0)


def solved(data: DataFrame, columns: list[str], solve: Callable[[Callable], object]):
    """What ``solve(sums)`` returns, where ``sums(part)`` is the sum of ``part`` over all batches of ``data``.

    Up to ``LOCAL_ROWS`` rows the whole fit runs in one task, as its steps are shorter than a job; several fits then
    run beside each other. More rows stay where they are and each step is a job.
    """
    if not fits_rows(data, LOCAL_ROWS):
        wide = is_wide(data)
        return solve(lambda part: row_sums(data, columns, part, wide))

    def here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if frames:
            whole = {c: np.concatenate([b[c].to_numpy() for b in frames]) for c in columns}
            yield pd.DataFrame({"r": [cloudpickle.dumps(solve(lambda part: part(whole)))]})

    return cloudpickle.loads(data.select(*columns).coalesce(1).mapInPandas(here, "r binary").first()["r"])


def lbfgs(
    value_and_grad: Callable[[np.ndarray], tuple[float, np.ndarray]],
    start: np.ndarray,
    rounds: int = 100,
    tol: float = 1e-4,
    memory: int = 10,
    watch: Callable[[np.ndarray, float], bool] | None = None,
) -> tuple[np.ndarray, list[float], bool]:
    """Minimise a smooth function; returns the point, the value after every step and whether it converged.

    A step is at most ten times as long as the one before, since a nearly linear stretch says nothing about
    the curvature beyond it. Where no step along the estimated direction helps, the gradient is followed.
    It has converged if a step changes the value by less than the tolerance, or if no step along the
    gradient lowers it any more. ``watch(point, value)`` may stop the run early, which does not count as converged.
    """
    x = start.astype(np.float64)
    f, g = value_and_grad(x)
    history = [f]
    pairs: deque = deque(maxlen=memory)
    done = False
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ q)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(g)))
        for (s, y, rho), a in zip(pairs, reversed(alphas)):
            q += (a - rho * (y @ q)) * s
        slope = float(g @ q)
        if slope <= 0:
            q = g / max(1.0, float(np.linalg.norm(g)))
            slope = float(g @ q)
            pairs.clear()
        if pairs:
            shrink = min(1.0, 10.0 * float(np.linalg.norm(pairs[-1][0])) / float(np.linalg.norm(q)))
            q, slope = shrink * q, shrink * slope
        step, moved = 1.0, False
        for _ in range(12):
            nx = x - step * q
            nf, ng = value_and_grad(nx)
            if np.isfinite(nf) and nf <= f - 1e-4 * step * slope:
                moved = True
                break
            step *= 0.4
        if not moved:
            if pairs:
                pairs.clear()
                continue
            done = True
            break
        s, y = nx - x, ng - g
        if s @ y > 1e-12 * float(np.linalg.norm(s) * np.linalg.norm(y)):
            pairs.append((s, y, 1.0 / float(s @ y)))
        done = abs(f - nf) <= tol * 1e-2 * max(1.0, abs(f))
        x, f, g = nx, nf, ng
        history.append(f)
        if watch is not None and watch(x, f):
            break
        if done:
            break
    return x, history, done
