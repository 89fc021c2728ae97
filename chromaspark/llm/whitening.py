"""Embedding whitening with a bidiagonal qd solver.

The centred rows are reduced block by block to the triangular factor of a QR decomposition; factors of tasks are
stacked and reduced again until one is left for each vector length. Householder reflections bring that factor to bidiagonal
form, the dqds iteration finds its singular values to high relative accuracy, and twisted factorisations of the
shifted tridiagonal form give the directions. The covariance matrix itself is never formed, so small directions keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from chromaspark.llm.common import drop_kept, keep

COMPONENTS = 32
FAN_IN = 16  # triangular factors that one task reduces to one
WAVE_BYTES = 64 << 20  # fitted models that are broadcast at a time
SCALE, SHIFT = 64.0, 1_000_000
LARGEST = float(1 << 53)  # entries beyond it count as this

_EPS = np.finfo(np.float64).eps
_CLUSTER = 1e-3  # singular values closer than this share are made orthogonal to each other


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, v)``: diagonal, upper diagonal and right reflections with ``r = u @ bidiagonal(a, b) @ v.T``."""
    x, n = np.array(r, dtype=np.float64), len(r)
    v = np.eye(n)

    def reflect(c: np.ndarray) -> tuple[np.ndarray, float]:
        """Unit normal of the reflection that leaves only the first entry of ``c``, and that entry."""
        size = np.linalg.norm(c)
        if size == 0.0:
            return c, 0.0
        u = c.copy()
        head = -size if c[0] >= 0 else size
        u[0] -= head
        return u / np.linalg.norm(u), head

    a, b = np.zeros(n), np.zeros(max(0, n - 1))
    for k in range(n):
        u, a[k] = reflect(x[k:, k])
        x[k:, k:] -= 2.0 * np.outer(u, u @ x[k:, k:])
        if k < n - 1:
            u, b[k] = reflect(x[k, k + 1:])
            x[k:, k + 1:] -= 2.0 * np.outer(x[k:, k + 1:] @ u, u)
            v[:, k + 1:] -= 2.0 * np.outer(v[:, k + 1:] @ u, u)
    return a, b, v


def _pass(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds transform: new ``q`` and ``e`` and the quantities ``d``; None if the shift was too large."""
    n = len(q)
    d, out_q, out_e, all_d = q[0] - shift, [0.0] * n, [0.0] * (n - 1), [0.0] * n
    for i in range(n - 1):
        if d < 0.0:
            return None
        all_d[i] = d
        out_q[i] = top = d + e[i]
        if top == 0.0:
            d = q[i + 1] - shift
            continue
        ratio = q[i + 1] / top
        out_e[i] = e[i] * ratio
        d = d * ratio - shift
    if d < 0.0:
        return None
    all_d[-1] = out_q[-1] = d
    return out_q, out_e, all_d


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Singular values of the upper bidiagonal matrix, falling, by dqds with shifts that are proven to be too small.

    A trial shift that is too large makes a quantity negative; the transform is then repeated with a smaller one,
    down to Newton's bound, which never is.
    """
    found: list[float] = []
    scale = max(float(np.max(np.abs(a), initial=0.0)), float(np.max(np.abs(b), initial=0.0)))
    if scale == 0.0:
        return np.zeros(len(a))
    work = [([float(x) ** 2 for x in a / scale], [float(x) ** 2 for x in b / scale], 0.0)]
    while work:
        q, e, sigma = work.pop()
        for _ in range(200 * len(q) + 200):
            n = len(q)
            if n == 1:
                found.append(sigma + q[0])
                break
            cut = next((i for i in range(n - 1) if e[i] <= _EPS * _EPS * (sigma + min(q[i], q[i + 1])) or e[i] < 1e-300), None)
            if cut is not None:
                work += [(q[:cut + 1], e[:cut], sigma), (q[cut + 1:], e[cut + 1:], sigma)]
                break
            plain = _pass(q, e, 0.0)
            least = min(plain[2])
            if least <= 0.0:
                q, e = plain[0], plain[1]
                continue
            low = (1.0 - 4.0 * n * _EPS) / sum(1.0 / x for x in plain[2])  # the diagonal of the inverse: Newton's bound
            for shift in (0.9 * least + 0.1 * low, 0.5 * (least + low), low, 0.5 * low):
                got = _pass(q, e, shift)
                if got is not None:
                    q, e, sigma = got[0], got[1], sigma + shift
                    break
            else:
                q, e = plain[0], plain[1]
        else:
            raise ArithmeticError("dqds did not settle")
    return scale * np.sqrt(np.array(sorted(found, reverse=True)))


def _twisted(q: np.ndarray, low: np.ndarray, shift: float, rhs: np.ndarray | None = None) -> np.ndarray:
    """Vector that ``L diag(q) L.T - shift`` almost takes to zero; ``low`` is the lower diagonal of the unit matrix L.

    The matrix is factored downwards (stationary qd) and upwards (progressive qd) without being formed; the two meet
    where the pivot is least. With ``rhs`` the shifted system is solved instead (a step of inverse iteration).
    """
    n = len(q)
    tiny = np.finfo(np.float64).tiny / _EPS
    held = lambda x: x if abs(x) > tiny else tiny
    down, left, s = np.empty(n), np.empty(n - 1), np.empty(n)
    s[0] = -shift
    for i in range(n - 1):
        down[i] = held(s[i] + q[i])
        left[i] = q[i] * low[i] / down[i]
        s[i + 1] = left[i] * low[i] * s[i] - shift
    up, right, p = np.empty(n), np.empty(n - 1), np.empty(n)
    p[-1] = q[-1] - shift
    for i in range(n - 2, -1, -1):
        up[i + 1] = held(q[i] * low[i] * low[i] + p[i + 1])
        ratio = q[i] / up[i + 1]
        right[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - shift
    gamma = s + p + shift
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    y = np.zeros(n) if rhs is None else rhs.astype(np.float64).copy()
    if rhs is None:
        z[k] = 1.0
    else:
        for i in range(k):
            y[i + 1] -= left[i] * y[i]
        for i in range(n - 2, k - 1, -1):
            y[i] -= right[i] * y[i + 1]
        y[:k] /= down[:k]
        y[k + 1:] /= up[k + 1:]
        z[k] = y[k] / (gamma[k] if abs(gamma[k]) > _EPS * _EPS * shift else held(_EPS * shift))
    for i in range(k - 1, -1, -1):
        z[i] = y[i] - left[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = y[i + 1] - right[i] * z[i]
    size = np.linalg.norm(z)
    return z / size if np.isfinite(size) and size > 0 else np.eye(n)[k]


def right_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors (columns) of the bidiagonal matrix for its leading singular values."""
    n, rng = len(a), np.random.default_rng(13)
    out = np.zeros((n, len(values)))
    if not len(values):
        return out
    a = np.where(np.abs(a) > 1e-3 * _EPS * values[0], a, 1e-3 * _EPS * values[0])
    q, low = a * a, b / a[:-1]
    first = 0
    for j, s in enumerate(values):
        if j and values[j - 1] - s > _CLUSTER * values[j - 1]:
            first = j
        z = _twisted(q, low, s * s)
        close = out[:, first:j]
        for attempt in range(8):
            left = z - close @ (close.T @ z)
            left -= close @ (close.T @ left)
            size = np.linalg.norm(left)
            if size > 0.5 or (size > 1e-2 and attempt):
                z = left / size
                break
            # the same direction again: start elsewhere and let inverse iteration find what is left of the cluster
            z = rng.normal(size=n)
            for _ in range(2):
                z -= close @ (close.T @ z)
                z = _twisted(q, low, s * s * (1.0 + 2 * _EPS * (j - first)), z)
        out[:, j] = z / np.linalg.norm(z)
    return out


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``(values, directions)``: leading singular values of a square matrix above rounding, and right singular vectors as columns."""
    a, b, v = bidiagonal(r)
    s = dqds(a, b)
    s = s[s > len(a) * _EPS * s[0]][:most] if len(s) and s[0] > 0 else s[:0]
    return s, v @ right_vectors(a, b, s)


def whole_numbers(c: np.ndarray) -> np.ndarray:
    """``floor(64 c) + 1000000`` as 64-bit integers; entries beyond 2^53 are held there."""
    return np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _rows(batch: pa.RecordBatch, column: str, dim: int) -> tuple[np.ndarray, pa.RecordBatch]:
    """Integer matrix of the vectors of one length in a batch, and their part of the batch."""
    part = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column(column)), dim))
    flat = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return whole_numbers(flat).reshape(-1, dim), part


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S`` exactly: 64-bit integers where they fit, Python's otherwise."""
    top = max(int(np.abs(x).max(initial=0)) * n, max((abs(s) for s in sums), default=0))
    if 2 * top < 1 << 63:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _squares(y: np.ndarray) -> list[int]:
    top = max((abs(int(y.max())), abs(int(y.min()))), default=0) if y.size else 0
    if y.dtype == object or top * top * max(1, y.shape[1]) >= 1 << 63:
        y = y.astype(object)
    return [int(v) for v in (y * y).sum(axis=1)]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, v)`` of the rows that take part: vectors that are not null or empty and hold finite numbers only."""
    v = F.col(vector)
    return vectors.select(F.col(key).alias("id"), v.cast("array<double>").alias("v")).where(
        v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    )


def column_sums(rows: DataFrame) -> list[tuple[int, int, list[int]]]:
    """``(length, rows, exact sums of the integer entries)`` of each vector length; partial sums a batch, added up by Spark."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            for dim in pa.compute.unique(pa.compute.list_value_length(b.column("v"))).to_pylist():
                x, _ = _rows(b, "v", dim)
                fits = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
                s = [int(t) for t in (x if fits else x.astype(object)).sum(axis=0)]
                n, old = held.get(dim, (0, [0] * dim))
                held[dim] = n + len(x), [p + q for p, q in zip(old, s)]
        for dim, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()),
                 pa.array([Decimal(t) for t in s], pa.decimal128(38, 0))], ["dim", "at", "n", "s"],
            )

    parts = rows.select("v").mapInArrow(part, "dim int, at int, n bigint, s decimal(38,0)")
    got = parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).groupBy("dim").agg(
        F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda p: p["s"]).alias("s")
    )
    return sorted((r["dim"], r["n"], [int(x) for x in r["s"]]) for r in got.toLocalIterator())


def triangular_factors(rows: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> DataFrame:
    """``(dim, r)``: one triangular factor of the centred rows for each vector length, by QR within tasks and a tree of merges."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for dim in pa.compute.unique(pa.compute.list_value_length(b.column("v"))).to_pylist():
                x, _ = _rows(b, "v", dim)
                n, s = sums[dim]
                step = max(1024, 8 * dim)
                for at in range(0, len(x), step):
                    y = _scaled(x[at: at + step], n, s).astype(np.float64) / n
                    held[dim] = np.linalg.qr(np.vstack((held[dim], y)) if dim in held else y, mode="r")
        for dim, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["dim", "r"])

    def merge(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        r = reduce(lambda one, two: np.linalg.qr(np.vstack((one, two)), mode="r"),
                   (np.frombuffer(t.as_py()).reshape(-1, dim) for t in group.column("r")))
        return pa.table({"dim": pa.array([dim], pa.int32()), "r": pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())})

    now = keep(rows.select("v").mapInArrow(block, "dim int, r binary"), "factors")
    while True:
        most = now.groupBy("dim").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return now
        groups = -(-most // FAN_IN)
        dealt = now.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(groups)))
        after = keep(dealt.groupBy("dim", "g").applyInArrow(merge, "dim int, r binary"), "factors")
        drop_kept(now)
        now = after


def _fit(factors: DataFrame, sizes: dict[int, int], most: int) -> DataFrame:
    """``(dim, n, m, explained)``: whitening matrix (bytes, length x components) and shares of the variance."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, r in zip(b.column("dim").to_pylist(), b.column("r").to_pylist()):
                r = np.frombuffer(r).reshape(-1, dim)
                r = np.vstack((r, np.zeros((dim - len(r), dim))))
                s, v = principal(r, most)
                matrix = v / s * np.sqrt(sizes[dim])  # variance along a direction is s^2 / n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([np.ascontiguousarray(matrix).tobytes()], pa.binary()),
                     pa.array([(s * s / np.sum(r * r)).tolist() if len(s) else []], pa.list_(pa.float64()))], ["dim", "m", "explained"],
                )

    return factors.mapInArrow(solve, "dim int, m binary, explained array<double>")


def _identity_errors(rows: DataFrame, model, dims: list[int]) -> dict[int, float]:
    """Largest absolute entry of the whitened rows' covariance minus the identity, for each vector length."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for dim in pa.compute.unique(pa.compute.list_value_length(b.column("v"))).to_pylist():
                n, s, m, _ = model.value[dim]
                x, _ = _rows(b, "v", dim)
                w = _scaled(x, n, s).astype(np.float64) / n @ m
                w = np.hstack((w, np.ones((len(w), 1))))
                held[dim] = held.get(dim, 0.0) + w.T @ w / n
        for dim, c in held.items():
            flat = c.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(flat), dim, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["dim", "at", "c"]
            )

    got = rows.select("v").mapInArrow(part, "dim int, at int, c double").groupBy("dim", "at").agg(F.sum("c").alias("c"))
    cells: dict[int, dict[int, float]] = {}
    for r in got.toLocalIterator():  # at most 33 x 33 numbers for each length
        cells.setdefault(r["dim"], {})[r["at"]] = r["c"]
    out = {}
    for dim in dims:
        k = int(np.sqrt(len(cells[dim])))
        c = np.array([cells[dim][i] for i in range(k * k)]).reshape(k, k)
        mean = c[-1, :-1]
        out[dim] = float(np.abs(c[:-1, :-1] - np.outer(mean, mean) - np.eye(k - 1)).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``: each row along each of up to ``most`` directions.

    Entries become integers ``floor(64 c) + 1000000`` first (held at 2^53). ``deviation`` is a decimal(38, 0). Rows with
    null or empty vectors, or null or non-finite entries, take no part; zero vectors, repeated rows and rows with a null key do, each on its own.
    Vectors of different lengths are fitted apart, with their own ``n``. Directions without variance (constant or
    dependent entries, a single row, equal rows) are left out, so their rows may be fewer than ``most`` or none. An empty table gives
    an empty one. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    sums = {dim: (n, s) for dim, n, s in column_sums(rows)}
    kind = dict(vectors.dtypes)[key]
    columns = f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not sums:
        return spark.createDataFrame([], columns).toDF(*names)
    factors = triangular_factors(rows, sums)
    fitted = keep(_fit(factors, {d: n for d, (n, _) in sums.items()}, most), "directions")
    drop_kept(factors)
    # lengths are fitted in one broadcast as long as their matrices are small, in several waves beyond
    waves, size = [[]], 0
    for dim in sums:
        bytes_ = 8 * dim * (most + 4)
        if waves[-1] and size + bytes_ > WAVE_BYTES:
            waves.append([])
            size = 0
        waves[-1].append(dim)
        size += bytes_
    parts = []
    for dims in waves:
        got = {r["dim"]: r for r in fitted.where(F.col("dim").isin(dims)).toLocalIterator()}
        model = spark.sparkContext.broadcast({
            d: (*sums[d], np.frombuffer(got[d]["m"]).reshape(d, -1), np.array(got[d]["explained"])) for d in dims
        })
        part = rows.where(F.size("v").isin(dims)) if len(waves) > 1 else rows
        parts.append(_whitened(part, model, _identity_errors(part, model, dims), columns))
    drop_kept(fitted)
    return reduce(DataFrame.union, parts).toDF(*names)


def _whitened(rows: DataFrame, model, errors: dict[int, float], columns: str) -> DataFrame:
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                for dim in pa.compute.unique(pa.compute.list_value_length(b.column("v"))).to_pylist():
                    n, s, m, explained = model.value[dim]
                    k = m.shape[1]
                    x, part = _rows(b, "v", dim)
                    y = _scaled(x, n, s)
                    each = np.repeat(np.arange(len(x)), k)
                    deviation = pa.array([Decimal(v) for v in _squares(y)], pa.decimal128(38, 0))
                    yield pa.RecordBatch.from_arrays([
                        part.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), n, np.int64)), deviation.take(pa.array(each)),
                        pa.array((y.astype(np.float64) / n @ m).ravel()), pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(each), errors[dim])),
                    ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, columns)
