"""t-SNE and UMAP layouts of distinct feature vectors.

Both build an exact neighbour graph, turn it into symmetric edge weights and then move the points.
Attraction runs along the edges. Up to ``POSITION_ROWS`` points (module ``layout``) t-SNE's repulsion comes from a space tree and
UMAP samples single edges and negatives; beyond, positions are a table and repulsion comes from a grid summary of all
points (cell counts and centroids). Runs with equal features share one point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chromaspark.analysis import layout
from chromaspark.analysis.pca import pca
from chromaspark.functions.columns import col, double, features_as
from chromaspark.functions.nearest import nearest
from chromaspark.functions.reuse import cut_lineage, hot, keep
from chromaspark.operators.lookup import lookup_join
from chromaspark.operators.neighbours import as_vectors, distinct_vectors
from chromaspark.schema import RUN_ID, quoted

POSITION_ROWS = 500_000  # positions broadcast below this count, shuffled above
GRID = {2: 64, 3: 16}  # cells per axis; at most 4,096 cells


def _packed_neighbours(near: DataFrame) -> DataFrame:
    """One row per vector with its (at most k) neighbours in order of distance."""
    items = F.array_sort(F.collect_list(F.struct("d2", "tid")))
    return near.groupBy("qid").agg(items.alias("near"))


def _row_weights(packed: DataFrame, weigh) -> DataFrame:
    """Directed edge weights ``(i, j, w)``; ``weigh`` maps distances (rows x k, padded inf) to weights."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sizes = np.array([len(x) for x in b["near"]])
            d = np.full((len(b), sizes.max()), np.inf)
            t = np.zeros(d.shape, dtype=np.int64)
            for r, items in enumerate(b["near"]):
                for c, item in enumerate(items):
                    d[r, c], t[r, c] = np.sqrt(item["d2"]), item["tid"]
            w = weigh(d)
            i = np.repeat(b["qid"].to_numpy(), sizes)
            mask = np.arange(d.shape[1])[None, :] < sizes[:, None]
            yield pd.DataFrame({"i": i, "j": t[mask], "w": w[mask]})

    return packed.mapInPandas(run, "i bigint, j bigint, w double")


def perplexity_weights(d: np.ndarray, perplexity: float, rounds: int = 64) -> np.ndarray:
    """Gaussian neighbour probabilities whose entropy is log(perplexity), by bisection."""
    real = np.isfinite(d)
    d2 = np.where(real, d, 0.0) ** 2
    d2 = d2 - np.where(real, d2, np.inf).min(axis=1, keepdims=True)
    target = np.log(np.minimum(perplexity, real.sum(axis=1)))
    lo, hi, beta = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    p = np.zeros(d.shape)
    for _ in range(rounds):
        e = np.where(real, np.exp(-d2 * beta[:, None]), 0.0)
        s = e.sum(axis=1)
        p = e / s[:, None]
        entropy = np.log(s) + beta * (d2 * p).sum(axis=1)
        high = entropy > target
        lo, hi = np.where(high, beta, lo), np.where(high, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    return p


def fuzzy_weights(d: np.ndarray, rounds: int = 64) -> np.ndarray:
    """UMAP membership: exp(-(d - rho) / sigma), sigma set so that a row sums to log2(k)."""
    real = np.isfinite(d)
    rho = np.where(real & (d > 0), d, np.inf).min(axis=1)
    rho = np.where(np.isfinite(rho), rho, 0.0)
    gap = np.maximum(np.where(real, d, 0.0) - rho[:, None], 0.0)
    target = np.log2(np.maximum(real.sum(axis=1), 2))
    lo, hi, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    w = np.zeros(d.shape)
    for _ in range(rounds):
        w = np.where(real, np.exp(-gap / sigma[:, None]), 0.0)
        big = w.sum(axis=1) > target
        hi, lo = np.where(big, sigma, hi), np.where(big, lo, sigma)
        sigma = np.where(np.isinf(hi), sigma * 2, (lo + hi) / 2)
    return w


def tsne_graph(vectors: DataFrame, perplexity: float = 30.0, cell_rows: int = 4096) -> DataFrame:
    """Symmetric joint probabilities ``(i, j, p)``, both directions, summing to 1."""
    k = max(1, int(3 * perplexity))
    near = nearest(vectors, vectors, k, exclude_self=True, cell_rows=cell_rows)
    rows = _row_weights(_packed_neighbours(near), lambda d: perplexity_weights(d, perplexity))
    both = rows.unionByName(rows.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    n = vectors.count()
    return both.groupBy("i", "j").agg((F.sum("w") / (2.0 * n)).alias("p"))


def umap_graph(vectors: DataFrame, k: int = 15, cell_rows: int = 4096) -> DataFrame:
    """Fuzzy union ``a + b - ab`` of the directed memberships ``(i, j, p)``, both directions.

    The neighbour count includes the point itself, as is usual for this method.
    """
    near = nearest(vectors, vectors, max(1, k - 1), exclude_self=True, cell_rows=cell_rows)
    rows = _row_weights(_packed_neighbours(near), fuzzy_weights)
    both = rows.select("i", "j", F.col("w").alias("a"), F.lit(0.0).alias("b")).unionByName(
        rows.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("a"), F.col("w").alias("b"))
    )
    pair = both.groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return pair.select("i", "j", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("p"))


@dataclass
class Layout:
    """Positions of the distinct vectors and the loss at the first and last epoch."""

    positions: DataFrame
    features: list[str]
    leaves: DataFrame
    first_loss: float
    last_loss: float

    def points(self, df: DataFrame, key: str = RUN_ID) -> DataFrame:
        """``(key, e1, e2[, e3])`` for every run."""
        dims = [c for c in self.positions.columns if c.startswith("e")]
        alias = {f: f"_f{i}" for i, f in enumerate(self.features)}
        named = keep(self.leaves.join(self.positions, "id").withColumnsRenamed(alias).select(*alias.values(), *dims))
        rows = df.selectExpr(quoted(key), *features_as(list(alias), list(alias.values())))
        return lookup_join(rows, named, list(alias.values()), "inner", spread=F.xxhash64(col(key))).select(col(key), *dims)


def _start(vectors: DataFrame, dims: int, spread: float) -> DataFrame:
    """Initial positions: the leading principal directions, scaled to ``spread``, plus a hash jitter."""
    size = vectors.select(F.size("v").alias("d")).first()["d"]
    wide = vectors.select("id", *[F.get("v", F.lit(i)).alias(f"x{i}") for i in range(size)])
    fit = pca(wide, [f"x{i}" for i in range(size)], dims)
    scores = fit.scores(wide, key="id")
    scale = spread / max(float(np.sqrt(fit.variance[0])) if len(fit.variance) else 0.0, 1e-12)

    def jitter(c: int):
        return (F.pmod(F.xxhash64("id", F.lit(c)), F.lit(10_007)) / 10_007.0 - 0.5) * (0.02 * spread)

    cells = [
        ((F.col(f"pc{c + 1}") * scale if c < fit.loadings.shape[1] else F.lit(0.0)) + jitter(c)).alias(f"e{c + 1}")
        for c in range(dims)
    ]
    zeros = [F.lit(0.0).alias(f"u{c + 1}") for c in range(dims)]
    gains = [F.lit(1.0).alias(f"g{c + 1}") for c in range(dims)]
    return cut_lineage(scores.select("id", *cells, *zeros, *gains))


def _grid(state: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and centroids of the occupied grid cells: at most ``GRID[dims] ** dims`` rows."""
    es = [f"e{c + 1}" for c in range(dims)]
    box = state.selectExpr(*[f"{fn}({e}) AS {fn}_{e}" for e in es for fn in ("min", "max")]).first()
    steps = GRID[dims]
    cell = []
    for e in es:
        low, width = box[f"min_{e}"], max((box[f"max_{e}"] - box[f"min_{e}"]) / steps, 1e-12)
        cell.append(f"least(floor(({e} - {double(low)}) / {double(width)}), {steps - 1}) AS c_{e}")
    rows = state.selectExpr(*es, *cell).groupBy(*[f"c_{e}" for e in es]).agg(
        F.expr("count(1) AS n"), *[F.expr(f"avg({e}) AS {e}") for e in es]
    ).collect()
    return np.array([r["n"] for r in rows], dtype=np.float64), np.array([[r[e] for e in es] for r in rows])


def _edges_with_positions(edges: DataFrame, state: DataFrame, dims: int, small: bool) -> DataFrame:
    es = [f"e{c + 1}" for c in range(dims)]
    at_i = state.selectExpr("id AS i", *[f"{e} AS i{e}" for e in es])
    at_j = state.selectExpr("id AS j", *[f"{e} AS j{e}" for e in es])
    if small:  # counted against POSITION_ROWS
        at_i, at_j = F.broadcast(at_i), F.broadcast(at_j)
    return edges.join(at_j, "j").join(at_i, "i")


def _attraction(edges: DataFrame, state: DataFrame, dims: int, small: bool, pull: str) -> DataFrame:
    """Sum over the edges of ``p * pull * (y_i - y_j)`` per point (``pull`` is SQL text in ``d2``), with the loss pieces."""
    es = [f"e{c + 1}" for c in range(dims)]
    rows = _edges_with_positions(edges, state, dims, small)
    gaps = [f"(i{e} - j{e}) AS x{e}" for e in es]
    d2 = " + ".join(f"x{e} * x{e}" for e in es)
    rows = rows.selectExpr("i", "p", *gaps).selectExpr("*", f"{d2} AS d2").selectExpr("*", f"p * ({pull}) AS f")
    return rows.groupBy(F.col("i").alias("id")).agg(
        *[F.expr(f"sum(f * x{e}) AS a{e}") for e in es], F.expr("sum(p) AS degree"),
        F.expr("sum(p * log1p(d2)) AS stress"),
    )


def _advance(state: DataFrame, pulls: DataFrame, dims: int, small: bool, move) -> DataFrame:
    """Join pulls to points and let ``move`` (NumPy, per batch) produce the next state."""
    es, us, gs = ([f"{p}{c + 1}" for c in range(dims)] for p in "eug")
    pulls = F.broadcast(pulls) if small else pulls
    joined = state.select("id", *es, *us, *gs).join(pulls, "id", "left").fillna(0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            y, u, g = (b[c].to_numpy(dtype=np.float64) for c in (es, us, gs))
            a = b[[f"a{e}" for e in es]].to_numpy(dtype=np.float64)
            y, u, g, extra = move(y, u, g, a, b["degree"].to_numpy())
            out = pd.DataFrame(np.hstack([y, u, g]), columns=[*es, *us, *gs])
            out.insert(0, "id", b["id"].to_numpy())
            out["z"], out["stress"] = extra, b["stress"].to_numpy()
            yield out

    schema = "id bigint, " + ", ".join(f"{c} double" for c in [*es, *us, *gs]) + ", z double, stress double"
    return joined.mapInPandas(run, schema)


def tsne_layout(vectors: DataFrame, edges: DataFrame, dims: int = 2, epochs: int = 250, exaggeration: float = 12.0):
    """Gradient descent with momentum and gains; returns positions and KL at the first and last epoch."""
    n = vectors.count()
    small = n <= POSITION_ROWS
    edges = keep(edges)
    entropy = edges.agg(F.sum(F.col("p") * F.log("p"))).first()[0] or 0.0
    state = _start(vectors, dims, 1.0)
    if small and epochs and n > 1:
        ids, y = layout.arrays(state, dims)
        packed = layout.Edges(edges, ids)
        y, first, last = layout.tsne_positions(packed, y, epochs, exaggeration)
        packed.close()
        return layout.table(vectors.sparkSession, ids, y), entropy + first, entropy + last
    edges = hot(edges)
    early = epochs // 4
    losses = []
    for t in range(epochs):
        count, center = _grid(state, dims)
        boost = exaggeration if t < early else 1.0
        momentum = 0.5 if t < early else 0.8
        rate = n / (4.0 * exaggeration)  # higher rates do not settle: the loss then rises again after the exaggeration

        def repulse(y):
            diff2 = np.zeros((len(y), len(center)))
            for c in range(dims):
                diff2 += (y[:, c][:, None] - center[:, c][None, :]) ** 2
            q = count[None, :] / (1.0 + diff2)
            q2 = q / (1.0 + diff2)
            force = y * q2.sum(axis=1, keepdims=True) - q2 @ center
            return np.maximum(q.sum(axis=1) - 1.0, 1e-12), force

        z = float((repulse(center)[0] * count).sum())

        def move(y, u, g, a, degree, z=z, boost=boost, momentum=momentum, rate=rate, repulse=repulse):
            mass, force = repulse(y)
            grad = 4.0 * (boost * a - force / z)
            same = np.sign(grad) == np.sign(u)
            g = np.clip(np.where(same, g * 0.8, g + 0.2), 0.01, None)
            u = momentum * u - rate * g * grad
            return y + u, u, g, mass

        pulls = _attraction(edges, state, dims, small, "1D / (1D + d2)")
        state = cut_lineage(_advance(state, pulls, dims, small, move))
        if t in (early, epochs - 1) or t == 0:
            s = state.agg(F.sum("z").alias("z"), F.sum("stress").alias("s")).first()
            losses.append(entropy + s["s"] + float(np.log(max(s["z"], 1e-12))))
    return state.select("id", *[f"e{c + 1}" for c in range(dims)]), losses[0], losses[-1]


# Curve parameters for min_dist 0.1, spread 1.0.
CURVE_A, CURVE_B = 1.577, 0.895


def umap_layout(vectors: DataFrame, edges: DataFrame, dims: int = 2, epochs: int = 200, negatives: int = 5):
    """Cross-entropy descent with a falling rate, edge by edge; beyond ``POSITION_ROWS`` points by the expected force of each point."""
    n = vectors.count()
    small = n <= POSITION_ROWS
    edges = keep(edges)
    state = _start(vectors, dims, 5.0)
    a_, b_ = CURVE_A, CURVE_B
    heaviest = edges.agg(F.max("p")).first()[0]
    if small and epochs and heaviest:
        ids, y = layout.arrays(state, dims)
        packed = layout.Edges(edges, ids)
        y, first, last = layout.umap_positions(packed, y, epochs, negatives, a_, b_, heaviest)
        packed.close()
        return layout.table(vectors.sparkSession, ids, y), first, last
    edges = hot(edges)

    safe = "greatest(d2, 1e-12D)"
    pull = f"{double(-2.0 * a_ * b_)} * pow({safe}, {double(b_ - 1.0)}) / (1D + {double(a_)} * pow({safe}, {double(b_)}))"

    stress = []
    for t in range(epochs):
        count, center = _grid(state, dims)
        rate = 1.0 - t / epochs

        def move(y, u, g, a, degree, rate=rate, count=count, center=center):
            diff2 = np.zeros((len(y), len(center)))
            for c in range(dims):
                diff2 += (y[:, c][:, None] - center[:, c][None, :]) ** 2
            k = 2.0 * b_ / ((1e-3 + diff2) * (1.0 + a_ * np.maximum(diff2, 1e-12) ** b_)) * count[None, :] / n
            push = y * k.sum(axis=1, keepdims=True) - k @ center
            step = np.clip(a, -4, 4) + np.clip(negatives * degree[:, None] * push, -4, 4)
            return y + rate * step, u, g, np.zeros(len(y))

        pulls = _attraction(edges, state, dims, small, pull)
        state = cut_lineage(_advance(state, pulls, dims, small, move))
        if t in (0, epochs - 1):
            stress.append(float(state.agg(F.sum("stress")).first()[0] or 0.0))
    return state.select("id", *[f"e{c + 1}" for c in range(dims)]), stress[0], stress[-1]


def _vectors(df: DataFrame, features: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    leaves = cut_lineage(distinct_vectors(df, features, key))
    return leaves, keep(as_vectors(leaves, None, features))


def tsne(df: DataFrame, features: list[str], dims: int = 2, perplexity: float = 30.0, epochs: int = 250, key: str = RUN_ID) -> Layout:
    leaves, vectors = _vectors(df, features, key)
    pos, first, last = tsne_layout(vectors, tsne_graph(vectors, perplexity), dims, epochs)
    return Layout(pos, list(features), leaves, first, last)


def umap(df: DataFrame, features: list[str], dims: int = 2, k: int = 15, epochs: int = 200, key: str = RUN_ID) -> Layout:
    leaves, vectors = _vectors(df, features, key)
    pos, first, last = umap_layout(vectors, umap_graph(vectors, k), dims, epochs)
    return Layout(pos, list(features), leaves, first, last)
