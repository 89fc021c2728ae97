"""Layouts of points whose positions fit in memory: one job an epoch over packed edges.

Edges lie in blocks of consecutive points (compressed rows), written once. Positions, at most ``POSITION_ROWS`` rows as the caller
checks, are broadcast as an array; each block gives back what its own points need, and the driver adds it up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chromaspark.functions.reuse import hot, keep

BLOCK = 512  # points of one block
OPEN = 0.5  # a cell counts as one mass if its width is less than this share of its distance
LEAF = 8  # points below which a cell is not parted any more
LEVELS = 20
PAIRS = 1 << 19  # (point, cell) pairs handled at a time


class Edges:
    """Edges ``(i, j, p)`` between ids as blocks of compressed rows over the places of the sorted ids."""

    def __init__(self, edges: DataFrame, ids: np.ndarray):
        self.spark, self.n = edges.sparkSession, len(ids)
        shared = self.spark.sparkContext.broadcast(ids)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                i, j = (np.searchsorted(shared.value, b.column(c).to_numpy()) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(i // BLOCK), pa.array(i), pa.array(j), b.column(2)], ["block", "i", "j", "p"])

        def pack(group: pa.Table) -> pa.Table:
            block = group.column("block")[0].as_py()
            i, j, p = (group.column(c).to_numpy() for c in ("i", "j", "p"))
            order = np.lexsort((j, i))
            parts = (i[order] - block * BLOCK).astype(np.int32), j[order].astype(np.int32), p[order].astype(np.float64)
            return pa.table({"block": pa.array([block], pa.int64()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip("ijp", parts)}})

        placed = edges.select("i", "j", "p").mapInArrow(place, "block bigint, i bigint, j bigint, p double")
        # an edge of no weight in each block, so that points without edges have a block, too
        blocks = self.spark.range(-(-self.n // BLOCK)).select(F.col("id").alias("block"), (F.col("id") * BLOCK).alias("i"), (F.col("id") * BLOCK).alias("j"), F.lit(0.0).alias("p"))
        placed = placed.union(blocks)
        schema = "block bigint, i binary, j binary, p binary"
        cores = self.spark.sparkContext.defaultParallelism
        packed = keep(placed.groupBy("block").applyInArrow(pack, schema).repartitionByRange(max(cores, self.n // (64 * BLOCK)), "block"))
        # small files would be read by few tasks
        self.blocks = hot(packed.repartition(cores) if self.n <= 64 * BLOCK * cores else packed)

    def each(self, payload: object, work: Callable) -> dict[int, np.ndarray]:
        """``work(payload, block, i, j, p)``, a float array, for each block; ``i`` counts within the block."""
        shared = self.spark.sparkContext.broadcast(payload)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, i, j, p in zip(*(b.column(c).to_pylist() for c in range(4))):
                    out = work(shared.value, block, np.frombuffer(i, np.int32), np.frombuffer(j, np.int32), np.frombuffer(p))
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["block", "out"])

        got = {r["block"]: np.frombuffer(r["out"]) for r in self.blocks.mapInArrow(run, "block bigint, out binary").collect()}
        shared.destroy()
        return got

    def close(self) -> None:
        self.blocks.unpersist()


def space_tree(y: np.ndarray) -> dict[str, np.ndarray]:
    """Cells of a quadtree (octree) over the points, level by level: mass, centre, width and the range of each cell's children."""
    n, dims = y.shape
    low = y.min(axis=0)
    width = max(float((y.max(axis=0) - low).max()), 1e-12) * (1 + 1e-9)
    cell = np.zeros(n, np.int64)
    mass, centre, size, first, last = [np.array([n])], [y.mean(axis=0)[None]], [width], [], []
    inside = np.arange(n) if n > LEAF else np.zeros(0, np.int64)
    base, level = 0, 0
    sizes = [1]
    while level < LEVELS and len(inside):
        level += 1
        step = width / 2.0**level
        side = (np.floor((y[inside] - low) / step).astype(np.int64) & 1) @ (1 << np.arange(dims))
        code = cell[inside] * (1 << dims) + side
        found, where = np.unique(code, return_inverse=True)
        count = np.bincount(where)
        sums = np.stack([np.bincount(where, weights=y[inside, c]) for c in range(dims)], axis=1)
        mass.append(count)
        centre.append(sums / count[:, None])
        parent = found >> dims
        begin, end = np.searchsorted(parent, np.arange(sizes[-1]), "left"), np.searchsorted(parent, np.arange(sizes[-1]), "right")
        offset = base + sizes[-1]
        first.append(np.where(end > begin, begin + offset, 0))
        last.append(np.where(end > begin, end + offset, 0))
        base, cell[inside] = offset, where
        sizes.append(len(found))
        size.append(step)
        inside = inside[count[where] > LEAF]
    for more in sizes[len(first):]:
        first.append(np.zeros(more, np.int64))
        last.append(np.zeros(more, np.int64))
    return {
        "mass": np.concatenate(mass).astype(float), "centre": np.concatenate(centre), "width": np.repeat(size, sizes),
        "first": np.concatenate(first).astype(np.int64), "last": np.concatenate(last).astype(np.int64),
    }


def repulsion(tree: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per point: the sum of ``mass / (1 + d2)`` over the tree, and the unscaled force; a point meets itself with mass one."""
    z, force = np.zeros(len(x)), np.zeros_like(x)
    mass, centre, width, first, last = (tree[k] for k in ("mass", "centre", "width", "first", "last"))
    step = max(1, PAIRS // 256)
    for at in range(0, len(x), step):
        point = np.arange(at, min(at + step, len(x)))
        cell = np.zeros(len(point), np.int64)
        while len(point):
            gap = x[point] - centre[cell]
            d2 = (gap * gap).sum(axis=1)
            done = (first[cell] == 0) | (width[cell] ** 2 < OPEN * OPEN * d2)
            p, q = point[done], 1.0 / (1.0 + d2[done])
            m = mass[cell[done]] * q
            z += np.bincount(p, weights=m, minlength=len(x))
            for c in range(x.shape[1]):
                force[:, c] += np.bincount(p, weights=m * q * gap[done, c], minlength=len(x))
            point, cell = point[~done], cell[~done]
            many = last[cell] - first[cell]
            point = np.repeat(point, many)
            cell = np.repeat(first[cell] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    return z, force


def tsne_positions(edges: Edges, y: np.ndarray, epochs: int, exaggeration: float) -> tuple[np.ndarray, float, float]:
    """Gradient descent with momentum and gains; positions, and the loss (without the entropy of ``p``) at the first and last epoch."""
    n, dims = y.shape
    u, gain, early, losses = np.zeros_like(y), np.ones_like(y), epochs // 4, []
    rate = n / (4.0 * exaggeration)  # higher rates do not settle: the loss then rises again after the exaggeration

    def work(payload: tuple, block: int, i: np.ndarray, j: np.ndarray, p: np.ndarray) -> np.ndarray:
        y, tree = payload
        own = y[block * BLOCK: (block + 1) * BLOCK]
        gap = own[i] - y[j]
        d2 = (gap * gap).sum(axis=1)
        pull = np.stack([np.bincount(i, weights=p / (1 + d2) * gap[:, c], minlength=len(own)) for c in range(gap.shape[1])], axis=1)
        z, force = repulsion(tree, own)
        stress = np.bincount(i, weights=p * np.log1p(d2), minlength=len(own))
        return np.column_stack((pull, force, z - 1.0, stress)).ravel()

    for t in range(epochs):
        got = edges.each((y, space_tree(y)), work)
        rows = np.concatenate([got[b].reshape(-1, 2 * dims + 2) for b in sorted(got)])
        pull, force, z, stress = rows[:, :dims], rows[:, dims: 2 * dims], max(rows[:, -2].sum(), 1e-12), rows[:, -1].sum()
        if t in (0, epochs - 1):
            losses.append(float(stress + np.log(z)))
        boost, momentum = (exaggeration, 0.5) if t < early else (1.0, 0.8)
        grad = 4.0 * (boost * pull - force / z)
        gain = np.clip(np.where(np.sign(grad) == np.sign(u), gain * 0.8, gain + 0.2), 0.01, None)
        u = momentum * u - rate * gain * grad
        y = y + u
        y -= y.mean(axis=0)
    return y, losses[0], losses[-1]


def sampled(weight: np.ndarray, heaviest: float, epoch: int) -> np.ndarray:
    """How often each edge is sampled in an epoch: the heaviest once, others in proportion, evenly spread."""
    share = weight / heaviest
    return (np.floor((epoch + 1) * share + 1e-9) - np.floor(epoch * share + 1e-9)).astype(np.int64)


def umap_positions(edges: Edges, y: np.ndarray, epochs: int, negatives: int, a: float, b: float, heaviest: float) -> tuple[np.ndarray, float, float]:
    """Cross-entropy descent, edge by edge: every sampled edge pulls its first point, which is then pushed from ``negatives`` others.

    A point takes its edges one after the other, seeing its own moves but the others' positions of the epoch's start. The others to be
    pushed from are hashes of (epoch, point, turn), so the same under any partitioning. Returns positions and the
    weighted log distance at the first and last epoch.
    """
    n, dims = y.shape
    stress = []

    def work(payload: tuple, block: int, i: np.ndarray, j: np.ndarray, p: np.ndarray) -> np.ndarray:
        y, epoch = payload
        rate = 1.0 - epoch / epochs
        x = y[block * BLOCK: (block + 1) * BLOCK].copy()
        gap = x[i] - y[j]
        told = float((p * np.log1p((gap * gap).sum(axis=1))).sum())
        on = np.flatnonzero(sampled(p, heaviest, epoch))
        i, j = i[on], j[on]
        turn = np.arange(len(i)) - np.searchsorted(i, i)  # i is sorted
        for r in range(int(turn.max(initial=-1)) + 1):
            at = np.flatnonzero(turn == r)
            me, other = i[at], j[at]
            gap = x[me] - y[other]
            d2 = np.maximum((gap * gap).sum(axis=1), 1e-12)
            x[me] += rate * np.clip((-2.0 * a * b * d2 ** (b - 1.0) / (1.0 + a * d2**b))[:, None] * gap, -4, 4)
            for k in range(negatives):
                h = (me + block * BLOCK).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(epoch * 1_000_003 + r * 101 + k)
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                far = (h ^ (h >> np.uint64(31))) % np.uint64(n)
                gap = x[me] - y[far]
                d2 = (gap * gap).sum(axis=1)
                push = np.clip((2.0 * b / ((1e-3 + d2) * (1.0 + a * np.maximum(d2, 1e-12) ** b)))[:, None] * gap, -4, 4)
                x[me] += rate * np.where((far == me + block * BLOCK)[:, None], 0.0, push)
        return np.append(x.ravel(), told)

    for t in range(epochs):
        with np.errstate(over="ignore"):
            got = edges.each((y, t), work)
        if t in (0, epochs - 1):
            stress.append(float(sum(v[-1] for v in got.values())))
        y = y.copy()
        for block, v in got.items():
            y[block * BLOCK: (block + 1) * BLOCK] = v[:-1].reshape(-1, dims)
    return y, stress[0], stress[-1]


def arrays(state: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and positions of a state table that the caller has counted."""
    names = [f"e{c + 1}" for c in range(dims)]
    t = state.select("id", *names).toArrow()
    ids = t.column("id").to_numpy()
    order = np.argsort(ids)
    return ids[order], np.column_stack([t.column(c).to_numpy() for c in names])[order]


def table(spark, ids: np.ndarray, y: np.ndarray) -> DataFrame:
    """``(id, e1, e2[, e3])``, kept."""
    columns = {"id": pa.array(ids), **{f"e{c + 1}": pa.array(y[:, c].copy()) for c in range(y.shape[1])}}
    return keep(spark.createDataFrame(pa.table(columns)))
