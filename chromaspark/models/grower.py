"""Histogram trees grown level by level, many at a time.

Rows are packed vectors (weight, target) whose features are cut into bins. One pass over the blocks of rows gives, for each open
node of each growing tree, the sums of every bin; the best split of a node follows from its sums alone. All trees of
a forest, all folds and all points of a grid share a pass: a forest of 50 trees is the beginning of one of 100, a tree of
depth 10 the top of a deeper one, and 50 rounds of boosting are the first of 100.

Packed blocks up to ``LOCAL_BYTES`` are broadcast and each task grows trees of its own. Beyond that bound the
blocks stay where they are and each level is a Spark job: sums per block, added up by (tree, node) in a shuffle, splits found where
the sums meet. The driver holds trees only, never rows or sums.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from chromaspark.functions.columns import features_as
from chromaspark.functions.reuse import keep

LOCAL_BYTES = 32 << 20  # packed blocks that are broadcast whole
WAVE_NODES = 20_000  # open nodes of one distributed pass, about
BINS = 1024  # of a feature; a feature with no more distinct values is cut between all of them
LEAST_GAIN = 1e-12  # of a node's score; below it a split is rounding
DEEP = 10_000  # no limit: trees end where rows are equal


@dataclass
class Tree:
    """Nodes in order of growth: ``left`` is the first child (-1 for a leaf, the second follows), rows up to bin ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    sums: np.ndarray
    gain: np.ndarray
    path: np.ndarray  # hash of the way to the node, the seed of its choice of features

    @staticmethod
    def root(sums: np.ndarray, seed: int) -> Tree:
        one = np.zeros(1, np.int32)
        return Tree(one.copy(), one.copy(), one - 1, sums[None].astype(float), np.zeros(1), np.array([mix(np.uint64(seed))], np.uint64))

    def down(self, bins: np.ndarray, steps: int = DEEP, node: np.ndarray | None = None) -> np.ndarray:
        """Node of each row (columns of ``bins``) after at most ``steps`` levels."""
        node = np.zeros(bins.shape[1], np.int32) if node is None else node.copy()
        rows = np.arange(bins.shape[1])
        for _ in range(steps):
            inner = np.flatnonzero(self.left[node[rows]] >= 0)
            if not len(inner):
                break
            rows = rows[inner]
            at = node[rows]
            node[rows] = self.left[at] + (bins[self.feature[at], rows] > self.cut[at])
        return node


@dataclass
class Spec:
    """One tree to grow: its data (``fold`` left out, -1 for none), the bootstrap seed, and what it is for."""

    kind: str  # "mean", "class" (class shares) or "boost" (residuals of column ``of`` of a booster)
    fold: int
    depth: int
    seed: int = 0
    bootstrap: bool = False
    some: int = 0  # features tried at each node; 0 for all
    of: int = 0
    booster: Booster | None = None
    n_labels: int = 0


@dataclass
class Booster:
    """A start value and rounds of trees with leaf values; one column for each class (one for regression)."""

    start: np.ndarray
    rate: float
    classify: bool
    rounds: list[list[tuple[Tree, np.ndarray]]] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)

    def raw(self, bins: np.ndarray, first: int = 0, raw: np.ndarray | None = None) -> np.ndarray:
        raw = np.tile(self.start, (bins.shape[1], 1)) if raw is None else raw
        for trees in self.rounds[first:]:
            for k, (tree, value) in enumerate(trees):
                raw[:, k] += self.rate * value[tree.down(bins)]
        return raw


def mix(x):
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson(mean: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
    """Poisson draws that depend on the rows' ids and the seed only, so the same under any partitioning.

    A vector that stands for ``w`` runs gets the sum of ``w`` draws of mean one: the bootstrap of single runs with a free total.
    """
    h = mix(ids ^ mix(np.uint64(seed)))
    u = (h >> np.uint64(11)).astype(float) / 2.0**53
    out = np.zeros(len(mean))
    few = mean <= 32
    p = np.exp(-mean[few])
    total, n, left = p.copy(), np.zeros(few.sum()), u[few]
    for i in range(1, 200):
        more = left > total
        if not more.any():
            break
        n += more
        p = p * mean[few] / i
        total += p
    out[few] = n
    many = np.flatnonzero(~few)
    out[many] = _poisson_many(mean[many], h[many])
    return out


def _poisson_many(mean: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """``default_rng(seed).poisson(mean)`` of each row, for means of 10 and more, a few tries of all rows at a time.

    NumPy's transformed rejection; a row whose test is within rounding, or that needs more tries, gets a generator of its own.
    """
    out, left = np.zeros(len(mean)), np.arange(len(mean))
    draws, alone = first_doubles(seeds, 8), []
    with np.errstate(divide="ignore", invalid="ignore"):
        for u, v in zip(draws[::2], draws[1::2]):
            m, u, v = mean[left], u[left] - 0.5, v[left]
            b = 0.931 + 2.53 * np.sqrt(m)
            a = -0.059 + 0.02483 * b
            us = 0.5 - np.abs(u)
            k = np.floor((2 * a / us + b) * u + m + 0.43)
            sure = (us >= 0.07) & (v <= 0.9277 - 3.6224 / (b - 2))
            never = ~sure & ((k < 0) | ((us < 0.013) & (v > us)))
            x = np.maximum(k, 0.0) + 1
            gamma = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
            gap = np.log(v) + np.log(1.1239 + 1.1328 / (b - 3.4)) - np.log(a / (us * us) + b) - (k * np.log(m) - m - gamma)
            close = ~sure & ~never & ((x < 8) | ~(np.abs(gap) > 1e-5))
            done = sure | (~never & ~close & (gap < 0))
            out[left[done]] = k[done]
            alone.append(left[close])
            left = left[~done & ~close]
    for i in np.concatenate((left, *alone)):
        out[i] = np.random.default_rng(int(seeds[i])).poisson(mean[i])
    return out


def first_doubles(seeds: np.ndarray, n: int) -> list[np.ndarray]:
    """The first ``n`` numbers of ``default_rng(seed).random()`` for every seed (uint64) at once: SeedSequence and PCG64 over arrays."""
    small, big = np.uint32, np.uint64
    low32, half = big(0xFFFFFFFF), big(32)
    with np.errstate(over="ignore"):
        const = small(0x43B0D7E5)

        def hashed(v: np.ndarray) -> np.ndarray:
            nonlocal const
            v, const = v ^ const, const * small(0x931E8875)
            v = v * const
            return v ^ (v >> small(16))

        none = np.zeros(len(seeds), small)
        pool = [hashed(v) for v in ((seeds & low32).astype(small), (seeds >> half).astype(small), none, none)]
        for i in range(4):
            for j in range(4):
                if i != j:
                    v = small(0xCA01F9DD) * pool[j] - small(0x4973F715) * hashed(pool[i])
                    pool[j] = v ^ (v >> small(16))
        const, words = small(0x8B51F9DD), []
        for i in range(8):
            v, const = pool[i % 4] ^ const, const * small(0x58F38DED)
            v = v * const
            words.append((v ^ (v >> small(16))).astype(big))
        start_high, start_low, step_high, step_low = (words[2 * i] | (words[2 * i + 1] << half) for i in range(4))
        step_high, step_low = (step_high << big(1)) | (step_low >> big(63)), (step_low << big(1)) | big(1)
        times_high, times_low = big(2549297995355413924), big(4865540595714422341)

        def plus(high, low, more_high, more_low):
            total = low + more_low
            return high + more_high + (total < low), total

        def step(high, low):
            a, b, c, d = low & low32, low >> half, times_low & low32, times_low >> half
            middle = (a * c >> half) + (a * d & low32) + (b * c & low32)
            carried = b * d + (a * d >> half) + (b * c >> half) + (middle >> half) + high * times_low + low * times_high
            return plus(carried, low * times_low, step_high, step_low)

        high, low = step(*plus(step_high, step_low, start_high, start_low))
        out = []
        for _ in range(n):
            high, low = step(high, low)
            x, turn = high ^ low, high >> big(58)
            x = (x >> turn) | (x << ((big(64) - turn) & big(63)))
            out.append((x >> big(11)).astype(float) / 2.0**53)
    return out


@dataclass
class Block:
    """Packed rows: ``bins`` (features x rows), weight, target, spread inside the row, fold and an id.

    Blocks that are at hand also have the distinct columns of ``bins`` and which of them each row is: trees of classes are grown on these.
    """

    bins: np.ndarray
    w: np.ndarray
    y: np.ndarray
    ss: np.ndarray
    fold: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray | None = None
    which: np.ndarray | None = None

    def with_vectors(self) -> Block:
        """The rows stay in order, so sums over a vector's rows are the same wherever they are made."""
        _, first, which = np.unique(self.bins.T, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(first)  # vectors as they come
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.vectors, self.which = np.ascontiguousarray(self.bins[:, first[order]]), place[which.ravel()]
        return self


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def statistics(block: Block, spec: Spec, raw: np.ndarray | None = None) -> np.ndarray:
    """Per row: weight, then what is averaged (a target or class weights), then for boosted classes the curvature."""
    w = np.where(block.fold != spec.fold, block.w, 0.0)
    if spec.bootstrap:
        w = np.where(w > 0, poisson(block.w, block.ids, spec.seed), 0.0)
    if spec.kind == "mean":
        return np.stack((w, w * block.y), axis=1)
    if spec.kind == "class":
        return np.concatenate((w[:, None], w[:, None] * (block.y[:, None] == np.arange(spec.n_labels))), axis=1)
    raw = spec.booster.raw(block.bins) if raw is None else raw
    if not spec.booster.classify:
        return np.stack((w, w * (block.y - raw[:, 0])), axis=1)
    r = (block.y == spec.of) - softmax(raw)[:, spec.of]
    return np.stack((w, w * r, w * np.abs(r) * (1 - np.abs(r))), axis=1)


def vector_statistics(block: Block, spec: Spec, raw: np.ndarray | None = None, held: dict | None = None) -> np.ndarray:
    """:func:`statistics` of classes, added up over the rows of each distinct vector; ``raw`` has a row a vector, ``held`` keeps what rounds share."""
    size = block.vectors.shape[1]
    held = {} if held is None else held
    if "w" not in held:
        held["w"] = np.where(block.fold != spec.fold, block.w, 0.0)
        if spec.bootstrap:
            live = held["w"] > 0
            held["w"][live] = poisson(block.w[live], block.ids[live], spec.seed)
    if "classes" not in held:
        k = spec.n_labels or len(spec.booster.start)
        place = block.which * k + block.y.astype(np.int64)
        held["classes"] = np.bincount(place, weights=held["w"], minlength=size * k).reshape(size, k)
    classes = held["classes"]
    weight = classes.sum(axis=1)
    if spec.kind == "class":
        return np.concatenate((weight[:, None], classes), axis=1)
    p = softmax(raw)[:, spec.of]
    return np.stack((weight, classes[:, spec.of] * (1 - p) - (weight - classes[:, spec.of]) * p, weight * p * (1 - p)), axis=1)


def labels_of(block: Block, spec: Spec) -> np.ndarray | None:
    return block.y.astype(np.int64) if spec.kind == "class" else None


def width(spec: Spec) -> int:
    """Columns of the statistics that are averaged."""
    return spec.n_labels if spec.kind == "class" else 1


def histogram(bins: np.ndarray, sizes: list[int], slot: np.ndarray, slots: int, stats: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Sums of each (open node, bin of each feature): slots x all bins x statistics. Rows with slot -1 count nowhere.

    With class shares each row has weight in the column of its ``label`` only, so one count serves all classes.
    """
    use = np.flatnonzero((slot >= 0) & (stats[:, 0] > 0))
    slot, stats = slot[use].astype(np.int64), stats[use]
    out, at = np.zeros((slots, sum(sizes), stats.shape[1])), 0
    for f, size in enumerate(sizes):
        place = slot * size + bins[f, use]
        if label is not None:
            k = stats.shape[1] - 1
            some = np.bincount(place * k + label[use], weights=stats[:, 0], minlength=slots * size * k).reshape(slots, size, k)
            out[:, at: at + size, 0], out[:, at: at + size, 1:] = some.sum(axis=2), some
            at += size
            continue
        for k in range(stats.shape[1]):
            out[:, at: at + size, k] = np.bincount(place, weights=stats[:, k], minlength=slots * size).reshape(slots, size)
        at += size
    return out


def _score(s: np.ndarray, averaged: int) -> np.ndarray:
    return (s[..., 1: 1 + averaged] ** 2).sum(axis=-1) / np.maximum(s[..., 0], 1e-300)


@dataclass
class Splits:
    """The best split of each node: whether there is one, feature, cut, gain, sums left and right."""

    real: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @staticmethod
    def of(found: list[tuple | None], width: int) -> Splits:
        some = [f if f is not None else (0, 0, 0.0, np.zeros(width), np.zeros(width)) for f in found]
        return Splits(np.array([f is not None for f in found]), *[np.array([f[i] for f in some]) for i in range(5)])


def _chosen(gains: np.ndarray, cuts: np.ndarray, lefts: list[np.ndarray], total: np.ndarray, base: np.ndarray, some: int, path: np.ndarray) -> Splits:
    """Ties go to the first feature."""
    if some:  # the first few of a random order of the features that can be split at all
        order = mix(path[:, None] ^ mix(np.arange(1, gains.shape[1] + 1, dtype=np.uint64))[None, :]).astype(float)
        order[~np.isfinite(gains)] = np.inf
        rank = order.argsort(axis=1).argsort(axis=1)
        gains = np.where(rank < some, gains, -np.inf)
    best, at = gains.argmax(axis=1), np.arange(len(gains))
    left = np.array(lefts)[best, at]
    gain = gains[at, best]
    return Splits(gain > LEAST_GAIN * np.maximum(base, 1e-300), best, cuts[at, best], gain, left, total - left)


def best_splits(hist: np.ndarray, sizes: list[int], averaged: int, some: int, path: np.ndarray) -> Splits:
    """The best split of each node from the sums of all bins; ties go to the first feature and cut."""
    slots, total, at = len(hist), hist[:, : sizes[0]].sum(axis=1), 0
    base = _score(total, averaged)
    gains, cuts, lefts = np.full((slots, len(sizes)), -np.inf), np.zeros((slots, len(sizes)), np.int64), []
    for f, size in enumerate(sizes):
        left = np.cumsum(hist[:, at: at + size], axis=1)[:, :-1]
        at += size
        if size > 1:
            right = total[:, None] - left
            real = (left[..., 0] > 1e-9) & (right[..., 0] > 1e-9)
            gain = np.where(real, _score(left, averaged) + _score(right, averaged) - base[:, None], -np.inf)
            cuts[:, f] = gain.argmax(axis=1)
            gains[:, f] = gain[np.arange(slots), cuts[:, f]]
            lefts.append(left[np.arange(slots), cuts[:, f]])
        else:
            lefts.append(np.zeros_like(total))
    return _chosen(gains, cuts, lefts, total, base, some, path)


def sparse_splits(bins: np.ndarray, sizes: list[int], slot: np.ndarray, slots: int, stats: np.ndarray, averaged: int, some: int, path: np.ndarray) -> Splits:
    """:func:`best_splits` of rows whose nodes are ``slot``, from the bins that hold rows only; every slot has rows."""
    use = np.flatnonzero((slot >= 0) & (stats[:, 0] > 0))
    slot, stats = slot[use].astype(np.int64), stats[use]
    gains, cuts, lefts = np.full((slots, len(sizes)), -np.inf), np.zeros((slots, len(sizes)), np.int64), []
    total = base = None
    for f, size in enumerate(sizes):
        key, at = np.unique(slot * size + bins[f, use], return_inverse=True)
        sums = np.stack([np.bincount(at, weights=stats[:, k], minlength=len(key)) for k in range(stats.shape[1])], axis=1)
        node = key // size
        first = np.flatnonzero(np.diff(node, prepend=-1))
        length = np.diff(np.append(first, len(key)))
        for step in range(1, length.max()):  # running sums within each node, added in order
            place = first[length > step] + step
            sums[place] += sums[place - 1]
        if total is None:
            total = sums[first + length - 1]
            base = _score(total, averaged)
        right = total[node] - sums
        real = (sums[:, 0] > 1e-9) & (right[:, 0] > 1e-9)
        gain = np.where(real, _score(sums, averaged) + _score(right, averaged) - base[node], -np.inf)
        gains[:, f] = np.maximum.reduceat(gain, first)
        best = np.minimum.reduceat(np.where(gain == gains[node, f], np.arange(len(key)), len(key)), first)
        cuts[:, f] = key[best] - node[best] * size
        lefts.append(sums[best])
    return _chosen(gains, cuts, lefts, total, base, some, path)


def extend(tree: Tree, open_: np.ndarray, splits: Splits, classes: bool) -> np.ndarray:
    """Split the open nodes of a tree; returns its new open nodes (those of one class are done)."""
    real, n = np.flatnonzero(splits.real), len(tree.left)
    node, more = open_[real], 2 * len(real)
    if more:
        tree.feature[node], tree.cut[node], tree.gain[node] = splits.feature[real], splits.cut[real], splits.gain[real]
        tree.left[node] = n + 2 * np.arange(len(real))
        with np.errstate(over="ignore"):
            paths = mix(tree.path[node][:, None] * np.uint64(2) + np.arange(2, dtype=np.uint64)[None, :]).ravel()
        sums = np.stack((splits.left[real], splits.right[real]), axis=1).reshape(more, -1)
        grown = lambda x, fill: np.concatenate((x, np.full(more, fill, x.dtype)))
        tree.feature, tree.cut, tree.gain = grown(tree.feature, 0), grown(tree.cut, 0), grown(tree.gain, 0)
        tree.left, tree.sums = grown(tree.left, -1), np.concatenate((tree.sums, sums))
        tree.path = np.concatenate((tree.path, paths))
    new = np.arange(n, n + more)
    return new[tree.sums[new, 1:].max(axis=1) < tree.sums[new, 0] * (1 - 1e-12)] if classes and more else new


def _slots(tree: Tree, open_: np.ndarray, node: np.ndarray) -> np.ndarray:
    place = np.full(len(tree.left), -1, np.int64)
    place[open_] = np.arange(len(open_))
    return place[node]


def grow_here(blocks: list[Block], sizes: list[int], spec: Spec, raws: list[np.ndarray] | None = None, held: list[dict] | None = None) -> Tree:
    """One tree from blocks that are at hand; ``raws`` has a row a vector of each block."""
    if len(blocks) != 1:
        raise ValueError("a tree is grown on one block")
    block, raw = blocks[0], raws[0] if raws else None
    if spec.kind == "class" or spec.kind == "boost" and spec.booster.classify:
        bins, stats = block.vectors, vector_statistics(block, spec, raw, held[0] if held else None)
    else:  # sums of targets depend on their order in the last digits, which decide between equal splits, so rows are added one by one
        bins, stats = block.bins, statistics(block, spec, None if raw is None else raw[block.which])
    tree, open_ = Tree.root(stats.sum(axis=0), spec.seed), np.zeros(1, np.int64)
    node = np.zeros(bins.shape[1], np.int32)
    live = stats[:, 0] > 0
    for _ in range(spec.depth if live.any() else 0):
        slot = _slots(tree, open_, node)
        if len(open_) * sum(sizes) > 2 * bins.size:  # most bins of most nodes are empty
            splits = sparse_splits(bins, sizes, slot, len(open_), stats, width(spec), spec.some, tree.path[open_])
        else:
            splits = best_splits(histogram(bins, sizes, slot, len(open_), stats), sizes, width(spec), spec.some, tree.path[open_])
        open_ = extend(tree, open_, splits, spec.kind == "class")
        node = tree.down(bins, 1, node)
        # a node of one vector or row cannot be split
        open_ = open_[np.bincount(node[live], minlength=len(tree.left))[open_] > 1]
        if not len(open_):
            break
    return tree


def left_out_score(blocks: list[Block], predicted: list[np.ndarray], fold: int, classify: bool) -> float:
    """Root mean square error, or accuracy of the largest column, on the rows of one fold."""
    total = weight = 0.0
    for b, p in zip(blocks, predicted):
        at = np.flatnonzero(b.fold == fold)
        w, y, p = b.w[at], b.y[at], p[at]
        total += (w * (p.argmax(axis=1) == y)).sum() if classify else (w * (y - p[:, 0]) ** 2 + b.ss[at]).sum()
        weight += w.sum()
    return float("nan") if not weight else float(total / weight if classify else np.sqrt(total / weight))


def leaf_values(tree: Tree, booster: Booster) -> np.ndarray:
    """Step of each node of a tree on residuals: their mean, for classes by Newton's rule."""
    s = tree.sums
    if not booster.classify:
        return s[:, 1] / np.maximum(s[:, 0], 1e-300)
    k = len(booster.start)
    return np.where(s[:, 2] > 1e-150, (k - 1) / k * s[:, 1] / np.maximum(s[:, 2], 1e-150), 0.0)


class Rows:
    """Packed rows of a training table as blocks of bins, with the cut points of every feature."""

    def __init__(self, packed: DataFrame, features: list[str], n_labels: int, bins: int = BINS):
        self.spark, self.features, self.n_labels = packed.sparkSession, features, n_labels
        values = packed.selectExpr(*features_as(features), "fold", "cast(y AS double) AS y", "w", "ss")
        self.cuts = cut_points(values, features, bins)
        self.sizes = [len(c) + 1 for c in self.cuts]
        cuts, names = self.cuts, list(features)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = [b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]
                y, w, ss, fold = (b.column(n).to_numpy(zero_copy_only=False) for n in ("y", "w", "ss", "fold"))
                ids = np.full(len(y), np.uint64(7))
                for c in (*x, y.astype(float), fold.astype(float)):
                    with np.errstate(over="ignore"):
                        ids = mix(ids * np.uint64(31) + (c + 0.0).view(np.uint64))
                binned = np.array([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x)], dtype=np.uint16)
                block = Block(binned, w.astype(float), y.astype(float), ss.astype(float), fold.astype(np.int32), ids)
                yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(block)], pa.binary())], ["block"])

        self.blocks = keep(values.mapInArrow(pack, "block binary"))
        size = self.blocks.selectExpr("coalesce(sum(octet_length(block)), 0) AS b").first()["b"]
        self.shared = None
        if size <= LOCAL_BYTES:
            held = [pickle.loads(bytes(r["block"])) for r in self.blocks.collect()]
            one = Block(np.concatenate([b.bins for b in held], axis=1), *[np.concatenate([getattr(b, n) for b in held]) for n in ("w", "y", "ss", "fold", "ids")])
            self.shared = self.spark.sparkContext.broadcast([one.with_vectors()])

    def each(self, jobs: list, work: Callable) -> list:
        """``work(blocks, job)`` for each job, one Spark task a job where cores allow; broadcast blocks only."""
        if not jobs:
            return []
        shared = self.shared
        table = self.spark.createDataFrame([(i, cloudpickle.dumps(j)) for i, j in enumerate(jobs)], "i int, job binary")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, job in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    out = cloudpickle.dumps(work(shared.value, pickle.loads(job)))
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([out], pa.binary())], ["i", "out"])

        dealt = table.repartitionByRange(min(len(jobs), 4 * self.spark.sparkContext.defaultParallelism), "i")
        got = dealt.mapInArrow(run, "i int, out binary").collect()
        return [pickle.loads(bytes(r["out"])) for r in sorted(got, key=lambda r: r["i"])]

    def grow(self, specs: list[Spec]) -> list[Tree]:
        """All trees of ``specs``."""
        if self.shared is not None:
            sizes = self.sizes
            return self.each(specs, lambda blocks, spec: grow_here(blocks, sizes, spec))
        out: list[Tree] = []
        step = max(1, WAVE_NODES // 200)
        for at in range(0, len(specs), step):
            out += self._grow_far(specs[at: at + step])
        return out

    def totals(self, specs: list[Spec]) -> list[np.ndarray]:
        """Sums of the statistics of each tree's rows."""
        return [t.sums[0] for t in self.grow([Spec(**{**s.__dict__, "depth": 0}) for s in specs])]

    def _grow_far(self, specs: list[Spec]) -> list[Tree]:
        """Level by level over the blocks where they are."""
        shared = self.spark.sparkContext.broadcast(specs)
        k = [1 + width(s) + (s.kind == "boost" and s.booster.classify) for s in specs]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for raw in b.column(0).to_pylist():
                    block = pickle.loads(raw)
                    for t, spec in enumerate(shared.value):
                        total[t] = total.get(t, 0.0) + statistics(block, spec).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["t", "s"])

        trees = [Tree.root(np.zeros(n), s.seed) for n, s in zip(k, specs)]
        roots = self.blocks.mapInArrow(sums, "t int, s array<double>").selectExpr("t", "posexplode(s) AS (i, v)").groupBy("t", "i").agg(F.sum("v").alias("v"))
        for r in roots.toLocalIterator():
            trees[r["t"]].sums[0, r["i"]] = r["v"]
        open_ = {t: np.zeros(1, np.int64) for t, s in enumerate(specs) if s.depth > 0}
        sizes = self.sizes
        while open_:
            now = self.spark.sparkContext.broadcast({t: (trees[t], nodes) for t, nodes in open_.items()})

            def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for raw in b.column(0).to_pylist():
                        block = pickle.loads(raw)
                        for t, (tree, nodes) in now.value.items():
                            stats = statistics(block, shared.value[t])
                            slot = _slots(tree, nodes, tree.down(block.bins))
                            met = np.unique(slot[slot >= 0])
                            short = np.full(len(nodes) + 1, -1)
                            short[met] = np.arange(len(met))
                            hist = histogram(block.bins, sizes, short[slot], len(met), stats, labels_of(block, shared.value[t]))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(met), t, np.int32)), pa.array(met.astype(np.int32)), pa.array([h.tobytes() for h in hist], pa.binary())],
                                ["t", "slot", "h"],
                            )

            def choose(group: pa.Table) -> pa.Table:
                t, slot = group.column("t")[0].as_py(), group.column("slot")[0].as_py()
                spec, (tree, nodes) = shared.value[t], now.value[t]
                hist = sum(np.frombuffer(h.as_py()) for h in group.column("h")).reshape(1, sum(sizes), -1)
                best = best_splits(hist, sizes, width(spec), spec.some, tree.path[nodes[slot: slot + 1]])
                split = (best.feature[0], best.cut[0], best.gain[0], best.left[0], best.right[0]) if best.real[0] else None
                return pa.table({"t": pa.array([t], pa.int32()), "slot": pa.array([slot], pa.int32()), "split": pa.array([cloudpickle.dumps(split)], pa.binary())})

            found = self.blocks.mapInArrow(level, "t int, slot int, h binary").groupBy("t", "slot").applyInArrow(choose, "t int, slot int, split binary")
            splits = {t: [None] * len(nodes) for t, nodes in open_.items()}
            for r in found.toLocalIterator():
                splits[r["t"]][r["slot"]] = pickle.loads(bytes(r["split"]))
            after = {}
            for t, nodes in open_.items():
                new = extend(trees[t], nodes, Splits.of(splits[t], k[t]), specs[t].kind == "class")
                if len(new) and specs[t].depth > _levels(trees[t]):
                    after[t] = new
            open_ = after
        return trees

    def boost(self, jobs: list[tuple[int, int, float]], rounds: int, classify: bool) -> list[Booster]:
        """A booster for each (fold left out, depth, rate), with all its rounds; ``scores`` holds the left-out fold's after each, if blocks are at hand."""
        n = self.n_labels if classify else 1
        kind = "class" if classify else "mean"
        totals = self.totals([Spec(kind, fold, 0, n_labels=self.n_labels) for fold, _, _ in jobs])
        starts = [np.log(np.maximum(s[1:] / max(s[0], 1e-300), 1e-12)) if classify else s[1:] / max(s[0], 1e-300) for s in totals]
        if self.shared is not None:
            sizes = self.sizes

            def whole(blocks: list[Block], job: tuple) -> Booster:
                (fold, depth, rate), start = job
                booster = Booster(start, rate, classify)
                raws = [booster.raw(b.vectors) for b in blocks]
                held: list[dict] = [{} for _ in blocks]
                for _ in range(rounds):
                    trees = [grow_here(blocks, sizes, Spec("boost", fold, depth, of=c, booster=booster), raws, held) for c in range(n)]
                    booster.rounds.append([(t, leaf_values(t, booster)) for t in trees])
                    raws = [booster.raw(b.vectors, len(booster.rounds) - 1, r) for b, r in zip(blocks, raws)]
                    booster.scores.append(left_out_score(blocks, [r[b.which] for b, r in zip(blocks, raws)], fold, classify))
                return booster

            return self.each(list(zip(jobs, starts)), whole)
        boosters = [Booster(start, rate, classify) for start, (_, _, rate) in zip(starts, jobs)]
        for _ in range(rounds):
            specs = [Spec("boost", fold, depth, of=c, booster=b) for b, (fold, depth, _) in zip(boosters, jobs) for c in range(n)]
            trees = self.grow(specs)
            for i, b in enumerate(boosters):
                b.rounds.append([(t, leaf_values(t, b)) for t in trees[i * n: (i + 1) * n]])
        return boosters


def _levels(tree: Tree) -> int:
    depth = np.zeros(len(tree.left), np.int32)
    for node in np.flatnonzero(tree.left >= 0):
        depth[tree.left[node]: tree.left[node] + 2] = depth[node] + 1
    return int(depth.max())


def cut_points(values: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Cut points of every feature: half-way between all distinct values, or between quantiles of the rows where there are more than ``bins``."""
    counts = values.agg(*[F.approx_count_distinct(F.col(f"`{f}`"), 0.02).alias(f"c{i}") for i, f in enumerate(features)]).first()
    out = []
    for i, f in enumerate(features):
        some = None
        if counts[i] <= 1.1 * bins:
            got = values.select(F.col(f"`{f}`").alias("v")).distinct().orderBy("v").limit(bins + 1).collect()
            some = np.array([r["v"] for r in got]) if len(got) <= bins else None
        if some is None:
            some = np.unique(values.approxQuantile(f"`{f}`", list(np.linspace(0, 1, bins)), 0.1 / bins))
        out.append((some[:-1] + some[1:]) / 2)
    return out


def real_cuts(tree: Tree, cuts: list[np.ndarray]) -> np.ndarray:
    """Cut values of the inner nodes (0 for leaves)."""
    return np.array([cuts[f][c] if left >= 0 else 0.0 for f, c, left in zip(tree.feature, tree.cut, tree.left)])


def importances(trees: Iterable[Tree], n_features: int) -> list[float]:
    """Mean over the trees of each feature's share of the gains."""
    rows = []
    for t in trees:
        g = np.bincount(t.feature, weights=t.gain, minlength=n_features)
        if g.sum() > 0:
            rows.append(g / g.sum())
    mean = np.mean(rows, axis=0) if rows else np.zeros(n_features)
    return [float(v) for v in (mean / mean.sum() if mean.sum() > 0 else mean)]
