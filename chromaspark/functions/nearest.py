"""Exact nearest-vector search between two tables of vectors.

Vectors are grouped into cells by a k-d cut of the train side. Each query is first compared with the
cells closest to it, which gives an upper bound of its k-th distance, and then only with the
remaining cells whose bounding box comes within that bound. Cells are packed into small blocks, so
the work is an ordinary equi-join on (cell, block) followed by a NumPy kernel over block pairs; a
crowded cell is many join keys, not one. Vectors of many dimensions, where boxes prune next to nothing,
are compared in a grid of (query group, train group) instead, so a vector travels once per group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chromaspark.functions.reuse import keep

DIGITS = 9  # distances are compared after rounding, so equal vectors tie in every engine
MAX_CELLS = 16_384
SAMPLE = 40_000
FLAT_DIMS = 16  # with more dimensions every pair of groups is compared
GROUP_BYTES = 16 << 20  # of the vectors of one group


@dataclass
class Cells:
    """A k-d cut with the bounding box, row count and smallest weight of each cell."""

    dims: np.ndarray
    cuts: np.ndarray
    depth: int
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray
    weight: np.ndarray

    def locate(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            d = self.dims[node]
            right = x[np.arange(len(x)), d] > self.cuts[node]
            node = 2 * node + 1 + right
        return node

    def within(self, x: np.ndarray, limit: float) -> np.ndarray:
        """Indexes of the cells whose box may lie within ``limit`` (squared) of some row of ``x``."""
        gap = np.maximum(np.maximum(self.low - x.max(axis=0), x.min(axis=0) - self.high), 0.0)
        return np.flatnonzero(~((gap**2).sum(axis=1) > limit))

    def box_distance(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Squared distance of every row of ``x`` to every cell box, or to those at ``at``."""
        low, high = (self.low, self.high) if at is None else (self.low[at], self.high[at])
        total = np.zeros((len(x), len(low)))
        for d in range(x.shape[1]):
            gap = np.maximum(low[:, d][None, :] - x[:, d][:, None], x[:, d][:, None] - high[:, d][None, :])
            total += np.maximum(gap, 0.0) ** 2
        return total


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64) if len(values) else np.zeros((0, 1))


def _cut_value(x: np.ndarray) -> float:
    """A value at or near the median with rows on both sides of it, if there are two values at all."""
    middle = np.median(x)
    if (x > middle).any():
        return float(middle)
    below = x[x < middle]  # half of the rows or more hold the largest value: they form one side
    return float(below.max()) if len(below) else float(middle)


def _cut_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Median cuts along the widest dimension; the sample only shapes cells, never the result."""
    size = 2**depth - 1
    dims, cuts = np.zeros(max(size, 1), dtype=np.int64), np.full(max(size, 1), np.inf)
    members = {0: np.arange(len(sample))}
    for node in range(size):
        rows = members.pop(node, np.zeros(0, dtype=np.int64))
        if len(rows) > 1:
            part = sample[rows]
            d = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            dims[node], cuts[node] = d, _cut_value(part[:, d])
            right = part[:, d] > cuts[node]
            members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
    return dims, cuts


def _with_cell(df: DataFrame, cells: Cells | None, schema: str) -> DataFrame:
    if cells is None or cells.depth == 0:
        return df.withColumn("cell", F.lit(0).cast("bigint"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["cell"] = cells.locate(_matrix(b["v"]))
                yield b

    return df.mapInPandas(place, schema + ", cell bigint")


def _block_rows(dim: int) -> int:
    return int(max(32, min(1024, 8192 // max(dim, 1))))


def nearest(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    exclude_self: bool = False,
    ward: bool = False,
    cell_rows: int = 4096,
) -> DataFrame:
    """The ``k`` train vectors closest to each query: ``(qid, tid, d2)``.

    Both inputs are ``(id bigint, v array<double>, w double)`` with unique ids. Ties go to the smaller
    ``tid``. With ``ward`` the squared distance is scaled by 2*wq*wt/(wq+wt), the merge cost of two
    clusters of those sizes; ties then follow a hash of the pair, so that equal-distance chains do
    not all point the same way.
    """
    train = keep(train.select("id", "v", F.col("w").cast("double").alias("w")))
    queries = queries.select("id", "v", F.col("w").cast("double").alias("w"))
    head = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    n, dim = head["n"], head["d"] or 1
    schema = "id bigint, v array<double>, w double"
    if dim > FLAT_DIMS and not ward:
        return _best(_grid(queries, train, n, dim, k, exclude_self), k).drop("tie")
    depth = 0 if n <= 2 * cell_rows else min(int(np.ceil(np.log2(n / cell_rows))), int(np.log2(MAX_CELLS)))
    cells = None
    if depth:
        share = min(1.0, SAMPLE / n * 1.2)
        rows = train.select("v").sample(False, share, 42).limit(SAMPLE).collect()
        dims, cuts = _cut_tree(np.array([r["v"] for r in rows], dtype=np.float64), depth)
        empty = np.zeros(0)
        cells = Cells(dims, cuts, depth, empty, empty, empty, empty, empty)
    placed = _with_cell(train, cells, schema)
    rows = int(min(_block_rows(dim), max(64, n // (4 * train.sparkSession.sparkContext.defaultParallelism))))
    if cells is None:
        packed, blocks = _train_blocks(placed, {0: n}, rows)
        wanted = queries.withColumn("cell", F.lit(0).cast("bigint"))
        return _best(_pairs(wanted, packed, blocks, rows, dim, k, exclude_self, ward), k).drop("tie")

    placed = keep(placed)
    stats = placed.groupBy("cell").agg(
        F.expr("count(1) AS n"), F.expr("min(w) AS w"),
        *[F.expr(f"{fn}(v[{i}]) AS {a}{i}") for i in range(dim) for fn, a in (("min", "lo"), ("max", "hi"))],
    ).orderBy("cell").collect()  # at most MAX_CELLS rows
    cells.ids = np.array([r["cell"] for r in stats])
    cells.count = np.array([r["n"] for r in stats])
    cells.weight = np.array([r["w"] if r["w"] is not None else 1.0 for r in stats])
    cells.low = np.array([[r[f"lo{i}"] for i in range(dim)] for r in stats])
    cells.high = np.array([[r[f"hi{i}"] for i in range(dim)] for r in stats])
    sizes = {int(c): int(m) for c, m in zip(cells.ids, cells.count)}
    packed, blocks = _train_blocks(placed, sizes, rows)
    packed = keep(packed)
    need = k + (1 if exclude_self else 0)

    def scaled(box: np.ndarray, w: np.ndarray) -> np.ndarray:
        if not ward:
            return box
        return box * (2 * w[:, None] * cells.weight[None, :] / (w[:, None] + cells.weight[None, :]))

    held = np.zeros(2 ** (depth + 1), dtype=np.int64)  # rows by cell id
    held[cells.ids] = cells.count
    slot = np.zeros(len(held), dtype=np.int64)
    slot[cells.ids] = np.arange(len(cells.ids))

    def first_cells(x: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        """Indexes of the cells met first: the vector's own where it holds enough rows, else the closest ones."""
        if ward:
            return closest_cells(x, w)
        home = cells.locate(x)
        chosen: list = [slot[h : h + 1] for h in home]
        short = np.flatnonzero(held[home] < need)
        if len(short):
            for i, c in zip(short, closest_cells(x[short], w[short])):
                chosen[i] = c
        return chosen

    def closest_cells(x: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(scaled(cells.box_distance(x), w), axis=1, kind="stable")
        have = np.cumsum(cells.count[order], axis=1)
        stop = np.argmax(have >= need, axis=1)
        stop = np.where(have[:, -1] >= need, stop, order.shape[1] - 1)
        return [order[i, : stop[i] + 1] for i in range(len(x))]

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _chunks(b, 512):
                x, w = _matrix(part["v"]), part["w"].to_numpy(dtype=np.float64)
                chosen = first_cells(x, w)
                yield _repeat(part, [cells.ids[c] for c in chosen])

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _chunks(b, 128):
                x, w = _matrix(part["v"]), part["w"].to_numpy(dtype=np.float64)
                done = first_cells(x, w)
                bound = part["bound"].to_numpy(dtype=np.float64)
                limit = bound + 1e-8 + 1e-9 * np.abs(bound)
                at = np.arange(len(cells.ids)) if ward else cells.within(x, limit.max())
                box = cells.box_distance(x, at)
                if ward:
                    box = scaled(box, w)
                open_ = ~(box > limit[:, None])
                yield _repeat(part, [cells.ids[np.setdiff1d(at[o], d)] for o, d in zip(open_, done)])

    if not ward:  # queries of one cell side by side, so that they are packed together
        queries = keep(_with_cell(queries, cells, schema).repartitionByRange(
            _parts(train.sparkSession, n), "cell", "id").sortWithinPartitions("cell").drop("cell"))
    close = keep(_best(_pairs(queries.mapInPandas(near, schema + ", cell bigint"), packed, blocks, rows, dim, k,
                              exclude_self, ward), k))
    bound = close.groupBy("qid").agg(F.max("d2").alias("bound"), F.count(F.lit(1)).alias("m"))
    bounded = queries.join(bound, queries["id"] == bound["qid"], "left").select(
        "id", "v", "w", F.when(F.col("m") >= k, F.col("bound")).otherwise(F.lit(float("inf"))).alias("bound")
    )
    if not ward:  # neighbours side by side, so that a chunk of queries has a small box
        bounded = _with_cell(bounded, cells, schema + ", bound double").repartitionByRange(
            _parts(train.sparkSession, n), "cell", "id").sortWithinPartitions("cell").drop("cell")
    more = _pairs(bounded.mapInPandas(rest, schema + ", cell bigint"), packed, blocks, rows, dim, k, exclude_self, ward)
    return _best(close.unionByName(more), k).drop("tie")


def _chunks(b: pd.DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    for s in range(0, len(b), rows):
        yield b.iloc[s : s + rows]


def _repeat(part: pd.DataFrame, cells: list[np.ndarray]) -> pd.DataFrame:
    times = np.array([len(c) for c in cells])
    at = np.repeat(np.arange(len(part)), times)
    out = part[["id", "v", "w"]].iloc[at].reset_index(drop=True)
    out["cell"] = np.concatenate(cells).astype(np.int64) if len(at) else np.zeros(0, dtype=np.int64)
    return out


def _parts(spark, keys: int) -> int:
    """Partitions of the block join: fixed, because small bytes here mean much arithmetic."""
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, min(keys, wide))


def _train_blocks(placed: DataFrame, sizes: dict, rows: int) -> tuple[DataFrame, dict]:
    """Train vectors packed into bounded rows ``(cell, blk, ti, tv, tw)``, spread by hash inside a cell."""
    spark = placed.sparkSession
    blocks = {c: max(1, -(-m // rows)) for c, m in sizes.items()}
    if len(blocks) == 1:
        placed = placed.withColumn("blocks", F.lit(next(iter(blocks.values()))))
    else:
        table = pd.DataFrame({"cell": list(blocks), "blocks": list(blocks.values())})  # at most MAX_CELLS rows
        placed = placed.join(F.broadcast(spark.createDataFrame(table)), "cell")
    spread = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int").alias("blk")
    items = placed.select("cell", spread, "id", "v", "w").repartition(_parts(spark, sum(blocks.values())), "cell", "blk")
    packed = items.groupBy("cell", "blk").agg(F.collect_list(F.struct("id", "v", "w")).alias("t"))
    return packed.select(
        "cell", "blk", F.col("t.id").alias("ti"), F.flatten("t.v").alias("tv"), F.col("t.w").alias("tw")
    ), blocks


def _query_blocks(wanted: DataFrame, blocks: dict, rows: int) -> DataFrame:
    """Query vectors of one Arrow batch packed per cell, one copy for every block of that cell.

    Any grouping of queries is as good as another, so packing needs no shuffle.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cell, part in b.groupby("cell", sort=False):
                for chunk in _chunks(part, rows):
                    n = blocks[int(cell)]
                    ids, w = chunk["id"].to_numpy(), chunk["w"].to_numpy(dtype=np.float64)
                    flat = np.concatenate(chunk["v"].to_numpy())
                    yield pd.DataFrame({"cell": cell, "blk": np.arange(n), "qi": [ids] * n, "qv": [flat] * n, "qw": [w] * n})

    return wanted.mapInPandas(
        pack, "cell bigint, blk int, qi array<bigint>, qv array<double>, qw array<double>"
    ).repartition(_parts(wanted.sparkSession, sum(blocks.values())), "cell", "blk")


def _pairs(wanted: DataFrame, packed: DataFrame, blocks: dict, rows: int, dim: int, k: int, exclude_self: bool, ward: bool):
    """Distances of (query block, train block) pairs of the same cell; k best per query and block."""
    pairs = _query_blocks(wanted, blocks, rows).join(packed, ["cell", "blk"]).select("qi", "qv", "qw", "ti", "tv", "tw")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield _block_best(r, dim, k, exclude_self, ward)

    return pairs.mapInPandas(kernel, "qid bigint, tid bigint, d2 double, tie bigint")


def _block_best(r, dim: int, k: int, exclude_self: bool, ward: bool) -> pd.DataFrame:
    qi, ti = np.asarray(r.qi, dtype=np.int64), np.asarray(r.ti, dtype=np.int64)
    x, z = np.asarray(r.qv).reshape(-1, dim), np.asarray(r.tv).reshape(-1, dim)
    d2 = np.zeros((len(x), len(z)))
    for d in range(dim):
        d2 += (x[:, d][:, None] - z[:, d][None, :]) ** 2
    if ward:
        a, b = np.asarray(r.qw)[:, None], np.asarray(r.tw)[None, :]
        d2 *= 2 * a * b / (a + b)
    d2 = np.round(d2, DIGITS)
    if exclude_self:
        d2[qi[:, None] == ti[None, :]] = np.inf
    order = np.argsort(ti, kind="stable")
    ti, d2 = ti[order], d2[:, order]
    if ward:
        # Keep every minimum: the pair hash decides between them later.
        low = d2.min(axis=1)
        a, b = np.nonzero((d2 == low[:, None]) & np.isfinite(low)[:, None])
        tie = pair_hash(qi[a], ti[b])
        first = np.lexsort((tie, a))
        _, at = np.unique(a[first], return_index=True)
        a, b, tie = a[first][at], b[first][at], tie[first][at]
        return pd.DataFrame({"qid": qi[a], "tid": ti[b], "d2": d2[a, b], "tie": tie})
    take = min(k, d2.shape[1])
    last = np.partition(d2, take - 1, axis=1)[:, take - 1]
    rows, cols = np.nonzero((d2 <= last[:, None]) & np.isfinite(d2))
    near = _first(rows, cols, d2[rows, cols], take)
    rows, cols = rows[near], cols[near]
    return pd.DataFrame({"qid": qi[rows], "tid": ti[cols], "d2": d2[rows, cols], "tie": ti[cols]})


def _first(rows: np.ndarray, cols: np.ndarray, d2: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` entries of each row with the smallest distance, then the smallest column."""
    order = np.lexsort((cols, d2, rows))
    ranked = rows[order]
    return order[np.arange(len(ranked)) - np.searchsorted(ranked, ranked) < k]


def _grid(queries: DataFrame, train: DataFrame, n: int, dim: int, k: int, exclude_self: bool) -> DataFrame:
    """The k best of every (query, train group): all pairs, in tasks of one query group and one train group.

    With g groups a side a vector travels g times. Groups are bounded in bytes; matrix products find the candidates, whose
    distances are then summed as everywhere else.
    """
    spark = train.sparkSession
    most = max(64, GROUP_BYTES // (8 * dim))

    def groups(rows: int) -> int:
        wide = int(np.ceil(np.sqrt(2 * _parts(spark, 1 << 30))))
        return max(1, -(-rows // most), min(wide, rows // 256))

    down, across = groups(queries.count()), groups(n)

    def spread(df: DataFrame, mine: str, own: int, other: str, copies: int) -> DataFrame:
        group = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(own)).cast("int").alias(mine)
        return df.select("id", "v", group, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other))

    def compare(key: tuple, q: pa.Table, t: pa.Table) -> pa.Table:
        qi, ti = q["id"].to_numpy(), t["id"].to_numpy()
        if not len(qi) or not len(ti):
            return _found(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.argsort(ti, kind="stable")
        ti, z = ti[order], _vectors(t["v"], dim)[order]
        x_all, norm = _vectors(q["v"], dim), (z * z).sum(axis=1)
        take, parts = min(k, len(ti)), []
        for s in range(0, len(qi), 256):
            x, ids = x_all[s : s + 256], qi[s : s + 256]
            own = (x * x).sum(axis=1)[:, None]
            about = own + norm[None, :] - 2.0 * (x @ z.T)
            if exclude_self:
                at = np.minimum(np.searchsorted(ti, ids), len(ti) - 1)
                hit = np.flatnonzero(ti[at] == ids)
                about[hit, at[hit]] = np.inf
            about[np.isnan(about)] = -np.inf  # decided below
            # beyond the rounding of the product and of the distance nothing else can be among the first
            slack = 10.0 ** -DIGITS + 1e-12 * (own + norm.max())
            last = np.partition(about, take - 1, axis=1)[:, take - 1 : take] + 2.0 * slack
            rows, cols = np.nonzero((about <= last) & (about < np.inf))
            d2 = np.zeros(len(rows))
            for d in range(dim):
                d2 += (x[rows, d] - z[cols, d]) ** 2
            d2 = np.round(d2, DIGITS)
            ok = np.isfinite(d2)
            rows, cols, d2 = rows[ok], cols[ok], d2[ok]
            near = _first(rows, cols, d2, k)
            parts.append(_found(ids[rows[near]], ti[cols[near]], d2[near]))
        return pa.concat_tables(parts)

    left = spread(queries, "qg", down, "tg", across).groupBy("qg", "tg")
    right = spread(train, "tg", across, "qg", down).select("id", "v", "qg", "tg").groupBy("qg", "tg")
    return left.cogroup(right).applyInArrow(compare, "qid bigint, tid bigint, d2 double, tie bigint")


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(-1, dim)


def _found(qid: np.ndarray, tid: np.ndarray, d2: np.ndarray) -> pa.Table:
    names = ("qid", "tid", "d2", "tie")
    return pa.table(dict(zip(names, (pa.array(qid), pa.array(tid), pa.array(d2), pa.array(tid)))))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-free 64-bit mix of two ids, used to break distance ties evenly."""
    lo, hi = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = lo * np.uint64(0x9E3779B97F4A7C15) + hi
        for _ in range(2):
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(1)).astype(np.int64)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k candidates of each query with the smallest (distance, tie) order."""
    if k == 1:
        first = F.min(F.struct("d2", "tie", "tid")).alias("m")
        return found.groupBy("qid").agg(first).select("qid", "m.tid", "m.d2", "m.tie")
    rank = "row_number() OVER (PARTITION BY qid ORDER BY d2, tie) AS rn"
    return found.selectExpr("*", rank).where(f"rn <= {int(k)}").drop("rn")
