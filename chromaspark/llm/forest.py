"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking.

Each tree halves the space again and again by hyperplanes between two groups of its own sample. Every
row is put into one leaf of each tree. A query walks all trees through a single queue of nodes, ordered
by how far on the right side of their planes it lies, and collects leaves until it has met enough rows;
these are scored exactly. Largest inner product is searched as smallest angle: one more coordinate
brings all rows to the same length. How many rows are enough is measured, not guessed: the true
neighbours of some queries are computed, and the queue runs as far as it must to meet the wished recall.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from chromaspark.llm.common import keep

TREES = 10
LEAF_ROWS = 256
FIT_ROWS = 32_768  # sampled rows for the planes of one tree
LEAST_FIT_LEAF = 16  # sampled rows a leaf must have
CALIBRATION = 64  # queries whose true neighbours are computed
RECALL = 0.94
BLOCK = 1024
SLACK = 1e-9
HELD_ROWS = 1 << 20  # scored rows (24 bytes each) that a task holds before it sorts out the best of each query
GROUP_BYTES = 16 << 20  # of the vectors of one group of queries or rows


@dataclass
class Forest:
    """Planes of perfect binary trees: ``normals[tree, node]`` and ``offsets[tree, node]``, nodes in heap order."""

    normals: np.ndarray
    offsets: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.normals)), dtype=np.int64)
        for t, (normal, offset) in enumerate(zip(self.normals, self.offsets)):
            for _ in range(self.depth):
                node = out[:, t]
                side = np.einsum("ij,ij->i", x, normal[node]) > offset[node]
                out[:, t] = 2 * node + 1 + side
        return out - (2**self.depth - 1)

    def visits(self, q: np.ndarray, sizes: np.ndarray, enough: float) -> list[list[tuple[int, int]]]:
        """(tree, leaf) pairs of each query in the order of the queue, until their rows are ``enough``."""
        trees, inner = len(self.normals), 2**self.depth - 1
        margins = np.einsum("tnd,qd->qtn", self.normals, q, optimize=True) - self.offsets[None]
        out = []
        for m in margins.tolist():
            queue, found, met = [(-np.inf, t, 0) for t in range(trees)], [], 0
            while queue and met < enough:
                far, t, node = heapq.heappop(queue)
                if node >= inner:
                    if sizes[t, node - inner]:
                        found.append((t, node - inner))
                        met += sizes[t, node - inner]
                    continue
                d = m[t][node]
                heapq.heappush(queue, (max(far, -d), t, 2 * node + 2))
                heapq.heappush(queue, (max(far, d), t, 2 * node + 1))
            out.append(found)
        return out


def _grow(x: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng, size = np.random.default_rng(seed), 2**depth - 1
    normals, offsets = np.zeros((size, x.shape[1])), np.zeros(size)
    members = {0: np.arange(len(x))}
    for node in range(size):
        rows = members.pop(node)
        w = rng.normal(size=x.shape[1])
        if len(rows) > 1:
            a, b = x[rng.choice(rows, 2, replace=False)]
            for _ in range(4):  # two means, roughly
                near = x[rows] @ (a - b) > (a @ a - b @ b) / 2
                if near.all() or not near.any():
                    break
                a, b = x[rows[near]].mean(axis=0), x[rows[~near]].mean(axis=0)
            w = a - b if np.any(a != b) else w
        w /= np.linalg.norm(w)
        p = x[rows] @ w
        normals[node], offsets[node] = w, np.median(p) if len(rows) else 0.0
        right = p > offsets[node]
        members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
    return normals, offsets


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lifted(x: np.ndarray, longest2: float) -> np.ndarray:
    """One more coordinate that gives every row the length of the longest."""
    return np.concatenate((x, np.sqrt(np.maximum(0.0, longest2 - (x * x).sum(axis=1)))[:, None]), axis=1)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices in double precision, added up in order, so that equal rows tie."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


def best_rows(rep: np.ndarray, hit: np.ndarray, score: np.ndarray, most: int) -> tuple[tuple[np.ndarray, ...], list[tuple[int, float]]]:
    """The distinct ``(rep, hit, score)`` of each ``rep`` that score no less than its ``most``-th, and that score of each that has so many."""
    order = np.lexsort((hit, -score, rep))
    rep, hit, score = rep[order], hit[order], score[order]
    new = np.ones(len(rep), dtype=bool)
    new[1:] = (rep[1:] != rep[:-1]) | (hit[1:] != hit[:-1]) | (score[1:] != score[:-1])
    rep, hit, score = rep[new], hit[new], score[new]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(rep)), dtype=bool), rep[1:] != rep[:-1])))
    size = np.diff(np.append(first, len(rep)))
    full = size >= most
    bar = np.full(len(first), -np.inf)
    bar[full] = score[first[full] + most - 1]
    stay = score >= np.repeat(bar, size)
    return (rep[stay], hit[stay], score[stay]), list(zip(rep[first[full]].tolist(), bar[full].tolist()))


class _Best:
    """The best rows of a group of queries so far; queries and rows are named by their places. Scores are exact at the end only."""

    def __init__(self, q: np.ndarray, x: np.ndarray, most: int):
        self.q, self.x, self.most = q, x, most
        self.bar = np.full(len(q), -np.inf)  # what a query's k-th best so far reached, less rounding: nothing below it is among the best
        self.held: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.n_held, self.limit = 0, HELD_ROWS

    def meet(self, qs: np.ndarray, xs: np.ndarray) -> None:
        """Score all rows ``xs`` for the queries ``qs``."""
        s = self.q[qs] @ self.x[xs].T
        if s.shape[1] > self.most:
            low = np.partition(s, -self.most, axis=1)[:, -self.most]
            self.bar[qs] = np.maximum(self.bar[qs], low - SLACK * np.maximum(1.0, np.abs(low)))
        i, j = np.nonzero(s >= self.bar[qs][:, None])
        self.held.append((qs[i], xs[j], s[i, j]))
        self.n_held += len(i)
        if self.n_held >= self.limit:
            self._sort_out()

    def _sort_out(self) -> None:
        q, x, s = map(np.concatenate, zip(*self.held))
        once = np.unique(q * len(self.x) + x, return_index=True)[1]  # a row may have been met in several trees
        q, x, s = q[once], x[once], s[once]
        order = np.lexsort((-s, q))
        q, x, s = q[order], x[order], s[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        full = first[np.diff(np.append(first, len(q))) >= self.most]
        low = s[full + self.most - 1]
        self.bar[q[full]] = np.maximum(self.bar[q[full]], low - SLACK * np.maximum(1.0, np.abs(low)))
        stay = s >= self.bar[q]
        self.held, self.n_held = [(q[stay], x[stay], s[stay])], int(stay.sum())
        self.limit = max(HELD_ROWS, 2 * self.n_held)

    def rows(self) -> tuple[np.ndarray, ...]:
        self._sort_out()
        q, x, _ = self.held[0]
        score = np.concatenate([np.zeros(0), *(inner(self.q[q[i: i + 65536]], self.x[x[i: i + 65536]]) for i in range(0, len(q), 65536))])
        return best_rows(q, x, score, self.most)[0]


def _group(key: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(13)), F.lit(groups)).cast("int")


def _copies(groups: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))


def _groups(spark: SparkSession, rows: int, row_bytes: int, queries: int, query_bytes: int) -> tuple[int, int]:
    """Numbers of groups of rows and of queries: bounded in bytes, and two cells of the grid for each partition where there are rows enough."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    row_groups = max(1, -(-rows * row_bytes // GROUP_BYTES), min(math.isqrt(2 * parts), rows // BLOCK))
    query_groups = max(1, -(-queries * query_bytes // GROUP_BYTES), min(-(-2 * parts // row_groups), queries // 64))
    return row_groups, query_groups


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, v)`` of the distinct rows that take part: no null, zero or non-finite vectors; the commonest length counts."""
    v = F.col(vector)
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
        & F.exists(v, lambda e: e != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0)).distinct()


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", trees: int = TREES,
    recall: float = RECALL, fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows found with the largest inner product, best first.

    ``is_query`` is a condition on column ``id``; every row but those with the query's own id is a
    candidate. Ties go to the smaller id. Vectors that are null, zero, of another length than most, or
    hold nulls or non-finite components take no part; neither do null ids. Repeated rows count once; an id with several
    vectors counts with the best. Equal vectors are indexed once and keep their ``k + 1`` smallest ids,
    more of which no answer can hold. Too few rows give shorter answers, none an empty table.

    Planes are fitted on at most ``fit_rows`` sampled rows for each tree; every row is indexed.
    """
    spark = vectors.sparkSession
    own = Window.partitionBy("v").orderBy("id")
    rows = usable(vectors, key, vector)
    ranked = rows.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k + 1)
    members = keep(ranked.withColumn("rep", F.min("id").over(Window.partitionBy("v"))), "vectors")
    index = members.where("place = 1").select("id", "v")
    head = index.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"),
        F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e)).alias("longest"),
    ).first()
    n, dim, longest = head["n"], head["d"] or 1, head["longest"] or 0.0
    asked = rows.where(is_query).select(F.col("id").alias("qid"), "v")
    # no side of a join here is broadcast: all grow with the table, and what a plan estimates of vectors or of Python's output is far too low
    query = keep(asked.hint("merge").join(index.withColumnRenamed("id", "rep"), "v").select("qid", "rep", "v"), "queries")
    n_query = query.count()
    kind = members.schema["v"].dataType.simpleString()
    depth = int(max(0, min(np.ceil(np.log2(max(1, n / leaf_rows))), np.floor(np.log2(max(1, min(n, fit_rows) / LEAST_FIT_LEAF))))))

    sample = index.select(F.explode(F.array(*map(F.lit, range(trees)))).alias("tree"), "id", "v").where(
        F.pmod(F.xxhash64("id", "tree"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_rows / max(1, n)))
    ).select("tree", "v")

    def grow(group: pa.Table) -> pa.Table:
        tree = group.column("tree")[0].as_py()
        x = _lifted(_matrix(group.column("v").combine_chunks(), dim), longest)
        normals, offsets = _grow(x, depth, tree)
        return pa.table({"tree": pa.array([tree], pa.int32()), "n": pa.array([normals.tobytes()], pa.binary()), "o": pa.array([offsets.tobytes()], pa.binary())})

    # at most trees x fit_rows / 16 planes, 10 MB for 64 dimensions and ten trees
    planes = sorted(sample.groupBy("tree").applyInArrow(grow, "tree int, n binary, o binary").collect(), key=lambda r: r["tree"])
    forest = Forest(
        np.array([np.frombuffer(r["n"]).reshape(-1, dim + 1) for r in planes]).reshape(len(planes), 2**depth - 1, dim + 1),
        np.array([np.frombuffer(r["o"]) for r in planes]).reshape(len(planes), 2**depth - 1), depth,
    )
    shared = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shared.value.leaves(_lifted(_matrix(b.column(1), dim), longest))
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * got.shape[1])
            leaves = pa.ListArray.from_arrays(ends, pa.array(got.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), leaves], ["id", "v", "leaves"])

    placed = keep(index.mapInArrow(place, f"id bigint, v {kind}, leaves array<int>"), "leaves")
    sizes = np.zeros((max(1, len(planes)), 2**depth), dtype=np.int64)
    for r in placed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().toLocalIterator():  # a row for each leaf
        sizes[r["tree"], r["leaf"]] = r["count"]
    enough = _enough(query, index, forest, sizes, dim, k, recall, n)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 32):
                b = whole.slice(at, 32)
                q = _matrix(b.column(1), dim)
                seen = np.zeros((len(q), *sizes.shape), dtype=bool)
                for i, found in enumerate(shared.value.visits(np.concatenate((q, np.zeros((len(q), 1))), axis=1), sizes, enough)):
                    for leaf in found:
                        seen[i][leaf] = True
                bits = np.packbits(seen, axis=2).reshape(len(q), -1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in bits], pa.binary())], ["rep", "v", "seen"])

    # A grid of (query group, row group): a vector travels once for each group of the other side, not once for each leaf met.
    row_groups, query_groups = _groups(spark, n, 8 * dim, n_query, 8 * dim + sizes.size // 8)
    # walking a query costs far more than its bytes tell, so the number of tasks does not follow them
    distinct = query.select(F.col("rep"), "v").distinct().repartition(max(spark.sparkContext.defaultParallelism, n_query // BLOCK))
    walked = distinct.mapInArrow(walk, f"rep bigint, v {kind}, seen binary")
    asking = walked.select("rep", "v", "seen", _group("rep", query_groups).alias("qg"), _copies(row_groups).alias("rg"))
    asked_of = placed.select("id", "v", "leaves", _copies(query_groups).alias("qg"), _group("id", row_groups).alias("rg"))
    most = k + 1

    def meet(q: pa.Table, rows: pa.Table) -> pa.Table:
        """The best of each query of a group among the rows of a group that lie in its leaves."""
        if q.num_rows and rows.num_rows:
            reps, vs, seen = (q.column(c).combine_chunks() for c in ("rep", "v", "seen"))
            ids, xs, leaves = (rows.column(c).combine_chunks() for c in ("id", "v", "leaves"))
            vs, xs, reps, ids = _matrix(vs, dim), _matrix(xs, dim), reps.to_numpy(), ids.to_numpy()
            leaves, best = leaves.flatten().to_numpy().reshape(len(ids), -1), _Best(vs, xs, most)
            begin, end = (seen.buffers()[1].to_pybytes()[4 * i: 4 * i + 4] for i in (seen.offset, seen.offset + len(seen)))
            bits = np.frombuffer(seen.buffers()[2], dtype=np.uint8)[int.from_bytes(begin, "little"): int.from_bytes(end, "little")].reshape(len(reps), len(sizes), -1)
            for t in range(leaves.shape[1]):
                met = np.unpackbits(bits[:, t], axis=1).T
                order = np.argsort(leaves[:, t], kind="stable")
                first = np.flatnonzero(np.diff(leaves[order, t], prepend=-1))
                for members in np.split(order, first[1:]):
                    who = np.flatnonzero(met[leaves[members[0], t]])
                    for i in range(0, len(who), BLOCK):
                        for j in range(0, len(members), BLOCK):
                            best.meet(who[i: i + BLOCK], members[j: j + BLOCK])
            i, j, score = best.rows()
            return pa.table({"rep": pa.array(reps[i]), "hit": pa.array(ids[j]), "score": pa.array(score)})
        return pa.table({"rep": pa.array([], pa.int64()), "hit": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the groups that meet in one task, the best of each query."""
        held, n_held = [], 0

        def out(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["rep", "hit", "score"])

        for b in batches:
            held.append(tuple(b.column(i).to_numpy() for i in range(3)))
            n_held += b.num_rows
            if n_held >= HELD_ROWS:
                rows, _ = best_rows(*map(np.concatenate, zip(*held)), most)
                held, n_held = [rows], len(rows[0])
                if n_held > HELD_ROWS // 2:  # too many queries meet in this task
                    yield out(rows)
                    held, n_held = [], 0
        if held:
            yield out(best_rows(*map(np.concatenate, zip(*held)), most)[0])

    cells = asking.groupBy("qg", "rg").cogroup(asked_of.groupBy("qg", "rg"))
    found = cells.applyInArrow(meet, "rep bigint, hit bigint, score double").mapInArrow(merge, "rep bigint, hit bigint, score double")
    best = found.withColumn("r", F.rank().over(Window.partitionBy("rep").orderBy(F.desc("score")))).where(F.col("r") <= most).drop("r")
    with_ids = best.hint("merge").join(members.select(F.col("rep").alias("hit"), F.col("id").alias("vec_id")), "hit")
    answers = query.select("qid", "rep").hint("merge").join(with_ids, "rep").where("qid <> vec_id")
    one = answers.groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    top = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select(F.col("qid").alias("query_id"), "rank", "vec_id", "score")


def true_neighbours(query: DataFrame, index: DataFrame, dim: int, k: int) -> dict[int, tuple[np.ndarray, list]]:
    """Vector and exact best ``k`` rows (score, vector) of a few queries ``(rep, v)``, by one pass over the index."""
    chosen = query.select("rep", "v").distinct().orderBy(F.xxhash64("rep")).limit(CALIBRATION).collect()
    if not chosen:
        return {}
    q = np.array([r["v"] for r in chosen], dtype=np.float64)
    ids = np.array([r["rep"] for r in chosen])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros((0, dim)))] * len(q)
        for b in batches:
            x, own = _matrix(b.column(1), dim), b.column(0).to_numpy()
            s = q @ x.T
            s[ids[:, None] == own[None, :]] = -np.inf
            for i in range(len(q)):
                top = np.argsort(-s[i])[:k]
                both, rows = np.concatenate((held[i][0], s[i][top])), np.concatenate((held[i][1], x[top]))
                top = np.argsort(-both)[:k]
                held[i] = both[top], rows[top]
        for i, (s, rows) in enumerate(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(s), ids[i])), pa.array(s), pa.array(list(rows), pa.list_(pa.float64()))], ["rep", "s", "x"]
            )

    rows = index.mapInArrow(scan, "rep bigint, s double, x array<double>")
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("s")))).where(f"r <= {k} AND s > double('-Infinity')")
    out: dict[int, tuple[np.ndarray, list]] = {r["rep"]: (np.array(r["v"], dtype=np.float64), []) for r in chosen}
    for r in top.collect():  # at most CALIBRATION x k rows
        out[r["rep"]][1].append(np.array(r["x"]))
    return out


def _enough(query: DataFrame, index: DataFrame, forest: Forest, sizes: np.ndarray, dim: int, k: int, recall: float, n: int) -> float:
    """Rows (with repeats over trees) the queue must meet for the wished mean recall on the calibration queries."""
    needed = []
    longest = float("nan")
    for vector, near in true_neighbours(query, index, dim, k).values():
        if not near:
            continue
        if np.isnan(longest):
            longest = index.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e))).first()[0]
        order = forest.visits(np.append(vector, 0.0)[None], sizes, np.inf)[0]
        before = np.cumsum([sizes[t, leaf] for t, leaf in order]).tolist()
        met = {leaf: before[i - 1] + 1 if i else 1 for i, leaf in enumerate(order)}
        for leaves in forest.leaves(_lifted(np.array(near), longest)):
            needed.append(min(met[(t, int(leaf))] for t, leaf in enumerate(leaves)))
    if not needed:
        return float(n)
    return float(np.quantile(needed, recall, method="higher"))
