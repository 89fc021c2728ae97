"""Decision trees, forests and boosting on packed rows.

Packing is exact for trees: rows with equal features share every leaf, and their weight and mean (or class weights) are all a
split looks at. Forests give each packed row a Poisson number of copies, so no single runs are needed either.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from chromaspark.functions.columns import zero_filled
from chromaspark.models import grower
from chromaspark.models.base import Model, TrainingTable, packed_score
from chromaspark.models.grower import DEEP, Block, Booster, Rows, Spec, Tree

NAMES = {"regression": ("RF", "GB", "DT"), "classification": ("RFC", "GBC", "DT")}
FORESTS, BOOSTED = ("RF", "RFC"), ("GB", "GBC")
SEED = 42
CHUNK = 5  # trees of one task in a search


@dataclass
class TreesModel(Model):
    """Trees with real cut values. ``members`` are ``(tree, values, column)``: node values are averaged over the trees of a
    forest (``start`` empty), added to ``start`` column by column in a booster."""

    members: list[tuple[Tree, np.ndarray, int]] = field(default_factory=list)
    start: list[float] = field(default_factory=list)
    shares: list[float] = field(default_factory=list)
    kind = "trees"

    def values(self, x: np.ndarray) -> np.ndarray:
        """Prediction or class probabilities of the columns of ``x`` (features x rows)."""
        classify = self.task == "classification"
        if self.start:
            raw = np.tile(np.array(self.start), (x.shape[1], 1))
            for tree, value, column in self.members:
                raw[:, column] += value[tree.down(x), 0]
            return grower.softmax(raw) if classify else raw
        return sum(value[tree.down(x)] for tree, value, _ in self.members) / max(1, len(self.members))

    def predict(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("array<double>")
        def scored(*columns: pa.Array) -> pa.Array:
            x = np.array([c.to_numpy(zero_copy_only=False) for c in columns], dtype=np.float64)
            return pa.array(list(shared.value.values(x)), pa.list_(pa.float64()))

        out = df.withColumn("_p", scored(*[zero_filled(f) for f in self.features]))
        if self.task == "regression":
            return out.withColumn("prediction", F.col("_p")[0]).drop("_p")
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("int")
        return out.withColumn("probability", F.col("_p")).withColumn("prediction", best).drop("_p")

    def importances(self) -> list[float]:
        return self.shares

    def state(self) -> dict:
        return {"start": list(map(float, self.start)), "importances": self.shares}

    def save(self, spark: SparkSession, path: str) -> None:
        super().save(spark, path)
        rows = [
            (i, column, n, int(t.feature[n]), float(t.cut[n]), int(t.left[n]), [float(v) for v in value[n]])
            for i, (t, value, column) in enumerate(self.members) for n in range(len(t.left))
        ]
        table = spark.createDataFrame(rows, "tree int, of int, node int, feature int, cut double, left int, value array<double>")
        table.write.mode("overwrite").parquet(f"{path}/nodes")


def read_trees(spark: SparkSession, path: str, state: dict) -> tuple[list]:
    """Members of a saved model; one row a tree reaches the driver."""
    node = F.sort_array(F.collect_list(F.struct("node", "feature", "cut", "left", "value"))).alias("n")
    members = []
    for r in spark.read.parquet(f"{path}/nodes").groupBy("tree", "of").agg(node).orderBy("tree").toLocalIterator():
        feature, cut, left, value = (np.array([x[c] for x in r["n"]]) for c in ("feature", "cut", "left", "value"))
        zeros = np.zeros(len(left))
        members.append((Tree(feature, cut, left, value, zeros, zeros.astype(np.uint64)), value, r["of"]))
    return (members,)


def _depth(params: dict) -> int:
    depth = params.get("max_depth")
    return DEEP if depth is None else int(depth)


def _count(name: str, params: dict) -> int:
    return 1 if name == "DT" else int(params.get("n_estimators", 100))


def rows_of(table: TrainingTable) -> Rows:
    if table.binned is None:
        table.binned = Rows(table.packed, table.features, table.n_labels)
    return table.binned


def _spec(name: str, table: TrainingTable, fold: int, depth: int, number: int) -> Spec:
    """Tree ``number`` of a forest, or the one decision tree."""
    classify = table.task == "classification"
    some = max(1, int(np.sqrt(len(table.features)))) if name == "RFC" else 0
    return Spec("class" if classify else "mean", fold, depth, SEED * 1_000_003 + number, name in FORESTS, some, n_labels=table.n_labels)


def _means(tree: Tree, columns: int) -> np.ndarray:
    return tree.sums[:, 1: 1 + columns] / np.maximum(tree.sums[:, :1], 1e-300)


def _real(tree: Tree, cuts: list[np.ndarray]) -> Tree:
    return Tree(tree.feature, grower.real_cuts(tree, cuts), tree.left, tree.sums[:, :0], tree.gain, tree.path[:0])


def _forest(name: str, table: TrainingTable, params: dict, trees: list[Tree]) -> TreesModel:
    columns = table.n_labels if table.task == "classification" else 1
    cuts = rows_of(table).cuts
    members = [(_real(t, cuts), _means(t, columns), 0) for t in trees]
    return TreesModel(name, table.task, list(table.features), dict(params), table.n_labels, members, [], grower.importances(trees, len(cuts)))


def _boosted(name: str, table: TrainingTable, params: dict, booster: Booster) -> TreesModel:
    cuts, rounds = rows_of(table).cuts, booster.rounds[: _count(name, params)]
    members = [(_real(t, cuts), booster.rate * v[:, None], k) for trees in rounds for k, (t, v) in enumerate(trees)]
    shares = grower.importances([t for trees in rounds for t, _ in trees], len(cuts))
    return TreesModel(name, table.task, list(table.features), dict(params), table.n_labels, members, booster.start.tolist(), shares)


def fit_trees(name: str, table: TrainingTable, params: dict) -> TreesModel:
    """RF, GB or DT (regression); RFC, GBC or DT (classification) on all rows of a training table."""
    rows, depth, n = rows_of(table), _depth(params), _count(name, params)
    if name in BOOSTED:
        booster = rows.boost([(-1, depth, float(params.get("learning_rate", 0.1)))], n, name == "GBC")[0]
        return _boosted(name, table, params, booster)
    return _forest(name, table, params, rows.grow([_spec(name, table, -1, depth, i) for i in range(n)]))


def fold_fits(name: str, table: TrainingTable, params: dict) -> list[TreesModel]:
    """The model of each fold left out, all grown together."""
    rows, depth, n = rows_of(table), _depth(params), _count(name, params)
    if name in BOOSTED:
        rate = float(params.get("learning_rate", 0.1))
        return [_boosted(name, table, params, b) for b in rows.boost([(f, depth, rate) for f in range(table.folds)], n, name == "GBC")]
    trees = rows.grow([_spec(name, table, f, depth, i) for f in range(table.folds) for i in range(n)])
    return [_forest(name, table, params, trees[f * n: (f + 1) * n]) for f in range(table.folds)]


def _shorter(tree: Tree, depth: int) -> Tree:
    """The top of a tree: the same nodes, those at ``depth`` made leaves."""
    level = np.zeros(len(tree.left), np.int32)
    for node in np.flatnonzero(tree.left >= 0):
        level[tree.left[node]: tree.left[node] + 2] = level[node] + 1
    return Tree(tree.feature, tree.cut, np.where(level < depth, tree.left, -1), tree.sums, np.where(level < depth, tree.gain, 0.0), tree.path)


def cv_scores(name: str, table: TrainingTable, grid: list[dict]) -> list[tuple[int, int, float]]:
    """``(grid_id, fold, score)``: each fold's trees are grown once for the largest point and read off at every other."""
    rows, folds, classify = rows_of(table), range(table.folds), table.task == "classification"
    counts, depths = [_count(name, p) for p in grid], [_depth(p) for p in grid]
    if name in BOOSTED:
        kinds = sorted({(d, float(p.get("learning_rate", 0.1))) for d, p in zip(depths, grid)})
        jobs = [(f, d, rate) for f in folds for d, rate in kinds]
        boosters = dict(zip(jobs, rows.boost(jobs, max(counts), classify)))
        out = []
        for i, p in enumerate(grid):
            for f in folds:
                b = boosters[(f, depths[i], float(p.get("learning_rate", 0.1)))]
                score = b.scores[counts[i] - 1] if b.scores else _far_score(_boosted(name, table, p, b), table, f)
                out.append((i, f, score))
        return out
    deepest, chosen = max(depths), sorted(set(depths))
    if rows.shared is None:
        out = []
        for f in folds:
            trees = rows.grow([_spec(name, table, f, deepest, i) for i in range(max(counts))])
            for i, p in enumerate(grid):
                cut = [_shorter(t, depths[i]) for t in trees[: counts[i]]]
                out.append((i, f, _far_score(_forest(name, table, p, cut), table, f)))
        return sorted(out, key=lambda s: s[:2])
    columns, sizes, ends = (table.n_labels if classify else 1), rows.sizes, sorted({*counts, *range(CHUNK, max(counts), CHUNK)})
    starts = [0, *ends[:-1]]
    jobs = [(f, [_spec(name, table, f, deepest, i) for i in range(a, b)]) for f in folds for a, b in zip(starts, ends)]

    def chunk(blocks: list[Block], job: tuple[int, list[Spec]]) -> list[np.ndarray]:
        """Sums of the trees' predictions on the left-out fold, one array for each depth."""
        sums: list = [0.0] * len(chosen)
        for spec in job[1]:
            tree = grower.grow_here(blocks, sizes, spec)
            value = _means(tree, columns)
            for i, d in enumerate(chosen):
                sums[i] = sums[i] + np.concatenate([value[tree.down(b.vectors, d)] for b in blocks])
        whose = np.concatenate([b.which[b.fold == job[0]] for b in blocks])  # of the one block
        return [total[whose] for total in sums]

    got = dict(zip(((f, b) for f in folds for b in ends), rows.each(jobs, chunk)))
    blocks, out = rows.shared.value, []
    for i, (n, d) in enumerate(zip(counts, depths)):
        for f in folds:
            total = sum(got[(f, b)][chosen.index(d)] for b in ends if b <= n) / n
            whole = [np.zeros((len(b.w), columns)) for b in blocks]
            at = 0
            for b, p in zip(blocks, whole):
                mine = b.fold == f
                p[mine] = total[at: at + mine.sum()]
                at += mine.sum()
            out.append((i, f, grower.left_out_score(blocks, whole, f, classify)))
    return out


def _far_score(model: TreesModel, table: TrainingTable, fold: int) -> float:
    return packed_score(model.predict(table.packed.where(F.col("fold") == fold)), table.task)
