"""Means, spreads, Gram matrices and correlation: one aggregation each, d x d results."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from chromaspark.functions.columns import double, features_as, number, zero
from chromaspark.schema import quoted


@dataclass
class Scaler:
    """Column means and population standard deviations."""

    features: list[str]
    mean: list[float]
    std: list[float]

    def texts(self) -> list[str]:
        """SQL texts of the standardised features in order; a constant column becomes 0."""
        return [
            f"(({zero(f)} - {double(m)}) / {double(s)})" if s > 0 else "0D"
            for f, m, s in zip(self.features, self.mean, self.std)
        ]

    def array(self) -> Column:
        return F.expr(f"array({', '.join(self.texts())})")

    def apply(self, df: DataFrame) -> DataFrame:
        scaled = dict(zip(self.features, self.texts()))
        return df.selectExpr(*[f"{scaled.get(c, quoted(c))} AS {quoted(c)}" for c in df.columns])


def fit_scaler(df: DataFrame, features: list[str], weight: str | None = None) -> Scaler:
    """Mean and population deviation of the zero-filled features in one pass.

    With ``weight`` each row stands for that many rows.
    """
    if weight is None:
        row = df.selectExpr(*features_as(features, [f"x{i}" for i in range(len(features))])).selectExpr(*[
            f"{fn}(x{i}) AS {fn}{i}" for i in range(len(features)) for fn in ("avg", "stddev_pop", "min", "max")
        ]).first()
        mean = [row[f"avg{i}"] or 0.0 for i in range(len(features))]
        # A constant column can show a rounding-size deviation; its range says it is constant.
        std = [
            (row[f"stddev_pop{i}"] or 0.0) if row[f"min{i}"] != row[f"max{i}"] else 0.0 for i in range(len(features))
        ]
        return Scaler(list(features), mean, std)
    g = gram(df, features, weight=weight)
    std = np.sqrt(np.maximum(np.diag(g.xx) / max(g.n, 1e-300), 0.0))
    ends = df.where(F.expr(f"{quoted(weight)} <> 0")).selectExpr(*features_as(features, [f"x{i}" for i in range(len(features))])).selectExpr(
        *[f"min(x{i}) <> max(x{i}) AS moves{i}" for i in range(len(features))]
    ).first()
    return Scaler(list(features), [float(m) for m in g.mean], [float(s) if ends[i] else 0.0 for i, s in enumerate(std)])


def standardize(df: DataFrame, features: list[str]) -> DataFrame:
    return fit_scaler(df, features).apply(df)


@dataclass
class Gram:
    """Centred cross products of features (and target): all that a linear fit needs."""

    features: list[str]
    n: float
    mean: np.ndarray
    xx: np.ndarray
    y_mean: float = 0.0
    xy: np.ndarray | None = None
    yy: float = 0.0

    def merge(self, other: "Gram", sign: float = 1.0) -> "Gram":
        """Add (or with ``sign=-1`` take away) the rows behind another Gram."""
        n = self.n + sign * other.n
        if n <= 0:
            d = len(self.features)
            return Gram(self.features, 0.0, np.zeros(d), np.zeros((d, d)), 0.0, np.zeros(d), 0.0)
        mean = (self.n * self.mean + sign * other.n * other.mean) / n
        y_mean = (self.n * self.y_mean + sign * other.n * other.y_mean) / n

        def about(g: Gram):
            dx, dy = g.mean - mean, g.y_mean - y_mean
            xy = None if g.xy is None else g.xy + g.n * dx * dy
            return g.xx + g.n * np.outer(dx, dx), xy, g.yy + g.n * dy * dy

        a, b = about(self), about(other)
        xy = None if a[1] is None else a[1] + sign * b[1]
        return Gram(self.features, n, mean, a[0] + sign * b[0], y_mean, xy, a[2] + sign * b[2])


def grams(
    df: DataFrame, features: list[str], y: str | None = None, by: str | None = None, weight: str | None = None
) -> dict:
    """Centred Gram per value of ``by`` (one entry ``None`` without it).

    Two passes: global means first, then products around them, so nothing cancels. ``by`` must have
    few values (folds). Only d(d+1)/2 sums per value reach the driver.
    """
    names = [f"x{i}" for i in range(len(features))] + (["y"] if y is not None else [])
    base = df.selectExpr(
        *([f"{quoted(by)} AS g"] if by else []),
        "1D AS w" if weight is None else f"cast({quoted(weight)} AS double) AS w",
        *features_as(features, [f"x{i}" for i in range(len(features))]),
        *([f"{number(y)} AS y"] if y is not None else []),
    )
    if y is not None:
        base = base.where("y IS NOT NULL")
    means = base.selectExpr("sum(w) AS n", *[f"sum({a} * w) AS {a}" for a in names]).first()
    if not means["n"]:
        return {}
    center = {a: (means[a] or 0.0) / means["n"] for a in names}
    around = base.selectExpr(*(["g"] if by else []), "w", *[f"({a} - {double(center[a])}) AS {a}" for a in names])
    sums = ["sum(w) AS n", *[f"sum({a} * w) AS s_{a}" for a in names]]
    sums += [f"sum({a} * {b} * w) AS p_{a}_{b}" for i, a in enumerate(names) for b in names[i:]]
    if by:
        rows = around.groupBy("g").agg(*[F.expr(t) for t in sums]).limit(1001).collect()
    else:
        rows = around.selectExpr(*sums).collect()
    if len(rows) > 1000:
        raise ValueError(f"{by}: too many groups for Gram matrices")
    out = {}
    d = len(features)
    for r in rows:
        n = r["n"]
        if not n:
            continue
        m = len(names)
        s = np.array([r[f"s_{a}"] for a in names])
        p = np.zeros((m, m))
        for i, a in enumerate(names):
            for j in range(i, m):
                p[i, j] = p[j, i] = r[f"p_{a}_{names[j]}"]
        p -= np.outer(s, s) / n
        mu = np.array([center[a] for a in names]) + s / n
        g = Gram(list(features), float(n), mu[:d], p[:d, :d])
        if y is not None:
            g.y_mean, g.xy, g.yy = float(mu[d]), p[:d, d], float(p[d, d])
        out[r["g"] if by else None] = g
    return out


def gram(df: DataFrame, features: list[str], y: str | None = None, weight: str | None = None) -> Gram:
    found = grams(df, features, y, weight=weight)
    if not found:
        raise ValueError("no rows to fit on")
    return found[None]


def gram_table(df: DataFrame, features: list[str], y: str | None = None) -> DataFrame:
    """Gram cells in long form ``(x, y, value)``, upper triangle, around the means."""
    g = gram(df, features, y)
    names = [*features, y] if y else list(features)
    full = g.xx if y is None else np.block([[g.xx, g.xy[:, None]], [g.xy[None, :], np.array([[g.yy]])]])
    rows = [(names[i], names[j], float(full[i, j])) for i in range(len(names)) for j in range(i, len(names))]
    return df.sparkSession.createDataFrame(rows, "x string, y string, value double")


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation in long form ``(x, y, r)``; NULL for constants.

    Two passes: means and value counts, then plain sums around the means for all pairs at once.
    Columns without missing values share their square sums; a pair with missing values gets sums over
    its own complete rows.
    """
    base = df.selectExpr(*[f"{number(c)} AS v{i}" for i, c in enumerate(columns)])
    span = range(len(columns))
    head = base.selectExpr(
        "count(1) AS n", *[f"count(v{i}) AS n{i}" for i in span], *[f"avg(v{i}) AS m{i}" for i in span]
    ).first()
    around = base.selectExpr(*[f"(v{i} - {double(head[f'm{i}'] or 0.0)}) AS v{i}" for i in span])
    full = [head[f"n{i}"] == head["n"] for i in span]
    pairs = [(i, j) for i in span for j in range(i, len(columns))]
    sums = ["count(1) AS n"]
    for i, j in pairs:
        sums.append(f"sum(v{i} * v{j}) AS p{i}_{j}")
        if i != j and not (full[i] and full[j]):
            both = f"v{i} IS NOT NULL AND v{j} IS NOT NULL"
            sums.append(f"count(CASE WHEN {both} THEN 1 END) AS n{i}_{j}")
            for side, v in (("a", f"v{i}"), ("b", f"v{j}")):
                sums.append(f"sum(CASE WHEN {both} THEN {v} END) AS {side}{i}_{j}")
                sums.append(f"sum(CASE WHEN {both} THEN {v} * {v} END) AS {side * 2}{i}_{j}")
    s = around.selectExpr(*sums).first()
    rows = []
    for i, j in pairs:
        shared = i == j or (full[i] and full[j])
        # Around the column's own mean the linear sums vanish, so shared rows need no shift.
        n = s["n"] if shared else s[f"n{i}_{j}"]
        a, b = (0.0, 0.0) if shared else (s[f"a{i}_{j}"] or 0.0, s[f"b{i}_{j}"] or 0.0)
        sxx = (s[f"p{i}_{i}"] if shared else s[f"aa{i}_{j}"]) or 0.0
        syy = (s[f"p{j}_{j}"] if shared else s[f"bb{i}_{j}"]) or 0.0
        sxy = s[f"p{i}_{j}"] or 0.0
        if n:
            sxx, syy, sxy = sxx - a * a / n, syy - b * b / n, sxy - a * b / n
        scale = [1e-13 * max(1.0, (head[f"m{x}"] or 0.0) ** 2) * max(n, 1) for x in (i, j)]
        r = float(sxy / np.sqrt(sxx * syy)) if sxx > scale[0] and syy > scale[1] else None
        rows.append((columns[i], columns[j], r))
        if i != j:
            rows.append((columns[j], columns[i], r))
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")
