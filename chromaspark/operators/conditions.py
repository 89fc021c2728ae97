"""Choosing the best observed pH / solvent condition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chromaspark.functions.columns import col, complement
from chromaspark.functions.reuse import with_ids
from chromaspark.operators.clean import label_text
from chromaspark.operators.lookup import lookup_join
from chromaspark.schema import DESCRIPTORS, PH, QUALITY_PRIORITY, RUN_ID, SMILES

MAX_BROADCAST_CONDITIONS = 50_000


def observed_conditions(df: DataFrame, solvents: list[str], tol: float = 0.0) -> DataFrame:
    """Distinct ``(pH, org, buf)`` that occur in the data with complementary solvent shares.

    ``org`` is the first solvent column and ``buf`` the second, whatever they are called. A surviving
    grid cell must itself be a data row, so no pH x solvent product has to be formed.
    """
    if not solvents:
        return df.select(col(PH).alias("pH"), F.lit(0.0).alias("org"), F.lit(0.0).alias("buf")).limit(0)
    org = col(solvents[0])
    rest = complement(org, len(solvents))
    seen = col(PH).isNotNull() & org.isNotNull()
    if len(solvents) > 1:
        second = col(solvents[1])
        seen = seen & ((second == rest) if tol == 0 else (F.abs(second - rest) <= tol))
    return df.where(seen).select(col(PH).alias("pH"), org.alias("org"), rest.alias("buf")).distinct()


def condition_features(conditions: DataFrame, solvents: list[str], descriptors: bool = False) -> DataFrame:
    """Feature columns of each condition: pH and two solvents set, other solvents 0.

    Descriptors are 0 unless the rows already carry a compound's (``descriptors=True``).
    """
    out = conditions
    for i, name in enumerate(solvents):
        out = out.withColumn(name, col("org") if i == 0 else col("buf") if i == 1 else F.lit(0.0))
    if not descriptors:
        for d in DESCRIPTORS:
            out = out.withColumn(d, F.lit(0.0))
    return out


def score_conditions(predict: Callable[[DataFrame], DataFrame], conditions: DataFrame, solvents: list[str],
                     descriptors: bool = False) -> DataFrame:
    """Predicted class ``code`` of every condition in one batch."""
    keyed = with_ids(condition_features(conditions, solvents, descriptors), RUN_ID)
    scored = predict(keyed)
    return scored.select(*[col(c) for c in conditions.columns], col("prediction").cast("int").alias("code"))


def priority_table(
    spark: SparkSession, labels: list[str], priority: list[str] | None = None, aliases: dict[str, str] | None = None
) -> DataFrame:
    """``(code, label, priority)`` of the known labels on the priority list, best = 1.

    ``aliases`` maps other spellings to a listed one.
    """
    order = {p: i + 1 for i, p in enumerate(priority or QUALITY_PRIORITY)}
    rows = []
    for code, label in enumerate(labels):
        place = order.get((aliases or {}).get(label, label))
        if place is not None:
            rows.append((code, label, place))
    return spark.createDataFrame(rows, "code int, label string, priority int")


def with_priority(scored: DataFrame, labels: list[str], priority: list[str] | None = None,
                  aliases: dict[str, str] | None = None, unlisted: bool = False) -> DataFrame:
    """Attach label and priority. Classes outside the list drop out, or with ``unlisted`` stay without a priority."""
    table = priority_table(scored.sparkSession, labels, priority, aliases)  # one row per label
    if not unlisted:
        return scored.join(F.broadcast(table), "code")
    return scored.join(F.broadcast(table.drop("label")), "code", "left").withColumn("label", label_text(F.col("code"), labels))


def best_condition(ranked: DataFrame) -> DataFrame:
    """The first condition by priority, then lowest pH, then lowest first solvent. May be empty."""
    return ranked.orderBy("priority", "pH", "org").limit(1)


def first_by_priority(ranked: DataFrame, group: list[str]) -> DataFrame:
    """Best condition of each group, as one aggregation."""
    pick = F.min(F.struct("priority", "pH", "org", "buf", "code", "label")).alias("m")
    return ranked.groupBy(*[col(g) for g in group]).agg(pick).select(
        *[col(g) for g in group], "m.pH", "m.org", "m.buf", "m.code", "m.label", "m.priority"
    )


def top_conditions(ranked: DataFrame, n: int = 10, order: str = "priority") -> DataFrame:
    """The ``n`` best conditions; ``order="code"`` sorts by falling label code instead of priority.

    Conditions without a priority (``with_priority(unlisted=True)``) come last, or in their place by code.
    """
    first = F.col("priority").asc_nulls_last() if order == "priority" else F.col("code").desc()
    return ranked.orderBy(first, "pH", "org").limit(n)


def condition_heatmap(df: DataFrame, scored: DataFrame, solvents: list[str], pivot: bool = False) -> DataFrame:
    """Every pH with every first-solvent share, and the predicted code where it was observed.

    The axes are short, bounded lists, so each pH row is expanded by the array of solvent values.
    """
    org = col(solvents[0])
    axis = [r[0] for r in df.select(org.alias("o")).dropna().distinct().limit(10_001).collect()]
    if len(axis) > 10_000:
        raise ValueError("more than 10000 solvent shares: a heatmap needs a coarser grid")
    shares = F.array(*[F.lit(float(v)) for v in sorted(axis)]) if axis else F.array().cast("array<double>")
    cells = df.select(col(PH).alias("pH")).dropna().distinct().select("pH", F.explode(shares).alias("org"))
    long = cells.join(scored.select("pH", "org", "code"), ["pH", "org"], "left")
    return long if not pivot else long.groupBy("pH").pivot("org", sorted(axis)).agg(F.first("code"))


def cross_conditions(compounds: DataFrame, conditions: DataFrame, per_block: int = 64) -> DataFrame:
    """Every compound under every observed condition.

    That product is the result asked for. Conditions are dealt into blocks and joined on the block, so
    the work of one compound is spread over tasks.
    """
    n = conditions.count()
    blocks = max(1, -(-n // per_block))
    dealt = conditions.withColumn("_blk", F.pmod(F.xxhash64("pH", "org", "buf"), F.lit(blocks)).cast("int"))
    if n <= MAX_BROADCAST_CONDITIONS:  # counted just above, so the broadcast is bounded
        dealt = F.broadcast(dealt)
    asked = compounds.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return asked.join(dealt, "_blk").drop("_blk")


def suggest_conditions(
    compounds: DataFrame,
    conditions: DataFrame,
    solvents: list[str],
    classify: Callable[[DataFrame], DataFrame],
    labels: list[str],
    regress: Callable[[DataFrame], DataFrame] | None = None,
    accuracy: float | None = None,
    r2: float | None = None,
    priority: list[str] | None = None,
    aliases: dict[str, str] | None = None,
) -> DataFrame:
    """Best condition for each compound (rows with ``SMILES`` and descriptors), all at once.

    Predictions depend on a compound only through its descriptors, so the product with the conditions
    is formed for distinct descriptor values. A compound without any listed class keeps NULLs.
    """
    known = compounds.select(SMILES, *DESCRIPTORS).distinct()
    bare = known.select(*DESCRIPTORS).distinct()
    scored = score_conditions(classify, cross_conditions(bare, conditions), solvents, descriptors=True)
    best = first_by_priority(with_priority(scored, labels, priority, aliases), DESCRIPTORS)
    if regress is not None:
        asked = with_ids(condition_features(best, solvents, descriptors=True), RUN_ID)
        best = regress(asked).select(*best.columns, col("prediction").alias("retention"))
    out = lookup_join(known, best, DESCRIPTORS, "left", spread=F.xxhash64(SMILES))
    if accuracy is not None:
        out = out.withColumn("accuracy", F.lit(accuracy))
    if r2 is not None:
        out = out.withColumn("r2", F.lit(r2))
    return out


def label_of(scored: DataFrame, labels: list[str], code: str = "code") -> DataFrame:
    return scored.withColumn("label", label_text(col(code), labels))


