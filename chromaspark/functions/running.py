"""Running totals over an order that is too long for a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from chromaspark.functions.columns import col
from chromaspark.functions.reuse import fits_rows

ONE_WINDOW_ROWS = 200_000


def running_totals(
    df: DataFrame, group: str, order: str, values: list[str], descending: bool = True, pieces: int = 256
) -> DataFrame:
    """Inclusive running sums of ``values`` along ``order`` in each ``group``, as ``cum_<value>``.

    ``df`` must hold one row per (group, order) value. The order is cut into ranges at approximate
    quantiles; range totals give the offsets and only the inside of a range is windowed.
    """
    by = col(order).desc() if descending else col(order).asc()
    if fits_rows(df, ONE_WINDOW_ROWS):  # counted: short enough for one plain window
        w = W.partitionBy(col(group)).orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.select("*", *[F.sum(v).over(w).alias(f"cum_{v}") for v in values])
    cuts = df.groupBy(col(group)).agg(
        F.percentile_approx(col(order), [i / pieces for i in range(1, pieces)], 1000).alias("_cuts")
    )
    rows = df.join(F.broadcast(cuts), group)
    piece = F.size(F.filter("_cuts", lambda c: c <= col(order)))
    rows = rows.withColumn("_piece", -piece if descending else piece).drop("_cuts")
    earlier = W.partitionBy(col(group)).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(col(group), F.col("_piece")).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    offsets = totals.select(
        col(group), "_piece", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    inside = W.partitionBy(col(group), F.col("_piece")).orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = rows.select("*", *[F.sum(v).over(inside).alias(f"_l_{v}") for v in values])
    joined = local.join(F.broadcast(offsets), [group, "_piece"])
    return joined.select(
        *[col(c) for c in df.columns], *[(F.col(f"_o_{v}") + F.col(f"_l_{v}")).alias(f"cum_{v}") for v in values]
    )
