"""Left/inner lookup joins that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from chromaspark.functions.columns import col
from chromaspark.schema import quoted

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024
NO_KEY_SALTS = 1 << 20


def _small(dim: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """Measure at most ``max_rows + 1`` rows of the lookup side: count and text size."""
    wide = [f.name for f in dim.schema.fields if f.dataType.typeName() in ("string", "array", "map", "struct")]
    size = " + ".join([str(8 * len(dim.columns)), *[f"coalesce(octet_length(to_json(struct({quoted(c)}))), 0)" for c in wide]])
    row = dim.limit(max_rows + 1).selectExpr("count(1) AS n", f"sum({size}) AS b").first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "left",
    spread: Column | None = None,
    salts: int = 16,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Attach the unique-keyed ``dim`` to ``facts``.

    A measured small ``dim`` is broadcast, so ``facts`` never moves. Otherwise both sides are
    shuffled on (key, salt): ``dim`` is repeated once per salt and each fact row picks a salt from
    ``spread`` (a column expression that varies inside a hot key, e.g. a hash of the row key). Rows with
    a null in the key are dealt over all tasks.
    """
    if _small(dim, max_rows, max_bytes):
        return facts.join(F.broadcast(dim), on=on, how=how)
    vary = spread if spread is not None else F.xxhash64(*[col(c) for c in facts.columns])
    salt = F.pmod(vary, F.lit(salts))
    # a row without a whole key meets nothing, so it may go anywhere
    anywhere = salts + F.pmod(vary, F.lit(NO_KEY_SALTS))
    bare = reduce(or_, [col(c).isNull() for c in on])
    salted = facts.withColumn("_salt", F.when(bare, anywhere).otherwise(salt).cast("int"))
    repeated = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, on=[*on, "_salt"], how=how).drop("_salt")
