"""Scalar Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from chromaspark.schema import quoted


def col(name: str) -> Column:
    """Column by exact name, safe for names with ``%`` or dots."""
    return F.col(quoted(name))


def number(name: str) -> str:
    """SQL text: column as double with NaN turned into NULL, so aggregates skip it."""
    return f"nanvl(cast({quoted(name)} AS double), cast(NULL AS double))"


def zero(name: str) -> str:
    """SQL text: feature value as double, missing values as 0."""
    return f"coalesce({number(name)}, 0D)"


def double(value: float) -> str:
    """SQL text of a double literal."""
    return f"{float(value)!r}D"


# Expressions are built as SQL text where there are many of them: one call instead of one per node.


def to_number(name: str) -> Column:
    """Text to double; anything that is not a plain number becomes NULL.

    The pattern keeps out Java-only spellings such as ``1d`` that a cast would accept.
    """
    text = f"trim(cast({quoted(name)} AS string))"
    plain = r"r'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
    return F.expr(f"CASE WHEN {text} RLIKE {plain} THEN try_cast({text} AS double) END")


def clean_double(name: str) -> Column:
    return F.expr(number(name))


def zero_filled(name: str) -> Column:
    return F.expr(zero(name))


def hash_text(key: str, seed: int) -> str:
    """SQL text of a portable 32-bit hash of ``seed:key``, equal in every engine that has md5."""
    return f"cast(conv(substring(md5(concat('{seed}:', cast({quoted(key)} AS string))), 1, 8), 16, 10) AS bigint)"


def hash32(key: str, seed: int) -> Column:
    return F.expr(hash_text(key, seed))


def complement(organic: Column, n_solvents: int) -> Column:
    """Share of the second solvent: what is left of 100, or 0 when there is only one."""
    return F.lit(100.0) - organic if n_solvents > 1 else F.lit(0.0)


def run_label(compound: Column, buffer: Column, organic: Column, ph: Column) -> Column:
    """Display label ``Compound buffer:organic pH``; shares are cut to whole numbers."""
    return F.concat(
        compound, F.lit(" "), buffer.cast("int").cast("string"), F.lit(":"),
        organic.cast("int").cast("string"), F.lit(" "), ph.cast("string"),
    )


def cut_text(c: Column, width: int) -> Column:
    """Value as text, cut to ``width`` characters plus ``...``."""
    s = c.cast("string")
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width), F.lit("..."))).otherwise(s)


def residual(actual: Column, predicted: Column) -> Column:
    return actual - predicted


def dot(names: list[str], weights, bias: float = 0.0) -> Column:
    """Linear form over zero-filled features with literal weights."""
    terms = [double(bias), *[f"{zero(n)} * {double(w)}" for n, w in zip(names, weights)]]
    return F.expr(" + ".join(terms))


def feature_array(names: list[str]) -> Column:
    """Zero-filled features as ``array<double>``."""
    return F.expr(f"array({', '.join(zero(n) for n in names)})")


def features_as(names: list[str], aliases: list[str] | None = None) -> list[str]:
    """SQL texts of the zero-filled features under their own (or other) names."""
    return [f"{zero(n)} AS {quoted(a)}" for n, a in zip(names, aliases or names)]
