"""Molecular descriptors attached by structure text.

The chemistry is pluggable: a provider is either a lookup table keyed by ``SMILES`` or a function
over Arrow batches of *distinct* structures (for example one that calls a cheminformatics package).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chromaspark.functions.columns import col
from chromaspark.functions.reuse import keep
from chromaspark.operators.lookup import lookup_join
from chromaspark.schema import DESCRIPTORS, DESCRIPTOR_TYPES, RUN_ID, SMILES

Provider = DataFrame | Callable[[pd.Series], pd.DataFrame]


def _provided(df: DataFrame, provider: Provider) -> DataFrame:
    """Descriptor rows for the structures a provider knows; each structure is computed once."""
    if isinstance(provider, DataFrame):
        rows = provider.select(SMILES, *[col(d).cast(t).alias(d) for d, t in DESCRIPTOR_TYPES.items()])
        return rows.dropna(subset=[SMILES]).dropDuplicates([SMILES])
    schema = f"{SMILES} string, " + ", ".join(f"{d} {t}" for d, t in DESCRIPTOR_TYPES.items())

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = provider(batch[SMILES]).reset_index(drop=True)
            out.insert(0, SMILES, batch[SMILES].to_numpy())
            yield out[[SMILES, *DESCRIPTORS]]

    # mapInPandas follows the shuffle of distinct(), so costly chemistry is spread over all tasks.
    # The result is kept: size checks and several joins read it, and chemistry is the dearest step.
    return keep(df.select(SMILES).dropna().distinct().mapInPandas(compute, schema).dropna(subset=DESCRIPTORS))


def _ready(df: DataFrame, overwrite: bool) -> DataFrame:
    clash = [d for d in DESCRIPTORS if d in df.columns]
    if clash and not overwrite:
        raise ValueError(f"input already has descriptor columns {clash}; pass overwrite=True to replace them")
    return df.drop(*clash)


def _spread(df: DataFrame):
    return F.xxhash64(col(RUN_ID)) if RUN_ID in df.columns else None


def enrich_descriptors(df: DataFrame, provider: Provider, overwrite: bool = False) -> DataFrame:
    """Add the five descriptors; unknown, invalid or missing structures get zeros."""
    facts = _ready(df, overwrite)
    joined = lookup_join(facts, _provided(facts, provider), [SMILES], "left", spread=_spread(facts))
    zeros = [F.coalesce(col(d), F.lit(0).cast(t)).alias(d) for d, t in DESCRIPTOR_TYPES.items()]
    return joined.select(*[col(c) for c in facts.columns], *zeros)


def strict_descriptors(df: DataFrame, provider: Provider, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split into rows with descriptors and rows rejected because the structure is not known."""
    facts = _ready(df, overwrite)
    known = _provided(facts, provider)
    valid = lookup_join(facts, known, [SMILES], "inner", spread=_spread(facts))
    rejected = lookup_join(facts, known.select(SMILES).withColumn("_hit", F.lit(1)), [SMILES], "left",
                           spread=_spread(facts)).where("_hit IS NULL")
    return (
        valid.select(*[col(c) for c in facts.columns], *DESCRIPTORS),
        rejected.select(*[col(c) for c in facts.columns]),
    )


def default_condition(compounds: DataFrame, solvents: list[str], ph: float = 7.0) -> DataFrame:
    """Feature row for a bare compound: equal solvent shares and a neutral pH."""
    share = 100.0 / len(solvents) if solvents else 0.0
    for name in solvents:
        compounds = compounds.withColumn(name, F.lit(share))
    return compounds.withColumn("pH", F.lit(float(ph)))
