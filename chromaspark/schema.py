"""Column names, label ranking and model catalogues.

Fixed values: they must be spelled exactly like this for results to match the
data files users already have (the label spellings are those found in the data).
"""

from __future__ import annotations

RUN_ID = "run_id"
COMPOUND = "Compound"
SMILES = "SMILES"
RETENTION = "Retention_Time_min"
QUALITY = "Separation_Quality"
QUALITY_CODE = "SepQuality_Code"
PH = "pH"
SOLVENT_SUFFIX = "_%"
NO_DATA = "No data"

DESCRIPTORS = ["MolWt", "LogP", "TPSA", "HBD", "HBA"]
DESCRIPTOR_TYPES = {"MolWt": "double", "LogP": "double", "TPSA": "double", "HBD": "int", "HBA": "int"}

# Separation quality, best to worst.
QUALITY_PRIORITY = [
    "Completely separated",
    "Switching-fully separated",
    "Switching-partialy separated",
    "Partialy separated",
    "Overlaping",
    "No data",
]

# Catalogue order decides metric ties between models.
REGRESSION_CATALOG = ["LR", "Ridge", "Lasso", "RF", "GB", "SVR", "MLP", "KNN", "DT"]
CLASSIFICATION_CATALOG = ["RFC", "GBC", "SVC", "MLPC", "KNN", "DT", "LR"]
DEFAULT_REGRESSION = ["LR", "RF", "GB", "SVR", "MLP"]
DEFAULT_CLASSIFICATION = ["RFC", "GBC", "SVC", "MLPC"]

# Text tokens a CSV reader must treat as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def solvent_columns(columns) -> list[str]:
    """Solvent share columns (names ending in ``_%``) in table order."""
    names = columns.columns if hasattr(columns, "columns") else columns
    return [c for c in names if c.endswith(SOLVENT_SUFFIX)]


def feature_columns(columns) -> list[str]:
    """Model features: solvents in table order, the five descriptors, pH."""
    return solvent_columns(columns) + DESCRIPTORS + [PH]


def quoted(name: str) -> str:
    """Back-quoted column name, needed for names holding ``%``."""
    return "`" + name.replace("`", "``") + "`"
