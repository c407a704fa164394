"""Metadata of cells in tab-separated files whose column names vary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that may name the donor, the first one found counts, and the author's labels.
DONORS = ("patient", "sample", "donor")
LABEL = "Celltype (major-lineage)"
MALIGNANCY = "Celltype (malignancy)"


def aliased(df: DataFrame) -> DataFrame:
    """(cell_id, donor_raw, label_raw, malignancy_raw) as text; a missing donor or label column raises.

    The first column is the cell. Column names are matched without case and blanks; a missing
    malignancy column reads NA throughout.
    """
    names = {c.lower().replace(" ", ""): c for c in reversed(df.columns)}
    donor = next((names[d] for d in DONORS if d in names), None)
    if donor is None:
        raise ValueError(f"no column of {DONORS} among {df.columns}")
    if LABEL not in df.columns:
        raise ValueError(f"no column {LABEL!r}")
    text = lambda c: F.col(f"`{c}`").cast("string")
    state = text(MALIGNANCY) if MALIGNANCY in df.columns else F.lit("NA")
    return df.select(
        text(df.columns[0]).alias("cell_id"), text(donor).alias("donor_raw"), text(LABEL).alias("label_raw"), state.alias("malignancy_raw")
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return aliased(spark.read.csv(path, sep="\t", header=True))
