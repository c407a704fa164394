"""All queries outside the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators import packed
from gridloom.plans import oracles, queries
from gridloom.sources.session import cut
from gridloom.sources.tables import latest, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value of the packed class lists, with its position and score."""
    lists = ["mappable_classes", "cell_types_retained"]
    scored = {"classes_learnable": False, "per_class_f1_json": True}
    sources = [
        (cut(latest(table(spark, sf_dir, "t1_dataset_manifest"), ["dataset"], "loaded_at", lists)), dict.fromkeys(lists, False)),
        (cut(latest(table(spark, sf_dir, "pilot_results_long"), ["result_id"], "loaded_at", list(scored))), scored),
    ]
    codes = packed.code_table(sources)
    (manifest, plain), (results, mixed) = sources
    return packed.unpacked(manifest, "dataset", plain, codes).unionByName(packed.unpacked(results, "result_id", mixed, codes))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**queries.QUERIES, "p1_found": p1_found}

SQL: dict[str, str] = dict(oracles.SQL)
