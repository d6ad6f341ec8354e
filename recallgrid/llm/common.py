"""Helpers shared by the training-data operators: written tables, worker caches, the driver's tables."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession

from ..shared import delete, new_path, remove, shared_dir, small_batches, written  # noqa: F401


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for loaded models and word caches."""
    mod = sys.modules.get("_recallgrid_worker")
    if mod is None:
        mod = sys.modules["_recallgrid_worker"] = types.ModuleType("_recallgrid_worker")
        mod.store = {}
    return mod.store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(taken, *wanted: str) -> list[str]:
    """Names for a plan's own columns that none of the columns taken has, whatever its case."""
    low = {c.lower() for c in taken}
    out = []
    for w in wanted:
        while w.lower() in low:
            w += "_"
        low.add(w.lower())
        out.append(w)
    return out
