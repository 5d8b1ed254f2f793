"""Small readers used by every operator here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.plans.store import drop, materialize, shared_dir

__all__ = ["drop", "materialize", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
