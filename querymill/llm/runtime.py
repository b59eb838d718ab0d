"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, ensure_checkpoint_dir

__all__ = ["cut", "ensure_checkpoint_dir", "read", "salt_of"]


def salt_of(col: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(salts)).cast("int")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
