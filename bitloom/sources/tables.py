"""Bit and integer vectors from tables. Layouts: bits (vec_id, pos, bit), ints (vec_id, idx, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bits_of(df: DataFrame, pos: Column | str, bit: Column, vec_id: Column | None = None) -> DataFrame:
    """A bit vector: one row per position, which must be unique within a vec_id. A null predicate is a zero."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return df.select((F.lit("") if vec_id is None else vec_id).alias("vec_id"), pos.cast("bigint").alias("pos"), F.coalesce(bit, F.lit(False)).alias("bit"))


def ints_of(df: DataFrame, idx: Column | str, value: Column | str, vec_id: Column | None = None) -> DataFrame:
    idx, value = (F.col(x) if isinstance(x, str) else x for x in (idx, value))
    return df.select((F.lit("") if vec_id is None else vec_id).alias("vec_id"), idx.cast("bigint").alias("idx"), value.cast("bigint").alias("value"))
