"""Prefix sums and as-of lookups without a window over all rows of a vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an inner window; sums of so many go to the next level.
FAN = 4096


def prefix_sums(df: DataFrame, idx: str, value: str, out: str, levels: int = 2) -> DataFrame:
    """df (vec_id, idx, value, ...) with `out`: the sum of value over smaller idx of the same vec_id.

    idx is divided by FAN level by level; only the sums of the last level (rows / FAN**levels) are scanned in one window
    per vector, all others in windows of FAN rows.
    """
    w = Window.partitionBy("vec_id").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    if levels == 0:
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0).cast("bigint")))
    group, base, inner = f"{idx}_{levels}", f"{out}_{levels}", Window.partitionBy("vec_id", f"{idx}_{levels}").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(group, F.floor(F.col(idx) / FAN))
    sums = prefix_sums(df.groupBy("vec_id", group).agg(F.sum(value).alias("s")), group, "s", base, levels - 1).select("vec_id", group, base)
    inside = df.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0).cast("bigint")))
    return inside.join(sums, ["vec_id", group]).withColumn(out, F.col(out) + F.col(base)).drop(group, base)


def number_rows(df: DataFrame, order: list[str], width: int = 1024) -> DataFrame:
    """df with vec_id '' and a dense `pos` from 0 in the given order, whose first column is an integer.

    Rows are numbered within ranges of that column; the ranges' counts are prefix sums.
    """
    df = df.withColumn("vec_id", F.lit("")).withColumn("range_", F.floor(F.col(order[0]) / width))
    starts = prefix_sums(df.groupBy("vec_id", "range_").agg(F.count("*").alias("n_")), "range_", "n_", "start_").select("vec_id", "range_", "start_")
    own = F.row_number().over(Window.partitionBy("vec_id", "range_").orderBy(*order)) - 1
    return df.withColumn("pos", own.cast("bigint")).join(starts, ["vec_id", "range_"]).withColumn("pos", F.col("pos") + F.col("start_")).drop("range_", "start_")
