"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.session import cut


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """df with the place of each row within its group, from 1.

    Rows are sorted by ranges of (group, order), so that a large group spans many tasks; a task numbers its own rows of a group, and what the ranges
    before hold of it is added. Only one row a group and range is summed up in a single task.
    """
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id()))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)))
    sizes = ranged.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    on = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    placed = own.join(starts, on)
    return placed.select(*df.columns, (F.col("_own") + F.col("_before")).cast("bigint").alias(name))
