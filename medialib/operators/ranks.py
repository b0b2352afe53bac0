"""Numbering of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "place", parts: int | None = None) -> DataFrame:
    """rows with their place (from 0) in the order within their group; no task has a whole group.

    Rows are dealt out by sampled ranges of group and order, which are written
    once; a range counts its groups' rows, and a row's place is that in its
    range and what the ranges before have of its group. Without `by` all rows
    are one group. Ties in the order have some order.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()))
    group = [F.col(c) for c in by]
    counts = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for a range
    counts = counts.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    same = F.col("_range") == F.col("_of")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return dealt.withColumn("_within", within).join(counts, same).select(*rows.columns, (F.col("_before") + F.col("_within") - 1).cast("long").alias(name))
