"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.session import written


def range_rank(rows: DataFrame, by: list[str], order: list[str], out: str, weight: str | None = None) -> DataFrame:
    """Add ``out``: the place from 1 on of each row within its group, by ``order``; or the running sum of ``weight``.

    Rows are dealt by range of (group, order), so a group with most of the rows spreads over many tasks; each range then
    starts where the group's earlier ranges end. Only a row a range and group meets in a window over ranges.
    """
    ranged = written(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "_range").agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range", *by).orderBy(*order)
    inside = F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) if weight else F.row_number().over(within)
    same = F.col("_range") == F.col("_r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ranged.withColumn("_in", inside).join(starts, same).withColumn(out, (F.col("_start") + F.col("_in")).cast("long")).select(*rows.columns, out)


def value_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by``, ``v``, ``first``, ``last``, ``n``: the places from 1 on that each distinct value takes among the ``n`` of its group.

    Equal values are counted before they move, so neither a large group nor a value of most rows meets in one task. Nulls
    take no place; a group of nothing else has one row with a null ``v`` and an ``n`` of 0.
    """
    keys = [F.col(c).alias(f"_by{k}") for k, c in enumerate(by)]
    names = [f"_by{k}" for k in range(len(by))]
    slim = rows.select(*keys, F.col(value).cast("double").alias("v"))
    counted = slim.filter("v is not null").groupBy(*names, "v").agg(F.count("*").alias("_count"))
    placed = range_rank(counted, names, ["v"], "last", "_count")
    sizes = slim.groupBy(*names).agg(F.count("v").alias("n")).select(*[F.col(c).alias(f"_s{c}") for c in names], "n")
    same = F.lit(True)
    for c in names:
        same &= F.col(f"_s{c}").eqNullSafe(F.col(c))
    whole = sizes.join(placed, same, "left")
    return whole.select(*[F.col(f"_s{x}").alias(c) for x, c in zip(names, by, strict=True)], "v", (F.col("last") - F.col("_count") + 1).alias("first"), "last", "n")
