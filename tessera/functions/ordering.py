"""Numbers and sums along a global order, without bringing all rows into one task.

Rows are dealt to tasks by range and written down, so that what a task holds stays as it is; each task's totals are added
up in order, a row for each task; and each row adds what its task holds before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import table


def running(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """``df`` and, by name, the sum of each column over all rows up to this one, which counts."""
    dealt = table(df.withColumns(totals).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    tasks = dealt.groupBy("_part").agg(*(F.sum(n).alias(n) for n in totals))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = tasks.select(F.col("_part").alias("_of"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in totals))
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = {n: F.col(f"_before_{n}") + F.sum(n).over(here) for n in totals}
    joined = dealt.join(F.broadcast(earlier), F.col("_part") == F.col("_of"))  # a row for each shuffle partition
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), *(x.alias(n) for n, x in sums.items()))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` and each row's place, from 0, in ``order``."""
    return running(df, order, {name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) - 1)
