"""Products of matrices over cells."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.meta import INT, SPARSE, SQL_TYPES, Meta

#: A side with so many places at most, some 24 MB, goes to all executors.
BROADCAST_CELLS = 1_000_000


#: Inner places up to which rows meet columns, not cells cells; cells of the result for each task of that.
NARROW, CELLS_A_TASK = 16, 8_000_000


def multiply_narrow(a: DataFrame, am: Meta, b: DataFrame, bm: Meta, meta: Meta) -> DataFrame:
    """As ``multiply``, over few inner places: each row of ``a`` meets each column of ``b`` once, with all their cells, so
    that what is shuffled grows with the operands and not with the result."""
    kind = SQL_TYPES[meta.dtype]
    summed = "bigint" if meta.dtype == INT else "double"

    def whole(df: DataFrame, keep: str, inner: str, name: str) -> DataFrame:
        return df.groupBy(keep).agg(*(F.max(F.when(F.col(inner) == k, F.col("v").cast(kind))).alias(f"{name}{k}") for k in range(am.cols)))

    left, right = whole(a, "i", "j", "x"), whole(b, "j", "i", "y")
    tasks = min(4096, -(-meta.size // CELLS_A_TASK))
    if am.size <= BROADCAST_CELLS and am.size <= bm.size:
        left, right = F.broadcast(left), right.repartition(tasks, "j") if tasks > 1 else right
    elif bm.size <= BROADCAST_CELLS:
        left, right = left.repartition(tasks, "i") if tasks > 1 else left, F.broadcast(right)
    met = [F.col(f"x{k}") * F.col(f"y{k}") for k in range(am.cols)]
    total = reduce(operator.add, (F.coalesce(m.cast(summed), F.lit(0).cast(summed)) for m in met))
    cells = left.crossJoin(right).where(F.coalesce(*met).isNotNull()).select("i", "j", total.cast(kind).alias("v"))
    return cells.where("v <> 0") if meta.fmt == SPARSE else cells


def multiply(a: DataFrame, am: Meta, b: DataFrame, bm: Meta, meta: Meta) -> DataFrame:
    """Cells of the product: a join on the inner index, summed by place. An absent cell meets nothing.

    Transposes of the operands are renamed columns of the join, not work. A side whose shape bounds its size is
    broadcast, which leaves only the partially aggregated sums to shuffle. Where both are large, the join shuffles on
    the inner index and adaptive execution splits a frequent one.
    """
    kind = SQL_TYPES[meta.dtype]
    left = a.select("i", F.col("j").alias("k"), F.col("v").cast(kind).alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").cast(kind).alias("y"))
    if am.size <= BROADCAST_CELLS and am.size <= bm.size:
        left = F.broadcast(left)
    elif bm.size <= BROADCAST_CELLS:
        right = F.broadcast(right)
    cells = left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).cast(kind).alias("v"))
    return cells.where("v <> 0") if meta.fmt == SPARSE else cells
