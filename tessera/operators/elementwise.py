"""Cell by cell: two matrices, or a matrix and a constant."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ieee
from tessera.plans.meta import DENSE, INT, SPARSE, SQL_TYPES, Meta


def apply(op: str, a: Column, b: Column, dtype: str) -> Column:
    match op:
        case "add":
            return a + b
        case "sub":
            return a - b
        case "mul":
            return a * b
        case "div":
            return ieee.int_div(a, b) if dtype == INT else ieee.ieee_div(a.cast("double"), b.cast("double")).cast(SQL_TYPES[dtype])
    raise ValueError(f"unknown operator {op}")


def combine(a: DataFrame, am: Meta, b: DataFrame, bm: Meta, op: str, meta: Meta) -> DataFrame:
    """Cells of ``a op b``; absent cells count as 0, and a sparse result has none that are 0.

    Sums and differences with a sparse side need no join: the cells of both are added up by place, which Spark
    aggregates in part before the one shuffle. Products of sparse sides meet in an inner join, as what is absent on
    either side stays absent; quotients in a full one.
    """
    kind = SQL_TYPES[meta.dtype]
    left, right = a.select("i", "j", F.col("v").cast(kind).alias("x")), b.select("i", "j", F.col("v").cast(kind).alias("y"))
    x, y = F.col("x"), F.col("y")
    if op in ("add", "sub") and SPARSE in (am.fmt, bm.fmt):
        signed = right.select("i", "j", (-y if op == "sub" else y).alias("x"))
        cells = left.unionAll(signed).groupBy("i", "j").agg(F.sum("x").cast(kind).alias("v"))
    elif am.fmt == bm.fmt == DENSE or (op == "mul" and am.fmt == bm.fmt == SPARSE):
        cells = left.join(right, ["i", "j"]).select("i", "j", apply(op, x, y, meta.dtype).alias("v"))
    else:
        how = "full" if am.fmt == bm.fmt else "left" if am.fmt == DENSE else "right"
        zero = F.lit(0).cast(kind)
        cells = left.join(right, ["i", "j"], how).select("i", "j", apply(op, F.coalesce(x, zero), F.coalesce(y, zero), meta.dtype).alias("v"))
    return cells.where("v <> 0") if meta.fmt == SPARSE else cells


def combine_filled(a: DataFrame, of_a: Column, b: DataFrame, of_b: Column, op: str, meta: Meta) -> tuple[DataFrame, Column]:
    """``a op b`` of matrices that are known by stored cells and a value for all others: the same of the result."""
    kind = SQL_TYPES[meta.dtype]
    x, y = (F.col(name).cast(kind) for name in "xy")
    of_a, of_b = of_a.cast(kind), of_b.cast(kind)
    pairs = a.select("i", "j", F.col("v").alias("x"), F.lit(True).alias("in_a")).join(b.select("i", "j", F.col("v").alias("y"), F.lit(True).alias("in_b")), ["i", "j"], "full")
    own = F.when(F.col("in_a"), x).otherwise(of_a), F.when(F.col("in_b"), y).otherwise(of_b)
    return pairs.select("i", "j", apply(op, *own, meta.dtype).alias("v")), apply(op, of_a, of_b, meta.dtype)


def constant_of(v: Column, op: str, constant: float, side: str, meta: Meta) -> Column:
    kind = SQL_TYPES[meta.dtype]
    v, c = v.cast(kind), F.lit(constant).cast(kind)
    return apply(op, *((v, c) if side == "right" else (c, v)), meta.dtype)


def with_constant(a: DataFrame, am: Meta, op: str, constant: float, side: str, meta: Meta) -> DataFrame:
    cells = a.select("i", "j", constant_of(F.col("v"), op, constant, side, meta).alias("v"))
    return cells.where("v <> 0") if meta.fmt == SPARSE else cells


def map_numpy(df: DataFrame, f) -> DataFrame:
    def convert(batches):
        for batch in batches:
            values = np.asarray(f(batch.column(2).to_numpy(zero_copy_only=False).astype(float)), float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["i", "j", "v"])

    return df.select("i", "j", "v").mapInArrow(convert, "i long, j long, v double")
