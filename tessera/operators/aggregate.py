"""Aggregates of all cells, of each row, or of each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ieee
from tessera.plans.meta import DENSE, INT, Meta

COLUMNS = {
    "count": lambda v: F.count(F.lit(1)),
    "sum": F.sum,
    "avg": F.avg,
    "max": ieee.max_real,
    "min": ieee.min_real,
    "var": ieee.sample_variance,
    "stdev": ieee.sample_deviation,
    "norm": lambda v: F.sqrt(F.sum(v * v)),
}


def of_stored(func: str, v: Column, n: Column, population: bool = False) -> Column:
    """Over n places of which only the cells that aren't 0 are there; count counts these."""
    stored, total = F.count(F.lit(1)), F.sum(v)
    # squares around the stored cells' mean, and what the absent zeros add to them: nothing large is taken from anything large
    around = F.coalesce(F.var_pop(v), F.lit(0.0)) * stored + F.pow(F.coalesce(F.avg(v), F.lit(0.0)), F.lit(2.0)) * stored * (n - stored) / n
    variance = around / n if population else ieee.ieee_div(around, n - 1.0)
    match func:
        case "avg":
            return total / n
        case "max":
            return F.when(stored < n, F.greatest(ieee.max_real(v), F.lit(0.0))).otherwise(ieee.max_real(v))
        case "min":
            return F.when(stored < n, F.least(ieee.min_real(v), F.lit(0.0))).otherwise(ieee.min_real(v))
        case "var":
            return variance
        case "stdev":
            return F.when(variance <= 0, F.lit(0.0)).otherwise(F.sqrt(variance))
    return COLUMNS[func](v)


def table(df: DataFrame, meta: Meta, funcs: tuple[str, ...], keep: str = "") -> DataFrame:
    """One pass for all ``funcs``. For a sparse matrix absent cells count as 0, and a row or column of zeros is absent."""
    v, key = F.col("v").cast("double"), {"rows": "i", "cols": "j", "": None}[keep]
    places = {"rows": meta.cols, "cols": meta.rows, "": meta.size}[keep]
    dense = meta.fmt == DENSE
    chosen = []
    for f in funcs:
        column = COLUMNS[f](v) if dense else of_stored(f, v, F.lit(float(places)))
        chosen.append(column.cast("bigint" if f == "count" or (meta.dtype == INT and f in ("sum", "max", "min")) else "double").alias(f))
    return (df.groupBy(key) if key else df).agg(*chosen)


def cells(df: DataFrame, meta: Meta, func: str, keep: str, drop_zeros: bool) -> DataFrame:
    got = table(df, meta, (func,), keep)
    zero = F.lit(0).cast("bigint")
    i, j = (F.col("i") if keep == "rows" else zero), (F.col("j") if keep == "cols" else zero)
    out = got.select(i.alias("i"), j.alias("j"), F.col(func).alias("v"))
    return out.where("v <> 0") if drop_zeros else out
