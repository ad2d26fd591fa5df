"""Feature preparation: tables of numbers and strings to matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ordering import numbered


def fill(df: DataFrame, numbers: list[str], strings: list[str]) -> DataFrame:
    return df.fillna(0, numbers).fillna("", strings)


def string_index(df: DataFrame, column: str) -> DataFrame:
    """value, index, n: distinct values by falling frequency, ties in order of the value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts, [F.desc("n"), F.col("value")], "index").select("value", "index", "n")


def one_hot(df: DataFrame, key: str, column: str, index: DataFrame | None = None) -> DataFrame:
    """Cells (i, j, 1.0): j is the index of the row's value."""
    index = string_index(df, column) if index is None else index
    return df.select(F.col(key).alias("i"), F.col(column).alias("value")).join(index.select("value", F.col("index").alias("j")), "value").select("i", "j", F.lit(1.0).alias("v"))


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    """Cells (i, j, v): how often each pair of values occurs."""
    return df.groupBy(F.col(row).alias("i"), F.col(col).alias("j")).agg(F.count(F.lit(1)).alias("v"))


def standard_scale(df: DataFrame, columns: list[str], centre: bool = False) -> DataFrame:
    """The columns divided by their sample deviation, after taking off the mean if ``centre``; constant ones become 0."""
    stats = df.agg(*(f(c).alias(f"{c}__{n}") for c in columns for n, f in (("mean", F.avg), ("dev", F.stddev_samp)))).first()
    scaled = {}
    for c in columns:
        mean, dev = stats[f"{c}__mean"], stats[f"{c}__dev"]
        shifted = F.col(c) - F.lit(mean) if centre else F.col(c)
        scaled[c] = shifted / F.lit(dev) if dev else F.lit(0.0)
    return df.withColumns(scaled)


def assemble(df: DataFrame, key: str, columns: list[str], label: str | None = None) -> DataFrame:
    """Rows (i, vec) with the label y, if one is named."""
    vec = F.array(*(F.col(c).cast("double") for c in columns)).alias("vec")
    return df.select(F.col(key).alias("i"), vec, *([F.col(label).cast("double").alias("y")] if label else []))
