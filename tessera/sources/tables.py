"""Matrices made from relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.matrix import Matrix
from tessera.plans.meta import DOUBLE, SPARSE


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_vectors(df: DataFrame, key: str, vector: str, rows: int, cols: int, value=lambda x: x) -> Matrix:
    """A row for each vector, a column for each component; ``value`` of each component, as a double."""
    vec = F.transform(vector, lambda x: value(x.cast("double")).cast("double"))
    return Matrix.from_rows(df.select(F.col(key).alias("i"), vec.alias("vec")), rows, cols)


def from_pairs(df: DataFrame, row: str, col: str, value: Column, rows: int, cols: int, dtype: str = DOUBLE) -> Matrix:
    """A sparse matrix: the sum of ``value`` for each pair of keys, which needn't be unique."""
    cells = df.groupBy(F.col(row).alias("i"), F.col(col).alias("j")).agg(F.sum(value).alias("v")).where("v <> 0")
    return Matrix.from_cells(cells, rows, cols, SPARSE, dtype)


def from_columns(df: DataFrame, key: str, columns: list[str], rows: int) -> Matrix:
    """A dense matrix of numeric columns, a row for each key (unique, from 0)."""
    return Matrix.from_rows(df.select(F.col(key).alias("i"), F.array(*(F.col(c).cast("double") for c in columns)).alias("vec")), rows, len(columns))


def from_edges(df: DataFrame, source: str, target: str, nodes: int) -> Matrix:
    """A graph as a column-stochastic matrix: each edge (i, j) has 1 / the number of edges whose second end is j."""
    edges = df.select(F.col(source).cast("bigint").alias("i"), F.col(target).cast("bigint").alias("j")).distinct()
    weights = edges.groupBy("j").agg((F.lit(1.0) / F.count(F.lit(1))).alias("v"))
    return Matrix.from_cells(edges.join(weights, "j").select("i", "j", "v"), nodes, nodes, SPARSE)


def introspect(cells: DataFrame) -> DataFrame:
    """What the cells themselves say of a matrix: rows, cols (up to the last one that holds a cell) and nnz."""
    return cells.agg((F.coalesce(F.max("i"), F.lit(-1)) + 1).alias("rows"), (F.coalesce(F.max("j"), F.lit(-1)) + 1).alias("cols"), F.count(F.lit(1)).alias("nnz"))
