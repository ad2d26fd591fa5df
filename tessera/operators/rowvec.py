"""Tall and narrow matrices as one vector a row, (i, vec): sums over rows as one pass with small partial results.

The number of columns is a stated bound (``MOST_COLUMNS``), checked where sums are taken: what a task hands on, and the
driver holds, is square in it at most. Rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.matrix import Matrix

MOST_COLUMNS = 2048
#: Tasks that add up what all tasks hand on; as many sums reach the driver.
FAN = 4


def rows(batch: pa.RecordBatch, name: str = "vec") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _checked(name: str, x: np.ndarray) -> np.ndarray:
    if x.ndim > 2 or max(x.shape, default=0) > MOST_COLUMNS:
        raise ValueError(f"{name} of {x.shape} is wider than {MOST_COLUMNS}")
    return np.ascontiguousarray(x, float)


def sums(df: DataFrame, of: Callable[[pa.RecordBatch], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """``of`` each batch, added up by name: inside each task, then by ``FAN`` tasks over the tasks, then on the driver.

    A task hands on one binary row for each name, of a size that ``MOST_COLUMNS`` bounds.
    """
    kind = "part int, name string, shape array<int>, data binary"

    def batch_of(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        part = TaskContext.get().partitionId() % FAN  # the same when a lost task runs again
        columns = [pa.array([part] * len(held), pa.int32()), pa.array(list(held), pa.string()), pa.array([list(x.shape) for x in held.values()], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "name", "shape", "data"])

    def add(held: dict[str, np.ndarray], name: str, x: np.ndarray) -> None:
        held[name] = held[name] + x if name in held else x

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for name, x in of(batch).items():
                    add(held, name, _checked(name, np.asarray(x)))
        if held:
            yield batch_of(held)

    def read(held: dict[str, np.ndarray], batch: pa.RecordBatch | pa.Table) -> None:
        for name, shape, data in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            add(held, name, np.frombuffer(data).reshape(shape))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            read(held, batch)
        if held:
            yield batch_of(held)

    parts = df.mapInArrow(partial, kind).repartition(FAN, "part").mapInArrow(total, kind)
    out: dict[str, np.ndarray] = {}
    read(out, parts.toArrow())
    return out


def gram_frame(df: DataFrame, vec: str = "vec") -> DataFrame:
    """XᵀX as cells (i, j, v), without bringing it to the driver: one small square for each task, added up by place."""
    return _products(df.select(vec), lambda batch: (x := rows(batch, vec)).T @ x)


def cross_frame(a: DataFrame, b: DataFrame) -> DataFrame:
    """AᵀB as cells (i, j, v): rows meet by number, then as ``gram_frame``."""
    both = a.select("i", F.col("vec").alias("x")).join(b.select("i", F.col("vec").alias("y")), "i").select("x", "y")
    return _products(both, lambda batch: rows(batch, "x").T @ rows(batch, "y"))


def _products(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                x = _checked("a product", of(batch))
                held = x if held is None else held + x
        if held is not None:
            n, m = held.shape
            offsets = pa.array(np.arange(0, n * m + 1, m, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.ListArray.from_arrays(offsets, pa.array(held.ravel()))], ["i", "row"])

    rows_ = df.mapInArrow(partial, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    return rows_.groupBy("i", "j").agg(F.sum("v").alias("v")).select("i", F.col("j").cast("bigint").alias("j"), "v")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def times_vector(df: DataFrame, w: list[float], vec: str = "vec") -> DataFrame:
    """X·w as cells, by native array expressions; w has as many numbers as X has columns."""
    return df.select(F.col("i"), F.lit(0).cast("bigint").alias("j"), dot(F.col(vec), F.array(*(F.lit(float(x)) for x in w))).alias("v"))


def times_matrix(df: DataFrame, m: np.ndarray, vec: str = "vec") -> DataFrame:
    """X·M as rows (i, vec), for a small M."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows(batch, vec) @ m
                offsets = pa.array(np.arange(0, out.size + 1, m.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], ["i", "vec"])

    return df.select("i", vec).mapInArrow(apply, "i long, vec array<double>")


def from_matrix(matrix: Matrix) -> DataFrame:
    """(i, vec) of a narrow matrix; absent cells are 0."""
    from tessera.plans import lowering, rules

    if (n := matrix.meta.cols) > MOST_COLUMNS:
        raise ValueError(f"{n} columns are more than {MOST_COLUMNS}")
    if (own := lowering.as_rows(rules.rewrite(matrix))) is not None:
        return own
    ordered = matrix.densify().cells().groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", F.col("v").cast("double").alias("v")))).alias("cells"))
    return ordered.select("i", F.transform("cells", lambda c: c["v"]).alias("vec"))


def to_matrix(df: DataFrame, rows_: int, cols: int, vec: str = "vec") -> Matrix:
    return Matrix.from_rows(df.select("i", F.col(vec).alias("vec")), rows_, cols)


def join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two matrices side by side, by row number."""
    return a.select("i", F.col("vec").alias("left")).join(b.select("i", F.col("vec").alias("right")), "i").select("i", F.concat("left", "right").alias("vec"))


def split_label(df: DataFrame, at: int = 0) -> DataFrame:
    """(i, vec, y): the component at a place becomes the label, the others the vector."""
    rest = F.concat(F.slice("vec", 1, at), F.slice("vec", at + 2, F.size("vec"))) if at else F.slice("vec", 2, F.size("vec"))
    return df.select("i", rest.alias("vec"), F.element_at("vec", at + 1).alias("y"))
