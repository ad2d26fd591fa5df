"""The lazy matrix: a small expression graph over DataFrames of cells.

Building an expression runs nothing. ``cells()`` rewrites the graph (``rules``) and lowers it to one DataFrame plan
(``lowering``) of (i, j, v), which Catalyst optimises and Spark runs. Nodes are shared where expressions are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ieee
from tessera.plans.meta import DENSE, DOUBLE, SPARSE, SQL_TYPES, Meta, result_format, result_type

ADD, SUB, MUL, DIV = "add", "sub", "mul", "div"
COUNT, SUM, AVG, MAX, MIN, VAR, STDEV, NORM = AGGREGATES = ("count", "sum", "avg", "max", "min", "var", "stdev", "norm")
LEFT, RIGHT = "left", "right"


def drawn(seed: int, *places: str) -> Column:
    """A number in [0, 1) from a digest of the seed and the places."""
    digits = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") for p in places)))
    return F.conv(F.substring(digits, 1, 13), 16, 10).cast("double") / float(16**13)


def _places(spark, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select(F.expr(f"id div {max(cols, 1)}").alias("i"), (F.col("id") % max(cols, 1)).alias("j"))


@dataclass(eq=False)
class Matrix:
    """A node: its operator, operands, parameters, and what is known of its result."""

    op: str
    meta: Meta
    operands: tuple[Matrix, ...] = ()
    params: dict = field(default_factory=dict)

    # sources

    @classmethod
    def from_cells(cls, df: DataFrame, rows: int, cols: int, fmt: str = DENSE, dtype: str = DOUBLE, tile: tuple[int, int] = (1000, 1000)) -> Matrix:
        """Cells (i, j, v), at most one for each place. A dense matrix must have all of them."""
        typed = df.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast(SQL_TYPES[dtype]).alias("v"))
        return cls("cells", Meta(rows, cols, fmt, dtype, tile), params={"df": typed})

    @classmethod
    def from_rows(cls, df: DataFrame, rows: int, cols: int, tile: tuple[int, int] = (1000, 1000)) -> Matrix:
        """A dense matrix of one vector a row (i, vec), which products of tall and narrow matrices keep as it is."""
        typed = df.select(F.col("i").cast("bigint").alias("i"), F.col("vec").cast("array<double>").alias("vec"))
        return cls("rows", Meta(rows, cols, DENSE, DOUBLE, tile), params={"df": typed})

    @classmethod
    def build(cls, spark, rows: int, cols: int, formula: Callable[[Column, Column], Column], dtype: str = DOUBLE) -> Matrix:
        """``formula`` of the row and column number in each cell; dense."""
        return cls.from_cells(_places(spark, rows, cols).withColumn("v", formula(F.col("i"), F.col("j"))), rows, cols, dtype=dtype)

    @classmethod
    def full(cls, spark, rows: int, cols: int, value: float, tile: tuple[int, int] = (1000, 1000), density: float = 1.0, seed: int = 0) -> Matrix:
        """One value everywhere; under a density of 1, in that share of the cells of a sparse matrix."""
        grid = _places(spark, rows, cols)
        if density < 1:
            return cls.from_cells(grid.where(drawn(seed, "i", "j") < density).withColumn("v", F.lit(float(value))).where("v <> 0"), rows, cols, SPARSE, tile=tile)
        return cls.from_cells(grid.withColumn("v", F.lit(float(value))), rows, cols, tile=tile)

    @classmethod
    def sequence(cls, spark, start: float, stop: float, step: float = 1.0) -> Matrix:
        """A column vector of start, start + step, ... up to stop, inclusive."""
        n = max(0, int((stop - start) / step + 1e-9) + 1)
        return cls.from_cells(spark.range(n).select(F.col("id").alias("i"), F.lit(0).alias("j"), (F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("v")), n, 1)

    @classmethod
    def random_triples(cls, spark, rows: int, cols: int, entries: int, seed: int) -> Matrix:
        """A sparse matrix of uniform values at random places, those that meet added up, and its first and last cell set."""
        entry = spark.range(entries).select(F.floor(drawn(seed, "id") * rows).alias("i"), F.floor(drawn(seed + 1, "id") * cols).alias("j"), drawn(seed + 2, "id").alias("v"))
        corners = spark.createDataFrame([(0, 0, 1.0), (rows - 1, cols - 1, 1.0)], "i long, j long, v double")
        return cls.from_cells(entry.unionAll(corners).groupBy("i", "j").agg(F.sum("v").alias("v")), rows, cols, SPARSE)

    @classmethod
    def identity(cls, spark, n: int) -> Matrix:
        return cls.from_cells(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), n, n, SPARSE)

    @classmethod
    def random(cls, spark, rows: int, cols: int, seed: int, density: float = 1.0, normal: bool = False) -> Matrix:
        """Uniform in [0, 1), or normal, values; under a density of 1 a sparse matrix with that share of its cells. Each
        is drawn from the seed and its place, so that neither partitions nor lost executors change it."""
        grid = _places(spark, rows, cols)
        if density < 1:
            grid = grid.where(drawn(seed + 1, "i", "j") < density)
        value = drawn(seed, "i", "j")
        if normal:
            value = F.sqrt(-2.0 * F.log(1.0 - value)) * F.cos(2 * math.pi * drawn(seed + 2, "i", "j"))
        return cls.from_cells(grid.withColumn("v", value), rows, cols, DENSE if density >= 1 else SPARSE)

    # element by element

    def _with(self, other, op: str) -> Matrix:
        if isinstance(other, Matrix):
            if self.meta.shape != other.meta.shape:
                raise ValueError(f"shapes differ: {self.meta.shape} and {other.meta.shape}")
            meta = self.meta.but(fmt=result_format(self.meta.fmt, other.meta.fmt), dtype=result_type(self.meta.dtype, other.meta.dtype))
            return Matrix("elementwise", meta, (self, other), {"op": op})
        return self.with_constant(other, op, RIGHT)

    def with_constant(self, constant: float, op: str, side: str = RIGHT) -> Matrix:
        """``self op constant`` for side right, ``constant op self`` for left. Where 0 doesn't stay 0, the result is dense."""
        kept = op == MUL or (op == DIV and side == RIGHT and constant != 0) or (op in (ADD, SUB) and constant == 0)
        dtype = result_type(self.meta.dtype, "int" if isinstance(constant, int) and self.meta.dtype == "int" else DOUBLE if self.meta.dtype != "float" else "float")
        meta = self.meta.but(fmt=self.meta.fmt if kept else DENSE, dtype=dtype)
        return Matrix("constant", meta, (self if kept else self.densify(),), {"op": op, "constant": constant, "side": side})

    def __add__(self, other):
        return self._with(other, ADD)

    def __sub__(self, other):
        return self._with(other, SUB)

    def __mul__(self, other):
        return self._with(other, MUL)

    def __truediv__(self, other):
        return self._with(other, DIV)

    def __radd__(self, c):
        return self.with_constant(c, ADD, LEFT)

    def __rsub__(self, c):
        return self.with_constant(c, SUB, LEFT)

    def __rmul__(self, c):
        return self.with_constant(c, MUL, LEFT)

    def __rtruediv__(self, c):
        return self.with_constant(c, DIV, LEFT)

    def map(self, f: Callable[[Column], Column]) -> Matrix:
        """``f`` of each cell, absent ones included: the result is dense."""
        return Matrix("map", self.meta.but(fmt=DENSE, dtype=DOUBLE), (self.densify(),), {"f": f})

    def map_stored(self, f: Callable[[Column], Column]) -> Matrix:
        """``f``, which must keep 0 at 0, of the cells that are there; the format stays."""
        return Matrix("map", self.meta.but(dtype=DOUBLE), (self,), {"f": f})

    def map_numpy(self, f: Callable) -> Matrix:
        """As ``map``, for what Spark's expressions can't say: ``f`` of NumPy arrays, in Arrow batches; NaN stays NaN."""
        return Matrix("map_numpy", self.meta.but(fmt=DENSE, dtype=DOUBLE), (self.densify(),), {"f": f})

    def cast(self, dtype: str) -> Matrix:
        """Another value type; to int, cut towards zero."""
        return Matrix("cast", self.meta.but(dtype=dtype), (self,))

    def exp(self) -> Matrix:
        return self.map(F.exp)

    def sigmoid(self) -> Matrix:
        return self.map(ieee.sigmoid)

    # layout

    @property
    def T(self) -> Matrix:  # noqa: N802
        return Matrix("transpose", self.meta.transposed(), (self,))

    def subarray(self, row_range: tuple[int, int], col_range: tuple[int, int]) -> Matrix:
        """Rows and columns between bounds, both inclusive, clipped to the matrix; places count from the lower bounds."""
        (r0, r1), (c0, c1) = row_range, col_range
        r0, c0, r1, c1 = max(r0, 0), max(c0, 0), min(r1, self.meta.rows - 1), min(c1, self.meta.cols - 1)
        return Matrix("subarray", self.meta.but(rows=max(0, r1 - r0 + 1), cols=max(0, c1 - c0 + 1)), (self,), {"rows": (r0, r1), "cols": (c0, c1)})

    def densify(self) -> Matrix:
        return self if self.meta.fmt == DENSE else Matrix("densify", self.meta.but(fmt=DENSE), (self,))

    def sparsify(self) -> Matrix:
        return self if self.meta.fmt == SPARSE else Matrix("sparsify", self.meta.but(fmt=SPARSE), (self,))

    def retile(self, tile: tuple[int, int]) -> Matrix:
        """Another tile size; cells don't move."""
        return Matrix("retile", self.meta.but(tile=tile), (self,))

    def sample(self, share: float, seed: int = 0) -> DataFrame:
        """The cells of a share of the rows, drawn by row number; rows keep their numbers."""
        return self.cells().where(drawn(seed, "i") < share)

    def cbind(self, other: Matrix) -> Matrix:
        if self.meta.rows != other.meta.rows:
            raise ValueError("numbers of rows differ")
        return self._bind(other, "cbind", self.meta.but(cols=self.meta.cols + other.meta.cols))

    def rbind(self, other: Matrix) -> Matrix:
        if self.meta.cols != other.meta.cols:
            raise ValueError("numbers of columns differ")
        return self._bind(other, "rbind", self.meta.but(rows=self.meta.rows + other.meta.rows))

    def _bind(self, other: Matrix, op: str, meta: Meta) -> Matrix:
        a, b = (self, other) if self.meta.fmt == other.meta.fmt else (self.densify(), other.densify())
        return Matrix(op, meta.but(fmt=a.meta.fmt, dtype=result_type(a.meta.dtype, b.meta.dtype)), (a, b))

    def diag(self) -> Matrix:
        """A column vector as a diagonal matrix."""
        if self.meta.cols != 1:
            raise ValueError("only a column vector has a diagonal matrix")
        return Matrix("diag", self.meta.but(cols=self.meta.rows, fmt=SPARSE), (self,))

    # products, aggregates, windows

    def __matmul__(self, other: Matrix) -> Matrix:
        if self.meta.cols != other.meta.rows:
            raise ValueError(f"inner sizes differ: {self.meta.shape} and {other.meta.shape}")
        meta = Meta(self.meta.rows, other.meta.cols, result_format(self.meta.fmt, other.meta.fmt), result_type(self.meta.dtype, other.meta.dtype), (self.meta.tile[0], other.meta.tile[1]))
        return Matrix("matmul", meta, (self, other))

    def aggregate(self, func: str, keep: str = "") -> Matrix:
        """keep ``rows``: one value a row, as a column vector; ``cols``: a row vector; nothing: 1 x 1."""
        if func not in AGGREGATES or keep not in ("rows", "cols", ""):
            raise ValueError(f"no aggregate {func} by {keep!r}")
        rows, cols = self.meta.rows if keep == "rows" else 1, self.meta.cols if keep == "cols" else 1
        meta = self.meta.but(rows=rows, cols=cols, dtype="int" if func == COUNT else self.meta.dtype if func in (SUM, MAX, MIN) else DOUBLE)
        return Matrix("aggregate", meta if keep else meta.but(fmt=DENSE), (self,), {"funcs": (func,), "keep": keep})

    def sum(self) -> Matrix:
        return self.aggregate(SUM)

    def norm(self) -> Matrix:
        return self.aggregate(NORM)

    def window(self, size: tuple[int, int], func: str) -> Matrix:
        """``func`` over a moving window, clipped at the borders; from centre - size // 2, ``size`` cells in each dimension."""
        if func not in AGGREGATES or min(size) < 1:
            raise ValueError(f"no window {func} of {size}")
        return Matrix("window", self.meta.but(fmt=DENSE, dtype="int" if func == COUNT else DOUBLE), (self.densify(),), {"size": size, "funcs": (func,)})

    # results

    def cells(self) -> DataFrame:
        """The cells (i, j, v) as a DataFrame; nothing has run yet."""
        from tessera.plans import lowering, rules

        return lowering.lower(rules.rewrite(self))

    def aggregates(self, funcs=AGGREGATES, keep: str = "") -> DataFrame:
        """Several aggregates in one pass: i or j, where kept, and a column for each."""
        from tessera.operators import aggregate
        from tessera.plans import lowering, rules

        return aggregate.table(lowering.lower(rules.rewrite(self)), self.meta, tuple(funcs), keep)

    def windows(self, size: tuple[int, int], funcs=AGGREGATES) -> DataFrame:
        """Several functions over one moving window: i, j and a column for each."""
        from tessera.operators import window
        from tessera.plans import lowering, rules

        dense = self.densify()
        return window.table(lowering.lower(rules.rewrite(dense)), size, tuple(funcs))

    def persist(self) -> Matrix:
        """The result held by Spark once it is first computed, for expressions that use it several times."""
        return Matrix("cells", self.meta, params={"df": self.cells().persist()})

    def checkpoint(self) -> Matrix:
        """The result written to the shared folder: cuts the lineage of a loop, and survives lost executors."""
        from tessera.sources.shared import table

        return Matrix("cells", self.meta, params={"df": table(self.cells(), "checkpoint")})

    def scalar(self) -> float:
        row = self.cells().first()
        return 0.0 if row is None else row["v"]

    def to_numpy(self, most: int = 4_000_000):
        """All cells on the driver; only up to a stated size."""
        import numpy as np

        if self.meta.size > most:
            raise ValueError(f"{self.meta.shape} is more than {most} cells")
        out = np.zeros(self.meta.shape)
        got = self.cells().toArrow()
        out[got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("v").to_numpy()
        return out

    def explain(self, mode: str = "formatted") -> None:
        print(self.tree())
        self.cells().explain(mode)

    def tree(self, depth: int = 0) -> str:
        """The expression graph as it will be lowered, a node a line."""
        from tessera.plans import rules

        node = rules.rewrite(self) if not depth else self
        known = {k: v for k, v in node.params.items() if k not in ("df", "f")}
        line = "  " * depth + f"{node.op} {node.meta.rows}x{node.meta.cols} {node.meta.fmt} {known or ''}".rstrip()
        return "\n".join([line, *(x.tree(depth + 1) for x in node.operands)])
