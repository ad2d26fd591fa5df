"""Moving windows over two dimensions of a dense matrix.

All the functions come from six values of a run of cells (number, sum, sum of squares, squares around the mean, largest,
smallest), taken along one dimension and then along the other. Runs double: the values of 2n cells join those of two runs
of n, so a window of w cells takes some log w joins a cell, and nothing is ever taken off a sum: a NaN or an infinity
stays in its windows, and large means cost no digits. Along a dimension, cells are dealt into blocks of ``BLOCK`` places, each
with a margin of cells from its neighbours, so that no window function sorts a whole row or column in one task. A small
window over a sparse matrix is taken of its stored cells alone (``scattered``).
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import aggregate
from tessera.plans.meta import Meta

BLOCK = 4096
_VALUES = ("n", "s", "q", "m", "hi", "lo")


def _joined(a: Column, b: Column) -> Column:
    """The values of two runs together; b is null where there is no cell."""
    n, m = a["n"] + b["n"], a["m"] + b["m"]
    apart = b["s"] / b["n"] - a["s"] / a["n"]
    both = F.struct(
        n.alias("n"), (a["s"] + b["s"]).alias("s"), (a["q"] + b["q"]).alias("q"), (m + apart * apart * a["n"] * b["n"] / n).alias("m"),
        F.greatest(a["hi"], b["hi"]).alias("hi"), F.least(a["lo"], b["lo"]).alias("lo"),
    )
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def _run(df: DataFrame, name: str, length: int, shift: Callable[[Column, int], Column]) -> DataFrame:
    """A column ``name``: the values of the ``length`` cells from each cell on, in the direction of ``shift``."""
    power, size, filled = "x", 1, False
    while length:
        if length & 1:
            df = df.withColumn(name, _joined(F.col(power), shift(F.col(name), size)) if filled else F.col(power))
            filled = True
        if length := length >> 1:
            wider = f"{name}{2 * size}"
            df = df.withColumn(wider, _joined(F.col(power), shift(F.col(power), size)))
            power, size = wider, 2 * size
    return df


def _along(df: DataFrame, axis: str, other: str, size: int) -> DataFrame:
    before, after = size // 2, size - 1 - size // 2
    block = max(BLOCK, 4 * size)
    # the blocks whose windows the cell is in: those of the centres at - after ... at + before
    first, last = F.expr(f"greatest({axis} - {after}, 0) div {block}"), F.expr(f"({axis} + {before}) div {block}")
    dealt = df.withColumn("block", F.explode(F.sequence(first, last)))
    cells = Window.partitionBy(other, "block").orderBy(axis)
    run = _run(dealt, "ahead", after + 1, lambda c, k: F.lead(c, k).over(cells))
    x = F.col("ahead")
    if before:
        run = _run(run, "behind", before, lambda c, k: F.lag(c, k).over(cells)).withColumn("left", F.lag("behind", 1).over(cells))
        x = _joined(x, F.col("left"))
    return run.where(F.expr(f"{axis} div {block}") == F.col("block")).select("i", "j", x.alias("x"))


def _result(func: str) -> Column:
    n, s, q, m, hi, lo = (F.col(f"x.{name}") for name in _VALUES)
    match func:
        case "count":
            return n.cast("bigint")
        case "sum":
            return s
        case "avg":
            return s / n
        case "max":
            return F.coalesce(hi, F.lit(float("-inf")))
        case "min":
            return F.coalesce(lo, F.lit(float("inf")))
        case "var":
            return m / n
        case "stdev":
            return F.sqrt(m / n)
        case "norm":
            return F.sqrt(q)
    raise ValueError(f"no window function {func}")


#: Cells of a window up to which stored cells are handed to the windows they are in; sides of the blocks that this is done in.
MOST_SCATTERED, BLOCK_ROWS, BLOCK_COLS = 64, 256, 4096


def scattered(df: DataFrame, meta: Meta, size: tuple[int, int], func: str) -> DataFrame:
    """``func``, any but count, over the windows of a sparse matrix that hold a stored cell; of all others it is 0.

    Cells are dealt into blocks with a margin, and handed to their windows after that: nothing is shuffled for a gap or a window.
    """
    sides = (("i", meta.rows, size[0], BLOCK_ROWS), ("j", meta.cols, size[1], BLOCK_COLS))
    before, after = ({k: of(w) for k, _, w, _ in sides} for of in (lambda w: w // 2, lambda w: w - 1 - w // 2))
    dealt = df.select("i", "j", F.col("v").cast("double").alias("v"))
    for k, n, _, block in sides:
        first, last = F.expr(f"greatest({k} - {after[k]}, 0) div {block}"), F.expr(f"least({k} + {before[k]}, {n - 1}) div {block}")
        dealt = dealt.withColumn(f"b{k}", F.explode(F.sequence(first, last)))
    met = dealt.repartition("bi", "bj")
    for k, n, _, block in sides:
        first = F.greatest(F.col(k) - after[k], F.col(f"b{k}") * block)
        last = F.least(F.col(k) + before[k], F.lit(n - 1), F.col(f"b{k}") * block + block - 1)
        met = met.withColumn(k, F.explode(F.sequence(first, last)))
    n = reduce(operator.mul, (F.least(F.col(k) + after[k], F.lit(m - 1)) - F.greatest(F.col(k) - before[k], F.lit(0)) + 1 for k, m, _, _ in sides))
    return met.groupBy("bi", "bj", "i", "j").agg(aggregate.of_stored(func, F.col("v"), n.cast("double"), population=True).alias("v")).select("i", "j", "v")


def table(df: DataFrame, size: tuple[int, int], funcs: tuple[str, ...]) -> DataFrame:
    """i, j and a column for each function; var and stdev are those of a population."""
    v = F.col("v").cast("double")
    real = F.when(~F.isnan(v), v)
    x = F.struct(F.lit(1.0).alias("n"), v.alias("s"), (v * v).alias("q"), F.lit(0.0).alias("m"), real.alias("hi"), real.alias("lo"))
    both = _along(_along(df.select("i", "j", x.alias("x")), "i", "j", size[0]), "j", "i", size[1])
    return both.select("i", "j", *(_result(f).alias(f) for f in funcs))
