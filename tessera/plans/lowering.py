"""From the expression graph to one DataFrame plan over cells (i, j, v).

A product chooses its encoding by what is known of its operands:

* Xᵀ·Y of tall and narrow matrices that are there, or can be had, as one vector a row: partial sums in each task, no join
  where both are one matrix, and one of rows, not of cells, where they are two (``rowvec``)
* two large dense matrices: tiles and BLAS (``tiles``)
* over few inner places: rows meet columns, with nothing to sum after that (``matmul.multiply_narrow``)
* else a join of cells on the inner index (``matmul.multiply``)
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import aggregate, elementwise, layout, matmul, rowvec, tiles, window
from tessera.plans.matrix import Matrix
from tessera.plans.meta import DENSE, DOUBLE, INT, SQL_TYPES


#: Operators whose dense results are known by stored cells and one value for all others, where their operands are.
FILLED = ("densify", "constant", "map", "elementwise", "window")


def lower(root: Matrix) -> DataFrame:
    done: dict[int, DataFrame] = {}
    known: dict[int, tuple[DataFrame, Column] | None] = {}

    def of(x: Matrix) -> DataFrame:
        if id(x) not in done:
            own = filled(x)
            done[id(x)] = layout.fill(*own, x.meta) if own else _lower(x, of)
        return done[id(x)]

    def filled(x: Matrix) -> tuple[DataFrame, Column] | None:
        if id(x) not in known:
            known[id(x)] = _filled(x, of, filled)
        return known[id(x)]

    return of(root)


def _filled(x: Matrix, of, filled) -> tuple[DataFrame, Column] | None:
    """Of a dense matrix that is made of sparse ones, cell by cell: the cells at places that one of them has stored, and
    the value at all others, so that gaps are filled once, at the end, and never shuffled. Else None."""
    meta, p = x.meta, x.params
    if meta.fmt != DENSE or x.op not in FILLED:
        return None
    kind = SQL_TYPES[meta.dtype]
    stored = lambda m: of(m).select("i", "j", F.col("v").cast(SQL_TYPES[m.meta.dtype]).alias("v"))
    if x.op == "densify":
        return stored(x.operands[0]), F.lit(0).cast(kind)
    if x.op == "window":
        sparse, (func,) = x.operands[0], p["funcs"]
        if sparse.op != "densify" or func == "count" or math.prod(p["size"]) > window.MOST_SCATTERED:
            return None
        return window.scattered(of(sparse.operands[0]), meta, p["size"], func), F.lit(0.0)
    if p.get("op") == "div" and meta.dtype == INT:
        return None  # by the 0 of a gap that needn't be there
    own = [filled(m) if m.meta.fmt == DENSE else (stored(m), F.lit(0).cast(SQL_TYPES[m.meta.dtype])) for m in x.operands]
    if None in own:
        return None
    (cells, value), before = own[0], x.operands[0].meta
    match x.op:
        case "constant":
            return elementwise.with_constant(cells, before, p["op"], p["constant"], p["side"], meta), elementwise.constant_of(value, p["op"], p["constant"], p["side"], meta)
        case "map":
            f = lambda v: p["f"](v.cast("double")).cast(kind)
            return cells.select("i", "j", f(F.col("v")).alias("v")), f(value)
        case "elementwise":
            return elementwise.combine_filled(*own[0], *own[1], p["op"], meta)
    raise ValueError(f"unknown operator {x.op}")


def as_rows(x: Matrix) -> DataFrame | None:
    """(i, vec) where the matrix has, or keeps, that encoding without a shuffle; else None."""
    if x.meta.fmt != DENSE or x.meta.dtype != DOUBLE or x.meta.cols > rowvec.MOST_COLUMNS:
        return None
    if x.op == "rows":
        return x.params["df"]
    if x.op not in ("constant", "map", "subarray", "retile") or (own := as_rows(x.operands[0])) is None:
        return None
    p = x.params
    if x.op == "constant":
        c, right = F.lit(float(p["constant"])), p["side"] == "right"
        return own.select("i", F.transform("vec", lambda v: elementwise.apply(p["op"], *((v, c) if right else (c, v)), DOUBLE)).alias("vec"))
    if x.op == "map":
        return own.select("i", F.transform("vec", lambda v: p["f"](v).cast("double")).alias("vec"))
    if x.op == "subarray":
        (r0, r1), (c0, _) = p["rows"], p["cols"]
        return own.where(F.col("i").between(r0, r1)).select((F.col("i") - r0).alias("i"), F.slice("vec", c0 + 1, x.meta.cols).alias("vec"))
    return own


def _product(x: Matrix, of) -> DataFrame:
    a, b = x.operands
    if a.op == "transpose" and a.meta.cols >= max(a.meta.rows, b.meta.cols):
        tall = a.operands[0]
        left = as_rows(tall)
        right = left if tall is b else as_rows(b) if left is not None else None
        if right is not None:
            return rowvec.gram_frame(left) if right is left else rowvec.cross_frame(left, right)
    if a.meta.fmt == b.meta.fmt == DENSE and x.meta.dtype == DOUBLE and min(a.meta.size, b.meta.size) > matmul.BROADCAST_CELLS:
        inner = min(a.meta.tile[1], b.meta.tile[0])
        packed = tiles.pack(a, (a.meta.tile[0], inner)), tiles.pack(b, (inner, b.meta.tile[1]))
        return tiles.unpack(tiles.multiply(*packed), *x.meta.shape, (a.meta.tile[0], b.meta.tile[1])).cells()
    product = matmul.multiply_narrow if 1 <= a.meta.cols <= matmul.NARROW else matmul.multiply
    return product(of(a), a.meta, of(b), b.meta, x.meta)


def _lower(x: Matrix, of) -> DataFrame:
    meta, p = x.meta, x.params
    match x.op:
        case "rows":
            return p["df"].select("i", F.posexplode("vec").alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), "v")
        case "cells":
            return p["df"]
        case "elementwise":
            a, b = x.operands
            return elementwise.combine(of(a), a.meta, of(b), b.meta, p["op"], meta)
        case "constant":
            return elementwise.with_constant(of(x.operands[0]), x.operands[0].meta, p["op"], p["constant"], p["side"], meta)
        case "map":
            return of(x.operands[0]).select("i", "j", p["f"](F.col("v").cast("double")).cast(SQL_TYPES[meta.dtype]).alias("v"))
        case "cast":
            cells = of(x.operands[0]).select("i", "j", F.col("v").cast(SQL_TYPES[meta.dtype]).alias("v"))
            return cells if meta.fmt == DENSE else cells.where("v <> 0")
        case "map_numpy":
            return elementwise.map_numpy(of(x.operands[0]), p["f"])
        case "transpose":
            return of(x.operands[0]).select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        case "subarray":
            return layout.subarray(of(x.operands[0]), p["rows"], p["cols"], x.operands[0].meta)
        case "sparsify":
            return of(x.operands[0]).where("v <> 0")
        case "retile":
            return of(x.operands[0])
        case "cbind" | "rbind":
            a, b = x.operands
            return layout.bind(of(a), of(b), a.meta, x.op == "cbind", meta)
        case "diag":
            return of(x.operands[0]).select("i", F.col("i").alias("j"), "v").where("v <> 0")
        case "matmul":
            return _product(x, of)
        case "aggregate":
            return aggregate.cells(of(x.operands[0]), x.operands[0].meta, p["funcs"][0], p["keep"], drop_zeros=meta.fmt != DENSE)
        case "window":
            return window.table(of(x.operands[0]), p["size"], p["funcs"]).select("i", "j", F.col(p["funcs"][0]).alias("v"))
    raise ValueError(f"unknown operator {x.op}")
