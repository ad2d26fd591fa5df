"""The tile encoding: a row for each tile, dense or CSR, for products of two large matrices.

(bi, bj, nr, nc, fmt, data, indptr, indices): ``data`` row by row for a dense tile, the stored values for a CSR tile.
Tiles at the right and lower border are as small as the matrix leaves them; nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.matrix import Matrix
from tessera.plans.meta import DENSE, SPARSE

SCHEMA = "bi int, bj int, nr int, nc int, fmt string, data array<double>, indptr array<int>, indices array<int>"
NAMES = ["bi", "bj", "nr", "nc", "fmt", "data", "indptr", "indices"]
#: Cells that a task holds before it cuts tiles from them; stored cells and row starts of an output batch.
HELD_ROWS, BATCH_CELLS = 200_000, 2_000_000
#: A tile with at least this share of its cells is kept dense.
DENSITY = 0.3
#: Partial output tiles that a task adds up before it hands them on, in cells.
HELD_CELLS = 16_000_000
#: How many multiplications of BLAS one met pair of stored entries costs.
ENTRY_COST = 50


def _csr(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, nr: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((cols, rows))
    return values[order], np.searchsorted(rows[order], np.arange(nr + 1)).astype(np.int32), cols[order].astype(np.int32)


def dense(tile: pd.Series | dict) -> np.ndarray:
    nr, nc, data = tile["nr"], tile["nc"], np.asarray(tile["data"], float)
    if tile["fmt"] == "dense":
        return data.reshape(nr, nc)
    out = np.zeros((nr, nc))
    out[np.repeat(np.arange(nr), np.diff(tile["indptr"])), np.asarray(tile["indices"], int)] = data
    return out


def _at(structs: pa.StructArray, n: int) -> dict:
    """One tile of a column of tiles, its arrays without copies."""
    tile = {name: structs.field(name)[n].as_py() for name in ("nr", "nc", "fmt")}
    for name in ("data", "indptr", "indices"):
        values = structs.field(name)[n].values
        tile[name] = None if values is None else values.to_numpy(zero_copy_only=False)
    return tile


def _rows(bi: np.ndarray, bj: np.ndarray, nr: np.ndarray, nc: np.ndarray, full: np.ndarray, counts: np.ndarray, r: np.ndarray, c: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of many tiles at once: each has ``counts`` cells, in the order of tiles and, but for full (dense) ones, of rows
    and columns."""
    area = nr.astype(np.int64) * nc
    stored, starts = np.where(full, area, counts), np.where(full, 0, nr + 1)
    ends = np.cumsum(counts)
    group = np.cumsum(stored + starts) // BATCH_CELLS
    borders = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(bi)]
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        first, last = int(ends[a] - counts[a]), int(ends[b - 1])
        tile = np.repeat(np.arange(a, b), counts[a:b])
        rows, cols, dense_cell = r[first:last], c[first:last], full[tile]
        at, starts_at = np.concatenate([[0], np.cumsum(stored[a:b])]), np.concatenate([[0], np.cumsum(starts[a:b])])
        data = np.zeros(at[-1])
        place = np.arange(first, last) - (ends - counts)[tile]
        data[at[tile - a] + np.where(dense_cell, rows.astype(np.int64) * nc[tile] + cols, place)] = v[first:last]
        sparse_cell = ~dense_cell
        upto = np.cumsum(np.bincount(starts_at[tile - a][sparse_cell] + rows[sparse_cell] + 1, minlength=starts_at[-1] + 1)[: starts_at[-1]])
        before = np.concatenate([[0], np.cumsum(np.where(full[a:b], 0, counts[a:b]))])[:-1]
        indptr = upto - np.repeat(before, starts[a:b])
        list_of = lambda values, sizes, null: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values), mask=None if null is None else pa.array(null))
        columns = [pa.array(x[a:b], pa.int32()) for x in (bi, bj, nr, nc)]
        arrays = [list_of(data, stored[a:b], None), list_of(indptr.astype(np.int32), starts[a:b], full[a:b]), list_of(cols[sparse_cell].astype(np.int32), np.where(full, 0, counts)[a:b], full[a:b])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.where(full[a:b], "dense", "csr").tolist(), pa.string()), *arrays], NAMES)


def pack(matrix: Matrix, tile: tuple[int, int] | None = None) -> DataFrame:
    """Cells gathered into tiles by one shuffle on the tile's place; a tile without cells is absent. Tiles are cut from the
    sorted cells of a task many at a time, however small they are."""
    (tr, tc), (rows, cols) = tile or matrix.meta.tile, matrix.meta.shape
    fmt = matrix.meta.fmt
    cells = matrix.cells().select(F.expr(f"cast(i div {tr} as int)").alias("bi"), F.expr(f"cast(j div {tc} as int)").alias("bj"), F.expr(f"cast(i % {tr} as int)").alias("r"), F.expr(f"cast(j % {tc} as int)").alias("c"), F.col("v").cast("double").alias("v"))

    def cut(bi, bj, r, c, v) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]))
        counts = np.diff(np.append(starts, len(bi)))
        ti, tj = bi[starts], bj[starts]
        nr, nc = (np.minimum(size, n - t.astype(np.int64) * size).astype(np.int32) for size, n, t in ((tr, rows, ti), (tc, cols, tj)))
        full = np.ones(len(ti), bool) if fmt == DENSE else counts >= DENSITY * nr * nc
        yield from _rows(ti, tj, nr, nc, full, counts, r, c, v)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, enough = [], 0, HELD_ROWS
        for batch in batches:
            if batch.num_rows:
                waiting.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
                held += batch.num_rows
            if held < enough:
                continue
            whole = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            same = (whole[0] == whole[0][-1]) & (whole[1] == whole[1][-1])
            begun = int(np.argmax(same))  # the last tile may go on in the next batch
            if begun:
                yield from cut(*(x[:begun] for x in whole))
            waiting = [[x[begun:] for x in whole]]
            held -= begun
            enough = max(HELD_ROWS, 2 * held)
        if held:
            yield from cut(*(np.concatenate(x) for x in zip(*waiting, strict=True)))

    return cells.repartition("bi", "bj").sortWithinPartitions("bi", "bj", "r", "c").mapInArrow(build, SCHEMA)


def unpack(tiles: DataFrame, rows: int, cols: int, tile: tuple[int, int], fmt: str = DENSE) -> Matrix:
    """Cells of tiles, by native expressions; zeros of dense tiles are dropped where the matrix is to be sparse."""
    tr, tc = tile
    n = F.col("n")
    flat = tiles.where("fmt = 'dense'").select("bi", "bj", "nc", F.posexplode("data").alias("n", "v"))
    own = [flat.select((F.col("bi").cast("long") * tr + F.expr("n div nc")).alias("i"), (F.col("bj").cast("long") * tc + n % F.col("nc")).alias("j"), "v")]
    ends = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda r: F.struct(r.alias("r"), F.element_at("indptr", r + 1).alias("from"), F.element_at("indptr", r + 2).alias("to")))
    by_row = tiles.where("fmt = 'csr'").select("bi", "bj", "data", "indices", F.explode(ends).alias("e")).where("e.to > e.from")
    part = lambda a: F.slice(a, F.col("e.from") + 1, F.col("e.to") - F.col("e.from"))
    entries = by_row.select("bi", "bj", "e.r", F.explode(F.arrays_zip(part("indices").alias("c"), part("data").alias("v"))).alias("x"))
    own.append(entries.select((F.col("bi").cast("long") * tr + F.col("r")).alias("i"), (F.col("bj").cast("long") * tc + F.col("x.c")).alias("j"), F.col("x.v").alias("v")))
    cells = own[0].unionAll(own[1])
    return Matrix.from_cells(cells.where("v <> 0") if fmt == SPARSE else cells, rows, cols, fmt, tile=tile)


def transpose(tiles: DataFrame) -> DataFrame:
    """Tiles swapped and turned, without a shuffle."""

    def turned(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bi, bj, nr, nc = (batch.column(k).to_numpy() for k in range(4))
        full = batch.column(4).to_numpy(zero_copy_only=False) == "dense"
        counts = batch.column(5).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        v, starts, cols = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (5, 6, 7))
        tile = np.repeat(np.arange(len(bi)), counts)
        dense_cell, r, c = full[tile], np.empty(len(v), np.int64), np.empty(len(v), np.int64)
        place = np.arange(len(v)) - np.repeat(np.cumsum(counts) - counts, counts)
        r[dense_cell], c[dense_cell] = np.divmod(place[dense_cell], nc[tile][dense_cell])
        sizes = np.diff(starts, append=0)[np.diff(np.repeat(np.arange(len(bi)), np.where(full, 0, nr + 1)), append=-1) == 0]
        r[~dense_cell] = np.repeat(np.concatenate([np.arange(n) for n in nr[~full]] or [np.zeros(0, int)]), sizes)
        c[~dense_cell] = cols
        # cells are sorted by row, and stay so inside a column
        order = np.argsort(tile * (int(nc.max()) + 1) + np.where(dense_cell, 0, c), kind="stable")
        yield from _rows(bj, bi, nc, nr, full, counts, c[order], r[order], v[order])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.cumsum(batch.column(5).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) // BATCH_CELLS
            borders = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                yield from turned(batch.slice(a, b - a))

    return tiles.select(*NAMES).mapInArrow(turn, SCHEMA)


def _by_row(tile: dict, turned: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, row starts and columns of a CSR tile, or of its transpose."""
    data, indptr, indices = np.asarray(tile["data"], float), np.asarray(tile["indptr"]), np.asarray(tile["indices"])
    return _csr(indices, np.repeat(np.arange(tile["nr"]), np.diff(indptr)), data, tile["nc"]) if turned else (data, indptr, indices)


def _product(x: dict, y: dict, turn_x: bool, turn_y: bool) -> np.ndarray:
    """The product of two tiles. Two CSR tiles meet entry by entry where that is less work than BLAS on dense ones: each
    entry of x is met by the row of y that its inner place names."""
    if x["fmt"] == y["fmt"] == "csr":
        (xs, x_starts, x_cols), (ys, y_starts, y_cols) = _by_row(x, turn_x), _by_row(y, turn_y)
        n, m = len(x_starts) - 1, y["nr"] if turn_y else y["nc"]
        sizes = (y_starts[1:] - y_starts[:-1])[x_cols].astype(np.int64)
        met = int(sizes.sum())
        if met * ENTRY_COST < n * m * (len(y_starts) - 1):
            entry = np.repeat(np.arange(len(xs)), sizes)
            at = np.arange(met) - np.repeat(np.cumsum(sizes) - sizes, sizes) + y_starts[x_cols][entry]
            place = np.repeat(np.arange(n), np.diff(x_starts))[entry] * m + y_cols[at]
            return np.bincount(place, weights=xs[entry] * ys[at], minlength=n * m).astype(float).reshape(n, m)  # whole numbers, if nothing met
    a, b = dense(x), dense(y)
    return (a.T if turn_x else a) @ (b.T if turn_y else b)


def multiply(a: DataFrame, b: DataFrame, transpose_a: bool = False, transpose_b: bool = False, together: int = 1) -> DataFrame:
    """Product tiles, dense. Pairs meet in a join on the inner index, so many neighbours of which go to one task
    (``together``; sparse matrices often have a block's entries in neighbouring tiles, whose products add up there); a transposed operand is one whose places swap in
    the join and whose tiles are turned in the kernel. Each task adds up the products of its pairs by output tile
    before the shuffle; what several tasks have is added up after it."""
    left = a.select(F.col("bj" if transpose_a else "bi").alias("oi"), F.col("bi" if transpose_a else "bj").alias("k"), F.struct("nr", "nc", "fmt", "data", "indptr", "indices").alias("x"))
    right = b.select(F.col("bj" if transpose_b else "bi").alias("k"), F.col("bi" if transpose_b else "bj").alias("oj"), F.struct("nr", "nc", "fmt", "data", "indptr", "indices").alias("y"))
    if together > 1:
        # only what is equal deals rows out; the rest is a filter of pairs
        group = F.expr(f"k div {together}").alias("near")
        right = right.select(group, F.col("k").alias("l"), "oj", "y")
        pairs = left.select(group, "k", "oi", "x").join(right, "near").where(F.col("k") - F.col("l") == 0).select("oi", "oj", "x", "y")
    else:
        pairs = left.join(right, "k").select("oi", "oj", "x", "y")
    partial = "bi int, bj int, nr int, nc int, data array<double>"

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            keys = list(held)
            columns = [[k[0] for k in keys], [k[1] for k in keys], [held[k].shape[0] for k in keys], [held[k].shape[1] for k in keys]]
            out = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array([held[k].ravel() for k in keys], pa.list_(pa.float64()))], ["bi", "bj", "nr", "nc", "data"])
            held.clear()
            return out

        for batch in batches:
            for n in range(batch.num_rows):
                product = _product(_at(batch.column(2), n), _at(batch.column(3), n), transpose_a, transpose_b)
                key = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                if key in held:
                    held[key] += product
                    continue
                held[key] = product
                if sum(v.size for v in held.values()) > HELD_CELLS:
                    yield flush()
        yield flush()

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.sum([np.asarray(x) for x in pdf["data"]], axis=0)
        first = pdf.iloc[0]
        return pd.DataFrame({"bi": [key[0]], "bj": [key[1]], "nr": [first["nr"]], "nc": [first["nc"]], "fmt": ["dense"], "data": [data], "indptr": [None], "indices": [None]})

    return pairs.mapInArrow(products, partial).groupBy("bi", "bj").applyInPandas(total, SCHEMA)


def describe(tiles: DataFrame) -> DataFrame:
    """What is known of each tile: its place, size, format, stored values and bytes."""
    sizes = [F.size("data").cast("long"), F.coalesce(F.size("indptr"), F.lit(0)).cast("long"), F.coalesce(F.size("indices"), F.lit(0)).cast("long")]
    data, indptr, indices = (F.when(n >= 0, n).otherwise(F.lit(0)) for n in sizes)
    return tiles.select("bi", "bj", "nr", "nc", "fmt", data.alias("stored"), (8 * data + 4 * indptr + 4 * indices).alias("bytes"))
