"""Matrices in files: Parquet with a JSON sidecar, CSV triples, dense CSV, MatrixMarket, NumPy's npy.

Text that has an order (dense CSV, MatrixMarket arrays) is numbered by the name of the file and the place in it, never
by partition numbers: Spark packs large files first. The lines of a split are counted, the counts are added up in order,
and each line takes its split's offset, so the lines themselves are not shuffled.
"""

from __future__ import annotations

import ast
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.matrix import Matrix
from tessera.plans.meta import DENSE, SPARSE, Meta
from tessera.sources.shared import delete, scratch, shared_folder, table  # noqa: F401

_SIDECAR = "_matrix.json"
#: Rows of an npy file that a task reads at a time are as many as hold so many bytes.
NPY_BYTES = 8 << 20


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def _describe(spark: SparkSession, path: str, meta: Meta, cells: str) -> None:
    """Write the sidecar; the last step of each change, by renaming, so that readers see the old state or the new one."""
    spark.createDataFrame([(json.dumps(asdict(meta) | {"cells": cells}),)], "value string").coalesce(1).write.text(new := f"{path}/_{uuid.uuid4().hex}")
    delete(spark, f"{path}/{_SIDECAR}")
    _path(spark, new)[1].rename(_path(spark, new)[0], _path(spark, f"{path}/{_SIDECAR}")[0])


def _described(spark: SparkSession, path: str) -> tuple[Meta, str]:
    known = json.loads(spark.read.text(f"{path}/{_SIDECAR}").first()[0])
    cells = known.pop("cells")
    return Meta(**{**known, "tile": tuple(known["tile"])}), f"{path}/{cells}"


def write(matrix: Matrix, path: str, band: int = 1 << 20, overwrite: bool = False) -> Matrix:
    """Store cells as Parquet sorted by place in bands of rows, so that readers prune by the files' minima and maxima;
    shape, format and tile go to a sidecar. Returns the stored matrix, whose plan starts at the files."""
    spark = matrix.cells().sparkSession
    if (was := exists(spark, f"{path}/{_SIDECAR}")) and not overwrite:
        raise ValueError(f"there is a matrix in {path}")
    before = _described(spark, path)[1] if was else None
    ordered = matrix.cells().repartitionByRange(F.expr(f"i div {band}"), "i").sortWithinPartitions("i", "j")
    ordered.write.parquet(f"{path}/{(cells := f'cells-{uuid.uuid4().hex[:12]}')}")
    _describe(spark, path, matrix.meta, cells)
    if before:
        delete(spark, before)
    return read(spark, path)


def read(spark: SparkSession, path: str) -> Matrix:
    meta, cells = _described(spark, path)
    return Matrix("cells", meta, params={"df": spark.read.parquet(cells).select("i", "j", "v")})


def compact(spark: SparkSession, path: str, files: int) -> None:
    """Rewrite a stored matrix into fewer files. The new files are whole before the sidecar names them; then the old go."""
    meta, old = _described(spark, path)
    cells = f"cells-{uuid.uuid4().hex[:12]}"
    spark.read.parquet(old).repartitionByRange(files, "i", "j").sortWithinPartitions("i", "j").write.parquet(f"{path}/{cells}")
    _describe(spark, path, meta, cells)
    delete(spark, old)


def write_tiles(packed: DataFrame, meta: Meta, path: str) -> None:
    """Store tiles sorted by place, so that the files' minima and maxima find one; shape and tile size go to a sidecar."""
    packed.repartitionByRange("bi", "bj").sortWithinPartitions("bi", "bj").write.parquet(f"{path}/tiles")
    _describe(packed.sparkSession, path, meta, "tiles")


def read_tiles(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> tuple[DataFrame, Meta]:
    """Stored tiles, all or those between places (inclusive), and what is known of the matrix."""
    meta, tiles = _described(spark, path)
    df = spark.read.parquet(tiles)
    for name, bounds in (("bi", rows), ("bj", cols)):
        if bounds:
            df = df.where(F.col(name).between(*bounds))
    return df, meta


def read_described(spark: SparkSession, path: str) -> Matrix:
    """A CSV, dense or of triples (0-based), by the JSON description in ``path``.mtd: rows, cols, nnz, sep."""
    known = json.loads("".join(r[0] for r in spark.read.text(f"{path}.mtd").collect()))
    rows, cols, sep = int(known["rows"]), int(known["cols"]), known.get("sep", ",")
    if int(known.get("nnz", rows * cols)) == rows * cols:
        return read_dense_csv(spark, path, rows, cols, sep)
    return read_triples(spark, path, rows, cols, sep)


def write_described(matrix: Matrix, path: str, sep: str = ",") -> None:
    """The CSV of a matrix, dense or of triples by its format, with its description beside it."""
    spark = matrix.cells().sparkSession
    known = {"rows": matrix.meta.rows, "cols": matrix.meta.cols, "nnz": matrix.meta.size, "sep": sep, "format": "csv"}
    if matrix.meta.fmt == DENSE:
        write_dense_csv(matrix, path, sep)
    else:
        write_triples(matrix, path, sep)
        known["nnz"] = spark.read.text(path).count()
    spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1).write.text(f"{path}.mtd")


def read_triples(spark: SparkSession, path: str, rows: int, cols: int, sep: str = ",", base: int = 0) -> Matrix:
    """Lines row, column, value in any order; places counted from ``base``."""
    df = spark.read.schema("i long, j long, v double").csv(path, sep=sep)
    return Matrix.from_cells(df.select((F.col("i") - base).alias("i"), (F.col("j") - base).alias("j"), "v").where("v <> 0"), rows, cols, SPARSE)


def write_triples(matrix: Matrix, path: str, sep: str = ",") -> None:
    matrix.cells().select("i", "j", "v").write.csv(path, sep=sep)


def read_dense_csv(spark: SparkSession, path: str, rows: int, cols: int, sep: str = ",") -> Matrix:
    """A line for each row. Of several files, those with the smaller name come first; empty lines don't count."""
    lines = _numbered(_lines(spark, path).where("value <> ''"))
    values = F.transform(F.split("value", f"\\Q{sep}\\E"), lambda x: x.cast("double"))
    return Matrix.from_rows(lines.select("i", values.alias("vec")), rows, cols)


def write_dense_csv(matrix: Matrix, path: str, sep: str = ",") -> None:
    """A line for each row, in files whose names are in the order of the rows."""
    from tessera.operators import rowvec

    lines = rowvec.from_matrix(matrix).repartitionByRange("i").sortWithinPartitions("i")
    lines.select(F.array_join(F.col("vec").cast("array<string>"), sep).alias("value")).write.text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, with the name of its file and where in the file its split starts."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _numbered(lines: DataFrame) -> DataFrame:
    """i, value: lines numbered from 0 by file, split and place in the split. A task goes through its splits one after
    another, so a line's place is how far its running number is from the first one of its split. The splits, not the
    lines, are sorted; their table is small beside the files."""
    at = lines.withColumn("at", F.monotonically_increasing_id())
    splits = at.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file", "start", (before - F.col("first")).alias("offset"))
    return at.join(offsets, ["file", "start"]).select((F.col("at") + F.col("offset")).alias("i"), "value")


def read_matrix_market(spark: SparkSession, path: str) -> Matrix:
    """Coordinate or array files, general or symmetric, real, integer or pattern. Entries at one place are added up.

    Of several files, the one with the header has the smallest name."""
    lines = _lines(spark, path).withColumn("value", F.trim("value"))
    header = lines.where(F.lower("value").startswith("%%matrixmarket")).first()
    if header is None or len(head := header["value"].lower().split()) != 5 or head[1] != "matrix":
        raise ValueError("no MatrixMarket header")
    layout, field, symmetry = head[2:5]
    told = lines.where(~F.col("value").startswith("%") & (F.col("value") != ""))
    first = told.where((F.col("file") == header["file"]) & (F.col("start") == header["start"])).withColumn("at", F.monotonically_increasing_id()).orderBy("at").first()
    sizes = [int(x) for x in first["value"].split()]
    words = F.split("value", r"\s+")
    if layout == "array":
        if symmetry != "general":
            raise ValueError(f"no {symmetry} arrays")
        place = F.col("i") - 1  # the first line is that of the sizes
        entries = _numbered(told).where("i > 0").select((place % sizes[0]).alias("i"), F.floor(place / sizes[0]).cast("long").alias("j"), F.col("value").cast("double").alias("v"))
        return Matrix.from_cells(entries, sizes[0], sizes[1], DENSE)
    value = F.lit(1.0) if field == "pattern" else words[2].cast("double")
    # the line of the sizes looks like an entry: it is told from one by its place
    body = _numbered(told).where("i > 0")
    entries = body.select((words[0].cast("long") - 1).alias("i"), (words[1].cast("long") - 1).alias("j"), value.alias("v"))
    if symmetry in ("symmetric", "skew-symmetric"):
        turned = F.col("v") if symmetry == "symmetric" else -F.col("v")
        entries = entries.unionAll(entries.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), turned.alias("v")))
    elif symmetry != "general":
        raise ValueError(f"no {symmetry} matrices")
    return Matrix.from_cells(entries.groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0"), sizes[0], sizes[1], SPARSE)


def write_matrix_market(matrix: Matrix, path: str) -> None:
    """A folder of coordinate files: the header is in the first, entries are sorted by place through all of them, so
    that the files one after another in the order of their names are one MatrixMarket file."""
    spark = matrix.cells().sparkSession
    cells = matrix.sparsify().cells()
    n = cells.count()
    head = spark.createDataFrame([(-2, 0, "%%MatrixMarket matrix coordinate real general"), (-1, 0, f"{matrix.meta.rows} {matrix.meta.cols} {n}")], "i long, j long, value string")
    lines = cells.select("i", "j", F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string")).alias("value"))
    # the rows of the header are in one range, as a range ends no earlier than a row of its own
    head.unionAll(lines).repartitionByRange(F.greatest("i", F.lit(-1)), "j").sortWithinPartitions("i", "j").select("value").write.text(path)


def read_npy(spark: SparkSession, path: str) -> Matrix:
    """A two-dimensional array in an npy file, rows in order; tasks read their rows straight from the file, which all
    executors must reach by the same name."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with where.open_input_file(name) as f:
        if f.read(6) != b"\x93NUMPY":
            raise ValueError(f"no npy file: {path}")
        version = f.read(2)[0]
        size = int.from_bytes(f.read(2 if version == 1 else 4), "little")
        told = ast.literal_eval(f.read(size).decode("latin1"))
        start = f.tell()
    kind = np.dtype(told["descr"])
    if told["fortran_order"] or len(told["shape"]) != 2 or kind.kind not in "iuf":
        raise ValueError(f"no matrix of numbers by row: {told}")
    rows, cols = told["shape"]
    width = max(1, cols * kind.itemsize)
    step = max(1, NPY_BYTES // width)
    names = pa.schema([("i", pa.int64()), ("vec", pa.list_(pa.float64()))])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, file = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        with source.open_input_file(file) as f:
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    n = min(step, rows - first)
                    f.seek(start + first * width)
                    values = np.frombuffer(f.read(n * width), kind).astype(float)
                    offsets = pa.array(np.arange(0, n * cols + 1, max(1, cols), dtype=np.int32)[: n + 1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(offsets, pa.array(values))], schema=names)

    pieces = spark.range(0, rows, step)
    return Matrix.from_rows(pieces.mapInArrow(load, "i long, vec array<double>"), rows, cols)
