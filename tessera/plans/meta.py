"""What is known of a matrix without looking at its cells, and the rules that carry it through operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

DENSE, SPARSE = "dense", "sparse"
INT, FLOAT, DOUBLE = "int", "float", "double"

#: Spark types of the value column.
SQL_TYPES = {INT: "bigint", FLOAT: "float", DOUBLE: "double"}


@dataclass(frozen=True)
class Meta:
    """Shape, format, value type and tile size. A dense matrix has every cell, a sparse one those that aren't 0."""

    rows: int
    cols: int
    fmt: str = DENSE
    dtype: str = DOUBLE
    tile: tuple[int, int] = (1000, 1000)

    def __post_init__(self):
        if self.rows < 0 or self.cols < 0 or min(self.tile) < 1:
            raise ValueError(f"no matrix has the shape {self.rows} x {self.cols} in tiles of {self.tile}")
        if self.fmt not in (DENSE, SPARSE) or self.dtype not in SQL_TYPES:
            raise ValueError(f"unknown format or type: {self.fmt}, {self.dtype}")

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, self.cols

    @property
    def size(self) -> int:
        return self.rows * self.cols

    def transposed(self) -> Meta:
        return replace(self, rows=self.cols, cols=self.rows, tile=self.tile[::-1])

    def but(self, **changes) -> Meta:
        return replace(self, **changes)


def result_type(a: str, b: str) -> str:
    """Equal types stay; any other pair widens to double."""
    return a if a == b else DOUBLE


def result_format(a: str, b: str) -> str:
    return SPARSE if a == b == SPARSE else DENSE
