"""Text helpers that several operators need, beside the tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.sources.shared import forget, scratch, shared_folder, small, table  # noqa: F401

#: The white space that every operator here splits and joins on, as a class for Java's, RE2's and Python's regular expressions.
SPACE = r"\x20\x09-\x0D"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def single_spaced(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(text_or_empty(text), f"[{SPACE}]+", " ")


def _give_back() -> None:
    """What Arrow and the C library hold for later goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than GNU's
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(convert: Callable[[Iterator], Iterator]):
    """A function over batches that gives spare memory back when its task ends: worker processes live on between tasks,
    and would hold it through stages that need no Python."""

    @functools.wraps(convert)
    def run(batches):
        try:
            yield from convert(batches)
        finally:
            _give_back()

    return run
