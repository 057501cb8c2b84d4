"""Shared pieces: what workers keep, and small column helpers."""

from __future__ import annotations

import ctypes
import platform
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import forget, materialize, shared_dir

__all__ = ["SPACE", "chunks", "forget", "held", "kept_in_worker", "materialize", "read", "released", "shared_dir", "stack", "words"]

#: White space of the word rule, as a Java regular expression class body.
SPACE = r" \t-\r"


def released(batches: Iterator) -> Iterator:
    """``batches``, after which the worker's freed memory goes back to the system: workers live on
    between tasks, beside those of other stages."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if platform.libc_ver()[0] == "glibc":
        ctypes.CDLL(None).malloc_trim(0)


def chunks(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Places (first, end) at which ``texts`` are cut so that a part has about ``size`` bytes; a longer text is one part."""
    place = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    edge = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(texts)]
    return ((lo, hi) for lo, hi in zip(edge[:-1], edge[1:], strict=True) if lo < hi)


_slot: dict[str, object] = {}


def kept_in_worker(name: str, build: Callable[[], object]) -> object:
    """What ``build`` gives, kept between the tasks of a Python worker in its only slot, so that
    stages that follow each other in one worker do not add up."""
    if name not in _slot:
        _slot.clear()
        _slot[name] = build()
    return _slot[name]


def words(text: Column) -> Column:
    """Words between white space, as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def held(value: Column) -> Column:
    """``value`` as a column by which rows can be filtered without Catalyst moving the filter below it.

    A filter that moves through projections is written out by their expressions, once per use; over
    long chains of array functions that multiplies the work.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stack(texts) -> list[str]:
    """A pandas column of texts as a list, nulls as empty strings."""
    return [t if isinstance(t, str) else "" for t in texts]
