"""Shared helpers: reading tables, packing columns, sizing work by the input."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ensure_checkpoint_dir

__all__ = ["GAP", "WORD", "cut", "ensure_checkpoint_dir", "input_bytes", "pack", "table", "tidy", "tidy_groups", "tidy_pairs", "unpack", "words"]

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a group after which memory is given back.
LARGE = 1 << 18
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame, column: str) -> int:
    """Size of the input: the optimiser's estimate from file sizes, else an exact sum over the column."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 55:
        return size
    return int(df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)


def words(text):
    """Array of words of a text column; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda x: x != "")


def pack(df: DataFrame, text: str, added: list[str]) -> tuple[DataFrame, list[str]]:
    """Two columns: the text, and a struct of all other columns whose names aren't added; and the names in the struct."""
    rest = [c for c in df.columns if c != text and c not in added]
    own = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)
    return df.select(own.alias("__rest"), F.col(f"`{text}`").alias("__text")), rest


def unpack(df: DataFrame, rest: list[str], added: list[str]) -> DataFrame:
    return df.select(*[F.col(f"__rest.`{c}`") for c in rest], *[F.col(f"`{c}`") for c in added])


def give_back() -> None:
    """Return memory that this worker no longer needs to the system, so that it doesn't add to the executor's while it waits."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc only
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The batch function, giving memory back at the end of a task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidy_groups(run: Callable[..., pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The function of a group, giving memory back after a large one."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes > LARGE:
            give_back()
        return out

    return wrapped


def tidy_pairs(run: Callable[..., pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """As ``tidy_groups`` for two tables."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        if left.nbytes + right.nbytes > LARGE:
            give_back()
        return out

    return wrapped
