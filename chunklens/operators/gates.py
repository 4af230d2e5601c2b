"""Data-quality gates: coverage, schemas, vectors, audits across methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import vectors as V

CHUNKED = ("_id", "domain", "sub_domain", "difficulty", "length", "question", "choice_A", "choice_B", "choice_C", "choice_D", "answer", "chunks", "time")


def interval_union(df: DataFrame, lo: str, hi: str, *keys: str) -> DataFrame:
    """Union of half-open intervals; touching ones merge."""
    w = W.Window.partitionBy(*keys).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(W.Window.unboundedPreceding, -1))
    d = df.withColumn("_new", F.when(before.isNull() | (F.col(lo) > before), 1).otherwise(0))
    d = d.withColumn("_grp", F.sum("_new").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_grp").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_grp")


def valid_chunks(chunks: Column) -> Column:
    return F.coalesce((F.size(chunks) > 0) & F.forall(chunks, lambda x: x.isNotNull()), F.lit(False))


def has_schema(df: DataFrame, columns: tuple[str, ...] = CHUNKED) -> bool:
    return set(df.columns) == set(columns)


def vector_gate(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows (check, passed, bad) for missing vectors, wrong sizes, components that aren't finite, and norms off 1."""
    v = F.col(vector)
    bad = {
        "present": F.count_if(v.isNull()), "size": F.count_if(F.coalesce(F.size(v), F.lit(-1)) != size), "finite": F.count_if(~F.coalesce(V.finite(v), F.lit(False))),
        "unit_norm": F.count_if(F.abs(V.norm(v) - 1) > 1e-3),
    }
    one = df.agg(*[c.alias(k) for k, c in bad.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("bad")) for k in bad]))
    return one.select(rows.alias("r")).select("r.check", (F.col("r.bad") == 0).alias("passed"), "r.bad")


def coverage(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...], item: str) -> DataFrame:
    """Expected and found different items by keys, and whether all are there."""
    e = expected.groupBy(*keys).agg(F.countDistinct(item).alias("expected"))
    a = actual.groupBy(*keys).agg(F.countDistinct(item).alias("found"))
    d = e.join(a, list(keys), "full_outer").na.fill(0, ["expected", "found"])
    return d.withColumn("complete", F.col("expected") == F.col("found"))


def audit(samples: DataFrame, method: str, domain: str, item: str, chunks: str) -> DataFrame:
    """By method and domain: rows, different items, duplicates, rows with bad chunks, and items missing against all methods."""
    own = samples.groupBy(method, domain).agg(F.count("*").alias("rows"), F.countDistinct(item).alias("items"), F.count_if(~valid_chunks(F.col(chunks))).alias("bad_chunks"))
    every = samples.groupBy(domain).agg(F.countDistinct(item).alias("all_items"))
    return own.join(every, domain).select(method, domain, "rows", "items", (F.col("rows") - F.col("items")).alias("duplicates"), "bad_chunks", (F.col("all_items") - F.col("items")).alias("missing"))


def progress(samples: DataFrame, row: str, column: str, item: str, columns: list[str]) -> DataFrame:
    """Different items by row and column as a matrix; 0 where there are none."""
    return samples.groupBy(row).pivot(column, columns).agg(F.countDistinct(item)).na.fill(0, columns)


def gate_all(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
