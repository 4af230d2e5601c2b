"""Spans: runs of consecutive sentences at several granularities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRANULARITIES = (2, 4)
SPAN = "array<struct<granularity:int,start:int,len:int>>"


def _span_of(g: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(g).alias("granularity"), s.cast("int").alias("start"), F.lit(g).alias("len"))


def spans(n: Column, granularities: tuple[int, ...] = GRANULARITIES) -> Column:
    """All spans over n sentences, in order of granularity, then start, the tail last.

    Granularity g starts every max(1, g // 2) sentences; a tail span is added if the last
    start is missed; granularities above n are left out; if none fits, one span holds all.
    """
    parts = []
    for g in granularities:
        step = max(1, g // 2)
        regular = F.transform(F.sequence(F.lit(0), F.greatest(n - g, F.lit(0)), F.lit(step)), _span_of(g))
        tail = F.when((n - g) % step != 0, F.array(_span_of(g)(n - g))).otherwise(F.array().cast(SPAN))
        parts.append(F.when(n >= g, F.concat(regular, tail)).otherwise(F.array().cast(SPAN)))
    found = F.concat(*parts)
    whole = F.array(F.struct(n.cast("int").alias("granularity"), F.lit(0).alias("start"), n.cast("int").alias("len")))
    return F.when(F.size(found) > 0, found).when(n > 0, whole).otherwise(F.array().cast(SPAN))


def span_count(n: Column, granularities: tuple[int, ...] = GRANULARITIES) -> Column:
    """Number of spans in closed form."""
    total = F.lit(0)
    for g in granularities:
        step = max(1, g // 2)
        total = total + F.when(n >= g, F.floor((n - g) / step) + 1 + F.when((n - g) % step != 0, 1).otherwise(0)).otherwise(0)
    return F.when(total > 0, total).when(n > 0, 1).otherwise(0).cast("long")


def windowed_spans(n: Column, width: int, granularities: tuple[int, ...] = GRANULARITIES) -> Column:
    """Spans inside windows of ``width`` sentences, by global sentence numbers."""
    windows = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>"))
    inside = lambda w: F.transform(
        spans(F.least(F.lit(width), n - w * width).cast("int"), granularities),
        lambda s: F.struct(s["granularity"].alias("granularity"), (s["start"] + w * width).cast("int").alias("start"), s["len"].alias("len")),
    )
    return F.flatten(F.transform(windows, inside))


def span_text(sentences: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(sentences, start + 1, length), " ")


def store_rows(sentences: Column, granularities: tuple[int, ...] = GRANULARITIES) -> Column:
    """Rows of a document's store: all sentences first, then its spans, as (granularity, start, len)."""
    n = F.size(sentences)
    one = lambda i: F.struct(F.lit(1).alias("granularity"), i.cast("int").alias("start"), F.lit(1).alias("len"))
    atoms = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)).otherwise(F.array().cast(SPAN))
    return F.concat(atoms, spans(n, granularities))


def enumerate_spans(docs: DataFrame, sentences: str = "sentences", granularities: tuple[int, ...] = GRANULARITIES) -> DataFrame:
    """One row for each span of each document, numbered from 0 in store order, with its text."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in (sentences, "span_id", "granularity", "start", "len", "span_text")]
    d = docs.select(*own, F.col(sentences).alias("_s"), F.posexplode(spans(F.size(F.col(sentences)), granularities)).alias("span_id", "_p"))
    return d.select(*own, "span_id", "_p.granularity", "_p.start", "_p.len", span_text(F.col("_s"), F.col("_p.start"), F.col("_p.len")).alias("span_text"))
