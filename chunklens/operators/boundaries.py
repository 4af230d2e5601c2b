"""Chunk boundaries from ordered scores, distances, budgets and judges."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as X
from ..functions.batches import slices


def is_minimum(value: Column, over: W.WindowSpec, threshold: float) -> Column:
    """Interior local minimum: below both neighbours by the threshold on one side at least, or below the left one by it and equal to the right one."""
    before, after = F.lag(value).over(over), F.lead(value).over(over)
    strict = (value < before) & (value < after) & ((before - value >= threshold) | (after - value >= threshold))
    plateau = (value < before) & (value == after) & (before - value >= threshold)
    return F.coalesce(strict | plateau, F.lit(False))


def drop_of(left: float, right: float, threshold: float) -> float | None:
    """What a minimum records, given how far its neighbours are above it: a strict one the smaller drop, a plateau the left one; None if it is none."""
    if left > 0 and (right > 0 and (left >= threshold or right >= threshold) or right == 0 and left >= threshold):
        return min(left, right) if right > 0 else left
    return None


def fold_minima(series: list[list[float]], threshold: float, drops: list[float], history: int = 100) -> tuple[list[list[int]], float, list[float]]:
    """Minima of each series in turn under a threshold that adapts; returns them with the state to go on with.

    Drops are recorded (``drop_of``), and from ``history`` of them on the threshold is the least. ``drops`` keeps no more than
    it has to: once full, its least and its number tell all.
    """
    found = []
    drops = list(drops)
    for v in series:
        own = []
        for i in range(1, len(v) - 1):
            drop = drop_of(v[i - 1] - v[i], v[i + 1] - v[i], threshold)
            if drop is not None:
                own.append(i)
                drops.append(drop)
                if len(drops) > history:
                    drops = [min(drops)] * history
            if len(drops) >= history:
                threshold = min(drops)
        found.append(own)
    return found, threshold, drops


def minima_dynamic(df: DataFrame, stream: str, series: str, position: str, value: str, start: float, history: int = 100) -> DataFrame:
    """(stream, series, position, threshold) of the minima of each series; the threshold goes on from series to series of a stream.

    A stream's rows reach one task in order, a batch at a time, and its state is ``history`` numbers, so no stream is held as a whole;
    the threshold is the one after the minimum. Series of a stream follow each other by their order values.
    """
    from ..session import ship

    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    d = df.select(stream, series, position, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    d = d.repartition(F.col(stream)).sortWithinPartitions(stream, series, position)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, window = run, []  # no stream yet
        for b in batches:
            rows = []
            for s, t, p, v in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if own != s:
                    own, threshold, drops, window = s, start, [], []
                if window and window[-1][0] != t:
                    window = []
                window = [*window[-2:], (t, p, v)]
                if len(window) == 3:
                    got, threshold, drops = fold_minima([[x[2] for x in window]], threshold, drops, history)
                    if got[0]:
                        rows.append((s, t, window[1][1], threshold))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            types = [*[b.schema.field(k).type for k in range(3)], pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=[stream, series, position, "threshold"])

    return d.mapInArrow(run, f"`{stream}` {kinds[stream]}, `{series}` {kinds[series]}, `{position}` {kinds[position]}, threshold double")


def ranges(df: DataFrame, key: str, position: str, minimum: str) -> DataFrame:
    """Add ``chunk``: a new chunk starts after each minimum."""
    w = W.Window.partitionBy(key).orderBy(position)
    d = df.withColumn("_start", F.coalesce(F.lag(F.col(minimum).cast("int")).over(w), F.lit(0)))
    return d.withColumn("chunk", F.sum("_start").over(w.rowsBetween(W.Window.unboundedPreceding, 0)).cast("int")).drop("_start")


def overlapping_ranges(df: DataFrame, key: str, position: str, minimum: str) -> DataFrame:
    """As ``ranges``, and each minimum that has a next chunk also begins that one."""
    w = W.Window.partitionBy(key).orderBy(position)
    d = ranges(df, key, position, minimum).withColumn("_more", F.lead(position).over(w).isNotNull())
    again = d.where(F.col(minimum) & F.col("_more")).withColumn("chunk", F.col("chunk") + 1)
    return d.unionByName(again).drop("_more")


def breakpoints(gaps: Column, percent: float = 0.5) -> Column:
    """Whether a chunk ends at each gap between sentences: its distance is above the document's percentile, interpolated."""

    def flags(v: Column) -> Column:
        place = (F.size(v) - 1) * percent
        low = F.floor(place).cast("int")
        at = lambda i: F.try_element_at(v, F.least(i, F.size(v)))
        limit = at(low + 1) + (at(low + 2) - at(low + 1)) * (place - low)
        return X.let(limit, lambda limit: F.transform(gaps, lambda g: g > limit))

    return F.when(F.size(gaps) > 0, X.let(F.sort_array(gaps), flags)).otherwise(F.array().cast("array<boolean>"))


def greedy_merge(sizes: Column, target: int) -> Column:
    """Group number of each part when parts join while their total stays within the target.

    It starts from an empty group: a first part above the target begins group 1 and leaves group 0 empty. A fold in a batch
    function, in time proportional to the parts.
    """

    @F.arrow_udf("array<int>")
    def run(lists: pa.Array) -> pa.Array:
        out = []
        for own in lists.to_pylist():
            total, group, groups = 0, 0, []
            for s in own or []:
                if total + s <= target:
                    total += s
                else:
                    total, group = s, group + 1
                groups.append(group)
            out.append(groups)
        return pa.array(out, pa.list_(pa.int32()))

    return run(sizes)


Judge = Callable[[list[str]], int | None]


def steepest_length_change(group: list[str]) -> int | None:
    """Default judge: the part of a group (not the first) whose length differs most from the one before; the first of equals."""
    if len(group) < 2:
        return None
    gaps = [abs(len(group[i]) - len(group[i - 1])) for i in range(1, len(group))]
    return 1 + max(range(len(gaps)), key=lambda i: (gaps[i], -i))


class Refused(Exception):
    """A judge that won't look at a group of parts."""


class Failed(Exception):
    """A judge that couldn't be asked."""


def judged_boundaries(parts: list[str], judge: Judge = steepest_length_change, budget: int = 550, tail: int = 5) -> list[int]:
    """Ends of chunks: from a pointer, parts are gathered up to a token budget, and a judge names the part where content shifts.

    Runs while the pointer is ``tail`` parts before the end. Parts are counted with the number that is shown before
    them (two words) and never gathered up to the last part of the text; the part that went over is left out unless
    it is the only one. The part that the judge names begins a chunk, and the pointer goes one past it. Without an answer
    the pointer goes past the group, by one part at least, so that it always ends. If the judge refuses the group, the pointer
    goes one part further still; if it fails, nothing more is asked. The last chunk ends with the parts.
    """
    return judged(parts, judge, budget, tail)[0]


def judged(parts: list[str], judge: Judge = steepest_length_change, budget: int = 550, tail: int = 5) -> tuple[list[int], int, bool]:
    """As ``judged_boundaries``, with the number of groups refused and whether a failed call ended the work."""
    size = [len(p.split()) + 2 for p in parts]
    at, ends, refused = 0, [], 0
    while at < len(parts) - tail:
        total = n = 0
        while total < budget and at + n < len(parts) - 1:
            total, n = total + size[at + n], n + 1
        shown = max(1, n - 1)
        try:
            answer = judge(parts[at : at + shown])
        except Refused:
            at, refused = at + max(0, n - 1) + 1, refused + 1
            continue
        except Failed:
            return [*ends, len(parts)], refused, True
        if answer is not None:
            ends.append(at + answer)
        at += shown if answer is None else answer + 1
    return [*ends, len(parts)], refused, False


def asking_judge(ask: Callable[[str], tuple[str, str]], task: str = "") -> Judge:
    """A judge that shows a model numbered parts and reads ``Answer: ID n`` from its reply.

    ask: from a prompt to (status, reply), status being answered, refused, or anything else for a failed call. A number
    that wasn't shown is no answer.
    """

    def judge(group: list[str]) -> int | None:
        status, reply = ask(task + "\nDocument:\n" + "\n".join(f"ID {i}: {p}" for i, p in enumerate(group)))
        if status == "refused":
            raise Refused
        if status != "answered":
            raise Failed(reply)
        named = re.search(r"Answer: ID \w*?(\d+)", reply)
        return int(named[1]) if named and 0 <= int(named[1]) < len(group) else None

    return judge


def judged_chunks(docs: DataFrame, key: str, parts: str, judge: Judge = steepest_length_change, budget: int = 550) -> DataFrame:
    """(key, chunk, start, chunk_text, refused, failed) by ``judged``; each document is one row, so tasks hold one at a time.

    ``refused`` is the number of groups of the document that the judge refused, ``failed`` whether a failed call left its end in one chunk.
    """
    from ..session import ship

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(*s) for whole in batches for s in slices(whole.column(1))):
            rows = []
            for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ends, refused, failed = judged(p or [], judge, budget)
                rows += [(k, i, s, "\n".join((p or [])[s:e]), refused, failed) for i, (s, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]
            types = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[key, "chunk", "start", "chunk_text", "refused", "failed"])

    return docs.select(key, parts).mapInArrow(run, f"`{key}` {kind}, chunk int, start int, chunk_text string, refused int, failed boolean")
