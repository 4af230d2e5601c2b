"""Adaptive minima over a running stream, with each series' threshold in the state store.

The rules are those of ``operators.boundaries.fold_minima``; what a key carries from one micro-batch to the next is the
number of its drops and the least of them, and the last two values, so state doesn't grow with the stream. A run that stops
goes on where its checkpoint stands.

Keys are dealt to buckets by hash, and a bucket's keys share one value in the state store: reading, writing and calling the
function cost far more than the fold over a key's few rows of a micro-batch. A bucket that gets rows writes all its keys again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import boundaries
from ..operators.boundaries import drop_of

#: For each key its drops; for each row held the number of its key.
STATE = "key array<string>, drops array<int>, least array<double>, held array<int>, series array<long>, position array<long>, value array<double>"

#: Buckets of keys; a stream's checkpoint goes with their number.
BUCKETS = 1024


class AdaptiveMinima(StatefulProcessor):
    """For each key of a bucket: rows in order of (series, position) to its minima, with the threshold after each."""

    def __init__(self, start: float, history: int):
        self.start, self.history = start, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("minima", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.state.get()
        keys, drops, least, *held = map(list, kept) if kept else [[] for _ in range(7)]
        new = pd.concat(list(rows))
        number = {k: i for i, k in enumerate(keys)}
        codes, seen = pd.factorize(new["key"], use_na_sentinel=False)
        own = np.array([number.setdefault(k if isinstance(k, str) else None, len(number)) for k in seen], np.int64)[codes]
        drops += [0] * (len(number) - len(drops))
        least += [float("inf")] * (len(number) - len(least))
        fresh = [own, *(new[c].to_numpy() for c in ("series", "position", "value"))]
        of, s, p, v = (np.concatenate([np.array(h, np.float64 if k == 3 else np.int64), f]) for k, (h, f) in enumerate(zip(held, fresh, strict=True)))
        order = np.lexsort((p, s, np.arange(len(of)) >= len(held[0]), of))
        of, s, p, v = of[order], s[order], p[order], v[order]
        same = (of[1:] == of[:-1]) & (s[1:] == s[:-1])  # a row and the next
        with np.errstate(invalid="ignore"):
            left, right = v[:-2] - v[1:-1], v[2:] - v[1:-1]
        low = np.flatnonzero(same[:-1] & same[1:] & (left > 0) & (right >= 0))  # no other row can be a minimum
        at, thresholds = [], []
        for i, k, a, b in zip((low + 1).tolist(), of[low + 1].tolist(), left[low].tolist(), right[low].tolist(), strict=True):
            drop = drop_of(a, b, least[k] if drops[k] >= self.history else self.start)
            if drop is not None:
                drops[k], least[k] = min(drops[k] + 1, self.history), min(least[k], drop)
                at.append(i)
                thresholds.append(least[k] if drops[k] >= self.history else self.start)
        keys = list(number)
        keep = np.append(of[1:] != of[:-1], True)
        keep[:-1] |= keep[1:] & same  # each key's last row, and the one before in the same series
        self.state.update((keys, drops, least, *(x[keep].tolist() for x in (of, s, p, v))))
        if at:  # a frame without rows has no column of texts
            yield pd.DataFrame({"key": [keys[k] for k in of[at].tolist()], "series": s[at], "position": p[at], "threshold": thresholds})

    def close(self) -> None:
        pass


def minima_stream(rows: DataFrame, key: str, start: float, history: int = 100, buckets: int = BUCKETS) -> DataFrame:
    """(key, series, position, threshold) from a stream of (key, series, position, value).

    The rows of a key come in order over micro-batches and in any order inside one. A key is held as text, so it has to be
    of a type that is read from text again. Needs the RocksDB state store (``state_store`` sets it).
    """
    kind = dict(rows.dtypes)[key]
    d = rows.where("value is not null").select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), F.col(key).cast("string").alias("key"), "series", "position", "value").groupBy("bucket")
    # the processor is also made in a process of the driver that doesn't see shipped files, so its code goes along with it
    own = [sys.modules[__name__], boundaries]
    for m in own:
        cloudpickle.register_pickle_by_value(m)
    try:
        found = d.transformWithStateInPandas(AdaptiveMinima(start, history), "key string, series long, position long, threshold double", "Append", "None")
    finally:
        for m in own:
            cloudpickle.unregister_pickle_by_value(m)
    return found.select(F.col("key").cast(kind).alias(key), "series", "position", "threshold")


def state_store(spark) -> None:
    """Keep state in RocksDB, as ``transformWithState`` asks."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
