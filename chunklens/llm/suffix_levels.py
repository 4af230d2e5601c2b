"""Suffix-array dedup over bytes with a logarithmic family of indexes.

A bucket holds the different runs of bytes around repeated anchors (see
``repeats``), in the order of their first places. They are taken in batches: a batch
gets the sorted array of its windows' suffixes (the order of their first ``WINDOW``
bytes), is compared with itself and merge-scanned against every existing level, and
becomes a level of its own; two levels of equal rank merge into one of the next, so a
suffix is merged at most log2(batches) times. A window repeats if an equal one is in
a level or earlier in its batch.

Edge cases: null text is empty; text shorter than a window is kept whole; of equal
rows the first by doc_id stays (null ids first; rows with equal ids in a fixed
order); an empty table gives an empty result. What is left of a text may not be
UTF-8 if a window ends inside a character: ``dedup`` gives bytes, the pipeline stage
keeps whole characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import HOT, Kind, Segments, mask_runs, repeated

#: Bytes of a window and of an anchor; bytes of runs that a family of indexes holds; windows of a batch.
WINDOW, GRAM, FAMILY, BATCH = 100, 24, 1_500_000, 16_384


class Levels:
    """Sorted arrays of suffixes of one buffer; level k holds about 2 ** k batches or nothing."""

    def __init__(self, data: np.ndarray, width: int):
        # bytes go up by one, so that none is 0 and fixed-width comparison sees all of a window
        shifted = np.minimum(data, 254) + np.uint8(1)
        n = len(shifted) - width + 1
        self.window = np.ndarray((max(n, 0),), dtype=f"S{width}", buffer=shifted, strides=(1,))
        self.levels: list[np.ndarray | None] = []

    def add(self, starts: np.ndarray) -> np.ndarray:
        """Flags of new suffixes (in text order) that have an equal one earlier; then they join the family."""
        words = self.window[starts]
        order = np.argsort(words, kind="stable")
        words = words[order]
        seen = np.zeros(len(starts), bool)
        seen[1:] = words[1:] == words[:-1]
        fresh = np.flatnonzero(~seen)
        for level in self.levels:
            if level is not None and len(fresh):
                there = self.window[level]
                at = np.searchsorted(there, words[fresh])
                found = there[np.minimum(at, len(there) - 1)] == words[fresh]
                seen[fresh[found]] = True
                fresh = fresh[~found]
        carry = starts[order[fresh]]
        k = 0
        while k < len(self.levels) and self.levels[k] is not None:
            carry, self.levels[k] = self._merge(self.levels[k], carry), None
            k += 1
        if k == len(self.levels):
            self.levels.append(None)
        self.levels[k] = carry
        flag = np.empty(len(starts), bool)
        flag[order] = seen
        return flag

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Two sorted arrays as one."""
        at = np.searchsorted(self.window[a], self.window[b]) + np.arange(len(b))
        out = np.empty(len(a) + len(b), a.dtype)
        taken = np.zeros(len(out), bool)
        taken[at] = True
        out[at], out[~taken] = b, a
        return out


def scan(kind: Kind, s: Segments) -> np.ndarray:
    """Flag of every window of every run: an equal one comes before it."""
    family = Levels(s.token, kind.length)
    base = np.cumsum(s.windows) - s.windows
    start = np.repeat(s.offset[:-1] - base, s.windows) + np.arange(int(s.windows.sum()))
    flags = [family.add(start[at : at + BATCH]) for at in range(0, len(start), BATCH)]
    return np.concatenate(flags) if flags else np.zeros(0, bool)


def _finish(data: bytes, mask: np.ndarray, emit_text: bool) -> dict:
    spans = list(mask_runs(mask))
    kept = np.frombuffer(data, np.uint8)[~mask].tobytes() if spans else data
    out = {"n_bytes": len(data), "n_removed": int(mask.sum()), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest()}
    out["removed_spans"] = [{"start": a, "end": b} for a, b in spans]
    return out | ({"kept": kept} if emit_text else {})


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, emit_text: bool = True) -> DataFrame:
    """Remove bytes covered by windows that also start earlier.

    Adds n_bytes, n_removed, n_spans, kept_sha256, removed_spans (half-open, in bytes) and,
    unless emit_text is off, kept (binary); the text column goes.
    """
    schema = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "removed_spans": "array<struct<start:long,end:long>>"}
    schema |= {"kept": "binary"} if emit_text else {}
    return repeated(df, Kind(False, window, gram, hot), scan, text, doc_id, True, FAMILY, lambda b, m: _finish(b, m, emit_text), schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that earlier 100-byte strings cover."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, emit_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document without the characters of which a byte was removed; n_chars follows the new text."""

    def finish(data: bytes, mask: np.ndarray) -> dict:
        if mask.any():
            x = np.frombuffer(data, np.uint8)
            first = np.flatnonzero((x & 0xC0) != 0x80)
            if len(first):
                mask = np.repeat(np.logical_or.reduceat(mask, first), np.diff(np.append(first, len(x)))) if first[0] == 0 else mask
            data = x[~mask].tobytes()
        return {"__kept": data}

    order = docs.columns
    had_null = docs.withColumn("__null", F.col("text").isNull())
    out = repeated(had_null, Kind(False, WINDOW, GRAM), scan, "text", "doc_id", True, FAMILY, finish, {"__kept": "binary"})
    out = out.withColumn("text", F.when(~F.col("__null"), F.col("__kept").cast("string")))
    if "n_chars" in order:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in order])


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLES: dict[str, str] = {}
