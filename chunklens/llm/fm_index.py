"""Substring dedup over words with a compressed FM-index for each shard.

A shard holds the different runs of words around repeated anchors (see
``repeats``). Its index is the Burrows-Wheeler transform of the runs in a wavelet
matrix: one packed bit vector with block ranks for each bit of a symbol. Documents'
runs stream against it: backward search gives matching statistics, that is, how far
to the left from an end the words still occur twice, counting copies. Intervals of
at least ``WINDOW`` words are reported; where a run is not one such interval, its
other windows are searched one by one. All searches of a shard step together.

Edge cases: null or empty text has no words; fewer words than a window are kept;
equal rows are copies of each other, so both lose what they share; repeated or null
ids don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .repeats import HOT, Kind, Segments, mask_runs, repeated, split_words

#: Words of a window, words of an anchor, words that a shard's index holds.
WINDOW, GRAM, SHARD = 35, 8, 1_000_000


class WaveletMatrix:
    """Ranks of symbols in a sequence, level by level from the highest bit."""

    def __init__(self, x: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            one = ((x >> b) & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            packed = np.append(packed, np.zeros(-len(packed) % 8 + 8, np.uint8)).view(np.uint64)
            blocks = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=blocks[1:])
            self.levels.append((packed, blocks.astype(np.int32), int((~one).sum())))
            x = np.concatenate([x[~one], x[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` goes when only equal symbols before it are followed down all levels."""
        for k, (packed, blocks, zeros) in enumerate(self.levels):
            word = at >> 6
            ones = blocks[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + ones, at - ones)
        return at


def suffix_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first ``depth`` symbols, by prefix doubling."""
    n = len(x)
    rank, size = x.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - size] = rank[size:] + 1 if n > size else 0
        pair = rank * (int(rank.max()) + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(pair[order[1:]] != pair[order[:-1]])
        rank, size = new, size * 2
        if size >= depth or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Index of runs separated by a symbol of their own; ``weight`` says how often each run occurs."""

    def __init__(self, token: np.ndarray, offset: np.ndarray, weight: np.ndarray, depth: int):
        self.names, symbol = np.unique(token, return_inverse=True)
        runs = np.diff(offset)
        text = np.zeros(len(token) + len(runs), np.int64)
        at = np.arange(len(token)) + np.repeat(np.arange(len(runs)), runs)
        text[at] = symbol + 1
        times = np.zeros(len(text), np.int64)
        times[at] = np.repeat(weight, runs)
        order = suffix_order(text, depth)
        self.total = np.append(0, np.cumsum(times[order]))  # occurrences up to a place in suffix order
        bwt = text[order - 1]
        bits = max(1, int(len(self.names)).bit_length())
        self.start = np.searchsorted(np.sort(text), np.arange(len(self.names) + 2))
        self.matrix = WaveletMatrix(bwt, bits)
        self.base = self.matrix.rank(np.arange(len(self.names) + 1), np.zeros(len(self.names) + 1, np.int64))
        self.symbol = symbol + 1

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of patterns with a symbol put before them."""
        shift = self.start[symbol] - self.base[symbol]
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return both[: len(lo)] + shift, both[len(lo) :] + shift

    def matches(self, begin: np.ndarray, end: np.ndarray, least: int = 2) -> np.ndarray:
        """For spans of the indexed symbols, how far left of their ends (not past begin) they occur ``least`` times."""
        at = end.copy()
        active = np.flatnonzero(end > begin)
        lo = np.zeros(len(active), np.int64)
        hi = np.full(len(active), len(self.total) - 1)
        while len(active):
            lo, hi = self.extend(self.symbol[at[active] - 1], lo, hi)
            good = self.total[hi] - self.total[lo] >= least
            active, lo, hi = active[good], lo[good], hi[good]
            at[active] -= 1
            go = at[active] > begin[active]
            active, lo, hi = active[go], lo[go], hi[go]
        return at


def search(kind: Kind, s: Segments) -> np.ndarray:
    """Flag of every window of every run: its words occur twice in the shard."""
    fm = FMIndex(s.token, s.offset, s.number, kind.length + int(s.windows.max()))
    begin, end = s.offset[:-1], s.offset[1:]
    reach = fm.matches(begin, end)
    base = np.cumsum(s.windows) - s.windows
    flag = np.zeros(int(s.windows.sum()), bool)
    # windows at or right of where the match reaches repeat; the others are searched one by one
    left = np.minimum(reach - begin, s.windows)
    number = np.arange(len(flag)) - np.repeat(base, s.windows)
    flag[number >= np.repeat(left, s.windows)] = True
    rest = np.flatnonzero(~flag)
    first = np.repeat(begin, s.windows)[rest] + number[rest]
    flag[rest] = fm.matches(first, first + kind.length) == first
    return flag


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, emit_text: bool = True) -> DataFrame:
    """Remove words covered by windows that also start elsewhere.

    Adds n_words, n_removed, kept_sha256 and removed_spans (half-open, in words); the text is
    what is left, its words joined by a blank (left out unless emit_text).
    """

    def finish(data: bytes, mask: np.ndarray) -> dict:
        start, end = split_words(data)
        if len(start) and not mask.any():
            kept = b" ".join(data.split())  # the same six white-space bytes
        else:
            keep = np.flatnonzero(~mask)
            kept = b" ".join([data[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist(), strict=True)])
        out = {"n_words": len(start), "n_removed": int(mask.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()}
        out["removed_spans"] = [{"start": a, "end": b} for a, b in mask_runs(mask)]
        return out | ({"__kept": kept} if emit_text else {})

    schema = {"n_words": "long", "n_removed": "long", "kept_sha256": "string", "removed_spans": "array<struct<start:long,end:long>>"} | ({"__kept": "binary"} if emit_text else {})
    out = repeated(df, Kind(True, window, gram, hot), search, text, doc_id, False, SHARD, finish, schema)
    return out.withColumn(text, out["__kept"].cast("string")).drop("__kept") if emit_text else out


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated 35-word windows cover."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, emit_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLES: dict[str, str] = {}
