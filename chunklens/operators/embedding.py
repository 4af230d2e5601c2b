"""Vectors of texts, in Arrow batches, by a model that each Python worker loads once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions.vectors import EPS

#: Texts whose vectors are held at once.
BLOCK = 1 << 13


class Encoder(Protocol):
    def encode(self, texts: pa.Array) -> np.ndarray:
        """A row of numbers for each text; null counts as empty."""


class HashedBag:
    """Counts of words by bucket: the default model, the same in any engine with md5. Words are looked up once for each different one of a batch."""

    def __init__(self, buckets: int = 64):
        self.buckets = buckets

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each word the number of its text, and its bucket."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        text, word = pc.list_parent_indices(parts).to_numpy(), parts.flatten()
        keep = pc.not_equal(word, "").to_numpy(zero_copy_only=False)
        code = word.dictionary_encode()
        of = np.array([int(hashlib.md5(w.lower().encode()).hexdigest()[:4], 16) % self.buckets for w in code.dictionary.to_pylist()], np.int32)
        return text[keep], of[code.indices.to_numpy()[keep]] if len(of) else np.zeros(0, np.int32)

    def encode(self, texts: pa.Array) -> np.ndarray:
        text, bucket = self.words(texts)
        return np.bincount(text.astype(np.int64) * self.buckets + bucket, minlength=len(texts) * self.buckets).reshape(-1, self.buckets).astype(np.float64)


_loaded: dict[str, Encoder] = {}


@dataclass(frozen=True)
class Model:
    """An encoder by name; ``load`` is called once in each worker, however many batches and queries use it."""

    name: str
    load: Callable[[], Encoder]

    def get(self) -> Encoder:
        if self.name not in _loaded:
            _loaded[self.name] = self.load()
        return _loaded[self.name]


def hashed(buckets: int = 64) -> Model:
    return Model(f"hashed bag of {buckets}", lambda: HashedBag(buckets))


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(lists: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Lengths of some lists in a row and their texts, about BLOCK texts at a time."""
    size, flat = _lengths(lists), lists.flatten()
    ends = np.cumsum(size)
    edges = np.append(np.flatnonzero(np.diff((ends - size) // BLOCK, prepend=-1)), len(size)).tolist()
    for i, j in zip(edges, edges[1:], strict=False):
        first = int(ends[i] - size[i])
        yield size[i:j], flat.slice(first, int(ends[j - 1]) - first)


def in_blocks(lists: pa.Array, *others: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """The columns of a batch in slices of some rows, as ``_blocks`` cuts them."""
    at = 0
    for size, _ in _blocks(lists):
        yield tuple(c.slice(at, len(size)) for c in (lists, *others))
        at += len(size)


def _nested(size: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Lists of rows, of the sizes given."""
    width = rows.shape[1] if rows.ndim == 2 and len(rows) else 0
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), inner)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as in SQL, halves away from zero (numpy's go to the even side)."""
    scaled = x * 10.0**digits
    whole = np.trunc(scaled)
    return (whole + np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0.0)) / 10.0**digits


def unit(rows: np.ndarray, eps: float = EPS) -> np.ndarray:
    """Rows divided by their norm plus eps."""
    return rows / (np.sqrt((rows * rows).sum(axis=1, keepdims=True)) + eps)


def word_buckets(buckets: int):
    """A batch function from texts of a row to the buckets of each text's words."""

    @F.arrow_udf("array<array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            for (own,) in in_blocks(lists):
                yield buckets_of(own, buckets)

    return run


def buckets_of(lists: pa.Array, buckets: int) -> pa.Array:
    """For each list of texts the buckets of each text's words, with repeats."""
    flat = lists.flatten()
    text, bucket = HashedBag(buckets).words(flat)
    inner = np.append(0, np.cumsum(np.bincount(text, minlength=len(flat)))) if len(flat) else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(_lengths(lists))), pa.int32()), pa.ListArray.from_arrays(pa.array(inner.astype(np.int32)), pa.array(bucket)))


def vectors(model: Model):
    """A batch function from texts of a row to their unit vectors."""

    @F.arrow_udf("array<array<float>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            for size, texts in _blocks(lists):
                yield _nested(size, unit(model.get().encode(texts)).astype(np.float32)).cast(pa.list_(pa.list_(pa.float32())))

    return run


def gaps(model: Model, digits: int = 9, on_error: str = "raise"):
    """A batch function from texts of a row to the cosine distances of neighbours, rounded.

    on_error "none": where the model fails on a block of rows they are tried one by one, and those that fail alone give null.
    """

    def of(size: np.ndarray, texts: pa.Array) -> pa.Array:
        v = model.get().encode(texts)
        n = np.sqrt((v * v).sum(axis=1)) + EPS
        d = 1 - (v[:-1] * v[1:]).sum(axis=1) / (n[:-1] * n[1:])
        inner = np.ones(len(v), bool)
        inner[np.cumsum(size)[size > 0] - 1] = False  # from the last text of a row to the next row
        each = np.maximum(size - 1, 0)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(each)), pa.int32()), pa.array(rounded(d[inner[:-1]], digits)))

    def careful(size: np.ndarray, texts: pa.Array) -> pa.Array:
        try:
            return of(size, texts)
        except Exception:
            if on_error == "raise":
                raise
            if len(size) == 1:
                return pa.array([None], pa.list_(pa.float64()))
            first = np.cumsum(size) - size
            return pa.concat_arrays([careful(size[i : i + 1], texts.slice(int(first[i]), int(size[i]))) for i in range(len(size))])

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            for size, texts in _blocks(lists):
                yield careful(size, texts).cast(pa.list_(pa.float64()))

    return run


def unit_means(encoder: Encoder, lists: pa.Array, spans: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of rows (texts, spans over them): texts and spans of each row, and the unit mean vector of each span."""
    at = 0
    for size, texts in _blocks(lists):
        own = spans.slice(at, len(size))
        at += len(size)
        v, each, count = encoder.encode(texts), own.flatten(), _lengths(own)
        number = lambda c: pc.struct_field(each, c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
        n = number("len")
        first = np.repeat(np.cumsum(size) - size, count) + number("start")
        gather = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        sums = np.add.reduceat(v[gather], np.cumsum(n) - n, axis=0) if len(n) else v[:0]
        mean = sums / np.maximum(n, 1)[:, None]
        yield size, count, mean / np.maximum(np.sqrt((mean * mean).sum(axis=1, keepdims=True)), 1e-12)


def pooled(model: Model):
    """A batch function from (texts, spans over them) to unit vectors of the spans' means; a span of one text has its vector."""

    @F.arrow_udf("array<array<double>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists, spans in batches:
            for _, count, rows in unit_means(model.get(), lists, spans):
                yield _nested(count, rows).cast(pa.list_(pa.list_(pa.float64())))

    return run


def cosines():
    """A batch function from two lists of vectors to the matrix of their cosines, EPS added to norms; null without either."""

    def rows(x: pa.Scalar) -> np.ndarray:
        n, flat = len(x), x.values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(n, -1) if n else np.zeros((0, 0))

    @F.arrow_udf("array<array<double>>")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            if not x.is_valid or not y.is_valid:
                out.append(None)
                continue
            a, b = rows(x), rows(y)
            out.append((unit(a) @ unit(b).T).tolist() if len(a) and len(b) else [[]] * len(a))
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    return run
