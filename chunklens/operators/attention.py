"""Cross-attention of spans over the sentences they cover, in Arrow batches.

A span asks with the mean of its sentences; keys and values are the sentences; only those that the span covers take
part (a mask over ragged spans, not a matrix of all spans by all sentences). Weights come from the caller, so a
trained model plugs in; identity weights are the default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Covered sentences (with repeats over spans) that are held at once.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Weights:
    """Projections [in, heads * size] of queries, keys and values; None leaves vectors as they are. ``distance`` [positions, size]
    is added to keys by a sentence's place in its document, the last one for all beyond it."""

    heads: int = 1
    query: np.ndarray | None = None
    key: np.ndarray | None = None
    value: np.ndarray | None = None
    distance: np.ndarray | None = field(default=None)

    def project(self, what: str, rows: np.ndarray) -> np.ndarray:
        """Rows by head: [rows, heads, size]."""
        w = getattr(self, what)
        out = rows if w is None else rows @ w
        return out.reshape(len(out), self.heads, -1)


def attend(vectors: np.ndarray, first: np.ndarray, length: np.ndarray, place: np.ndarray, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """For spans of consecutive rows: their vectors, and the attention on each covered row (span by span, [covered, heads])."""
    if not len(first):
        return np.zeros((0, weights.project("value", vectors[:0]).shape[1] * weights.project("value", vectors[:1]).shape[2] if len(vectors) else 0)), np.zeros((0, weights.heads))
    starts = np.cumsum(length) - length
    covered = np.repeat(first - starts, length) + np.arange(length.sum())
    span = np.repeat(np.arange(len(first)), length)
    mean = np.add.reduceat(vectors[covered], starts, axis=0) / length[:, None]
    q, k, v = weights.project("query", mean), weights.project("key", vectors), weights.project("value", vectors)
    keys = k[covered]
    if weights.distance is not None:
        keys = keys + weights.distance[np.minimum(place[covered], len(weights.distance) - 1)][:, None, :]
    score = np.einsum("chs,chs->ch", q[span], keys) / np.sqrt(k.shape[2])
    score = np.exp(score - np.maximum.reduceat(score, starts, axis=0)[span])
    share = score / np.add.reduceat(score, starts, axis=0)[span]
    out = np.add.reduceat(share[:, :, None] * v[covered], starts, axis=0)
    return out.reshape(len(first), -1), share


def span_attention(weights: Weights = Weights()):  # noqa: B008
    """A batch function from (vectors of a document's sentences, its spans) to a vector for each span."""

    @F.arrow_udf("array<array<double>>")
    def run(vectors: pa.Array, spans: pa.Array) -> pa.Array:
        sizes = lambda x: pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        of_doc, of_span = sizes(vectors), sizes(spans)
        inner, each = vectors.flatten(), spans.flatten()
        number = lambda c: pc.struct_field(each, c).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(inner):
            return pa.array([[] if s is not None else None for s in spans.to_pylist()], pa.list_(pa.list_(pa.float64())))
        rows = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(inner), -1)
        begin = np.cumsum(of_doc) - of_doc
        place = np.arange(len(inner)) - np.repeat(begin, of_doc)
        first, length = np.repeat(begin, of_span) + number("start"), number("len")
        edges = np.append(np.flatnonzero(np.diff(np.cumsum(length) // BLOCK, prepend=-1)), len(first)).tolist()
        parts = [attend(rows, first[i:j], length[i:j], place, weights)[0] for i, j in zip(edges, edges[1:], strict=False)]
        out = np.concatenate(parts) if parts else np.zeros((0, 1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(of_span)), pa.int32()), lists)

    return run


def attended(vectors: Column, spans: Column, weights: Weights = Weights()) -> Column:  # noqa: B008
    return span_attention(weights)(vectors, spans)
