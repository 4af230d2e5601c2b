"""Extension points. Models (tokenizers, embedders, judges) plug in here; the defaults are deterministic."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as X


class Chunker(Protocol):
    def chunk(self, text: Column) -> Column:
        """From text to an array of chunks."""


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text; loaded once in each Python worker."""


class TokenWindows:
    """Chunks of a fixed number of tokens."""

    def __init__(self, size: int = 256, overlap: int = 0):
        self.size, self.overlap = size, overlap

    def chunk(self, text: Column) -> Column:
        return X.token_windows(X.words(text), self.size, self.overlap)


class Sentences:
    """Chunks of one sentence."""

    def chunk(self, text: Column) -> Column:
        return X.sentences(text)


#: Chunkers by name.
METHODS: dict[str, Chunker] = {"tokens_256": TokenWindows(256), "tokens_512": TokenWindows(512), "sentences": Sentences()}


def chunk_with(docs: DataFrame, method: str, text: str = "text") -> DataFrame:
    """Add ``chunks`` by a registered method; an unknown one is an error that lists the known."""
    if method not in METHODS:
        raise KeyError(f"unknown method {method}; known: {sorted(METHODS)}")
    return docs.withColumn("chunks", METHODS[method].chunk(F.col(text)))


def embed_with(df: DataFrame, embedder: Embedder, text: str = "text", out: str = "embedding", batch: int = 256) -> DataFrame:
    """Add vectors by a model, in Arrow batches sorted by length so that a batch pads little."""
    cols = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(cols.index(text)).to_pylist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))
            found: list = [None] * len(texts)
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                for i, v in zip(pick, embedder.encode([texts[i] or "" for i in pick]), strict=True):
                    found[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.float32()))], names=[*cols, out])

    return df.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [f"`{out}` array<float>"]))
