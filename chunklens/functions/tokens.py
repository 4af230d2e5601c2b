"""Tokens of any tokenizer in batches: encoding, decoding, and cutting texts to a budget."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


def encoded(load: Callable[[], Tokenizer]):
    """A batch function from texts to token ids; null stays null."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        t = load()
        return pa.array([None if x is None else t.encode(x) for x in texts.to_pylist()], pa.list_(pa.int32()))

    return run


def decoded(load: Callable[[], Tokenizer]):
    """A batch function from token ids to texts."""

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        t = load()
        return pa.array([None if x is None else t.decode(x) for x in ids.to_pylist()], pa.string())

    return run


def budget(limit: int, question: Column, system: str = "", reserve: int = 0) -> Column:
    """Tokens (words) that are left for the context when the system's and the question's and a reserve are taken off."""
    return F.lit(limit - len(system.split()) - reserve) - X.word_count(question)


def within(context: Column, question: Column, limit: int, system: str = "", reserve: int = 0) -> Column:
    """The context as it is if it fits the budget, else its first tokens; none if the budget is used up."""
    return X.truncate_tokens(context, budget(limit, question, system, reserve))
