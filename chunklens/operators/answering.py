"""Answering multiple-choice questions over chunks, with the whole record of how each answer came about.

A sample is a row (question_id, question, domain, chunks, choices, answer, time). Its chunks are embedded once, whatever
the number of cut-offs, and ranked inside the row; only prompts go to the model.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as TK
from ..session import ship
from . import ask as Q
from . import embedding as EM

LETTERS = ("A", "B", "C", "D")


def choices(*columns: Column) -> Column:
    """Choices by letter."""
    return F.create_map(*[x for letter, c in zip(LETTERS, columns, strict=False) for x in (F.lit(letter), c)])


def sample(df: DataFrame, chunks: Column, seconds: Column) -> DataFrame:
    """A chunked sample: all columns but ``context``, with ``chunks`` and ``time`` in place of columns of these names."""
    own = [c for c in df.columns if c not in ("context", "chunks", "time")]
    return df.select(*[F.col(f"`{c}`") for c in own], chunks.alias("chunks"), seconds.cast("double").alias("time"))


def nearest(model: EM.Model, k: int):
    """A batch function from (chunks, question) to the k most alike chunks (number, similarity), the later of equals first, and the seconds it took for a row."""

    @F.arrow_udf("struct<hits:array<struct<at:int,similarity:double>>,seconds:double>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for whole in batches:
            for lists, questions in EM.in_blocks(*whole):
                yield nearest_of(lists, questions)

    def nearest_of(lists: pa.Array, questions: pa.Array) -> pa.Array:
        began = time.perf_counter()
        asked = model.get().encode(questions)
        norm = np.sqrt((asked * asked).sum(axis=1))
        out: list[list[dict]] = []
        for size, texts in EM._blocks(lists):
            v = model.get().encode(texts)
            row = np.repeat(np.arange(len(size)) + len(out), size)
            under = np.sqrt((v * v).sum(axis=1)) * norm[row]
            score = np.divide((v * asked[row]).sum(axis=1), under, out=np.zeros(len(v)), where=under > 0)
            first = np.cumsum(size) - size
            for a, n in zip(first.tolist(), size.tolist(), strict=True):
                own = score[a : a + n]
                best = np.lexsort((-np.arange(n), -own))[:k]
                out.append([{"at": int(i), "similarity": float(own[i])} for i in best])
        each = (time.perf_counter() - began) / max(len(out), 1)
        return pa.array([{"hits": h, "seconds": each} for h in out], pa.struct([("hits", pa.list_(pa.struct([("at", pa.int32()), ("similarity", pa.float64())]))), ("seconds", pa.float64())]))

    return run


def records(
    samples: DataFrame, load: Callable[[], Q.Chat], model: EM.Model, ks: tuple[int, ...] = (5, 10), limit: int = 8192, system: str = "", reserve: int = 0, at_once: int = 8, retries: int = 2
) -> DataFrame:
    """One record for each sample and cut-off, in the fields of ``sources.readers.RESULT`` and more.

    A reply without an answer that can be read, and a call that failed, count as UNKNOWN; ``status`` tells them apart.
    Samples without chunks are asked without a context.
    """
    ship(samples.sparkSession)
    d = samples.withColumn("_n", nearest(model, max(ks))(F.coalesce("chunks", F.array().cast("array<string>")), F.coalesce("question", F.lit(""))))
    d = d.withColumn("topk", F.explode(F.array(*[F.lit(k) for k in ks])))
    hits = F.transform(F.slice("_n.hits", F.lit(1), F.col("topk")), lambda h: F.struct(F.col("chunks")[h["at"]].alias("text"), h["similarity"].alias("similarity")))
    d = d.withColumn("retrieved_chunks", hits)
    context = TK.within(F.array_join(F.transform("retrieved_chunks", lambda h: h["text"]), "\n\n"), F.col("question"), limit, system, reserve)
    d = d.withColumn("_prompt", X.prompt(F.coalesce(context, F.lit("")), F.coalesce("question", F.lit("")), F.col("choices")))
    d = Q.answers(d.drop("chunks"), "_prompt", load, at_once, retries=retries)
    answered = F.col("status") == "answered"
    got = F.when(answered, X.parse_answer(F.col("reply"))).otherwise("UNKNOWN")
    return d.select(
        "question_id", "question", F.lower("domain").alias("domain"), "topk", "retrieved_chunks", F.struct(F.coalesce("time", F.lit(0.0)).alias("chunking_time")).alias("original_chunking_stats"),
        F.struct("question_id", F.col("_n.seconds").alias("time")).alias("chunks_encoding_stats"), F.col("_prompt").alias("prompt"), F.col("reply").alias("raw_response"),
        F.to_json(F.struct(got.alias("answer"))).alias("parsed_response"), got.alias("model_answer"), F.col("answer").alias("correct_answer"), "choices",
        F.coalesce(F.upper(got) == F.upper("answer"), F.lit(False)).alias("is_correct"), "status", "tries",
    )
