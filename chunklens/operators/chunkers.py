"""Chunkers that ask a model: token losses, decisions between neighbours, and any function from a text to chunks.

A document is one row, so a task holds one at a time; models come as functions and are shipped to the workers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..functions.text import joined_at, let
from ..session import ship
from .boundaries import breakpoints, fold_minima
from .embedding import Model, gaps, hashed

#: From parts to the number of tokens of each, and the loss of every token but the first of all.
LossModel = Callable[[list[str]], tuple[list[int], list[float]]]
#: Whether a chunk ends between two neighbouring parts.
Decision = Callable[[str, str], bool]


def word_lengths(parts: list[str]) -> tuple[list[int], list[float]]:
    """Default loss model: a word is a token, and its loss its length."""
    words = [p.split() for p in parts]
    return [len(w) for w in words], [float(len(x)) for w in words for x in w][1:]


def part_losses(counts: list[int], losses: list[float]) -> list[float]:
    """Mean loss of each part; the first has one loss less than tokens. Not a number for a part without losses."""
    out, at = [], 0
    for k, n in enumerate(counts):
        own = losses[at : at + n - (k == 0)]
        at += max(0, n - (k == 0))
        out.append(sum(own) / len(own) if own else float("nan"))
    return out


def loss_chunks(parts: list[str], model: LossModel = word_lengths, threshold: float = 0.5) -> list[list[str]]:
    """Parts grouped so that a chunk ends with each minimum of their mean losses."""
    ends = fold_minima([part_losses(*model(parts))], threshold, [], 1 << 62)[0][0]
    cuts = [0, *[e + 1 for e in ends], len(parts)]
    return [parts[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]


class ContextModel(Protocol):
    """A loss model that reads on from earlier tokens."""

    def tokens(self, part: str) -> list[str]: ...

    def losses(self, context: list[str], batch: list[str]) -> list[float]:
        """The loss of each token of a batch after the context."""


class WordLengths:
    """Default: a word is a token, and its loss its length, whatever stood before."""

    def tokens(self, part: str) -> list[str]:
        return part.split()

    def losses(self, context: list[str], batch: list[str]) -> list[float]:
        return [float(len(w)) for w in batch]


def batched_losses(parts: list[str], model: ContextModel, batch: int = 4096, most: int = 9000) -> tuple[list[int], list[float]]:
    """Tokens of each part, and the loss of every token but the first of all, worked out in batches of tokens.

    Batches don't mind where parts end. Each is read after the tokens before it; of these the oldest are dropped so that
    context and batch are ``most`` tokens together, so the work for a text grows with its length and no faster.
    """
    words = [model.tokens(p) for p in parts]
    flat = [w for own in words for w in own]
    losses: list[float] = []
    context: list[str] = []
    for at in range(0, len(flat), batch):
        now = flat[at : at + batch]
        context = context[max(0, len(context) + len(now) - most) :]
        losses += model.losses(context, now)
        context += now
    return [len(w) for w in words], losses[1:]


def long_loss_chunks(parts: list[str], model: ContextModel | None = None, threshold: float = 0.5, batch: int = 4096, most: int = 9000) -> list[list[str]]:
    """As ``loss_chunks`` for texts that a model can't read at once."""
    return loss_chunks(parts, lambda p: batched_losses(p, model or WordLengths(), batch, most), threshold)


def merged_chunks(chunks: list[str], target: int, words: bool = True) -> list[str]:
    """Chunks joined while they stay within ``target`` words (by blanks) or characters (without).

    It starts from an empty text: a first chunk above the target leaves it as the first result, and with words the
    first result begins with a blank.
    """
    size, joint = (lambda x: len(x.split()), " ") if words else (len, "")
    out, now, held = [], "", 0
    for c in chunks:
        n = size(c)
        if held + n <= target:
            now, held = now + joint + c, held + n
        else:
            out.append(now)
            now, held = c, n
    return [*out, now] if now else out


def words_differ(a: str, b: str) -> bool:
    """Default decision: a chunk ends where the number of words changes by eight or more."""
    return abs(len(a.split()) - len(b.split())) >= 8


def plain_sentences(text: str) -> list[str]:
    """Sentences as ``functions.text.sentences`` has them."""
    return [x for x in (p.strip(" \t\n\r\f\v") for p in re.findall(r"[^.?!]+[.?!]*", text)) if x]


def grouped(parts: list[str], decide: Decision) -> list[list[str]]:
    """Parts grouped by decisions between neighbours."""
    out = [parts[:1]] if parts else []
    for a, b in zip(parts, parts[1:], strict=False):
        if decide(a, b):
            out.append([])
        out[-1].append(b)
    return out


def out_of_memory(e: Exception) -> bool:
    """Whether an error is Python's or a device's way to say that memory is short."""
    return isinstance(e, MemoryError) or "out of memory" in str(e).lower()


def decided_chunks(parts: list[str], decide: Decision = words_differ, block: int = 4096, split: Callable[[str], list[str]] = plain_sentences, joint: str = " ") -> list[tuple[str, bool]]:
    """(chunk, lost) by decisions between neighbours.

    Where the model runs out of memory, the text is cut anew: windows of ``block`` tokens, whatever sentences they cut through, are
    split and done one by one. A window that fails again ends the work: it and all after it come out as they are, marked as lost.
    Other errors go to the caller.
    """
    try:
        return [(joint.join(c), False) for c in grouped(parts, decide)]
    except (MemoryError, RuntimeError) as e:
        if not out_of_memory(e):
            raise
        tokens = joint.join(parts).split()
    out: list[tuple[str, bool]] = []
    windows = [" ".join(tokens[at : at + block]) for at in range(0, len(tokens), block)]
    for k, w in enumerate(windows):
        try:
            out += [(joint.join(c), False) for c in grouped(split(w), decide)]
        except (MemoryError, RuntimeError) as e:
            if not out_of_memory(e):
                raise
            return out + [(x, True) for x in windows[k:]]
    return out


def clauses(text: str) -> list[str]:
    """Default propositions: what stands between marks."""
    return [c for c in (x.strip(" \t\n\r\f\v") for x in re.split(r"[,;:.?!]+", text)) if c]


def _rows(docs: DataFrame, key: str, column: str, chunker: Callable[[object], list[tuple]], added: dict[str, pa.DataType]) -> DataFrame:
    """(key, chunk, added) of a Python chunker that gives a tuple for each chunk; null gives no chunks."""
    ship(docs.sparkSession)
    names = [key, "chunk", *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(*s) for whole in batches for s in slices(whole.column(1))):
            rows = [(k, i, *c) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if v is not None for i, c in enumerate(chunker(v))]
            kinds = [b.schema.field(0).type, pa.int32(), *added.values()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    kinds = {pa.string(): "string", pa.bool_(): "boolean"}
    return docs.select(key, column).mapInArrow(run, ", ".join([f"`{key}` {dict(docs.dtypes)[key]}, chunk int", *[f"`{c}` {kinds[t]}" for c, t in added.items()]]))


def chunk_by(docs: DataFrame, key: str, column: str, chunker: Callable[[object], list[str]]) -> DataFrame:
    """(key, chunk, chunk_text) of a Python chunker over a text or an array of parts; null gives no chunks."""
    return _rows(docs, key, column, lambda v: [(c,) for c in chunker(v)], {"chunk_text": pa.string()})


def by_loss(docs: DataFrame, key: str, parts: str, model: LossModel = word_lengths, threshold: float = 0.5, joint: str = " ") -> DataFrame:
    return chunk_by(docs, key, parts, lambda p: [joint.join(c) for c in loss_chunks(p, model, threshold)])


def by_loss_of_any_length(
    docs: DataFrame, key: str, parts: str, model: ContextModel | None = None, threshold: float = 0.5, short: int = 4096, batch: int = 4096, most: int = 9000, merge: int | None = None, words: bool = True
) -> DataFrame:
    """(key, chunk, chunk_text): texts of at most ``short`` words (or characters) are read at once, longer ones in batches with carried context;
    ``merge`` joins chunks up to a size. Parts of a chunk are put together without blanks."""

    def chunks(p: list[str]) -> list[str]:
        size = sum(len(x.split()) if words else len(x) for x in p)
        # a text that is short enough is one batch without limit
        found = long_loss_chunks(p, model, threshold, batch if size > short else 1 << 62, most if size > short else 1 << 62)
        texts = ["".join(c) for c in found]
        return merged_chunks(texts, merge, words) if merge else texts

    return chunk_by(docs, key, parts, chunks)


def by_meaning(docs: DataFrame, key: str, parts: str, model: Model | None = None, percent: float = 0.5, joint: str = " ") -> DataFrame:
    """(key, chunk, chunk_text): a chunk ends where the distance to the next part is above the document's percentile of distances.

    A document that the model can't embed has no chunks, and others of its batch are not touched by that. So has one without parts.
    """
    ship(docs.sparkSession)
    d = docs.select(key, F.col(parts).alias("_p")).withColumn("_g", gaps(model or hashed(16), on_error="none")(F.coalesce("_p", F.array().cast("array<string>"))))
    cuts = lambda g: F.filter(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: F.try_element_at(g, i + 1))
    whole = let(breakpoints(F.col("_g")), lambda flags: joined_at(F.col("_p"), cuts(flags), joint))
    d = d.where(F.col("_g").isNotNull() & (F.size("_p") > 0)).select(key, F.posexplode(whole).alias("chunk", "chunk_text"))
    return d.select(key, "chunk", "chunk_text")


def by_decision(docs: DataFrame, key: str, parts: str, decide: Decision = words_differ, block: int = 4096, joint: str = " ", split: Callable[[str], list[str]] = plain_sentences) -> DataFrame:
    """(key, chunk, chunk_text, lost) by ``decided_chunks``."""
    return chunk_rows(docs, key, parts, lambda p: decided_chunks(p, decide, block, split, joint))


def chunk_rows(docs: DataFrame, key: str, column: str, chunker: Callable[[object], list[tuple[str, bool]]]) -> DataFrame:
    """(key, chunk, chunk_text, lost) of a chunker that tells what it lost; a decision with a state of its own is made anew for each row there."""
    return _rows(docs, key, column, chunker, {"chunk_text": pa.string(), "lost": pa.bool_()})
