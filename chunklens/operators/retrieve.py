"""Retrieval: per-document stores, scores, deterministic top-k, re-assembly.

A store belongs to one document, so building, scoring, ranking and re-assembly are
narrow: everything happens inside the document's row, without a shuffle. Only scoring leaves
the JVM: a batch function that takes some documents of a batch at a time.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..session import ship
from .embedding import Model, buckets_of, in_blocks, pooled, rounded, unit_means
from .spans import GRANULARITIES, span_text, store_rows

BUCKETS = 64
#: Counts of the histograms that are held at once.
BLOCK = 1 << 22
GAP = "..."


def _texts(sentences: Column) -> Column:
    return F.coalesce(sentences, F.array().cast("array<string>"))


def _sizes(x: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(np.int64)


def _before(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _scores(found: pa.Array, rows: pa.Array, asked: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the store rows of all documents of a batch: number of the document, number in its store, score."""
    of_doc, of_row, inner, each = _sizes(found), _sizes(rows), found.flatten(), rows.flatten()
    words, ends = _flat(inner.flatten()), np.append(0, np.cumsum(_sizes(inner)))
    docs = np.arange(len(of_doc))
    doc = np.repeat(docs, of_row)
    start = _before(of_doc)[doc] + _flat(pc.struct_field(each, "start"))
    low = ends[start]
    n = ends[start + _flat(pc.struct_field(each, "len"))] - low
    q = np.bincount(np.repeat(docs, _sizes(asked)) * buckets + _flat(asked.flatten()), minlength=len(docs) * buckets).reshape(-1, buckets)
    score = np.zeros(len(doc))
    block = np.cumsum(n + buckets) // BLOCK
    edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(doc)).tolist()
    for i, j in zip(edges, edges[1:], strict=False):
        m = n[i:j]
        at = np.repeat(low[i:j] - _before(m), m) + np.arange(m.sum())
        h = np.bincount(np.repeat(np.arange(j - i), m) * buckets + words[at], minlength=(j - i) * buckets).reshape(-1, buckets)
        square = (h * h).sum(axis=1)
        score[i:j] = (h * q[doc[i:j]]).sum(axis=1) / np.sqrt(np.maximum(square, 1))
    return doc, np.arange(len(doc)) - _before(of_row)[doc], score


def ranker(k: int, buckets: int = BUCKETS):
    """A batch function from (sentences, store rows, buckets of the question) to each document's k best rows.

    A row's score is the dot product of the question's histogram with the normalised one of the row's words; 0
    without words. Counts are whole numbers up to the last division, so that any engine gives the same double; of
    equal scores the later row comes first. Null or empty sentences have no rows. Histograms are made for blocks of
    about ``BLOCK`` counts, whatever the lengths of the documents.
    """

    @F.arrow_udf("array<struct<score:double,row_idx:int>>")
    def best(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for whole in batches:
            for lists, rows, asked in in_blocks(*whole):
                yield hits_of(lists, rows, asked)

    def hits_of(lists: pa.Array, rows: pa.Array, asked: pa.Array) -> pa.Array:
        doc, number, score = _scores(buckets_of(lists, buckets), rows, asked, buckets)
        order = np.lexsort((-number, -score, doc))
        order = order[number < k]  # rows stay with their documents, so places in the order are numbers too
        offsets = np.append(0, np.cumsum(np.minimum(_sizes(rows), k))).astype(np.int32)
        hits = pa.StructArray.from_arrays([pa.array(score[order]), pa.array(number[order].astype(np.int32))], names=["score", "row_idx"])
        return pa.ListArray.from_arrays(pa.array(offsets), hits)

    return best


def subset_ranker(k: int, granularities: tuple[int, ...], buckets: int = BUCKETS):
    """As ``ranker``, with the k best of each set of granularities, from one pass of scores: (subset, rank, score, row_idx).

    A set is a bit mask: bit 0 for sentences, bit i for the i-th granularity; the span that stands for a short document counts as the first.
    """
    bit = {g: 2 << i for i, g in enumerate(granularities)}

    @F.arrow_udf("array<struct<subset:int,rank:int,score:double,row_idx:int>>")
    def best(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for whole in batches:
            for lists, rows, asked in in_blocks(*whole):
                yield hits_of(buckets_of(lists, buckets), rows, asked)

    def hits_of(found: pa.Array, rows: pa.Array, asked: pa.Array) -> pa.Array:
        doc, number, score = _scores(found, rows, asked, buckets)
        g, n = _flat(pc.struct_field(rows.flatten(), "granularity")), _sizes(found)[doc]
        own = np.full(len(doc), 2)
        for size, b in bit.items():
            own[g == size] = b
        own[number < n] = 1
        order = np.lexsort((-number, -score, doc))
        parts = []
        for mask in range(1, 2 << len(bit)):
            pick = order[(own[order] & mask) > 0]
            first = np.flatnonzero(np.diff(doc[pick], prepend=-1))
            rank = np.arange(len(pick)) - np.repeat(first, np.diff(np.append(first, len(pick))))
            pick, rank = pick[rank < k], rank[rank < k]
            parts.append((np.full(len(pick), mask), rank + 1, pick))
        mask, rank, pick = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((rank, mask, doc[pick]))
        mask, rank, pick = mask[by], rank[by], pick[by]
        hits = [pa.array(mask, pa.int32()), pa.array(rank, pa.int32()), pa.array(score[pick]), pa.array(number[pick], pa.int32())]
        offsets = np.append(0, np.cumsum(np.bincount(doc[pick], minlength=len(rows)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(hits, names=["subset", "rank", "score", "row_idx"]))

    return best


def ablation(docs: DataFrame, sentences: str, question: str, k: int, granularities: tuple[int, ...] = GRANULARITIES) -> DataFrame:
    """One row for each document, set of granularities and hit: the columns of ``docs`` with subset, rank, score, row_idx, start, len."""
    ship(docs.sparkSession)
    s = F.col(sentences)
    rows = store_rows(s, granularities)
    asked = F.transform(T.words(F.col(question)), lambda w: T.bucket(w, BUCKETS))
    d = docs.withColumn("_rows", rows).withColumn("_h", subset_ranker(k, granularities)(_texts(s), rows, asked))
    d = d.withColumn("_h", F.explode("_h")).withColumn("_r", F.col("_rows")[F.col("_h.row_idx")])
    return d.select(*docs.columns, "_h.subset", "_h.rank", "_h.score", "_h.row_idx", "_r.start", "_r.len")


def model_ranker(k: int, model: Model):
    """As ``ranker`` for any encoder, from (sentences, store rows, question): a row's vector is the unit mean of its sentences', the question's is as it comes.

    Scores are rounded to nine digits, so that rows that differ by the order of a sum only are equal.
    """

    @F.arrow_udf("array<struct<score:double,row_idx:int>>")
    def best(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for whole in batches:
            for lists, rows, questions in in_blocks(*whole):
                yield hits_of(lists, rows, questions)

    def hits_of(lists: pa.Array, rows: pa.Array, questions: pa.Array) -> pa.Array:
        asked, out, at = model.get().encode(questions), [], 0
        for size, count, vectors in unit_means(model.get(), lists, rows):
            first = np.cumsum(count) - count
            score = rounded((vectors * asked[np.repeat(np.arange(at, at + len(size)), count)]).sum(axis=1), 9) if len(vectors) else np.zeros(0)
            at += len(size)
            for a, n in zip(first.tolist(), count.tolist(), strict=True):
                own = score[a : a + n]
                out.append([{"score": float(own[i]), "row_idx": int(i)} for i in np.lexsort((-np.arange(n), -own))[:k]])
        return pa.array(out, pa.list_(pa.struct([("score", pa.float64()), ("row_idx", pa.int32())])))

    return best


def build_store(docs: DataFrame, key: str, sentences: str, model: Model, granularities: tuple[int, ...] = GRANULARITIES) -> DataFrame:
    """A store as rows (key, row_idx, granularity, start, len, text, embedding): vectors beside their texts, by place."""
    ship(docs.sparkSession)
    s = F.col(sentences)
    d = docs.withColumn("_rows", store_rows(s, granularities)).withColumn("_v", pooled(model)(s, F.col("_rows")))
    d = d.select(key, s.alias("_s"), F.posexplode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_v").alias("v"))).alias("row_idx", "x"))
    return d.select(key, "row_idx", "x.r.granularity", "x.r.start", "x.r.len", span_text(F.col("_s"), F.col("x.r.start"), F.col("x.r.len")).alias("text"), F.col("x.v").alias("embedding"))


def search(docs: DataFrame, sentences: str, question: str, k: int, granularities: tuple[int, ...] = GRANULARITIES, model: Model | None = None) -> DataFrame:
    """Add ``hits``: the k best rows of each document's store for its question, as (rank, score, row_idx, granularity, start, len).

    Without a model by the hashed bags of words, which need only counts.
    """
    ship(docs.sparkSession)
    s = F.col(sentences)
    rows = store_rows(s, granularities)
    if model is None:
        found = ranker(k)(_texts(s), rows, F.transform(T.words(F.col(question)), lambda w: T.bucket(w, BUCKETS)))
    else:
        found = model_ranker(k, model)(_texts(s), rows, F.coalesce(F.col(question), F.lit("")))

    def named(v: Column) -> Column:
        hit = lambda h, i: F.struct(
            (i + 1).alias("rank"), h["score"].alias("score"), h["row_idx"].alias("row_idx"), v["rows"][h["row_idx"]]["granularity"].alias("granularity"),
            v["rows"][h["row_idx"]]["start"].alias("start"), v["rows"][h["row_idx"]]["len"].alias("len"),
        )
        return F.transform(v["best"], hit)

    return docs.withColumn("hits", found).withColumn("hits", T.let(F.struct(F.col("hits").alias("best"), rows.alias("rows")), named))


def assemble(sentences: Column, ids: Column) -> Column:
    """Sentences of sorted, different numbers joined, with a gap mark where numbers aren't consecutive; empty for none."""

    def joined(v: Column) -> Column:
        gap = lambda x, i: F.when((i > 0) & (x != v["ids"][F.greatest(i - 1, F.lit(0))] + 1), F.lit(GAP)).otherwise(F.lit(""))
        return F.array_join(F.transform(v["ids"], lambda x, i: F.concat(gap(x, i), T.strip(v["s"][x]))), "")

    return T.let(F.struct(F.array_sort(F.array_distinct(ids)).alias("ids"), sentences.alias("s")), joined)


def covered(hits: Column) -> Column:
    """Sentence numbers of hits, with repeats, in order of rank."""
    return F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1)))


def retrieve(docs: DataFrame, sentences: str, question: str, k: int, mode: str = "none", model: Model | None = None) -> DataFrame:
    """Add ``hits`` and, in mode ``post``, ``context``: the hits' sentences once each, in order, with gap marks.

    Any other mode gives the plain hits, with their texts in ``texts``; one that isn't ``none`` is warned of.
    """
    if mode not in ("none", "post"):
        warnings.warn(f"unknown mode {mode}: hits are given as they are", stacklevel=2)
    d = search(docs, sentences, question, k, model=model)
    if mode == "post":
        return d.withColumn("context", assemble(F.col(sentences), covered(F.col("hits"))))
    return d.withColumn("texts", F.transform("hits", lambda h: F.array_join(F.slice(F.col(sentences), h["start"] + 1, h["len"]), " ")))


def merge_marked(texts: Column) -> Column:
    """Re-assemble marked texts: the first text of each number stays; numbers in order; gap marks; empty without markers."""
    joined = F.array_join(F.coalesce(texts, F.array().cast("array<string>")), "")
    pairs = F.arrays_zip(T.marked_ids(joined).alias("i"), T.marked_texts(joined).alias("t"))
    first = F.aggregate(
        pairs, F.array().cast("array<struct<i:int,t:string>>"),
        lambda a, p: F.when(F.exists(a, lambda x: x["i"] == p["i"]), a).otherwise(F.concat(a, F.array(F.struct(p["i"].alias("i"), p["t"].alias("t"))))),
    )

    def parts(ordered: Column) -> Column:
        gap = lambda x, k: F.when((k > 0) & (x["i"] != ordered[F.greatest(k - 1, F.lit(0))]["i"] + 1), F.lit(GAP)).otherwise(F.lit(""))
        return F.array_join(F.transform(ordered, lambda x, k: F.concat(gap(x, k), T.unmark(x["t"]))), "")

    return T.let(F.array_sort(first), parts)


def top_k(scored: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group with ``rank``; of equal scores the larger tie value comes first."""
    w = W.Window.partitionBy(group).orderBy(F.desc(score), F.desc(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def several_k(ranked: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One ranking for several cut-offs: each row once for every k that its rank is within, with ``topk``."""
    return ranked.withColumn("topk", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rank"))))


def redundancy(hits: Column) -> Column:
    """Different sentences of hits over the sum of their lengths."""
    ids = covered(hits)
    return F.when(F.size(ids) > 0, F.size(F.array_distinct(ids)) / F.size(ids))


def dispersion(hits: Column) -> Column:
    """Distance from the first to the last sentence of hits."""
    ids = covered(hits)
    return F.array_max(ids) - F.array_min(ids)


def select_covering(hits: Column, k: int) -> Column:
    """Greedy choice of k hits by score times the share of sentences not covered yet; of equals the better rank."""
    init = F.struct(F.array().cast("array<int>").alias("chosen"), F.array().cast("array<int>").alias("seen"))

    def step(a: Column, _: Column) -> Column:
        gain = F.transform(hits, lambda h: F.struct(
            F.when(F.array_contains(a["chosen"], h["rank"]), F.lit(-1.0)).otherwise(
                h["score"] * F.size(F.array_except(F.sequence(h["start"], h["start"] + h["len"] - 1), a["seen"])) / h["len"]).alias("gain"),
            (-h["rank"]).alias("order"), h["start"].alias("start"), h["len"].alias("len")))
        best = F.array_max(gain)
        grown = F.struct(F.concat(a["chosen"], F.array((-best["order"]).cast("int"))).alias("chosen"), F.array_union(a["seen"], F.sequence(best["start"], best["start"] + best["len"] - 1)).alias("seen"))
        return F.when(F.coalesce(best["gain"], F.lit(-1.0)) < 0, a).otherwise(grown)

    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), init, step, lambda a: a["chosen"])


def compare_selections(docs: DataFrame, sentences: str, k: int) -> DataFrame:
    """Two rows for each row with ``hits``: the k best scores, and k that ``select_covering`` chooses from all hits; with
    selection, chosen (ranks in order), context (their texts), covered (different sentences) and budget (sentences with repeats)."""
    by_score = F.transform(F.slice("hits", 1, k), lambda h: h["rank"])
    both = F.array(F.struct(F.lit("score").alias("selection"), by_score.alias("chosen")), F.struct(F.lit("covering").alias("selection"), select_covering(F.col("hits"), k).alias("chosen")))
    d = docs.withColumn("_x", F.explode(both)).withColumn("chosen", F.col("_x.chosen")).withColumn("_h", F.transform("_x.chosen", lambda r: F.col("hits")[r - 1]))
    texts = F.transform("_h", lambda h: span_text(F.col(sentences), h["start"], h["len"]))
    d = d.withColumn("selection", F.col("_x.selection")).withColumn("context", F.array_join(texts, "\n\n"))
    return d.withColumn("covered", F.size(F.array_distinct(covered(F.col("_h"))))).withColumn("budget", F.size(covered(F.col("_h")))).drop("_x", "_h")
