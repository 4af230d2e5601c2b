"""Ranked lexical search over document shards of postings with whole-number impacts.

Documents stay where they are read: each task turns its own into shards of about ``SHARD`` terms. A shard is one row of a written
table: its sorted terms and, in compressed sparse rows, the documents of each term and the impact of the term in each, worked
out from the document's length and the corpus totals. Items are searched in blocks of about ``BLOCK`` terms: a shard adds
weight times impact, term after term, to a dense accumulator over its documents, takes its k best by ``argpartition``, and the shards'
lists are merged. Both the pass that counts in how many documents a term is and the search read only the columns they need; no list
of terms of the corpus is gathered anywhere.

Edge cases: null or empty text, or one without terms, isn't counted and not found; a null doc_id comes after all others among equal
scores; each row is a document, also where rows or ids repeat; each row of items is an item of its own; an item without
a known term has no rows; an empty table of either kind gives an empty result; other columns are ignored. A document is never split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import ship
from .common import cut, table

#: Documents returned, terms of a shard, terms of a block of items.
K, SHARD, BLOCK = 10, 2_000_000, 65_536
#: What a term consists of: digits, letters A-Z and a-z, and all that isn't ASCII. Only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEEP = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in _KEEP)


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order, with repeats."""
    return text.translate(_BYTES).split()


def postings(ids: pa.Array, words: list[list[bytes]], documents: int, length: int) -> dict:
    """A shard: postings by term, documents in order of their ids, nulls last."""
    order = pc.array_sort_indices(ids, null_placement="at_end").to_numpy()
    sizes = np.array([len(words[i]) for i in order], np.int64)
    code = pa.array([w for i in order for w in words[i]], pa.binary()).dictionary_encode()
    sort = pc.array_sort_indices(code.dictionary).to_numpy().astype(np.int64)
    rank = np.empty(len(sort), np.int64)
    rank[sort] = np.arange(len(sort))
    key, tf = np.unique(rank[code.indices.to_numpy()] * len(sizes) + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
    term, doc = np.divmod(key, len(sizes))
    m = 100 - 90 + (90 * sizes * documents) // length
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    first = np.searchsorted(term, np.arange(len(sort) + 1))
    return {"terms": code.dictionary.take(pa.array(sort)).cast(pa.string()), "first": first, "docs": doc, "impacts": impact, "ids": ids.take(pa.array(order))}


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(documents, length): documents with a term in a batch, and their terms."""
    for b in batches:
        sizes = [len(terms(t.as_py())) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, sizes))]), pa.array([sum(sizes)])], names=["documents", "length"])


def _build(documents: int, length: int, shard: int):
    """Rows (id, text) to shards; a shard is closed as soon as it has ``shard`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        words: list[list[bytes]] = []
        kind, held = None, 0

        def row() -> pa.RecordBatch:
            p = postings(pa.array(ids, kind), words, documents, length)
            number = lambda x: pa.array([x.astype(np.int32).tobytes()], pa.binary())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(p[c])], pa.int32()), p[c]) for c in ("terms", "ids")]
            return pa.RecordBatch.from_arrays([lists[0], number(p["first"]), number(p["docs"]), number(p["impacts"]), lists[1]], names=["terms", "first", "docs", "impacts", "ids"])

        for b in batches:
            kind = b.schema.field(0).type
            for i, t in zip(b.column(0), b.column(1), strict=True):
                if own := terms(t.as_py()):
                    ids.append(i.as_py())
                    words.append(own)
                    held += len(own)
                    if held >= shard:
                        yield row()
                        ids, words, held = [], [], 0
        if ids:
            yield row()

    return run


def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shard: int = SHARD) -> tuple[DataFrame, int]:
    """The written index of a corpus, and how many documents it has."""
    ship(docs.sparkSession)
    t = F.col(f"`{text}`")
    kind = dict(docs.dtypes)[doc_id]
    schema = f"terms array<string>, first binary, docs binary, impacts binary, ids array<{kind}>"
    d = docs.where(t.isNotNull()).select(F.col(f"`{doc_id}`"), t.cast("binary"))
    total = d.mapInArrow(_totals, "documents long, length long").agg(F.sum("documents"), F.sum("length")).first()
    documents, length = (x or 0 for x in total)
    return cut(d.mapInArrow(_build(documents, length or 1, shard), schema)), documents


def _found(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """For a shard and the terms asked in one row: place of each term in the shard or -1, and where the postings begin."""
    at = pc.index_in(batch.column("asked")[i].values, value_set=batch.column("terms")[i].values)
    return pc.fill_null(at, -1).to_numpy(zero_copy_only=False), np.frombuffer(batch.column("first")[i].as_py(), np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of asked terms in a shard."""
    for b in batches:
        for i in range(b.num_rows):
            at, first = _found(b, i)
            here = np.flatnonzero(at >= 0)
            df = (first[at[here] + 1] - first[at[here]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("asked")[i].values.take(pa.array(here)), pa.array(df)], names=["term", "df"])


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest positive scores; of equal ones at the edge the first places."""
    hit = np.flatnonzero(score > 0)
    if len(hit) <= k:
        return hit
    own = score[hit]
    edge = own[np.argpartition(own, len(own) - k)[len(own) - k]]
    above = hit[own > edge]
    return np.concatenate([above, hit[own == edge][: k - len(above)]])


def _search(k: int):
    """(item, doc_id, score): the k best documents of a shard for each item of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at, first = _found(b, i)
                docs, impacts = (np.frombuffer(b.column(c)[i].as_py(), np.int32) for c in ("docs", "impacts"))
                ids = b.column("ids")[i].values
                item, weight = (b.column(c)[i].values.to_numpy() for c in ("items", "weights"))
                rows: list[np.ndarray] = []
                for n in np.unique(item):
                    score = np.zeros(len(ids), np.int64)
                    for j in np.flatnonzero((item == n) & (at >= 0)):
                        own = slice(first[at[j]], first[at[j] + 1])
                        score[docs[own]] += weight[j] * impacts[own].astype(np.int64)  # a term has a document once
                    top = best(score, k)
                    rows.append(np.stack([np.full(len(top), n), top, score[top]]))
                found = np.concatenate(rows, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), ids.take(pa.array(found[1])), pa.array(found[2])], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score."""
    index, documents = build(docs, text, doc_id, shard)
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.translate(F.col(f"`{item_text}`"), UPPER, LOWER).alias("t"))
    asked = cut(asked.withColumn("item", F.monotonically_increasing_id()))
    each = asked.select("item", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(TERM), F.lit(0)))).alias("term"))
    total = each.count()
    blocks = max(1, math.ceil(total / block))
    # the asked set in blocks against every shard; which side is sent to the other is left to its size
    vocabulary = each.select("term").distinct().groupBy(F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("b")).agg(F.collect_list("term").alias("asked"))
    df = index.select("terms", "first").crossJoin(vocabulary.select("asked")).mapInArrow(_counts, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(documents)) + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    weighed = each.join(df.select("term", weight.alias("weight")), "term")
    asks = weighed.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("b")).agg(F.array_sort(F.collect_list(F.struct("item", "term", "weight"))).alias("q"))
    asks = cut(asks.select(F.col("q.item").alias("items"), F.col("q.term").alias("asked"), F.col("q.weight").alias("weights")))
    found = index.crossJoin(asks).mapInArrow(_search(k), f"item long, doc_id {dict(docs.dtypes)[doc_id]}, score long")
    w = W.Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term"
QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLES = {
    "op13_ranked_search": f"""
WITH occ AS (SELECT doc_id, {_TERMS} FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, {_TERMS} FROM benchmark),
weight AS (SELECT item_id, term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN df USING (term), total),
score AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM weight JOIN tf USING (term) JOIN len USING (doc_id), total GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM score WHERE score > 0) WHERE rank <= 10"""
}
