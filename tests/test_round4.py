"""Findings of round 3: the whole job with bounded memory, and steps that don't follow the number of rows."""

import hashlib
import os
from collections import Counter

import numpy as np
import pyarrow as pa
from chunklens.functions import batches as BA
from chunklens.llm import bpe
from chunklens.operators import answering as AN
from chunklens.operators import embedding as EM
from chunklens.operators import etl as E
from chunklens.operators import retrieve as R
from chunklens.operators import sentences as SE
from chunklens.plans import ORACLES, QUERIES
from chunklens.streaming import evaluation as SV
from compare import same
from pyspark.sql import Row
from pyspark.sql import functions as F


def test_blocks_of_a_stream_share_micro_batches(spark, tmp_path):
    """3,000 blocks in three runs are evaluated in as many micro-batches; a block without rows has no metrics."""
    at = str(tmp_path)
    d = spark.range(1, 30_001).select(F.col("id").alias("step"), (F.col("id") % 7).cast("double").alias("value")).where("step not between 11 and 20")
    metrics = {"n": F.count("*"), "most": F.max("step")}
    for k in range(3):
        SV.deal_blocks(d.where(F.floor((F.col("step") - 1) / 10_000) == k), "step", 10, f"{at}/in/part={k}", 2500)
        source = spark.readStream.schema("step long, value double").option("recursiveFileLookup", True).parquet(f"{at}/in")
        got = SV.evaluate_blocks(source, "step", 10, metrics, f"{at}/out", f"{at}/state")
        assert got.count() == 1000 * (k + 1) - 1
    assert sorted(map(tuple, got.collect())) == [(b, 10, 10 * b + 10) for b in range(3000) if b != 1]
    assert len([n for n in os.listdir(f"{at}/state/commits") if n.isdigit()]) == 3


def test_evaluation_of_few_micro_batches(spark, sf, tmp_path):
    """The number of micro-batches doesn't follow that of blocks, and rows without an id are a block of their own."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    n = e.count()
    more = e.select("event_id", "value").crossJoin(spark.range(60)).select((F.col("event_id") + n * F.col("id")).alias("event_id"), "value")
    more.unionByName(spark.createDataFrame([(None, 1.5), (None, 2.5)], more.schema)).write.parquet(f"{tmp_path}/events.parquet")
    begun = []

    class Seen(SV.StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            begun.append(event.progress.batchId)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    watch = Seen()
    spark.streams.addListener(watch)
    try:
        same(QUERIES["evaluation_every_2000"](spark, str(tmp_path)), ORACLES["evaluation_every_2000"], str(tmp_path))
    finally:
        spark.streams.removeListener(watch)
    assert len(set(begun)) <= 4


def _docs_at(spark, texts, path):
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")


def test_halves_are_rounded_as_in_sql(spark, tmp_path):
    """Distances of neighbours such as 0.7500000025 lie half-way between two results of nine digits."""
    bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 16
    word = {bucket(x): x for x in (f"w{i}" for i in range(500))} | {(bucket(x), "end"): x for x in (f"w{i}." for i in range(500))}
    text = lambda parts: " ".join(" ".join([*[word[b] for b in p[:-1]], word[p[-1], "end"]]) for p in parts)
    # distances 0.7500000025, 0.5 and 0.7500000031: the median is the first, and as great as the last
    parts = [[0, 1, 2, 3], [0, 4, 5, 6], [4], list(range(16))]
    texts = [text(parts), text(parts[::-1])]
    _docs_at(spark, texts, tmp_path)
    for name in ("semantic_breakpoints", "semantic_chunks"):
        same(QUERIES[name](spark, str(tmp_path)), ORACLES[name], str(tmp_path))
    assert EM.rounded(np.array([0.7500000025, -0.7500000025, 0.1234567894, 0.0, 1.0]), 9).tolist() == [0.750000003, -0.750000003, 0.123456789, 0.0, 1.0]


def test_results_of_a_batch_come_in_slices(monkeypatch):
    """A batch of 400 lists gives its vectors, hits and places some rows at a time, so memory doesn't follow the batch."""
    n = 400
    lists = pa.array([[f"a b{i}", "c d", "e"] for i in range(n)], pa.list_(pa.string()))
    spans = pa.array([[{"granularity": 1, "start": s, "len": 1} for s in range(3)]] * n, pa.list_(pa.struct([("granularity", pa.int32()), ("start", pa.int32()), ("len", pa.int32())])))
    asked, questions, texts = pa.array([[1, 2]] * n, pa.list_(pa.int32())), pa.array(["a b"] * n), pa.array(["a b. c d. e. Mr. X. " * 5] * n)
    monkeypatch.setattr(EM, "BLOCK", 30)
    monkeypatch.setattr(BA, "BYTES", 1000)
    calls = [
        (EM.vectors(EM.hashed(4)), lists), (EM.gaps(EM.hashed(4)), lists), (EM.word_buckets(4), lists), (EM.pooled(EM.hashed(4)), lists, spans), (R.ranker(2), lists, spans, asked),
        (R.model_ranker(2, EM.hashed(4)), lists, spans, questions), (R.subset_ranker(2, (2, 4)), lists, spans, asked), (AN.nearest(EM.hashed(4), 2), lists, questions),
    ]
    for f, *columns in calls:
        f = getattr(f, "func", f)
        got = list(f(iter([tuple(columns) if len(columns) > 1 else columns[0]])))
        assert len(got) > 20 and sum(map(len, got)) == n and max(map(len, got)) <= 20
    assert [n for _, n in BA.slices(lists)] != [400] and sum(n for _, n in BA.slices(lists)) == sum(n for _, n in BA.slices(texts)) == 400
    assert list(BA.slices(pa.array([], pa.string()))) == [] and list(BA.slices(pa.array([None, "x" * 5000, ""]))) == [(0, 2), (2, 1)]


def test_counts_are_handed_on(monkeypatch):
    texts = [f"Word{i} goes on. Then word{i + 1} ends." for i in range(200)]
    batches = lambda: iter([pa.record_batch([pa.array(texts)], names=["text"])])
    total = lambda got: sum((Counter({tuple(r.values())[:5]: r["n"] for r in b.to_pylist()}) for b in got), Counter())
    whole = list(SE._counted(batches()))
    monkeypatch.setattr(SE, "HELD", 50)
    parts = list(SE._counted(batches()))
    assert len(whole) == 1 and len(parts) > 10 and max(map(len, parts)) < 100 and total(parts) == total(whole)


def test_bpe_reads_a_batch_some_texts_at_a_time(spark, monkeypatch):
    """A round ends before the next text is read, and lists of ids are numbers without objects of their own."""
    read = []
    monkeypatch.setattr(bpe, "ROUND_CHARS", 10)
    rounds = bpe._rounds(read.append(t) or t for t in ["abcdefgh", None, "ijkl", "m", "n" * 20, "o"])
    assert next(rounds) == ["abcdefgh", "", "ijkl"] and len(read) == 3 and list(rounds) == [["m", "n" * 20], ["o"]]
    assert bpe._numbers(["5,70000", "", "0", ""]).to_pylist() == [[5, 70000], [], [0], []] and bpe._numbers([]).to_pylist() == []
    texts = ["", None, "One two.", "x" * 700]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode_documents(spark, d, "").collect()}
    assert all(got[i]["text"] == (t or "") and len(got[i]["token_ids"]) == got[i]["n_tokens"] for i, t in enumerate(texts))


def test_a_large_group_is_no_single_task(spark, monkeypatch):
    """Facts of few groups are sent to every task; those of many are joined, with the same rows."""
    d = spark.createDataFrame([(g, i) for g in ("a", "b", None) for i in range(30, 0, -1)], "g string, i int")
    rows = lambda x: sorted(map(str, x.select("g", "i", "pos").collect()))
    few = E.in_slice(d, "g", "i")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    monkeypatch.setattr(E, "GROUPS", 2)
    many = E.in_slice(d, "g", "i")
    assert rows(few) == rows(many) == sorted(str(Row(g=g, i=i, pos=i - 1)) for g in ("a", "b", None) for i in range(1, 31))
