"""Golden cases and laws of operators, against plain Python."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from chunklens.functions import text as X
from chunklens.functions import vectors as V
from chunklens.operators import boundaries as B
from chunklens.operators import etl as E
from chunklens.operators import gates as G
from chunklens.operators import retrieve as R
from chunklens.operators import spans as S


def one(spark, col, **values):
    return spark.createDataFrame([Row(**(values or {"_": 1}))]).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("n,count", [(1, 1), (2, 1), (3, 2), (4, 4), (5, 6), (117, 174), (124, 184), (179, 267)])
def test_span_counts(spark, n, count):
    assert one(spark, S.span_count(F.lit(n))) == count
    found = one(spark, S.spans(F.lit(n)))
    assert len(found) == count
    if n >= 2:
        assert {i for s in found for i in range(s["start"], s["start"] + s["len"])} == set(range(n))


def test_span_order_and_fallback(spark):
    assert [(s["granularity"], s["start"]) for s in one(spark, S.spans(F.lit(5)))] == [(2, 0), (2, 1), (2, 2), (2, 3), (4, 0), (4, 1)]
    assert [tuple(s) for s in one(spark, S.spans(F.lit(3), (4,)))] == [(3, 0, 3)]
    assert one(spark, S.spans(F.lit(0))) == []


def test_minima_and_ranges(spark):
    from pyspark.sql import window as W

    d = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([3, 1, 3, 2, 2, 5])], "k int, pos int, v double")
    d = d.withColumn("m", B.is_minimum(F.col("v"), W.Window.partitionBy("k").orderBy("pos"), 0.5))
    assert [r["pos"] for r in d.where("m").collect()] == [1, 3]
    groups = lambda x: sorted({c: sorted(r["pos"] for r in x if r["chunk"] == c) for c in {r["chunk"] for r in x}}.values())
    assert groups(B.ranges(d, "k", "pos", "m").collect()) == [[0, 1], [2, 3], [4, 5]]
    assert groups(B.overlapping_ranges(d, "k", "pos", "m").collect()) == [[0, 1], [1, 2, 3], [3, 4, 5]]


def plain_minima(v, t, drops, history):
    drops, out = list(drops), []
    for i in range(1, len(v) - 1):
        a, b = v[i - 1] - v[i], v[i + 1] - v[i]
        if a > 0 and b > 0 and (a >= t or b >= t):
            drops.append(min(a, b))
            out.append(i)
        elif a > 0 and b == 0 and a >= t:
            drops.append(a)
            out.append(i)
        if len(drops) >= history:
            t = min(drops)
    return out, t, drops


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=20), max_size=4))
def test_adaptive_minima(series):
    """Folded over series in turn, the state equals that of a plain loop that keeps every drop."""
    series = [[float(x) for x in v] for v in series]
    got, threshold, drops = B.fold_minima(series, 2.0, [], 3)
    t, every = 2.0, []
    for v, own in zip(series, got, strict=True):
        want, t, every = plain_minima(v, t, every, 3)
        assert own == want
    assert threshold == t and min(drops, default=None) == min(every, default=None)


def test_adaptive_minima_carried(spark):
    values = [[5, 1, 5, 4, 5], [5, 1, 5], [3, 2, 3, 1, 3]]
    rows = [(u, k, i, float(x)) for u in ("a", "b", None) for k, v in enumerate(values) for i, x in enumerate(v)]
    d = spark.createDataFrame([*rows, ("a", 9, 0, None)], "u string, k int, i int, x double")
    want = {(k, i) for k, own in enumerate(B.fold_minima([[float(x) for x in v] for v in values], 2.0, [], 2)[0]) for i in own}
    got = B.minima_dynamic(d, "u", "k", "i", "x", 2.0, 2).collect()
    for u in ("a", "b", None):
        assert {(r["k"], r["i"]) for r in got if r["u"] == u} == want


def test_greedy_merge(spark):
    assert one(spark, B.greedy_merge(F.array(*map(F.lit, [150, 60, 40])), 200)) == [0, 1, 1]
    assert one(spark, B.greedy_merge(F.array(F.lit(250)), 200)) == [1]


def test_token_windows(spark):
    t = " ".join(map(str, range(10)))
    got = one(spark, X.token_windows(X.words(F.lit(t)), 4, 1))
    assert [w.split()[0] for w in got] == ["0", "3", "6", "9"]
    assert one(spark, X.token_windows(X.words(F.lit("")), 4)) == []


def test_interval_union(spark):
    d = spark.createDataFrame([(0, 5), (5, 8), (10, 12)], "lo int, hi int")
    got = sorted(map(tuple, G.interval_union(d, "lo", "hi").select("lo", "hi").collect()))
    assert got == [(0, 8), (10, 12)]


def test_packing_and_shards(spark):
    d = E.numbered(spark.range(10).withColumnRenamed("id", "i"), "i").withColumn("s", E.contiguous(F.col("pos"), F.lit(10), 4))
    assert [r["c"] for r in d.groupBy("s").agg(F.count("*").alias("c")).orderBy("s").collect()] == [3, 3, 3, 1]
    assert one(spark, E.spare_split(F.array(F.lit(10.0), F.lit(30.0)), 2)) == [1, 3]


def test_numbered_loses_nothing(spark, tmp_path):
    """Positions of a million rows with other columns, written and read again, are 0 to n - 1 in order."""
    n = 1_000_000
    d = spark.range(n).select(F.xxhash64("id").alias("k"), F.col("id").cast("string").alias("a"), (F.col("id") % 7).alias("b"))
    E.numbered(d, "k").write.parquet(f"{tmp_path}/n")
    got = spark.read.parquet(f"{tmp_path}/n")
    r = got.agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.countDistinct("a").alias("a")).first()
    assert tuple(r) == (n, n, 0, n - 1, n)
    q = spark.read.parquet(f"{tmp_path}/n").where("pos < 50").orderBy("pos").collect()
    assert [x["k"] for x in q] == sorted(x["k"] for x in q) and q[0]["k"] == d.agg(F.min("k")).first()[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 5))
def test_packing_by_runs(sizes, bins):
    """Runs of equal sizes give the loads of one row after another."""
    import pandas as pd

    load, rows = [0] * bins, [0] * bins
    for s in sorted(sizes, reverse=True):
        b = load.index(min(load))
        load[b], rows[b] = load[b] + s, rows[b] + 1
    runs = pd.Series(sizes).value_counts()
    got = E._pack_runs(pd.DataFrame({"g": "x", "_s": runs.index, "_n": runs.values}), "g", bins)
    assert {(r.bin, r.load, r.n) for r in got.itertuples()} == {(b, v, n) for b, (v, n) in enumerate(zip(load, rows, strict=True)) if n}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=60))
def test_batches_by_runs(lengths):
    import pandas as pd

    n = batch = 0
    want = []
    for x in sorted(lengths):
        if n and (n >= 4 or (n + 1) * x * x > 300):
            n, batch = 0, batch + 1
        n += 1
        want.append(batch)
    runs = pd.Series(sorted(lengths)).value_counts().sort_index()
    p = pd.DataFrame({"g": "x", "x": runs.index, "_at": runs.cumsum().values - runs.values, "_n": runs.values})
    f = E._fill(p, "x", 4, 300)
    got = [b + (h + j) // cap for h, cap, b, c in zip(f["_held"], f["_cap"], f["_batch"], runs.values, strict=True) for j in range(c)]
    assert got == want


def marked(lines, ids):
    return "".join(f"【Begin-{i}】{lines[i]}【End-{i}】" for i in ids)


@pytest.mark.parametrize("parts,gaps", [
    ([[0, 1, 2]], []), ([[4, 5], [0, 1]], [4]), ([[7], [3, 4, 5], [4, 5], [0]], [3, 7]), ([[2, 3], [3, 4], [2]], []), ([], []),
])
def test_merge_marked(spark, parts, gaps):
    """Texts of several hits, out of order and overlapping, come out once each, with a mark where numbers are missing."""
    lines = ["Rain fell at noon. ", "Who heard the bell?", "Nine boats left, two came back.", "Ask the miller.", "It was cheaper by rail!", "Oats: 40 sacks.", "(unsigned)", "The end of the ledger."]
    ids = sorted({i for p in parts for i in p})
    want = "".join(("..." if i in gaps else "") + lines[i].strip() for i in ids)
    got = one(spark, R.merge_marked(F.col("m")), m=[marked(lines, p) for p in parts], z=1) if parts else one(spark, R.merge_marked(F.array().cast("array<string>")))
    assert got == want


def test_merge_unmarked(spark):
    assert one(spark, R.merge_marked(F.col("m")), m=["a page that was never cut"]) == ""


def test_answers(spark):
    assert one(spark, X.parse_answer(F.lit('noise {"answer":"b"} tail'))) == "b"
    assert one(spark, X.parse_answer(F.lit("{}"))) == "UNKNOWN"
    assert one(spark, X.parse_answer(F.lit("{'answer': 'C',}"))) == "C"
    assert one(spark, X.parse_answer(F.lit(r"{'answer': 'don\'t',}"))) == "don't"
    assert one(spark, X.parse_answer(F.lit("I say {answer: 'D', why: [1, 2,],} so"))) == "D"
    assert one(spark, X.answer_number(F.lit("Answer: ID 17 because"))) == 17
    assert one(spark, X.strip_number(F.lit("ID 3: text"))) == "text"


def test_file_facts(spark):
    f = one(spark, X.file_facts(F.lit("raw_traditional_256_shard3_rep1_20250102_030405.jsonl")))
    assert (f["method"], f["size"], f["shard"], f["rep"]) == ("traditional", 256, 3, 1)
    f = one(spark, X.file_facts(F.lit("raw_bge-m3_shard0_rep2_20250102_030405.jsonl")))
    assert (f["method"], f["size"], f["rep"]) == ("bge-m3", None, 2)
    assert one(spark, X.file_facts(F.lit("raw_method_2_shard0_rep1_20250102_030405.jsonl")))["method"] == "method_2"
    assert one(spark, X.file_facts(F.lit("other.txt"))) is None


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.norm(v)) == 5.0
    assert abs(one(spark, V.cosine(v, v)) - 1) < 1e-6
    assert one(spark, V.pad(v, 3)) == [3.0, 4.0, 0.0]
    assert one(spark, V.pool(F.array(v, v), "mean")) == [3.0, 4.0]


def test_upper_median(spark):
    from chunklens.operators.evaluate import length_profile

    assert one(spark, length_profile(F.array(*map(F.lit, [1, 2, 3, 4])), (2,)))["upper_median"] == 3


def test_judged_boundaries():
    parts = ["w " * 100] * 20
    ends = B.judged_boundaries(parts, lambda g: len(g) - 1, 550)
    assert ends == [4, 9, 14, 20]  # five parts are shown, the sixth went over; the pointer goes past the answer
    assert B.judged_boundaries(["w " * 600] * 8, lambda g: None, 550) == [8]
    assert B.judged_boundaries([], lambda g: 0) == [0] and B.judged_boundaries(["a"] * 5, lambda g: 0) == [5]


def test_sources_and_sinks(spark, tmp_path):
    from chunklens.sources import readers, writers

    p = str(tmp_path)
    d = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "id int, domain string, block int")
    writers.by_domain(d, f"{p}/d")
    assert spark.read.parquet(f"{p}/d").count() == 2
    writers.parts(d, f"{p}/parts")
    writers.parts(d, f"{p}/parts")
    assert spark.read.parquet(f"{p}/parts").count() == 2
    writers.replace(d, f"{p}/r")
    writers.replace(d.limit(1), f"{p}/r")
    assert spark.read.parquet(f"{p}/r").count() == 1
    d.limit(1).write.parquet(f"{p}/r.old")  # left by a run that broke off
    writers.replace(d, f"{p}/r")
    assert spark.read.parquet(f"{p}/r").count() == 2 and not (tmp_path / "r.old").exists()
    writers.csv_report(d, f"{p}/report")
    assert next((tmp_path / "report").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfid")
    assert readers.csv_report(spark, f"{p}/report").columns == ["id", "domain", "block"]
    (tmp_path / "log.jsonl").write_text('{"_id": "a", "chunks": ["x"]}\n\n{"_id": "b", "chu')
    assert [r["_id"] for r in readers.json_log(spark, f"{p}/log.jsonl").collect()] == ["a"]
    (tmp_path / "r.csv").write_text("﻿method,acc\nm,1\n", encoding="utf-8")
    assert readers.csv_report(spark, f"{p}/r.csv").columns == ["method", "acc"]
    assert "| id |" in writers.markdown(d)
    d.write.parquet(f"{p}/s/val")
    assert readers.split(spark, f"{p}/s", "validation").count() == 2
    with pytest.raises(FileNotFoundError, match="val"):
        readers.split(spark, f"{p}/s", "other")
    (tmp_path / "raw_ppl_shard0_rep1_20250102_030405.jsonl").write_text('{"question_id": "q", "topk": 5, "is_correct": true}\n')
    r = readers.result_files(spark, f"{p}/raw_*.jsonl").first()
    assert (r["method"], r["rep"], r["is_correct"]) == ("ppl", 1, True)


def test_merge_first_wins(spark):
    mk = lambda ids, src: spark.createDataFrame([(i, k, src) for k, i in enumerate(ids)], "_id string, line int, src string")
    got = E.merge_sources([mk("AB", "dir"), mk("A", "shard"), mk("BC", "log")], "_id", "line").collect()
    assert {r["_id"]: r["src"] for r in got} == {"A": "dir", "B": "dir", "C": "log"}


def test_select_covering(spark):
    hits = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(s).alias("score"), F.lit(a).alias("start"), F.lit(n).alias("len")) for r, s, a, n in [(1, 1.0, 0, 2), (2, 0.9, 0, 2), (3, 0.5, 5, 2)]])
    assert one(spark, R.select_covering(hits, 2)) == [1, 3]


def test_search_against_brute_force(spark, monkeypatch):
    """Null, empty, long and tied documents, also where histograms are made in many blocks."""
    import hashlib

    texts = [None, [], ["only one"], ["same words", "same words", "other thing"], ["", "x"], [f"w{i % 7} w{i % 3} tail" for i in range(300)], ["long " * 3000, "w1 w2"]]
    rows = [(i, t, q) for i, t in enumerate(texts) for q in ("same w1 long", "", None)]
    d = spark.createDataFrame(rows, "i int, s array<string>, q string")

    def histogram(words):
        h = [0] * R.BUCKETS
        for w in words:
            h[int(hashlib.md5(w.lower().encode()).hexdigest()[:4], 16) % R.BUCKETS] += 1
        return h

    def want(s, q, k):
        n = len(s or [])
        spans = [(1, i, 1) for i in range(n)]
        for g, step in ((2, 1), (4, 2)):
            if n >= g:
                starts = list(range(0, n - g + 1, step))
                spans += [(g, a, g) for a in starts + ([n - g] if starts[-1] != n - g else [])]
        spans += [(1, 0, 1)] if n == 1 else []
        asked, scored = histogram((q or "").split()), []
        for r, (g, a, m) in enumerate(spans):
            h = histogram(" ".join(s[a : a + m]).split())
            square = sum(x * x for x in h)
            scored.append((sum(x * y for x, y in zip(h, asked, strict=True)) / square**0.5 if square else 0.0, r, g, a, m))
        return [(i + 1, *x) for i, x in enumerate(sorted(scored, reverse=True)[:k])]

    for block in (64, R.BLOCK):
        monkeypatch.setattr(R, "BLOCK", block)
        for r in R.search(d, "s", "q", 5).collect():
            assert [tuple(h) for h in r["hits"]] == want(r["s"], r["q"], 5), (block, r["i"])
    assert R.search(d.limit(0), "s", "q", 5).count() == 0
