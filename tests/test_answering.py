"""Answer records, budgets, names, chunks by meaning, and folds in batches."""

import sys
from collections import namedtuple

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chunklens.functions import naming as N
from chunklens.functions import text as X
from chunklens.functions import tokens as TK
from chunklens.operators import answering as AN
from chunklens.operators import boundaries as B
from chunklens.operators import chunkers as C
from chunklens.operators import embedding as EM
from chunklens.operators import etl as E
from chunklens.session import ship
from chunklens.sources import constants as K

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module
Reply = namedtuple("Reply", "text")


class Parrot:
    """Answers with the letter that the question ends with; refuses, fails and rambles on request."""

    def chat(self, prompt):
        asked = prompt.split("Question: ")[1].split("\n")[0]
        if asked.endswith("fail"):
            raise RuntimeError("down")
        if asked.endswith("refuse"):
            return "content_flag_increment"
        return [Reply("no idea")] if asked.endswith("ramble") else f"Well: {{'answer': '{asked[-1]}',}}"


def test_records(spark):
    rows = [
        ("1", "red fox b", "Law", ["blue hen", "red fox", "red fox", "grey"], "B", 1.5), ("2", "x fail", "Law", ["x"], "A", None), ("3", "x refuse", None, ["x"], "A", 0.0),
        ("4", "x ramble", "Art", [], "A", 0.0), ("5", "no chunks C", "Art", None, "c", 0.0), (None, None, None, ["y"], None, None),
    ]
    d = spark.createDataFrame(rows, "question_id string, question string, domain string, chunks array<string>, answer string, time double").withColumn("choices", AN.choices(F.lit("yes"), F.lit("no")))
    got = {(r["question_id"], r["topk"]): r for r in AN.records(d, Parrot, EM.hashed(64), ks=(1, 3), retries=1).collect()}
    assert len(got) == 12
    r = got["1", 3]
    assert [h["text"] for h in r["retrieved_chunks"]] == ["red fox", "red fox", "grey"] or [h["text"] for h in r["retrieved_chunks"]][:2] == ["red fox", "red fox"]
    assert r["retrieved_chunks"][0]["similarity"] == pytest.approx(2 / np.sqrt(2) / np.sqrt(3)) and len(got["1", 1]["retrieved_chunks"]) == 1
    assert (r["domain"], r["model_answer"], r["correct_answer"], r["is_correct"], r["status"], r["choices"]) == ("law", "b", "B", True, "answered", {"A": "yes", "B": "no"})
    assert r["original_chunking_stats"]["chunking_time"] == 1.5 and r["chunks_encoding_stats"]["question_id"] == "1" and r["chunks_encoding_stats"]["time"] > 0
    assert r["parsed_response"] == '{"answer":"b"}' and "Context:\nred fox\n\nred fox" in r["prompt"]
    assert [(got[q, 1]["model_answer"], got[q, 1]["status"], got[q, 1]["tries"]) for q in "234"] == [("UNKNOWN", "failed", 2), ("UNKNOWN", "refused", 1), ("UNKNOWN", "answered", 1)]
    assert got["5", 1]["is_correct"] and got["5", 1]["retrieved_chunks"] == [] and got[None, 1]["is_correct"] is False and got["2", 1]["original_chunking_stats"]["chunking_time"] == 0


def test_budget_takes_system_question_and_reserve_off(spark):
    d = spark.createDataFrame([("a b c d e f g", "one two"), ("a b", "one"), (None, "one"), ("a b", "w " * 50)], "c string, q string")
    got = [r[0] for r in d.select(TK.within(F.col("c"), F.col("q"), 10, "be brief", 3)).collect()]
    assert got == ["a b c", "a b", None, ""]


class Codes:
    def encode(self, text):
        return list(text.encode())

    def decode(self, ids):
        return bytes(ids).decode()


def test_any_tokenizer(spark):
    ship(spark)
    d = spark.createDataFrame([("né",), ("",), (None,)], "t string").select("t", TK.encoded(Codes)("t").alias("i"))
    assert [tuple(r) for r in d.select("i", TK.decoded(Codes)("i")).collect()] == [([110, 195, 169], "né"), ([], ""), (None, None)]


def test_sample_drops_context(spark):
    d = spark.createDataFrame([("1", "long text", 7)], "_id string, context string, time int")
    s = AN.sample(d, F.array("context"), F.lit(2))
    assert s.columns == ["_id", "chunks", "time"] and tuple(s.first()) == ("1", ["long text"], 2.0)


def test_names(spark):
    d = spark.createDataFrame([("Multi-Document QA",), ("Single-Document QA",)], "n string")
    assert [r[0] for r in d.select(N.mapped(F.col("n"), K.DOMAIN_NAMES, "domain")).collect()] == ["multi-doc", "single-doc"]
    for bad in ("Poems", None):
        with pytest.raises(PySparkException, match="unmapped domain: " + str(bad or "null")):
            spark.createDataFrame([(bad,)], "n string").select(N.mapped(F.col("n"), K.DOMAIN_NAMES, "domain")).collect()
    e = spark.createDataFrame([("zz",), ("ppl",), ("lumber",), ("aa",), (None,)], "n string")
    order = ["lumber", "ppl"]
    assert [r["n"] for r in e.orderBy(N.place(F.col("n"), order), F.col("n").asc_nulls_last()).collect()] == ["lumber", "ppl", "aa", "zz", None]
    assert [r[0] for r in e.select(N.labelled(F.col("n"), {"ppl": "PPL"})).collect()] == ["zz", "PPL", "lumber", "aa", None]
    assert e.where(N.admitted(F.col("n"), ["aa", "ppl"])).count() == 2 and e.where(N.admitted(F.col("n"), None)).count() == 5 == e.where(N.admitted(F.col("n"), [])).count()


def test_constant_tables(spark):
    p = {(r["method"], r["domain"], r["topk"]): r["acc_pct"] for r in K.accuracies(spark, K.PUBLISHED).collect()}
    assert len(p) == 28 and p["spans", "overall", 5] == 33.6 and p["windows", "code-repo", 10] == 51.33
    assert K.domain_facts(spark).agg(F.sum("questions")).first()[0] == 503 and set(K.DOMAIN_NAMES.values()) == set(K.DOMAINS)


class Picky(EM.HashedBag):
    def encode(self, texts):
        if "poison" in texts.to_pylist():
            raise ValueError("poison")
        return super().encode(texts)


def test_chunks_by_meaning(spark):
    docs = [(1, ["a a", "a a", "b b", "b b", "a a"]), (2, ["x", "poison"]), (3, ["one"]), (4, []), (5, None), (6, ["a", "b"])]
    d = spark.createDataFrame(docs, "k int, s array<string>").coalesce(1)
    got = {}
    for r in C.by_meaning(d, "k", "s", EM.Model("picky", lambda: Picky(64))).orderBy("k", "chunk").collect():
        got.setdefault(r["k"], []).append(r["chunk_text"])
    # distances 0, 1, 0, 1: above their median of 0.5
    assert got == {1: ["a a a a", "b b b b", "a a"], 3: ["one"], 6: ["a b"]}
    with pytest.raises(PySparkException, match="poison"):
        d.select(EM.gaps(EM.Model("picky", lambda: Picky(64)))(F.coalesce("s", F.array().cast("array<string>")))).collect()


@pytest.mark.parametrize("ends, want", [([], ["abcd"]), ([0], ["a", "bcd"]), ([0, 1, 2, 3], ["a", "b", "c", "d"]), ([3], ["abcd"]), ([1, 2], ["ab", "c", "d"])])
def test_joined_at(spark, ends, want):
    d = spark.createDataFrame([(["a", "b", "c", "d"], ends)], "p array<string>, e array<int>")
    assert d.select(X.joined_at(F.col("p"), F.col("e"))).first()[0] == want


def test_positions_and_merge_of_many_parts(spark):
    n = 20_000
    d = spark.createDataFrame([(" ".join(f"s{i}" for i in range(n)), [f"s{i}" for i in range(n)]), ("abc", ["c", "zz", "a"]), (None, ["q"]), ("x", None)], "t string, p array<string>")
    got = [r[0] for r in d.select(X.positions(F.col("t"), F.col("p"))).collect()]
    text = " ".join(f"s{i}" for i in range(n))
    assert len(got[0]) == n and all(text[x["start"] : x["end"]] == x["sentence"] for x in got[0])
    assert [(x["start"], x["end"]) for x in got[1]] == [(2, 3), (3, 5), (5, 6)] and [(x["start"], x["end"]) for x in got[2]] == [(0, 1)] and got[3] == []
    sizes = spark.createDataFrame([([150, 60, 40],), ([250, 1],), ([],), (None,)], "s array<int>")
    assert [r[0] for r in sizes.select(B.greedy_merge(F.col("s"), 200)).collect()] == [[0, 1, 1], [1, 2], [], []]


def test_slices_with_and_without_a_limit(spark):
    d = spark.createDataFrame([(g, i) for g in ("a", "b", None) for i in range(30, 0, -1)], "g string, i int")
    for offset, limit in ((0, 5), (28, 10), (40, 1), (3, None)):
        got = sorted(((r["g"], r["i"], r["pos"]) for r in E.in_slice(d, "g", "i", offset=offset, limit=limit).collect()), key=str)
        want = [(g, i, i - 1) for g in ("a", "b", None) for i in range(1, 31) if i > offset and (limit is None or i <= offset + limit)]
        assert got == sorted(want, key=str)
    plan = E.in_slice(d, "g", "i", offset=1, limit=2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
