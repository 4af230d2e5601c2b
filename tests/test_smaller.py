"""Plug-ins, text forms and small rules that no query asks for on its own."""

import json
import os
import sys
import warnings

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from chunklens import protocols as P
from chunklens.functions import text as X
from chunklens.operators import embedding as EM
from chunklens.operators import gates as G
from chunklens.operators import retrieve as R
from chunklens.session import ship
from chunklens.sources import readers, writers

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def one(spark, column, **values):
    return (spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)).select(column).first()[0]


@pytest.mark.parametrize("text, want", [
    ("今天下雨。你好吗？好！走；完", ["今天下雨。", "你好吗？", "好！", "走；", "完"]), ("无标点", ["无标点"]), ("。。", ["。", "。"]), ("", []), ("a.b。c", ["a.b。", "c"]),
])
def test_full_width_sentences(spark, text, want):
    assert one(spark, X.sentences_cjk(F.col("t")), t=text) == want


def test_numbered_lines_and_assignments(spark):
    assert one(spark, X.number_lines(F.array(F.lit("a"), F.lit("b")))) == ["ID 0: a", "ID 1: b"]
    assert [one(spark, X.strip_number(F.lit(t))) for t in ("ID 12:   x", "no ID 3: x", "ID 3:")] == ["x", "no ID 3: x", ""]
    assert [one(spark, X.answer_number(F.lit(t))) for t in ("so\nAnswer: ID x12y", "Answer: ID none", "ID 3")] == [12, None, None]
    assert one(spark, X.assignment(F.lit("2=code-repo;3=a,b"))) == {"2": ["code-repo"], "3": ["a", "b"]}


class Lengths:
    def encode(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_registry_and_embedder(spark):
    d = spark.createDataFrame([("one two. three.",), (None,)], "text string")
    assert [r["chunks"] for r in P.chunk_with(d, "sentences").collect()] == [["one two.", "three."], []]
    with pytest.raises(KeyError, match="sentences"):
        P.chunk_with(d, "magic")
    assert [r["embedding"] for r in P.embed_with(d, Lengths(), batch=1).collect()] == [[15.0, 1.0], [0.0, 1.0]]


def test_schema_equality(spark):
    d = spark.createDataFrame([(1,) * len(G.CHUNKED)], list(G.CHUNKED))
    assert G.has_schema(d) and G.has_schema(d.select(*reversed(G.CHUNKED))) and not G.has_schema(d.drop("time")) and not G.has_schema(d.withColumn("context", F.lit(1)))


def test_json_keeps_letters(spark, tmp_path):
    writers.json_lines(spark.createDataFrame([("né 日本",)], "t string"), f"{tmp_path}/j")
    line = "".join((tmp_path / "j" / f).read_text(encoding="utf-8") for f in os.listdir(f"{tmp_path}/j") if f.endswith(".json")).strip()
    assert "né 日本" in line and json.loads(line) == {"t": "né 日本"}


def test_families_by_name(spark, tmp_path):
    for n in ("set", "set.shard0", "set.shard10", "set.gap", "setting", "other.shard0"):
        spark.range(1).write.parquet(f"{tmp_path}/{n}")
    assert [p.rsplit("/", 1)[1] for p in readers.family(spark, str(tmp_path), "set")] == ["set", "set.shard0", "set.shard10", "set.gap"]


def test_plot_points(spark):
    d = spark.range(10_000).select(F.col("id").alias("step"), (F.col("id") * 2.0).alias("v"))
    got = writers.plot_points(d, "step", "v", 100).orderBy("step").collect()
    assert len(got) == 100 and (got[0]["step"], got[0]["mean"]) == (99, 99.0) and got[-1]["step"] == 9999
    assert writers.plot_points(d.limit(1), "step", "v", 5).count() == 1


def test_cosine_matrix_of_any_shape(spark):
    ship(spark)
    r = np.random.default_rng(0)
    a, b = r.normal(size=(3, 5)), r.normal(size=(4, 5))
    d = spark.createDataFrame([(a.tolist(), b.tolist()), ([], b.tolist()), (a.tolist(), []), (None, b.tolist())], "a array<array<double>>, b array<array<double>>").coalesce(1)
    got = [x[0] for x in d.select(EM.cosines()("a", "b")).collect()]
    assert np.allclose(got[0], (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T, atol=1e-6)
    assert got[1:] == [[], [[], [], []], None]


class Letters:
    """Vectors of three counts, of which the question's is not a unit vector."""

    def encode(self, texts):
        return np.array([[(t or "").count(c) for c in "abc"] for t in texts.to_pylist()], float).reshape(-1, 3)


def test_search_with_any_model(spark):
    docs = [(1, ["aa", "b", "ab", "c"], "a"), (2, [], "a"), (3, None, None), (4, ["c"], "abc")]
    d = spark.createDataFrame(docs, "k int, s array<string>, q string")
    got = {r["k"]: [(h["row_idx"], round(h["score"], 6)) for h in r["hits"]] for r in R.search(d, "s", "q", 3, model=EM.Model("letters", Letters)).collect()}
    # rows: four sentences, pairs from 0, 1 and 2, and all four; the pair "aa b" has the mean (1, .5, 0)
    assert got[1] == [(0, 1.0), (4, round(2 / 5**0.5, 6)), (7, round(3 / (9 + 4 + 1) ** 0.5, 6))] and got[2] == got[3] == [] and got[4] == [(1, 1.0), (0, 1.0)]


def test_store_rows_carry_text_and_vector(spark):
    d = spark.createDataFrame([(1, ["aa", "b"]), (2, [])], "k int, s array<string>")
    got = R.build_store(d, "k", "s", EM.Model("letters", Letters)).orderBy("row_idx").collect()
    assert [(r["k"], r["row_idx"], r["text"]) for r in got] == [(1, 0, "aa"), (1, 1, "b"), (1, 2, "aa b")]
    assert np.allclose([r["embedding"] for r in got], [[1, 0, 0], [0, 1, 0], np.array([2, 1, 0]) / 5**0.5])


def test_unknown_modes_are_warned_of(spark):
    d = spark.createDataFrame([(["a b", "b"], "b")], "s array<string>, q string")
    with pytest.warns(UserWarning, match="unknown mode fancy"):
        fancy = R.retrieve(d, "s", "q", 2, "fancy").first()
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert R.retrieve(d, "s", "q", 2, "none").first()["texts"] == fancy["texts"]


def test_selections_pay_the_same_number_of_hits(spark):
    d = spark.createDataFrame([(["x y", "x y", "x", "z"], "x y")], "s array<string>, q string")
    got = {r["selection"]: r for r in R.compare_selections(R.search(d, "s", "q", 6), "s", 2).collect()}
    assert set(got) == {"score", "covering"} and got["score"]["chosen"] == [1, 2] and len(got["covering"]["chosen"]) == 2
    assert got["covering"]["covered"] >= got["score"]["covered"] and got["score"]["budget"] >= got["score"]["covered"]
