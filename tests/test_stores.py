"""Stores of training pairs: manifests, coverage, the gate and the merge, each failure once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from chunklens.operators import embedding as EM
from chunklens.operators import etl as E
from chunklens.operators import stores as ST


def texts(spark):
    rows = [("a", p, [f"s{p} {k}." for k in range(p % 4)]) for p in range(10)] + [("b", p, ["one.", "two.", "three."]) for p in range(3)] + [(None, 0, ["x.", "y."])]
    return spark.createDataFrame(rows, "corpus_split string, pos long, sentences array<string>")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("store"))
    ST.write_shards(texts(spark), at, 2, EM.hashed(8))
    ST.merge(spark, at, f"{at}/store", 8)
    return at


def manifest(spark, *rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], "corpus_split string, lo long, hi long, n_records long, n_short_docs long, n_vectors long")


def test_manifests_say_what_was_written(spark, built):
    m = {(r["corpus_split"], r["shard"]): r for r in ST.read_manifests(spark, built).collect()}
    assert {k: (r["lo"], r["hi"], r["n_records"], r["n_short_docs"]) for k, r in m.items()} == {
        ("a", 0): (0, 5, 2, 3), ("a", 1): (5, 10, 2, 3), ("b", 0): (0, 2, 2, 0), ("b", 1): (2, 3, 1, 0), (None, 0): (0, 1, 1, 0)}
    assert m["b", 1]["n_vectors"] == 3 + 2  # three sentences, spans at 0 and 1
    t = ST.manifest_totals(ST.read_manifests(spark, built)).first()
    assert (t["shards"], t["n_records"], t["n_short_docs"]) == (5, 8, 6)


def test_coverage_counts_each_document_once(spark):
    d = texts(spark)
    m = manifest(spark, ("a", 0, 4, 1), ("a", 2, 3, 1), ("a", 4, 6, 0), ("a", 8, 99, 1), ("b", 5, 9, 0), ("b", 1, 1, 0), ("c", 0, 2, 0))
    got = {r["corpus_split"]: tuple(r)[1:] for r in ST.coverage(d, m, d.where("corpus_split = 'a' and size(sentences) >= 2").limit(3)).collect()}
    assert got["a"] == ("[0,6) [8,99)", 2, 3, 3, 0, 0, False)  # 2 and 3 are long enough, and 8 and 9 aren't
    assert got["b"][:4] == ("[5,9)", 0, 0, 0) and got["c"][:4] == ("[0,2)", 0, 0, 0)


@pytest.mark.parametrize("block", [1, 3, 100])
def test_prefix_counts(spark, block):
    d = spark.createDataFrame([(g, p, p % 3 == 0) for g, n in (("x", 10), ("y", 1), (None, 4)) for p in range(n)], "g string, p long, c boolean")
    for r in E.prefix_counts(d, "g", "p", F.col("c"), block).collect():
        assert r["upto"] == r["p"] // 3 + 1
    assert set(E.prefix_counts(d, "g", "p", F.col("c")).columns) == {"g", "p", "c", "upto"}


def checks(df):
    return {r["check"]: r["passed"] for r in df.collect()}


def test_gate_passes_a_sound_store(spark, built):
    got = checks(ST.gate(spark.read.parquet(f"{built}/store"), texts(spark), ST.read_manifests(spark, built), 8))
    assert got == dict.fromkeys(("columns", "input_type", "label_type", "shape", "dim", "finite", "rows_covered", "rows_declared"), True)
    sampled = ST.gate(spark.read.parquet(f"{built}/store"), texts(spark), ST.read_manifests(spark, built), 8, sample=3)
    assert {r["detail"] for r in sampled.where("check = 'shape'").collect()} == {"0 of 3 rows"}


@pytest.mark.parametrize("fails, change", [
    ("shape", lambda d: d.withColumn("label", F.slice("label", 1, 1))), ("shape", lambda d: d.withColumn("input", F.slice("input", 1, 1)).withColumn("label", F.slice("label", 1, 1))),
    ("dim", lambda d: d.withColumn("input", F.transform("input", lambda v: F.slice(v, 1, 7)))), ("finite", lambda d: d.withColumn("label", F.transform("label", lambda v: F.transform(v, lambda x: x / F.lit(0.0).cast("float")).cast("array<float>")))),
    ("label_type", lambda d: d.withColumn("label", F.col("label").cast("array<array<double>>"))), ("columns", lambda d: d.withColumn("more", F.lit(1))), ("rows_covered", lambda d: d.union(d)), ("manifest", None),
])
def test_gate_fails_each_check(spark, built, fails, change):
    store = spark.read.parquet(f"{built}/store")
    got = checks(ST.gate(change(store) if change else store, texts(spark), ST.read_manifests(spark, built) if change else None, 8)) if fails != "finite" else None
    if fails == "finite":
        with_nan = store.withColumn("label", F.transform("label", lambda v: F.transform(v, lambda x: F.lit(float("nan")).cast("float"))))
        got = checks(ST.gate(with_nan, texts(spark), ST.read_manifests(spark, built), 8))
    assert not got[fails]


def test_merge_publishes_only_what_holds(spark, built, tmp_path):
    out = f"{tmp_path}/out"
    assert ST.merge(spark, built, out, 8, expect=8).first()["rows"] == 8
    before = sorted(os.listdir(out))
    with pytest.raises(ST.NotPublished, match="expected 9"):
        ST.merge(spark, built, out, 8, expect=9)
    with pytest.raises(ST.NotPublished, match="dim"):
        ST.merge(spark, built, out, 16)
    wrong = f"{tmp_path}/wrong"
    ST.write_shards(texts(spark), wrong, 2, EM.hashed(8))
    ST.read_manifests(spark, wrong).limit(2).write.json(f"{wrong}/manifests", mode="append")
    with pytest.raises(ST.NotPublished, match="declared"):
        ST.merge(spark, wrong, out, 8)
    doubles = f"{tmp_path}/doubles"
    ST.write_shards(texts(spark), doubles, 2, EM.hashed(8))
    ST.read_parts(spark, doubles).withColumn("label", F.col("label").cast("array<array<double>>")).write.partitionBy("corpus_split", "shard").parquet(f"{doubles}/typed/parts")
    ST.read_manifests(spark, doubles).write.json(f"{doubles}/typed/manifests")
    with pytest.raises(ST.NotPublished, match="label_type"):
        ST.merge(spark, f"{doubles}/typed", out, 8)
    assert sorted(os.listdir(out)) == before and spark.read.parquet(out).count() == 8
    line = "".join(open(f"{out}.manifest/{f}", encoding="utf-8").read() for f in os.listdir(f"{out}.manifest") if f.endswith(".json"))  # noqa: SIM115
    assert json.loads(line)["declared"] == 8
