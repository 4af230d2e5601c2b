"""The trained sentence splitter, batch embedding and attention, against small corpora and brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunklens.operators import attention as A
from chunklens.operators import embedding as EM
from chunklens.operators import sentences as SE
from chunklens.operators import spans as S
from chunklens.session import ship

TOPICS = ["harbour", "mill", "orchard", "quarry", "tannery", "chapel", "depot", "canal", "market", "foundry"]


@pytest.fixture(scope="module")
def model(spark):
    lines = []
    for k in range(400):
        t, u = TOPICS[k % 10], TOPICS[(k * 7 + 3) % 10]
        lines.append(f"We met Dr. Weber near the {t} today. The {u} was closed, approx. half of it. A visitor from the {t} came by.")
        lines.append(f"The {t} belongs to J. Keller now. However the {u} stays open. It opens on the {k % 28 + 1}. of every month.")
        lines.append(f"In the {u} we found tools, cf. page {k}. However nobody asked. Is the {t} far? No one could tell in the {u}.")
        lines.append(f"some now say today that it came by the month when the {u} stays open and nobody asked or closed the {t} or {k} at noon")
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    return SE.train(docs)


def split(spark, model, text):
    return SE.split(spark.createDataFrame([(1, text)], "k int, text string"), "k", "text", model).first()["sentences"]


def test_what_is_learned(model):
    assert {"dr", "approx", "cf"} <= {r["type"] for r in model["abbreviations"].collect()} and "harbour" not in {r["type"] for r in model["abbreviations"].collect()}
    assert "however" in {r["type"] for r in model["starters"].collect()}


@pytest.mark.parametrize("text, want", [
    ("We met Dr. Weber at noon. The mill was closed.", ["We met Dr. Weber at noon.", "The mill was closed."]),
    ("It holds approx. half of it. However it leaks.", ["It holds approx. half of it.", "However it leaks."]),
    ("It belongs to J. Keller now. The rest is ours.", ["It belongs to J. Keller now.", "The rest is ours."]),
    ("On the 3. of May we left! Why? No one knows", ["On the 3. of May we left!", "Why?", "No one knows"]),
    ('He said "stop." The mill stood still.', ['He said "stop."', "The mill stood still."]),
    ("  Blanks  stay\n inside.   The end. ", ["Blanks  stay\n inside.", "The end."]),
    ("Well ... he left.", ["Well ... he left."]), ("one", ["one"]), (" \n", []), ("", []), (None, []),
])
def test_trained_split(spark, model, text, want):
    assert split(spark, model, text) == want


def test_nothing_of_a_text_is_lost(spark, model):
    text = "A. B. C! ... d.e.f. (g.) 3. X? " * 50
    assert "".join("".join(split(spark, model, text)).split()) == "".join(text.split())


def test_large_models_are_joined(spark, model, monkeypatch, tmp_path):
    """Both ways to use a model, and one that was saved, split alike."""
    r = random.Random(7)
    words = ["Dr.", "approx.", "cf.", "J.", "3.", "the", "The", "However", "however", "mill", "Mill.", "closed.", "Why?", "...", "page", "It", "it", "now."]
    d = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(60))) for i in range(40)], "k int, text string")
    SE.save(model, f"{tmp_path}/m")
    kept = SE.load(spark, f"{tmp_path}/m")
    assert SE.rules(model) is not None
    near = {x["k"]: x["sentences"] for x in SE.split(d, "k", "text", kept).collect()}
    monkeypatch.setattr(SE, "SMALL", 3)
    assert SE.rules(model) is None
    far = {x["k"]: x["sentences"] for x in SE.split(d, "k", "text", kept).collect()}
    assert near == far and sum(map(len, near.values())) > 100


def test_association_is_the_likelihood_ratio(spark):
    both, first, second, total = 30.0, 40.0, 100.0, 10_000.0
    log = lambda k, n, p: k * np.log(p) + (n - k) * np.log(1 - p)
    want = 2 * (log(both, first, both / first) + log(second - both, total - first, (second - both) / (total - first)) - log(both, first, second / total) - log(second - both, total - first, second / total))
    got = spark.range(1).select(SE.association(*map(F.lit, (both, first, second, total)))).first()[0]
    assert got == pytest.approx(want)
    assert spark.range(1).select(SE.association(*map(F.lit, (5.0, 5.0, 5.0, 50.0)))).first()[0] > 0


def counts(text, n):
    out = np.zeros(n)
    for w in (text or "").split():
        out[int(hashlib.md5(w.lower().encode()).hexdigest()[:4], 16) % n] += 1
    return out


LISTS = [["one two two", "Three", ""], None, [], ["  \t lead and trail \n", None, "ONE one"], ["x " * 3000]]


def test_hashed_bag_and_its_batch_functions(spark, monkeypatch):
    ship(spark)
    flat = [t for x in LISTS if x for t in x]
    assert (EM.HashedBag(8).encode(pa.array(flat, pa.string())) == np.stack([counts(t, 8) for t in flat])).all()
    assert EM.HashedBag(8).encode(pa.array([], pa.string())).shape == (0, 8)
    d = spark.createDataFrame([(i, x) for i, x in enumerate(LISTS)], "k int, t array<string>").coalesce(1).withColumn("s", S.store_rows(F.col("t")))
    got = d.select("k", EM.vectors(EM.hashed(8))("t").alias("v"), EM.gaps(EM.hashed(8))("t").alias("g"), EM.pooled(EM.hashed(8))("t", "s").alias("p"), EM.word_buckets(8)("t").alias("w"), "s").collect()
    for r, x in zip(sorted(got, key=lambda r: r["k"]), LISTS, strict=True):
        c = [counts(t, 8) for t in x or []]
        n = [np.sqrt((v * v).sum()) + 1e-8 for v in c]
        assert np.allclose(r["v"], [v / m for v, m in zip(c, n, strict=True)], atol=1e-6) if c else r["v"] == []
        assert r["g"] == [pytest.approx(1 - a @ b / (m * o), abs=1e-9) for a, b, m, o in zip(c, c[1:], n, n[1:], strict=False)]
        assert [len(w) for w in r["w"]] == [int(v.sum()) for v in c]
        for p, got_p in zip(r["s"] or [], r["p"], strict=True):
            m = sum(c[p["start"] : p["start"] + p["len"]]) / p["len"]
            assert np.allclose(got_p, m / max(np.sqrt((m * m).sum()), 1e-12))


def test_small_blocks_give_the_same(monkeypatch):
    lists = pa.array(LISTS * 3, pa.list_(pa.string()))
    whole = list(EM._blocks(lists))
    monkeypatch.setattr(EM, "BLOCK", 2)
    cut = list(EM._blocks(lists))
    assert len(cut) > len(whole) == 1
    assert np.concatenate([n for n, _ in cut]).tolist() == whole[0][0].tolist() and [t for _, x in cut for t in x.to_pylist()] == whole[0][1].to_pylist()


def test_model_is_loaded_once():
    calls = []
    m = EM.Model("test model", lambda: calls.append(1) or EM.HashedBag(2))
    assert m.get() is m.get() and len(calls) == 1


def brute_attention(x, first, length, w, place):
    out = []
    h = w.heads
    p = lambda what, rows: rows if getattr(w, what) is None else rows @ getattr(w, what)
    for a, n in zip(first, length, strict=True):
        own = x[a : a + n]
        q, k, v = p("query", own.mean(axis=0)), p("key", own), p("value", own)
        size = len(q) // h
        heads = []
        for j in range(h):
            cols = slice(j * size, (j + 1) * size)
            keys = k[:, cols] + (w.distance[np.minimum(place[a : a + n], len(w.distance) - 1)] if w.distance is not None else 0)
            s = keys @ q[cols] / np.sqrt(size)
            e = np.exp(s - s.max())
            heads.append(e / e.sum() @ v[:, cols])
        out.append(np.concatenate(heads))
    return np.array(out)


@pytest.mark.parametrize("heads, trained, distance", [(1, False, False), (2, True, False), (2, True, True), (4, False, True)])
def test_attention_equals_brute_force(heads, trained, distance):
    r = np.random.default_rng(heads)
    x = r.normal(size=(20, 8))
    m = lambda: r.normal(size=(8, 8)) if trained else None
    w = A.Weights(heads, m(), m(), m(), r.normal(size=(3, 8 // heads)) if distance else None)
    first, length = np.array([0, 0, 5, 7, 19]), np.array([1, 4, 2, 13, 1])
    place = np.arange(20) % 7
    got, share = A.attend(x, first, length, place, w)
    assert np.allclose(got, brute_attention(x, first, length, w, place)) and np.allclose(np.add.reduceat(share, np.cumsum(length) - length), 1)


def test_attention_in_spark(spark, monkeypatch):
    ship(spark)
    r = np.random.default_rng(0)
    docs = [r.normal(size=(n, 4)).tolist() for n in (5, 1, 0, 9)] + [None]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(docs)], "k int, v array<array<double>>").coalesce(1).withColumn("s", S.store_rows(F.col("v")))
    w = A.Weights(2, *(r.normal(size=(4, 6)) for _ in range(3)))
    for row in d.select("k", "v", "s", A.attended(F.col("v"), F.col("s"), w).alias("y")).collect():
        if row["v"]:
            want = brute_attention(np.array(row["v"]), [s["start"] for s in row["s"]], [s["len"] for s in row["s"]], w, np.arange(99))
            assert np.allclose(row["y"], want)
        else:
            assert not row["y"]
