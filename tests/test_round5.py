"""Findings of round 3, second part: a step's work grows no faster than its rows."""

import os
import random

from chunklens.functions import text as X
from chunklens.operators import boundaries as B
from chunklens.plans import ORACLES, QUERIES, streams
from chunklens.streaming import minima as SM
from compare import same
from pyspark.sql import functions as F


def _plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_text_are_found_once(spark):
    """A text's words are found once, however many windows it has; before, each window read the whole text again."""
    texts = {0: None, 1: " \n", 2: "a", 3: " ".join(f"w{i}" for i in range(3001))}
    d = spark.createDataFrame(list(texts.items()), "i int, text string")
    for size, overlap in ((1, 0), (64, 0), (64, 16), (3, 5)):
        got = d.select("i", X.token_windows(X.words(F.col("text")), size, overlap).alias("w"))
        assert _plan(got).count("regexp_extract_all") == 1
        of = {i: (t or "").split() for i, t in texts.items()}
        assert dict(map(tuple, got.collect())) == {i: [" ".join(t[a : a + size]) for a in range(0, len(t), max(1, size - overlap))] for i, t in of.items()}
    got = d.select("i", X.truncate_tokens(F.col("text"), F.lit(3)).alias("w"))
    assert _plan(got).count("regexp_extract_all") == 1 and dict(map(tuple, got.collect())) == texts | {3: "w0 w1 w2"}


def test_records_of_texts_without_words(spark, tmp_path):
    """Windows aren't made a second time to find texts without any, and don't go to the model."""
    texts = ["", None, " \n\t ", "\u00a0", "one", "a b\nc " * 700]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"question {i} of a b") for i in range(4)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = QUERIES["answer_records"](spark, str(tmp_path))
    plan = _plan(d)
    assert plan.count("regexp_extract_all(text") == 1 and "chunks#" not in plan[plan.index("MapInArrow run(") :].split("\n")[0].replace("retrieved_chunks#", "")
    same(d, ORACLES["answer_records"], str(tmp_path))


def test_state_of_many_keys(spark, tmp_path):
    """3,000 keys share at most as many values in the state store as there are buckets; ids beyond 2^53 and the null key keep apart over a restart."""
    r = random.Random(2)
    keys = [None, *range(2**53, 2**53 + 2999)]
    rows = [(k, s, p, r.choice([1.0, 2.0, 2.5, 3.0, 4.0])) for k in keys for s in range(3) for p in range(r.randint(1, 9))]
    SM.state_store(spark)
    at, schema = str(tmp_path), "k long, series long, position long, value double"
    cut = lambda x: (x[1], x[2]) < (1, 2 + (x[0] or 0) % 3)  # inside a series, at another place for each key
    for part in (cut, lambda x: not cut(x)):
        spark.createDataFrame([x for x in rows if part(x)][::-1], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        q = SM.minima_stream(spark.readStream.schema(schema).parquet(f"{at}/in"), "k", 0.5, history=3).writeStream.trigger(availableNow=True)
        q = q.option("checkpointLocation", f"{at}/state").format("parquet").start(f"{at}/out")
        q.awaitTermination()
        assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= SM.BUCKETS < len(keys)
    want = {}
    for k, s, p, v in rows:
        threshold, drops, held = want.setdefault(k, [0.5, [], [], []])[:3]
        held = [*held[-2:], (s, p, v)] if held and held[-1][0] == s else [(s, p, v)]
        found, threshold, drops = B.fold_minima([[h[2] for h in held]], threshold, drops, 3)
        want[k] = [threshold, drops, held, want[k][3] + [(k, s, held[i][1], threshold) for i in found[0]]]
    got = sorted(map(tuple, spark.read.parquet(f"{at}/out").collect()), key=str)
    assert got == sorted((x for w in want.values() for x in w[3]), key=str) and len({x[3] for x in got}) > 1


def test_a_step_of_several_files(spark, sf, monkeypatch, tmp_path):
    """A step of a stream is written by as many tasks as its rows need, and a user's rows stay in order."""
    monkeypatch.setattr(streams, "STEP_ROWS", 50)
    monkeypatch.setattr(streams, "_place", lambda _: str(tmp_path))
    same(QUERIES["minima_streamed"](spark, sf), ORACLES["minima_streamed"], sf)
    files = len([n for n in os.listdir(f"{tmp_path}/in") if n.endswith(".parquet")])
    assert 5 < files <= 5 * (spark.read.parquet(f"{sf}/events.parquet").count() // 250 + 1)
