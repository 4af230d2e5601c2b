"""Streams with restarts, true line numbers, chat models that misbehave, and rankings by menu, against plain Python."""

import json
import random
import threading
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from chunklens.operators import ask as Q
from chunklens.operators import boundaries as B
from chunklens.operators import evaluate as EV
from chunklens.operators import retrieve as R
from chunklens.sources import readers
from chunklens.streaming import evaluation as SV
from chunklens.streaming import minima as SM


def test_minima_go_on_after_a_restart(spark, tmp_path):
    r = random.Random(1)
    series = {k: [[r.choice([1.0, 2.0, 2.5, 3.0, 4.0]) for _ in range(r.randint(1, 30))] for _ in range(6)] for k in "abc"}
    rows = [(k, s, p, v) for k, own in series.items() for s, vs in enumerate(own) for p, v in enumerate(vs)]
    SM.state_store(spark)
    at = str(tmp_path)
    schema = "k string, series long, position long, value double"
    for part in (lambda x: x[1] < 2, lambda x: x[1] == 2, lambda x: x[1] > 2):  # three runs, each from the checkpoint of the last
        spark.createDataFrame([x for x in rows if part(x)][::-1], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        d = SM.minima_stream(spark.readStream.schema(schema).parquet(f"{at}/in"), "k", 0.5, history=5)
        d.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/state").format("parquet").start(f"{at}/out").awaitTermination()
    got = {(x["k"], x["series"], x["position"]) for x in spark.read.parquet(f"{at}/out").collect()}
    want = {(k, s, p) for k, own in series.items() for s, ps in enumerate(B.fold_minima(own, 0.5, [], 5)[0]) for p in ps}
    assert got == want and want


def test_metrics_fire_by_count(spark, tmp_path):
    at = str(tmp_path)
    d = spark.range(1, 1051).select(F.col("id").alias("step"), (F.col("id") % 7).cast("double").alias("value"))
    SV.deal(d, "step", 200, f"{at}/in")
    source = lambda: spark.readStream.schema("step long, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{at}/in")
    metrics = {"first": F.min("step"), "n": F.count("*"), "mean": F.avg("value")}
    got = SV.evaluate_every(source(), metrics, f"{at}/out", f"{at}/state")
    assert sorted((r["first"], r["n"]) for r in got if r["n"]) == [(1, 200), (201, 200), (401, 200), (601, 200), (801, 200), (1001, 50)]
    assert all(r["mean"] == pytest.approx(sum(i % 7 for i in range(r["first"], r["first"] + r["n"])) / r["n"]) for r in got if r["n"])
    assert spark.read.parquet(f"{at}/out").count() == 1050
    assert not [r for r in SV.evaluate_every(source(), metrics, f"{at}/out", f"{at}/state") if r["n"]]  # nothing new


def test_line_numbers_of_split_files(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    files = {f"{n}.txt": [f"{n} {i} " + "x" * (i % 50) for i in range(k)] for n, k in (("a", 900), ("b", 1), ("c", 333))}
    for n, lines in files.items():
        (tmp_path / n).write_text("\n".join(lines) + "\n")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        d = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    got = {(r["_path"].rsplit("/", 1)[1], r["_line"]): r["value"] for r in d}
    assert got == {(n, i): x for n, lines in files.items() for i, x in enumerate(lines)}


def test_first_answer_in_files_and_lines_counts(spark, tmp_path):
    record = lambda q, ok, k=5: json.dumps({"question_id": q, "topk": k, "is_correct": ok, "total_sample_time": 1.5})
    name = "raw_{}_shard{}_rep1_20250102_030405.jsonl"
    (tmp_path / name.format("m", 0)).write_text("\n".join(["", record("q1", True), "{torn", record("q1", False), record("q2", False), record("q1", False, 10)]))
    (tmp_path / name.format("m", 1)).write_text("\n".join([record("q2", True), record("q9", True)]))
    (tmp_path / name.format("traditional_256", 0)).write_text(record("q1", False))
    (tmp_path / "notes.jsonl").write_text(record("q1", True))
    ids = spark.createDataFrame([("q1", "law"), ("q2", "law")], "question_id string, domain string")
    got = EV.first_answers(readers.result_lines(spark, str(tmp_path)), ids).select("method", "size", "domain", "topk", "question_id", "is_correct", "_line").collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        ("m", None, "law", 5, "q1", True, 1), ("m", None, "law", 5, "q2", False, 4), ("m", None, "law", 10, "q1", False, 5), ("m", None, "unknown", 5, "q9", True, 1), ("traditional", 256, "law", 5, "q1", False, 0)], key=str)


# ---- models ----


class Scripted:
    """A model that plays a list of replies for each prompt."""

    def __init__(self, **script):
        self.script, self.lock, self.busy, self.most = {k: list(v) for k, v in script.items()}, threading.Lock(), 0, 0

    def chat(self, prompt):
        with self.lock:
            self.busy += 1
            self.most = max(self.most, self.busy)
            reply = self.script[prompt].pop(0) if self.script.get(prompt) else "default"
        try:
            time.sleep(reply if isinstance(reply, float) else 0.01)
            if isinstance(reply, Exception):
                raise reply
            return "slow" if isinstance(reply, float) else reply
        finally:
            with self.lock:
                self.busy -= 1


def test_replies_of_every_form():
    assert [Q.reply_text(x) for x in ("a", ["b", "c"], (SimpleNamespace(text="d"),), SimpleNamespace(text="e"), 7, [])] == ["a", "b", "d", "e", "7", ""]
    with pytest.raises(ValueError, match="known: .'local_model'"):
        Q.service("elsewhere", {})
    assert Q.service("local_model", {"llm": 3}) == 3


def test_outcomes_and_bounded_calls():
    m = Scripted(no=[Q.REFUSAL], bad=[ValueError("x")] * 9, again=[ValueError("y"), "fine"], late=[1.0])
    got = list(Q.ask_all(["no", "bad", None, "again", "late", *["p"] * 20], m, 3, 0.3, 2))
    assert got[:5] == [Q.Outcome("refused", Q.REFUSAL, 1), Q.Outcome("failed", "ValueError: x", 3), Q.Outcome("failed", "no prompt", 0), Q.Outcome("answered", "fine", 2), Q.Outcome("late", "no reply in 0.3 s", 1)]
    assert got[5:] == [Q.Outcome("answered", "default", 1)] * 20 and m.most <= 3


def test_judge_that_refuses_and_fails():
    parts = [f"{'w ' * 100}{i}" for i in range(30)]
    seen = []

    def judge(g):
        seen.append(int(g[0].split()[-1]))
        if len(seen) == 1:
            raise B.Refused
        if len(seen) == 4:
            raise B.Failed
        return 2 if len(seen) == 2 else None

    # shown are five of six gathered parts; a refusal skips one part more, no answer skips what was shown
    assert B.judged(parts, judge) == ([8, 30], 1, True) and seen == [0, 6, 9, 14]
    assert B.judged_boundaries(parts, lambda g: (_ for _ in ()).throw(B.Failed())) == [30]


def test_asking_judge():
    replies = {"a": ("answered", "I think.\nAnswer: ID 2"), "b": ("answered", "no idea"), "c": ("answered", "Answer: ID 99"), "d": ("answered", "Answer: ID x1")}
    judge = B.asking_judge(lambda p: replies[p.rsplit(" ", 1)[1]], "Task")
    assert [judge(["x", "y", k]) for k in "abcd"] == [2, None, None, 1]
    prompts = []
    B.asking_judge(lambda p: prompts.append(p) or ("answered", ""), "T")(["one", "two"])
    assert prompts == ["T\nDocument:\nID 0: one\nID 1: two"]
    with pytest.raises(B.Refused):
        B.asking_judge(lambda p: ("refused", ""))(["x"])
    with pytest.raises(B.Failed):
        B.asking_judge(lambda p: ("late", ""))(["x"])


def test_ablation_ranks_each_menu(spark):
    docs = [(1, ["red fox", "blue fox", "red hen", "grey owl", "fox fox"], "red fox"), (2, ["only one"], "one"), (3, [], "x"), (4, ["a b", "c d"], None)]
    d = spark.createDataFrame(docs, "k int, s array<string>, q string")
    got = R.ablation(d, "s", "q", 3).collect()
    whole = {r["k"]: [(h["rank"], h["row_idx"]) for h in r["hits"]] for r in R.search(d, "s", "q", 3).collect()}
    for k, hits in whole.items():
        assert sorted((r["rank"], r["row_idx"]) for r in got if r["k"] == k and r["subset"] == 7) == hits
    assert all(r["len"] == 1 and r["row_idx"] < 5 for r in got if r["k"] == 1 and r["subset"] == 1)
    assert {r["len"] for r in got if r["k"] == 1 and r["subset"] == 4} == {4} and {r["len"] for r in got if r["k"] == 1 and r["subset"] == 6} <= {2, 4}
    assert [(r["row_idx"], r["rank"]) for r in got if r["k"] == 2 and r["subset"] == 2] == [(1, 1)] and not [r for r in got if r["k"] == 3]
