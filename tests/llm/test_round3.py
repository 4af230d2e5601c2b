"""Hard negatives, the digest index and ranked search against brute force and SQL, on awkward rows and in batches."""

import hashlib
import re
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunklens.llm import digest_index, fm_index, hard_negatives, lexical, suffix_levels, url_filters
from chunklens.llm.common import table
from chunklens.llm.digest_index import DigestIndex

# ---- hard negatives ----


def brute(rows, k=5):
    """rows: (place, vec_id, label, whole numbers, is an anchor)."""
    out = []
    for p, a, label, q, asks in rows:
        if not asks:
            continue
        dot = lambda o: sum(x * y for x, y in zip(q, o, strict=False))  # noqa: B023, E731
        scores = [(dot(o[3]), o[1], o[0], o[2] == label) for o in rows if o[0] != p]
        positives = sorted((-s, i, r) for s, i, r, same in scores if same)[:k]
        for s, i, _ in positives:
            fit = sorted((-n, j, r) for n, j, r, same in scores if not same and 80 * -s <= 100 * n <= 100 * -s)[:k]
            out += [(a, i, n + 1, j, -s, -m) for n, (m, j, _) in enumerate(fit)]
    return Counter(out)


def mined(spark, data, label=None):
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit(1)).withColumn("place", F.lit(2))
    got = hard_negatives.mine(d, F.col("vec_id") % 4 == 0, label if label is not None else F.col("label"))
    return Counter(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def numbers(data):
    good = [(i, v, lb) for i, v, lb in data if i is not None and v is not None and lb is not None and all(x is not None and np.isfinite(x) for x in v)]
    return [(n, i, lb, [int(np.floor(256 * x)) for x in v], i % 4 == 0) for n, (i, v, lb) in enumerate(good)]


def test_hard_negatives_on_awkward_rows(spark):
    r = np.random.default_rng(3)
    data = [(int(i), r.normal(size=6).round(2).tolist(), int(i) % 3) for i in range(60)]
    data += [(7, [0.5] * 6, 1)] * 9 + [(8, [0.5] * 6, 2)] * 3  # repeated rows and ties
    data += [(4, None, 1), (8, [1.0, None], 1), (12, [float("nan")], 1), (16, [float("inf")] * 6, 1), (20, [1.0] * 6, None), (None, [1.0] * 6, 1), (24, [], 1), (28, [1.0], 2)]
    assert mined(spark, data) == brute(numbers(data))
    assert mined(spark, []) == Counter()
    assert mined(spark, data, F.concat(F.lit("class "), F.col("label").cast("string"))) == brute(numbers(data))


def test_hard_negatives_of_large_numbers(spark):
    r = np.random.default_rng(4)
    data = [(int(i), (r.normal(size=3) * 1e5).tolist(), int(i) % 2) for i in range(40)]
    assert mined(spark, data) == brute(numbers(data))
    assert hard_negatives.products(np.array([[1 << 40, 1 << 40]]), np.array([[1 << 40, -3]])).tolist() == [[(1 << 63) - 1]]
    assert hard_negatives.products(np.array([[1 << 30, 5]]), np.array([[1 << 30, -3]])).tolist() == [[(1 << 60) - 15]]


@pytest.mark.parametrize("same", [True, False])
def test_dual_tree_prunes_whole_groups(same):
    """Clustered vectors: results equal brute force, and few products are worked out."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(64, 24)) * 400
    group = r.integers(0, 64, 6000)
    q = np.floor(centres[group] + r.normal(size=(6000, 24)) * 3).astype(np.int64)
    labels, ids = group % 16, np.arange(6000)
    pick = np.arange(0, 6000, 10)
    anchors = hard_negatives.Tree(q[pick], labels[pick], 16)
    every = hard_negatives.products(q[pick], q)
    mask = ((labels[pick][:, None] == labels) == same) & (pick[:, None] != ids)
    best = np.where(mask, every, hard_negatives.LEAST)
    high = np.full(len(pick), hard_negatives.MOST) if same else np.quantile(every, 0.9, axis=1).astype(np.int64)
    best = np.where(best <= high[:, None], best, hard_negatives.LEAST)
    want = np.array([np.lexsort((ids, ~row))[:5] for row in best])
    w = hard_negatives.Wanted(anchors, pick, np.arange(len(pick)), np.full(len(pick), hard_negatives.LEAST), high, 5, same)
    for half in (ids[::2], ids[1::2]):  # two candidate blocks, one after the other
        tree = hard_negatives.Tree(q[half], labels[half], 64)
        w.search(tree, half[tree.order], half[tree.order])
    got = np.empty_like(want)
    got[w.given] = w.vec_id
    assert (got == want).all()
    assert w.scored < (0.1 if same else 0.6) * every.size


def test_intervals_hold_all_products():
    r = np.random.default_rng(6)
    q = np.floor(r.normal(size=(500, 9)) * 100).astype(np.int64)
    a, c = hard_negatives.Tree(q[:200], r.integers(0, 3, 200), 8), hard_negatives.Tree(q[200:], r.integers(0, 3, 300), 16)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.spans)), np.arange(len(c.spans)), indexing="ij"))
    low, high = hard_negatives.interval(a, i, c, j)
    for n in range(len(i)):
        p = a.vectors[slice(*a.spans[i[n]])] @ c.vectors[slice(*c.spans[j[n]])].T
        assert low[n] <= p.min() and p.max() <= high[n]


# ---- digest index ----

TEXTS = [
    (1, "a"), (2, "a"), (2, "a"), (None, "a"), (3, None), (4, ""), (None, None), (5, "b" * 100_000), (6, "b" * 100_000), (6, "é"), (7, "é\n"), (None, "only null"), (None, "only null"),
]


def verdict(spark, rows, parts=1):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    p = digest_index.fingerprints(d.withColumn("digest", F.lit(1)).withColumn("place", F.lit("x")))
    index = DigestIndex(spark, tempfile.mkdtemp(prefix="digests-"))
    p = digest_index.add_in_turn(index, p, *([F.col("id") > 3] if parts > 1 else []))
    return [tuple(r) for r in digest_index.verdicts(p, index).select("id", "keep_id", "group_size", "kept", "text_sha256").collect()]


@pytest.mark.parametrize("parts", [1, 2])
def test_exact_dedup_on_awkward_rows(spark, parts):
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[t or ""].append(i)
    got = verdict(spark, TEXTS, parts)
    assert len(got) == len(TEXTS)
    sha = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    assert Counter((h, i) for i, _, _, _, h in got) == Counter((hashlib.sha256((t or "").encode()).hexdigest(), i) for i, t in TEXTS)
    assert all((keep, size) == sha[h] for _, keep, size, _, h in got)
    assert Counter((h, i) for i, _, _, kept, h in got if kept) == Counter((h, keep) for h, (keep, _) in sha.items())
    assert verdict(spark, []) == []


def test_hot_digest_is_split(spark):
    rows = [(i, "hot" if i % 3 else f"text {i // 6}") for i in range(6000)]
    got = verdict(spark, rows)
    assert sum(k for *_, k, _ in got) == 1001 and Counter(s for _, _, s, _, _ in got) == {4000: 4000, 2: 2000}


def test_index_persists_batches_and_compacts(spark):
    at = tempfile.mkdtemp(prefix="digests-")
    index = DigestIndex(spark, at, buckets=3)
    one = spark.createDataFrame([(1, "x", 0.5), (2, "y", 0.25), (3, "y", 0.75)], "doc_id long, text string, digest double")
    first = digest_index.keep_new(one, index)
    assert first.columns == one.columns and sorted(tuple(r) for r in first.collect()) == [(1, "x", 0.5), (3, "y", 0.75)]
    again = DigestIndex(spark, at)  # opened anew: its buckets come from its own record
    assert again.buckets == 3 and digest_index.keep_new(one, again).count() == 0
    more = spark.createDataFrame([(9, "y", 1.0), (4, "z", 2.0), (5, "x", 3.0)], "doc_id long, text string, digest double")
    assert [tuple(r) for r in digest_index.keep_new(more, again).collect()] == [(4, "z", 2.0)]
    again.compact()
    last = DigestIndex(spark, at)
    assert last.version == 1 and sorted(r["keep_id"] for r in last.entries().collect()) == [1, 3, 4]
    files = {r["f"] for r in last.entries().select(F.input_file_name().alias("f")).collect()}
    assert len(files) <= 3
    plan = one.select(F.unhex(F.sha2("text", 256)).alias("digest")).hint("merge").join(last.entries(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # the index side is not shuffled


# ---- ranked search ----

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans(lexical.UPPER, lexical.LOWER)


def ranked(docs, items, k=10):
    words = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    total, length = len(words), sum(c.total() for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in words:
            m = 10 + 90 * c.total() * total // length
            s = sum(int(np.floor(1000 * np.log((2.0 * total + 2) / (2.0 * df[t] + 1)))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOW))) if t in c)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


@pytest.mark.parametrize("shard, block", [(2_000_000, 65_536), (20, 3)])
def test_ranked_search_on_awkward_rows(spark, shard, block):
    docs = [(i, f"word{i % 5} Common ÉCOLE école {'x' * (i % 3)}, don't 3.14") for i in range(40)]
    docs += [(3, "word1 again"), (3, "word1 again"), (None, "word1 word2 null id"), (90, None), (91, ""), (92, "?! \n"), (93, "word3 " * 5000), (94, "Straße İ ſ 日本語 mixed_under\x00word4")]
    items = [(1, "WORD1 word2"), (1, "word3 ÉCOLE"), (2, None), (3, ""), (None, "straße 日本語 word4"), (4, "unknown"), (5, "common " * 300), (6, "3 14 t don")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("item", F.lit("a")).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1)).withColumn("doc_id", F.lit(1))
    got = Counter(tuple(r) for r in lexical.search(d, q, shard=shard, block=block).collect())
    assert got == ranked(docs, items)
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0


def test_ties_at_the_edge_go_by_id(spark):
    d = spark.createDataFrame([(i, "same words here") for i in range(50, 0, -1)], "doc_id long, text string").repartition(4)
    q = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert [r["doc_id"] for r in lexical.search(d, q, k=7, shard=9).orderBy("rank").collect()] == list(range(1, 8))
    assert lexical.best(np.array([3, 0, 5, 3, 3, -1]), 2).tolist() == [2, 0]


def test_terms_equal_the_pattern(spark, sf):
    for r in table(spark, sf, "documents").select("text").limit(50).collect():
        assert [w.decode() for w in lexical.terms(r["text"].encode())] == TERM.findall(r["text"].translate(LOW))


# ---- earlier operators: keys and ids of any form ----


def test_list_keys_differ_in_case_dot_and_port(spark):
    rows = [("Example.com", "add", "2024-01-01"), ("example.COM.", "remove", "2024-02-01"), ("Example.com:80/Shop", "add", "2024-01-05"), ("example.com/shop", "add", "2024-01-05"), ("example.com/shop", "remove", "2024-03-01")]
    listed = spark.createDataFrame(rows, "key string, action string, day string").withColumn("day", F.col("day").cast("date"))
    got = sorted((r["key"], str(r["since"]), str(r["until"])) for r in url_filters.intervals(listed).collect())
    assert got == [("example.com", "2024-01-01", "2024-02-01"), ("example.com/shop", "2024-01-05", "2024-03-01")]
    d = spark.createDataFrame([("http://EXAMPLE.com/", "2024-06-01"), ("http://example.com/shop/a", "2024-02-10")], "url string, fetched string").withColumn("fetched", F.col("fetched").cast("date"))
    assert [(r["allowed"], r["n_active"]) for r in url_filters.filter_urls(d, listed).orderBy("url").collect()] == [(True, 0), (False, 1)]


@pytest.mark.parametrize("dedup", [fm_index.dedup, suffix_levels.dedup])
def test_ids_that_are_no_numbers(spark, dedup):
    passage = " ".join(f"w{i}" for i in range(50))
    texts = [f"one {passage} end", f"two {passage} more", passage, None, "short", f"{passage} {passage}"]
    named = spark.createDataFrame([(f"doc {chr(97 + i)}", t) for i, t in enumerate(texts)] + [(None, "no id")], "doc_id string, text string")
    plain = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "no id")], "doc_id long, text string")
    what = lambda d: [(r["n_removed"], r["kept_sha256"]) for r in dedup(d).orderBy("doc_id").collect()]
    assert what(named) == what(plain)
    assert sum(n for n, _ in what(named)) > 0
