"""Hard negatives of anchors by dual-tree search over whole-number inner products.

Anchors and candidates are written as blocks of at most ``BLOCK`` rows. For a block of each, a tree splits the
rows by label first and then at the widest gap in the middle half of the dimension that varies most. A pair of nodes has an interval of inner
products, the narrower of what boxes and balls give, and stands for all its anchors at once: it is dropped when no
anchor below could still use a product in the interval, or when the labels rule it out. What is left is a list of pairs of
leaves, most promising first, that are scored exactly unless a bound has risen meanwhile. A task keeps the best rows of its anchors
over all candidate blocks that it sees, so bounds rise from block to block, and emits them once; the tasks' lists are merged.

The same search runs twice: for the positives (same label, the k greatest), and for the negatives (other label, the k
greatest inside the window that each positive sets). Candidates never leave the task that reads their blocks, and no label is
gathered anywhere, so a label that a third of all rows have costs no more than others.

Edge cases: rows with a null id, label or vector or a component that is null or not finite take no part; vectors of
different sizes are filled up with zeros; a row is never its own positive, but another row with its id may be; equal scores go by id, then
by row; a positive with a negative score has no window, thus no negatives; fewer rows than k give fewer; scores
outside 64 bits are held at their ends; an empty table gives an empty result; other columns are ignored. Labels
that are not whole numbers are told apart by their 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import ship
from .common import cut, table

#: Positives of an anchor and negatives of a positive, rows of a block, rows of a leaf of anchors and of candidates.
K, BLOCK, LEAVES = 5, 8192, (32, 128)
#: Components are multiplied by this and rounded down.
SCALE = 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Tree:
    """Nodes over rows, children after their parent; rows are put in the order of the leaves."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, leaf: int):
        order, spans, self.children = np.arange(len(vectors)), [(0, len(vectors))], []
        real = vectors.astype(np.float64)
        for b, e in spans:  # grows while it is walked
            if e - b <= leaf:
                self.children.append((-1, -1))
                continue
            own = order[b:e]
            kinds = labels[own]
            if kinds.min() != kinds.max():
                own = own[np.argsort(kinds, kind="stable")]
                edges = np.flatnonzero(np.diff(labels[own])) + 1
                middle = int(edges[np.argmin(np.abs(edges - len(own) // 2))])
            else:
                along = real[own, np.argmax(real[own].var(axis=0))]
                by = np.argsort(along, kind="stable")
                own, quarter = own[by], len(own) // 4
                middle = quarter + 1 + int(np.argmax(np.diff(along[by])[quarter : len(own) - quarter - 1]))
            order[b:e] = own
            self.children.append((len(spans), len(spans) + 1))
            spans += [(b, b + middle), (b + middle, e)]
        self.order, self.vectors, self.labels = order, vectors[order], labels[order]
        self.children, self.spans = np.array(self.children), np.array(spans)
        real = real[order]
        part = [real[b:e] for b, e in spans]
        self.low, self.high = np.stack([x.min(axis=0) for x in part]), np.stack([x.max(axis=0) for x in part])
        self.centre = np.stack([x.mean(axis=0) for x in part])
        self.radius = np.array([np.sqrt(((x - c) ** 2).sum(axis=1)).max() for x, c in zip(part, self.centre, strict=True)])
        self.length = np.sqrt((self.centre**2).sum(axis=1))
        #: The label of all rows of a node, and whether there is one.
        self.label = self.labels[self.spans[:, 0]]
        self.pure = np.array([(self.labels[b:e] == self.labels[b]).all() for b, e in spans])
        self.size = float(np.sqrt((real**2).sum(axis=1)).max())
        self.leaves = np.flatnonzero(self.children[:, 0] < 0)


def interval(a: Tree, i: np.ndarray, c: Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product between rows of nodes i of one tree and j of another, a little widened."""
    sides = np.stack([x * y for x in (a.low[i], a.high[i]) for y in (c.low[j], c.high[j])])
    middle = np.einsum("pd,pd->p", a.centre[i], c.centre[j])
    reach = a.radius[i] * c.length[j] + c.radius[j] * a.length[i] + a.radius[i] * c.radius[j]
    slack = 1 + 1e-9 * a.size * c.size
    return np.maximum(sides.min(axis=0).sum(axis=1), middle - reach) - slack, np.minimum(sides.max(axis=0).sum(axis=1), middle + reach) + slack


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, held in 64 bits."""
    most = [max((abs(int(f(x))) for f in (np.min, np.max)), default=0) if x.size else 0 for x in (a, c)]
    bound = most[0] * most[1] * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound <= MOST:
        return a @ c.T
    return np.clip(a.astype(object) @ c.astype(object).T, LEAST, MOST).astype(np.int64)


class Wanted:
    """What the anchors of a tree ask for: requests by anchor, each for the k greatest products from low to high."""

    def __init__(self, tree: Tree, places: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        back = np.empty(len(tree.order), np.int64)
        back[tree.order] = np.arange(len(tree.order))
        self.given = np.argsort(back[anchor], kind="stable")  # requests in the order of the leaves
        self.tree, self.places, self.k, self.same = tree, places[tree.order], k, same
        self.anchor, self.low, self.high = back[anchor][self.given], low[self.given], high[self.given]
        self.score = np.full((len(low), k), LEAST)
        self.vec_id, self.place = np.full((len(low), k), MOST), np.full((len(low), k), -1)
        self.span = np.searchsorted(self.anchor, tree.spans)
        self.scored = 0

    def need(self) -> np.ndarray:
        """For each request the least product that it could still use."""
        return np.maximum(self.low, self.score[:, -1])

    def search(self, c: Tree, ids: np.ndarray, places: np.ndarray) -> None:
        """Take in the rows of a candidate tree."""
        a, seen = self.tree, set()
        first, upper = a.leaves, c.leaves
        near = a.centre[first] @ c.centre[upper].T
        near[~self._labels(c, *np.meshgrid(first, upper, indexing="ij"))] = -np.inf
        for i, row in zip(first.tolist(), near, strict=True):  # one leaf for each, so that there are bounds to prune with
            j = int(upper[np.argmax(row)])
            if row.max() > -np.inf and self.span[i, 0] < self.span[i, 1]:
                seen.add((i, j))
                self._leaf(i, c, j, ids, places)
        need, found = self.need(), []
        asks = [slice(b, e) for b, e in self.span]
        least = np.array([need[s].min() if s.start < s.stop else MOST for s in asks]).astype(np.float64)
        most = np.array([self.high[s].max() if s.start < s.stop else LEAST for s in asks]).astype(np.float64)
        i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(i):
            low, high = interval(a, i, c, j)
            # a float of a number near 2^63 may be off by a thousand, so bounds count with one relative step to spare
            go = (high >= least[i] - np.abs(least[i]) * 1e-15) & (low <= most[i] + np.abs(most[i]) * 1e-15) & (least[i] < MOST) & self._labels(c, i, j)
            i, j = i[go], j[go]
            ends = (a.children[i, 0] < 0) & (c.children[j, 0] < 0)
            found.append(np.stack([i[ends], j[ends]]))
            i, j = i[~ends], j[~ends]
            left = [np.where(t.children[x, :1] < 0, x[:, None], t.children[x]) for t, x in ((a, i), (c, j))]
            pairs = np.stack([np.repeat(left[0], 2, axis=1).ravel(), np.tile(left[1], 2).ravel()])
            i, j = np.unique(pairs, axis=1)  # a leaf has itself for both children
        i, j = np.concatenate(found, axis=1)
        low, high = interval(a, i, c, j)
        # products near the top of the windows first, since they raise the bounds most
        order = np.argsort(np.abs((low + high) / 2 - np.minimum(most[i], high)), kind="stable")
        for x, y, lo, hi in zip(i[order].tolist(), j[order].tolist(), low[order].tolist(), high[order].tolist(), strict=True):
            own = asks[x]
            need, limit = np.maximum(self.low[own], self.score[own, -1]), self.high[own]
            if (x, y) not in seen and ((hi >= need - np.abs(need) * 1e-15) & (lo <= limit + np.abs(limit) * 1e-15)).any():
                self._leaf(x, c, y, ids, places)

    def _labels(self, c: Tree, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether labels allow a pair of nodes; mixed nodes are always allowed."""
        equal = self.tree.label[i] == c.label[j]
        return ~(self.tree.pure[i] & c.pure[j]) | (equal if self.same else ~equal)

    def _leaf(self, i: int, c: Tree, j: int, ids: np.ndarray, places: np.ndarray) -> None:
        a, own = self.tree, slice(*self.span[i])
        rows, cols = slice(*a.spans[i]), slice(*c.spans[j])
        every = products(a.vectors[rows], c.vectors[cols])
        self.scored += every.size
        at = self.anchor[own] - rows.start
        score = every[at]
        fits = (score >= self.need()[own, None]) & (score <= self.high[own, None])
        fits &= (a.labels[rows][at][:, None] == c.labels[cols]) == self.same
        fits &= self.places[rows][at][:, None] != places[cols]
        r, k = np.nonzero(fits)
        if not len(r):
            return
        touched = np.unique(r)
        old, slot = np.nonzero(self.place[own][touched] >= 0)
        before = touched[old]
        row = np.concatenate([before, r])
        s = np.concatenate([self.score[own][before, slot], score[r, k]])
        v, p = np.concatenate([self.vec_id[own][before, slot], ids[cols][k]]), np.concatenate([self.place[own][before, slot], places[cols][k]])
        order = np.lexsort((p, v, ~s, row))
        row, s, v, p = row[order], s[order], v[order], p[order]
        number = np.arange(len(row)) - np.searchsorted(row, row)
        top = number < self.k
        to = (own.start + row[top], number[top])
        self.score[to], self.vec_id[to], self.place[to] = s[top], v[top], p[top]


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(n, -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, vec_id, label, q, asks) to blocks; vectors as one binary, filled up with zeros."""
    rows: list[dict] = []

    def block() -> pa.RecordBatch:
        size = max((len(r["q"]) for r in rows), default=0) or 1
        data = np.array([r["q"] + [0] * (size - len(r["q"])) for r in rows], np.int64).tobytes()
        asks = [(i, *(a[c] for c in ("number", "low", "high"))) for i, r in enumerate(rows) for a in r["asks"] or []]
        lists = [[r[c] for r in rows] for c in ("place", "vec_id", "label")] + [[a[x] for a in asks] for x in range(4)]
        return pa.RecordBatch.from_arrays([pa.array([data]), *(pa.array([x], pa.list_(pa.int64())) for x in lists)], names=["q", "place", "vec_id", "label", "anchor", "number", "low", "high"])

    for b in batches:
        for r in b.to_pylist():
            rows.append(r)
            if len(rows) == BLOCK:
                yield block()
                rows = []
    if rows:
        yield block()


_BLOCK = "q binary, place array<long>, vec_id array<long>, label array<long>, anchor array<long>, number array<long>, low array<long>, high array<long>"


def _pairs(k: int, same: bool):
    """Pairs of blocks (candidates, anchors) to (anchor, number, score, vec_id, place), once for all that a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple[Wanted, np.ndarray, np.ndarray]] = {}
        last, tree, ids, places = None, None, None, None
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c: b.column(c)[r].values.to_numpy()  # noqa: B023, E731
                mine = get("a_place")
                if last != (now := b.column("place")[r].values[0].as_py()):
                    last, places = now, get("place")
                    tree = Tree(_matrix(b.column("q")[r].as_py(), len(places)), get("label"), LEAVES[1])
                    ids, places = get("vec_id")[tree.order], places[tree.order]
                if mine[0] not in asked:
                    anchors = Tree(_matrix(b.column("a_q")[r].as_py(), len(mine)), get("a_label"), LEAVES[0])
                    w = Wanted(anchors, mine, get("a_anchor"), get("a_low"), get("a_high"), k, same)
                    asked[mine[0]] = (w, mine[get("a_anchor")][w.given], get("a_number")[w.given])
                widen(asked[mine[0]][0].tree, tree)
                asked[mine[0]][0].search(tree, ids, places)
        for w, anchor, number in asked.values():
            at, slot = np.nonzero(w.place >= 0)
            cols = [anchor[at], number[at], w.score[at, slot], w.vec_id[at, slot], w.place[at, slot]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["anchor", "number", "score", "vec_id", "place"])

    return run


def widen(*trees: Tree) -> None:
    """Give all trees as many dimensions as the widest has."""
    size = max(t.vectors.shape[1] for t in trees)
    for t in trees:
        if (more := size - t.vectors.shape[1]) > 0:
            for name in ("vectors", "low", "high", "centre"):
                setattr(t, name, np.pad(getattr(t, name), ((0, 0), (0, more))))


def _best(candidates: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, number, score, vec_id, rank) of the k greatest for each request of rows (place, vec_id, label, q, asks)."""
    n = rows.count()
    anchors = cut(rows.repartitionByRange(max(1, math.ceil(n / BLOCK)), "label", "place").mapInArrow(_blocks, _BLOCK))
    anchors = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    # the stated set of anchors in blocks against all candidate blocks; which side is sent to the other is left to its size
    found = candidates.crossJoin(anchors).mapInArrow(_pairs(k, same), "anchor long, number long, score long, vec_id long, place long")
    w = W.Window.partitionBy("anchor", "number").orderBy(F.desc("score"), "vec_id", "place")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, label: Column, k: int = K, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """For each row for which ``anchors`` holds, its k positives, and for each the k greatest products with rows of other labels
    from 80 % to 100 % of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    ship(spark)
    d = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), label.alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    if dict(d.dtypes)["label"] not in ("tinyint", "smallint", "int", "bigint"):
        d = d.withColumn("label", F.when(F.col("label").isNotNull(), F.xxhash64("label")))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    d = d.withColumn("q", F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))).drop("v").withColumn("label", F.col("label").cast("long"))
    d = cut(d.withColumn("place", F.monotonically_increasing_id()))
    ask = "array<struct<number:long,low:long,high:long>>"
    row = lambda x: ("place", "vec_id", "label", "q", x.alias("asks"))
    candidates = cut(d.select(*row(F.lit(None).cast(ask))).mapInArrow(_blocks, _BLOCK)).select("q", "place", "vec_id", "label")
    own = d.where("asks")
    every = F.array(F.struct(F.lit(0).cast("long").alias("number"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    positives = _best(candidates, own.select(*row(every)), k, True)
    positives = cut(positives.select("anchor", F.col("rank").cast("long").alias("number"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")))
    window = F.struct("number", F.expr("positive_score - positive_score div 5").alias("low"), F.col("positive_score").alias("high"))
    asks = positives.where("positive_score >= 0").groupBy(F.col("anchor").alias("place")).agg(F.collect_list(window).alias("_asks"))
    found = _best(candidates, own.join(asks, "place").select(*row(F.col("_asks"))), k, False)
    found = found.select("anchor", "number", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = own.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = found.join(positives, ["anchor", "number"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 100; the label of every seventh is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {
    "op11_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.q, c.q)::BIGINT AS score FROM e AS a JOIN e AS c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
}
