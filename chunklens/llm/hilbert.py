"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions by several seeded rotations, shifted, cut to a
grid and ordered along a Hilbert curve for each. Spark sorts the keys by ranges of
(curve, key, number) and numbers them, so that every vector has a place on each curve whatever partition it lies in. A curve is cut
into blocks of places; a query looks at its own block and those beside it that hold its window, so windows cross any edge. What all
windows of a query hold is merged and ranked by exact distance.

How wide windows have to be depends on the data: on clustered vectors a few places do, on isotropic ones in many dimensions a
share of all rows. So the width is fitted: for ``FIT`` queries, chosen by hash, the true neighbours are found in one pass over all rows,
and the width is what takes in ``RECALL`` of them on at least one curve. A width may be given instead; one of all places makes results exact.

Equal vectors are one class that keeps its k + 1 least ids, which is all that a query can
ask of it; so a vector that a third of all rows share costs no more than another one.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component
take no part; vectors of different sizes have no distance and don't find each other; null ids take no part; a query's own row
is left out, but not others with its id or its vector; fewer candidates than k give fewer rows; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators.etl import numbered
from ..session import ship
from .common import cut, table

K = 10
#: Curves, dimensions after projection, bits of a dimension, queries that the width is fitted on, share of their neighbours to take in, places of a block (least, most), salts of askers.
CURVES, DIMS, BITS, FIT, RECALL, BLOCK, SALT, SEED = 16, 12, 5, 64, 0.95, (64, 4096), 32, 11


def hilbert_key(x: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of grid points [n, dims], by Gray-code transposition."""
    x = x.astype(np.uint64).T.copy()
    dims = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > one:
        p = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[-1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(v: np.ndarray, spread: float) -> np.ndarray:
    """Keys of vectors [n, d] on every curve: [n, CURVES]; ``spread`` is the root mean square of a component, of which the grid holds three either way."""
    g = np.random.default_rng([SEED, v.shape[1]])
    out = []
    for _ in range(CURVES):
        basis, _r = np.linalg.qr(g.normal(size=(v.shape[1], min(DIMS, v.shape[1]))))
        y = v @ basis / max(spread, 1e-300) / 6 + g.uniform(-0.15, 0.15, basis.shape[1]) + 0.5
        out.append(hilbert_key(np.clip(y * (1 << BITS), 0, (1 << BITS) - 1), BITS))
    return np.stack(out, axis=1)


def usable(v: Column) -> Column:
    """True for a vector that can take part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _by_size(part: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = pc.list_value_length(part.column("v")).to_numpy()
    for n in np.unique(sizes):
        yield int(n), part.filter(pa.array(sizes == n))


def _on_curves(spread: dict[int, float]):
    """Class rows to (n, curve, key, cid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, part in _by_size(b):
                keys = curve_keys(_matrix(part.column("v")), spread[n])
                curve = np.tile(np.arange(CURVES, dtype=np.int32), part.num_rows)
                cid = np.repeat(part.column("cid").to_numpy(), CURVES)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cid), n, np.int32)), pa.array(curve), pa.array(keys.ravel()), pa.array(cid)], names=["n", "curve", "key", "cid"])

    return run


def _near(v: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows that can be among its k nearest, ties included, with their exact distances."""
    d2 = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * q @ v.T
    kth = np.partition(d2, k - 1, axis=1)[:, k - 1] if k < len(v) else np.full(len(q), np.inf)
    slack = 1e-9 * (1 + (q * q).sum(axis=1) + np.where(np.isinf(kth), 0, np.abs(kth)))
    for i in range(len(q)):
        near = np.flatnonzero(d2[i] <= kth[i] + slack[i])
        yield near, np.sqrt(((v[near] - q[i]) ** 2).sum(axis=1))


def _truth(sample: list[tuple[int, list[float]]], k: int):
    """Class rows to the k nearest classes of each sample query, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, part in _by_size(b):
                own = [(c, x) for c, x in sample if len(x) == n]
                if own:
                    cid = part.column("cid").to_numpy()
                    for (c, _), (near, d) in zip(own, _near(_matrix(part.column("v")), np.array([x for _, x in own], float), k + 1), strict=True):
                        rows += [(c, float(x), int(i)) for x, i in zip(d, cid[near], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], names=["qid", "score", "cid"])

    return run


def _windows(k: int):
    """A block's classes against the queries that look at it: (qid, score, vec_id, cid, j), j the number of a row in its class."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks = t["ask"].to_numpy(zero_copy_only=False)
        v = _matrix(t["v"].combine_chunks())
        cid, ids = t["cid"].to_numpy(), t["ids"].to_pylist()
        rows, place = [], np.flatnonzero(~asks)
        if len(place) and asks.any():
            for c, (near, d) in zip(cid[asks], _near(v[place], v[asks], k + 1), strict=True):
                found = sorted((float(x), i, int(cid[place[p]]), j) for x, p in zip(d, near, strict=True) for j, i in enumerate(ids[place[p]]))
                rows += [(int(c), *f) for f in found[: k + 1]]
        types = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
        return pa.table([pa.array([r[j] for r in rows], x) for j, x in enumerate(types)], names=["qid", "score", "vec_id", "cid", "j"])

    return run


def _least(found: DataFrame, k: int, *order: str) -> DataFrame:
    """The k least rows of each query; Spark limits groups before it shuffles them."""
    w = W.Window.partitionBy("qid").orderBy(*order)
    return found.distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def _width(classes: DataFrame, places: DataFrame, k: int) -> int:
    """Places that take in RECALL of the k nearest classes of FIT queries on some curve; all that comes to the driver are these."""
    sample = classes.where("is_query").orderBy(F.xxhash64("cid"), "cid").limit(FIT).select("cid", "v").collect()
    if not sample:
        return 1
    true = _least(classes.select("cid", "v").mapInArrow(_truth([tuple(r) for r in sample], k), "qid long, score double, cid long"), k + 1, "score", "cid").collect()
    wanted = classes.sparkSession.createDataFrame([(c,) for c in {r["cid"] for r in true} | {r["cid"] for r in sample}], "cid long")
    at = {r["cid"]: np.array([p["pos"] for p in r["places"]]) for r in places.join(F.broadcast(wanted), "cid").collect()}
    off = [int(np.abs(at[r["qid"]] - at[r["cid"]]).min()) for r in true if r["qid"] != r["cid"]]
    return int(np.quantile(off, RECALL, method="higher")) + 1 if off else 1


def search(vectors: DataFrame, queries: Column, k: int = K, vector: str = "embedding", vec_id: str = "vec_id", width: int | None = None) -> DataFrame:
    """The k nearest other rows of each row for which ``queries`` holds: query_id, rank, vec_id, score.

    width: places to either side on each curve that a query looks at, at least; fitted if not given.
    """
    spark = vectors.sparkSession
    ship(spark)
    d = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    d = d.where(F.col("id").isNotNull() & usable(F.col("v")))
    least = F.row_number().over(W.Window.partitionBy("v").orderBy("id"))
    classes = d.select("id", "v").withColumn("r", least).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = d.where("q").select(F.col("v").alias("_v")).distinct()
    classes = classes.join(asked, F.col("v") == F.col("_v"), "left").select("v", "ids", F.col("_v").isNotNull().alias("is_query"))
    classes = cut(classes).withColumn("cid", F.monotonically_increasing_id())  # the number of a written row, so it stays
    squares = F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")
    sizes = {r["n"]: r["s"] for r in classes.groupBy(F.size("v").alias("n")).agg((F.sum(squares) / F.count("*")).alias("s")).collect()}
    spread = {n: math.sqrt(s / n) for n, s in sizes.items()}
    placed = numbered(classes.select("cid", "v").mapInArrow(_on_curves(spread), "n int, curve int, key long, cid long"), "n", "curve", "key", "cid")
    first = placed.groupBy("n", "curve").agg(F.min("pos").alias("zero"), F.count("*").alias("rows"))
    placed = placed.join(first, ["n", "curve"]).select("cid", F.struct("curve", (F.col("pos") - F.col("zero")).alias("pos"), "rows").alias("p"))
    places = cut(placed.groupBy("cid").agg(F.sort_array(F.collect_list("p")).alias("places")))
    width = width or _width(classes, places, k)
    block = max(BLOCK[0], min(BLOCK[1], width))
    beside = math.ceil(width / block)
    rows = classes.join(places, "cid").select("cid", "v", "ids", "is_query", F.size("v").alias("n"), F.explode("places").alias("p"))
    rows = rows.select("cid", "v", "ids", "is_query", "n", "p.curve", F.floor(F.col("p.pos") / block).alias("block"), F.floor((F.col("p.rows") - 1) / block).alias("last"))
    look = F.explode(F.sequence(F.greatest(F.col("block") - beside, F.lit(0)), F.least(F.col("block") + beside, F.col("last"))))
    asks = rows.where("is_query").select("n", "curve", look.alias("block"), F.lit(True).alias("ask"), "cid", "v", F.array().cast("array<long>").alias("ids"))
    held = rows.select("n", "curve", "block", F.lit(False).alias("ask"), "cid", "v", "ids")
    found = held.unionByName(asks).groupBy("n", "curve", "block").applyInArrow(_windows(k), "qid long, score double, vec_id long, cid long, j int")
    found = _least(found, k + 1, "score", "vec_id", "cid", "j").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id", "cid", "j"))).alias("hits"))
    # many rows may ask with one vector: they are dealt over salts
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    own = classes.where("is_query").select("v", F.col("cid").alias("_cid"))
    own = own.join(found, own["_cid"] == found["qid"]).select(F.col("v").alias("_v"), "qid", "hits", salts.alias("_salt"))
    wanted = d.where("q").select(F.col("id").alias("query_id"), "v", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int").alias("salt"))
    out = wanted.join(own, (F.col("v") == F.col("_v")) & (F.col("salt") == F.col("_salt")))
    out = out.withColumn("me", F.array_position(F.transform("hits", lambda h: (h["cid"] == F.col("qid")) & (h["vec_id"] == F.col("query_id"))), F.lit(True)))
    out = out.withColumn("hits", F.slice(F.filter("hits", lambda h, i: F.col("me").isNull() | (i + 1 != F.col("me"))), 1, k))
    out = out.select("query_id", F.posexplode("hits").alias("at", "h"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "h.vec_id", "h.score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors of every vector whose id is divisible by 100."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op4_nearest_neighbours": op4_nearest_neighbours}
ORACLES: dict[str, str] = {}
