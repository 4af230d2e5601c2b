"""Near-duplicate detection by order MinHash.

The k-mers of a text are its five-word shingles, each labelled with its occurrence
number. A sketch hashes all of them, takes the ``TAKE`` least, and keeps these in the
order of the text, so that it is sensitive to edits and moves; texts that share one of
``SKETCHES`` sketches are candidates. Labels hide what a text and the same text with a
passage pasted again have in common, so each text also has as many unordered sketches of its
different shingles, whose buckets count if a member repeats any. A candidate pair is verified by aligning the two
sequences of labelled shingles inside a diagonal band: similarity is the number of
different shingles in the longest common chain, over the different shingles of both.
Labelled shingles are unique in a text, so the alignment is a longest
increasing chain of matched positions; where that isn't enough and shingles repeat, any
occurrence may match any. Similarity is 0.8 or more by default, at which
a sketch is shared with probability of about 0.8 ** TAKE and a pair is missed with
about (1 - 0.8 ** TAKE) ** SKETCHES.

Equal word sequences are collapsed first. A bucket of a sketch links each member to
its first, its hub, never all pairs. In a bucket that then holds several classes, members outside
its most common class meet those of other classes, in blocks of ``SMALL`` members by as many; so
every pair of a bucket is in one class or verified. The blocks of a bucket are members outside its
most common class times members: with n texts that share a passage but aren't alike, n^2 counts of
common shingles. Classes are connected components by alternating star steps.

Edge cases: a text of fewer than five words is one shingle; texts without words (null
or empty) are classes of their own; rows with equal text are in one class, also with
equal or null ids; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import ship
from .common import cut, table, tidy
from .repeats import Kind, _gram_hash, mix

#: Words of a shingle, least similarity, sketches and shingles of a sketch.
SHINGLE, SIMILARITY, SKETCHES, TAKE = 5, 0.8, 16, 3
#: Members of a block of a bucket that is left over; one of so few ends in one task.
SMALL = 256
#: Bits of the table that an alignment of texts with repeated shingles keeps.
TABLE = 1 << 29
#: Hashes that are worked on at once; rows whose texts are.
AT_ONCE, ROWS = 1 << 18, 200
_U = np.uint64
_WORDS = Kind(True, SHINGLE, SHINGLE)
_SEEDS = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def grams(data: bytes) -> np.ndarray:
    """Hashes of the shingles of a text, in its order."""
    x = _WORDS.tokens(data)
    if not len(x):
        return x
    if len(x) < SHINGLE:
        return mix(np.bitwise_xor.reduce(mix(x + np.arange(len(x), dtype=_U)), keepdims=True))
    return _gram_hash(x, SHINGLE)


def label(h: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence number mixed in, so that all differ."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return h
    at = np.arange(len(h))
    first = np.maximum.accumulate(np.where(np.append(True, ~same), at, 0))
    number = np.empty(len(h), _U)
    number[order] = (at - first).astype(_U)
    return np.where(number > 0, mix(h + number * _U(0xD6E8FEB86659FD93)), h)


def sketches(h: np.ndarray, number: int = SKETCHES, take: int = TAKE) -> np.ndarray:
    """The ``take`` least shingles under the hash of each sketch, in text order; all of a shorter text."""
    if len(h) <= take:
        return np.tile(h, (number, 1))
    out = np.empty((number, take), _U)
    step = max(1, min(number, AT_ONCE // len(h)))  # of a very long text one sketch after the other
    for k in range(0, number, step):
        own = slice(k, min(k + step, number))
        y = (h[None, :] ^ _SEEDS[own, None]) * (_SEEDS[number + own.start : number + own.stop, None] | _U(1))
        y ^= y >> _U(29)
        out[own] = h[np.sort(np.argpartition(y, take - 1, axis=1)[:, :take], axis=1)]
    return out


def sketch_keys(h: np.ndarray) -> tuple[list[int], bool]:
    """One hash for each ordered sketch of the labelled shingles, one for each unordered sketch of the different ones; whether any repeats."""
    x = label(h)
    ordered = sketches(x)
    different = sketches(np.unique(h)) if (repeats := x is not h) else ordered
    out = []
    for pick in (ordered, np.sort(different, axis=1)):
        key = _SEEDS[: len(pick)].copy()
        for j in range(pick.shape[1]):
            key = mix(key * _U(0x9E3779B97F4A7C15) + pick[:, j])
        out += key.view(np.int64).tolist()
    return out, repeats


def longest_chain(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Positions in ``x`` of a longest common subsequence of two arrays, where any occurrence may match any.

    Rows of the table are bits of an integer (a zero where the length grows) and are kept to walk
    back; a table too large for that is halved at the best place of ``y``, as Hirschberg has it.
    """
    n, every = len(y), (1 << len(y)) - 1

    def rows(x: list, y: list) -> Iterator[int]:
        where: dict = {}
        for j, c in enumerate(y):
            where.setdefault(c, []).append(j)
        masks: dict = {}
        for c, at in where.items():
            bits = np.zeros(n, np.uint8)
            bits[at] = 1
            masks[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        v = every
        for c in x:
            u = v & masks.get(c, 0)
            v = ((v + u) | (v - u)) & every
            yield v

    def lengths(v: int) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(v.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]
        return np.append(0, np.cumsum(1 - bits.astype(np.int64)))

    if not len(x) or not n:
        return []
    p, q = x.tolist(), y.tolist()
    if len(p) > 1 and len(p) * n > TABLE:
        half, v, w = len(p) // 2, every, every
        for v in rows(p[:half], q):
            pass
        for w in rows(p[half:][::-1], q[::-1]):
            pass
        k = int(np.argmax(lengths(v) + lengths(w)[::-1]))
        return longest_chain(x[:half], y[:k]) + [half + i for i in longest_chain(x[half:], y[k:])]
    table_ = [every, *rows(p, q)]
    i, j, chain = len(p), n, []
    while i and j:
        if table_[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if table_[i] >> (j - 1) & 1:
                chain.append(i)
                j -= 1
    return chain[::-1]


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Different shingles in the longest common chain of two texts, over the different shingles of both; 0 if it can't reach ``least``.

    The band allows as many unmatched shingles as the threshold does; texts that repeat
    shingles, where the number of places says little, are aligned without a band, and if
    occurrences of the same number don't reach ``least``, any occurrence may match any.
    """
    x, y = label(a), label(b)
    na, nb = len(np.unique(a)), len(np.unique(b))
    need = least * (na + nb) / (1 + least)  # shingles in common at this similarity
    if min(na, nb) < need - 1e-9:
        return 0.0
    order = np.argsort(y)
    place = order[np.minimum(np.searchsorted(y, x, sorter=order), len(y) - 1)]
    hit = np.flatnonzero(y[place] == x)
    place = place[hit]
    if na == len(a) and nb == len(b):
        near = np.abs(place - hit) <= na + nb - 2 * need + 1
        hit, place = hit[near], place[near]
    if not (np.diff(place) > 0).all():
        import bisect

        ends: list[int] = []
        back, last = np.zeros(len(place), np.int64), []
        for i, p in enumerate(place.tolist()):
            k = bisect.bisect_left(ends, p)
            back[i] = last[k - 1] if k else -1
            ends[k : k + 1] = [p]
            last[k : k + 1] = [i]
        chain, i = [], last[-1] if last else -1
        while i >= 0:
            chain.append(i)
            i = int(back[i])
        hit = hit[chain]
    common = len(np.unique(a[hit]))
    if common < need - 1e-9 and (na < len(a) or nb < len(b)):
        both = np.intersect1d(a, b)
        if len(both) >= need - 1e-9:
            p = a[np.isin(a, both)]
            common = max(common, len(np.unique(p[longest_chain(p, b[np.isin(b, both)])])))
    return common / (na + nb - common)


def _number(data: bytes) -> tuple[int, bytes]:
    """A 62-bit number of the words of a text, the same in every run and task, and the words joined by blanks."""
    words = b" ".join(data.split())
    return int.from_bytes(hashlib.sha256(words).digest()[:8], "big") >> 2, words


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(o, text) to (o, r, keys, repeats); texts without words have none of these."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            numbers, keys, repeats = [], [], []
            for t in part.column(1).to_pylist():
                r, words = _number(t or b"")
                numbers.append(r if words else None)
                own, twice = sketch_keys(grams(words)) if words else (None, None)
                keys.append(own)
                repeats.append(twice)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(numbers, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(repeats, pa.bool_())], names=["o", "r", "keys", "repeats"])


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r, text) to (r, grams) where r is the text's number: ids may repeat."""
    for batch in batches:
        out = [(r, (grams(words) >> _U(32)).astype(np.uint32).tobytes()) for r, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for own, words in [_number(t.as_py() or b"")] if own == r]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([g for _, g in out], pa.binary())], names=["r", "grams"])


def _stored(b: bytes) -> np.ndarray:
    """Shingles as they are kept for verification, by the upper halves of their hashes."""
    return np.frombuffer(b, np.uint32).astype(_U)


def _finish(least: float):
    """The members that ask are aligned with those told, unless they are of one class already, also by links found here; two that ask once."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("r")
        all_ = [(r, _stored(g)) for r, g in zip(t["r"].to_pylist(), t["grams"].to_pylist(), strict=True)]
        each = [np.unique(x) for _, x in all_]
        size = np.array([len(x) for x in each])
        start = np.cumsum(size) - size
        shingles, flat = np.unique(np.concatenate(each), return_inverse=True)
        mark = np.zeros(len(shingles), np.int64)
        found, root = [], t["root"].to_numpy().copy()
        at, told, ask = np.arange(len(each)), t["told"].to_numpy(), t["ask"].to_numpy()
        for i in np.flatnonzero(ask):
            # different shingles in common with every other member: what an alignment can't exceed
            own = flat[start[i] : start[i] + size[i]]
            mark[own] = 1
            common = np.add.reduceat(mark[flat], start)
            mark[own] = 0
            for k in np.flatnonzero((common >= least * (size + size[i] - common) - 1e-9) & told & (~ask | (at > i))):
                if root[k] != root[i] and (s := similarity(all_[i][1], all_[k][1], least)) >= least:
                    found.append((min(all_[i][0], all_[k][0]), max(all_[i][0], all_[k][0]), s))
                    root[root == root[k]] = root[i]
        return pa.table([pa.array([f[j] for f in found], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [similarity(_stored(p.as_py()), _stored(q.as_py()), least) for p, q in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (r, root): the least number of each connected component, by large-star and small-star steps.

    Each step keeps only (larger, smaller) edges to least neighbours; the sum of the
    smaller ends and the number of edges, both single numbers, tell when nothing moves.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u")
        e = e.select("u", F.col("m").alias("v")).unionByName(e.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = cut(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("r"), F.col("v").alias("root"))
        before = now


def classes(df: DataFrame, text: str = "text", order: str = "doc_id", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of the rows of ``df``.

    Returns (rows, members, links). rows has (o, r) for each row: its order value and the number of its words, null
    without words; members has (r, root, leader, links) for each different text, where leader is the least order value
    of the class; links has the verified pairs (a, b, similarity) of texts.
    """
    ship(df.sparkSession)
    d = df.select(F.col(f"`{order}`").alias("o"), F.col(f"`{text}`").cast("binary").alias("t"))
    sk = cut(d.mapInArrow(tidy(_sketch_rows), f"o {dict(d.dtypes)['o']}, r long, keys array<long>, repeats boolean"))
    firsts = sk.where("r IS NOT NULL").groupBy("r").agg(F.min("o").alias("o"), F.any_value("keys").alias("keys"), F.any_value("repeats").alias("repeats"))
    firsts = cut(firsts)
    bucket = _buckets(firsts)
    wanted = cut(firsts.join(bucket.select("r").distinct(), "r", "left_semi").select("r", F.col("o").alias("_o")))
    # by sort and merge at any size: a broadcast of these ids would grow with the corpus
    texts = d.join(wanted.hint("merge"), F.col("o").eqNullSafe(F.col("_o"))).select("r", "t")
    gram_rows = cut(texts.mapInArrow(tidy(_gram_rows), "r long, grams binary"))
    if gram_rows.count() > wanted.count():  # rows that repeat with their ids
        gram_rows = cut(gram_rows.groupBy("r").agg(F.any_value("grams").alias("grams")))
    members, links = _link(bucket, gram_rows, firsts.select("r", "o"), least)
    return sk.select("o", "r"), members, links


def _buckets(keyed: DataFrame) -> DataFrame:
    """(k, key, r, hub) of the buckets with two members or more; the hub is the least member.

    Unordered sketches serve for texts that repeat shingles: of theirs, buckets without such a member are left to the ordered ones.
    """
    d = keyed.select("r", "repeats", F.posexplode("keys").alias("k", "key"))
    size = d.groupBy("k", "key").agg(F.count("*").alias("n"), F.min("r").alias("hub"), F.max("repeats").alias("repeats")).where(f"n > 1 AND (k < {SKETCHES} OR repeats)").drop("repeats")
    return cut(d.join(size, ["k", "key"]).select("k", "key", "r", "hub"))


def _link(bucket: DataFrame, gram_rows: DataFrame, firsts: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Verify members of buckets against hubs, then those of different classes against each other; then find the components."""
    star = bucket.where("r <> hub").select(F.col("hub").alias("a"), F.col("r").alias("b")).distinct()
    pairs = star.join(gram_rows.select(F.col("r").alias("a"), F.col("grams").alias("x")), "a").join(gram_rows.select(F.col("r").alias("b"), F.col("grams").alias("y")), "b")
    tried = cut(pairs.select("a", "b", "x", "y").mapInArrow(tidy(_verify(least)), "a long, b long, similarity double"))
    star = tried.where(F.col("similarity") >= least)
    # a bucket is settled when its members are of one class; else those outside its most common class meet all others
    rest = bucket.join(components(star), "r", "left").withColumn("root", F.coalesce("root", "r"))
    size = rest.groupBy("k", "key", "root").agg(F.count("*").alias("n"), F.sum(F.xxhash64("r").cast("decimal(38,0)")).alias("s"))
    size = size.groupBy("k", "key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("classes")).where("classes > 1 AND n > 2")
    # of buckets with the same members one does
    one = size.groupBy("n", "s").agg(F.min(F.struct("k", "key", F.col("most.root").alias("most"), (F.col("n") - F.col("most.n")).alias("m"))).alias("c")).select("c.*", "n")
    rest = rest.join(one, ["k", "key"]).withColumn("open", F.col("root") != F.col("most"))
    # pairs of blocks, of open members with open ones or with the others; a bucket of few members is one block
    count = lambda n: F.ceil(F.col(n) / SMALL).cast("int")
    whole = F.col("n") <= SMALL
    rest = rest.withColumn("_m", F.when(whole, 1).otherwise(count("m"))).withColumn("_n", F.when(whole, 1).otherwise(F.col("_m") + F.ceil((F.col("n") - F.col("m")) / SMALL).cast("int")))
    deal = lambda n: F.pmod(F.xxhash64("r"), n).cast("int")
    rest = rest.withColumn("_own", F.when(whole, 0).when(F.col("open"), deal(F.col("_m"))).otherwise(F.col("_m") + deal(F.col("_n") - F.col("_m"))))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("open"), F.col("_n")).otherwise(F.col("_m")) - 1))
    rest = rest.withColumn("_other", other).withColumn("q", F.least("_own", "_other")).withColumn("d", F.greatest("_own", "_other"))
    rest = rest.select("k", "key", "q", "d", "r", "root", (F.col("open") & (F.col("_own") == F.col("q"))).alias("ask"), (F.col("_own") == F.col("d")).alias("told"))
    few = rest.join(gram_rows, "r").groupBy("k", "key", "q", "d").applyInArrow(_finish(least), "a long, b long, similarity double")
    links = cut(star.unionByName(few).groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    root = components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("r")).groupBy("r").agg(F.count("*").alias("links"))
    m = firsts.join(root, "r", "left").withColumn("root", F.coalesce("root", "r")).join(ends, "r", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    leader = m.groupBy("root").agg(F.min("o").alias("leader"))
    return m.join(leader, "root"), links


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``df``: its id, ``class_id`` (the least id of its class), ``n_links`` of its text, ``representative``.

    A row without words is its own class; its class_id is its id.
    """
    rows, members, _ = classes(df, text, doc_id, least)
    d = rows.join(members.select("r", "leader", "links"), "r", "left")
    leader = F.when(F.col("r").isNull(), F.col("o")).otherwise(F.col("leader"))
    return d.select(
        F.col("o").alias(doc_id), leader.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("o").eqNullSafe(leader).alias("representative")
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the rows of least doc_id, and of these one; rows without words stay.

    Rows that agree in doc_id (repeated or null ids) are told apart by the number of their text.
    """
    rows, members, _ = classes(docs)
    own = rows.join(members.select("r", "leader", "root"), "r", "left").where(F.col("r").isNull() | F.col("o").eqNullSafe(F.col("leader")))
    chosen = own.where("r IS NOT NULL").groupBy("root").agg(F.min(F.struct("o", "r")).alias("c")).select("c.o", "c.r")
    chosen = chosen.unionByName(own.where("r IS NULL").select("o", "r").distinct())
    # one exchange of the texts: the join and the window share their keys, and the number is taken before it
    key = lambda o, r: (F.coalesce(o.cast("string"), F.lit("")).alias("_ko"), o.isNull().alias("_kn"), F.coalesce(r, F.lit(-1)).alias("_kr"))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *key(F.col("doc_id"), number(F.col("text").cast("binary"))))
    d = d.join(chosen.select(*key(F.col("o"), F.col("r"))), ["_ko", "_kn", "_kr"])
    first = F.row_number().over(W.Window.partitionBy("_ko", "_kn", "_kr").orderBy(F.col("_row.text")))
    return d.withColumn("_n", first).where("_n = 1 OR _kr < 0").select("_row.*")


def number(t):
    """The number of the words of a binary text, null without words, as ``_number`` has it."""
    from .common import words

    w = words(t.cast("string"))
    head = F.conv(F.substring(F.sha2(F.array_join(w, " "), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.when(F.size(w) > 0, F.floor(head / 4).cast("long"))


QUERIES = {"op7_minhash_near_dedup": op7_minhash_near_dedup}
ORACLES: dict[str, str] = {}
