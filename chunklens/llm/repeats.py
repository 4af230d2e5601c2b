"""Finding windows of tokens that occur more than once, over blocks and buckets.

A window is ``length`` consecutive tokens (words or bytes) of one text. Its anchor
is the least hash of its ``gram``-token substrings: equal windows have equal
anchors, so they can meet by anchor. Work goes in five steps, all over groups of
bounded size:

1. texts are dealt by hash into blocks; a block sends each anchor hash with the
   number of its places, once, to the bucket of that hash;
2. buckets add the numbers up and tell the blocks which anchors have two places or more;
3. blocks cut out the text around those anchors, as runs of windows with one anchor,
   and send each different run once, with its number and first place, to buckets.
   An anchor with more than ``HOT`` places sends single windows instead, dealt by the
   hash of the window, so that a passage that many documents share fills no bucket;
4. buckets index the runs, by the method of the operator, and tell the blocks which
   windows repeat;
5. blocks mark the tokens that those windows cover.

Steps 1, 3 and 5 read one shuffle of the texts (Spark reuses the exchange).
Words and runs are known by 64-bit hashes; runs go to the index as 32-bit tokens.

A block holds rows in the order of (doc_id, text), nulls first. Equal rows are
told apart by that order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.etl import numbered
from ..session import ship
from .common import input_bytes, tidy_groups, tidy_pairs

#: Input bytes (as stored) of a block and of a bucket; tokens worked on at once; places of an anchor beyond which single windows are sent.
BLOCK_BYTES, BUCKET_BYTES, PIECE, HOT = 2_500_000, 5_000_000, 1 << 18, 2000
#: Input bytes of a task at most.
TASK_BYTES = 128_000_000

_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
#: Base of the polynomial hashes, odd, and its inverse by 2 ** 64.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of base by 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.ones(max(n, 1), _U)
        p[1:] = _U(base)
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def spans_hash(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of x[start:end] for each span; equal spans have equal hashes wherever they are."""
    sums = np.zeros(len(x) + 1, _U)
    np.cumsum(x * _power(_BASE, len(x)), out=sums[1:])
    h = (sums[end] - sums[start]) * _power(_INVERSE, len(x) + 1)[start]
    return mix(h + (end - start).astype(_U) * _GOLD)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(1, 257, dtype=_U) * _GOLD)


def split_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edge[::2], edge[1::2]


@dataclass(frozen=True)
class Kind:
    """What a window is made of."""

    words: bool
    length: int
    gram: int
    hot: int = HOT

    def tokens(self, data: bytes) -> np.ndarray:
        """64-bit hashes of the tokens of a text."""
        x = _BYTE[np.frombuffer(data, np.uint8)]
        if not self.words or not len(x):
            return x if not self.words else np.zeros(0, _U)
        out = []
        step = 4 << 20
        start, end = split_words(data)
        at = 0
        while at < len(start):  # spans of bytes that hold whole words
            upto = max(at + 1, int(np.searchsorted(end, start[at] + step)))
            lo = int(start[at])
            out.append(spans_hash(x[lo : int(end[upto - 1])], start[at:upto] - lo, end[at:upto] - lo))
            at = upto
        return np.concatenate(out) if out else np.zeros(0, _U)


@dataclass
class Runs:
    """Runs of windows with one anchor: text number, first token, number of windows, anchor, hash of the run's tokens."""

    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))


def _gram_hash(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive tokens, by doubling."""
    have, h, size = None, x, 1
    done = 0
    while True:
        if k & size:
            have = h if have is None else have[: len(have) - size] * _U(_BASE) + h[done : done + len(have) - size]
            done += size
            if done == k:
                return mix(have) | _U(1)
        h = h[:-size] * _M1 + (h[size:] ^ _U(size))
        size *= 2


def _sliding(x: np.ndarray, w: int, op: Callable) -> np.ndarray:
    """op over every w consecutive values."""
    size = 1
    while size * 2 <= w:
        x = op(x[:-size], x[size:])
        size *= 2
    return x if size == w else op(x[: len(x) - (w - size)], x[w - size :])


def find_runs(kind: Kind, texts: list[np.ndarray]) -> Runs:
    """All runs of all texts. Long texts are done in overlapping pieces, short ones together; results don't depend on it."""
    L, parts = kind.length, []
    pending: list[tuple[int, int, np.ndarray]] = []
    held = 0
    for i, x in enumerate(texts):
        if len(x) < L:
            continue
        for at in range(0, len(x) - L + 1, PIECE):
            piece = x[at : at + PIECE + L - 1]
            pending.append((i, at, piece))
            held += len(piece)
            if held >= PIECE:
                parts.append(_runs(kind, pending))
                pending, held = [], 0
    if pending:
        parts.append(_runs(kind, pending))
    if not parts:
        z = np.zeros(0, np.int64)
        return Runs(z, z, z, np.zeros(0, _U), np.zeros(0, _U))
    return Runs(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("text", "start", "count", "anchor", "content", "places")])


def _runs(kind: Kind, pieces: list[tuple[int, int, np.ndarray]]) -> Runs:
    L, W = kind.length, kind.length - kind.gram + 1
    x = np.concatenate([p for _, _, p in pieces])
    sizes = np.array([len(p) for _, _, p in pieces])
    ends = np.cumsum(sizes)
    g = _gram_hash(x, kind.gram)
    least = _sliding(g, W, np.minimum)  # of the window that starts here
    owner = np.repeat(np.arange(len(pieces)), sizes)[: len(least)]
    valid = np.arange(len(least)) + L <= ends[owner]
    shown = np.where(valid, least, _U(0))
    wide = np.zeros(len(g) + W - 1, _U)
    wide[W - 1 : W - 1 + len(shown)] = shown
    place = np.flatnonzero(_sliding(wide, W, np.maximum) == g)
    # runs: same anchor, same piece, at most W windows
    edge = np.ones(len(least), bool)
    edge[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(edge)
    length = np.diff(np.append(first, len(least)))
    if (long := length > W).any():
        n = np.where(long, -(-length // W), 1)
        base = np.repeat(first, n)
        step = np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
        first = base + step * W
        length = np.minimum(W, np.repeat(length, n) - step * W)
    keep = valid[first]
    first, length = first[keep], length[keep]
    own = owner[first]
    begin = (ends - sizes)[own]
    return Runs(
        np.array([t for t, _, _ in pieces])[own], first - begin + np.array([a for _, a, _ in pieces])[own], length, least[first],
        spans_hash(x, first, first + length - 1 + L), g[place],
    )


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] values, then the same from start[1], ..."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


@dataclass
class Segments:
    """Different runs of a bucket, sorted by (key, first place); tokens of run i are token[offset[i]:offset[i + 1]]."""

    key: np.ndarray
    number: np.ndarray
    windows: np.ndarray
    offset: np.ndarray
    token: np.ndarray


#: An index takes segments and returns a flag for each of their windows.
Index = Callable[[Kind, Segments], np.ndarray]

_COLUMNS = ("key", "hot", "content", "number", "windows", "doc", "row", "start", "token")
_TYPES = {"key": _U, "hot": _U, "content": _U, "number": np.int64, "windows": np.int32, "doc": np.int64, "row": np.int32, "start": np.int32}
_REPLY = ("full", "full_hot", "first_row", "first_start", "row", "start", "end")
_REPLY_TYPES = {"full": _U, "full_hot": _U, "first_row": np.int64, "first_start": np.int64, "row": np.int64, "start": np.int64, "end": np.int64}


def _pack(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _order(table: pa.Table) -> pa.Table:
    """Rows of a block in the order of (doc_id, text), nulls first."""
    return table.take(pc.sort_indices(table, sort_keys=[("__id", "ascending"), ("__text", "ascending")], null_placement="at_start"))


def _texts(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table["__text"].to_pylist()]


def _dup_anchors(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted anchors that repeat, and those of them that are hot."""
    got = [np.frombuffer(b, _U) for b in right["dup"].to_pylist()]
    hot = [np.frombuffer(b, _U) for b in right["hot"].to_pylist()]
    cat = lambda a: np.sort(np.concatenate(a)) if a else np.zeros(0, _U)
    return cat(got), cat(hot)


def _first_pass(kind: Kind, buckets: int, table: pa.Table) -> pa.Table:
    bid = table["__block"][0].as_py()
    anchors, n = [], []
    runs = find_runs(kind, [kind.tokens(t) for t in _texts(table)])
    anchors, n = np.unique(runs.places, return_counts=True)
    to = (anchors >> _U(1)) % _U(buckets)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1).astype(_U))
    rows = [{"bucket": b, "bid": bid, "anchor": anchors[order[i:j]].tobytes(), "n": n[order[i:j]].astype(np.int64).tobytes()} for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
    return _pack(_SENT, rows)


_SENT = pa.schema([("bucket", pa.int64()), ("bid", pa.int64()), ("anchor", pa.binary()), ("n", pa.binary())])
_DUP = pa.schema([("bid", pa.int64()), ("dup", pa.binary()), ("hot", pa.binary())])


def _count(kind: Kind, table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(b, _U) for b in table["anchor"].to_pylist()]
    number = [np.frombuffer(b, np.int64) for b in table["n"].to_pylist()]
    values, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(number))
    dup, hot = values[total >= 2], values[total > kind.hot]
    rows = []
    for bid, own in zip(table["bid"].to_pylist(), parts, strict=True):
        if len(mine := own[_in(own, dup)]):
            rows.append({"bid": bid, "dup": mine.tobytes(), "hot": mine[_in(mine, hot)].tobytes()})
    return _pack(_DUP, rows)


_RUNS = pa.schema([("bucket", pa.int64()), ("bid", pa.int64()), *[(c, pa.binary()) for c in _COLUMNS]])


def _send_runs(kind: Kind, buckets: int, left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return _pack(_RUNS, [])
    left = _order(left)
    bid = left["__block"][0].as_py()
    dup, hot = _dup_anchors(right)
    tokens = [kind.tokens(t) for t in _texts(left)]
    r = find_runs(kind, tokens)
    keep = _in(r.anchor, dup)
    text, start, count, anchor, content = (a[keep] for a in (r.text, r.start, r.count, r.anchor, r.content))
    key, is_hot = anchor, _in(anchor, hot)
    if is_hot.any():
        size = count[is_hot]
        t1, s1 = np.repeat(text[is_hot], size), _ragged(start[is_hot], size)
        h1 = _windows_hash(kind, tokens, t1, s1)
        cold = ~is_hot
        zero = np.zeros(int(cold.sum()), _U)
        text, start, count = np.concatenate([text[cold], t1]), np.concatenate([start[cold], s1]), np.concatenate([count[cold], np.ones(len(t1), count.dtype)])
        key, content, mark = np.concatenate([key[cold], h1]), np.concatenate([content[cold], h1]), np.concatenate([zero, np.repeat(anchor[is_hot], size)])
        order = np.lexsort((start, text))
        text, start, count, key, content, mark = (a[order] for a in (text, start, count, key, content, mark))
    else:
        mark = np.zeros(len(text), _U)
    _, first, number = np.unique(content, return_index=True, return_counts=True)
    to = ((key[first] >> _U(1)) % _U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    first, number, to = first[order], number[order], to[order]
    ids = np.array([_low if i is None else i for i in left["__id"].to_pylist()], np.int64)
    offset = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
    flat = np.concatenate(tokens)
    flat = (flat >> _U(32)).astype(np.uint32) if kind.words else np.frombuffer(b"".join(_texts(left)), np.uint8)
    cuts = np.searchsorted(to, np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(cuts)):
        f = first[cuts[b] : cuts[b + 1]]
        size = count[f] - 1 + kind.length
        out = {
            "key": key[f], "hot": mark[f], "content": content[f], "number": number[cuts[b] : cuts[b + 1]], "windows": count[f], "doc": ids[text[f]],
            "row": text[f], "start": start[f],
        }
        rows.append({"bucket": int(b), "bid": bid, "token": flat[_ragged(offset[text[f]] + start[f], size)].tobytes()} | {c: np.ascontiguousarray(v).astype(_TYPES[c]).tobytes() for c, v in out.items()})
    return _pack(_RUNS, rows)


_low = -(1 << 63)


def _windows_hash(kind: Kind, tokens: list[np.ndarray], text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of single windows; text numbers must come in groups."""
    out = np.zeros(len(text), _U)
    if not len(text):
        return out
    edge = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    for i, j in zip(edge, np.append(edge[1:], len(text)), strict=True):
        s = start[i:j]
        lo, hi = int(s.min()), int(s.max()) + kind.length
        out[i:j] = spans_hash(tokens[text[i]][lo:hi], s - lo, s - lo + kind.length)
    return out


_REPLIES = pa.schema([("bid", pa.int64()), *[(c, pa.binary()) for c in _REPLY]])


def _judge(kind: Kind, index: Index, keep_first: bool, tokens_at_once: int, table: pa.Table) -> pa.Table:
    """Index the different runs of a bucket, some keys at a time, and tell each block about its own.

    Runs that occur once, or with keep_first the first of each, get a flag for each window;
    all others repeat as a whole.
    """
    col = {c: [np.frombuffer(b, _TYPES[c]) for b in table[c].to_pylist()] for c in _TYPES}
    each = [len(k) for k in col["key"]]
    bid = np.repeat(np.array(table["bid"].to_pylist(), np.int64), each)
    a = {c: np.concatenate(v) for c, v in col.items()}
    flat = np.concatenate([np.frombuffer(b, np.uint32 if kind.words else np.uint8) for b in table["token"].to_pylist()])
    size = a["windows"].astype(np.int64) - 1 + kind.length
    offset = np.cumsum(size) - size
    order = np.lexsort((a["start"], a["row"], bid, a["doc"], a["content"], a["key"]))
    same = np.zeros(len(order), bool)
    same[1:] = (a["key"][order][1:] == a["key"][order][:-1]) & (a["content"][order][1:] == a["content"][order][:-1])
    group = np.cumsum(~same) - 1
    lead = order[~same]  # first place of each different run
    number = np.bincount(group, weights=a["number"][order]).astype(np.int64)
    # by key, then by first place
    rank = np.lexsort((a["start"][lead], a["row"][lead], bid[lead], a["doc"][lead], a["key"][lead]))
    flags: list[np.ndarray] = [np.zeros(0, bool)] * len(lead)
    edge = np.flatnonzero(np.append(True, a["key"][lead[rank]][1:] != a["key"][lead[rank]][:-1]))
    edge = np.append(edge, len(rank))
    total = np.append(0, np.cumsum(size[lead[rank]]))
    i = 0
    while i + 1 < len(edge):
        j = max(i + 1, int(np.searchsorted(total[edge], total[edge[i]] + tokens_at_once, "right")) - 1)
        pick = rank[edge[i] : edge[j]]
        own = lead[pick]
        off = np.append(0, np.cumsum(size[own]))
        got = index(kind, Segments(a["key"][own], number[pick], a["windows"][own].astype(np.int64), off, flat[_ragged(offset[own], size[own])]))
        for p, f in zip(pick, np.split(got, np.cumsum(a["windows"][own])[:-1]), strict=True):
            flags[p] = f
        i = j
    # replies
    out: dict[int, dict[str, list]] = {}
    reply = lambda b: out.setdefault(int(b), {c: [] for c in _REPLY})
    for e, gi in zip(order, group, strict=True):
        first = lead[gi]
        whole = number[gi] > 1 if not keep_first else e != first or a["number"][e] > 1
        if not keep_first and not flags[gi].all():
            whole = False  # runs that only share a hash: what the index found counts
        if whole:
            r = reply(bid[e])
            r["full"].append(a["content"][e])
            r["full_hot"].append(a["hot"][e])
            mine = keep_first and e == first
            r["first_row"].append(a["row"][e] if mine else -1)
            r["first_start"].append(a["start"][e] if mine else -1)
        if (keep_first and e == first or not keep_first and not whole) and flags[gi].any():
            f = np.flatnonzero(np.diff(np.concatenate(([0], flags[gi].view(np.int8), [0]))))
            r = reply(bid[e])
            r["row"] += [a["row"][e]] * (len(f) // 2)
            r["start"] += (a["start"][e] + f[::2]).tolist()
            r["end"] += (a["start"][e] + f[1::2] - 1 + kind.length).tolist()
    return _pack(_REPLIES, [{"bid": b} | {c: np.array(v, _REPLY_TYPES[c]).tobytes() for c, v in r.items()} for b, r in out.items()])


def _covered(kind: Kind, left: pa.Table, right: pa.Table) -> list[np.ndarray]:
    """For each row of a block, in order, which of its tokens repeated windows cover."""
    tokens = [kind.tokens(t) for t in _texts(left)]
    size = np.array([len(t) for t in tokens])
    base = np.cumsum(size + 1) - (size + 1)
    change = np.zeros(int((size + 1).sum()) + 1, np.int32)
    if right.num_rows:
        got = {c: np.concatenate([np.frombuffer(b, _REPLY_TYPES[c]) for b in right[c].to_pylist()]) for c in _REPLY}

        def mark(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
            np.add.at(change, base[text] + start, 1)
            np.add.at(change, base[text] + end, -1)

        mark(got["row"], got["start"], got["end"])
        r = find_runs(kind, tokens)
        cold, hot = got["full_hot"] == 0, got["full_hot"] != 0
        first = {(int(a), int(b)) for a, b in zip(got["first_row"], got["first_start"], strict=True) if a >= 0}

        def others(text: np.ndarray, start: np.ndarray) -> np.ndarray:
            return np.array([(int(t), int(s)) not in first for t, s in zip(text, start, strict=True)], bool) if first else np.ones(len(text), bool)

        pick = _in(r.content, np.sort(got["full"][cold]))
        t, s, n = r.text[pick], r.start[pick], r.count[pick]
        o = others(t, s)
        mark(t[o], s[o], s[o] + n[o] - 1 + kind.length)
        if hot.any():
            pick = _in(r.anchor, np.unique(got["full_hot"][hot]))
            t, s = np.repeat(r.text[pick], r.count[pick]), _ragged(r.start[pick], r.count[pick])
            h = _in(_windows_hash(kind, tokens, t, s), np.sort(got["full"][hot]))
            t, s = t[h], s[h]
            o = others(t, s)
            mark(t[o], s[o], s[o] + kind.length)
    depth = np.cumsum(change)
    return [depth[b : b + n] > 0 for b, n in zip(base, size, strict=True)]


def _nullable(t: pa.DataType) -> pa.DataType:
    """A type whose fields, at any depth, may be null, as a schema string has it."""
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, _nullable(f.type), True) for f in t])
    if pa.types.is_list(t):
        return pa.list_(pa.field(t.value_field.name, _nullable(t.value_type), True))
    if pa.types.is_map(t):
        return pa.map_(t.key_type, pa.field(t.item_field.name, _nullable(t.item_type), True))
    return t


def repeated(df: DataFrame, kind: Kind, index: Index, text: str, doc_id: str, keep_first: bool, tokens_at_once: int, finish: Callable[[bytes, np.ndarray], dict], schema: dict[str, str]) -> DataFrame:
    """All columns but the text, with what ``finish`` makes of each text's bytes and its mask of covered tokens.

    keep_first: the first place of a window, by doc_id and then by position, is not covered.
    """
    rest = [c for c in df.columns if c not in (text, *schema)]
    d = df.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__rest") if rest else F.lit(0).alias("__rest"),
        F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").cast("binary").alias("__text"),
    )
    if dict(d.dtypes)["__id"] not in ("tinyint", "smallint", "int", "bigint"):  # other ids by their rank
        ranks = numbered(d.where("__id is not null").select(F.col("__id").alias("__known")).distinct(), "__known")
        d = d.join(ranks, F.col("__id") == F.col("__known"), "left").withColumn("__id", F.col("pos")).drop("__known", "pos")
    d = d.withColumn("__id", F.col("__id").cast("long"))
    size = input_bytes(df, text)
    blocks, buckets = max(1, math.ceil(size / BLOCK_BYTES)), max(1, math.ceil(size / BUCKET_BYTES))
    d = d.withColumn("__block", F.pmod(F.xxhash64("__id", "__text"), F.lit(blocks)))
    # tasks by the input, or more if the session asks for more; blocks and buckets of a task are done one after the other
    tasks = max(math.ceil(size / TASK_BYTES), int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = d.repartition(min(blocks, tasks), "__block")
    ship(df.sparkSession)
    # all three passes read d itself: the same exchange, which Spark reuses
    sent = d.groupBy("__block").applyInArrow(tidy_groups(lambda t: _first_pass(kind, buckets, t)), "bucket long, bid long, anchor binary, n binary")
    dup = sent.repartition(min(buckets, tasks), "bucket").groupBy("bucket").applyInArrow(tidy_groups(lambda t: _count(kind, t)), "bid long, dup binary, hot binary")
    cols = ", ".join(f"{c} binary" for c in _COLUMNS)
    runs = d.groupBy("__block").cogroup(dup.groupBy("bid")).applyInArrow(tidy_pairs(lambda a, b: _send_runs(kind, buckets, a, b)), f"bucket long, bid long, {cols}")
    replies = runs.repartition(min(buckets, tasks), "bucket").groupBy("bucket").applyInArrow(tidy_groups(lambda t: _judge(kind, index, keep_first, tokens_at_once, t)), "bid long, " + ", ".join(f"{c} binary" for c in _REPLY))
    out_schema = ", ".join([f"`__rest` {dict(d.dtypes)['__rest']}"] + [f"`{c}` {t}" for c, t in schema.items()])
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<struct<start:long,end:long>>": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _order(left)
        made = [finish(t, m) for t, m in zip(_texts(left), _covered(kind, left, right), strict=True)]
        return pa.table([left["__rest"].cast(_nullable(left["__rest"].type)), *[pa.array([m[c] for m in made], arrow[t]) for c, t in schema.items()]], names=["__rest", *schema])

    out = d.groupBy("__block").cogroup(replies.groupBy("bid")).applyInArrow(tidy_pairs(last), out_schema)
    return out.select(*([F.col(f"__rest.`{c}`") for c in rest]), *[F.col(f"`{c}`") for c in schema])


def mask_runs(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    """Maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)
