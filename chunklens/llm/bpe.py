"""Byte-level BPE encoding and decoding with recursive DuckDB queries.

Each partition splits its texts at single blanks between other characters, where
the public pattern always splits, and looks up every chunk in a cache. New chunks are
split by the pattern; a text with other blanks is split by the pattern as a whole.
Pieces that are new go to an in-memory DuckDB: a piece that is a token
itself gets that id; the others start as the tokens of their bytes, and a recursive query
lays out one row for each token and position, joins the rows with the merge table and contracts
each piece's leftmost pair of least rank until no piece has a pair. Decoding knows ids only: different
sequences of ids are joined with the vocabulary, and an ordered aggregation by position gives their bytes; a
text is decoded from the sequences that its ids consist of. Pieces never cross
texts, so texts of any length are done piece by piece.

A piece of more than ``LONG`` bytes is encoded in windows of ``WIDTH`` bytes that overlap by half. A sequence of
tokens is the encoding of its bytes if every two neighbours are that of theirs, so two windows are joined at a token that
both have at one place; where they have none, a window that begins at a token of the first takes the place of the second. Time
is then in proportion to the length.

The caches of chunks, of pieces and of decoded sequences hold two generations of at most about ``CACHE``
entries each, so memory does not grow with the corpus; what was dropped is encoded again. Between tasks, when the worker may serve
other stages, a codec closes its database and keeps its caches as one string each.

Edge cases: null text is empty and has no tokens; repeated rows each keep a row;
an empty table gives an empty result; the longest of texts are held one at a time.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import marshal
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import pack, table, unpack

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of a cache generation; characters of a round of texts; bytes of pieces, or tokens, of one query; contractions of one query.
CACHE, ROUND_CHARS, QUERY_BYTES, DEPTH = 150_000, 1 << 20, 600_000, 32
#: Bytes beyond which a piece is encoded in windows, and of a window.
LONG, WIDTH = 256, 128

_STEP = """
WITH RECURSIVE st AS (
  SELECT w, 0 AS it, t FROM init
  UNION ALL
  (WITH best AS (
     SELECT w, min(r::BIGINT * 4294967296 + pos) AS b
     FROM (SELECT w, unnest(range(1, len(t))) AS pos, unnest(t[:-2]) AS tok, unnest(t[2:]) AS nt FROM st WHERE it < {depth}) JOIN merges ON k = tok::BIGINT * 65536 + nt GROUP BY w)
   SELECT st.w, it + 1, t[:b % 4294967296 - 1] || [(b // 4294967296)::INTEGER] || t[b % 4294967296 + 2:] FROM st JOIN best ON st.w = best.w))
SELECT w, max(it) AS it, arg_max(t, it) AS t FROM st GROUP BY w
"""
# bytes as characters of the same numbers, as DuckDB joins text only
_DECODE = "SELECT s, array_to_string(list(chars ORDER BY pos), '') AS chars FROM tokens JOIN vocab ON vocab.id = tok GROUP BY s"


class Codec:
    """Encodes pieces and decodes ids in DuckDB and keeps what it has met lately."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = {r: len(token) for token, r in self.ranks.items()}
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a * 65536 + b)
                    rank.append(r)
        self.merges = pa.table({"k": pa.array(left, pa.int64()), "r": pa.array(rank, pa.int32())})
        self.vocab = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "chars": pa.array([t.decode("latin-1") for t in self.ranks], pa.string())})
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        #: Ids joined by commas of a piece or chunk; bytes of ids joined by commas.
        self.pieces, self.chunks, self.decoded = Generations(), Generations(), Generations()
        self.db = None
        self.wake()

    def wake(self) -> None:
        """Make ready for a task."""
        import duckdb

        if self.db is None:
            self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
            self.db.register("m", self.merges)
            self.db.register("v", self.vocab)
            self.db.execute("CREATE TABLE merges AS SELECT * FROM m; CREATE TABLE vocab AS SELECT * FROM v")
            for g in (self.pieces, self.chunks, self.decoded):
                g.unpack()

    def sleep(self) -> None:
        """Give memory back until the next task."""
        import ctypes

        if self.db is not None:
            self.db.close()
            self.db = None
            for g in (self.pieces, self.chunks, self.decoded):
                g.pack()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it has
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    def _final(self, parts: list[bytes]) -> list[str]:
        """Ids of byte strings: contract to the fixpoint; a query stops after DEPTH contractions, strings that may go on go into the next."""
        ends = np.cumsum([0, *map(len, parts)])
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.byte[np.frombuffer(b"".join(parts), np.uint8)]))
        rows = pa.table({"w": pa.array(np.arange(len(parts), dtype=np.int32)), "t": tokens})
        out = [""] * len(parts)
        while rows.num_rows:
            self.db.register("init", rows)
            got = self.db.sql(_STEP.format(depth=DEPTH)).to_arrow_table()
            open_ = pc.equal(got["it"], DEPTH)
            done = got.filter(pc.invert(open_))
            joined = pc.binary_join(done["t"].cast(pa.list_(pa.string())), ",")
            for w, ids in zip(done["w"].to_pylist(), joined.to_pylist(), strict=True):
                out[w] = ids
            rows = got.filter(open_).select(["w", "t"])
        return out

    def _contract(self, parts: list[bytes]) -> list[str]:
        """Ids of byte strings, some at a time."""
        out, first, size = [], 0, 0
        for k, b in enumerate(parts):
            size += len(b)
            if size > QUERY_BYTES or k + 1 == len(parts):
                out += self._final(parts[first : k + 1])
                first, size = k + 1, 0
        return out

    def _encode(self, pieces: list[str]) -> None:
        """Add pieces to the cache."""
        ids = self.pieces.known
        rest = []
        for p in pieces:
            if (i := self.ranks.get(b := p.encode())) is not None:
                ids[p] = str(i)
            elif len(b) > LONG:
                ids[p] = self._long(b)
            else:
                rest.append((p, b))
        ids.update(zip([p for p, _ in rest], self._contract([b for _, b in rest]), strict=True))

    def _long(self, data: bytes) -> str:
        """Ids of a piece of any length, from windows that are joined at tokens that two of them share."""
        step = WIDTH // 2
        cuts = [data[at : at + WIDTH] for at in range(0, len(data) - step, step)]
        different = list(dict.fromkeys(cuts))
        known = dict(zip(different, self._contract(different), strict=True))

        def tokens(at: int, part: bytes) -> list[tuple[int, int]]:
            """(place, id) of each token of a window."""
            if part not in known:
                known[part] = self._contract([part])[0]
            out = []
            for i in map(int, known[part].split(",")):
                out.append((at, i))
                at += self.size[i]
            return out

        out, end = tokens(0, cuts[0]), len(cuts[0])
        while end < len(data):
            at = max(end - step, 0)
            tail = len(out)
            while tail > 1 and out[tail - 1][0] >= at:
                tail -= 1
            # a window at a fixed place, which other places may share; else one that begins at a token, and longer ones
            k = -(-at // step) * step
            for start, width in ((k, WIDTH), *((out[tail - 1][0], WIDTH << j) for j in range(1, 40))):
                more = tokens(start, data[start : start + width])
                ours = {t: n for n, t in enumerate(out[tail - 1 :], tail - 1)}
                met = [(ours[t], n) for n, t in enumerate(more) if t in ours]
                if met and start + width > end:
                    n, j = met[len(met) // 2]
                    out[n:] = more[j:]
                    end = min(len(data), start + width)
                    break
        return ",".join([str(i) for _, i in out])

    def _decode(self, sequences: set[str]) -> None:
        """Add the bytes of sequences of ids to the cache, by an ordered aggregation of their tokens."""
        new, first, size = self.decoded.missing(sequences), 0, 0
        number = [s.count(",") + 1 for s in new]
        known = self.decoded.known
        for k, n in enumerate(number):
            size += n
            if size > QUERY_BYTES or k + 1 == len(new):
                count = np.array(number[first : k + 1])
                s = np.repeat(np.arange(len(count), dtype=np.int32), count)
                pos = np.arange(size) - np.repeat(np.cumsum(count) - count, count)
                self.db.register("tokens", pa.table({"s": s, "pos": pos.astype(np.int32), "tok": np.fromstring(",".join(new[first : k + 1]), np.int32, sep=",")}))
                got = self.db.sql(_DECODE).to_arrow_table()
                for at, c in zip(got["s"].to_pylist(), got["chars"].to_pylist(), strict=True):
                    known[new[first + at]] = c.encode("latin-1")
                first, size = k + 1, 0

    def _learn_pieces(self, pieces: set[str]) -> None:
        if new := self.pieces.missing(pieces):
            self._encode(new)

    def _learn_chunks(self, chunks: set[str]) -> None:
        """A chunk stands for itself after a blank; one that begins or ends with white space, or is empty, is odd."""
        new = self.chunks.missing(chunks)
        self.odd = {c for c in new if not c or c[0].isspace() or c[-1].isspace()}  # never cached
        if not (new := [c for c in new if c not in self.odd] if self.odd else new):
            return
        # all at once: a blank, which no chunk holds, begins the first piece of each
        split = self.find(" " + " ".join(new))
        self._learn_pieces(set(split))
        one = self.pieces.known
        joined = "".join([("\n" if p[0] == " " else ",") + one[p] for p in split])
        self.chunks.known.update(zip(new, joined[1:].split("\n"), strict=True))

    def texts(self, texts: list[str]) -> Iterator[tuple[str, bytes, int]]:
        """For each text its ids joined by commas, the bytes they decode to, and their number."""
        split = [t.split(" ") for t in texts]
        heads = [cs.pop(0) for cs in split]
        self._learn_chunks(set().union(*split))
        for k, (t, cs) in enumerate(zip(texts, split, strict=True)):
            h = heads[k]
            if cs and (not h or h[-1].isspace() or self.odd and not self.odd.isdisjoint(cs)):
                split[k], heads[k] = [], t
        first = [self.find(h) for h in heads]
        self._learn_pieces(set().union(*first))
        piece, chunk = self.pieces.known.__getitem__, self.chunks.known.__getitem__
        sequences = [[*map(piece, ps), *map(chunk, cs)] for ps, cs in zip(first, split, strict=True)]
        self._decode(set().union(*sequences))
        decoded = self.decoded.known.__getitem__
        for own in sequences:
            i = ",".join(own)
            yield i, b"".join(map(decoded, own)), i.count(",") + 1 if i else 0


class Generations:
    """What is known by string; what has not been asked for since the last turn is dropped."""

    def __init__(self):
        self.known: dict = {}
        self.before: dict = {}
        self.packed = b""

    def pack(self) -> None:
        self.packed, self.known, self.before = marshal.dumps((self.known, self.before)), {}, {}

    def unpack(self) -> None:
        if self.packed:
            self.known, self.before = marshal.loads(self.packed)
            self.packed = b""

    def missing(self, keys: set[str]) -> list[str]:
        """Keys in neither generation; all others are in the present one afterwards."""
        if len(self.known) > CACHE:
            self.before, self.known = self.known, {}
        new = keys.difference(self.known)
        old = new.intersection(self.before)
        self.known.update(zip(old, map(self.before.__getitem__, old), strict=True))
        return list(new - old)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of this process, ready for a task."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    _codecs[path, pattern].wake()
    return _codecs[path, pattern]


def _rounds(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Some texts at a time, about ``ROUND_CHARS`` characters; only these are read from the source."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size > ROUND_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _numbers(ids: list[str]) -> pa.Array:
    """Lists of ids from texts with commas, without an object for each."""
    full = [i for i in ids if i]
    flat = np.fromstring(",".join(full), np.int32, sep=",") if full else np.zeros(0, np.int32)
    count = [i.count(",") + 1 if i else 0 for i in ids]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(flat))


def transcode(df: DataFrame, path: str, pattern: str, text: str = "text", emit: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """All columns but the text, with ``n_tokens`` and what ``emit`` names: ``ids`` (array), ``decoded`` (binary), or the hex digests ``ids_sha256`` and ``decoded_sha256``.

    Added columns take the place of columns of the same name.
    """
    added = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    names = ["n_tokens", *emit]
    sql = {"n_tokens": "long", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
    d, keep = pack(df, text, names)
    schema = ", ".join([f"__rest {dict(d.dtypes)['__rest']}"] + [f"{c} {sql[c]}" for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        try:
            yield from rows(own, batches)
        finally:
            own.sleep()

    def rows(own: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            where = batch.schema.get_field_index("__text")
            for part in _rounds(t.as_py() for t in batch.column(where)):
                out: dict[str, list] = {c: [] for c in names}
                for ids, decoded, n in own.texts(part):
                    out["n_tokens"].append(n)
                    for c in emit:
                        out[c].append(ids if c == "ids" else decoded if c == "decoded" else hashlib.sha256(ids.encode() if c == "ids_sha256" else decoded).hexdigest())
                rest = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [c for k, c in enumerate(rest.columns) if k != where] + [_numbers(out[c]) if c == "ids" else pa.array(out[c], added[c]) for c in names],
                    names=[c for c in rest.schema.names if c != "__text"] + names,
                )

    ship(df.sparkSession)
    return unpack(d.mapInArrow(run, schema), keep, names)


def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return transcode(docs, *_public(), emit=("ids_sha256", "decoded_sha256"))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its ids; the text is what the ids decode to.

    ``n_tokens`` and ``token_ids`` take the place of columns of these names.
    """
    own = [c for c in docs.columns if c not in ("text", "n_tokens", "token_ids")]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), "text")
    d = transcode(d, *_public(), emit=("ids", "decoded"))
    return d.select("_row.*", F.col("decoded").cast("string").alias("text"), "n_tokens", F.col("ids").alias("token_ids"))


QUERIES = {"op6_bpe_roundtrip": op6_bpe_roundtrip}
ORACLES: dict[str, str] = {}
