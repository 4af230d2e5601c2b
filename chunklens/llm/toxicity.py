"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are trained: one on words that toxic rows favour, one on ordinary
text. A window is one word between blanks (of a long word, pieces that overlap by the
longest word that toxic rows favour), set in a fixed carrier that both
dictionaries hold, so that even short windows are compressed rather than stored.
The distance of a window is its compressed length with the ordinary dictionary less
that with the toxic one. A text's largest distance and its counts of windows at or
above thresholds go through a logistic function calibrated on other training rows.

Learning takes a bounded, hash-chosen sample of labelled rows (``PER_LABEL``; of
each text at most ``WORDS`` words, spread over it) to the driver; of these at most twice as many rows are taken
where ids repeat; the ordinary dictionary
trains on the first ``SAMPLE`` bytes of each of these. Scoring reads
whole texts; distances of words are cached up to ``CACHE`` words.

Edge cases: null or empty text has no window and gets the calibrated score of none;
rows with a null id or label aren't learned from; without both labels every score is
0; of repeated labels for an id the largest counts; repeated rows each keep a row;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import pack, table, unpack

#: Bounds of the training sample: rows of each label (toxic, ordinary), words of a row.
PER_LABEL, WORDS = (2400, 6000), 700
#: A word is favoured by toxic rows if this share of them has it, this many times the share of ordinary rows.
LEAST_SHARE, FAVOUR = 0.012, 10.0
#: Bytes of the dictionaries; compression level; bytes of a piece of a long word; distance thresholds; cached words.
TOXIC_DICT, ORDINARY_DICT, LEVEL, PIECE, THRESHOLDS, CACHE = 3072, 112_640, 9, 48, (3, 4, 5), 250_000
#: First bytes of an ordinary row, words spread over it, that train the dictionary.
SAMPLE = 3000
CARRIER = b"0123456789abcdef~|"
TOP = 9


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _compressor(content: bytes):
    import zstandard as z

    d = z.ZstdCompressionDict(content + CARRIER, dict_type=z.DICT_TYPE_RAWCONTENT)
    p = z.ZstdCompressionParameters(
        compression_level=LEVEL, min_match=3, strategy=z.STRATEGY_BTULTRA, window_log=17,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    d.precompute_compress(compression_params=p)
    return z.ZstdCompressor(dict_data=d, compression_params=p).compress


class Distances:
    """Distances of words, each between 0 and TOP; what favours ordinary text is 0."""

    def __init__(self, toxic: bytes, ordinary: bytes, reach: int = 1):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        self.reach, self.piece = max(1, reach), max(PIECE, 2 * reach)
        self.known: dict[str, int] = {}

    def _word(self, word: str) -> int:
        b = word.strip(".,;:!?\"'()").encode("utf-8", "replace")
        most = 0
        # any ``reach`` bytes lie whole in a piece
        for at in range(0, max(1, len(b) - self.reach + 1), self.piece - self.reach + 1):
            x = CARRIER + b" " + b[at : at + self.piece] + b" " + CARRIER
            most = max(most, len(self.ordinary(x)) - len(self.toxic(x)))
        return min(most, TOP)

    def text(self, words: list[str]) -> list[float]:
        """Features of a text: largest distance, log counts at the thresholds, log share at the first."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self._word(w)
        d = bytes(map(known.__getitem__, words))
        counts = [d.count(k) for k in range(TOP + 1)]
        over = [sum(counts[t:]) for t in THRESHOLDS]
        return [float(max(d, default=0)), *[math.log1p(n) for n in over], math.log1p(100 * over[0] / max(1, len(words)))]


class Model:
    """Dictionaries and calibration, small enough to go to every task."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: list[float], reach: int = 1):
        self.toxic, self.ordinary, self.weights, self.reach = toxic, ordinary, weights, reach

    def distances(self) -> Distances | None:
        return Distances(self.toxic, self.ordinary, self.reach) if self.weights else None

    def score(self, x: list[float]) -> float:
        z = self.weights[-1] + sum(w * v for w, v in zip(self.weights, x, strict=False))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _words(text: str) -> list[str]:
    return text.lower().split()


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Newton steps with a small ridge; the bias comes last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.1 * w)
    return w.tolist()


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Fit on texts, words joined by blanks: dictionaries on three of four, calibration on the fourth."""
    import zstandard as z

    if len(toxic) < 2 or len(ordinary) < 2:
        return Model(b"", b"", [])
    strip = lambda r: [sys.intern(w.strip(".,;:!?\"'()")) for w in r.split()]
    t, o = ([strip(r) for k, r in enumerate(rows) if k % 4] for rows in (toxic, ordinary))
    in_t, in_o = Counter(w for r in t for w in set(r)), Counter(w for r in o for w in set(r))
    least = max(2, LEAST_SHARE * len(t))
    favoured = {w for w, n in in_t.items() if len(w) > 2 and n >= least and n / len(t) > FAVOUR * (in_o[w] + 0.5) / len(o)}

    def dictionary(samples: list[bytes], size: int) -> bytes:
        samples = [s for s in samples if len(s) >= 8]
        try:
            return z.train_dictionary(size, samples).as_bytes()
        except z.ZstdError:  # too few samples to train on: their own bytes serve
            return b"".join(samples)[-size:]

    spaced = lambda ws: "".join(f" {w} " for w in ws).encode("utf-8", "replace")
    model = Model(
        dictionary([spaced(w for w in r if w in favoured) for r in t], TOXIC_DICT),
        dictionary([spaced(r)[:SAMPLE] for r in o], ORDINARY_DICT),
        [0.0],
        max((len(w.encode("utf-8", "replace")) for w in favoured), default=1),
    )
    d = model.distances()
    rows = [(d.text(r.split()), y) for part, y in ((toxic[::4], 1.0), (ordinary[::4], 0.0)) for r in part]
    model.weights = _logistic(np.array([r for r, _ in rows]), np.array([y for _, y in rows]))
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """Train on a bounded sample of the labelled rows that aren't held out."""
    y = labels.select(F.col(doc_id).alias("i"), F.col(label).alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1))
    y = y.where(~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(b"", b"", [])
    share = lambda k, most: F.lit(min(1.0, most / sizes[k]))
    share = F.when(F.col("y") == 1, share(1, PER_LABEL[0])).otherwise(share(0, PER_LABEL[1]))
    y = y.where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < share * (1 << 20))
    d = docs.select(F.col(doc_id).alias("i"), F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+").alias("w"))
    d = d.join(F.broadcast(y), "i")  # about sum(PER_LABEL) ids at most
    step = f"greatest(1, ceil(size(w) / {WORDS}))"
    d = d.select("i", "y", F.expr(f"filter(w, (x, k) -> k % {step} = 0 AND x <> '')").alias("w"))
    # ids may repeat, rows of the sample not without bound
    d = d.select("y", "i", F.array_join("w", " ").alias("t")).orderBy(F.xxhash64("i", "t")).limit(2 * sum(PER_LABEL))
    rows = sorted((r["y"], r["i"], r["t"]) for r in d.collect())
    return train([t for k, _, t in rows if k == 1], [t for k, _, t in rows if k == 0])


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns but the text, with ``score`` and ``predicted``."""
    added = ["score", "predicted"]
    d, keep = pack(df, text, added)
    schema = f"__rest {dict(d.dtypes)['__rest']}, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.distances()
        for batch in batches:
            where = batch.schema.get_field_index("__text")
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [model.score(own.text(_words(t or ""))) if own else 0.0 for t in part.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [c for k, c in enumerate(part.columns) if k != where] + [pa.array(got, pa.float64()), pa.array([int(g >= 0.5) for g in got], pa.int32())],
                    names=[c for c in part.schema.names if c != "__text"] + ["score", "predicted"],
                )

    ship(df.sparkSession)
    return unpack(d.mapInArrow(run, schema), keep, added)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
