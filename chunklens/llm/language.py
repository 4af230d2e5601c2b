"""Language identification by a byte convolutional network, trained in numpy.

Bytes of lower-cased text are embedded; filters of several widths slide over
fixed-length windows; each filter's largest value in a window, rectified, goes to a
softmax over the learned languages. A text is covered whole by consecutive windows;
its log probabilities are summed over them.

Training takes a bounded, hash-chosen sample of labelled rows for each language
(``PER_LANGUAGE`` rows, ``WINDOWS_PER_ROW`` windows a row) to the driver; nothing
else is collected. An embedding followed by a filter is a table for each offset, so
prediction adds rows of tables for byte pairs, which is what makes it fast.

Edge cases: text that is null or has no letter is ``und`` with score 0; rows with a
null language or doc_id aren't learned from; without any labelled row all is ``und``;
repeated rows each keep a row; an empty table gives an empty result; added columns
take the place of columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import pack, table, unpack

#: Bounds of the training sample.
PER_LANGUAGE, WINDOWS_PER_ROW = 600, 6
#: Bytes of a window; filter widths; filters of a width; size of the embedding.
WINDOW, WIDTHS, FILTERS, EMBED = 192, (2, 3, 4), 16, 8
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 7
UNDETERMINED = "und"


class ByteNet:
    """Parameters of the network, and tables derived from them."""

    def __init__(self, languages: list[str]):
        g = np.random.default_rng(SEED)
        self.languages = languages
        self.p = {"emb": g.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"w{w}"] = g.normal(0, 1 / math.sqrt(w * EMBED), (w, EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["out"] = g.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages)))
        self.p["bias"] = np.zeros(len(languages))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Log probabilities of windows of bytes [n, WINDOW], and what the backward pass needs."""
        e = self.p["emb"][x]
        hidden, at = [], {}
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            y = sum(e[:, j : j + n] @ self.p[f"w{w}"][j] for j in range(w)) + self.p[f"b{w}"]
            at[w] = y.argmax(axis=1)
            hidden.append(y.max(axis=1))
        h = np.concatenate(hidden, axis=1)
        z = np.maximum(h, 0) @ self.p["out"] + self.p["bias"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True)), {"h": h, "at": at}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        logp, kept = self.forward(x)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = np.exp(logp)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g["out"] = np.maximum(kept["h"], 0).T @ d
        g["bias"] = d.sum(axis=0)
        dh = (d @ self.p["out"].T) * (kept["h"] > 0)
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            part = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"] = part.sum(axis=0)
            for j in range(w):
                byte = x[rows, kept["at"][w] + j]
                g[f"w{w}"][j] = np.einsum("nfe,nf->ef", self.p["emb"][byte], part)
                np.add.at(g["emb"], byte, part[:, :, None] * self.p[f"w{w}"][j].T[None])
        return g

    def train(self, x: np.ndarray, y: np.ndarray) -> ByteNet:
        """Adam over shuffled batches."""
        g = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = g.permutation(len(x))
            for at in range(0, len(x), BATCH):
                pick = order[at : at + BATCH]
                step += 1
                for k, d in self.gradients(x[pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


class Predictor:
    """Tables for byte pairs: a filter's value is a sum of one row for each two bytes of it."""

    def __init__(self, net: ByteNet):
        self.languages = net.languages
        one = {w: [(net.p["emb"] @ net.p[f"w{w}"][j]).astype(np.float32) for j in range(w)] for w in WIDTHS}
        self.tables = {}
        for w in WIDTHS:
            pairs = [(j, (one[w][j][:, None, :] + one[w][j + 1][None, :, :]).reshape(65536, FILTERS)) for j in range(0, w - 1, 2)]
            self.tables[w] = (pairs, (w - 1, one[w][w - 1]) if w % 2 else None)
        self.shift = {w: net.p[f"b{w}"].astype(np.float32) for w in WIDTHS}
        self.out, self.bias = net.p["out"].astype(np.float32), net.p["bias"].astype(np.float32)

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of windows of bytes [n, WINDOW]."""
        pair = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        hidden = []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            pairs, last = self.tables[w]
            y = None
            for j, t in pairs:
                part = t[pair[:, j : j + n]]
                y = part if y is None else np.add(y, part, out=y)
            if last:
                y += last[1][x[:, last[0] : last[0] + n]]
            hidden.append(y.max(axis=1) + self.shift[w])
        z = np.maximum(np.concatenate(hidden, axis=1), 0) @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def texts(self, texts: list[str | None], at_once: int = 256) -> Iterator[tuple[str, float]]:
        """Language and score of each text; windows of consecutive texts are predicted together."""
        import regex

        letter = regex.compile(r"\p{L}").search
        owner, rows, total = [], [], [None] * len(texts)

        def flush() -> None:
            if not rows:
                return
            logp = self.windows(np.concatenate(rows))
            for i, p in zip(owner_of(), logp, strict=True):
                total[i] = p.astype(np.float64) if total[i] is None else total[i] + p
            owner.clear()
            rows.clear()

        def owner_of() -> Iterator[int]:
            for i, n in owner:
                yield from [i] * n

        held = 0
        counts = [0] * len(texts)
        for i, t in enumerate(texts):
            if not t or not letter(t) or not self.languages:
                continue
            x = cut_windows(t)
            counts[i] = len(x)
            for at in range(0, len(x), at_once):
                part = x[at : at + at_once]
                owner.append((i, len(part)))
                rows.append(part)
                held += len(part)
                if held >= at_once:
                    flush()
                    held = 0
        flush()
        for i, p in enumerate(total):
            if p is None:
                yield UNDETERMINED, 0.0
            else:
                q = np.exp((p - p.max()) / counts[i])
                k = int(p.argmax())
                yield self.languages[k], float(q[k] / q.sum())


def cut_windows(text: str) -> np.ndarray:
    """Bytes of lower-cased text as rows of WINDOW, the last one filled with spaces."""
    b = text.lower().encode("utf-8", "replace")
    n = -(-len(b) // WINDOW)
    return np.frombuffer(b.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> ByteNet:
    """Train on a bounded sample: for each language the rows whose id hash is lowest, and evenly spaced windows of each."""
    d = docs.select(F.col(doc_id).alias("i"), F.col(lang).alias("y"), F.col(text).alias("t"))
    d = d.where(F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("i")))
    sizes = {r["y"]: r["n"] for r in d.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return ByteNet([])
    names = sorted(sizes)
    share = F.element_at(F.create_map(*[F.lit(x) for y in names for x in (y, min(1.0, PER_LANGUAGE / sizes[y]))]), F.col("y"))
    d = d.where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < share * (1 << 20))
    step = f"IF(length(t) > {WINDOW}, (length(t) - {WINDOW}) / {WINDOWS_PER_ROW - 1}, 0)"
    cut = F.expr(f"transform(sequence(0, IF(length(t) > {WINDOW}, {WINDOWS_PER_ROW - 1}, 0)), k -> substring(t, CAST(1 + k * {step} AS INT), {WINDOW}))")
    # ids may repeat, rows of the sample not without bound
    sample = d.where(F.length("t") > 0).select("y", cut.alias("x"), F.xxhash64("i", "t").alias("h")).orderBy("h").limit(2 * PER_LANGUAGE * len(names))
    rows = sorted((r["y"], x) for r in sample.collect() for x in r["x"])
    if not rows:
        return ByteNet([])
    x = np.concatenate([cut_windows(t)[:1] for _, t in rows])
    return ByteNet(names).train(x, np.array([names.index(y) for y, _ in rows]))


def predict(df: DataFrame, net: ByteNet, text: str = "text") -> DataFrame:
    """All columns but the text, with ``lang_pred`` and ``score``."""
    added = ["lang_pred", "score"]
    d, keep = pack(df, text, added)
    schema = f"__rest {dict(d.dtypes)['__rest']}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Predictor(net)
        for batch in batches:
            where = batch.schema.get_field_index("__text")
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = list(own.texts(part.column(where).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [c for k, c in enumerate(part.columns) if k != where] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                    names=[c for c in part.schema.names if c != "__text"] + ["lang_pred", "score"],
                )

    ship(df.sparkSession)
    return unpack(d.mapInArrow(run, schema), keep, added)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = fit(docs)
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(d, net)


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
