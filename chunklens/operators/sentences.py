"""A sentence splitter that learns from the corpus itself, without labels.

After Kiss and Strunk, "Unsupervised multilingual sentence boundary detection" (2006): abbreviations are words that
nearly always come with a full stop and are short; collocations are pairs that hold together over a stop;
starters are words that stand after a sure stop much more often than elsewhere; and the case in which a word was seen
elsewhere tells what a capital letter after a doubtful stop means. All are counts and log-likelihood ratios, so training is a few
aggregations that combine before they shuffle, and only what passes a threshold is in the model. Splitting decides each stop from the
word before and the word after it; only words with a stop meet the model, so the text itself isn't shuffled for that.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.batches import slices
from ..session import cut, ship

#: Least scores of an abbreviation, a collocation and a starter, and how often an abbreviation has its stop.
ABBREVIATION, COLLOCATION, STARTER, SURE = 0.3, 7.88, 30.0, 0.99
#: Entries of a model that is sent to every task.
SMALL = 200_000


def pieces(text: Column) -> Column:
    """Words with the blanks after them; joined they are the text without the blanks before it."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"\S+\s*"), F.lit(0)), F.array().cast("array<string>"))


_PIECE, _TRAIL, _NUMBER = re.compile(r"\S+\s*", re.A), re.compile(r"[.!?,;:…]+$"), re.compile(r"[+-]?\d[\d.,]*", re.A)
#: Quotes and brackets that may stand around a word.
_OPEN, _CLOSE = "([\"'“‘«", ")]\"'”’»"
#: Facts of words seen lately by this worker, and how many are kept; different counts that a task holds before it hands them on.
_seen: dict[str, tuple[str, str, str]] = {}
SEEN, HELD = 150_000, 150_000


def word_facts(piece: str) -> tuple[str, str, str]:
    """Type (lower case, numbers as #), stop (. ! ? e for an ellipsis, or empty) and case (U, l or empty) of a word without quotes and brackets around it."""
    if (known := _seen.get(piece)) is not None:
        return known
    w = piece.rstrip(" \t\n\r\f\v").lstrip(_OPEN).rstrip(_CLOSE)
    name = _TRAIL.sub("", w).lower()
    stop = "e" if w.endswith(("..", "…")) else w[-1:] if w.endswith((".", "!", "?")) else ""
    case = {"Lu": "U", "Ll": "l"}.get(unicodedata.category(w[0]), "") if w else ""
    if len(_seen) >= SEEN:
        _seen.clear()
    _seen[piece] = ("#" if _NUMBER.fullmatch(name) else name, stop, case)
    return _seen[piece]


def text_stops(words: list[tuple[str, str, str]]) -> list[tuple[int, str, str, str, str]]:
    """(pos, type, stop, next_type, next_case) of the words that end in a stop and have a word after them."""
    return [(i, t, s, words[i + 1][0], words[i + 1][2]) for i, (t, s, _) in enumerate(words[:-1]) if s]


def _facts(text: str | None) -> list[tuple[str, str, str]]:
    return [word_facts(p) for p in _PIECE.findall(text or "")]


def stops(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, stops): for each text its words that end in a stop and have a word after them, as (pos, type, stop, next_type, next_case)."""
    names = ("pos", "type", "stop", "next_type", "next_case")
    kind = pa.list_(pa.struct([("pos", pa.int32()), *[(n, pa.string()) for n in names[1:]]]))

    @F.arrow_udf("array<struct<pos:int,type:string,stop:string,next_type:string,next_case:string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            for s in slices(whole):
                yield pa.array([[dict(zip(names, x, strict=True)) for x in text_stops(_facts(t.as_py()))] for t in whole.slice(*s)], kind)

    ship(docs.sparkSession)
    return docs.select(F.col(key).alias("key"), run(F.col(text)).alias("stops"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to counts, added up until a task holds ``HELD`` different ones."""
    n: Counter = Counter()

    def handed_on() -> pa.RecordBatch:
        cols = list(zip(*n, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols], pa.array(list(n.values()), pa.int64())], names=["kind", "type", "stop", "next_type", "next_case", "n"])

    for b in batches:
        for t in b.column(0):
            words = _facts(t.as_py())
            if words:
                n["p", None, "^", words[0][0], words[0][2]] += 1
            n.update(("w", t, "." if s == "." else "", None, None) for t, s, _ in words)
            n.update(("p", a if s else None, s, c, k) for (a, s, _), (c, _, k) in zip(words, words[1:], strict=False))
            if len(n) >= HELD:
                yield handed_on()
                n.clear()
    yield handed_on()


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, type, stop, next_type, next_case, n), from one pass over the texts.

    Kind w: words by type and whether a full stop ends them. Kind p: what follows each word with a stop, by that word, and what follows
    words without one and begins texts (stop ^), not by the word before. Counts are added up in each task, some at a time, and then over all.
    """
    ship(docs.sparkSession)
    d = docs.select(text).mapInArrow(_counted, "kind string, type string, stop string, next_type string, next_case string, n long")
    return d.groupBy("kind", "type", "stop", "next_type", "next_case").agg(F.sum("n").alias("n"))


def _trials(hits: Column, of: Column, p: Column) -> Column:
    """Log-likelihood of so many hits of so many trials; 0 * log 0 counts as 0."""
    part = lambda n, q: F.when(n > 0, n * F.log(q)).otherwise(0.0)
    return part(hits, p) + part(of - hits, 1 - p)


def association(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Log-likelihood ratio that ``second`` depends on ``first``."""
    apart = _trials(both, first, second / total) + _trials(second - both, total - first, second / total)
    tied = _trials(both, first, both / first) + _trials(second - both, total - first, (second - both) / (total - first))
    return 2 * (tied - apart)


def train(docs: DataFrame, text: str = "text") -> dict[str, DataFrame]:
    """The tables of a model, all but ``totals`` with one row for each entry.

    abbreviations (type, score), collocations (type, next_type, score), starters (type, score), cases (type and the flags lower,
    upper, upper_inside, lower_first of types that were seen after a doubtful stop), totals (words, stops, breaks).
    """
    seen = cut(counts(docs, text))
    dotted = F.coalesce(F.sum(F.when(F.col("stop") == ".", F.col("n"))), F.lit(0))
    by_type = seen.where("kind = 'w'").groupBy("type").agg(dotted.alias("with_stop"), F.sum("n").alias("c"))
    totals = by_type.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("words"), F.coalesce(F.sum("with_stop"), F.lit(0)).alias("stops"))
    n, w = F.col("c"), F.col("with_stop")
    size, inner = F.length(F.regexp_replace("type", r"\.", "")), F.length(F.regexp_replace("type", r"[^.]", ""))
    ratio = 2 * (_trials(w, n, F.lit(SURE)) - _trials(w, n, F.col("stops") / F.col("words")))
    score = ratio * F.exp(-size) * (inner + 1) * F.pow(size.cast("double"), w - n)
    # one row of two sums is all that is sent to every task
    scored = by_type.where((w > 0) & F.col("type").rlike(r"\p{L}") & ~F.col("type").rlike(r"^\p{L}$")).crossJoin(F.broadcast(totals)).withColumn("score", score)
    abbreviations = cut(scored.where(F.col("score") >= ABBREVIATION).select("type", "score"))

    pairs = seen.where("kind = 'p'").join(abbreviations.select("type", F.lit(True).alias("abbreviations")), "type", "left")
    place = F.when(F.col("stop") == "", "inside").when(in_doubt(F.coalesce("abbreviations", F.lit(False))), "unknown").otherwise("first")
    pairs = cut(pairs.withColumn("place", place).select("type", "stop", "next_type", "next_case", "place", "n"))
    met = lambda case, *where: F.coalesce(F.bool_or((F.col("next_case") == case) & F.col("place").isin(*where)), F.lit(False))
    every = ("inside", "unknown", "first")
    cases = pairs.groupBy(F.col("next_type").alias("type")).agg(
        met("l", *every).alias("lower"), met("U", *every).alias("upper"), met("U", "inside").alias("upper_inside"), met("l", "first").alias("lower_first"), F.bool_or(F.col("place") == "unknown").alias("_asked")
    ).where("_asked").drop("_asked")
    by_type = by_type.select("type", "c")
    totals = cut(totals.crossJoin(pairs.agg(F.coalesce(F.sum(F.when(F.col("place") == "first", F.col("n"))), F.lit(0)).alias("breaks"))))
    one = F.broadcast(totals)  # one row
    tied = pairs.where("place = 'unknown' and stop = '.'").groupBy("type", "next_type").agg(F.sum("n").alias("both"))
    tied = tied.join(by_type, "type").join(by_type.select(F.col("type").alias("next_type"), F.col("c").alias("d")), "next_type").crossJoin(one)
    tied = tied.withColumn("score", association(F.col("both"), F.col("c"), F.col("d"), F.col("words")))
    collocations = tied.where((F.col("score") >= COLLOCATION) & (F.col("both") * F.col("words") > F.col("c") * F.col("d"))).select("type", "next_type", "score")
    starts = pairs.where("place = 'first'").groupBy(F.col("next_type").alias("type")).agg(F.sum("n").alias("both")).join(by_type, "type").crossJoin(one)
    starts = starts.where(F.col("type").rlike(r"\p{L}")).withColumn("score", association(F.col("both"), F.col("breaks"), F.col("c"), F.col("words")))
    starters = starts.where((F.col("score") >= STARTER) & (F.col("both") * F.col("words") > F.col("breaks") * F.col("c"))).select("type", "score")
    return {"abbreviations": abbreviations, "collocations": cut(collocations), "starters": cut(starters), "cases": cut(cases), "totals": totals}


def save(model: dict[str, DataFrame], path: str) -> None:
    """The tables of a model as folders of one."""
    for name, table in model.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("abbreviations", "collocations", "starters", "cases", "totals")}


def in_doubt(short: Column) -> Column:
    """Whether a stop may not end a sentence: after an abbreviation, a single letter or a number, or dots."""
    return (F.col("stop") == "e") | (F.col("stop") == ".") & (short | F.coalesce(F.col("type").rlike(r"^(\p{L}|#)$"), F.lit(False)))


@dataclass
class Rules:
    """A small model, and the decision for one stop."""

    abbreviations: set[str] = field(default_factory=set)
    collocations: set[tuple[str, str]] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    #: type to (lower, upper, upper_inside, lower_first)
    cases: dict[str, tuple[bool, bool, bool, bool]] = field(default_factory=dict)

    def ends(self, type_: str, stop: str, next_type: str, next_case: str) -> bool:
        letter = len(type_) == 1 and type_.isalpha()
        if stop in "!?" or (stop == "." and not letter and type_ != "#" and type_ not in self.abbreviations):
            return True
        if stop == "." and (type_, next_type) in self.collocations:
            return False
        lower, upper, upper_inside, lower_first = self.cases.get(next_type, (False,) * 4)
        starts = next_case == "U" and lower and not upper_inside
        if not letter and (stop == "e" or type_ in self.abbreviations):
            return starts or (next_case == "U" and next_type in self.starters)
        if next_case == "l" and (upper or not lower_first):
            return False
        return not (letter and not starts and next_case == "U" and not lower)


def rules(model: dict[str, DataFrame]) -> Rules | None:
    """The model as it goes to the tasks, or None if it has more than ``SMALL`` entries; no more than that comes to the driver."""
    rows: dict[str, list] = {}
    for name in ("abbreviations", "collocations", "starters", "cases"):
        rows[name] = model[name].drop("score").take(SMALL + 1 - sum(map(len, rows.values())))
        if sum(map(len, rows.values())) > SMALL:
            return None
    flat = lambda name: {r["type"] for r in rows[name]}
    cases = {r["type"]: (r["lower"], r["upper"], r["upper_inside"], r["lower_first"]) for r in rows["cases"]}
    return Rules(flat("abbreviations"), {(r["type"], r["next_type"]) for r in rows["collocations"]}, flat("starters"), cases)


def sentences_of(text: str | None, r: Rules) -> list[str]:
    """The sentences of one text by a small model."""
    found = _PIECE.findall(text or "")
    words = [word_facts(p) for p in found]
    edges = [0, *[pos + 1 for pos, *s in text_stops(words) if r.ends(*s)], len(found)]
    return [s for s in ("".join(found[a:b]).strip(" \t\n\r\f\v") for a, b in zip(edges, edges[1:], strict=False)) if s]


def _split(sent: Broadcast):
    """A batch function from texts to their sentences; ``sent`` is the broadcast of rules."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            for s in slices(whole):
                yield pa.array([sentences_of(t.as_py(), sent.value) for t in whole.slice(*s)], pa.list_(pa.string()))

    return run


def decide(words: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """The rows of ``stops``, one for each stop, with ``ends``: whether a sentence ends there.

    Only stops in doubt meet the large tables; how tables are joined is left to their sizes.
    """
    d = words.select("key", F.explode("stops").alias("s")).select("key", "s.*")
    flag = lambda t, *on: model[t].select(*on, F.lit(True).alias(t))
    d = d.join(flag("abbreviations", "type"), "type", "left").withColumn("abbreviations", F.coalesce("abbreviations", F.lit(False)))
    sure = d.where(~in_doubt(F.col("abbreviations"))).select("key", "pos", F.lit(True).alias("ends"))
    d = d.where(in_doubt(F.col("abbreviations"))).join(flag("collocations", "type", "next_type"), ["type", "next_type"], "left")
    for t in (model["cases"], flag("starters", "type")):
        d = d.join(t.withColumnRenamed("type", "next_type"), "next_type", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    upper, lower = F.col("next_case") == "U", F.col("next_case") == "l"
    starts = upper & is_("lower") & ~is_("upper_inside")
    letter = F.col("type").rlike(r"^\p{L}$")
    short = (F.col("abbreviations") | (F.col("stop") == "e")) & ~letter
    ends = (
        F.when(is_("collocations") & (F.col("stop") == "."), False).when(short, starts | (upper & is_("starters")))
        .when(lower & (is_("upper") | ~is_("lower_first")), False).when(letter & ~starts & upper & ~is_("lower"), False).otherwise(True)
    )
    return sure.unionByName(d.select("key", "pos", ends.alias("ends")))


def split(docs: DataFrame, key: str, text: str = "text", model: dict[str, DataFrame] | None = None) -> DataFrame:
    """(key, sentences): the texts cut after stops that end sentences; blanks inside a sentence stay as they are.

    Without a model one is trained on the same texts. Null and blank texts have no sentences. With a small model rows may
    repeat or have no key; with a large one ``key`` has to tell rows apart.
    """
    model = model or train(docs, text)
    small = rules(model)
    if small is not None:
        ship(docs.sparkSession)
        return docs.select(key, _split(docs.sparkSession.sparkContext.broadcast(small))(F.col(text)).alias("sentences"))
    ends = decide(stops(docs, key, text), model).where("ends").groupBy("key").agg(F.sort_array(F.collect_list("pos")).alias("cuts"))
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(ends, "key", "left")
    texts = X.joined_at(pieces(F.col("text")), F.coalesce("cuts", F.array().cast("array<int>")))
    return d.select(F.col("key").alias(key), F.filter(F.transform(texts, X.strip), lambda s: s != "").alias("sentences"))
