"""Stores of training pairs: built in shards with manifests, checked against them, merged and published.

A corpus is a table (corpus_split, pos, sentences): documents numbered from 0 in each split. A shard covers the positions
[lo, hi) of a split and declares in its manifest what it wrote. Documents of fewer than two sentences have no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..sources import readers, writers
from . import embedding as EM
from . import spans as S
from .etl import beside, contiguous, in_slice, prefix_counts
from .gates import interval_union

#: Sentences that a document needs to have a pair.
LEAST = 2


def pairs(docs: DataFrame, sentences: str, model: EM.Model, granularities: tuple[int, ...] = S.GRANULARITIES) -> DataFrame:
    """Add ``input`` (a vector for each sentence) and ``label`` (one for each span's text); documents that are too short go."""
    from ..session import ship

    ship(docs.sparkSession)
    s = F.col(sentences)
    d = docs.where(F.size(s) >= LEAST)
    texts = F.transform(S.spans(F.size(s), granularities), lambda p: S.span_text(s, p["start"], p["len"]))
    d = d.withColumn("_v", EM.vectors(model)(F.concat(s, texts)))
    return d.withColumn("input", F.slice("_v", F.lit(1), F.size(s))).withColumn("label", F.slice("_v", F.size(s) + 1, F.size("_v"))).drop("_v")


def corpus(docs: DataFrame, split: str, key: str, sentences: str) -> DataFrame:
    """(corpus_split, pos, sentences) with positions in order of the key."""
    d = docs.select(F.col(split).alias("corpus_split"), F.col(key).alias("_key"), F.col(sentences).alias("sentences"))
    return in_slice(d, "corpus_split", "_key").select("corpus_split", "pos", "sentences")


def write_shards(texts: DataFrame, path: str, shards: int, model: EM.Model, granularities: tuple[int, ...] = S.GRANULARITIES) -> None:
    """Parts of each split in ``shards`` contiguous shards, in path/parts, and a manifest line for each shard in path/manifests."""
    spark = texts.sparkSession
    total = texts.groupBy(F.col("corpus_split").alias("_s")).agg(F.count("*").alias("_n"))
    d = beside(texts, "corpus_split", total, "_s").withColumn("shard", contiguous(F.col("pos"), F.col("_n"), shards)).drop("_n")
    pairs(d, "sentences", model, granularities).select("corpus_split", "shard", "input", "label").write.mode("overwrite").partitionBy("corpus_split", "shard").parquet(f"{path}/parts")
    parts = read_parts(spark, path)
    wrote = parts.groupBy("corpus_split", "shard").agg(F.count("*").alias("n_records"), F.sum(F.size("input") + F.size("label")).cast("long").alias("n_vectors"))
    covers = d.groupBy("corpus_split", "shard").agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"), F.count_if(F.size("sentences") < LEAST).alias("n_short_docs"))
    wrote = wrote.select(F.col("corpus_split").alias("_s"), F.col("shard").alias("_k"), "n_records", "n_vectors")
    m = covers.join(wrote, F.col("corpus_split").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_k")), "left").na.fill(0, ["n_records", "n_vectors"])
    m.select(F.lit("train").alias("split"), "corpus_split", F.lit(model.name).alias("model"), F.col("shard").cast("long").alias("shard"), F.lit(shards).cast("long").alias("nshards"), "lo", "hi", "n_records", "n_short_docs", "n_vectors").write.mode("overwrite").json(f"{path}/manifests")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*readers.VECTORS.fields, T.StructField("corpus_split", T.StringType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/parts")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(readers.MANIFEST).json(f"{path}/manifests")


def covered_rows(texts: DataFrame, manifests: DataFrame) -> DataFrame:
    """(corpus_split, ranges, expected): what manifests cover of each split, and how many documents with a pair that holds.

    Intervals are joined to the documents at their two ends only, where counts up to the position are looked up, so their
    length doesn't matter; what lies past the last document covers nothing.
    """
    flat = interval_union(manifests.where("hi > lo").select("corpus_split", F.greatest("lo", F.lit(0)).alias("lo"), "hi"), "lo", "hi", "corpus_split")
    n = texts.groupBy(F.col("corpus_split").alias("_s")).agg(F.count("*").alias("n"))
    flat = flat.join(n, F.col("corpus_split").eqNullSafe(F.col("_s")), "left").drop("_s").na.fill(0, ["n"])
    ends = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.least("lo", "n").alias("x")), F.struct(F.lit(1).alias("sign"), F.least("hi", "n").alias("x"))))
    ends = flat.select("corpus_split", ends.alias("e")).select("corpus_split", "e.sign", (F.col("e.x") - 1).alias("at"))
    upto = prefix_counts(texts, "corpus_split", "pos", F.size("sentences") >= LEAST).select(F.col("corpus_split").alias("_s"), "pos", "upto")
    # before the first position nothing is counted
    found = ends.join(upto, F.col("corpus_split").eqNullSafe(F.col("_s")) & (F.col("at") == F.col("pos")), "left")
    expected = found.groupBy("corpus_split").agg(F.sum(F.col("sign") * F.coalesce("upto", F.lit(0))).alias("expected"))
    text = F.concat(F.lit("["), F.col("lo").cast("string"), F.lit(","), F.col("hi").cast("string"), F.lit(")"))
    ranges = flat.groupBy(F.col("corpus_split").alias("_r")).agg(F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))).alias("r"))
    ranges = ranges.select("_r", F.array_join(F.transform("r", lambda x: x["t"]), " ").alias("ranges"))
    return expected.join(ranges, F.col("corpus_split").eqNullSafe(F.col("_r"))).select("corpus_split", "ranges", "expected")


def manifest_totals(manifests: DataFrame, *by: str) -> DataFrame:
    """Sums of what manifests declare, by split or over all."""
    return manifests.groupBy(*by).agg(F.count("*").alias("shards"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_records", "n_short_docs", "n_vectors")])


def coverage(texts: DataFrame, manifests: DataFrame, found: DataFrame) -> DataFrame:
    """By split: ranges covered, rows expected from the corpus, declared by manifests and found in the store, and whether all three agree.

    ``found`` has corpus_split and one row for each row of the store.
    """
    have = found.groupBy(F.col("corpus_split").alias("_f")).agg(F.count("*").alias("found"))
    say = manifest_totals(manifests, "corpus_split").select(F.col("corpus_split").alias("_m"), F.col("n_records").alias("declared"), "n_short_docs", "n_vectors")
    d = covered_rows(texts, manifests).join(say, F.col("corpus_split").eqNullSafe(F.col("_m")), "full").withColumn("corpus_split", F.coalesce("corpus_split", "_m"))
    d = d.join(have, F.col("corpus_split").eqNullSafe(F.col("_f")), "full").withColumn("corpus_split", F.coalesce("corpus_split", "_f"))
    d = d.na.fill(0, ["expected", "declared", "found", "n_short_docs", "n_vectors"])
    agree = (F.col("expected") == F.col("declared")) & (F.col("declared") == F.col("found"))
    return d.select("corpus_split", "ranges", "expected", "declared", "found", "n_short_docs", "n_vectors", agree.alias("complete"))


def type_checks(schema: T.StructType) -> list[tuple[str, bool, str]]:
    """(check, passed, detail) of what the schema alone tells: the columns, and two levels of lists of 32-bit floats."""
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    out = [("columns", set(kinds) == {"input", "label"}, " ".join(sorted(kinds)))]
    return out + [(f"{c}_type", kinds.get(c) == "array<array<float>>", kinds.get(c, "absent")) for c in ("input", "label")]


def _row_faults(dim: int, granularities: tuple[int, ...]) -> dict[str, Column]:
    """For each check whether a row fails it; the number of spans comes from the closed form."""
    both = F.concat(F.coalesce("input", F.array().cast("array<array<float>>")), F.coalesce("label", F.array().cast("array<array<float>>")))
    return {
        "shape": F.coalesce(F.size("label") != S.span_count(F.size("input"), granularities), F.lit(True)) | F.coalesce(F.size("input") < LEAST, F.lit(True)),
        "dim": F.exists(both, lambda v: F.coalesce(F.size(v) != dim, F.lit(True))),
        "finite": F.exists(both, lambda v: v.isNull() | ~F.coalesce(V.finite(v), F.lit(True))),
    }


def gate(store: DataFrame, texts: DataFrame | None, manifests: DataFrame | None, dim: int, granularities: tuple[int, ...] = S.GRANULARITIES, sample: int | None = None, seed: int = 0) -> DataFrame:
    """(check, passed, detail) for a store: types from its schema, then one pass over its rows (all, or a seeded sample for shapes), and the
    rows against what manifests cover and declare. Without manifests ``manifest`` fails and the two row checks are left out."""
    spark = store.sparkSession
    out, n = type_checks(store.schema), None
    if set(store.columns) >= {"input", "label"} and all(p for _, p, _ in out[1:]):
        # least hashes: the same rows in every run; Spark keeps so many for each task, and doesn't sort the store
        rows = store if sample is None else store.orderBy(F.xxhash64(F.lit(seed), "input", "label")).limit(sample)
        faults = _row_faults(dim, granularities)
        r = rows.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in faults.items()]).first()
        out += [(k, r[k] == 0, f"{r[k]} of {r['n']} rows") for k in faults]
        n = r["n"] if sample is None else None
    if manifests is None or texts is None:
        out.append(("manifest", False, "absent"))
    else:
        n = store.count() if n is None else n
        expected = covered_rows(texts, manifests).agg(F.coalesce(F.sum("expected"), F.lit(0))).first()[0]
        declared = manifest_totals(manifests).first()["n_records"]
        out += [("rows_covered", n == expected, f"{n} of {expected}"), ("rows_declared", n == declared, f"{n} of {declared}")]
    return spark.createDataFrame(out, "check string, passed boolean, detail string")


class NotPublished(RuntimeError):
    """A merged store that failed its checks; the target is as it was."""


def merge(spark: SparkSession, path: str, out: str, dim: int, expect: int | None = None, granularities: tuple[int, ...] = S.GRANULARITIES) -> DataFrame:
    """Merge path/parts into the store ``out`` and write its manifest, out.manifest; returns the manifest.

    Rows, shapes and values are observed while the store is written beside the target. Only if the types are right, the
    rows are as many as declared (and as expected), and no row is at fault does it take the target's place.
    """
    parts = read_parts(spark, path)
    say = manifest_totals(read_manifests(spark, path)).first()
    kinds = spark.read.parquet(f"{path}/parts").schema
    bad = [f"{c}: {d}" for c, ok, d in type_checks(T.StructType([f for f in kinds if f.name in ("input", "label")])) if not ok]
    if bad:
        raise NotPublished("; ".join(bad))
    seen = Observation("merge")
    faults = _row_faults(dim, granularities)
    watched = parts.observe(seen, F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in faults.items()])
    watched.select("input", "label").write.mode("overwrite").parquet(f"{out}.new")
    got = seen.get
    bad = [f"{k}: {got[k]} of {got['n']} rows" for k in faults if got[k]]
    bad += [f"rows: {got['n']}, {what} {n}" for what, n in (("declared", say["n_records"]), ("expected", expect)) if n is not None and n != got["n"]]
    if bad:
        raise NotPublished("; ".join(bad))
    writers.publish(spark, f"{out}.new", out)
    n_parts = parts.select("corpus_split", "shard").distinct().count()
    row = F.lit(out.rstrip("/").rsplit("/", 1)[-1]).alias("split"), F.lit(got["n"]).alias("rows"), F.lit(n_parts).alias("n_parts"), F.lit(say["n_records"]).alias("declared")
    summary = read_manifests(spark, path).groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("corpus_split", "shard", "lo", "hi", "n_records", "n_short_docs", "n_vectors"))).alias("shards"))
    summary.coalesce(1).write.mode("overwrite").json(f"{out}.manifest")
    return spark.read.schema(summary.schema).json(f"{out}.manifest")
