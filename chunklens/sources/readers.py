"""Readers: JSON arrays, logs with torn lines, result files with facts in their names, CSV with a byte-order mark, split folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions.text import file_facts
from ..session import cut

#: Names under which a split may be stored.
ALIASES = {"validation": ("validation", "val"), "val": ("val", "validation"), "train": ("train",), "test": ("test",)}

_TEXT = ("_id", "domain", "sub_domain", "difficulty", "length", "question", "choice_A", "choice_B", "choice_C", "choice_D", "answer")
QUESTION = T.StructType([T.StructField(c, T.StringType()) for c in (*_TEXT, "context")])
CHUNKED = T.StructType([*[T.StructField(c, T.StringType()) for c in _TEXT], T.StructField("chunks", T.ArrayType(T.StringType())), T.StructField("time", T.DoubleType())])
VECTORS = T.StructType([T.StructField(c, T.ArrayType(T.ArrayType(T.FloatType()))) for c in ("input", "label")])
MANIFEST = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("split", "corpus_split", "model")]
    + [T.StructField(c, T.LongType()) for c in ("shard", "nshards", "lo", "hi", "n_records", "n_short_docs", "n_vectors")]
)
RESULT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("question_id", "question", "domain", "raw_response", "parsed_response", "model_answer", "correct_answer", "retrieved_context")]
    + [
        T.StructField("topk", T.IntegerType()), T.StructField("is_correct", T.BooleanType()), T.StructField("choices", T.MapType(T.StringType(), T.StringType())),
        T.StructField("retrieved_chunks", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("similarity", T.DoubleType())]))),
        T.StructField("total_sample_time", T.DoubleType()),
    ]
)


def json_array(spark: SparkSession, path: str, schema: T.StructType = QUESTION) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_log(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = CHUNKED) -> DataFrame:
    """Append-only logs of one record a line; blank and torn lines are left out.

    ``_file`` and ``_line`` put records in the order of file names and of lines; ``_line`` rises inside a file but isn't its line number.
    """
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths).select("value", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    d = lines.where(F.trim("value") != "").withColumn("_r", parsed).where(F.col("_r").isNotNull() & F.col("_r._corrupt").isNull())
    return d.select(*[F.col(f"_r.`{f.name}`") for f in schema.fields], "_file", "_line")


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(value, _path, _line): lines of text files with their numbers from 0, also where a file is read in several blocks.

    Lines are written once with the block that they come from, and a block's number in its file is a sum over the counts
    of the blocks before it, so no file is read by one task.
    """
    d = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    d = cut(d.select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_in")))
    blocks = d.groupBy("_path", "_block").agg(F.min("_in").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.Window.partitionBy("_path").orderBy("_block").rowsBetween(W.Window.unboundedPreceding, -1))
    blocks = blocks.select("_path", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return d.join(blocks, ["_path", "_block"]).select("value", "_path", (F.col("_before") + F.col("_in") - F.col("_first")).alias("_line"))


def result_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``result_files``, with the place of each record: ``_file`` (its name), ``_path`` and ``_line``; blank and torn lines are left out but counted."""
    d = numbered_lines(spark, path)
    whole = T.StructType([*RESULT.fields, T.StructField("_corrupt", T.StringType())])
    d = d.where(F.trim("value") != "").withColumn("_r", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    d = d.where(F.col("_r").isNotNull() & F.col("_r._corrupt").isNull()).withColumn("_file", _result_name(F.col("_path")))
    d = d.withColumn("_f", file_facts(F.col("_file"))).where("_f IS NOT NULL")
    return d.select(*[F.col(f"_r.`{f.name}`") for f in RESULT.fields], "_f.method", "_f.size", "_f.shard", "_f.rep", "_f.at", "_file", "_path", "_line")


def _result_name(path: Column) -> Column:
    """Name of a result file, or of the folder that ``writers.result_files`` makes of one."""
    return F.regexp_extract(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"(?:^|[/=])(raw_[^/]*\.jsonl)(?:/[^/]*)?$", 1)


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records with method, size, shard, repeat and time from the names of their files, or of the folders that
    ``writers.result_files`` makes; files with other names are left out.
    """
    d = spark.read.schema(RESULT).json(path).withColumn("_file", _result_name(F.col("_metadata.file_path")))
    d = d.withColumn("_f", file_facts(F.col("_file"))).where("_f IS NOT NULL")
    return d.select("*", "_f.method", "_f.size", "_f.shard", "_f.rep", "_f.at").drop("_f")


def csv_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header that may start with a byte-order mark."""
    d = spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True)
    return d.toDF(*[c.lstrip("﻿") for c in d.columns])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _list(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().toString() for f in found or [])


def split(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """One split of a dataset folder, by any of its names; the error lists what is there."""
    for alias in ALIASES.get(name, (name,)):
        if _exists(spark, f"{root}/{alias}"):
            return (spark.read.schema(schema) if schema else spark.read).parquet(f"{root}/{alias}")
    raise FileNotFoundError(f"no split {name} in {root}; there are {[p.rsplit('/', 1)[1] for p in _list(spark, root + '/*')]}")


def vectors(spark: SparkSession, root: str, name: str) -> DataFrame:
    return split(spark, root, name, VECTORS)


def family(spark: SparkSession, root: str, name: str) -> list[str]:
    """Folders of a dataset and of its shards and gap fills: name, name.shard*, name.gap*, in this order."""
    return [p for pattern in (name, f"{name}.shard*", f"{name}.gap*") for p in _list(spark, f"{root}/{pattern}")]


def read_family(spark: SparkSession, root: str, name: str) -> list[DataFrame]:
    return [spark.read.parquet(p) for p in family(spark, root, name)]


def probe(spark: SparkSession, root: str, method: str, domain: str, model: str | None = None) -> str | None:
    """First that exists of root/method/model/domain, root/method/domain, and the logs root/method/checkpoints/domain*.jsonl, as a pattern."""
    tries = [f"{root}/{method}/{model}/{domain}"] if model else []
    found = next((p for p in [*tries, f"{root}/{method}/{domain}"] if _exists(spark, p)), None)
    logs = f"{root}/{method}/checkpoints/{domain}*.jsonl"
    return found or (logs if _list(spark, logs) else None)


def chunked(spark: SparkSession, root: str, method: str, domain: str, model: str | None = None) -> DataFrame:
    """Chunked samples of a method and domain from wherever ``probe`` finds them; an error names the place if they are nowhere."""
    place = probe(spark, root, method, domain, model)
    if place is None:
        raise FileNotFoundError(f"no samples of {method}/{domain} in {root}")
    return json_log(spark, place).drop("_file", "_line") if place.endswith(".jsonl") else spark.read.schema(CHUNKED).parquet(place)


def manifests(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Manifests of a dataset's shards (name.shard*.json), or the ``shards`` of its merged manifest (name.json) where there are none."""
    if _list(spark, f"{root}/{name}.shard*.json"):
        return spark.read.schema(MANIFEST).option("multiLine", True).json(f"{root}/{name}.shard*.json")
    merged = T.StructType([T.StructField("shards", T.ArrayType(MANIFEST))])
    return spark.read.schema(merged).option("multiLine", True).json(f"{root}/{name}.json").select(F.explode("shards").alias("s")).select("s.*")


def modified_since(spark: SparkSession, path: str, at: str) -> DataFrame:
    """Text files changed after a time (yyyy-MM-ddTHH:mm:ss)."""
    return spark.read.option("modifiedAfter", at).text(path)


def store(spark: SparkSession, path: str) -> DataFrame:
    """A saved vector store; a clear error if there is none."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no vector store at {path}")
    return spark.read.parquet(path)
