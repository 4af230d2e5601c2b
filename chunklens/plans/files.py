"""One named query through all file formats: each is written from the tables, read again, and summed up in a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import etl as E
from ..sources import readers, writers
from .catalog import _t, query
from .studies import _place


def _sum(part: str, df: DataFrame, value) -> DataFrame:
    """(part, n, total) of a table that was read again."""
    return df.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.coalesce(F.sum(value).cast("long"), F.lit(0).cast("long")).alias("total"))


@query("""WITH d AS (SELECT doc_id, text, lang, source, n_chars FROM documents), l AS (SELECT * FROM labels)
SELECT 'json array' AS part, count(*) AS n, sum(length(text))::BIGINT AS total FROM d
UNION ALL SELECT 'split by alias', count(*), sum(doc_id)::BIGINT FROM d
UNION ALL SELECT 'vectors', count(*), sum(len(embedding))::BIGINT FROM embeddings
UNION ALL SELECT 'domains', count(*), sum(doc_id)::BIGINT FROM d
UNION ALL SELECT 'domain index', count(DISTINCT lang), count(*) FROM d
UNION ALL SELECT 'result files', count(*), sum((l.doc_id % 3) * 10 + 1)::BIGINT FROM l
UNION ALL SELECT 'chunked folder', count(*), sum(n_chars)::BIGINT FROM d WHERE lang = 'en'
UNION ALL SELECT 'chunked log', count(*), sum(n_chars)::BIGINT FROM d WHERE lang = 'de'
UNION ALL SELECT 'manifest of shards', count(DISTINCT source), count(*) FROM d
UNION ALL SELECT 'merged manifest', count(DISTINCT source), count(*) FROM d
UNION ALL SELECT 'changed since', count(*), sum(doc_id)::BIGINT FROM d
UNION ALL SELECT 'changed later', 0, 0
UNION ALL SELECT 'losses', count(DISTINCT (event_id + 1) // 1000), count(*) FROM events
UNION ALL SELECT 'loss summary', 1, count(*) FROM events
UNION ALL SELECT 'included', count(*), sum(doc_id)::BIGINT FROM d WHERE doc_id IN (SELECT doc_id FROM l WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM l WHERE toxic = 1)
UNION ALL SELECT 'known ids', count(DISTINCT doc_id), sum(DISTINCT doc_id)::BIGINT FROM (SELECT doc_id FROM l UNION ALL SELECT doc_id FROM d WHERE lang = 'fr')
UNION ALL SELECT 'pool', count(DISTINCT doc_id), sum(DISTINCT doc_id)::BIGINT FROM (SELECT doc_id FROM l UNION ALL SELECT doc_id FROM d WHERE lang = 'es')""")
def file_formats(spark, sf):
    """What each format gives back of whole tables: rows, and a sum over them."""
    at = _place(spark)
    d, labels, events = _t(spark, sf, "documents"), _t(spark, sf, "labels"), _t(spark, sf, "events")
    out = []

    # JSON arrays, a file for each hundred documents
    one = F.struct(F.col("doc_id").cast("string").alias("_id"), F.col("lang").alias("domain"), F.col("text").alias("context"))
    arrays = d.groupBy(F.floor(F.col("doc_id") / 100).alias("b")).agg(F.to_json(F.collect_list(one)).alias("value"))
    arrays.repartition("b").write.partitionBy("b").text(f"{at}/arrays")
    out.append(_sum("json array", readers.json_array(spark, f"{at}/arrays/*"), F.length("context")))

    # splits by any of their names
    d.select("doc_id", "text").write.parquet(f"{at}/splits/val")
    out.append(_sum("split by alias", readers.split(spark, f"{at}/splits", "validation"), F.col("doc_id")))
    v = _t(spark, sf, "embeddings").select(F.array("embedding").alias("input"), F.array("embedding").alias("label"))
    v.write.parquet(f"{at}/splits/train")
    out.append(_sum("vectors", readers.vectors(spark, f"{at}/splits", "train"), F.size(F.col("label")[0])))

    # a folder for each domain, and their index
    writers.by_domain(d.select("doc_id", F.col("lang").alias("domain")), f"{at}/domains")
    out += [_sum("domains", spark.read.parquet(f"{at}/domains"), F.col("doc_id")), _sum("domain index", spark.read.json(f"{at}/domains.index"), F.col("rows"))]

    # result files that carry facts in their names
    r = labels.select(F.col("doc_id").cast("string").alias("question_id"), F.lit("traditional_256").alias("method"), (F.col("doc_id") % 3).alias("shard"), F.lit(1).alias("rep"), F.lit(5).alias("topk"))
    writers.result_files(r, f"{at}/results", "20250102_030405")
    out.append(_sum("result files", readers.result_files(spark, f"{at}/results").where("method = 'traditional' and size = 256"), F.col("shard") * 10 + F.col("rep")))

    # chunked samples where a folder has them, else a log
    text = [F.lit(None).cast("string").alias(c) for c in ("sub_domain", "difficulty", "length", "question", "choice_A", "choice_B", "choice_C", "choice_D", "answer")]
    chunked = d.select(F.col("doc_id").cast("string").alias("_id"), F.col("lang").alias("domain"), *text, F.array("text").alias("chunks"), F.lit(0.5).alias("time"))
    chunked.where("domain = 'en'").write.parquet(f"{at}/chunks/m/en")
    writers.json_lines(chunked.where("domain = 'de'"), f"{at}/chunks/m/checkpoints/de.jsonl")
    for domain, part in (("en", "chunked folder"), ("de", "chunked log")):
        out.append(_sum(part, readers.chunked(spark, f"{at}/chunks", "m", domain), F.length(F.col("chunks")[0])))

    # manifests of shards, and the merged one
    m = d.groupBy("source").agg(F.count("*").alias("n_records")).select(F.lit("train").alias("split"), F.col("source").alias("corpus_split"), F.xxhash64("source").alias("shard"), "n_records")
    m.select(F.concat(F.lit("set.shard"), "corpus_split", F.lit(".json")).alias("_name"), F.to_json(F.struct("*")).alias("value")).repartition("_name").write.partitionBy("_name").text(f"{at}/shards")
    m.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("shards"))).alias("value")).coalesce(1).write.text(f"{at}/merged/set.json")
    out.append(_sum("manifest of shards", spark.read.schema(readers.MANIFEST).json(f"{at}/shards"), F.col("n_records")))
    out.append(_sum("merged manifest", readers.manifests(spark, f"{at}/merged", "set"), F.col("n_records")))

    # files by the time they were changed
    d.select(F.col("doc_id").cast("string").alias("value")).write.text(f"{at}/lines")
    for time, part in (("2000-01-01T00:00:00", "changed since"), ("2100-01-01T00:00:00", "changed later")):
        out.append(_sum(part, readers.modified_since(spark, f"{at}/lines", time), F.col("value").cast("long")))

    # losses in order, and their summary
    writers.loss_summary(events.select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss")), f"{at}/loss", block=1000)
    out.append(_sum("losses", spark.read.json(f"{at}/loss"), F.size("losses")))
    out.append(_sum("loss summary", spark.read.json(f"{at}/loss.summary"), F.col("steps")))

    # lists of ids
    out.append(_sum("included", E.picked(d, "doc_id", labels.where("quality = 1"), labels.where("toxic = 1")), F.col("doc_id")))
    out.append(_sum("known ids", E.known_ids("doc_id", labels, d.where("lang = 'fr'")), F.col("doc_id")))
    out.append(_sum("pool", E.extend_pool(labels.select("doc_id"), d.where("lang = 'es'").select("doc_id"), "doc_id"), F.col("doc_id")))
    return reduce(DataFrame.unionByName, out)
