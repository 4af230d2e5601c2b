"""Exact dedup against a persistent index of digests.

The index is a Parquet table with a row for each different text ever seen, bucketed and sorted by the text's
SHA-256. A batch is reduced to its different digests before it is shuffled, met with the index by a sort-merge
anti-join (the index side needs no exchange, its buckets are the join's partitions), and what is new is appended.
Adding a batch again adds nothing, so a job that died half-way is run again as it is. ``compact`` rewrites a grown
index to one sorted file a bucket.

Rows find their entry by digest. Digests that more than one in ``HOT`` of the rows share are at most ``HOT`` by number, so their
entries are broadcast; no other group is large enough to matter to the task that joins it.

Edge cases: null text counts as empty; a null id is less than any other; of rows with the greatest id of a group exactly one is
kept; an empty table gives an empty result and leaves the index as it is; columns with clashing names are carried in a struct.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .common import cut, table

#: A digest is hot if it has more than one in so many of the rows.
HOT = 1000


class DigestIndex:
    """Entries (digest, keep_id, batch, place): which row of which batch stays for a text.

    path: folder of the index in shared storage; opened if it is there, else made with ``buckets`` (the session's shuffle
    partitions if not given, so that a shuffled batch and the index are dealt alike).
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long", buckets: int | None = None):
        self.spark, self.path = spark, path
        state = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
        if state.getFileSystem(spark._jsc.hadoopConfiguration()).exists(state):
            kept = spark.read.parquet(f"{path}/state").orderBy(F.desc("version")).first()
            self.buckets, self.version, id_type = kept["buckets"], kept["version"], kept["id_type"]
        else:
            self.buckets, self.version = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), 0
            self._state(id_type)
        self.id_type = id_type
        self._open()

    def _state(self, id_type: str) -> None:
        row = self.spark.range(1).select(F.lit(self.buckets).alias("buckets"), F.lit(self.version).alias("version"), F.lit(id_type).alias("id_type"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    def _open(self) -> None:
        """Make the folder known to the session as a bucketed table."""
        self.name = f"digests_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {self.id_type}, batch STRING, place LONG) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/v{self.version}'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, batch: str) -> None:
        """Append the texts of rows (digest, id, place) that the index hasn't; of equal ones the row with the greatest id."""
        own = rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.coalesce(F.max_by("place", "id"), F.max("place")).alias("place")).withColumn("batch", F.lit(batch))
        # written, since the optimiser would else put the join before the aggregation, and a text that many rows share in one task;
        # the hint keeps the join to sorted partitions: a hash table or a broadcast would grow with the index
        new = cut(own).join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id", "batch", "place").repartition(self.buckets, "digest").write.insertInto(self.name)

    def compact(self) -> None:
        """Rewrite to one file a bucket beside the old version, then point to it; the old version's files stay until they are removed by hand."""
        old = self.entries()
        self.version += 1
        self._open()
        old.repartition(self.buckets, "digest").write.insertInto(self.name)
        self._state(self.id_type)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", whole: bool = True) -> DataFrame:
    """Written rows (digest, id, place) and, if ``whole``, the document in the struct ``row``; place is a number of its own."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    d = docs.select(*row, F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).alias("digest"), F.col(f"`{doc_id}`").alias("id"))
    return cut(d.withColumn("place", F.monotonically_increasing_id()))


def verdicts(rows: DataFrame, index: DigestIndex, *carry: str) -> DataFrame:
    """For each of rows (digest, id, batch, place): id, carried columns, keep_id, group_size, kept, text_sha256; group_size counts these rows."""
    limit = rows.count() // HOT
    own = rows.select("digest", "id", "batch", "place", *carry)
    sizes = own.groupBy("digest").agg(F.count("*").alias("group_size"))
    found = index.entries().select("digest", "keep_id", F.col("batch").alias("_batch"), F.col("place").alias("_place"))
    found = cut(sizes.join(found.hint("merge"), "digest"))
    hot = F.broadcast(found.where(F.col("group_size") > limit))  # at most HOT rows
    rest = own.join(hot.select("digest"), "digest", "left_anti").join(found.where(F.col("group_size") <= limit).hint("merge"), "digest")
    out = own.join(hot, "digest").unionByName(rest)
    kept = (F.col("batch") == F.col("_batch")) & (F.col("place") == F.col("_place"))
    return out.select("id", *carry, "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_new(docs: DataFrame, index: DigestIndex, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents whose text the index hadn't, one of each group, whole; their texts are in the index then."""
    d, batch = fingerprints(docs, text, doc_id), uuid.uuid4().hex
    index.add(d, batch)
    return d.join(index.entries().where(F.col("batch") == batch).select("place"), "place", "left_semi").select("row.*")


def add_in_turn(index: DigestIndex, rows: DataFrame, *first: Column) -> DataFrame:
    """Add rows (digest, id, place) in batches: those for which the first condition holds come first, and so on. Returns them with ``batch``."""
    name, step = uuid.uuid4().hex, F.lit(len(first))
    for k in reversed(range(len(first))):
        step = F.when(first[k], F.lit(k)).otherwise(step)
    for k in range(len(first) + 1):
        index.add(rows.where(step == k), f"{name}-{k}")
    return rows.withColumn("batch", F.concat(F.lit(f"{name}-"), step.cast("string")))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches, the half with the greater ids first, against a new index; the row with the largest id stays."""
    d = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=False)
    middle = d.agg(F.percentile_approx("id", 0.5)).first()[0]
    index = DigestIndex(spark, scratch(spark, "digests"))
    return verdicts(add_in_turn(index, d, F.col("id") >= (0 if middle is None else middle)), index).withColumnRenamed("id", "doc_id")


QUERIES = {"op12_exact_dedup": op12_exact_dedup}
ORACLES = {
    "op12_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
