"""Incremental chunking: a file stream that chunks each new document once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X


def token_chunks(docs: DataFrame, text: str = "text", size: int = 256) -> DataFrame:
    """Default chunker: token windows as an array."""
    return docs.withColumn("chunks", X.token_windows(X.words(F.col(text)), size))


def chunk_new(
    spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, key: str = "doc_id", chunker: Callable[[DataFrame], DataFrame] = token_chunks,
    form: str = "parquet",
) -> StreamingQuery:
    """Chunk what is new in a folder of parquet files, append it to ``sink`` (as parquet, or as a log of JSON lines with ``form`` json), and stop.

    Files and keys that are done are in the checkpoint; a run that broke off goes on where it stopped, and a key comes out once.
    """
    new = spark.readStream.schema(schema).parquet(source).dropDuplicates([key])
    out = chunker(new)
    return out.writeStream.format(form).option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
