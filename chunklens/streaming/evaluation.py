"""Metrics of a stream every so many rows, observed while the rows go by."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Evaluations(StreamingQueryListener):
    """The observed metrics of each micro-batch of one query, as they come."""

    def __init__(self, name: str):
        self.name, self.rows, self.query, self.ended = name, [], None, threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.query = str(event.id)

    def onQueryProgress(self, event) -> None:
        if (row := event.progress.observedMetrics.get(self.name)) is not None:
            self.rows.append(row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.query:
            self.ended.set()


def deal(df: DataFrame, step: str, every: int, path: str) -> None:
    """Rows as files of ``every`` steps each, so that a stream that takes one file at a time fires by count."""
    df.withColumn("_block", F.floor((F.col(step) - 1) / every)).repartition("_block").write.mode("overwrite").partitionBy("_block").parquet(path)


def evaluate_every(rows: DataFrame, metrics: dict[str, Column], into: str, checkpoint: str) -> list[dict]:
    """Write a stream of one file a micro-batch, and give the metrics of each: what is evaluated is what was written, in one pass.

    A run with the checkpoint of an earlier one evaluates what is new. There is one row of metrics for each ``every`` rows,
    which is what comes to the driver.
    """
    spark = rows.sparkSession
    name = f"evaluation-{uuid.uuid4().hex}"
    watch = Evaluations(name)
    spark.streams.addListener(watch)
    try:
        watched = rows.observe(name, *[c.alias(k) for k, c in metrics.items()])
        watched.writeStream.queryName(name).trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(into).awaitTermination()
        watch.ended.wait(60)  # progress is told on another thread, in order, the end last
    finally:
        spark.streams.removeListener(watch)
    return watch.rows


def deal_blocks(df: DataFrame, step: str, every: int, path: str, rows: int = 1 << 18) -> None:
    """Rows as files of whole blocks of ``every`` steps, about ``rows`` steps a file, so that the number of files doesn't follow that of blocks."""
    own = F.floor(F.floor((F.col(step) - 1) / every) / max(1, rows // every))
    df.withColumn("_file", own).repartition("_file").write.mode("overwrite").partitionBy("_file").parquet(path)


def evaluate_blocks(rows: DataFrame, step: str, every: int, metrics: dict[str, Column], into: str, checkpoint: str) -> DataFrame:
    """Write a stream to into/rows, and give the metrics of each block of ``every`` steps, as (block, metrics).

    A micro-batch holds many blocks, each of them whole, and what is evaluated is what it wrote; so neither the number of micro-batches nor
    what the driver holds follows the number of blocks. A run with the checkpoint of an earlier one goes on where that ended; a micro-batch
    that is run again takes the place of its first run.
    """
    spark, schema = rows.sparkSession, rows.schema

    def evaluated(d: DataFrame) -> DataFrame:
        return d.groupBy(F.floor((F.col(step) - 1) / every).alias("block")).agg(*[c.alias(k) for k, c in metrics.items()])

    def one(batch: DataFrame, number: int) -> None:
        own = f"{into}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(own)
        evaluated(spark.read.schema(schema).parquet(own)).write.mode("overwrite").parquet(f"{into}/metrics/batch={number}")

    evaluated(spark.createDataFrame([], schema)).write.mode("overwrite").parquet(f"{into}/metrics/batch=-1")  # a stream without rows has no metrics
    rows.writeStream.foreachBatch(one).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()
    return spark.read.parquet(f"{into}/metrics").select("block", *metrics)
