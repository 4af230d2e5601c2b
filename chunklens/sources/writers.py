"""Writers: partitioned datasets, resumable parts, replacement by staging, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_domain(df: DataFrame, path: str, column: str = "domain") -> None:
    """A folder for each domain, and beside them an index, one JSON line with the name and rows of each."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)
    index = df.sparkSession.read.parquet(path).groupBy(column).agg(F.count("*").alias("rows"))
    index.coalesce(1).write.mode("overwrite").json(f"{path}.index")


def missing_blocks(df: DataFrame, path: str, block: str = "block") -> DataFrame:
    """Rows of blocks that aren't in ``path`` yet."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(block).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return df
    return df.join(done, block, "left_anti")


def parts(df: DataFrame, path: str, block: str = "block") -> None:
    """Append the blocks that are missing, a folder each; running it again adds nothing."""
    missing_blocks(df, path, block).write.mode("append").partitionBy(block).parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Write beside the target, then move into its place; the old data go last."""
    df.write.mode("overwrite").parquet(f"{path}.new")
    publish(df.sparkSession, f"{path}.new", path)


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Move a written folder into the place of the target; the old data go last."""
    jvm = spark.sparkContext._jvm
    old, new, gone = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staged, f"{path}.old"))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(gone):  # left by a run that broke off: the target is whole if it is there, else this is the last data
        if fs.exists(old):
            fs.delete(gone, True)
        else:
            _move(fs, gone, old)
    if fs.exists(old):
        _move(fs, old, gone)
    _move(fs, new, old)
    fs.delete(gone, True)


def _move(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"could not rename {a} to {b}")


def csv_report(df: DataFrame, path: str) -> None:
    """One CSV file that starts with a byte-order mark, as spreadsheets want it."""
    names = [f"\ufeff{c}" if k == 0 else c for k, c in enumerate(df.columns)]
    df.toDF(*names).coalesce(1).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def result_files(df: DataFrame, path: str, at: str, method: str = "method", shard: str = "shard", rep: str = "rep") -> None:
    """Records as JSON lines, a folder for each method, shard and repeat, named as ``functions.text.file_facts`` reads it; ``at`` is yyyyMMdd_HHmmss."""
    name = F.concat(F.lit("raw_"), F.col(method), F.lit("_shard"), F.col(shard), F.lit("_rep"), F.col(rep), F.lit(f"_{at}.jsonl"))
    df.withColumn("_name", name).drop(method, shard, rep).write.mode("overwrite").partitionBy("_name").json(path)


def json_lines(df: DataFrame, path: str, *partitions: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partitions) if partitions else w).json(path)


def loss_summary(df: DataFrame, path: str, step: str = "step", value: str = "loss", block: int = 10_000) -> None:
    """Losses in order of steps, ``block`` steps a JSON line, and beside them one line with their least, most and last."""
    rows = df.groupBy(F.floor(F.col(step) / block).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct(step, value))), lambda x: x[value]).alias("losses"))
    rows.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").json(path)
    s = df.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.max_by(value, step).alias("final"), F.count("*").alias("steps"))
    s.coalesce(1).write.mode("overwrite").json(f"{path}.summary")


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small report as a markdown table; more than ``limit`` rows are an error, not a cut."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join(map(cell, r)) + " |" for r in rows]]) + "\n"


def loss_plot(df: DataFrame, path: str, step: str = "step", value: str = "mean", points: int = 2000) -> None:
    """A PNG of a series, where matplotlib is installed; a longer one than ``points`` is binned first, so no more come to the driver."""
    import matplotlib.pyplot as plt  # optional

    rows = plot_points(df, step, value, points).orderBy("step").collect()
    fig, ax = plt.subplots()
    ax.plot([r["step"] for r in rows], [r["mean"] for r in rows])
    fig.savefig(path)
    plt.close(fig)


def plot_points(df: DataFrame, step: str, value: str, points: int) -> DataFrame:
    """(step, mean) of at most ``points`` bins of equal width; step is the last of a bin."""
    ends = df.agg(F.min(step).alias("a"), F.max(step).alias("b"))
    d = df.select(F.col(step).alias("_x"), F.col(value).alias("_y")).crossJoin(F.broadcast(ends))  # one row
    bin_ = F.when(F.col("b") > F.col("a"), F.floor((F.col("_x") - F.col("a")) * points / (F.col("b") - F.col("a") + 1))).otherwise(0)
    return d.groupBy(bin_.alias("_bin")).agg(F.max("_x").alias("step"), F.avg("_y").alias("mean")).drop("_bin")
