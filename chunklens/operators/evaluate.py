"""Evaluation roll-ups: accuracy, repeats, deltas, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .etl import first_wins


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * part, whole.cast("double")), F.lit(0.0))


def accuracy(records: DataFrame, *keys: str, correct: str = "is_correct") -> DataFrame:
    """correct, total and acc_pct by keys."""
    d = records.groupBy(*keys).agg(F.count_if(F.col(correct)).alias("correct"), F.count("*").alias("total"))
    return d.withColumn("acc_pct", F.round(percent(F.col("correct"), F.col("total")), 6))


def with_overall(records: DataFrame, group: str, domain: str, topk: str, unknown: str = "unknown", correct: str = "is_correct") -> DataFrame:
    """Accuracy by (group, domain, topk), and rows with domain ``overall`` over all known domains, in one pass over the data."""
    part = records.groupBy(group, domain, topk).agg(F.count_if(F.col(correct)).alias("correct"), F.count("*").alias("total"))
    known = part.where(F.col(domain) != unknown).groupBy(group, topk).agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    d = part.unionByName(known.withColumn(domain, F.lit("overall")))
    return d.withColumn("acc_pct", F.round(percent(F.col("correct"), F.col("total")), 6))


def with_domain(records: DataFrame, questions: DataFrame, key: str, domain: str = "domain", unknown: str = "unknown") -> DataFrame:
    """Look each record's domain up; ``unknown`` where there is none."""
    return records.drop(domain).join(questions.select(key, domain), key, "left").withColumn(domain, F.coalesce(domain, F.lit(unknown)))


def first_answers(records: DataFrame, questions: DataFrame, key: str = "question_id") -> DataFrame:
    """Records of ``readers.result_lines`` with their domain looked up; of several for one method, size, domain, cut-off and question the first counts,
    in order of file names and lines."""
    d = with_domain(records, questions, key)
    return first_wins(d, ("method", "size", "domain", "topk", key), F.col("_file"), F.col("_path"), F.col("_line"))


def pivot(rows: DataFrame, row: str, column: str, columns: list, value: str = "acc_pct") -> DataFrame:
    """One line for each value of ``row`` in order, a column for each of ``columns``; two decimals, empty where there is none."""
    d = rows.groupBy(row).pivot(column, columns).agg(F.first(value))
    return d.select(F.coalesce(row, F.lit("")).alias(row), *[F.when(F.col(f"`{c}`").isNotNull(), F.format_string("%.2f", F.col(f"`{c}`"))).otherwise("").alias(str(c)) for c in columns]).orderBy(row)


def mean_and_deviation(runs: DataFrame, *keys: str, value: str = "acc_pct") -> DataFrame:
    """Mean and sample deviation over runs; 0 for one run."""
    return runs.groupBy(*keys).agg(
        F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"), F.count("*").alias("runs")
    )


def gaps(ours: DataFrame, paper: DataFrame, baseline: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Our accuracy beside a published and a baseline one, with signed differences; null where one is missing."""
    d = ours.join(paper.withColumnRenamed("acc_pct", "paper_pct"), list(keys), "left")
    d = d.join(baseline.withColumnRenamed("acc_pct", "base_pct"), list(keys), "left")
    signed = lambda c: F.format_string("%+.2f", F.col("acc_pct") - F.col(c))
    return d.withColumn("vs_paper", F.when(F.col("paper_pct").isNotNull(), signed("paper_pct"))).withColumn("vs_base", F.when(F.col("base_pct").isNotNull(), signed("base_pct")))


def accepted(deltas: DataFrame, group: str, domain: str, delta: str, cost: str, overall: str = "overall") -> DataFrame:
    """Per group: overall at least 0.5 points up and 4 domains or more not worse; or cost at least 20 % down with under 0.5 points lost."""
    up = F.max(F.when(F.col(domain) == overall, F.col(delta)))
    kept = F.count_if((F.col(domain) != overall) & (F.col(delta) >= 0))
    saved = F.max(F.when(F.col(domain) == overall, F.col(cost)))
    d = deltas.groupBy(group).agg(up.alias("overall_delta"), kept.alias("domains_kept"), saved.alias("cost_saved_pct"))
    better = (F.col("overall_delta") >= 0.5) & (F.col("domains_kept") >= 4)
    cheaper = (F.col("cost_saved_pct") >= 20) & (F.col("overall_delta") > -0.5)
    return d.withColumn("accepted", F.coalesce(better, F.lit(False)) | F.coalesce(cheaper, F.lit(False)))


def time_by(records: DataFrame, *keys: str, seconds: str, question: str) -> DataFrame:
    """Time as recorded (once for each row) and once for each question."""
    once = records.groupBy(*keys, question).agg(F.sum(F.coalesce(F.col(seconds), F.lit(0.0))).alias("s"), F.max(F.coalesce(F.col(seconds), F.lit(0.0))).alias("m"))
    return once.groupBy(*keys).agg(F.round(F.sum("s"), 6).alias("recorded_s"), F.round(F.sum("m"), 6).alias("question_s"), F.round(F.avg("m"), 6).alias("avg_question_s"))


def bins(series: DataFrame, step: str, value: str, width: int) -> DataFrame:
    """mean, min and max by bins of steps; a bin is named by its last step."""
    d = series.groupBy((F.ceil(F.col(step) / width) * width).cast("long").alias("step_bin"))
    return d.agg(F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"))


def head_tail(series: DataFrame, step: str, value: str, size: int) -> DataFrame:
    """Mean of the first and the last ``size`` steps (null with fewer rows), and least, most and final value."""
    last = series.agg(F.max(step).alias("_last"), F.count("*").alias("_n"))
    d = series.crossJoin(F.broadcast(last))
    mean = lambda where: F.when(F.max("_n") >= size, F.round(F.avg(F.when(where, F.col(value))), 6))
    return d.agg(
        mean(F.col(step) <= size).alias("head_mean"), mean(F.col(step) > F.col("_last") - size).alias("tail_mean"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.max_by(value, step).alias("final_value"),
    )


def length_profile(lengths: Column, limits: tuple[int, ...]) -> Column:
    """Most, upper median (element n // 2 of the sorted lengths) and the number above each limit."""
    ordered = F.sort_array(lengths)
    n = F.size(lengths)
    upper = F.when(n > 0, F.element_at(ordered, F.least(F.floor(n / 2).cast("int") + 1, n)))
    over = [F.size(F.filter(lengths, lambda x, m=m: x > m)).alias(f"over_{m}") for m in limits]
    return F.struct(F.array_max(lengths).alias("most"), upper.alias("upper_median"), *over)
