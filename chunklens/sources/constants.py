"""Published and measured figures that reports compare with, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The domains in the order of reports, their long names, questions, millions of characters and seconds a sample.
DOMAINS = ("single-doc", "multi-doc", "code-repo", "long-dialogue", "long-icl", "long-structured")
DOMAIN_NAMES = {
    "Single-Document QA": "single-doc",
    "Multi-Document QA": "multi-doc",
    "Code Repository Understanding": "code-repo",
    "Long In-context Learning": "long-icl",
    "Long-dialogue History Understanding": "long-dialogue",
    "Long Structured Data Understanding": "long-structured",
}
DOMAIN_TOTALS = {"single-doc": 175, "multi-doc": 125, "long-icl": 81, "code-repo": 50, "long-dialogue": 39, "long-structured": 33}
DOMAIN_CHARS = {"code-repo": 178.0, "single-doc": 77.1, "long-icl": 65.9, "multi-doc": 65.0, "long-structured": 39.9, "long-dialogue": 12.7}
SECONDS_A_SAMPLE = {"single-doc": 33.7, "multi-doc": 72.4, "long-icl": 55.6, "code-repo": 169.2, "long-dialogue": 23.0, "long-structured": 26.0}

# Accuracy in percent at 5 and at 10 chunks, as published and as measured, by method ("spans": sentences and spans together; "windows": 256 tokens).
PUBLISHED = {
    "windows": {"single-doc": (30.86, 35.43), "multi-doc": (24.80, 28.00), "code-repo": (44.00, 51.33), "long-icl": (27.57, 30.86), "long-dialogue": (26.50, 33.33), "long-structured": (15.15, 24.24), "overall": (28.76, 33.53)},
    "spans": {"single-doc": (35.43, 32.57), "multi-doc": (26.40, 26.40), "code-repo": (46.00, 44.00), "long-icl": (32.10, 28.40), "long-dialogue": (28.21, 23.08), "long-structured": (42.42, 45.45), "overall": (33.60, 31.61)},
}
MEASURED = {
    "spans": {"single-doc": (33.71, 33.71), "multi-doc": (28.00, 25.60), "code-repo": (48.00, 46.00), "long-dialogue": (28.21, 35.90), "long-icl": (25.93, 28.40), "long-structured": (30.30, 24.24), "overall": (31.81, 31.61)},
    "windows": {"single-doc": (30.86, 35.43), "multi-doc": (24.00, 28.00), "code-repo": (44.00, 52.00), "long-dialogue": (25.64, 33.33), "long-icl": (27.16, 30.86), "long-structured": (15.15, 24.24), "overall": (28.43, 33.60)},
}


def accuracies(spark: SparkSession, table: dict[str, dict[str, tuple[float, float]]]) -> DataFrame:
    """(method, domain, topk, acc_pct) of PUBLISHED or MEASURED."""
    rows = [(m, d, k, x) for m, own in table.items() for d, both in own.items() for k, x in zip((5, 10), both, strict=True)]
    return spark.createDataFrame(rows, "method string, domain string, topk int, acc_pct double")


def domain_facts(spark: SparkSession) -> DataFrame:
    """(domain, place, questions, mega_chars, seconds) of the six domains."""
    rows = [(d, i, DOMAIN_TOTALS[d], DOMAIN_CHARS[d], SECONDS_A_SAMPLE[d]) for i, d in enumerate(DOMAINS)]
    return spark.createDataFrame(rows, "domain string, place int, questions int, mega_chars double, seconds double")
