"""The corpus pipeline: five stages from raw documents to token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunklens.llm import bpe, mixing, order_minhash, quality, suffix_levels
from chunklens.llm.common import cut, table

#: (name, function); a function takes (spark, docs, sf_dir) and all but the last return the columns of documents.
STAGES = [
    ("quality rules", quality.keep_good),
    ("MinHash near-dedup", order_minhash.keep_one),
    ("suffix-array dedup", suffix_levels.cut_repeats),
    ("mixing sources to target weights", mixing.take_copies),
    ("byte-level BPE encoding and decoding", bpe.encode_documents),
]

#: Pivotal rounding and near-duplicate classes aren't expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is materialised in the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
