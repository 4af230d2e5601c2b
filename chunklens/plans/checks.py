"""Named queries that build stores, hold them against manifests, and merge them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import embedding as EM
from ..operators import etl as E
from ..operators import stores as ST
from .catalog import _SENT, _spans_sql, _t, query
from .studies import _place

_POS = f"""WITH {_SENT}, d AS MATERIALIZED (SELECT documents.doc_id, lang AS corpus_split, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY lang ORDER BY documents.doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total
  FROM documents LEFT JOIN n USING (doc_id)),
m AS MATERIALIZED (SELECT corpus_split, pos // ceil(total / 3.0)::BIGINT AS shard, min(pos) AS lo, max(pos) + 1 AS hi, count(*) FILTER (WHERE n >= 2) AS n_records, count(*) FILTER (WHERE n < 2) AS n_short_docs FROM d GROUP BY ALL)"""


def _texts(spark, sf):
    return ST.corpus(_t(spark, sf, "documents").select("doc_id", "lang", X.sentences(F.col("text")).alias("sentences")), "lang", "doc_id", "sentences")


def _built(spark, sf):
    """All documents as a store of three shards in each language."""
    at, texts = _place(spark), _texts(spark, sf)
    ST.write_shards(texts, at, 3, EM.hashed(16))
    return at, texts


@query(f"""{_POS}, {_spans_sql()}, v AS (SELECT corpus_split, shard, sum(k) AS n_vectors FROM (SELECT doc_id, count(*) AS k FROM span GROUP BY doc_id) AS c JOIN d USING (doc_id)
  JOIN (SELECT doc_id, pos // ceil(total / 3.0)::BIGINT AS shard FROM d) AS s USING (doc_id) WHERE n >= 2 GROUP BY ALL),
a AS (SELECT corpus_split, pos // ceil(total / 3.0)::BIGINT AS shard, sum(n) AS atoms FROM d WHERE n >= 2 GROUP BY ALL)
SELECT corpus_split, shard, lo, hi, n_records, n_short_docs, (n_vectors + atoms)::BIGINT AS n_vectors FROM m JOIN v USING (corpus_split, shard) JOIN a USING (corpus_split, shard)""")
def shard_manifests(spark, sf):
    """What the manifests of a built store say of its shards."""
    at, _ = _built(spark, sf)
    return ST.read_manifests(spark, at).select("corpus_split", "shard", "lo", "hi", "n_records", "n_short_docs", "n_vectors")


_LABEL = """i AS MATERIALIZED (SELECT d.corpus_split, pos AS lo, pos + 2 + labels.doc_id % 5 AS hi, quality::BIGINT AS n_records, toxic::BIGINT AS n_short_docs, labels.doc_id % 7 AS n_vectors FROM labels JOIN d USING (doc_id))"""


@query(f"""{_POS}, {_LABEL},
c AS MATERIALIZED (SELECT d.corpus_split, pos, n FROM d WHERE EXISTS (SELECT 1 FROM i WHERE i.corpus_split = d.corpus_split AND lo <= pos AND pos < hi)),
f AS (SELECT corpus_split, count(*) AS found FROM d WHERE n >= 2 GROUP BY ALL),
s AS (SELECT corpus_split, sum(n_records)::BIGINT AS declared, sum(n_short_docs)::BIGINT AS n_short_docs, sum(n_vectors)::BIGINT AS n_vectors FROM i GROUP BY ALL),
u AS (SELECT *, sum(fresh) OVER (PARTITION BY corpus_split ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT corpus_split, lo, hi, coalesce(lo > max(hi) OVER (PARTITION BY corpus_split ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM i)),
r AS (SELECT corpus_split, string_agg('[' || lo || ',' || hi || ')', ' ' ORDER BY lo) AS ranges FROM (SELECT corpus_split, min(lo) AS lo, max(hi) AS hi FROM u GROUP BY corpus_split, g) GROUP BY ALL)
SELECT r.corpus_split, md5(ranges) AS ranges_h, expected, declared, found, n_short_docs, n_vectors, expected = declared AND declared = found AS complete
FROM r JOIN s USING (corpus_split) JOIN f USING (corpus_split) JOIN (SELECT corpus_split, count(*) FILTER (WHERE n >= 2) AS expected FROM c GROUP BY ALL) USING (corpus_split)""")
def manifest_coverage(spark, sf):
    """Each labelled document declares a few positions from its own on; overlapping and touching ones are one range, and some are past the end."""
    texts = _texts(spark, sf)
    at = E.in_slice(_t(spark, sf, "documents").select(F.col("lang").alias("corpus_split"), "doc_id"), "corpus_split", "doc_id").select("corpus_split", "doc_id", F.col("pos").alias("lo"))
    m = _t(spark, sf, "labels").join(at, "doc_id").select(
        "corpus_split", "lo", (F.col("lo") + 2 + F.col("doc_id") % 5).alias("hi"), F.col("quality").cast("long").alias("n_records"), F.col("toxic").cast("long").alias("n_short_docs"), (F.col("doc_id") % 7).alias("n_vectors")
    )
    d = ST.coverage(texts, m, texts.where(F.size("sentences") >= 2))
    return d.select("corpus_split", F.md5("ranges").alias("ranges_h"), "expected", "declared", "found", "n_short_docs", "n_vectors", "complete")


@query(f"""{_POS}, t AS (SELECT count(*) FILTER (WHERE n >= 2) AS k FROM d)
SELECT unnest(['columns', 'input_type', 'label_type', 'shape', 'dim', 'finite', 'rows_covered', 'rows_declared']) AS "check", true AS passed,
  unnest(['input label', 'array<array<float>>', 'array<array<float>>', '0 of ' || k || ' rows', '0 of ' || k || ' rows', '0 of ' || k || ' rows', k || ' of ' || k, k || ' of ' || k]) AS detail FROM t""")
def data_gate(spark, sf):
    """All checks of a store built from all documents and merged."""
    at, texts = _built(spark, sf)
    ST.merge(spark, at, f"{at}/store", 16)
    return ST.gate(spark.read.parquet(f"{at}/store"), texts, ST.read_manifests(spark, at), 16)


@query(f"""{_POS} SELECT 'store' AS split, sum(n_records)::BIGINT AS "rows", count(*)::BIGINT AS n_parts, sum(n_records)::BIGINT AS declared,
  string_agg(coalesce(corpus_split, '') || ':' || shard || ':' || lo || '-' || hi || ':' || n_records || ':' || n_short_docs, ' ' ORDER BY corpus_split, shard) AS shards FROM m""")
def merged_store(spark, sf):
    """The manifest of a store that was merged from shards and published, twice over."""
    at, _ = _built(spark, sf)
    ST.merge(spark, at, f"{at}/store", 16)
    m = ST.merge(spark, at, f"{at}/store", 16)
    one = lambda s: F.concat_ws(":", F.coalesce(s["corpus_split"], F.lit("")), s["shard"], F.concat_ws("-", s["lo"], s["hi"]), s["n_records"], s["n_short_docs"])
    return m.select("split", "rows", F.col("n_parts").cast("long").alias("n_parts"), "declared", F.array_join(F.transform("shards", one), " ").alias("shards"))
