"""Named queries for reports: names, orders, published figures, corpus statistics, chunks by meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming as N
from ..operators import chunkers as C
from ..operators import evaluate as EV
from ..operators import spans as S
from ..sources import constants as K
from .catalog import _SENT, _docs, _spans_sql, _t, query

_LONG = list(K.DOMAIN_NAMES)
_LABELS = {"src1": "First", "src2": "Second"}
_NAMED = f"""named AS (SELECT d.doc_id, {_LONG!r}[d.doc_id % 6 + 1] AS long_name, {list(K.DOMAIN_NAMES.values())!r}[d.doc_id % 6 + 1] AS domain,
  CASE source WHEN 'src1' THEN 'First' WHEN 'src2' THEN 'Second' ELSE source END AS method, lower({_LONG!r}[d.doc_id % 6 + 1]) AS sub_domain FROM documents AS d)"""


def _named(spark, sf):
    """Documents with the long name of a domain, mapped to its short one, and sources as methods by their labels."""
    d = _t(spark, sf, "documents").withColumn("long_name", F.element_at(F.array(*map(F.lit, _LONG)), (F.col("doc_id") % 6 + 1).cast("int")))
    return d.select("doc_id", "long_name", N.mapped(F.col("long_name"), K.DOMAIN_NAMES, "domain").alias("domain"), N.labelled(F.col("source"), _LABELS).alias("method"), F.lower("long_name").alias("sub_domain"))


@query(f"""WITH {_NAMED}, o AS (SELECT unnest({list(K.DOMAINS[:4])!r}) AS domain, unnest(range(4))::INT AS place)
SELECT method, domain, place, sub_domain, count(*) AS n FROM named JOIN o USING (domain) GROUP BY ALL""")
def domain_report(spark, sf):
    """Documents by method and domain, in the order of reports, for four domains that are asked for."""
    d = _named(spark, sf).where(N.admitted(F.col("domain"), K.DOMAINS[:4]))
    return d.groupBy("method", "domain", N.place(F.col("domain"), K.DOMAINS).alias("place"), "sub_domain").agg(F.count("*").alias("n"))


def _values(table) -> str:
    return ", ".join(f"('{m}', '{d}', {k}, {x})" for m, own in table.items() for d, both in own.items() for k, x in zip((5, 10), both, strict=True))


@query(f"""WITH {_NAMED}, rec AS (SELECT domain, k AS topk, coalesce((l.quality + l.doc_id + k) % 2 = 0, false) AS ok FROM labels AS l JOIN named USING (doc_id), (VALUES (5), (10)) AS t(k)),
every AS (SELECT * FROM rec UNION ALL SELECT 'overall', topk, ok FROM rec), ours AS (SELECT domain, topk, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 6) AS acc_pct FROM every GROUP BY ALL),
p(method, domain, topk, p) AS (VALUES {_values(K.PUBLISHED)}), b(method, domain, topk, b) AS (VALUES {_values(K.MEASURED)}),
f(domain, place, questions) AS (VALUES {", ".join(f"('{d}', {i}, {K.DOMAIN_TOTALS[d]})" for i, d in enumerate(K.DOMAINS))})
SELECT p.method, ours.domain, ours.topk, acc_pct, printf('%+.2f', acc_pct - p) AS vs_paper, printf('%+.2f', acc_pct - b) AS vs_base, coalesce(place, 6)::INT AS place, questions
FROM ours JOIN p ON p.domain = ours.domain AND p.topk = ours.topk JOIN b ON b.method = p.method AND b.domain = p.domain AND b.topk = p.topk LEFT JOIN f ON f.domain = ours.domain""")
def paper_gap(spark, sf):
    """Accuracy over all labelled documents beside the published and the measured one of each method, by domain and over all."""
    d = _t(spark, sf, "labels").join(_named(spark, sf).select("doc_id", "domain"), "doc_id").withColumn("topk", F.explode(F.array(F.lit(5), F.lit(10)))).withColumn("all", F.lit(1))
    d = d.withColumn("is_correct", F.coalesce((F.col("quality") + F.col("doc_id") + F.col("topk")) % 2 == 0, F.lit(False)))
    ours = EV.with_overall(d, "all", "domain", "topk").select("domain", "topk", "acc_pct")
    ours = ours.join(K.accuracies(spark, K.PUBLISHED).select("method", "domain", "topk"), ["domain", "topk"])
    d = EV.gaps(ours, K.accuracies(spark, K.PUBLISHED), K.accuracies(spark, K.MEASURED), ("method", "domain", "topk"))
    d = d.join(K.domain_facts(spark).select("domain", "questions"), "domain", "left")
    return d.select("method", "domain", "topk", "acc_pct", "vs_paper", "vs_base", N.place(F.col("domain"), K.DOMAINS).alias("place"), "questions")


@query(f"""WITH {_SENT}, {_spans_sql()}, m AS (SELECT doc_id, count(*) AS m FROM span GROUP BY doc_id)
SELECT round(avg(n), 6) AS mean_sentences, round(avg(m), 6) AS mean_spans, round(avg(n + m), 6) AS mean_rows, sum(n + m)::BIGINT AS n_rows FROM n JOIN m USING (doc_id)""")
def corpus_stats(spark, sf):
    """Means of sentences, spans and both, from the closed form of the number of spans."""
    d = _docs(spark, sf).select(F.size("sentences").alias("n")).where("n > 0").withColumn("m", S.span_count(F.col("n")))
    return d.agg(F.round(F.avg("n"), 6).alias("mean_sentences"), F.round(F.avg("m"), 6).alias("mean_spans"), F.round(F.avg(F.col("n") + F.col("m")), 6).alias("mean_rows"), F.sum(F.col("n") + F.col("m")).alias("n_rows"))


@query(rf"""WITH {_SENT}, tok AS (SELECT doc_id, sent_id, ('0x' || substr(md5(lower(w)), 1, 4))::INT % 16 AS b FROM (SELECT doc_id, sent_id, unnest(regexp_extract_all(sentence, '\S+')) AS w FROM sent)),
bag AS MATERIALIZED (SELECT doc_id, sent_id, b, count(*)::DOUBLE AS c FROM tok GROUP BY ALL),
nn AS MATERIALIZED (SELECT doc_id, sent_id, sum(c * c) AS sq FROM bag GROUP BY ALL),
dd AS MATERIALIZED (SELECT a.doc_id, a.sent_id, sum(a.c * b.c) AS d FROM bag AS a JOIN bag AS b ON a.doc_id = b.doc_id AND b.sent_id = a.sent_id + 1 AND a.b = b.b GROUP BY ALL),
g AS MATERIALIZED (SELECT x.doc_id, x.sent_id, round(1 - coalesce(d, 0) / ((sqrt(x.sq) + 1e-8) * (sqrt(y.sq) + 1e-8)), 9) AS gap FROM nn AS x JOIN nn AS y ON y.doc_id = x.doc_id AND y.sent_id = x.sent_id + 1 LEFT JOIN dd ON dd.doc_id = x.doc_id AND dd.sent_id = x.sent_id),
lim AS (SELECT doc_id, quantile_cont(gap, 0.5) AS l FROM g GROUP BY doc_id),
f AS (SELECT sent.doc_id, sent.sent_id, sentence, coalesce(lag(gap > l) OVER (PARTITION BY sent.doc_id ORDER BY sent.sent_id), false)::INT AS f FROM sent LEFT JOIN g ON g.doc_id = sent.doc_id AND g.sent_id = sent.sent_id LEFT JOIN lim ON lim.doc_id = sent.doc_id),
k AS (SELECT *, (sum(f) OVER (PARTITION BY doc_id ORDER BY sent_id))::INT AS chunk FROM f)
SELECT doc_id, chunk, md5(string_agg(sentence, ' ' ORDER BY sent_id)) AS h FROM k GROUP BY doc_id, chunk""")
def semantic_chunks(spark, sf):
    """Chunk texts by the distances of neighbouring sentences' vectors."""
    return C.by_meaning(_docs(spark, sf), "doc_id", "sentences").select("doc_id", "chunk", F.md5("chunk_text").alias("h"))
