"""Named queries over rules for names, marks, vectors and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import evaluate as EV
from ..sources import writers
from .catalog import _ACC, _EVAL, _SENT, _docs, _records, _t, query


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '.?!;', '。？！；'), '[^。！？；]*[。！？；]|[^。！？；]+$') AS p FROM documents)
SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS sent_id, md5(unnest(p)) AS h FROM d""")
def sentence_split_full_width(spark, sf):
    """Documents whose marks were made full-width ones, cut after these."""
    d = _t(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences_cjk(F.translate("text", ".?!;", "。？！；"))).alias("sent_id", "s"))
    return d.select("doc_id", "sent_id", F.md5("s").alias("h"))


@query(f"""WITH {_SENT}, l AS (SELECT doc_id, md5(string_agg('ID ' || sent_id || ': ' || sentence, chr(10) ORDER BY sent_id)) AS lines_h, count(*)::INT AS n FROM sent GROUP BY doc_id)
SELECT l.doc_id, lines_h, n AS returned, l.doc_id::INT AS answer, lang || '+2' AS domains, CASE WHEN l.doc_id % 2 = 0 THEN 'traditional' ELSE 'm_' || source END AS method, CASE WHEN l.doc_id % 2 = 0 THEN 256 END AS size,
  (l.doc_id % 7)::INT AS shard, (l.doc_id % 3)::INT AS rep, l.doc_id % 5 = 0 AS is_shard FROM l JOIN documents USING (doc_id)""")
def name_rules(spark, sf):
    """Numbered lines and back, the number in a reply, an assignment, the facts in a file's name, and whether a folder is a shard's."""
    d = _docs(spark, sf).join(_t(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "source"), "doc_id").where(F.size("sentences") > 0)
    d = d.withColumn("lines", X.number_lines(F.col("sentences"))).withColumn("back", F.transform("lines", X.strip_number))
    same = F.size(F.filter(F.zip_with("back", "sentences", lambda a, b: a == F.regexp_replace(b, r"^ID \d+:\s*", "")), lambda x: x))
    reply = F.concat(F.lit("It changes here.\nAnswer: ID x"), F.col("doc_id").cast("string"), F.lit(" because"))
    work = X.assignment(F.concat(F.lit("2="), F.col("lang"), F.lit(",b;7=c")))
    method = F.when(F.col("doc_id") % 2 == 0, F.lit("traditional_256")).otherwise(F.concat(F.lit("m_"), "source"))
    name = F.concat(F.lit("raw_"), method, F.lit("_shard"), (F.col("doc_id") % 7).cast("string"), F.lit("_rep"), (F.col("doc_id") % 3).cast("string"), F.lit("_20250102_030405.jsonl"))
    d = d.withColumn("f", X.file_facts(name)).withColumn("work", work["2"])
    folder = F.concat(F.lit("set"), F.when(F.col("doc_id") % 5 == 0, F.lit(".shard3")).otherwise(F.lit(".gap")))
    return d.select(
        "doc_id", F.md5(F.array_join("lines", "\n")).alias("lines_h"), same.alias("returned"), X.answer_number(reply).alias("answer"), F.concat(F.col("work")[0], F.lit("+"), F.size("work").cast("string")).alias("domains"),
        "f.method", "f.size", "f.shard", "f.rep", F.startswith(folder, F.lit("set.shard")).alias("is_shard"),
    )


@query("""WITH v AS (SELECT vec_id, k, list_resize(embedding::DOUBLE[], k, 0.0) AS v FROM embeddings, (VALUES (32), (64), (96)) AS t(k))
SELECT vec_id, k AS size, len(v)::INT AS n, round(list_sum(v), 6) AS total, round(v[k], 6) AS last FROM v""")
def padded_vectors(spark, sf):
    """Vectors cut to 32 dimensions, as they are, and filled up to 96."""
    e = _t(spark, sf, "embeddings").select("vec_id", F.explode(F.array(*[F.struct(F.lit(k).alias("size"), V.pad(F.col("embedding"), k).alias("v")) for k in (32, 64, 96)])).alias("x"))
    return e.select("vec_id", "x.size", F.size("x.v").alias("n"), F.round(F.aggregate("x.v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.element_at("x.v", F.col("x.size")), 6).alias("last"))


_CELL = "coalesce(printf('%.2f', max(acc) FILTER (WHERE {})), '')"


@query(f"""WITH {_EVAL}, a AS (SELECT method, domain, topk, {_ACC} AS acc FROM (SELECT * FROM rec UNION ALL SELECT method, 'overall', topk, is_correct, run, doc_id FROM rec WHERE domain <> 'unknown') GROUP BY ALL),
o AS (SELECT method, '| ' || method || ' | ' || {_CELL.format("topk = 5")} || ' | ' || {_CELL.format("topk = 10")} || ' |' AS line FROM a WHERE domain = 'overall' GROUP BY method),
p AS (SELECT method, '| ' || method || ' | ' || {" || ' | ' || ".join(_CELL.format(f"domain = '{d}'") for d in ("de", "en", "es", "fr"))} || ' |' AS line FROM a WHERE topk = 5 AND domain <> 'overall' GROUP BY method),
x AS (SELECT 0 AS part, '' AS m, '| method | 5 | 10 |' AS line UNION ALL SELECT 1, '', '| --- | --- | --- |' UNION ALL SELECT 2, method, line FROM o
  UNION ALL SELECT 3, '', '' UNION ALL SELECT 4, '', '| method | de | en | es | fr |' UNION ALL SELECT 5, '', '| --- | --- | --- | --- | --- |' UNION ALL SELECT 6, method, line FROM p)
SELECT (row_number() OVER (ORDER BY part, m))::INT AS line_no, line FROM x""")
def markdown_report(spark, sf):
    """The report as markdown: overall accuracy by cut-off, and by domain at 5. Its lines are few, whatever the number of records."""
    a = EV.with_overall(_records(spark, sf), "method", "domain", "topk")
    overall = EV.pivot(a.where("domain = 'overall'"), "method", "topk", [5, 10])
    by_domain = EV.pivot(a.where("topk = 5 and domain <> 'overall'"), "method", "domain", ["de", "en", "es", "fr"])
    text = writers.markdown(overall) + "\n" + writers.markdown(by_domain)
    return spark.createDataFrame([(i + 1, line) for i, line in enumerate(text.rstrip("\n").split("\n"))], "line_no int, line string")
