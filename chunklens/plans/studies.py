"""Named queries that go through files, models and plug-ins, with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import vectors as V
from ..operators import answering as AN
from ..operators import chunkers as C
from ..operators import embedding as EM
from ..operators import etl as E
from ..operators import evaluate as EV
from ..operators import retrieve as R
from ..operators import spans as S
from ..session import scratch, ship
from ..sources import readers, writers
from ..streaming.incremental import chunk_new, token_chunks
from .catalog import _DIM, _LOSS, _RAG, _SENT, _asked, _docs, _loss, _t, query


def _place(spark) -> str:
    """A new folder among the shared ones."""
    return scratch(spark, "study")


# ---- models ----------------------------------------------------------------------------------


@query(rf"""WITH {_SENT}, tok AS (SELECT doc_id, sent_id, length(w) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, k) AS nr
  FROM (SELECT doc_id, sent_id, unnest(regexp_extract_all(sentence, '\S+')) AS w, generate_subscripts(regexp_extract_all(sentence, '\S+'), 1) AS k FROM sent)),
p AS (SELECT doc_id, sent_id, avg(l) FILTER (WHERE nr > 1) AS v FROM tok GROUP BY ALL),
m AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY sent_id)),
c AS (SELECT doc_id, sent_id, sum(lag_) OVER (PARTITION BY doc_id ORDER BY sent_id) AS chunk FROM (SELECT doc_id, sent_id, coalesce(lag((v < a AND v < b AND (a - v >= 0.5 OR b - v >= 0.5)) OR (v < a AND v = b AND a - v >= 0.5)) OVER (PARTITION BY doc_id ORDER BY sent_id), false)::INT AS lag_ FROM m))
SELECT doc_id, chunk::INT AS chunk, md5(string_agg(sentence, ' ' ORDER BY sent_id)) AS h FROM c JOIN sent USING (doc_id, sent_id) GROUP BY doc_id, chunk""")
def loss_chunks(spark, sf):
    """Chunks that end with minima of the mean token loss of sentences."""
    return C.by_loss(_docs(spark, sf), "doc_id", "sentences").select("doc_id", "chunk", F.md5("chunk_text").alias("h"))


@query(rf"""WITH {_SENT}, w AS (SELECT *, len(regexp_extract_all(sentence, '\S+')) AS k FROM sent),
c AS (SELECT doc_id, sent_id, sentence, sum(f) OVER (PARTITION BY doc_id ORDER BY sent_id) AS chunk FROM (SELECT *, coalesce(abs(k - lag(k) OVER (PARTITION BY doc_id ORDER BY sent_id)) >= 8, false)::INT AS f FROM w))
SELECT doc_id, chunk::INT AS chunk, md5(string_agg(sentence, ' ' ORDER BY sent_id)) AS h FROM c GROUP BY doc_id, chunk""")
def decided_chunks(spark, sf):
    """Chunks by a decision between neighbouring sentences."""
    return C.by_decision(_docs(spark, sf), "doc_id", "sentences").select("doc_id", "chunk", F.md5("chunk_text").alias("h"))


@query(r"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk, md5(c) AS h FROM (
  SELECT doc_id, k, regexp_replace(regexp_replace(x, '^[ \t\n\r\f\v]+', ''), '[ \t\n\r\f\v]+$', '') AS c FROM (
    SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^,;:.?!]+') AS p FROM documents))) WHERE c <> ''""")
def propositions(spark, sf):
    """Chunks of a Python function over the text."""
    return C.chunk_by(_t(spark, sf, "documents"), "doc_id", "text", C.clauses).select("doc_id", "chunk", F.md5("chunk_text").alias("h"))


@query(rf"""{_RAG.replace("rank <= 5", "rank <= 10")},
txt AS MATERIALIZED (SELECT h.doc_id, h.rank, string_agg(sentence, ' ' ORDER BY sent.sent_id) AS t FROM hit AS h JOIN holds ON holds.doc_id = h.doc_id AND holds.row_idx = h.row_idx JOIN sent ON sent.doc_id = holds.doc_id AND sent.sent_id = holds.sent_id GROUP BY ALL),
ctx AS MATERIALIZED (SELECT doc_id, 5 AS topk, string_agg(t, chr(10) || chr(10) ORDER BY rank) AS c FROM txt WHERE rank <= 5 GROUP BY ALL UNION ALL SELECT doc_id, 10, string_agg(t, chr(10) || chr(10) ORDER BY rank) FROM txt WHERE rank <= 10 GROUP BY ALL),
cut AS MATERIALIZED (SELECT doc_id, topk, c, regexp_extract_all(c, '\S+') AS w FROM ctx),
p AS MATERIALIZED (SELECT doc_id, topk, 'Context:' || chr(10) || CASE WHEN len(w) <= 300 THEN c ELSE array_to_string(w[1:300], ' ') END || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'A) yes' || chr(10) || 'B) no' || chr(10) || 'Reply with {{"answer": letter}}.' AS p FROM cut JOIN ask USING (doc_id)),
r AS (SELECT doc_id, topk, p, CASE WHEN ('0x' || substr(md5(lower(p)), 1, 4))::INT % 2 = 0 THEN 'A' ELSE 'B' END AS answer FROM p)
SELECT doc_id, topk, md5(p) AS prompt_h, answer, answer = CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS is_correct FROM r""")
def question_answering(spark, sf):
    """Each document asked once and answered for two cut-offs; the default model answers by a hash of the prompt."""
    d = R.search(_asked(spark, sf), "sentences", "question", 10).withColumn("topk", F.explode(F.array(F.lit(5), F.lit(10))))
    texts = F.transform(F.slice("hits", F.lit(1), F.col("topk")), lambda h: F.array_join(F.slice(F.col("sentences"), h["start"] + 1, h["len"]), " "))
    d = d.withColumn("p", X.prompt(X.truncate_tokens(F.array_join(texts, "\n\n"), F.lit(300)), F.col("question"), AN.choices(F.lit("yes"), F.lit("no"))))
    reply = F.concat(F.lit('I think {"answer": "'), F.when(X.bucket(F.col("p"), 2) == 0, "A").otherwise("B"), F.lit('"}'))
    d = d.withColumn("answer", X.parse_answer(reply))
    return d.select("doc_id", "topk", F.md5("p").alias("prompt_h"), "answer", (F.upper("answer") == F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B")).alias("is_correct"))


class HashedAnswers:
    """Answers by a hash of the prompt; one in sixteen replies names no letter."""

    def chat(self, prompt: str) -> str:
        n = int(hashlib.md5(prompt.encode()).hexdigest()[:4], 16)
        return "I can't tell." if n % 16 == 0 else f'I think {{"answer": "{AN.LETTERS[n // 16 % 4]}"}}, but look again.'


_SYSTEM = "You answer multiple choice questions."


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents),
c AS MATERIALIZED (SELECT doc_id, a // 64 AS win, array_to_string(w[a + 1:a + 64], ' ') AS c, w[a + 1:a + 64] AS w FROM (SELECT doc_id, w, unnest(range(0, len(w), 64)) AS a FROM t)),
cb AS MATERIALIZED (SELECT doc_id, win, b, count(*)::DOUBLE AS n FROM (SELECT doc_id, win, ('0x' || substr(md5(lower(x)), 1, 4))::INT % 64 AS b FROM (SELECT doc_id, win, unnest(w) AS x FROM c)) GROUP BY ALL),
ask AS MATERIALIZED (SELECT d.doc_id, q.text AS question FROM documents AS d JOIN benchmark AS q ON q.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
qb AS MATERIALIZED (SELECT doc_id, b, count(*)::DOUBLE AS n FROM (SELECT doc_id, ('0x' || substr(md5(lower(x)), 1, 4))::INT % 64 AS b FROM (SELECT doc_id, unnest(regexp_extract_all(question, '\S+')) AS x FROM ask)) GROUP BY ALL),
dot AS MATERIALIZED (SELECT cb.doc_id, win, sum(cb.n * qb.n) AS d FROM cb JOIN qb ON qb.doc_id = cb.doc_id AND qb.b = cb.b GROUP BY ALL),
cn AS MATERIALIZED (SELECT doc_id, win, sum(n * n) AS s FROM cb GROUP BY ALL), qn AS MATERIALIZED (SELECT doc_id, sum(n * n) AS s FROM qb GROUP BY ALL),
sim AS MATERIALIZED (SELECT cn.doc_id, cn.win, coalesce(d, 0) / (sqrt(cn.s) * sqrt(qn.s)) AS sim FROM cn JOIN qn ON qn.doc_id = cn.doc_id LEFT JOIN dot ON dot.doc_id = cn.doc_id AND dot.win = cn.win),
hit AS MATERIALIZED (SELECT doc_id, win, sim, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, win DESC) AS rank FROM sim),
ctx AS MATERIALIZED (SELECT hit.doc_id, k AS topk, string_agg(c, chr(10) || chr(10) ORDER BY rank) AS c, sum(sim) AS total, count(*) AS n FROM hit JOIN c ON c.doc_id = hit.doc_id AND c.win = hit.win, (VALUES (5), (10)) AS x(k) WHERE rank <= k GROUP BY ALL),
w AS MATERIALIZED (SELECT ctx.*, question, regexp_extract_all(c, '\S+') AS w, 400 - {len(_SYSTEM.split())} - 20 - len(regexp_extract_all(question, '\S+')) AS most FROM ctx JOIN ask ON ask.doc_id = ctx.doc_id),
p AS MATERIALIZED (SELECT doc_id, topk, total, n, 'Context:' || chr(10) || CASE WHEN len(w) <= most THEN c ELSE array_to_string(w[1:most], ' ') END || chr(10) || chr(10) || 'Question: ' || question || chr(10)
  || 'A) yes' || chr(10) || 'B) no' || chr(10) || 'C) both' || chr(10) || 'D) neither' || chr(10) || 'Reply with {{"answer": letter}}.' AS p FROM w),
r AS (SELECT *, ('0x' || substr(md5(p), 1, 4))::INT AS h FROM p),
a AS (SELECT *, CASE WHEN h % 16 = 0 THEN 'UNKNOWN' ELSE ['A', 'B', 'C', 'D'][h // 16 % 4 + 1] END AS model_answer FROM r)
SELECT doc_id::VARCHAR AS question_id, topk, n AS n_chunks, round(total, 6) AS similarity, md5(p) AS prompt_h, CASE WHEN h % 16 = 0 THEN 'I can''t tell.' ELSE 'I think {{"answer": "' || model_answer || '"}}, but look again.' END AS raw_response,
  model_answer, model_answer = ['A', 'B', 'C', 'D'][doc_id % 4 + 1] AS is_correct FROM a""")
def answer_records(spark, sf):
    """The whole record of each document's question over its windows of 64 words, for two cut-offs, from a model that sometimes names no answer."""
    q = _t(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    d = _t(spark, sf, "documents").withColumn("item_id", F.pmod(F.col("doc_id"), F.lit(q.count()))).join(q, "item_id")
    d = d.select(F.col("doc_id").cast("string").alias("question_id"), "question", F.col("lang").alias("domain"), F.col("text").alias("context"), F.element_at(F.array(*map(F.lit, AN.LETTERS)), (F.col("doc_id") % 4 + 1).cast("int")).alias("answer"))
    d = d.withColumn("choices", AN.choices(F.lit("yes"), F.lit("no"), F.lit("both"), F.lit("neither")))
    # a text with a word has chunks; a condition on the chunks would make them twice
    r = AN.records(AN.sample(d.where(F.col("context").rlike(r"\S")), X.token_windows(X.words(F.col("context")), 64), F.lit(0.0)), HashedAnswers, EM.hashed(), limit=400, system=_SYSTEM, reserve=20)
    total = F.aggregate("retrieved_chunks", F.lit(0.0), lambda s, x: s + x["similarity"])
    return r.select("question_id", "topk", F.size("retrieved_chunks").cast("long").alias("n_chunks"), F.round(total, 6).alias("similarity"), F.md5("prompt").alias("prompt_h"), "raw_response", "model_answer", "is_correct")


# ---- vectors ---------------------------------------------------------------------------------


@query(f"{_RAG}, f AS (SELECT doc_id, row_idx, sum(c) / sqrt(sum(c * c)) AS l1 FROM vec GROUP BY ALL) SELECT doc_id, count(*)::BIGINT AS n_rows, round(sum(l1), 4) AS l1 FROM f GROUP BY doc_id")
def vector_store(spark, sf):
    """Normalised vectors of sentences and of spans (the mean of theirs), built in the document's row."""
    d = _docs(spark, sf).where(F.size("sentences") > 0)
    ship(spark)
    d = d.select("doc_id", F.explode(EM.pooled(EM.hashed())(F.col("sentences"), S.store_rows(F.col("sentences")))).alias("embedding"))
    l1 = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.round(F.sum(l1), 4).alias("l1"))


@query(f"""WITH v AS ({_DIM}) SELECT a.vec_id, b.vec_id AS other, round(sum(a.x * b.x) / ((sqrt(sum(a.x * a.x)) + 1e-8) * (sqrt(sum(b.x * b.x)) + 1e-8)), 6) AS cosine
FROM v AS a JOIN v AS b ON a.vec_id // 8 = b.vec_id // 8 AND a.d = b.d GROUP BY ALL""")
def cosine_matrix(spark, sf):
    """The matrix of cosines inside each block of eight vectors."""
    ship(spark)
    e = _t(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 8).alias("b")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("m"))
    e = e.select(F.transform("m", lambda x: x["vec_id"]).alias("ids"), F.transform("m", lambda x: x["embedding"]).alias("v"))
    d = e.select("ids", F.posexplode(EM.cosines()("v", "v")).alias("i", "row")).select(F.col("ids")[F.col("i")].alias("vec_id"), "ids", F.posexplode("row").alias("j", "c"))
    return d.select("vec_id", F.col("ids")[F.col("j")].alias("other"), F.round("c", 6).alias("cosine"))


@query(f"{_LOSS} SELECT round(avg(1 - cos), 6) AS loss, count(*)::BIGINT AS n FROM (SELECT cos FROM k ORDER BY vec_id LIMIT 200)")
def validation_loss(spark, sf):
    """Mean loss over the first 200 rows: the limit is the feature."""
    return _loss(spark, sf).orderBy("vec_id").limit(200).agg(F.round(F.avg(1 - F.col("cos")), 6).alias("loss"), F.count("*").alias("n"))


@query(f"""{_RAG}, txt AS (SELECT holds.doc_id, row_idx, string_agg(sentence, ' ' ORDER BY sent.sent_id) AS t FROM holds JOIN sent ON sent.doc_id = holds.doc_id AND sent.sent_id = holds.sent_id GROUP BY ALL),
f AS (SELECT doc_id, row_idx, sum(c) / sqrt(sum(c * c)) AS l1 FROM vec GROUP BY ALL)
SELECT store.doc_id, store.row_idx::INT AS row_idx, store.start::INT AS start, store.len::INT AS len, md5(t) AS h, round(l1, 6) AS l1 FROM store JOIN txt USING (doc_id, row_idx) JOIN f USING (doc_id, row_idx)""")
def store_texts(spark, sf):
    """Every row of every store: its text beside its vector."""
    d = R.build_store(_docs(spark, sf).where(F.size("sentences") > 0), "doc_id", "sentences", EM.hashed())
    l1 = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x))
    return d.select("doc_id", "row_idx", "start", "len", F.md5("text").alias("h"), F.round(l1, 6).alias("l1"))


@query(f"""{_RAG}, again AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, row_idx DESC) AS r FROM ranked)
SELECT doc_id, r::INT AS rank, row_idx::INT AS row_idx, round(round(score, 9), 6) AS score FROM again WHERE r <= 5""")
def rag_topk_model(spark, sf):
    """As ``rag_topk_none``, by way of an encoder that is plugged in."""
    d = R.search(_asked(spark, sf), "sentences", "question", 5, model=EM.hashed())
    return d.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.rank", "h.row_idx", F.round("h.score", 6).alias("score"))


@query(f"""WITH RECURSIVE {_RAG.removeprefix("WITH ").replace("rank <= 5", "rank <= 10")},
h AS (SELECT doc_id, list({{'rank': rank, 'score': score, 'ids': range(start, start + len), 'len': len}} ORDER BY rank) AS hits FROM hit GROUP BY doc_id),
s AS (SELECT doc_id, hits, 0 AS it, CAST([] AS INT[]) AS chosen, CAST([] AS BIGINT[]) AS seen FROM h UNION ALL
  SELECT doc_id, hits, it + 1, list_append(chosen, b.rank), list_concat(seen, b.ids) FROM (
    SELECT doc_id, hits, it, chosen, seen, list_sort(list_transform(list_filter(hits, lambda x: NOT list_contains(chosen, x.rank)),
      lambda x: {{'gain': -x.score * len(list_filter(x.ids, lambda i: NOT list_contains(seen, i))) / x.len, 'rank': x.rank, 'ids': x.ids}}))[1] AS b FROM s WHERE it < 5) WHERE b IS NOT NULL),
best AS (SELECT doc_id, arg_max(chosen, it) AS chosen FROM s GROUP BY doc_id),
pick AS MATERIALIZED (SELECT doc_id, 'covering' AS selection, unnest(chosen) AS rank, generate_subscripts(chosen, 1) AS k FROM best UNION ALL SELECT doc_id, 'score', rank, rank FROM hit WHERE rank <= 5),
txt AS MATERIALIZED (SELECT h.doc_id, h.rank, any_value(h.len) AS len, string_agg(sentence, ' ' ORDER BY sent.sent_id) AS t FROM hit AS h JOIN holds ON holds.doc_id = h.doc_id AND holds.row_idx = h.row_idx JOIN sent ON sent.doc_id = holds.doc_id AND sent.sent_id = holds.sent_id GROUP BY ALL),
cover AS MATERIALIZED (SELECT pick.doc_id, selection, count(DISTINCT sent_id) AS sentences FROM pick JOIN hit ON hit.doc_id = pick.doc_id AND hit.rank = pick.rank JOIN holds ON holds.doc_id = hit.doc_id AND holds.row_idx = hit.row_idx GROUP BY ALL),
ctx AS MATERIALIZED (SELECT pick.doc_id, selection, string_agg(t, chr(10) || chr(10) ORDER BY k) AS c, sum(len) AS budget FROM pick JOIN txt ON txt.doc_id = pick.doc_id AND txt.rank = pick.rank GROUP BY ALL),
a AS (SELECT ctx.doc_id, selection, budget, sentences, ('0x' || substr(md5(c), 1, 4))::INT % 2 = ctx.doc_id % 2 AS ok FROM ctx JOIN cover USING (doc_id, selection))
SELECT selection, count(*) FILTER (WHERE ok) AS correct, count(*) AS total, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 6) AS acc_pct, sum(sentences)::BIGINT AS sentences, sum(budget)::BIGINT AS budget FROM a GROUP BY selection""")
def selection_ceiling(spark, sf):
    """What five of ten hits reach when chosen for what they cover, against the five best scores: accuracy of a judge, sentences covered, sentences paid for."""
    d = R.compare_selections(R.search(_asked(spark, sf), "sentences", "question", 10), "sentences", 5)
    right = F.conv(F.substring(F.md5("context"), 1, 4), 16, 10).cast("int") % 2 == F.col("doc_id") % 2
    d = d.groupBy("selection").agg(F.count_if(right).alias("correct"), F.count("*").alias("total"), F.sum(F.col("covered").cast("long")).alias("sentences"), F.sum(F.col("budget").cast("long")).alias("budget"))
    return d.withColumn("acc_pct", F.round(100.0 * F.col("correct") / F.col("total"), 6))


# ---- slices, orders, samples -----------------------------------------------------------------


@query("SELECT lang, doc_id, pos FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos >= 10 AND pos < 60")
def range_slice(spark, sf):
    return E.in_slice(_t(spark, sf, "documents").select("lang", "doc_id"), "lang", "doc_id", offset=10, limit=50).select("lang", "doc_id", "pos")


@query("SELECT doc_id, pos FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7:3:' || doc_id), doc_id) - 1 AS pos FROM documents) WHERE pos >= 40")
def epoch_order(spark, sf):
    """The order of epoch 3, taken up after 40 rows."""
    return E.epoch_order(_t(spark, sf, "documents").select("doc_id"), "doc_id", 7, 3, 40).select("doc_id", "pos")


@query("""WITH RECURSIVE c AS (SELECT lang, sum(n_chars)::DOUBLE AS cost FROM documents GROUP BY lang), l AS (SELECT list(lang ORDER BY lang) AS langs, list(cost ORDER BY lang) AS costs FROM c),
r AS (SELECT 0 AS k, langs, costs, list_transform(costs, lambda x: 1) AS w FROM l UNION ALL
  SELECT k + 1, langs, costs, list_transform(w, lambda n, i: CASE WHEN i = list_position(list_transform(costs, lambda c, j: c / w[j]), list_max(list_transform(costs, lambda c, j: c / w[j]))) THEN n + 1 ELSE n END) FROM r WHERE k < 12)
SELECT unnest(langs) AS lang, unnest(w)::INT AS workers FROM r WHERE k = 12""")
def spare_workers(spark, sf):
    """A worker for each language, and each of twelve spare ones to the language with most characters a worker."""
    d = _t(spark, sf, "documents").groupBy("lang").agg(F.sum("n_chars").alias("cost")).groupBy().agg(F.array_sort(F.collect_list(F.struct("lang", "cost"))).alias("c"))
    d = d.select("c", E.spare_split(F.transform("c", lambda x: x["cost"].cast("double")), 12).alias("w"))
    return d.select(F.explode(F.arrays_zip(F.transform("c", lambda x: x["lang"]).alias("lang"), F.col("w").alias("workers"))).alias("x")).select("x.lang", "x.workers")


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 20")
def seeded_sample(spark, sf):
    return E.seeded_sample(_t(spark, sf, "documents").select("doc_id"), "doc_id", 7, 20)


# ---- files -----------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS h FROM documents")
def torn_log(spark, sf):
    """All documents through a log where each line is followed by a torn and a blank one."""
    at = _place(spark)
    line = F.to_json(F.struct("doc_id", "text"))
    _t(spark, sf, "documents").select(F.explode(F.array(line, F.substring(line, 1, 9), F.lit("  "))).alias("value")).write.text(at)
    schema = _t(spark, sf, "documents").select("doc_id", "text").schema
    return readers.json_log(spark, at, schema).select("doc_id", F.md5("text").alias("h"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents) SELECT doc_id, ceil(len(w) / 256)::INT AS n_chunks, md5(array_to_string(w[1:256], ' ')) AS first_h FROM t""")
def incremental_log(spark, sf):
    """All documents appended to a log of JSON lines as they are done, in two runs with the second half of them new; torn lines of a broken run don't matter."""
    at, d = _place(spark), _t(spark, sf, "documents").select("doc_id", "text")
    half = d.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    for part in (d.where(F.col("doc_id") <= half), d.where(F.col("doc_id") > half)):
        part.write.mode("append").parquet(f"{at}/in")
        chunk_new(spark, f"{at}/in", d.schema, f"{at}/log", f"{at}/state", chunker=lambda x: token_chunks(x).drop("text"), form="json").awaitTermination()
    d.limit(1).select(F.lit('{"doc_id":').alias("value")).write.mode("append").text(f"{at}/log/torn")
    log = readers.json_log(spark, [f"{at}/log/*.json", f"{at}/log/torn"], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("chunks", T.ArrayType(T.StringType()))]))
    return log.select("doc_id", F.size("chunks").alias("n_chunks"), F.md5(F.coalesce(F.try_element_at("chunks", F.lit(1)), F.lit(""))).alias("first_h"))


@query("SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def csv_report(spark, sf):
    """A report written with a byte-order mark and read again."""
    at = _place(spark)
    writers.csv_report(_t(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")), at)
    return readers.csv_report(spark, at, "lang string, n long")


_ANSWER = """a AS (SELECT 'raw_' || method || '_shard' || shard || '_rep1_20250102_030405.jsonl' AS f, * FROM (
  SELECT l.doc_id, d.source AS method, d.lang, k AS topk, again, ((l.doc_id + again) % 3)::INT AS shard, (l.quality + again + k) % 2 = 0 AS is_correct, (l.doc_id % 10 + again) / 4.0 AS seconds
  FROM labels AS l JOIN documents AS d USING (doc_id), (VALUES (5), (10)) AS t(k), (VALUES (0), (1), (3)) AS u(again)))"""


@query(f"""WITH {_ANSWER}, r AS (SELECT *, row_number() OVER (PARTITION BY method, topk, doc_id ORDER BY f, again) AS n FROM a)
SELECT method, coalesce(lang, 'unknown') AS domain, topk, count(*) FILTER (WHERE is_correct) AS correct, count(*) AS total, round(sum(seconds), 6) AS seconds FROM r WHERE n = 1 GROUP BY ALL""")
def accuracy_first_wins(spark, sf):
    """Each question answered three times, in two or three files of its method and twice in one of them: the first in order of files and lines counts.
    Every second line of the files is blank or torn."""
    at = _place(spark)
    d = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", F.col("source").alias("method"), "lang"), "doc_id")
    d = d.withColumn("topk", F.explode(F.array(F.lit(5), F.lit(10)))).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))))
    name = F.concat(F.lit("raw_"), "method", F.lit("_shard"), ((F.col("doc_id") + F.col("again")) % 3).cast("string"), F.lit("_rep1_20250102_030405.jsonl"))
    record = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("question_id"), "topk", ((F.col("quality") + F.col("again") + F.col("topk")) % 2 == 0).alias("is_correct"), ((F.col("doc_id") % 10 + F.col("again")) / 4.0).alias("total_sample_time")))
    d = d.select(name.alias("_name"), "doc_id", "again", "topk", record.alias("value")).repartition("_name").sortWithinPartitions("_name", "doc_id", "again", "topk")
    torn = F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.substring("value", 1, 20))
    d.select("_name", F.explode(F.array("value", torn)).alias("value")).write.partitionBy("_name").text(at)
    ids = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("question_id"), F.col("lang").alias("domain"))
    r = EV.first_answers(readers.result_lines(spark, at), ids)
    return r.groupBy("method", "domain", "topk").agg(F.count_if("is_correct").alias("correct"), F.count("*").alias("total"), F.round(F.sum("total_sample_time"), 6).alias("seconds"))


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 0 WHEN lang = 'en' THEN 1 ELSE 2 END AS src_prio FROM documents")
def dataset_family(spark, sf):
    """A dataset, its shard and its gap fill, written as folders, found by name and merged with the first winning."""
    at, d = _place(spark), _t(spark, sf, "documents").select("doc_id", "lang")
    d.join(_t(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi").write.parquet(f"{at}/set")
    d.where("lang = 'en'").write.parquet(f"{at}/set.shard0")
    d.write.parquet(f"{at}/set.gap")
    return E.merge_sources(readers.read_family(spark, at, "set"), "doc_id", "doc_id").select("doc_id", "src_prio")


@query("SELECT doc_id, md5(text) AS h FROM documents")
def resumed_parts(spark, sf):
    """Blocks of documents appended twice, then replaced in place and read as a store: nothing comes twice."""
    at, d = _place(spark), E.numbered(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    for _ in range(2):
        writers.parts(d.withColumn("block", E.block(F.col("pos"), 100)), f"{at}/parts")
    for _ in range(2):
        writers.replace(spark.read.parquet(f"{at}/parts"), f"{at}/store")
    return readers.store(spark, f"{at}/store").select("doc_id", F.md5("text").alias("h"))
