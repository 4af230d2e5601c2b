"""Named queries and the DuckDB SQL that gives the same rows.

Texts come out as md5 so that results stay small; doubles are rounded to six places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as X
from ..functions import vectors as V
from ..operators import boundaries as B
from ..operators import embedding as EM
from ..operators import etl as E
from ..operators import evaluate as EV
from ..operators import gates as G
from ..operators import retrieve as R
from ..operators import spans as S
from ..session import scratch, ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", X.sentences(F.col("text")).alias("sentences"))


# Shared SQL: sentences with their numbers, and spans of [2, 4] of each document.
_SENT = r"""
sent AS MATERIALIZED (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS sent_id, s AS sentence FROM (
  SELECT doc_id, k, regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '') AS s FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[^.?!]+[.?!]*')) AS x, generate_subscripts(regexp_extract_all(text, '[^.?!]+[.?!]*'), 1) AS k FROM documents))
  WHERE s <> ''),
n AS MATERIALIZED (SELECT doc_id, count(*)::INT AS n FROM sent GROUP BY doc_id)"""


def _spans_sql(granularities=(2, 4)) -> str:
    parts = []
    for o, g in enumerate(granularities):
        step = max(1, g // 2)
        parts.append(f"SELECT doc_id, {o} AS o, {g} AS granularity, unnest(range(0, n - {g} + 1, {step}))::INT AS start, {g} AS len, n FROM n WHERE n >= {g}")
        parts.append(f"SELECT doc_id, {o}, {g}, n - {g}, {g}, n FROM n WHERE n >= {g} AND (n - {g}) % {step} <> 0")
    parts.append(f"SELECT doc_id, 9, n, 0, n, n FROM n WHERE n > 0 AND n < {min(granularities)}")
    return f"span0 AS ({' UNION ALL '.join(parts)}), span AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o, start) - 1)::INT AS span_id, granularity, start, len, n FROM span0)"


# ---- splitting -------------------------------------------------------------------------------


@query(f"WITH {_SENT} SELECT doc_id, sent_id, md5(sentence) AS h FROM sent")
def sentence_split(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode("sentences").alias("sent_id", "s")).select("doc_id", "sent_id", F.md5("s").alias("h"))


@query(r"""
WITH cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
x AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS k FROM cut)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS sent_id, md5(s) AS h FROM x WHERE s <> ''""")
def sentence_split_ws(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences_after_blank(F.col("text"))).alias("sent_id", "s"))
    return d.select("doc_id", "sent_id", F.md5("s").alias("h"))


@query(r"""
WITH x AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[^.?!]+[.?!]*')) AS raw, generate_subscripts(regexp_extract_all(text, '[^.?!]+[.?!]*'), 1) AS k FROM documents),
pl AS (SELECT doc_id, k, raw, text, (coalesce(length(regexp_extract(text, '^[.?!]+')), 0) + sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY k) - length(raw))::INT AS pos FROM x),
y AS (SELECT doc_id, k, pos + length(regexp_extract(raw, '^\s*')) AS a, regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '') AS s FROM pl)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS sent_id, a::INT AS start, (a + length(s))::INT AS "end" FROM y WHERE s <> ''""")
def sentence_positions(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", X.positions(F.col("text"), X.sentences(F.col("text"))).alias("p"))
    return d.select("doc_id", F.posexplode("p").alias("sent_id", "x")).select("doc_id", "sent_id", "x.start", "x.end")


def _windows(size: int, overlap: int):
    step = max(1, size - overlap)
    sql = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w), {step})) AS a FROM t)
SELECT doc_id, (a // {step})::INT AS chunk_id, md5(array_to_string(w[a + 1:a + {size}], ' ')) AS h, len(w[a + 1:a + {size}])::INT AS n_tokens FROM s"""

    @query(sql, f"token_windows_{size}_{overlap}")
    def run(spark, sf):
        d = _t(spark, sf, "documents").select("doc_id", F.posexplode(X.token_windows(X.words(F.col("text")), size, overlap)).alias("chunk_id", "c"))
        return d.select("doc_id", "chunk_id", F.md5("c").alias("h"), X.word_count(F.col("c")).alias("n_tokens"))


_windows(256, 0)
_windows(256, 32)
_windows(4096, 0)


@query(r"""SELECT doc_id, CASE WHEN len(w) <= 200 THEN md5(text) ELSE md5(array_to_string(w[1:200], ' ')) END AS h, least(len(w), 200)::INT AS n_tokens
FROM (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS w FROM documents)""")
def truncate_context(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", X.truncate_tokens(F.col("text"), F.lit(200)).alias("c"))
    return d.select("doc_id", F.md5("c").alias("h"), X.word_count(F.col("c")).alias("n_tokens"))


@query(f"""WITH {_SENT} SELECT doc_id, sent_id, md5(CASE WHEN len(w) > 1024 THEN array_to_string(w[1:256], ' ') || '...' WHEN len(w) > 512 THEN array_to_string(w[1:512], ' ') || '...' ELSE sentence END) AS h
FROM (SELECT *, regexp_extract_all(sentence, '\\S+') AS w FROM sent)""")
def long_sentences_shortened(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.posexplode("sentences").alias("sent_id", "s"))
    return d.select("doc_id", "sent_id", F.md5(X.shorten(F.col("s"))).alias("h"))


# ---- spans and stores ------------------------------------------------------------------------


@query(f"WITH {_SENT}, {_spans_sql()} SELECT doc_id, count(*)::BIGINT AS n_spans FROM span GROUP BY doc_id")
def span_count(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.size("sentences").alias("n")).where("n > 0")
    return d.select("doc_id", S.span_count(F.col("n")).alias("n_spans"))


@query(f"WITH {_SENT}, {_spans_sql()} SELECT doc_id, span_id, granularity, start, len FROM span")
def span_enumerate(spark, sf):
    return S.enumerate_spans(_docs(spark, sf)).select("doc_id", "span_id", "granularity", "start", "len")


@query(f"""WITH {_SENT}, {_spans_sql()} SELECT span.doc_id, span_id, md5(string_agg(sentence, ' ' ORDER BY sent_id)) AS h
FROM span JOIN sent ON sent.doc_id = span.doc_id AND sent_id >= start AND sent_id < start + len GROUP BY span.doc_id, span_id""")
def span_text(spark, sf):
    return S.enumerate_spans(_docs(spark, sf)).select("doc_id", "span_id", F.md5("span_text").alias("h"))


def _windowed_sql(width: int) -> str:
    inner = _spans_sql().replace("FROM n ", "FROM nw ").replace("doc_id,", "doc_id, win,").replace("PARTITION BY doc_id, win,", "PARTITION BY doc_id,")
    inner = inner.replace("(PARTITION BY doc_id ORDER BY o, start)", "(PARTITION BY doc_id ORDER BY win, o, start)")
    return f"""WITH {_SENT}, w0 AS (SELECT doc_id, n AS total, unnest(range(0, n, {width})) AS a FROM n), nw AS (SELECT doc_id, a AS win, least({width}, total - a)::INT AS n FROM w0), {inner}
SELECT doc_id, granularity, (start + win)::INT AS start, len FROM span"""


@query(_windowed_sql(50))
def sentence_window_spans(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.explode(S.windowed_spans(F.size("sentences"), 50)).alias("p"))
    return d.select("doc_id", "p.granularity", "p.start", "p.len")


@query(f"WITH {_SENT}, {_spans_sql()} SELECT n.doc_id, n.n AS n_atoms, c.c AS n_spans, (n.n + c.c)::BIGINT AS n_rows FROM n JOIN (SELECT doc_id, count(*)::INT AS c FROM span GROUP BY doc_id) AS c ON c.doc_id = n.doc_id")
def vector_store_rows(spark, sf):
    d = _docs(spark, sf).where(F.size("sentences") > 0).select("doc_id", F.size("sentences").alias("n_atoms"), F.size(S.store_rows(F.col("sentences"))).cast("long").alias("n_rows"))
    return d.select("doc_id", "n_atoms", (F.col("n_rows") - F.col("n_atoms")).cast("int").alias("n_spans"), "n_rows")


@query(f"""WITH {_SENT}, {_spans_sql()}, a AS (SELECT doc_id, list(md5(sentence) ORDER BY sent_id) AS input FROM sent GROUP BY doc_id),
tx AS (SELECT span.doc_id, span_id, md5(string_agg(sentence, ' ' ORDER BY sent_id)) AS h FROM span JOIN sent ON sent.doc_id = span.doc_id AND sent_id >= start AND sent_id < start + len GROUP BY span.doc_id, span_id),
b AS (SELECT doc_id, list(h ORDER BY span_id) AS label FROM tx GROUP BY doc_id)
SELECT a.doc_id, md5(array_to_string(input, ',')) AS input_h, md5(array_to_string(label, ',')) AS label_h, len(input)::INT AS n_input, len(label)::INT AS n_label FROM a JOIN b USING (doc_id) WHERE len(input) >= 2""")
def training_pairs(spark, sf):
    d = _docs(spark, sf).where(F.size("sentences") >= 2).withColumn("sp", S.spans(F.size("sentences")))
    d = d.withColumn("a", F.transform("sentences", F.md5)).withColumn("b", F.transform("sp", lambda p: F.md5(S.span_text(F.col("sentences"), p["start"], p["len"]))))
    return d.select("doc_id", F.md5(F.array_join("a", ",")).alias("input_h"), F.md5(F.array_join("b", ",")).alias("label_h"), F.size("a").alias("n_input"), F.size("b").alias("n_label"))


# ---- vectors ---------------------------------------------------------------------------------

_DIM = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings"


def _pool(how: str):
    value = {"mean": "avg(x)", "max": "max(x)", "first": "arg_min(x, vec_id)", "last": "arg_max(x, vec_id)"}[how]

    @query(f"SELECT label, d::INT AS dim, round({value}, 6) AS x FROM ({_DIM}) GROUP BY label, d", f"span_pool_{how}")
    def run(spark, sf):
        d = _t(spark, sf, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("p", "x"))
        x = F.col("x").cast("double")
        agg = {"mean": F.avg(x), "max": F.max(x), "first": F.min_by(x, "vec_id"), "last": F.max_by(x, "vec_id")}[how]
        return d.groupBy("label", (F.col("p") + 1).alias("dim")).agg(F.round(agg, 6).alias("x"))


for _how in ("mean", "max", "first", "last"):
    _pool(_how)


@query(f"WITH v AS ({_DIM}), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY vec_id) SELECT vec_id, round(sum(abs(x / (n + 1e-8))), 6) AS l1, round(sqrt(sum((x / (n + 1e-8)) ** 2)), 6) AS l2 FROM v JOIN n USING (vec_id) GROUP BY vec_id")
def l2_normalize(spark, sf):
    d = _t(spark, sf, "embeddings").select("vec_id", V.normalize(F.col("embedding")).alias("v"))
    return d.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"), F.round(V.norm(F.col("v")), 6).alias("l2"))


@query(f"""WITH v AS ({_DIM}), p AS (SELECT a.vec_id, sum(a.x * b.x) AS d, sqrt(sum(a.x * a.x)) AS na, sqrt(sum(b.x * b.x)) AS nb FROM v AS a JOIN v AS b ON b.vec_id = a.vec_id + 1 AND a.d = b.d GROUP BY a.vec_id)
SELECT vec_id, round(d / ((na + 1e-8) * (nb + 1e-8)), 6) AS cosine FROM p""")
def cosine_pairs(spark, sf):
    d = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    n = d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return d.join(n, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query("""WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id < 5),
s AS (SELECT q, vec_id, list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) AS s FROM q, embeddings),
r AS (SELECT q, vec_id, (row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, vec_id DESC))::INT AS rank FROM s)
SELECT q, vec_id, rank, k AS topk FROM r, (VALUES (5), (10)) AS t(k) WHERE rank <= k""")
def dot_topk_5_10(spark, sf):
    e = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    # five stated queries, a fixed number of rows
    q = F.broadcast(e.where("vec_id < 5").select(F.col("vec_id").alias("q"), F.col("embedding").alias("e")))
    scored = e.crossJoin(q).select("q", "vec_id", F.round(V.dot(F.col("e"), F.col("embedding")), 9).alias("s"))
    return R.several_k(R.top_k(scored, "q", "s", "vec_id", 10), (5, 10)).select("q", "vec_id", "rank", "topk")


_LOSS = f"""WITH v AS ({_DIM}), c AS (SELECT label, d, avg(x) AS c FROM v GROUP BY label, d),
k AS (SELECT vec_id, sum(x * c) / ((sqrt(sum(x * x)) + 1e-8) * (sqrt(sum(c * c)) + 1e-8)) AS cos, any_value(label) AS label FROM v JOIN c USING (label, d) GROUP BY vec_id)"""


def _loss(spark, sf) -> DataFrame:
    e = _t(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    x = e.select("vec_id", "label", F.posexplode("embedding").alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    c = x.groupBy("label", "d").agg(F.avg("x").alias("c"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda s: s["c"]).alias("centre"))
    return e.join(c, "label").select("vec_id", "label", V.cosine(F.col("embedding"), F.col("centre")).alias("cos"))


@query(f"{_LOSS} SELECT round(avg(1 - cos), 6) AS loss FROM k")
def cosine_loss(spark, sf):
    return _loss(spark, sf).agg(F.round(F.avg(1 - F.col("cos")), 6).alias("loss"))


@query(f"{_LOSS} SELECT round(sum((label + 1) * (1 - cos)) / sum(label + 1), 6) AS loss FROM k")
def cosine_loss_weighted(spark, sf):
    w = F.col("label") + 1
    return _loss(spark, sf).agg(F.round(F.sum(w * (1 - F.col("cos"))) / F.sum(w), 6).alias("loss"))


# ---- retrieval -------------------------------------------------------------------------------

_RAG = rf"""WITH {_SENT}, {_spans_sql()},
store AS MATERIALIZED (SELECT doc_id, sent_id AS row_idx, sent_id AS start, 1 AS len FROM sent UNION ALL SELECT doc_id, n + span_id, start, len FROM span),
holds AS MATERIALIZED (SELECT doc_id, row_idx, unnest(range(start, start + len))::INT AS sent_id FROM store),
tok AS (SELECT doc_id, sent_id, ('0x' || substr(md5(lower(w)), 1, 4))::INT % 64 AS b FROM (SELECT doc_id, sent_id, unnest(regexp_extract_all(sentence, '\S+')) AS w FROM sent)),
bag AS MATERIALIZED (SELECT doc_id, sent_id, b, count(*) AS c FROM tok GROUP BY ALL),
vec AS MATERIALIZED (SELECT holds.doc_id, row_idx, b, sum(c) AS c FROM holds JOIN bag ON bag.doc_id = holds.doc_id AND bag.sent_id = holds.sent_id GROUP BY ALL),
items AS (SELECT count(*) AS m FROM benchmark),
ask AS MATERIALIZED (SELECT d.doc_id, q.text AS question FROM documents AS d JOIN benchmark AS q ON q.item_id = d.doc_id % (SELECT m FROM items)),
qb AS MATERIALIZED (SELECT doc_id, b, count(*) AS c FROM (SELECT doc_id, ('0x' || substr(md5(lower(w)), 1, 4))::INT % 64 AS b FROM (SELECT doc_id, unnest(regexp_extract_all(question, '\S+')) AS w FROM ask)) GROUP BY ALL),
sc AS (SELECT v.doc_id, row_idx, coalesce(sum(v.c * q.c), 0)::BIGINT AS dot, sum(v.c * v.c)::BIGINT AS sq FROM vec AS v LEFT JOIN qb AS q ON q.doc_id = v.doc_id AND q.b = v.b GROUP BY ALL),
ranked AS MATERIALIZED (SELECT s.doc_id, s.row_idx, s.start, s.len, coalesce(dot / sqrt(sq::DOUBLE), 0) AS score FROM store AS s LEFT JOIN sc USING (doc_id, row_idx) JOIN ask USING (doc_id)),
hit AS MATERIALIZED (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, row_idx DESC))::INT AS rank FROM ranked) WHERE rank <= 5)"""


def _asked(spark, sf) -> DataFrame:
    """Every document with the question whose number is its id by the number of questions."""
    q = _t(spark, sf, "benchmark")
    n = q.count()
    d = _docs(spark, sf).where(F.size("sentences") > 0).withColumn("item_id", F.pmod(F.col("doc_id"), F.lit(n)))
    return d.join(q.select("item_id", F.col("text").alias("question")), "item_id")


@query(f"{_RAG} SELECT doc_id, rank, row_idx::INT AS row_idx, len::INT AS len, round(score, 6) AS score FROM hit")
def rag_topk_none(spark, sf):
    d = R.retrieve(_asked(spark, sf), "sentences", "question", 5).select("doc_id", F.explode("hits").alias("h"))
    return d.select("doc_id", "h.rank", "h.row_idx", "h.len", F.round("h.score", 6).alias("score"))


@query(f"""{_RAG}, ids AS (SELECT DISTINCT h.doc_id, sent.sent_id, sentence FROM hit AS h JOIN holds ON holds.doc_id = h.doc_id AND holds.row_idx = h.row_idx JOIN sent ON sent.doc_id = holds.doc_id AND sent.sent_id = holds.sent_id),
g AS (SELECT *, lag(sent_id) OVER (PARTITION BY doc_id ORDER BY sent_id) AS p FROM ids)
SELECT doc_id, md5(string_agg(CASE WHEN p IS NOT NULL AND sent_id <> p + 1 THEN '...' ELSE '' END || sentence, '' ORDER BY sent_id)) AS context_md5, count(*)::INT AS n_sentences FROM g GROUP BY doc_id""")
def rag_post_aggregate(spark, sf):
    d = R.retrieve(_asked(spark, sf), "sentences", "question", 5, "post")
    return d.select("doc_id", F.md5("context").alias("context_md5"), F.size(F.array_distinct(R.covered(F.col("hits")))).alias("n_sentences"))


@query(f"""{_RAG}, ids AS (SELECT h.doc_id, sent.sent_id FROM hit AS h JOIN holds ON holds.doc_id = h.doc_id AND holds.row_idx = h.row_idx JOIN sent ON sent.doc_id = holds.doc_id AND sent.sent_id = holds.sent_id)
SELECT doc_id, round(count(DISTINCT sent_id) / count(*), 6) AS redundancy, (max(sent_id) - min(sent_id))::INT AS dispersion FROM ids GROUP BY doc_id""")
def redundancy_dispersion(spark, sf):
    d = R.search(_asked(spark, sf), "sentences", "question", 5)
    return d.select("doc_id", F.round(R.redundancy(F.col("hits")), 6).alias("redundancy"), R.dispersion(F.col("hits")).alias("dispersion"))


@query(f"""{_RAG}, sets AS (SELECT unnest(range(1, 8))::INT AS subset),
bits AS (SELECT r.*, CASE WHEN row_idx < n.n THEN 1 WHEN len = 4 AND n.n >= 2 THEN 4 ELSE 2 END AS bit FROM ranked AS r JOIN n USING (doc_id)),
best AS (SELECT doc_id, subset, row_idx, start, len, score, row_number() OVER (PARTITION BY doc_id, subset ORDER BY score DESC, row_idx DESC) AS rank FROM bits, sets WHERE bit & subset > 0)
SELECT doc_id, subset, count(*) AS n_hits, string_agg(row_idx::VARCHAR, ',' ORDER BY rank) AS hits, round(max(score), 6) AS best, round(sum(score), 6) AS total FROM best WHERE rank <= 5 GROUP BY doc_id, subset""")
def granularity_ablation(spark, sf):
    """The five best rows of each document's store under each menu of sentences and spans."""
    d = R.ablation(_asked(spark, sf).select("doc_id", "sentences", "question"), "sentences", "question", 5)
    row = F.array_sort(F.collect_list(F.struct("rank", "row_idx")))
    d = d.groupBy("doc_id", "subset").agg(F.count("*").alias("n_hits"), F.transform(row, lambda x: x["row_idx"].cast("string")).alias("h"), F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 6).alias("total"))
    return d.select("doc_id", "subset", "n_hits", F.array_join("h", ",").alias("hits"), "best", "total")


@query(f"""WITH RECURSIVE {_RAG.removeprefix("WITH ").replace("rank <= 5", "rank <= 10")},
h AS (SELECT doc_id, list({{'rank': rank, 'score': score, 'ids': range(start, start + len), 'len': len}} ORDER BY rank) AS hits FROM hit GROUP BY doc_id),
s AS (SELECT doc_id, hits, 0 AS it, CAST([] AS INT[]) AS chosen, CAST([] AS BIGINT[]) AS seen FROM h UNION ALL
  SELECT doc_id, hits, it + 1, list_append(chosen, b.rank), list_concat(seen, b.ids) FROM (
    SELECT doc_id, hits, it, chosen, seen, list_sort(list_transform(list_filter(hits, lambda x: NOT list_contains(chosen, x.rank)),
      lambda x: {{'gain': -x.score * len(list_filter(x.ids, lambda i: NOT list_contains(seen, i))) / x.len, 'rank': x.rank, 'ids': x.ids}}))[1] AS b FROM s WHERE it < 5) WHERE b IS NOT NULL)
SELECT doc_id, array_to_string(arg_max(chosen, it), ',') AS chosen FROM s GROUP BY doc_id""")
def coverage_selection(spark, sf):
    d = R.search(_asked(spark, sf), "sentences", "question", 10)
    return d.select("doc_id", F.array_join(R.select_covering(F.col("hits"), 5), ",").alias("chosen"))


@query(r"""WITH m AS (SELECT conv_id, turn, text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE turn % 3 <> 1 GROUP BY conv_id, turn))
SELECT conv_id, md5(string_agg(CASE WHEN p IS NOT NULL AND turn <> p + 1 THEN '...' ELSE '' END || regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '' ORDER BY turn)) AS h, count(*)::BIGINT AS n FROM m GROUP BY conv_id""")
def gap_concat(spark, sf):
    """Marked turns with some left out, re-assembled; a conversation is re-assembled in one row."""
    t = _t(spark, sf, "conversations").where("turn % 3 <> 1").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    t = t.withColumn("m", X.mark(F.col("turn"), F.col("text")))
    d = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]).alias("m"), F.count("*").alias("n"))
    return d.select("conv_id", F.md5(R.merge_marked(F.col("m"))).alias("h"), "n")


# ---- boundaries ------------------------------------------------------------------------------

_MIN = """m0 AS (SELECT user_id, event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b, (row_number() OVER w - 1)::INT AS pos, lead(event_id) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, coalesce((value < a AND value < b AND (a - value >= 0.5 OR b - value >= 0.5)) OR (value < a AND value = b AND a - value >= 0.5), false) AS is_min FROM m0),
r AS (SELECT *, (sum(coalesce(p::INT, 0)) OVER (PARTITION BY user_id ORDER BY pos))::INT AS chunk FROM (SELECT *, lag(is_min) OVER (PARTITION BY user_id ORDER BY pos) AS p FROM m))"""


def _minima(spark, sf) -> DataFrame:
    e = _t(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    w = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).withColumn("is_min", B.is_minimum(F.col("value"), w, 0.5))


@query(f"WITH {_MIN} SELECT event_id, user_id, pos FROM m WHERE is_min")
def minima_static(spark, sf):
    return _minima(spark, sf).where("is_min").select("event_id", "user_id", "pos")


@query(f"WITH {_MIN} SELECT user_id, chunk, count(*)::BIGINT AS n, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos FROM r GROUP BY user_id, chunk")
def minima_ranges(spark, sf):
    d = B.ranges(_minima(spark, sf), "user_id", "pos", "is_min")
    return d.groupBy("user_id", "chunk").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(f"""WITH {_MIN}, o AS (SELECT user_id, chunk, pos FROM r UNION ALL SELECT user_id, chunk + 1, pos FROM r WHERE is_min AND nxt IS NOT NULL)
SELECT user_id, chunk::INT AS chunk, count(*)::BIGINT AS n, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos FROM o GROUP BY user_id, chunk""")
def minima_ranges_overlap(spark, sf):
    d = B.overlapping_ranges(_minima(spark, sf), "user_id", "pos", "is_min")
    return d.groupBy("user_id", F.col("chunk").cast("int").alias("chunk")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def _carried_sql(unit: int) -> str:
    """Adaptive minima by recursion; ``unit`` positions make a series, over which the threshold is carried on."""
    return f"""WITH RECURSIVE p AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS pos, value AS v FROM events WHERE value IS NOT NULL),
m AS (SELECT *, lag(v) OVER w - v AS l, lead(v) OVER w - v AS r FROM p WINDOW w AS (PARTITION BY user_id, pos // {unit} ORDER BY pos)),
f AS (SELECT user_id, event_id, pos, -1 AS spot, 0.5::DOUBLE AS threshold, CAST([] AS DOUBLE[]) AS drops, false AS is_min FROM m WHERE pos = 0 UNION ALL
  SELECT user_id, event_id, pos + 1, pos, CASE WHEN len(drops) >= 100 THEN list_min(drops) ELSE threshold END, drops, is_min FROM (
    SELECT user_id, event_id, pos, is_min, threshold, CASE WHEN is_min THEN list_append(drops, CASE WHEN r > 0 THEN least(l, r) ELSE l END) ELSE drops END AS drops FROM (
      SELECT m.user_id, m.event_id, m.pos, m.l, m.r, f.threshold, f.drops, coalesce((m.l > 0 AND m.r > 0 AND (m.l >= f.threshold OR m.r >= f.threshold)) OR (m.l > 0 AND m.r = 0 AND m.l >= f.threshold), false) AS is_min
      FROM f JOIN m ON m.user_id = f.user_id AND m.pos = f.pos)))
SELECT user_id, event_id, spot AS pos, round(threshold, 6) AS threshold FROM f WHERE is_min"""


def _carried(spark, sf, unit: int) -> DataFrame:
    e = _t(spark, sf, "events").select("event_id", "user_id", "ts", "value").where("value IS NOT NULL")
    w = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).withColumn("series", F.floor(F.col("pos") / unit))
    return B.minima_dynamic(e.withColumn("place", F.struct("pos", "event_id")), "user_id", "series", "place", "value", 0.5).select("user_id", "place.event_id", "place.pos", F.round("threshold", 6).alias("threshold"))


@query(_carried_sql(1 << 30))
def minima_dynamic(spark, sf):
    """Adaptive minima over each user's series."""
    return _carried(spark, sf, 1 << 30)


@query(_carried_sql(20))
def minima_dynamic_carried(spark, sf):
    """Adaptive minima over series of 20 values, where a user's threshold goes on from one to the next."""
    return _carried(spark, sf, 20)


_SEM = rf"""WITH {_SENT}, tok AS (SELECT doc_id, sent_id, ('0x' || substr(md5(lower(w)), 1, 4))::INT % 16 AS b FROM (SELECT doc_id, sent_id, unnest(regexp_extract_all(sentence, '\S+')) AS w FROM sent)),
bag AS (SELECT doc_id, sent_id, b, count(*)::DOUBLE AS c FROM tok GROUP BY ALL),
nn AS (SELECT doc_id, sent_id, sum(c * c) AS sq FROM bag GROUP BY ALL),
dd AS (SELECT a.doc_id, a.sent_id, sum(a.c * b.c) AS d FROM bag AS a JOIN bag AS b ON a.doc_id = b.doc_id AND b.sent_id = a.sent_id + 1 AND a.b = b.b GROUP BY ALL),
g AS (SELECT x.doc_id, x.sent_id, round(1 - coalesce(d, 0) / ((sqrt(x.sq) + 1e-8) * (sqrt(y.sq) + 1e-8)), 9) AS gap FROM nn AS x JOIN nn AS y ON y.doc_id = x.doc_id AND y.sent_id = x.sent_id + 1 LEFT JOIN dd ON dd.doc_id = x.doc_id AND dd.sent_id = x.sent_id),
lim AS (SELECT doc_id, quantile_cont(gap, 0.5) AS l FROM g GROUP BY doc_id)
SELECT n.doc_id, (1 + coalesce(c, 0))::INT AS n_chunks FROM n LEFT JOIN (SELECT g.doc_id, count(*) AS c FROM g JOIN lim USING (doc_id) WHERE gap > l GROUP BY g.doc_id) AS k ON k.doc_id = n.doc_id"""


@query(_SEM)
def semantic_breakpoints(spark, sf):
    """Chunks per document when a chunk ends where the distance to the next sentence is above the median."""
    d = _docs(spark, sf).where(F.size("sentences") > 0)
    ship(spark)
    d = d.withColumn("g", EM.gaps(EM.hashed(16))(F.col("sentences")))
    return d.select("doc_id", (1 + F.size(F.filter(B.breakpoints(F.col("g")), lambda x: x))).alias("n_chunks"))


@query(r"""WITH RECURSIVE p AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, text))::INT AS k, len(regexp_extract_all(text, '\S+'))::INT AS s FROM conversations),
r AS (SELECT conv_id, 0 AS k, 0 AS total, 0 AS grp FROM (SELECT DISTINCT conv_id FROM p) UNION ALL
 SELECT r.conv_id, p.k, CASE WHEN total + s <= 200 THEN total + s ELSE s END, CASE WHEN total + s <= 200 THEN grp ELSE grp + 1 END FROM r JOIN p ON p.conv_id = r.conv_id AND p.k = r.k + 1)
SELECT conv_id, k, grp::INT AS grp FROM r WHERE k > 0""")
def greedy_merge(spark, sf):
    c = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    g = B.greedy_merge(F.transform("t", lambda x: X.word_count(x["text"])), 200)
    return c.select("conv_id", F.posexplode(g).alias("k", "grp")).select("conv_id", (F.col("k") + 1).alias("k"), "grp")


@query(rf"""WITH RECURSIVE {_SENT}, c AS (SELECT sent.doc_id, sent_id, sentence, n, sum(len(regexp_extract_all(sentence, '\S+')) + 2) OVER w AS upto, abs(length(sentence) - lag(length(sentence)) OVER w) AS gap
  FROM sent JOIN n USING (doc_id) WINDOW w AS (PARTITION BY sent.doc_id ORDER BY sent_id)),
g AS (SELECT a.doc_id, a.sent_id AS spot, greatest(1, least(coalesce(min(b.sent_id) - a.sent_id + 1, a.n), a.n - 1 - a.sent_id) - 1) AS shown
  FROM (SELECT *, coalesce(lag(upto) OVER (PARTITION BY doc_id ORDER BY sent_id), 0) AS before FROM c) AS a LEFT JOIN c AS b ON a.doc_id = b.doc_id AND b.sent_id >= a.sent_id AND b.upto - a.before >= 550
  WHERE a.sent_id < a.n - 5 GROUP BY a.doc_id, a.sent_id, a.n),
j AS (SELECT g.doc_id, spot, any_value(shown) AS shown, arg_max(sent_id, gap * 100000 - sent_id) AS answer FROM g LEFT JOIN c ON c.doc_id = g.doc_id AND sent_id > spot AND sent_id < spot + shown GROUP BY g.doc_id, spot),
r AS (SELECT doc_id, 0 AS spot, CAST(NULL AS INT) AS answer FROM n UNION ALL
  SELECT r.doc_id, coalesce(j.answer + 1, j.spot + shown)::INT, j.answer FROM r JOIN j ON j.doc_id = r.doc_id AND j.spot = r.spot),
e AS (SELECT doc_id, answer AS stop FROM r WHERE answer IS NOT NULL UNION ALL SELECT doc_id, n FROM n),
k AS (SELECT doc_id, (row_number() OVER w - 1)::INT AS chunk, coalesce(lag(stop) OVER w, 0)::INT AS start, stop FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY stop))
SELECT k.doc_id, chunk, start, md5(string_agg(sentence, chr(10) ORDER BY sent_id)) AS h FROM k JOIN sent ON sent.doc_id = k.doc_id AND sent_id >= start AND sent_id < stop GROUP BY k.doc_id, chunk, start""")
def lumber_boundaries(spark, sf):
    """Chunks by the budgeted judge loop with the default judge."""
    d = B.judged_chunks(_docs(spark, sf).where(F.size("sentences") > 0), "doc_id", "sentences")
    return d.select("doc_id", "chunk", "start", F.md5("chunk_text").alias("h"))


# ---- ETL -------------------------------------------------------------------------------------


@query("SELECT doc_id, source, md5(text) AS h, ((row_number() OVER (ORDER BY doc_id) - 1) % 7)::INT AS shard FROM documents")
def shard_round_robin(spark, sf):
    d = E.numbered(_t(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("h")), "doc_id")
    return d.select("doc_id", "source", "h", E.round_robin(F.col("pos"), 7).alias("shard"))


@query("SELECT doc_id, source, n_chars, floor((row_number() OVER (ORDER BY doc_id) - 1) / ceil((SELECT count(*) FROM documents) / 7.0))::INT AS shard FROM documents")
def shard_contiguous(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return E.numbered(d, "doc_id").select("doc_id", "source", "n_chars", E.contiguous(F.col("pos"), F.lit(d.count()), 7).alias("shard"))


@query("SELECT doc_id, lang, n_chars, ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::INT AS block FROM documents")
def blocks(spark, sf):
    return E.numbered(_t(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("doc_id", "lang", "n_chars", E.block(F.col("pos"), 100).alias("block"))


@query("SELECT true AS non_empty, true AS disjoint, true AS complete")
def shard_laws(spark, sf):
    d = E.numbered(_t(spark, sf, "documents").select("doc_id"), "doc_id").withColumn("shard", E.round_robin(F.col("pos"), 6))
    return E.shard_laws(d, "doc_id", "shard", 6)


@query("SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY text")
def dedupe_first(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return E.first_wins(d, ("h",), F.col("doc_id"))


@query("SELECT max(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY text")
def dedupe_last(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return E.last_wins(d, ("h",), F.col("doc_id"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS src_prio FROM documents")
def merge_sources(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("line"))
    return E.merge_sources([d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0"), d], "doc_id", "line").select("doc_id", "src_prio")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_done(spark, sf):
    return E.not_done(_t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "labels"), "doc_id")


@query("WITH m AS (SELECT min(doc_id) AS a, max(doc_id) AS b FROM labels) SELECT i AS idx FROM (SELECT unnest(range(a, b + 1)) AS i FROM m) WHERE i NOT IN (SELECT doc_id FROM labels)")
def missing_index(spark, sf):
    done = _t(spark, sf, "labels").select("doc_id")
    span = done.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a IS NOT NULL")
    expected = span.select(F.explode(F.sequence("a", "b")).alias("doc_id"))
    return E.not_done(expected, done, "doc_id").select(F.col("doc_id").alias("idx"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) AS a FULL JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') AS b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def sym_diff(spark, sf):
    return E.sym_diff(_t(spark, sf, "labels").where("quality = 1"), _t(spark, sf, "documents").where("lang = 'en'"), "doc_id")


@query("""WITH RECURSIVE p AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id))::INT AS k, n_chars AS x FROM documents),
r AS (SELECT source, 0 AS k, 0 AS n, 0 AS batch FROM (SELECT DISTINCT source FROM p) UNION ALL
 SELECT r.source, p.k, CASE WHEN n > 0 AND (n >= 32 OR (n + 1) * x * x > 80000000) THEN 1 ELSE n + 1 END, CASE WHEN n > 0 AND (n >= 32 OR (n + 1) * x * x > 80000000) THEN batch + 1 ELSE batch END
 FROM r JOIN p ON p.source = r.source AND p.k = r.k + 1)
SELECT source, k, batch::INT AS batch FROM r WHERE k > 0""")
def length_batches(spark, sf):
    return E.length_batches(_t(spark, sf, "documents"), "source", "n_chars", "doc_id").select("source", "k", "batch")


@query("""WITH RECURSIVE p AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k, n_chars::BIGINT AS x FROM documents),
r AS (SELECT lang, 0::BIGINT AS k, list_transform(range(8), lambda i: 0::BIGINT) AS load, 0 AS bin FROM (SELECT DISTINCT lang FROM p) UNION ALL
  SELECT lang, k, list_transform(load, lambda v, i: CASE WHEN i = bin THEN v + x ELSE v END), bin FROM (
    SELECT r.lang, p.k, load, x, list_position(load, list_min(load)) AS bin FROM r JOIN p ON p.lang IS NOT DISTINCT FROM r.lang AND p.k = r.k + 1))
SELECT lang, (bin - 1)::INT AS bin, sum(x)::BIGINT AS load, count(*)::BIGINT AS n FROM r JOIN p USING (lang, k) GROUP BY lang, bin""")
def lpt_pack(spark, sf):
    """Documents of each language into 8 bins, longest first."""
    return E.pack_longest_first(_t(spark, sf, "documents"), "lang", "n_chars", 8)


# ---- evaluation ------------------------------------------------------------------------------

_EVAL = "rec AS (SELECT d.source AS method, coalesce(d.lang, 'unknown') AS domain, k AS topk, coalesce((l.quality + d.doc_id + k) % 2 = 0, false) AS is_correct, (d.doc_id % 3)::INT AS run, l.doc_id FROM labels AS l LEFT JOIN documents AS d ON d.doc_id = l.doc_id, (VALUES (5), (10)) AS t(k))"


def _records(spark, sf) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", F.col("source").alias("method"), F.col("lang").alias("domain"))
    r = EV.with_domain(_t(spark, sf, "labels").join(d.drop("domain"), "doc_id", "left"), d, "doc_id")
    r = r.withColumn("topk", F.explode(F.array(F.lit(5), F.lit(10))))
    return r.withColumn("is_correct", F.coalesce((F.col("quality") + F.col("doc_id") + F.col("topk")) % 2 == 0, F.lit(False))).withColumn("run", (F.col("doc_id") % 3).cast("int"))


_ACC = "round(100.0 * count(*) FILTER (WHERE is_correct) / count(*), 6)"


@query(f"WITH {_EVAL} SELECT method, domain, topk, count(*) FILTER (WHERE is_correct)::BIGINT AS correct, count(*)::BIGINT AS total, {_ACC} AS acc_pct FROM rec GROUP BY ALL")
def accuracy_by_method_domain_topk(spark, sf):
    return EV.accuracy(_records(spark, sf), "method", "domain", "topk")


@query(f"WITH {_EVAL} SELECT method, domain, topk, count(*) FILTER (WHERE is_correct)::BIGINT AS correct, count(*)::BIGINT AS total, {_ACC} AS acc_pct FROM (SELECT * FROM rec UNION ALL SELECT method, 'overall', topk, is_correct, run, doc_id FROM rec WHERE domain <> 'unknown') GROUP BY ALL")
def accuracy_overall(spark, sf):
    return EV.with_overall(_records(spark, sf), "method", "domain", "topk").select("method", "domain", "topk", "correct", "total", "acc_pct")


@query(f"WITH {_EVAL}, a AS (SELECT method, topk, run, {_ACC} AS acc_pct FROM rec GROUP BY ALL) SELECT method, topk, round(avg(acc_pct), 6) AS mean, round(coalesce(stddev_samp(acc_pct), 0), 6) AS std, count(*)::BIGINT AS runs FROM a GROUP BY ALL")
def accuracy_mean_std(spark, sf):
    return EV.mean_and_deviation(EV.accuracy(_records(spark, sf), "method", "topk", "run"), "method", "topk")


_GAP = f"""{_EVAL}, ours AS (SELECT domain, topk, {_ACC} AS acc_pct FROM rec GROUP BY ALL),
paper(domain, topk, p) AS (VALUES ('en', 5, 50.0), ('en', 10, 49.0), ('de', 5, 52.5), ('fr', 10, 47.25)), base(domain, topk, b) AS (VALUES ('en', 5, 45.0), ('es', 10, 51.0))"""


@query(f"WITH {_GAP} SELECT domain, topk, acc_pct, CASE WHEN p IS NOT NULL THEN printf('%+.2f', acc_pct - p) END AS vs_paper, CASE WHEN b IS NOT NULL THEN printf('%+.2f', acc_pct - b) END AS vs_base FROM ours LEFT JOIN paper USING (domain, topk) LEFT JOIN base USING (domain, topk)")
def gap_report(spark, sf):
    ours = EV.accuracy(_records(spark, sf), "domain", "topk").select("domain", "topk", "acc_pct")
    table = "domain string, topk int, acc_pct double"
    paper = spark.createDataFrame([("en", 5, 50.0), ("en", 10, 49.0), ("de", 5, 52.5), ("fr", 10, 47.25)], table)
    base = spark.createDataFrame([("en", 5, 45.0), ("es", 10, 51.0)], table)
    return EV.gaps(ours, paper, base, ("domain", "topk")).select("domain", "topk", "acc_pct", "vs_paper", "vs_base")


@query(f"""WITH {_EVAL}, a AS (SELECT method, domain, {_ACC} AS acc FROM (SELECT * FROM rec UNION ALL SELECT method, 'overall', topk, is_correct, run, doc_id FROM rec WHERE domain <> 'unknown') WHERE topk = 5 GROUP BY ALL),
d AS (SELECT method, domain, acc - 50 AS delta, CASE WHEN method IN ('src1', 'src2') THEN 25.0 ELSE 0.0 END AS cost FROM a),
s AS (SELECT method, max(delta) FILTER (WHERE domain = 'overall') AS up, count(*) FILTER (WHERE domain <> 'overall' AND delta >= 0) AS kept, max(cost) FILTER (WHERE domain = 'overall') AS saved FROM d GROUP BY method)
SELECT method, round(up, 6) AS overall_delta, kept::BIGINT AS domains_kept, coalesce((up >= 0.5 AND kept >= 4) OR (saved >= 20 AND up > -0.5), false) AS accepted FROM s""")
def acceptance_rule(spark, sf):
    a = EV.with_overall(_records(spark, sf).where("topk = 5"), "method", "domain", "topk").withColumn("delta", F.col("acc_pct") - 50)
    a = a.withColumn("cost", F.when(F.col("method").isin("src1", "src2"), 25.0).otherwise(0.0))
    return EV.accepted(a, "method", "domain", "delta", "cost").select("method", F.round("overall_delta", 6).alias("overall_delta"), "domains_kept", "accepted")


@query(f"WITH {_EVAL}, t AS (SELECT domain, doc_id, sum(doc_id % 5 / 10.0) AS s, max(doc_id % 5 / 10.0) AS m FROM rec GROUP BY ALL) SELECT domain, round(sum(s), 6) AS recorded_s, round(sum(m), 6) AS question_s, round(avg(m), 6) AS avg_question_s FROM t GROUP BY domain")
def time_by_domain(spark, sf):
    r = _records(spark, sf).withColumn("seconds", F.col("doc_id") % 5 / 10.0)
    return EV.time_by(r, "domain", seconds="seconds", question="doc_id")


@query("SELECT (ceil((event_id + 1) / 2000) * 2000)::BIGINT AS step_bin, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, count(*)::BIGINT AS n FROM events GROUP BY 1")
def loss_bins(spark, sf):
    return EV.bins(_t(spark, sf, "events").select((F.col("event_id") + 1).alias("step"), "value"), "step", "value", 2000)


@query("""WITH e AS (SELECT event_id + 1 AS step, value FROM events), m AS (SELECT max(step) AS mx, count(*) AS c FROM e)
SELECT CASE WHEN any_value(c) >= 1000 THEN round(avg(value) FILTER (WHERE step <= 1000), 6) END AS head_mean, CASE WHEN any_value(c) >= 1000 THEN round(avg(value) FILTER (WHERE step > mx - 1000), 6) END AS tail_mean,
min(value) AS min_value, max(value) AS max_value, arg_max(value, step) AS final_value FROM e, m""")
def loss_head_tail(spark, sf):
    return EV.head_tail(_t(spark, sf, "events").select((F.col("event_id") + 1).alias("step"), "value"), "step", "value", 1000)


@query("""WITH e AS (SELECT event_id + 1 AS step, user_id, value FROM events), r AS (SELECT step, avg(value) OVER (ORDER BY step ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS m FROM e)
SELECT step, round(m, 6) AS rolling_mean FROM r WHERE step % 1000 = 0""")
def rolling_loss(spark, sf):
    """Mean of the last 1000 steps at every 1000th; steps are numbered without gaps, so blocks of 1000 do."""
    e = _t(spark, sf, "events").select((F.col("event_id") + 1).alias("step"), "value")
    d = EV.bins(e, "step", "value", 1000).where("n = 1000")
    return d.select(F.col("step_bin").alias("step"), F.col("mean").alias("rolling_mean"))


@query("""WITH c AS (SELECT doc_id, lang, len(regexp_extract_all(text, '\\S+')) AS k, length(text) AS l FROM documents), o AS (SELECT lang, list(l ORDER BY l) AS x FROM c GROUP BY lang)
SELECT lang, len(x)::BIGINT AS n, list_max(x)::INT AS most, x[len(x) // 2 + 1]::INT AS upper_median, len(list_filter(x, lambda v: v > 2000))::INT AS over_2000, len(list_filter(x, lambda v: v > 8000))::INT AS over_8000 FROM o""")
def chunk_length_stats(spark, sf):
    """Upper median by rank, without gathering a group's lengths in one row: counts by length first."""
    c = _t(spark, sf, "documents").select("lang", F.length("text").alias("l")).groupBy("lang", "l").agg(F.count("*").alias("c"))
    run = F.sum("c").over(W.Window.partitionBy("lang").orderBy("l"))
    c = c.withColumn("upto", run).withColumn("n", F.sum("c").over(W.Window.partitionBy("lang")))
    over = lambda m: F.sum(F.when(F.col("l") > m, F.col("c")).otherwise(0)).cast("int")
    return c.groupBy("lang").agg(
        F.max("n").alias("n"), F.max("l").alias("most"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("l"))).alias("upper_median"),
        over(2000).alias("over_2000"), over(8000).alias("over_8000"),
    )


@query(f"WITH {_SENT} SELECT round(avg(n), 6) AS mean_sentences, max(n)::INT AS most, count(*) FILTER (WHERE n > 50)::BIGINT AS over_50, count(*) FILTER (WHERE n > 200)::BIGINT AS over_200 FROM n")
def sentence_count_profile(spark, sf):
    n = _docs(spark, sf).select(F.size("sentences").alias("n")).where("n > 0")
    return n.agg(F.round(F.avg("n"), 6).alias("mean_sentences"), F.max("n").alias("most"), F.count_if(F.col("n") > 50).alias("over_50"), F.count_if(F.col("n") > 200).alias("over_200"))


@query("SELECT lang AS domain, sum(length(text))::BIGINT AS chars, count(*)::BIGINT AS n, count(DISTINCT md5(text))::BIGINT AS distinct_texts, (count(*) - count(DISTINCT md5(text)))::BIGINT AS duplicates FROM documents GROUP BY lang")
def domain_volume(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("lang").alias("domain"), F.length("text").alias("l"), F.md5("text").alias("h"))
    d = d.groupBy("domain").agg(F.sum("l").alias("chars"), F.count("*").alias("n"), F.countDistinct("h").alias("distinct_texts"))
    return d.withColumn("duplicates", F.col("n") - F.col("distinct_texts"))


# ---- quality ---------------------------------------------------------------------------------


@query("SELECT source, count(DISTINCT doc_id) FILTER (WHERE lang = 'de')::BIGINT AS de, count(DISTINCT doc_id) FILTER (WHERE lang = 'en')::BIGINT AS en, count(DISTINCT doc_id) FILTER (WHERE lang = 'es')::BIGINT AS es, count(DISTINCT doc_id) FILTER (WHERE lang = 'fr')::BIGINT AS fr FROM documents GROUP BY source")
def progress_pivot(spark, sf):
    return G.progress(_t(spark, sf, "documents"), "source", "lang", "doc_id", ["de", "en", "es", "fr"])


@query("""WITH x AS (SELECT count(*) FILTER (WHERE embedding IS NULL) AS a, count(*) FILTER (WHERE coalesce(len(embedding), -1) <> 64) AS b,
count(*) FILTER (WHERE len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) > 0) AS c, count(*) FILTER (WHERE abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-3) AS d FROM embeddings)
SELECT 'present' AS "check", a = 0 AS passed, a::BIGINT AS bad FROM x UNION ALL SELECT 'size', b = 0, b FROM x UNION ALL SELECT 'finite', c = 0, c FROM x UNION ALL SELECT 'unit_norm', d = 0, d FROM x""")
def quality_gate(spark, sf):
    return G.vector_gate(_t(spark, sf, "embeddings"), "embedding", 64)


@query("SELECT coalesce(e.lang, a.lang) AS lang, coalesce(e, 0)::BIGINT AS expected, coalesce(a, 0)::BIGINT AS found, coalesce(e, 0) = coalesce(a, 0) AS complete FROM (SELECT lang, count(DISTINCT doc_id) AS e FROM documents GROUP BY lang) AS e FULL JOIN (SELECT lang, count(DISTINCT doc_id) AS a FROM documents JOIN labels USING (doc_id) GROUP BY lang) AS a ON e.lang = a.lang")
def coverage(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "lang")
    return G.coverage(d, d.join(_t(spark, sf, "labels").select("doc_id"), "doc_id"), ("lang",), "doc_id")


@query(r"""WITH c AS (SELECT source, lang, doc_id, md5(text) AS item, len(regexp_extract_all(text, '\S+')) = 0 AS bad FROM documents), e AS (SELECT lang, count(DISTINCT item) AS a FROM c GROUP BY lang)
SELECT source, lang, count(*)::BIGINT AS "rows", count(DISTINCT item)::BIGINT AS items, (count(*) - count(DISTINCT item))::BIGINT AS duplicates, count(*) FILTER (WHERE bad)::BIGINT AS bad_chunks, (any_value(a) - count(DISTINCT item))::BIGINT AS missing FROM c JOIN e USING (lang) GROUP BY source, lang""")
def audit(spark, sf):
    d = _t(spark, sf, "documents").select("source", "lang", F.md5("text").alias("item"), X.token_windows(X.words(F.col("text")), 256).alias("chunks"))
    return G.audit(d, "source", "lang", "item", "chunks")


@query("""WITH i AS (SELECT event_id % 40 AS g, event_id AS lo, event_id + 20 + (event_id % 60)::BIGINT AS hi FROM events), s AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY g ORDER BY lo, hi) = 1 THEN 1 ELSE 0 END AS f FROM i),
t AS (SELECT *, sum(f) OVER (PARTITION BY g ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT g, min(lo) AS lo, max(hi) AS hi FROM t GROUP BY g, k""")
def interval_union(spark, sf):
    i = _t(spark, sf, "events").select((F.col("event_id") % 40).alias("g"), F.col("event_id").alias("lo"), (F.col("event_id") + 20 + F.col("event_id") % 60).alias("hi"))
    return G.interval_union(i, "lo", "hi", "g")


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'UNKNOWN') AS answer, upper(coalesce(json_extract_string(props, '$.k'), 'UNKNOWN')) = (event_id % 10)::VARCHAR AS is_correct FROM events""")
def parse_answer(spark, sf):
    e = _t(spark, sf, "events").select("event_id", X.parse_answer(F.concat(F.lit("noise "), F.col("props"), F.lit(" tail")), "k").alias("answer"))
    return e.withColumn("is_correct", F.upper("answer") == F.upper((F.col("event_id") % 10).cast("string")))


@query("SELECT event_type, json_extract_string(props, '$.k')::INT AS k, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def count_by_json_field(spark, sf):
    e = _t(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


# ---- streaming -------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)
SELECT doc_id, ceil(len(w) / 256)::INT AS n_chunks, md5(array_to_string(w[1:256], ' ')) AS first_h FROM t""")
def incremental_chunks(spark, sf):
    """All documents through the file stream, run twice: the second run finds nothing new."""
    from ..streaming.incremental import chunk_new

    base = scratch(spark, "stream")
    source = f"{sf}/document[s].parquet"  # a stream takes a folder or a pattern; the table may be one file
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    for _ in range(2):
        chunk_new(spark, source, schema, f"{base}/out", f"{base}/state").awaitTermination()
    d = spark.read.parquet(f"{base}/out")
    return d.select("doc_id", F.size("chunks").alias("n_chunks"), F.md5(F.coalesce(F.try_element_at("chunks", F.lit(1)), F.lit(""))).alias("first_h"))

