"""Named queries where a model is asked: long texts, failing models, attention, judges."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from ..operators import ask as Q
from ..operators import attention as A
from ..operators import boundaries as B
from ..operators import chunkers as C
from ..operators import spans as S
from ..session import ship
from .catalog import _SENT, _docs, _spans_sql, _t, query

_LOSS_CHUNK = rf"""tok AS (SELECT doc_id, sent_id, length(w) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, k) AS nr
  FROM (SELECT doc_id, sent_id, unnest(regexp_extract_all(sentence, '\S+')) AS w, generate_subscripts(regexp_extract_all(sentence, '\S+'), 1) AS k FROM sent)),
p AS (SELECT doc_id, sent_id, avg(l) FILTER (WHERE nr > 1) AS v FROM tok GROUP BY ALL),
m AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY sent_id)),
e AS (SELECT doc_id, sent_id, coalesce(lag((v < a AND v < b AND (a - v >= 0.5 OR b - v >= 0.5)) OR (v < a AND v = b AND a - v >= 0.5)) OVER (PARTITION BY doc_id ORDER BY sent_id), false)::INT AS f FROM m),
g AS (SELECT doc_id, sent_id, sum(f) OVER (PARTITION BY doc_id ORDER BY sent_id) AS chunk FROM e),
c AS MATERIALIZED (SELECT doc_id, chunk, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk))::INT AS k, string_agg(sentence, '' ORDER BY sent_id) AS t FROM g JOIN sent USING (doc_id, sent_id) GROUP BY doc_id, chunk)"""


@query(rf"""WITH RECURSIVE {_SENT}, {_LOSS_CHUNK},
s AS MATERIALIZED (SELECT doc_id, k, len(regexp_extract_all(t, '\S+'))::INT AS s FROM c),
r AS (SELECT doc_id, 0 AS k, 0 AS total, 0 AS grp FROM (SELECT DISTINCT doc_id FROM s) UNION ALL
  SELECT r.doc_id, s.k, CASE WHEN total + s <= 200 THEN total + s ELSE s END, CASE WHEN total + s <= 200 THEN grp ELSE grp + 1 END FROM r JOIN s ON s.doc_id = r.doc_id AND s.k = r.k + 1),
o AS (SELECT r.doc_id, grp, CASE WHEN grp = 0 THEN ' ' ELSE '' END || string_agg(t, ' ' ORDER BY r.k) AS t FROM r JOIN c ON c.doc_id = r.doc_id AND c.k = r.k GROUP BY r.doc_id, grp UNION ALL
  SELECT r.doc_id, 0, '' FROM r WHERE r.k = 1 AND grp = 1)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1)::INT AS chunk, md5(t) AS h FROM o""")
def long_text_chunks(spark, sf):
    """Chunks by token losses, read in batches of 512 tokens with up to 488 before them where a text is above 512 words, then merged to 200 words."""
    d = C.by_loss_of_any_length(_docs(spark, sf), "doc_id", "sentences", short=512, batch=512, most=1000, merge=200)
    return d.select("doc_id", "chunk", F.md5("chunk_text").alias("h"))


class NarrowDecision:
    """As the default decision, for a model that holds no more than ``most`` words of one text and fails on sentences whose first word has twelve letters or more."""

    def __init__(self, most: int):
        self.most, self.held, self.last = most, 0, None

    def __call__(self, a: str, b: str) -> bool:
        self.held = len(b.split()) + (self.held if a is self.last else len(a.split()))
        self.last = b
        if self.held > self.most or any(len(x.split()[0]) >= 12 for x in (a, b)):
            raise MemoryError
        return C.words_differ(a, b)


_UNIT = r"""(SELECT {key}, sent_id, sentence, len(regexp_extract_all(sentence, '\S+')) AS k, length(regexp_extract(sentence, '\S+')) AS l FROM {src})"""
_SPLIT = r"""SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY i) - 1)::INT AS sent_id, s AS sentence FROM (SELECT {key}, i, regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '') AS s
  FROM (SELECT {key}, unnest(regexp_extract_all(text, '[^.?!]+[.?!]*')) AS x, generate_subscripts(regexp_extract_all(text, '[^.?!]+[.?!]*'), 1) AS i FROM {src})) WHERE s <> ''"""


@query(rf"""WITH {_SENT}, u AS {_UNIT.format(key="doc_id", src="sent")},
bad AS MATERIALIZED (SELECT doc_id, count(*) > 1 AND (sum(k) > 300 OR max(l) >= 12) AS failed FROM u GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all(string_agg(sentence, ' ' ORDER BY sent_id), '\S+') AS w FROM sent JOIN bad USING (doc_id) WHERE failed GROUP BY doc_id),
win AS MATERIALIZED (SELECT doc_id, a // 256 AS win, array_to_string(w[a + 1:a + 256], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, len(w), 256)) AS a FROM w)),
ws AS MATERIALIZED ({_SPLIT.format(key="doc_id, win", src="win")}), wu AS {_UNIT.format(key="doc_id, win", src="ws")},
stop AS MATERIALIZED (SELECT doc_id, min(win) AS stop FROM (SELECT doc_id, win, count(*) > 1 AND max(l) >= 12 AS failed FROM wu GROUP BY doc_id, win) WHERE failed GROUP BY doc_id),
good AS (SELECT doc_id, 0 AS win, sent_id, sentence, k FROM u JOIN bad USING (doc_id) WHERE NOT failed UNION ALL
  SELECT wu.doc_id, win, sent_id, sentence, k FROM wu LEFT JOIN stop USING (doc_id) WHERE win < coalesce(stop, 1 << 30)),
c AS (SELECT doc_id, win, sent_id, sentence, sum(f) OVER (PARTITION BY doc_id, win ORDER BY sent_id) AS part FROM (SELECT *, coalesce(abs(k - lag(k) OVER (PARTITION BY doc_id, win ORDER BY sent_id)) >= 8, false)::INT AS f FROM good)),
o AS (SELECT doc_id, win, part, string_agg(sentence, ' ' ORDER BY sent_id) AS t, false AS lost FROM c GROUP BY doc_id, win, part UNION ALL SELECT doc_id, win, 0, text, true FROM win JOIN stop USING (doc_id) WHERE win >= stop)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY win, part) - 1)::INT AS chunk, md5(t) AS h, lost FROM o""")
def decided_chunks_fallback(spark, sf):
    """Chunks by decisions of a model that often runs out of memory: token windows then, and what is lost is marked."""
    ship(spark)
    d = C.chunk_rows(_docs(spark, sf), "doc_id", "sentences", lambda p: C.decided_chunks(p, NarrowDecision(300), 256))
    return d.select("doc_id", "chunk", F.md5("chunk_text").alias("h"), "lost")


@query(f"""WITH v AS MATERIALIZED (SELECT vec_id // 12 AS doc_id, vec_id % 12 AS i, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
n AS (SELECT doc_id, count(DISTINCT i)::INT AS n FROM v GROUP BY doc_id), {_spans_sql()},
q AS MATERIALIZED (SELECT span.doc_id, span_id, d, avg(x) AS q FROM span JOIN v ON v.doc_id = span.doc_id AND i >= start AND i < start + len GROUP BY ALL),
s AS (SELECT span.doc_id, span.span_id, i, sum(q * x) / 8 AS s FROM span JOIN v ON v.doc_id = span.doc_id AND i >= start AND i < start + len JOIN q ON q.doc_id = span.doc_id AND q.span_id = span.span_id AND q.d = v.d GROUP BY ALL),
p AS (SELECT doc_id, span_id, i, exp(s) / sum(exp(s)) OVER (PARTITION BY doc_id, span_id) AS p FROM s),
o AS (SELECT p.doc_id, span_id, d, sum(p * x) AS y FROM p JOIN v ON v.doc_id = p.doc_id AND v.i = p.i GROUP BY ALL)
SELECT doc_id, span_id, round(sum(abs(y)), 6) AS l1, round(sum(y * y), 6) AS sq FROM o GROUP BY ALL""")
def span_attention(spark, sf):
    """Spans over every twelve vectors in a row, by attention with identity weights."""
    ship(spark)
    d = _t(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 12).alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("v"))
    d = d.select("doc_id", F.posexplode(A.attended(F.col("v"), S.spans(F.size("v")))).alias("span_id", "y"))
    return d.select("doc_id", "span_id", F.round(F.aggregate("y", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"), F.round(F.aggregate("y", F.lit(0.0), lambda s, x: s + x * x), 6).alias("sq"))


def moody_judge(group: list[str]) -> int | None:
    """The default judge, which refuses and fails by the length of a group's first part."""
    if len(group[0]) % 31 == 0:
        raise B.Failed("no reply")
    if len(group[0]) % 7 == 0:
        raise B.Refused
    return B.steepest_length_change(group)


@query(rf"""WITH RECURSIVE {_SENT}, c AS (SELECT sent.doc_id, sent_id, sentence, n, sum(len(regexp_extract_all(sentence, '\S+')) + 2) OVER w AS upto, abs(length(sentence) - lag(length(sentence)) OVER w) AS gap
  FROM sent JOIN n USING (doc_id) WINDOW w AS (PARTITION BY sent.doc_id ORDER BY sent_id)),
g0 AS (SELECT a.doc_id, a.sent_id AS spot, any_value(length(a.sentence)) AS l, least(coalesce(min(b.sent_id) - a.sent_id + 1, a.n), a.n - 1 - a.sent_id) AS got
  FROM (SELECT *, coalesce(lag(upto) OVER (PARTITION BY doc_id ORDER BY sent_id), 0) AS before FROM c) AS a LEFT JOIN c AS b ON a.doc_id = b.doc_id AND b.sent_id >= a.sent_id AND b.upto - a.before >= 550
  WHERE a.sent_id < a.n - 5 GROUP BY a.doc_id, a.sent_id, a.n),
g AS (SELECT *, greatest(1, got - 1) AS shown, CASE WHEN l % 31 = 0 THEN 'failed' WHEN l % 7 = 0 THEN 'refused' ELSE 'ok' END AS mode FROM g0),
j AS MATERIALIZED (SELECT g.doc_id, spot, any_value(shown) AS shown, any_value(got) AS got, any_value(mode) AS mode, arg_max(sent_id, gap * 100000 - sent_id) AS answer FROM g LEFT JOIN c ON c.doc_id = g.doc_id AND sent_id > spot AND sent_id < spot + shown GROUP BY g.doc_id, spot),
r AS (SELECT doc_id, 0 AS spot, CAST(NULL AS INT) AS answer, 0 AS refused, false AS failed FROM n UNION ALL
  SELECT r.doc_id, CASE mode WHEN 'failed' THEN 1 << 30 WHEN 'refused' THEN j.spot + greatest(0, got - 1) + 1 ELSE coalesce(j.answer + 1, j.spot + shown) END::INT, CASE WHEN mode = 'ok' THEN j.answer END,
    r.refused + (mode = 'refused')::INT, mode = 'failed' FROM r JOIN j ON j.doc_id = r.doc_id AND j.spot = r.spot),
f AS (SELECT doc_id, max(refused) AS refused, bool_or(failed) AS failed FROM r GROUP BY doc_id),
e AS (SELECT doc_id, answer AS stop FROM r WHERE answer IS NOT NULL UNION ALL SELECT doc_id, n FROM n),
k AS (SELECT doc_id, (row_number() OVER w - 1)::INT AS chunk, coalesce(lag(stop) OVER w, 0)::INT AS start FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY stop))
SELECT k.doc_id, chunk, start, refused, failed FROM k JOIN f USING (doc_id)""")
def judged_with_refusals(spark, sf):
    """Chunks by the judge loop where the judge refuses some groups and can't be asked about others."""
    d = B.judged_chunks(_docs(spark, sf).where(F.size("sentences") > 0), "doc_id", "sentences", moody_judge)
    return d.select("doc_id", "chunk", "start", "refused", "failed")


class MoodyModel:
    """Replies with the end of a prompt, in three forms; refuses, fails or fails once by its last digit."""

    def __init__(self):
        self.seen: set[str] = set()

    def chat(self, prompt: str) -> object:
        end = prompt[-1]
        if end == "0":
            return Q.REFUSAL
        if end == "1" or (end == "2" and prompt not in self.seen):
            self.seen.add(prompt)
            raise ValueError(prompt[-4:])
        text = prompt[-8:]
        return text if end in "abc" else [text, "more"] if end in "def" else SimpleNamespace(text=text)


@query("""SELECT doc_id, CASE right(p, 1) WHEN '0' THEN 'refused' WHEN '1' THEN 'failed' ELSE 'answered' END AS status, CASE right(p, 1) WHEN '0' THEN 'content_flag_increment' WHEN '1' THEN 'ValueError: ' || right(p, 4) ELSE right(p, 8) END AS reply,
  CASE right(p, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 ELSE 1 END::INT AS tries FROM (SELECT doc_id, md5(doc_id || ':' || text) AS p FROM documents)""")
def model_answers(spark, sf):
    """A prompt for each document to a model that refuses, fails and recovers."""
    d = _t(spark, sf, "documents").select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text")).alias("p"))
    return Q.answers(d, "p", MoodyModel).select("doc_id", "status", "reply", "tries")
