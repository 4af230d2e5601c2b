"""Named queries that learn from the tables: the trained sentence splitter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sentences as SE
from .catalog import _t, query

_ASSOC = """2 * (CASE WHEN {b} > 0 THEN {b} * ln({b} / {f}) ELSE 0 END + CASE WHEN {f} - {b} > 0 THEN ({f} - {b}) * ln(1 - {b} / {f}) ELSE 0 END
  + CASE WHEN {s} - {b} > 0 THEN ({s} - {b}) * ln(({s} - {b}) / ({t} - {f})) ELSE 0 END + CASE WHEN {t} - {f} - {s} + {b} > 0 THEN ({t} - {f} - {s} + {b}) * ln(1 - ({s} - {b}) / ({t} - {f})) ELSE 0 END
  - CASE WHEN {b} > 0 THEN {b} * ln({s} / {t}) ELSE 0 END - CASE WHEN {f} - {b} > 0 THEN ({f} - {b}) * ln(1 - {s} / {t}) ELSE 0 END
  - CASE WHEN {s} - {b} > 0 THEN ({s} - {b}) * ln({s} / {t}) ELSE 0 END - CASE WHEN {t} - {f} - {s} + {b} > 0 THEN ({t} - {f} - {s} + {b}) * ln(1 - {s} / {t}) ELSE 0 END)"""

_MODEL = rf"""
piece AS MATERIALIZED (SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS pos, unnest(p) AS piece FROM (SELECT doc_id, regexp_extract_all(text, '\S+\s*') AS p FROM documents)),
bare AS (SELECT doc_id, pos, regexp_replace(regexp_replace(regexp_replace(piece, '\s+$', ''), '^[(\["''“‘«]+', ''), '[)\]"''”’»]+$', '') AS w FROM piece),
named AS (SELECT doc_id, pos, lower(regexp_replace(w, '[.!?,;:…]+$', '')) AS name, CASE WHEN regexp_matches(w, '(\.\.|…)$') THEN 'e' ELSE regexp_extract(w, '[.!?]$') END AS stop,
  CASE WHEN regexp_matches(w, '^\p{{Lu}}') THEN 'U' WHEN regexp_matches(w, '^\p{{Ll}}') THEN 'l' ELSE '' END AS kase FROM bare),
typed AS (SELECT doc_id, pos, CASE WHEN regexp_matches(name, '^[+-]?\d[\d.,]*$') THEN '#' ELSE name END AS type, stop, kase FROM named),
word AS MATERIALIZED (SELECT *, lead(type) OVER w AS next_type, lead(kase) OVER w AS next_case FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
kinds AS MATERIALIZED (SELECT type, count(*) FILTER (WHERE stop = '.')::DOUBLE AS w, count(*)::DOUBLE AS n FROM word GROUP BY type),
total AS MATERIALIZED (SELECT sum(n) AS t, sum(w) AS s FROM kinds),
rated AS (SELECT type, 2 * (w * ln(0.99) + CASE WHEN n > w THEN (n - w) * ln(1 - 0.99::DOUBLE) ELSE 0 END - w * ln(s / t) - (n - w) * ln(1 - s / t)) * exp(-length(replace(type, '.', '')))
  * (length(regexp_replace(type, '[^.]', '', 'g')) + 1) * pow(length(replace(type, '.', ''))::DOUBLE, -(n - w)) AS score
  FROM kinds, total WHERE w > 0 AND regexp_matches(type, '\p{{L}}') AND NOT regexp_matches(type, '^\p{{L}}$')),
abbr AS MATERIALIZED (SELECT * FROM rated WHERE score >= 0.3),
over_ AS (SELECT CASE WHEN stop <> '' THEN type END AS type, stop, next_type, next_case, count(*) AS n FROM word WHERE next_type IS NOT NULL GROUP BY ALL
  UNION ALL SELECT NULL, '^', type, kase, count(*) FROM word WHERE pos = 0 GROUP BY ALL),
pair AS MATERIALIZED (SELECT o.*, CASE WHEN stop = '' THEN 'inside' WHEN stop = 'e' OR (stop = '.' AND (a.type IS NOT NULL OR coalesce(regexp_matches(o.type, '^(\p{{L}}|#)$'), false))) THEN 'unknown' ELSE 'first' END AS place
  FROM over_ AS o LEFT JOIN abbr AS a ON a.type = o.type),
cases AS MATERIALIZED (SELECT next_type AS type, bool_or(next_case = 'l') AS lower_, bool_or(next_case = 'U') AS upper_, bool_or(next_case = 'U' AND place = 'inside') AS upper_inside,
  bool_or(next_case = 'l' AND place = 'first') AS lower_first FROM pair GROUP BY next_type),
breaks AS (SELECT sum(n)::DOUBLE AS f FROM pair WHERE place = 'first'),
tie AS (SELECT p.type, next_type, sum(p.n)::DOUBLE AS b, any_value(k.n) AS f, any_value(l.n) AS s, any_value(t) AS t FROM pair AS p JOIN kinds AS k ON k.type = p.type JOIN kinds AS l ON l.type = next_type, total WHERE place = 'unknown' AND stop = '.' GROUP BY ALL),
colloc AS MATERIALIZED (SELECT * FROM (SELECT *, {_ASSOC.format(b="b", f="f", s="s", t="t")} AS score FROM tie) WHERE score >= 7.88 AND b * t > f * s),
open_ AS (SELECT next_type AS type, sum(p.n)::DOUBLE AS b, any_value(breaks.f) AS f, any_value(k.n) AS s, any_value(t) AS t FROM pair AS p JOIN kinds AS k ON k.type = next_type, total, breaks WHERE place = 'first' AND regexp_matches(next_type, '\p{{L}}') GROUP BY ALL),
starter AS MATERIALIZED (SELECT * FROM (SELECT *, {_ASSOC.format(b="b", f="f", s="s", t="t")} AS score FROM open_) WHERE score >= 30 AND b * t > f * s)"""


@query(f"""WITH {_MODEL} SELECT 'abbreviation' AS kind, type, '' AS next_type, round(score, 4) AS score FROM abbr UNION ALL SELECT 'collocation', type, next_type, round(score, 4) FROM colloc
UNION ALL SELECT 'starter', type, '', round(score, 4) FROM starter""")
def sentence_model(spark, sf):
    """What the splitter learns from all documents."""
    m = SE.train(_t(spark, sf, "documents"))
    row = lambda t, kind, b: m[t].select(F.lit(kind).alias("kind"), "type", b.alias("next_type"), F.round("score", 4).alias("score"))
    return row("abbreviations", "abbreviation", F.lit("")).unionByName(row("collocations", "collocation", F.col("next_type"))).unionByName(row("starters", "starter", F.lit("")))


@query(rf"""WITH {_MODEL},
doubt AS (SELECT w.*, a.type IS NOT NULL AS short, c.type IS NOT NULL AS tied, s.type IS NOT NULL AS opens, coalesce(lower_, false) AS lo, coalesce(upper_, false) AS up, coalesce(upper_inside, false) AS ui, coalesce(lower_first, false) AS lf,
    regexp_matches(w.type, '^\p{{L}}$') AS letter
  FROM word AS w LEFT JOIN abbr AS a ON a.type = w.type LEFT JOIN colloc AS c ON c.type = w.type AND c.next_type = w.next_type LEFT JOIN starter AS s ON s.type = w.next_type LEFT JOIN cases AS k ON k.type = w.next_type
  WHERE stop <> '' AND w.next_type IS NOT NULL),
verdict AS (SELECT doc_id, pos, CASE WHEN stop IN ('!', '?') THEN true WHEN tied AND stop = '.' THEN false
  WHEN (short OR stop = 'e') AND NOT letter THEN (next_case = 'U' AND lo AND NOT ui) OR (next_case = 'U' AND opens)
  WHEN (letter OR type = '#') AND next_case = 'l' AND (up OR NOT lf) THEN false
  WHEN letter AND NOT (next_case = 'U' AND lo AND NOT ui) AND next_case = 'U' AND NOT lo THEN false ELSE true END AS ends FROM doubt),
numbered AS (SELECT p.doc_id, p.pos, piece, coalesce(sum(ends::INT) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS sent_id
  FROM piece AS p LEFT JOIN verdict AS v ON v.doc_id = p.doc_id AND v.pos = p.pos)
SELECT doc_id, sent_id, md5(regexp_replace(string_agg(piece, '' ORDER BY pos), '\s+$', '')) AS h FROM numbered GROUP BY doc_id, sent_id""")
def sentence_split_trained(spark, sf):
    """All documents split by what was learned from all of them."""
    d = SE.split(_t(spark, sf, "documents"), "doc_id")
    return d.select("doc_id", F.posexplode("sentences").alias("sent_id", "s")).select("doc_id", "sent_id", F.md5("s").alias("h"))
