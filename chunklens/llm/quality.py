"""Quality rules as weak supervision.

Every rule looks at one document and votes good (1), bad (-1) or abstains (0).
Votes are counted per vote pattern over all documents (at most 3 ** 8 patterns),
and expectation-maximisation on that table estimates, for each rule, how often
it says "bad" of bad documents and "good" of good ones. Estimates are the most probable ones under
a Beta prior that counts as much as ``PRIOR`` of all rows, so that a rule that nothing speaks for or against stays near
what it starts with, and one that the data know follows them, alike at every size. A document is kept when
its posterior probability of being good is at least ``threshold``.

Everything is DataFrame functions. The EM loop runs on the pattern table, whose
size has a fixed bound; each round returns one row of parameters to the driver.

Edge cases: null or empty text has no words and fails the base rule; repeated
rows each keep a row; an empty table gives an empty result; documents are never
joined, and their other columns travel in a struct, so clashing column names do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, pack, table, words

#: Least words, and largest percentage of words in repeated five-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Bounds of the rules: at or under the first value good, at or over the second bad, between them no vote.
SYMBOLS_PER_WORD = (0.02, 0.1)
REPEAT_SHARE = (0.05, 0.2)
DUP_LINE_SHARE = (0.1, 0.3)
UPPER_SHARE = (0.1, 0.3)
SHOUTS_PER_WORD = (0.05, 0.3)
NON_LETTER_SHARE = (0.08, 0.15)
MARK_WORD_SHARE = (0.05, 0.2)
GOOD_WORD_LENGTH, BAD_WORD_LENGTH = (3.0, 7.5), (2.0, 12.0)
#: Characters of words that are no letters.
MARK = r"[^\p{L}\x20\x09-\x0D]"
#: A word with a letter in it.
LETTERED = r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*"
RULES = ("symbols", "letters", "marks", "repeats", "lines", "upper", "shouts", "length")
#: Rounds of EM; start values, which are also the means of the priors (share of good documents, sensitivity, specificity); weight of a prior as a share of all rows.
ROUNDS, START, PRIOR = 12, (0.8, 0.3, 0.99), 0.05
THRESHOLD = 0.5


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base features and the inputs of the rules to every row.

    n_repeat_words: five-word windows are hashed from their words' 64-bit hashes;
    only rows with an equal pair sort them, and the covered words are summed from
    the gaps between the sorted positions of repeated windows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_w", words(F.col(text)))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    d = d.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x))).drop("_w")
    d = d.withColumn(
        "_g",
        F.expr(
            "IF(n_words < 5, CAST(array() AS ARRAY<BIGINT>), transform(slice(_h, 1, CAST(n_words AS INT) - 4),"
            " (x, i) -> xxhash64(x, _h[i + 1], _h[i + 2], _h[i + 3], _h[i + 4])))"
        ),
    ).drop("_h")
    d = d.withColumn(
        "_s",
        F.expr(
            "IF(size(array_distinct(_g)) = size(_g), CAST(array() AS ARRAY<STRUCT<x: BIGINT, i: INT>>),"
            " sort_array(transform(_g, (x, i) -> struct(x, i))))"
        ),
    ).drop("_g")
    d = d.withColumn(
        "_p",
        F.expr(
            "sort_array(transform(filter(transform(_s, (e, k) -> struct(e.i AS i,"
            " (k > 0 AND e.x = _s[greatest(k - 1, 0)].x) OR (k + 1 < size(_s) AND e.x = _s[least(k + 1, size(_s) - 1)].x) AS dup)),"
            " e -> e.dup), e -> e.i))"
        ),
    ).drop("_s")
    d = d.withColumn(
        "n_repeat_words",
        F.expr(
            "CAST(IF(size(_p) = 0, 0, 5 + aggregate(transform(_p, (p, k) -> IF(k = 0, 0, least(5, p - _p[greatest(k - 1, 0)]))),"
            " 0, (a, b) -> a + b)) AS BIGINT)"
        ),
    ).drop("_p")
    d = d.withColumn("n_symbols", F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"))
    d = d.withColumn("_shouts", F.regexp_count(t, F.lit("!")))
    d = d.withColumn("_marks", F.regexp_count(t, F.lit(MARK)))
    d = d.withColumn("_lettered", F.regexp_count(t, F.lit(LETTERED)))
    d = d.withColumn("_upper", F.regexp_count(t, F.lit("[A-Z]")))
    d = d.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    d = d.withColumn("n_lines", F.size("_lines").cast("long"))
    return d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _vote(share: Column, bounds: tuple[float, float]) -> Column:
    return F.when(share <= bounds[0], 1).when(share >= bounds[1], -1).otherwise(0)


def votes(featured: DataFrame) -> DataFrame:
    """Add one column ``v_<rule>`` (1 good, -1 bad, 0 abstains) for each rule; rows without words get no votes."""
    n = F.col("n_words")
    length = _share(F.col("word_chars"), n)
    good = (length >= GOOD_WORD_LENGTH[0]) & (length <= GOOD_WORD_LENGTH[1])
    bad = (length <= BAD_WORD_LENGTH[0]) | (length >= BAD_WORD_LENGTH[1])
    by = {
        "symbols": _vote(_share(F.col("n_symbols"), n), SYMBOLS_PER_WORD),
        "repeats": _vote(_share(F.col("n_repeat_words"), n), REPEAT_SHARE),
        "lines": _vote(_share(F.col("n_dup_lines"), F.col("n_lines")), DUP_LINE_SHARE),
        "upper": _vote(_share(F.col("_upper"), F.col("word_chars")), UPPER_SHARE),
        "shouts": _vote(_share(F.col("_shouts"), n), SHOUTS_PER_WORD),
        "letters": _vote(_share(F.col("_marks"), F.col("word_chars")), NON_LETTER_SHARE),
        "marks": _vote(_share(n - F.col("_lettered"), n), MARK_WORD_SHARE),
        "length": F.when(good, 1).when(bad, -1).otherwise(0),
    }
    return featured.withColumns({f"v_{r}": F.when(n > 0, by[r]).otherwise(0).cast("int") for r in RULES})


def _logs(p: dict) -> tuple[float, dict[str, tuple[float, float]]]:
    """Prior log odds of good, and each rule's log ratio for a good and for a bad vote."""
    prior = math.log(p["prior"] / (1 - p["prior"]))
    return prior, {r: (math.log(p[f"b_{r}"] / (1 - p[f"a_{r}"])), math.log((1 - p[f"b_{r}"]) / p[f"a_{r}"])) for r in RULES}


def posterior(params: dict) -> Column:
    """Probability that a row with vote columns is good."""
    prior, logs = _logs(params)
    odds = F.lit(prior)
    for r in RULES:
        v = F.col(f"v_{r}")
        odds = odds + F.when(v == 1, F.lit(logs[r][0])).when(v == -1, F.lit(logs[r][1])).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame, rounds: int = ROUNDS) -> dict:
    """EM over the vote patterns of all rows: ``prior``, ``a_<rule>`` (bad votes on bad rows), ``b_<rule>`` (good votes on good)."""
    cols = [f"v_{r}" for r in RULES]
    patterns = cut(voted.groupBy(*cols).agg(F.count("*").alias("n")).coalesce(1).sortWithinPartitions(*cols))
    params = {"prior": START[0]} | {f"a_{r}": START[1] for r in RULES} | {f"b_{r}": START[2] for r in RULES}
    for _ in range(rounds):
        q = patterns.withColumn("g", F.col("n") * posterior(params)).withColumn("h", F.col("n") - F.col("g"))
        sums = [F.sum("g").alias("good"), F.sum("n").alias("all")]
        for r in RULES:
            v = F.col(f"v_{r}")
            sums += [F.sum(F.when(v == s, F.col(c)).otherwise(0.0)).alias(f"{c}_{r}_{s}") for c in "gh" for s in (1, -1)]
        x = q.agg(*sums).first()
        if not x["all"]:
            return params
        weight = PRIOR * x["all"]
        rate = lambda a, b, mean: (a + weight * mean) / (a + b + weight)
        params = {"prior": rate(x["good"], x["all"] - x["good"], START[0])}
        params |= {f"a_{r}": rate(x[f"h_{r}_-1"], x[f"h_{r}_1"], START[1]) for r in RULES}
        params |= {f"b_{r}": rate(x[f"g_{r}_1"], x[f"g_{r}_-1"], START[2]) for r in RULES}
    return params


_ADDED = ["n_words", "word_chars", "n_repeat_words", "n_symbols", "n_lines", "n_dup_lines", *[f"v_{r}" for r in RULES], "base_failed", "p_good", "kept"]


def judge(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, slim: bool = False) -> DataFrame:
    """Every row with its features, votes, ``base_failed``, ``p_good`` and ``kept``; added names replace equal ones.

    slim: leave out the text; the features are then computed once and written to the
    shared folder between the fit and the verdict, instead of computed in both passes.
    """
    packed, rest = pack(docs, text, _ADDED)
    voted = votes(features(packed, "__text"))
    if slim:
        voted = cut(voted.drop("__text"))
    params = fit(voted)
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)
    out = voted.withColumn("base_failed", failed).withColumn("p_good", posterior(params))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    return out.select(*[F.col(f"__rest.`{c}`") for c in rest], *([] if slim else [F.col("__text").alias(text)]), *_ADDED)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict for every document."""
    d = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), slim=True)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with their own columns only."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    # the features are materialised, else the filter would be pushed below them and compute them many times over
    return judge(own, "_text", slim=True).where("kept").select("_row.*")


def _oracle() -> str:
    """The same judgement in DuckDB SQL: features by unnesting, EM by a recursive query."""
    vote = lambda share, b: f"CASE WHEN {share} <= {b[0]} THEN 1 WHEN {share} >= {b[1]} THEN -1 ELSE 0 END"
    n = "greatest(n_words, 1)"
    length = f"(word_chars / {n})"
    by = {
        "symbols": vote(f"n_symbols / {n}", SYMBOLS_PER_WORD),
        "repeats": vote(f"n_repeat_words / {n}", REPEAT_SHARE),
        "lines": vote("n_dup_lines / greatest(n_lines, 1)", DUP_LINE_SHARE),
        "upper": vote("n_upper / greatest(word_chars, 1)", UPPER_SHARE),
        "shouts": vote(f"n_shouts / {n}", SHOUTS_PER_WORD),
        "marks": vote(f"(n_words - n_lettered) / {n}", MARK_WORD_SHARE),
        "letters": vote("n_marks / greatest(word_chars, 1)", NON_LETTER_SHARE),
        "length": f"CASE WHEN {length} BETWEEN {GOOD_WORD_LENGTH[0]} AND {GOOD_WORD_LENGTH[1]} THEN 1 WHEN {length} <= {BAD_WORD_LENGTH[0]} OR {length} >= {BAD_WORD_LENGTH[1]} THEN -1 ELSE 0 END",
    }
    v = ", ".join(f"CASE WHEN n_words > 0 THEN {by[r]} ELSE 0 END AS v_{r}" for r in RULES)
    odds = "ln(e.prior / (1 - e.prior))" + "".join(
        f" + CASE v_{r} WHEN 1 THEN ln(e.b_{r} / (1 - e.a_{r})) WHEN -1 THEN ln((1 - e.b_{r}) / e.a_{r}) ELSE 0 END" for r in RULES
    )
    rate = lambda a, b, mean: f"(({a}) + {PRIOR} * sum(n) * {mean}) / (({a}) + ({b}) + {PRIOR} * sum(n))"
    over = lambda c, r, s: f"coalesce(sum({c}) FILTER (WHERE v_{r} = {s}), 0)"
    step = ", ".join(f"{rate(over('h', r, -1), over('h', r, 1), START[1])} AS a_{r}, {rate(over('g', r, 1), over('g', r, -1), START[2])} AS b_{r}" for r in RULES)
    start = ", ".join(f"{START[1]}::DOUBLE AS a_{r}, {START[2]}::DOUBLE AS b_{r}" for r in RULES)
    rules = ", ".join(f"v_{r}" for r in RULES)
    gap = r"[\x20\x09-\x0D]"
    return f"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS w FROM documents),
grams AS (
  SELECT rid, i, w[i:i + 4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS c FROM dup, range(5) AS r(j) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS d FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM base) WHERE regexp_replace(l, '{gap}', '', 'g') <> '' GROUP BY rid),
feat AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{gap}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_shouts, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
    (length(t) - length(regexp_replace(t, '{MARK}', '', 'g')))::BIGINT AS n_marks,
    len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_lettered,
    coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(lines.d, 0)::BIGINT AS n_dup_lines, coalesce(rep.c, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
voted AS (SELECT *, {v} FROM feat),
pat AS (SELECT {rules}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL),
em AS (
  SELECT 0 AS it, {START[0]}::DOUBLE AS prior, {start}
  UNION ALL
  SELECT it, prior, {", ".join(f"a_{r}, b_{r}" for r in RULES)} FROM (
    SELECT any_value(it) + 1 AS it, {rate("sum(g)", "sum(h)", START[0])} AS prior, {step} FROM (
      SELECT *, n - g AS h FROM (SELECT e.it, pat.*, n / (1 + exp(-({odds}))) AS g FROM em AS e, pat WHERE e.it < {ROUNDS}))
    HAVING count(*) > 0))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 1 / (1 + exp(-({odds}))) >= {THRESHOLD} AS kept
FROM voted, em AS e WHERE e.it = {ROUNDS}
"""


WORD_SQL = r"[^\x20\x09-\x0D]+"
ORACLES = {"op8_quality_rules": _oracle()}
QUERIES = {"op8_quality_rules": op8_quality_rules}
