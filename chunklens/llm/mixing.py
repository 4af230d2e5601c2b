"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; each of its rows should be copied
``target / source size`` times. The whole part of that is given to every row. The
fractional parts are rounded by the pivotal method: two units meet, mass moves at
random until one of them is 0 or 1, and the other meets the next unit. What moves is words, not copies: one unit
gains as many as the other loses, so that the words taken are those of the fractions until the last unit, and each unit
keeps its expectation. Units are dealt by hash into blocks of about ``BLOCK``, ordered from the largest down. A block
leaves at most one undecided unit; those go into blocks of the next level, and so
on, so that the tree has log_BLOCK(rows) levels and no task holds more than a block.
In the one block that a source ends with, the last unit is rounded by its probability. Where that puts the words off by more than
``NEAR`` of the target, as with few rows of uneven size, single units of that block are turned over as long as that brings them nearer.

Everything is DataFrame functions. Randomness is a hash of the ids that meet, so
reruns agree.

Edge cases: null text has size 0 and is taken 0 words; a null source comes last in
the order of sources; equal rows (source, doc_id, size) are one unit with a count
(their copies are dealt as evenly as possible), so a doc_id that repeats, or is
null, cannot fill a block; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators.etl import numbered
from .common import cut, table, words

#: Weights by rank of the source, repeating; the most copies of a row; units of a block.
WEIGHTS, MOST, BLOCK = (1, 2, 3), 3, 256
#: Share of the target that the last rounding of a source may be off; most units that are turned over.
NEAR, TURNS = 0.01, 64
#: A mass nearer to 0 or 1 than this counts as decided.
EPS = 1e-9
#: Keys that the rows of one source are dealt over where they are joined to what is known of it.
SALTS = 256


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size) to targets: shares by weight, none above ``MOST`` times its size, the excess reshared.

    The fixpoint of resharing is min(cap, level * weight). Sources in order of cap per
    weight are capped as long as the level that the others would get is not below that;
    later sources would get less, so the level is the largest of these.
    The windows run over one row for each source.
    """
    by_name = W.Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    d = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * MOST).cast("double"))
    order = W.Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(W.Window.unboundedPreceding, -1), W.Window.partitionBy()
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    others = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    d = d.withColumn("_level", F.when(F.col("cap") / F.col("weight") >= rest / others, rest / others))
    d = d.withColumn("_level", F.max("_level").over(whole))
    return d.select("source", "source_size", F.least(F.col("cap"), F.coalesce("_level", F.lit(0.0)) * F.col("weight")).alias("target"))


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


_UNIT = "STRUCT<size: BIGINT, doc_id: {id}, m: BIGINT, sure: BIGINT, p: DOUBLE, extra: BIGINT, open: BOOLEAN>"

#: A unit with another mass and decision.
_SET = "named_struct('size', {x}.size, 'doc_id', {x}.doc_id, 'm', {x}.m, 'sure', {x}.sure, 'p', {p}, 'extra', {extra}, 'open', {x}.open)"

#: One meeting of the unit that is carried (a.c) and the next (x): words move up or down to it until one of the two is 0 or 1.
_MEET = """
aggregate(units, named_struct('c', CAST(NULL AS {unit}), 'out', CAST(array() AS ARRAY<{unit}>)),
 (a, x) -> IF(x.extra IS NOT NULL, named_struct('c', a.c, 'out', array_append(a.out, x)),
  IF(a.c IS NULL, named_struct('c', x, 'out', a.out),
   transform(array(named_struct('i', greatest(a.c.size, 1), 'j', greatest(x.size, 1), 'u', shiftrightunsigned(xxhash64({seed}, a.c.doc_id, a.c.size, x.doc_id, x.size), 11) / 9007199254740992D)),
    s -> transform(array(named_struct('i', s.i, 'j', s.j, 'u', s.u, 'up', least((1 - a.c.p) * s.i, x.p * s.j), 'down', least(a.c.p * s.i, (1 - x.p) * s.j))),
     r -> transform(array(IF(r.u * (r.up + r.down) < r.down, named_struct('p', a.c.p + r.up / r.i, 'q', x.p - r.up / r.j), named_struct('p', a.c.p - r.down / r.i, 'q', x.p + r.down / r.j))),
      q -> named_struct(
       'c', IF(q.p > {eps} AND q.p < 1 - {eps}, {carried}, IF(q.q > {eps} AND q.q < 1 - {eps}, {next}, CAST(NULL AS {unit}))),
       'out', concat(a.out, IF(q.p > {eps} AND q.p < 1 - {eps}, CAST(array() AS ARRAY<{unit}>), array({carried_done})), IF(q.q > {eps} AND q.q < 1 - {eps}, CAST(array() AS ARRAY<{unit}>), array({next_done}))))
     )[0])[0])[0])))
"""

#: The last block of a source: its units with the last one rounded, which puts the words off by ``off``, and single units turned over while that helps.
_LAST = """
aggregate(sequence(1, {turns}), named_struct('off', IF(r.c IS NULL, 0D, (CAST(won AS DOUBLE) - r.c.p) * r.c.size), 'out', IF(r.c IS NULL, r.out, array_append(r.out, {rounded}))),
 (a, i) -> IF(abs(a.off) <= near, a,
  transform(array(array_min(transform(a.out, (x, k) -> named_struct('d', IF(x.open, abs(a.off + IF(x.extra = 1, -x.size, x.size)), 1D / 0D), 'k', k)))),
   b -> IF(b.k IS NULL OR b.d >= abs(a.off) - 0.5D, a, named_struct('off', a.off + IF(a.out[b.k].extra = 1, -a.out[b.k].size, a.out[b.k].size),
     'out', transform(a.out, (x, k) -> IF(k = b.k, {turned}, x)))))[0])).out
"""


def _filled(sql: str, **more: str) -> str:
    unset = "CAST(NULL AS BIGINT)"
    sets = {
        "carried": _SET.format(x="a.c", p="q.p", extra=unset), "next": _SET.format(x="x", p="q.q", extra=unset),
        "carried_done": _SET.format(x="a.c", p="0D", extra="IF(q.p > 0.5, 1L, 0L)"), "next_done": _SET.format(x="x", p="0D", extra="IF(q.q > 0.5, 1L, 0L)"),
        "rounded": _SET.format(x="r.c", p="0D", extra="won"), "turned": _SET.format(x="x", p="0D", extra="1L - x.extra"),
    }
    return sql.format(eps=f"{EPS:.12f}D", turns=TURNS, **sets, **more)


def with_source(d: DataFrame, small: DataFrame) -> DataFrame:
    """Rows with what ``small`` has of their source, one row for each ``_s``; a source's rows are dealt over ``SALTS`` keys, so that a hot one isn't one task's."""
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    d = d.withColumn("_dealt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)))
    return d.join(small, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_dealt") == F.col("_salt"))).drop("_dealt", "_salt")


def round_copies(units: DataFrame, seed: int = 0) -> DataFrame:
    """From (source, doc_id, size, m, fraction) to the copies of each unit: m rows, ``sure`` for every row and ``extra`` for the unit.

    The number of levels follows from the largest number of units in a source; a source is done at the level where it is one block.
    """
    unit = _UNIT.format(id=dict(units.dtypes)["doc_id"])
    d = units.withColumn("sure", F.floor("fraction")).withColumn("_mass", F.col("m") * (F.col("fraction") - F.floor("fraction")))
    d = d.withColumn("_whole", F.floor(F.col("_mass") + EPS)).withColumn("p", F.greatest(F.col("_mass") - F.col("_whole"), F.lit(0.0)))
    counts = units.groupBy("source").agg(F.count("*").alias("_n"), (F.sum(F.col("m") * F.col("size") * F.col("fraction")) * NEAR).alias("near"))
    counts = cut(counts)
    most = counts.agg(F.max("_n")).first()[0] or 0
    d = with_source(d, counts.withColumnRenamed("source", "_s")).drop("_s")
    d = d.withColumn("blocks", F.ceil(F.col("_n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("blocks")))
    settled = F.when(F.col("p") <= EPS, F.lit(0)).cast("bigint")
    d = d.select("source", "blocks", "block", "near", F.struct("size", "doc_id", "m", "sure", "p", settled.alias("extra"), (F.col("p") > EPS).alias("open")).cast(unit).alias("u"), "_whole")
    # what a unit surely gets beyond the equal share of its rows travels in "sure" as an exact total
    d = d.withColumn("u", F.col("u").withField("sure", F.col("u.sure") * F.col("u.m") + F.col("_whole"))).drop("_whole")
    out = None
    level = 0
    while True:
        g = d.groupBy("source", "blocks", "block", "near").agg(F.sort_array(F.collect_list("u"), asc=False).alias("units"))
        g = g.withColumn("r", F.expr(_filled(_MEET, unit=unit, seed=seed * 64 + level)))
        g = g.withColumn("won", (_uniform(F.lit(seed), F.lit("last"), F.col("r.c.doc_id"), F.col("r.c.size")) < F.col("r.c.p")).cast("bigint"))
        g = cut(g.withColumn("done", F.when(F.col("blocks") == 1, F.expr(_filled(_LAST))).otherwise(F.col("r.out"))).select("source", "blocks", "block", "near", "r.c", "done"))
        done = g.select("source", F.explode("done").alias("u"))
        out = done if out is None else out.unionByName(done)
        if most <= BLOCK:
            break
        left = g.where("c IS NOT NULL AND blocks > 1")
        d = left.select("source", F.ceil(F.col("blocks") / BLOCK).alias("blocks"), F.floor(F.col("block") / BLOCK).alias("block"), "near", F.col("c").alias("u"))
        most, level = -(-most // BLOCK), level + 1
    return out.select("source", "u.doc_id", "u.size", "u.m", (F.col("u.sure") + F.col("u.extra")).alias("copies"))


def plan(sized: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """From rows (doc_id, source, size) to the copies of all m rows of each different one, (source, doc_id, size, m, copies), and the targets (_s, source_size, target)."""
    units = cut(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("m")))
    t = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")))
    t = cut(t.withColumnRenamed("source", "_s"))
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    d = with_source(units, t).select("source", "doc_id", "size", "m", share.alias("fraction"))
    return round_copies(d, seed), t


#: Equal rows are written out so many at a time.
_AT_ONCE = 10_000


def mix(sized: DataFrame, seed: int = 0) -> DataFrame:
    """From rows (doc_id, source, size) to rows (doc_id, source, size, source_size, target, copies), one for each row given."""
    copies, t = plan(sized, seed)
    d = with_source(copies, t)
    d = d.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / _AT_ONCE))))
    d = d.withColumn("_j", F.explode(F.sequence(F.col("_k") * _AT_ONCE + 1, F.least((F.col("_k") + 1) * _AT_ONCE, F.col("m")))))
    each = F.floor(F.col("copies") / F.col("m")) + F.when(F.col("_j") <= F.col("copies") % F.col("m"), 1).otherwise(0)
    return d.select("doc_id", "source", "size", "source_size", "target", each.cast("bigint").alias("copies"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def take_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, with its own columns.

    Rows that agree in doc_id, source and size share their copies in the order of their text; where there are such rows, they
    are numbered over partitions, so that no number of them is too many for a task.
    """
    size = F.size(words(F.col("text"))).cast("long")
    copies, _ = plan(docs.select("doc_id", "source", size.alias("size")))
    got = copies.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size", "m", "copies")])
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), size.alias("_z"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_doc_id")) & F.col("_row.source").eqNullSafe(F.col("_source")) & (F.col("_z") == F.col("_size"))
    d = d.join(got, same)
    out = d.where("_m = 1").select("_row", F.col("_copies").alias("_c"))
    if (copies.agg(F.max("m")).first()[0] or 1) > 1:
        keys = [F.col("_row.source").alias("_a"), F.col("_row.doc_id").alias("_b"), F.col("_z").alias("_s"), F.col("_row.text").alias("_t")]
        many = numbered(d.where("_m > 1").select("*", *keys), "_a", "_b", "_s", "_t")
        first = many.groupBy(F.col("_a").alias("_fa"), F.col("_b").alias("_fb"), F.col("_s").alias("_fs")).agg(F.min("pos").alias("_zero"))
        many = many.join(first, F.col("_a").eqNullSafe(F.col("_fa")) & F.col("_b").eqNullSafe(F.col("_fb")) & (F.col("_s") == F.col("_fs")))
        own = F.floor(F.col("_copies") / F.col("_m")) + F.when(F.col("pos") - F.col("_zero") < F.col("_copies") % F.col("_m"), 1).otherwise(0)
        out = out.unionByName(many.select("_row", own.alias("_c")))
    out = out.where("_c > 0").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_c"))))
    return out.select("_row.*")


QUERIES = {"op9_mix_sources": op9_mix_sources}
ORACLES: dict[str, str] = {}
