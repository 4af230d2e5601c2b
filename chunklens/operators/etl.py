"""Shards, blocks, batches, packing, first- and last-wins merges, pairs for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import cut

#: Groups whose facts are sent to every task.
GROUPS = 100_000


def round_robin(position: Column, shards: int) -> Column:
    return F.pmod(position, F.lit(shards)).cast("int")


def contiguous(position: Column, total: Column, shards: int) -> Column:
    """Shards of ceil(total / shards) rows; the last one is short."""
    return F.floor(position / F.ceil(total / shards)).cast("int")


def block(position: Column, size: int) -> Column:
    return F.floor(position / size).cast("int")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Add ``pos`` from 0 in a total order, without one task for all rows.

    Rows are range-partitioned, sorted and written to the shared checkpoint folder once: range bounds are sampled, so
    a second run of the exchange could deal rows otherwise. Each written partition's count gives the offset of the
    next (one number a partition), and rows are numbered inside their partition. Columns named ``_part``, ``_in``,
    ``_first`` or ``_before`` and an earlier ``pos`` would be lost.
    """
    d = cut(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order))
    d = d.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id())
    first = d.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_in").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select("_part", "_first", before.alias("_before"))
    return d.join(F.broadcast(first), "_part").withColumn("pos", F.col("_before") + F.col("_in") - F.col("_first")).drop("_part", "_in", "_before", "_first")


def prefix_counts(df: DataFrame, group: str, position: str, counted: Column, block: int = 1 << 16) -> DataFrame:
    """Add ``upto``: the rows of the group that count, up to and with each position.

    Positions of a group are numbered from 0 without gaps. They are counted in blocks, and blocks are counted beside them, so no
    task has more than a block, or one number for each block of a group.
    """
    d = df.withColumn("_b", F.floor(F.col(position) / block)).withColumn("_c", counted.cast("long"))
    blocks = d.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_own")).agg(F.sum("_c").alias("_n"))
    before = F.sum("_n").over(W.Window.partitionBy("_g").orderBy("_own").rowsBetween(W.Window.unboundedPreceding, -1))
    blocks = blocks.select("_g", "_own", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_c").over(W.Window.partitionBy(group, "_b").orderBy(position).rowsBetween(W.Window.unboundedPreceding, 0))
    d = d.withColumn("_inside", inside).join(blocks, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_own")))
    return d.withColumn("upto", F.col("_before") + F.col("_inside")).drop("_b", "_c", "_g", "_own", "_before", "_inside")


def beside(df: DataFrame, group: str, facts: DataFrame, key: str) -> DataFrame:
    """Rows with the facts of their group, null being a group; ``key`` names the group in ``facts`` and goes.

    Rows of a large group stay where they are: up to ``GROUPS`` facts are sent to every task. More groups are joined by a shuffle, as none
    of so many needs to be large.
    """
    facts = cut(facts)
    few = facts.limit(GROUPS + 1).count() <= GROUPS
    return df.join(F.broadcast(facts) if few else facts, F.col(group).eqNullSafe(F.col(key))).drop(key)


def first_wins(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """One row for each key, the first in an explicit order: a row of least order value, found by partial aggregation."""
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    picked = df.groupBy(*keys).agg(F.min_by(own, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row"))
    return picked.select("_row.*")


def last_wins(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    picked = df.groupBy(*keys).agg(F.max_by(own, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row"))
    return picked.select("_row.*")


def merge_sources(parts: list[DataFrame], key: str, position: str) -> DataFrame:
    """Union in order of priority, then the first of each key."""
    tagged = [p.withColumn("src_prio", F.lit(i)) for i, p in enumerate(parts)]
    union = tagged[0]
    for p in tagged[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    return first_wins(union, (key,), F.col("src_prio"), F.col(position))


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def sym_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    d = x.join(y, key, "full_outer").where("_a IS NULL OR _b IS NULL")
    return d.select(key, F.when(F.col("_a").isNotNull(), "left").otherwise("right").alias("side"))


def length_batches(df: DataFrame, group: str, length: str, key: str, most: int = 32, budget: int = 80_000_000) -> DataFrame:
    """(group, key, k, batch): rows of a group by ascending length, then key, numbered from 1; a new batch when one is full or
    (rows + 1) * longest ** 2 goes over budget.

    The rule is folded over runs of equal lengths, of which a group has no more than it has lengths; rows find their
    batch from their place in the run. So no task holds a group.
    """
    d = numbered(df.select(group, length, key), group, length, key)
    runs = d.groupBy(group, length).agg(F.min("pos").alias("_at"), F.count("*").alias("_n"))
    kinds = dict(runs.dtypes)
    start = runs.groupBy(group).agg(F.min("_at").alias("_zero"))
    first = runs.groupBy(group).applyInPandas(lambda p: _fill(p, length, most, budget), f"`{group}` {kinds[group]}, `{length}` {kinds[length]}, _at long, _held int, _cap int, _batch int")
    d = d.join(first.withColumnsRenamed({group: "_g", length: "_l"}), F.col(group).eqNullSafe(F.col("_g")) & F.col(length).eqNullSafe(F.col("_l"))).drop("_g", "_l")
    d = d.join(start.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")))
    batch = F.col("_batch") + F.floor((F.col("_held") + F.col("pos") - F.col("_at")) / F.col("_cap"))
    return d.select(group, key, (F.col("pos") - F.col("_zero") + 1).cast("int").alias("k"), batch.cast("int").alias("batch"))


def _fill(p, length: str, most: int, budget: int):
    """For each run the batch that it begins in, the rows that this holds already (none in a new one), and the rows a batch may hold."""
    p = p.sort_values("_at").reset_index(drop=True)
    held, batch, out = 0, 0, []
    for x, n in zip(p[length].fillna(0).tolist(), p["_n"].tolist(), strict=True):
        cap = max(1, min(most, int(budget // (x * x)) if x else most))
        if held >= cap:
            held, batch = 0, batch + 1
        out.append((held, cap, batch))
        full, held = divmod(held + n - 1, cap)
        batch, held = batch + full, held + 1
    p["_held"], p["_cap"], p["_batch"] = zip(*out, strict=True)
    return p[[p.columns[0], length, "_at", "_held", "_cap", "_batch"]]


def pack_longest_first(df: DataFrame, group: str, size: str, bins: int) -> DataFrame:
    """(group, bin, load, n) when rows of a group go, largest first, to the lightest bin, of equals the first.

    Rows are counted by size first. A run of equal sizes goes to the bins whose loads, one size apart, are the least of all bins'
    future loads, so a run takes the time of its bins, not of its rows.
    """
    runs = df.groupBy(group, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_s")).agg(F.count("*").alias("_n"))
    return runs.groupBy(group).applyInPandas(lambda p: _pack_runs(p, group, bins), f"`{group}` {dict(runs.dtypes)[group]}, bin int, load long, n long")


def _pack_runs(p, group: str, bins: int):
    import pandas as pd

    load, rows = [0] * bins, [0] * bins
    for size, n in sorted(zip(p["_s"].tolist(), p["_n"].tolist(), strict=True), reverse=True):
        if size <= 0:  # they change no load, so all go to the first of the lightest
            rows[load.index(min(load))] += n
            continue
        # the highest load such that no more than n rows are taken below it
        under = lambda top: sum(max(0, -(-(top - v) // size)) for v in load)
        lo, hi = min(load), max(load) + (n + 1) * size
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if under(mid) <= n else (lo, mid - 1)
        take = [max(0, -(-(lo - v) // size)) for v in load]
        left = n - sum(take)
        for b in range(bins):  # what is left goes to bins whose load is that very one, in their order
            if left and load[b] + take[b] * size == lo:
                take[b], left = take[b] + 1, left - 1
        load, rows = [v + t * size for v, t in zip(load, take, strict=True)], [r + t for r, t in zip(rows, take, strict=True)]
    own = [(p[group].iloc[0], b, v, r) for b, (v, r) in enumerate(zip(load, rows, strict=True)) if r]
    return pd.DataFrame(own, columns=[group, "bin", "load", "n"])


def spare_split(costs: Column, spare: int) -> Column:
    """Workers of each task: one each, and each spare one to the task with most cost per worker, of equals the first."""
    init = F.transform(costs, lambda _: F.lit(1))

    def step(a: Column, _: Column) -> Column:
        load = F.zip_with(costs, a, lambda c, n: c.cast("double") / n)
        to = F.array_position(load, F.array_max(load)) - 1
        return F.transform(a, lambda n, i: F.when(i == to, n + 1).otherwise(n))

    return F.aggregate(F.sequence(F.lit(1), F.lit(spare)), init, step)


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows of least hash: the same in every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def shard_laws(assigned: DataFrame, key: str, shard: str, shards: int) -> DataFrame:
    """One row: whether no shard is empty, no key in two shards, and no shard out of range."""
    per_key = assigned.groupBy(key).agg(F.countDistinct(shard).alias("c"), F.min(shard).alias("lo"), F.max(shard).alias("hi"))
    laws = per_key.agg(F.max("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    used = assigned.agg(F.countDistinct(shard).alias("used"))
    return laws.crossJoin(used).select((F.col("used") == shards).alias("non_empty"), (F.col("c") == 1).alias("disjoint"), ((F.col("lo") >= 0) & (F.col("hi") < shards)).alias("complete"))


def in_slice(df: DataFrame, group: str, *order: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of each group in a total order, with ``pos``.

    With a limit, each task keeps the first rows of its groups and only these are shuffled. Without one, rows are
    numbered over all groups first, so that a large group is no single task.
    """
    if limit is not None:
        n = F.row_number().over(W.Window.partitionBy(group).orderBy(*order))
        return df.withColumn("_n", n).where(F.col("_n") <= offset + limit).withColumn("pos", (F.col("_n") - 1).cast("long")).where(F.col("pos") >= offset).drop("_n")
    d = numbered(df, group, *order)
    first = d.groupBy(F.col(group).alias("_g")).agg(F.min("pos").alias("_zero"))
    d = beside(d, group, first, "_g").withColumn("pos", F.col("pos") - F.col("_zero")).drop("_zero")
    return d.where(F.col("pos") >= offset)


def picked(df: DataFrame, key: str, include: DataFrame | None = None, skip: DataFrame | None = None) -> DataFrame:
    """Rows whose key is listed to be included (all without a list) and isn't listed to be skipped."""
    d = df.join(include.select(key).distinct(), key, "left_semi") if include is not None else df
    return d.join(skip.select(key).distinct(), key, "left_anti") if skip is not None else d


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int, skip: int = 0) -> DataFrame:
    """Rows in the order of an epoch as ``pos``, the same in every run; the first ``skip`` (done before a run broke off) are left out."""
    d = numbered(df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(key).cast("string")))), "_h", key).drop("_h")
    return d.where(F.col("pos") >= skip)


def known_ids(key: str, *places: DataFrame) -> DataFrame:
    """Different ids over all places (folders, logs, pools)."""
    ids = places[0].select(key)
    for p in places[1:]:
        ids = ids.unionByName(p.select(key))
    return ids.where(F.col(key).isNotNull()).distinct()


def extend_pool(pool: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """The pool and what is finished but not in it yet, each id once; what the pool has stays."""
    return pool.unionByName(not_done(finished.dropDuplicates([key]), pool, key))
