"""URL filters that hold at fetch time.

A filter list is a history of dated entries (key, action, day): ``add`` puts a key on
the list, ``remove`` takes it off. A key is a host, a parent domain, or a host with a
path prefix. Each entry's validity runs to the next entry of its key; touching ``add``
entries stay separate. Every capture (page_id, url, fetched) is turned into the keys that
can match it: its host, all parents of the host with two labels or more, and all its
path prefixes. An equi-join on the key with the interval condition finds the entries
active at the fetch.

Everything is DataFrame functions. Captures are exploded to their keys and joined with the list on the key, a salt and the interval;
hits are gathered by URL and time, which is all that they depend on, and joined back on these. A list whose counted rows times
their counted width stay under ``BROADCAST_BYTES`` is broadcast to the join, without salts. Otherwise both sides are shuffled: the list is
repeated for each of ``SALT`` salts and captures are dealt over them, so that a host with a third of all captures is spread.

Edge cases: a null or unparsable url has no keys and is allowed; a null fetch time matches
nothing; host names are compared in lower case without a trailing dot or a port; repeated
rows each keep a row; two entries of a key on one day count in the order add, remove; an
empty table or list gives an empty result or no matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import table

#: Size up to which the list is broadcast; salts beyond.
BROADCAST_BYTES, SALT = 8 << 20, 32

#: Captures are dated by their number, a day of 2024 each.
FIRST_DAY, DAYS = "2024-01-01", 366
#: Histories that the query's list deals out to keys, by a hash of the key: (action, days after the first). Keys are
#: the hosts of all pages, their parents and their first path parts; of the numbers from 0 to ``SPREAD`` - 1 those without a history are not listed.
SPREAD = 11
HISTORIES = {
    0: (("add", 0),),
    1: (("add", 31), ("remove", 121), ("add", 227)),
    3: (("add", 60), ("remove", 70)),
    4: (("add", 9), ("remove", 9), ("add", 300)),
    7: (("add", 92), ("add", 121), ("remove", 335)),
}


def intervals(entries: DataFrame) -> DataFrame:
    """From (key, action, day) to (key, since, until): half-open validity of each ``add``; until is null while it lasts.

    Keys are one if they differ only in case, or in a dot or port after the host.
    """
    w = W.Window.partitionBy("key").orderBy("day", "action")
    host = F.substring_index(F.lower("key"), "/", 1)
    plain = F.concat(F.regexp_replace(host, r"\.?(:[0-9]*)?$", ""), F.substring(F.lower("key"), F.length(host) + 1, F.length("key")))
    d = entries.where(F.col("key").isNotNull() & F.col("day").isNotNull()).withColumn("key", plain)
    d = d.withColumn("until", F.lead("day").over(w)).where(F.col("action") == "add")
    return d.select("key", F.col("day").alias("since"), "until").where("until IS NULL OR until > since").distinct()


def keys(url):
    """Keys of a URL column, the longest first: host and path prefixes, the host, its parents of two labels or more."""
    rest = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)([^?#]*)", 0)
    host = F.regexp_replace(F.regexp_extract(rest, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)", 1), r"\.?(:[0-9]*)?$", "")
    path = F.regexp_extract(rest, r"^[a-z][a-z0-9+.-]*://[^/]*(/.*)?$", 1)
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda x: x != "")
    return labels, parts, host


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Every capture with ``host``, ``n_active`` (entries active at its fetch), ``matched`` (the longest of their keys) and ``allowed``.

    The columns ``host``, ``n_active``, ``matched`` and ``allowed`` take the place of columns of these names.
    """
    own = [c for c in captures.columns if c not in ("host", "n_active", "matched", "allowed")]
    d = captures.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(f"`{url}`").alias("_url"), F.col(f"`{fetched}`").alias("_at"))
    labels, parts, host = keys(F.col("_url"))
    facts = d.withColumn("host", host).withColumn("_labels", labels).withColumn("_parts", parts)
    most = F.size("_parts")
    prefixes = F.when(most > 0, F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice("_parts", 1, k), "/")))).otherwise(F.array())
    n = F.size("_labels")
    first = F.lit(1)
    parents = F.when(n >= 2, F.transform(F.sequence(first, F.greatest(first, n - 1)), lambda k: F.array_join(F.slice("_labels", k, n - k + 1), "."))).otherwise(F.array())
    facts = facts.withColumn("_keys", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(prefixes, F.array("host"), parents))))
    facts = facts.drop("_labels", "_parts")

    valid = intervals(entries)
    width = valid.agg(F.count("*").alias("n"), F.max(F.length("key")).alias("w")).first()
    small = width["n"] * (64 + 4 * (width["w"] or 0)) <= BROADCAST_BYTES
    keyed = facts.where("_at IS NOT NULL").select("_url", "_at", F.explode("_keys").alias("key"))
    if small:
        hit = keyed.join(F.broadcast(valid), (keyed["key"] == valid["key"]) & (F.col("since") <= F.col("_at")) & (F.col("until").isNull() | (F.col("_at") < F.col("until"))))
    else:
        salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("_url", "_at"), F.lit(SALT)))
        many = valid.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint")))).hint("merge")
        hit = salted.join(many, (salted["key"] == many["key"]) & (salted["_salt"] == many["_salt"]) & (F.col("since") <= F.col("_at")) & (F.col("until").isNull() | (F.col("_at") < F.col("until"))))
    # an interval of a key has one entry at most, so the different keys are the entries; equal captures are one before the shuffle
    hits = hit.groupBy("_url", "_at").agg(F.collect_set(keyed["key"]).alias("_hits")).select(F.col("_url").alias("_u"), F.col("_at").alias("_t"), "_hits")
    d = facts.join(hits, (F.col("_url") == F.col("_u")) & (F.col("_at") == F.col("_t")), "left")
    best = F.element_at(F.array_sort(F.transform("_hits", lambda k: F.struct((-F.length(k)).alias("l"), k.alias("k")))), 1)["k"]
    d = d.withColumn("n_active", F.coalesce(F.size("_hits"), F.lit(0)).cast("long")).withColumn("matched", best)
    return d.select("_row.*", "host", "n_active", "matched", F.col("_hits").isNull().alias("allowed"))


def listed(pages: DataFrame, url: str = "url") -> DataFrame:
    """The query's list, of the keys of all pages: hosts, their parents and first path parts that the hash gives a history."""
    labels, parts, host = keys(F.col(f"`{url}`"))
    d = pages.select(labels.alias("_labels"), parts.alias("_parts"), host.alias("_host")).where("_host <> ''")
    own = F.array("_host", F.array_join(F.slice("_labels", F.lit(2), F.greatest(F.size("_labels") - 1, F.lit(0))), "."), F.concat("_host", F.lit("/"), F.coalesce(F.try_element_at("_parts", F.lit(1)), F.lit(""))))
    d = d.select(F.explode(own).alias("key")).where(r"key <> '' AND key NOT LIKE '%/' AND (key LIKE '%.%')").distinct()
    histories = F.create_map(*[x for k, h in HISTORIES.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(a).alias("action"), F.lit(n).alias("n")) for a, n in h]))])
    d = d.withColumn("h", F.explode(F.try_element_at(histories, (F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int") % SPREAD))))
    return d.select("key", F.col("h.action").alias("action"), F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("h.n")).alias("day"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list as it stood on the day it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id"), F.lit(DAYS)).cast("int"))
    d = filter_urls(pages.withColumn("fetched", fetched), listed(pages))
    return d.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "n_active", "matched", "allowed")


def _oracle() -> str:
    values = ", ".join(f"({k}, '{a}', {n})" for k, h in HISTORIES.items() for a, n in h)
    return f"""
WITH page0 AS (
  SELECT row_number() OVER () AS rid, page_id, DATE '{FIRST_DAY}' + (page_id % {DAYS})::INTEGER AS fetched,
    regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)', 1), '\\.?(:[0-9]*)?$', '') AS host,
    regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
history(h, action, n) AS (VALUES {values}),
key0 AS (SELECT DISTINCT unnest([host, regexp_replace(host, '^[^.]*\\.?', ''), host || '/' || coalesce(list_filter(string_split(path, '/'), lambda x: x <> '')[1], '')]) AS key FROM page0 WHERE host <> ''),
listed AS (SELECT key, action, DATE '{FIRST_DAY}' + n AS day FROM key0 JOIN history ON h = ('0x' || substr(md5(key), 1, 4))::INT % {SPREAD} WHERE key LIKE '%.%' AND key NOT LIKE '%/'),
valid AS (
  SELECT DISTINCT key, day AS since, until FROM (SELECT *, lead(day) OVER (PARTITION BY key ORDER BY day, action) AS until FROM listed)
  WHERE action = 'add' AND (until IS NULL OR until > day)),
entry AS (SELECT *, CASE WHEN position('/' IN key) > 0 THEN split_part(key, '/', 1) ELSE key END AS khost, CASE WHEN position('/' IN key) > 0 THEN substr(key, position('/' IN key)) ELSE '' END AS kpath FROM valid),
hit AS (
  SELECT rid, count(*) AS n, first(key ORDER BY length(key) DESC, key) AS matched FROM page0 JOIN entry
    ON since <= fetched AND (until IS NULL OR fetched < until)
   AND CASE WHEN kpath = '' THEN host = khost OR ends_with(host, '.' || khost) ELSE host = khost AND (path = kpath OR starts_with(path, kpath || '/')) END
  GROUP BY rid)
SELECT page_id, host, fetched::VARCHAR AS fetched, coalesce(n, 0)::BIGINT AS n_active, matched, n IS NULL AS allowed FROM page0 LEFT JOIN hit USING (rid)
"""


QUERIES = {"op2_url_filters": op2_url_filters}
ORACLES = {"op2_url_filters": _oracle()}
