"""URL filters from dated lists, in DataFrame functions only.

A list is a log of dated entries: a key (a domain, or a site section ``host/first-path-part``) is added or removed at a time. Entries
become validity intervals: an entry is in force from its time until the key's next one. An as-of join finds for every
capture of a URL the entry in force at its fetch time, for each of the keys that the URL falls under, and the capture is blocked if
one of them says "added".

The join is one sorted union of entries and captures per key: the interval that holds a capture's time is that of the last entry before it.
The union is dealt to ranges of (kind, key, time) and looked through slab by slab (``operators/slabs``), with a carry of the entry in force
from each slab to the next, so a key with most of the entries or captures is no hot spot and rows stay entries and captures.

Of entries for a key at the same time the one with the greatest ``seq`` counts. Entries and captures without a time, and URLs without a
host, match nothing: such captures are kept. Captures equal in id, URL and time give one row. Empty tables on either side are taken;
columns other than the named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.slabs import highest_so_far, in_slabs


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(host != "", host)


def section_of(url: Column) -> Column:
    """Host and first part of the path, null where the path has none."""
    part = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)", 1)
    return F.when(part != "", F.concat(host_of(url), F.lit("/"), part))


def keys_of(url: Column) -> Column:
    """All keys that a URL falls under: its host, the parent domains of two labels or more, and its section."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.struct(
        F.lit("domain").alias("kind"),
        F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    section = F.array(F.struct(F.lit("section").alias("kind"), section_of(url).alias("key")))
    return F.filter(F.concat(F.when(host_of(url).isNotNull(), domains).otherwise(F.slice(section, 1, 0)), section),
                    lambda k: k["key"].isNotNull())


def in_force(asked: DataFrame, entries: DataFrame, slabs: int | None = None) -> DataFrame:
    """``asked`` (kind, key, at and more) with ``force``, the entry (at, seq, added) of the key that is in force then, or null.

    ``entries`` has kind, key, at (microseconds), seq, added. At the same time entries come before captures.
    """
    dated = entries.filter(F.col("key").isNotNull() & F.col("at").isNotNull())
    entry = F.struct("at", "seq", "added")
    both = dated.select("kind", "key", "at", F.lit(0).alias("_turn"), entry.alias("_entry")).unionByName(
        asked.filter(F.col("key").isNotNull() & F.col("at").isNotNull()).withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    keys, order = ["kind", "key"], ["at", "_turn"]
    met = highest_so_far(in_slabs(both, keys, order, slabs), keys, order, F.col("_entry"), "force").filter("_turn = 1")
    none = asked.filter(F.col("key").isNull() | F.col("at").isNull())
    return met.select(*asked.columns, "force").unionByName(none, allowMissingColumns=True)


def evaluate(captures: DataFrame, entries: DataFrame, slabs: int | None = None) -> DataFrame:
    """(id, host, n_active, matched, entry_age_s, kept) per capture (id, url, at).

    ``n_active`` counts the keys in force, ``matched`` is the longest of them (then the greatest), ``entry_age_s`` the whole
    seconds since its entry.
    """
    asked = captures.select("id", "url", "at", F.explode_outer(keys_of(F.col("url"))).alias("k")).select(
        "id", "url", "at", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"))
    met = in_force(asked, entries, slabs)
    force = F.col("force")
    hit = F.when(force["added"], F.struct(F.length("key").alias("n"), F.col("key").alias("key"), force["at"].alias("since")))
    grouped = met.select("id", "url", "at", hit.alias("hit")).groupBy("id", "url", "at").agg(
        F.size(F.collect_set("hit.key")).cast("bigint").alias("n_active"), F.max("hit").alias("best"))
    age = F.floor((F.col("at") - F.col("best.since")) / 1_000_000).cast("bigint")
    return grouped.select("id", host_of(F.col("url")).alias("host"), "n_active", F.col("best.key").alias("matched"),
                          age.alias("entry_age_s"), (F.col("n_active") == 0).alias("kept"))


# The query's captures are the pages, fetched at the time of the event with the page's number. Its list is the log that the
# events make: an event speaks of the page with its user's number.
VERBS = {"error": ("domain", True), "purchase": ("domain", False), "signup": ("section", True), "click": ("section", False)}


def captures_of(pages: DataFrame, events: DataFrame) -> DataFrame:
    times = events.select(F.col("event_id").alias("_event"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return pages.join(times, F.col("page_id") == F.col("_event"), "left").select(F.col("page_id").alias("id"), "url", "at")


def entries_of(pages: DataFrame, events: DataFrame) -> DataFrame:
    said = events.filter(F.col("event_type").isin(list(VERBS)))
    kind = F.when(F.col("event_type").isin("error", "purchase"), F.lit("domain")).otherwise(F.lit("section"))
    joined = said.join(pages.select(F.col("page_id").alias("user_id"), "url"), "user_id")
    key = F.when(kind == "domain", host_of(F.col("url"))).otherwise(section_of(F.col("url")))
    return joined.select(kind.alias("kind"), key.alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
                         F.col("event_id").alias("seq"), F.col("event_type").isin("error", "signup").alias("added"))


ORACLE = r"""
WITH urls AS (
  SELECT page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
         nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)', 1), '') AS part FROM pages),
captures AS (SELECT page_id, host, part, epoch_us(ts) AS t FROM urls LEFT JOIN events ON event_id = page_id),
entries AS (
  SELECT CASE WHEN event_type IN ('error', 'purchase') THEN 'domain' ELSE 'section' END AS kind,
         CASE WHEN event_type IN ('error', 'purchase') THEN host ELSE host || '/' || part END AS key,
         epoch_us(ts) AS since, event_id AS seq, event_type IN ('error', 'signup') AS added
  FROM events JOIN urls ON page_id = user_id WHERE event_type IN ('error', 'purchase', 'signup', 'click')),
labels AS (SELECT page_id, t, string_split(host, '.') AS l FROM captures WHERE host IS NOT NULL),
keys AS (
  SELECT page_id, t, 'domain' AS kind, array_to_string(l[i:], '.') AS key
  FROM (SELECT page_id, t, l, unnest(range(1, greatest(len(l) - 1, 1) + 1)) AS i FROM labels)
  UNION ALL SELECT page_id, t, 'section', host || '/' || part FROM captures WHERE host IS NOT NULL AND part IS NOT NULL),
inforce AS (SELECT page_id, t, key, max(struct_pack(since := since, seq := seq, added := added)) AS e
         FROM keys JOIN entries USING (kind, key) WHERE since <= t GROUP BY page_id, t, kind, key),
active AS (SELECT page_id, count(*) AS n, max(struct_pack(n := length(key), key := key, age := (t - e.since) // 1000000)) AS best
           FROM inforce WHERE e.added GROUP BY page_id)
SELECT page_id, host, coalesce(n, 0) AS n_active, best.key AS matched, best.age AS entry_age_s, n IS NULL AS kept
FROM captures LEFT JOIN active USING (page_id)
"""
