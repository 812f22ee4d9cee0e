"""URL filters: captures judged by the list entries that were active when they were fetched.

A list is a history of dated entries (kind, key, listed_at, action); action is 'add' or 'remove'.
Each run of entries of one kind and key becomes validity intervals [valid_from, valid_to). A capture
is looked up under its host, under each parent domain of its host, and under its host with the first
segment of its path; it is blocked if any interval under these keys holds its fetch time. The lookup
is an as-of join: an equi-join on the key, then the interval test.

Lookup keys of captures are aggregated to distinct (key, fetch time) pairs before the join where that
helps; a key that holds a third of all captures is split by Spark's skew join, since only the small
list side would be repeated.

Defined results: a null or unparsable URL, or a null fetch time, matches nothing and is kept; entries
with a null kind, key or date are ignored; of entries of one key and date, 'remove' wins; captures
are returned row by row, repeated ones too; an empty list blocks nothing; other columns of captures
and entries are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: The list of intervals is broadcast up to this many rows; a larger one is shuffled.
BROADCAST_ROWS = 50_000


def intervals(entries: DataFrame) -> DataFrame:
    """kind, key, valid_from, valid_to (null: still active) of each stretch in which a key is listed."""
    e = entries.select(
        F.lower("kind").alias("kind"), F.lower("key").alias("key"), F.col("listed_at").cast("timestamp").alias("at"), (F.col("action") == "add").alias("on")
    ).where("kind is not null and key is not null and at is not null and on is not null")
    e = e.groupBy("kind", "key", "at").agg(F.min("on").alias("on"))
    w = Window.partitionBy("kind", "key").orderBy("at")
    e = e.withColumn("was", F.lag("on").over(w)).where(F.col("was").isNull() | (F.col("was") != F.col("on")))
    e = e.withColumn("until", F.lead("at").over(w))
    return e.where("on").select("kind", "key", F.col("at").alias("valid_from"), F.col("until").alias("valid_to"))


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user, port and a final dot."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def first_segment(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def lookup_keys(url: Column) -> Column:
    """array of struct(kind, key): the host, each domain that holds it (two labels at least), the host with a path."""
    host, segment = host_of(url), first_segment(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("key")),
    )
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key")), F.struct(F.lit("path").alias("kind"), F.concat(host, F.lit("/"), segment).alias("key")))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<struct<kind:string,key:string>>")).otherwise(F.concat(own, domains))


def filter_captures(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id_col, url, fetched_at, host, n_hits, first_hit (least kind:key that is active) and blocked of each capture."""
    spans = intervals(entries).withColumnsRenamed({"kind": "list_kind", "key": "list_key"})
    small = spans.limit(broadcast_rows + 1).count() <= broadcast_rows
    named = captures.select(F.col(id_col).alias("capture_id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("fetched_at"))
    # A URL and fetch time is judged once, however often it was captured.
    judged = named.select("url", "fetched_at").distinct()
    keyed = judged.withColumn("k", F.explode(lookup_keys(F.col("url")))).select("url", "fetched_at", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"))
    active = keyed.join(
        F.broadcast(spans) if small else spans,
        (F.col("kind") == F.col("list_kind")) & (F.col("key") == F.col("list_key")) & (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))),
    )
    hits = active.groupBy("url", "fetched_at").agg(F.count("*").alias("hits"), F.min(F.concat_ws(":", "kind", "key")).alias("first_hit"))
    hits = hits.withColumnsRenamed({"url": "hit_url", "fetched_at": "hit_at"})
    out = named.join(hits, (named["url"] == hits["hit_url"]) & (named["fetched_at"] == hits["hit_at"]), "left")
    return out.select(
        F.col("capture_id").alias(id_col), "url", "fetched_at", host_of(F.col("url")).alias("host"), F.coalesce("hits", F.lit(0)).cast("long").alias("n_hits"), "first_hit", F.col("hits").isNotNull().alias("blocked")
    )
