"""URL filter with dated lists: every capture is judged by the list entries that were active when it was fetched.

List events (a domain is added to or removed from a list at a time) become validity intervals; an as-of join finds for
each captured host and time the active intervals of the host and its parent domains. DataFrame functions only.

Skew: captures are reduced to distinct (host, time) pairs first; intervals and captures meet on (domain, month), an
interval standing once in each month it touches, so a host with a third of all captures is spread over the months and the
join may be split further by adaptive execution. Events of one domain are linked day by day, then day to day.

Defined results: a null, relative or over-long host (over 253 characters) matches nothing; a null time matches nothing;
null or unknown actions, domains and times of events are ignored; of several events of one domain, list and instant an
addition wins; repeated captures give repeated rows; an interval holds its start but not its end; columns of the
captures that are named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
MAX_HOST = 253
ADDED = ("blocked", "matched", "n_lists")


def host_of(url: Column) -> Column:
    """Lower-case host without trailing dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when((host != "") & (F.length(host) <= MAX_HOST), host)


def validity_intervals(events: DataFrame) -> DataFrame:
    """``domain``, ``list``, ``valid_from``, ``valid_to`` (null: open) from events ``domain``, ``list``, ``action``, ``at``."""
    known = (events.where(F.col("action").isin("add", "remove") & F.col("domain").isNotNull() & F.col("at").isNotNull())
             .groupBy(F.lower("domain").alias("domain"), F.coalesce("list", F.lit("")).alias("list"), "at")
             .agg(F.max((F.col("action") == "add").cast("int")).alias("adds"))
             .withColumn("day", F.to_date("at")))
    days = known.groupBy("domain", "list", "day").agg(F.min("at").alias("first"))
    following = days.withColumn("after", F.lead("first").over(Window.partitionBy("domain", "list").orderBy("day"))).drop("first")
    inside = known.withColumn("next", F.lead("at").over(Window.partitionBy("domain", "list", "day").orderBy("at")))
    return (inside.join(following, ["domain", "list", "day"]).where("adds = 1")
            .select("domain", "list", F.col("at").alias("valid_from"), F.coalesce("next", "after").alias("valid_to")))


def filter_urls(captures: DataFrame, events: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with ``blocked``, ``matched`` (the longest active domain) and ``n_lists`` (lists it was on)."""
    keyed = captures.select(F.struct(*captures.columns).alias("row"), host_of(F.col(url)).alias("host"), F.col(at).alias("at"))
    pairs = keyed.where("host is not null and at is not null").select("host", "at").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = pairs.select("host", "at", F.explode(parents).alias("domain"), F.trunc("at", "month").alias("month"))
    last = pairs.agg(F.max("at").alias("last"))
    month = F.explode(F.sequence(F.trunc("valid_from", "month"), F.trunc(F.least(F.coalesce("valid_to", "last"), "last"), "month"),
                                 F.expr("interval 1 month"))).alias("month")
    spans = (validity_intervals(events).join(F.broadcast(last)).where("valid_from <= last")  # one row
             .select("domain", "list", "valid_from", "valid_to", month))
    hits = (asked.join(spans, ["domain", "month"]).where("at >= valid_from and (valid_to is null or at < valid_to)")
            .groupBy("host", "at").agg(F.max_by("domain", F.struct(F.length("domain"), "domain")).alias("matched"),
                                       F.count_distinct("list").alias("n_lists")))
    return (keyed.join(hits, ["host", "at"], "left")
            .select(*[F.col("row")[c].alias(c) for c in captures.columns if c.lower() not in ADDED], F.col("matched").isNotNull().alias("blocked"), "matched", F.coalesce("n_lists", F.lit(0)).cast("long").alias("n_lists")))
