"""Review queue of collected documents and health of the monitored sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger.functions.values import probe_state, short_digest
from geoledger.operators.merges import pick
from geoledger.sources.feeds import feed_entries


def collect_documents(feeds: DataFrame, fetched_at: Column) -> DataFrame:
    """Unreviewed documents of feed texts (source_id, feed_pos, xml), one per id, the last occurrence winning."""
    entries = feed_entries(feeds).filter("length(title) > 0 AND length(url) > 0")
    return queue_entries(entries, fetched_at)


def queue_entries(entries: DataFrame, fetched_at: Column) -> DataFrame:
    documents = entries.select(
        F.concat(F.lit("doc-"), short_digest(20, F.col("source_id"), F.col("url"))).alias("id"), "source_id", "title", "url",
        "published_at_raw", fetched_at.alias("fetched_at"), F.lit("unreviewed").alias("review_status"), "feed_pos", "entry_pos")
    return pick(documents, ["id"], F.struct("feed_pos", "entry_pos"), last=True).drop("feed_pos", "entry_pos")


def in_publishing_order(documents: DataFrame) -> DataFrame:
    """The review queue sorted by id."""
    return documents.orderBy("id")


def monitored(sources: DataFrame) -> DataFrame:
    return sources.filter(F.coalesce("monitor", F.lit(True)))


def source_health(sources: DataFrame, probes: DataFrame) -> DataFrame:
    """State of each monitored source from probe results (source_id, http_status, error_class, checked_at).

    When every probe failed on the network the monitor itself is at fault: all states become unknown.
    """
    watched = monitored(sources).select(F.col("id").alias("source_id"))
    states = probes.join(watched, "source_id", "left_semi").select(
        "source_id", probe_state(F.col("http_status"), F.col("error_class")).alias("state"), "http_status", "checked_at",
        F.when(F.col("http_status").isNotNull() & F.col("error_class").isNotNull(),
               F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))).otherwise(F.col("error_class")).alias("error"))
    verdict = states.agg(F.coalesce(F.bool_and((F.col("state") == "unavailable") & F.col("http_status").isNull()), F.lit(False)).alias("_all_failed"))
    joined = states.join(F.broadcast(verdict))  # one row
    return joined.select(
        "source_id", F.when(F.col("_all_failed"), "unknown").otherwise(F.col("state")).alias("state"), "http_status", "checked_at",
        F.when(F.col("_all_failed"), "monitor_network_error").otherwise(F.col("error")).alias("error"),
        F.when(F.col("_all_failed"), "monitor_error").otherwise("ok").alias("monitor_state"))
