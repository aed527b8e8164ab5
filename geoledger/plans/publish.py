"""Publication: gate, diff, points, a version of the archive, and one commit that is manifest and audit row at once."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger import schemas, vocab
from geoledger.functions.values import utc
from geoledger.operators.merges import single_row
from geoledger.plans.diff import change_summary, diff_snapshots, point_status_changes, point_status_index
from geoledger.plans.snapshot_rules import validate_collection
from geoledger.session import cut
from geoledger.sources.archive import (
    commit_manifest_row, new_version, open_version, previous_date, read_commits, read_manifest, version_of, write_archived,
)
from geoledger.sources.geojson import read_collection
from geoledger.sources.tables import content_digest, read_newest_version, write_version

class Rejected(RuntimeError):
    """Publication refused; ``violations`` holds the failed rules."""

    def __init__(self, message: str, violations: DataFrame | None = None):
        super().__init__(message)
        self.violations = violations


def audit_row(features: DataFrame, digest: str, now) -> DataFrame:
    """Who approved the features of a date."""
    reviewers = F.sort_array(F.collect_set("moderation.reviewer"))
    return features.groupBy("snapshot_date").agg(reviewers.alias("reviewers")).select(
        F.lit("publish_snapshot").alias("action"), "snapshot_date", now.alias("published_at"), F.lit(digest).alias("sha256"), "reviewers")


def publish(spark: SparkSession, candidate_path: str, root: str, approved: bool, now: datetime, points: DataFrame,
            evidence: DataFrame | None = None, sources: DataFrame | None = None, events: DataFrame | None = None,
            methodology_version: str = "1.0") -> str:
    """Publish a reviewed candidate below ``root`` and return its date.

    All tables go to a new version folder; the commit, which is the manifest's and the audit's row, makes them the date's state.
    The current status follows as a new version. A run that breaks off leaves the old state; running the same publication
    again, after whatever step, ends in one commit: candidate, date and the version compared with tell it from others.
    """
    if not approved:
        raise Rejected("publication needs an explicit approval after human review")
    moment = utc(now)
    collection = read_collection(spark, candidate_path)
    documents = collection.documents
    violations = cut(validate_collection(collection, moment, evidence, sources))
    if not violations.isEmpty():
        raise Rejected("snapshot rejected", violations.orderBy("ctx", "idx", "rule"))
    head = documents.select("metadata.snapshot_date", F.coalesce("metadata.methodology_version", F.lit(methodology_version)).alias("version")).first()
    if not head or not head.snapshot_date:
        raise Rejected("metadata.snapshot_date is required")
    day = head.snapshot_date
    digest = content_digest(spark, candidate_path).first().sha256

    features = cut(collection.features.drop("document", "properties_text", "geometry_type", "coordinates"))
    manifest = cut(read_manifest(spark, root))
    before = previous_date(manifest, day).first().date
    compared = version_of(manifest, before)
    publication = hashlib.sha256(f"{day}|{digest}|{compared}".encode()).hexdigest()
    done = read_commits(spark, root).filter(F.col("date") == day).orderBy(F.desc("seq")).select("publication", "version").first()
    if done and done.publication == publication:  # a run after one that was committed
        _publish_status(open_version(spark, root, done.version, "status", schemas.STATUS).drop("snapshot_date").withColumn("snapshot_date", F.lit(day)), root, digest)
        return day
    features = cut(collection.features.drop("document", "properties_text", "geometry_type", "coordinates"))
    previous = open_version(spark, root, compared, "current", schemas.SNAPSHOT_FEATURES).withColumn("ctx", F.lit(day))
    current = features.withColumn("ctx", F.lit(day))
    registry = points.withColumn("ctx", F.lit(day))
    changes = cut(diff_snapshots(previous, current))
    moved = cut(point_status_changes(previous, current, registry).drop("ctx"))

    version = new_version(day)
    tables = {"current": features, "changes": changes, "points": moved, "points_index": point_status_index(current, registry).drop("ctx")}
    if events is not None:
        tables["events"] = events
    for name, table in tables.items():
        write_archived(table, root, version, name, day)

    total = change_summary(changes, F.lit(before)).select("area_change_km2", "feature_count")
    zero = spark.range(1).select(F.lit(0.0).alias("_area"), F.lit(0).cast("bigint").alias("_n"))
    counted = zero.join(total, F.lit(True), "left").select(
        F.coalesce("area_change_km2", "_area").alias("area_change_km2"), F.coalesce("feature_count", "_n").alias("change_count")
    ).join(moved.agg(F.count(F.lit(1)).alias("settlement_count")))
    approved_by = single_row(audit_row(features, digest, moment).select("action", "reviewers"))
    row = cut(counted.join(approved_by, F.lit(True), "left").select(
        F.lit(day).alias("date"), moment.alias("published_at"), "area_change_km2", "change_count", "settlement_count", F.lit(digest).alias("sha256"),
        F.lit(version).alias("version"), F.lit(publication).alias("publication"), F.coalesce("action", F.lit("publish_snapshot")).alias("action"),
        F.coalesce("reviewers", F.array().cast("array<string>")).alias("reviewers")))
    status = row.select(
        F.lit("current").alias("state"), F.col("date").alias("snapshot_date"), "published_at", "area_change_km2",
        F.col("settlement_count").alias("new_settlements"), F.lit(head.version).alias("methodology_version"),
        F.col("sha256").alias("snapshot_sha256"), F.lit(vocab.DELAY_HOURS).alias("public_delay_hours"),
        F.lit(vocab.PUBLICATION_WARNING).alias("warning"))
    write_archived(status, root, version, "status", day)
    commit_manifest_row(row, root)
    _publish_status(status, root, digest)
    return day


def _publish_status(status: DataFrame, root: str, digest: str) -> None:
    """Make the status of a publication the current one, unless it is already; the block of the point feed stays."""
    spark = status.sparkSession
    old = cut(read_newest_version(spark, f"{root}/status_current", schemas.STATUS))
    newest = old.first()
    if newest and newest.snapshot_sha256 == digest and newest.state == "current":
        return
    feed = ("point_feed_date", "point_feed_published_at", "point_feed_updated_at", "point_update_count")
    kept = single_row(old.select(*feed))
    write_version(status.drop(*feed).join(kept, F.lit(True), "left"), f"{root}/status_current", (newest.version if newest else 0) + 1)
