"""Read-side queries: period changes, search, evidence bundles, point cards, source grid and headline counters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger import vocab
from geoledger.functions.text import name_matches
from geoledger.functions.values import freshness, located
from geoledger.operators.merges import first_match, pick, single_row


def changes_for_period(archived: DataFrame, manifest: DataFrame, current: DataFrame, anchor: date, period: str = "day") -> DataFrame:
    """Changes of all published dates in the period, one per id (or geometry), the last one in manifest order winning:
    the manifest is newest first, so of several dates the oldest wins.

    ``archived`` is partitioned by snapshot_date and compared with a literal, so only eligible partitions are read.
    ``manifest`` carries date and ordinal. When no date is eligible the current changes are shown.
    """
    floor_day = F.date_sub(F.lit(anchor), vocab.PERIOD_DAYS[period])
    eligible = manifest.filter(F.col("date").cast("date") > floor_day).select(F.col("date").cast("string").alias("snapshot_date"), "ordinal")
    in_period = archived.filter(F.col("snapshot_date").cast("date") > floor_day).join(eligible, "snapshot_date")
    none_eligible = eligible.agg((F.count(F.lit(1)) == 0).alias("_none"))
    fallback = current.join(F.broadcast(none_eligible)).filter("_none").drop("_none").withColumn("ordinal", F.lit(0))  # one row
    keep = [c for c in current.columns if c in archived.columns and c != "snapshot_date"]
    both = in_period.select(*keep, "ordinal").unionByName(fallback.select(*keep, F.col("ordinal").cast("bigint")))
    position = F.struct("ordinal", *([F.col("pos")] if "pos" in keep else [F.col("id")]))
    key = F.coalesce(F.nullif("id", F.lit("")), F.to_json("geometry")) if "geometry" in keep else F.col("id")
    return pick(both.withColumn("_key", key), ["_key"], position, last=True).drop("_key", "ordinal")


def period_total(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count(F.lit(1)).alias("change_count"), F.coalesce(F.sum(F.coalesce("area_km2", F.lit(0.0))), F.lit(0.0)).alias("area_km2"))


def search_points(points: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """First matches in index order (column ``ordinal``)."""
    names = [F.col(c) for c in ("name", "name_ru", "name_uk", "name_en")]
    return points.filter(name_matches(query, names, F.col("aliases"))).orderBy("ordinal").limit(limit)


def evidence_bundle(changes: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, pos, evidence columns, side): evidence of each change in bundle order; unknown ids are left out."""
    listed = changes.select("id", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    known = first_match(evidence, "id", "ordinal").withColumnRenamed("id", "evidence_id").drop("ordinal")
    sided = first_match(sources.select("id", "side", "ordinal"), "id", "ordinal").select(F.col("id").alias("source_id"), "side")
    return listed.join(known, "evidence_id").join(sided, "source_id", "left")


def evidence_matrix(changes: DataFrame, evidence: DataFrame, sources: DataFrame,
                    sides: tuple[str, ...] = vocab.SIDES[:3]) -> DataFrame:
    """Per change: does any evidence come from each side, is any of it a satellite image, how many independent groups."""
    bundle = evidence_bundle(changes, evidence, sources)
    flags = [F.bool_or(F.col("side").eqNullSafe(s)).alias(f"has_{s}") for s in sides]
    facts = bundle.groupBy("id").agg(*flags, F.bool_or(F.col("evidence_type").eqNullSafe("satellite")).alias("has_satellite"),
                                     F.count_distinct("independence_group").alias("independent_groups"))
    no = F.lit(False)
    names = [f"has_{s}" for s in sides] + ["has_satellite"]
    return changes.select("id").join(facts, "id", "left").select(
        "id", *[F.coalesce(n, no).alias(n) for n in names], F.coalesce("independent_groups", F.lit(0)).alias("independent_groups"))


def weakly_confirmed(matrix: DataFrame, minimum: int = 2) -> DataFrame:
    """Optional rule: changes with fewer independent evidence groups than the stated method wants."""
    return matrix.filter(F.col("independent_groups") < minimum)


def source_links(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, pos, source_id, name, url): named sources of each record in order."""
    known = first_match(sources.select("id", "name", "url", "ordinal"), "id", "ordinal").withColumnRenamed("id", "source_id")
    return records.select("id", F.posexplode("source_ids").alias("pos", "source_id")).join(known.drop("ordinal"), "source_id")


def evidence_links(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, url): distinct evidence addresses of each record."""
    known = first_match(evidence.select("id", "url", "ordinal"), "id", "ordinal").withColumnRenamed("id", "evidence_id")
    listed = records.select("id", F.explode("evidence_ids").alias("evidence_id"))
    return listed.join(known, "evidence_id").select("id", "url").distinct()


def source_grid(sources: DataFrame, health: DataFrame, side: str = "all") -> DataFrame:
    """Sources with their measured state, or the declared one where there is no measurement."""
    shown = sources if side == "all" else sources.filter(F.col("side") == side)
    first = first_match(health.select("source_id", "state", "checked_at", "ordinal"), "source_id", "ordinal").drop("ordinal")
    joined = shown.join(first.withColumnRenamed("source_id", "id"), "id", "left")
    measured = F.concat_ws(" · ", "state", F.col("checked_at").cast("string"))
    return joined.select(
        "id", "name", "role", "side", "license_status", "usage_note", "url", F.coalesce("state", "health").alias("health_state"),
        F.when(F.col("state").isNotNull(), measured).otherwise(F.col("health_label")).alias("health_label"))


def verified_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("verification_status").isin(*vocab.VERIFIED))


def unverified_records(claims: DataFrame, events: DataFrame) -> DataFrame:
    """All claims, then the events of the unverified class: ordered by (origin, ordinal)."""
    weak = events.filter(F.col("verification_status").isin(*vocab.UNVERIFIED))
    return claims.withColumn("origin", F.lit(0)).unionByName(weak.withColumn("origin", F.lit(1)), allowMissingColumns=True)


def located_events(events: DataFrame) -> DataFrame:
    return verified_events(events).filter(located(F.col("location.lat"), F.col("location.lon")))


def located_points(points: DataFrame) -> DataFrame:
    """Points that can be drawn on a map."""
    return points.filter(located(F.col("lat"), F.col("lon")))


def located_claims(claims: DataFrame, side: str) -> DataFrame:
    return claims.filter((F.col("side") == side) & located(F.col("location.lat"), F.col("location.lon")))


def layer(features: DataFrame, status: str) -> DataFrame:
    return features.filter(F.col("status") == status)


def point_card(points: DataFrame, claims: DataFrame, events: DataFrame, point_id: str | None = None) -> DataFrame:
    """(id, name, kind, ordinal, record_id, summary): each point with its claims, then its events, one row per record.

    Points without records keep one row. Records stay rows: a point may own a large share of all of them.
    """
    chosen = points if point_id is None else points.filter(F.col("id") == point_id)
    def related(records: DataFrame, kind: str) -> DataFrame:
        own = records if point_id is None else records.filter(F.col("settlement_id") == point_id)
        return own.select(F.col("settlement_id").alias("_point"), F.lit(kind).alias("kind"), "ordinal", F.col("id").alias("record_id"), "summary")
    records = related(claims, "claim").unionByName(related(events, "event"))
    return chosen.select("id", "name").join(records, F.col("id") == F.col("_point"), "left").drop("_point")


def point_card_counts(points: DataFrame, claims: DataFrame, events: DataFrame) -> DataFrame:
    """How many claims and events each point has (counts combine before the shuffle, so a hot point is harmless)."""
    count = lambda df, name: df.groupBy(F.col("settlement_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    joined = points.select("id").join(count(claims, "claim_count"), "id", "left").join(count(events, "event_count"), "id", "left")
    return joined.na.fill(0, ["claim_count", "event_count"])


def change_badge(changes: DataFrame, events: DataFrame) -> DataFrame:
    """Number of changes, or of verified point events when there are none."""
    points = events.agg(F.count_if((F.col("event_kind") == vocab.POINT_EVENT_KIND) & F.col("verification_status").isin(*vocab.VERIFIED)).alias("_m"))
    counted = changes.agg(F.count(F.lit(1)).alias("_n"))
    return counted.join(F.broadcast(points)).select(F.coalesce(F.nullif("_n", F.lit(0)), "_m").alias("badge"))  # one row each


def dashboard_status(status: DataFrame, points: DataFrame, events: DataFrame, claims: DataFrame, now: Column,
                     snapshot_features: DataFrame | None = None, reference_features: DataFrame | None = None) -> DataFrame:
    """One row: freshness, display date, counters and which layer to offer for download."""
    seen = events.agg(
        F.count_if(F.col("verification_status").isin(*vocab.VERIFIED)).alias("verified_count"),
        F.count_if(F.col("verification_status").isin(*vocab.DISPUTED)).alias("_disputed_events"),
        F.coalesce(F.bool_or(F.col("verification_status").isin(*vocab.VERIFIED) & F.col("location").isNotNull()), F.lit(False)).alias("has_points"))
    claimed = claims.agg(F.count_if(F.col("verification_status").isin(*vocab.DISPUTED)).alias("_disputed_claims"))
    named = points.agg(F.count(F.lit(1)).alias("_rows"))
    def any_row(df: DataFrame | None, name: str) -> DataFrame:
        base = df if df is not None else events.limit(0)
        return base.agg((F.count(F.lit(1)) > 0).alias(name))
    one = single_row(status)
    for row in (seen, claimed, named, any_row(snapshot_features, "has_snapshot"), any_row(reference_features, "has_reference")):
        one = one.join(F.broadcast(row))  # one row each
    return one.select(
        freshness(F.col("published_at"), F.col("point_feed_published_at"), now, vocab.STALE_HOURS).alias("freshness"),
        F.coalesce("snapshot_date", "point_feed_date").alias("display_date"),
        F.substring("snapshot_sha256", 1, 12).alias("version"), F.coalesce("new_settlements", "_rows").alias("point_count"),
        "verified_count", (F.col("_disputed_events") + F.col("_disputed_claims")).alias("disputed_count"),
        (~(F.col("has_snapshot") | F.col("has_reference") | F.col("has_points"))).alias("map_empty"),
        F.when(F.col("has_snapshot"), "snapshot").when(F.col("has_reference"), "reference").otherwise("points").alias("download_layer"))


def newest_audit(audit: DataFrame, limit: int = 20) -> DataFrame:
    return audit.orderBy(F.desc("seq")).limit(limit)
