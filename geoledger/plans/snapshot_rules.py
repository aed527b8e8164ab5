"""Fail-closed rules of a snapshot: (ctx, idx, rule, message) rows; a snapshot is accepted when there are none.

Input is the document table of ``sources.geojson.read_snapshot``; per-feature rules also run on any feature table
with the same columns, so a whole archive can be judged at once (ctx tells snapshots apart and is never NULL).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger import vocab
from geoledger.functions.values import absent, age_hours, is_date_time, is_uri, zoned_timestamp
from geoledger.operators.edges import feature_area_km2
from geoledger.operators.merges import later_occurrences, unknown_members
from geoledger.operators.validity import bounds, invalid_features, overlapping_pairs
from geoledger.session import cut
from geoledger.sources.geojson import Collection, feature_rows


def _at(df: DataFrame, rule: str, message: Column) -> DataFrame:
    return df.select("ctx", F.col("idx").cast("bigint").alias("idx"), F.lit(rule).alias("rule"), message.alias("message"))


def _feature_count(documents: DataFrame) -> str:
    return "feature_count" if "feature_count" in documents.columns else "size(features)"


def document_rules(documents: DataFrame) -> DataFrame:
    """V-S1 to V-S3."""
    docs = documents.withColumn("idx", F.lit(None).cast("bigint")).withColumn("ctx", F.col("document"))
    broken = docs.filter("_corrupt IS NOT NULL")
    readable = docs.filter("_corrupt IS NULL")
    return reduce(DataFrame.unionByName, [
        _at(broken, "V-S1", F.lit("cannot read snapshot")),
        _at(readable.filter("coalesce(type, '') <> 'FeatureCollection'"), "V-S2", F.lit("root.type must be FeatureCollection")),
        _at(readable.filter(f"{_feature_count(documents)} > 0 AND coalesce(metadata.snapshot_date, '') = ''"), "V-S3",
            F.lit("metadata.snapshot_date is required for non-empty snapshots")),
    ])


def property_rules(features: DataFrame, now: Column, delay_hours: int = vocab.DELAY_HOURS,
                   statuses: tuple[str, ...] = vocab.STATUSES, min_confidence: float = vocab.MIN_CONFIDENCE) -> DataFrame:
    """Rules that need one row only (V-S4, V-S5, V-S7 to V-S10, V-S12 to V-S15), in one pass."""
    present = F.coalesce(F.json_object_keys("properties_text"), F.array().cast("array<string>"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(p) for p in vocab.FEATURE_PROPERTIES]), present))
    confidence = F.col("confidence")
    in_range = F.coalesce(confidence.between(0, 1), F.lit(False))
    evidence = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    moment = zoned_timestamp(F.col("valid_from"))
    age = age_hours(now, moment)
    approved = (F.coalesce(F.col("moderation.decision") == "approved", F.lit(False))
                & ~absent(F.col("moderation.reviewer")) & ~absent(F.col("moderation.reviewed_at")))
    checks = [
        ("V-S4", F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))),
        ("V-S5", absent(F.col("id")), F.lit("id must not be empty")),
        ("V-S7", ~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), F.lit("invalid status")),
        ("V-S8", ~in_range, F.lit("confidence must be between 0 and 1")),
        ("V-S9", in_range & (confidence < min_confidence), F.lit(f"confidence below publication threshold {min_confidence}")),
        ("V-S10", F.size(evidence) == 0, F.lit("evidence bundle is empty")),
        ("V-S10", F.size(F.array_distinct(evidence)) < F.size(evidence), F.lit("duplicate evidence ids")),
        ("V-S12", F.coalesce(F.size("source_ids"), F.lit(0)) <= 0, F.lit("source ids are empty")),
        ("V-S13", ~approved, F.lit("explicit moderation approval, reviewer and reviewed_at required")),
        ("V-S14", moment.isNull(), F.lit("valid_from must be timezone-aware ISO-8601")),
        ("V-S14", F.coalesce(age < delay_hours, F.lit(False)),
         F.format_string(f"public delay is %.1fh, minimum is {delay_hours}h", age)),
        ("V-S15", ~F.coalesce(F.col("geometry_type").isin("Polygon", "MultiPolygon"), F.lit(False)),
         F.lit("Polygon or MultiPolygon geometry required")),
        ("V-S19", F.coalesce(F.col("geometry_type").isin("Polygon", "MultiPolygon"), F.lit(False)) & F.col("geometry").isNull(),
         F.lit("unreadable geometry")),
    ]
    hits = F.array_compact(F.array(*[
        F.when(bad, F.struct(F.lit(rule).alias("rule"), text.alias("message"))) for rule, bad, text in checks]))
    return features.select("ctx", F.col("idx").cast("bigint").alias("idx"), F.explode(hits).alias("v")).select("ctx", "idx", "v.*")


def reference_rules(features: DataFrame, known_evidence: DataFrame | None, known_sources: DataFrame | None) -> DataFrame:
    """V-S6, V-S11 and V-S12; a registry that is not given is not checked."""
    repeated = later_occurrences(features.select("ctx", "idx", F.coalesce("id", F.lit("")).alias("id"))
                                 .withColumn("_k", F.struct("ctx", "id")), "_k", "idx")
    out = _at(repeated, "V-S6", F.concat(F.lit("duplicate id "), "id"))
    for rule, column, known, what in (("V-S11", "evidence_ids", known_evidence, "evidence"),
                                      ("V-S12", "source_ids", known_sources, "source")):
        if known is not None:
            unknown = unknown_members(features, ["ctx", "idx"], column, known)
            out = out.unionByName(_at(unknown, rule, F.concat(F.lit(f"unknown {what} ids "), F.array_join("unknown", ", "))))
    return out


def geometry_rules(features: DataFrame, max_area_km2: float = vocab.MAX_FEATURE_KM2,
                   min_overlap_km2: float = vocab.MIN_OVERLAP_KM2) -> DataFrame:
    """V-S16 to V-S18 and V-S20. Features are told apart by idx; invalid ones are left out of the pair test."""
    shapes = cut(features.filter("geometry IS NOT NULL").select("ctx", "idx", F.col("idx").cast("string").alias("id"), "geometry"))
    invalid = cut(invalid_features(shapes))
    with_idx = lambda df: df.withColumn("idx", F.col("id").cast("bigint"))
    empty = shapes.filter("size(flatten(flatten(geometry))) = 0")
    reasons = invalid.groupBy("ctx", "id").agg(F.array_join(F.sort_array(F.collect_set("reason")), ", ").alias("reasons"))
    outside = bounds(shapes).filter("minx < -180 OR maxx > 180 OR miny < -90 OR maxy > 90")
    areas = feature_area_km2(shapes, ["ctx", "id"])
    sound = shapes.join(invalid.select("ctx", "id").distinct(), ["ctx", "id"], "left_anti")
    clash = overlapping_pairs(sound.select("ctx", F.format_string("%018d", "idx").alias("id"), "geometry"), min_overlap_km2)
    return reduce(DataFrame.unionByName, [
        _at(empty, "V-S16", F.lit("geometry is empty")),
        _at(with_idx(reasons), "V-S16", F.concat(F.lit("invalid geometry: "), "reasons")),
        _at(with_idx(outside), "V-S17", F.lit("coordinates outside WGS84 bounds")),
        _at(with_idx(areas.filter("area_km2 <= 0")), "V-S18", F.lit("geometry has zero area")),
        _at(with_idx(areas.filter(F.col("area_km2") > max_area_km2)), "V-S18", F.format_string("anomalous area %.1f km²", "area_km2")),
        _at(clash.withColumn("idx", F.col("left_id").cast("bigint")), "V-S20",
            F.format_string("overlaps feature[%d] by %.3f km²", F.col("right_id").cast("bigint"), "overlap_km2")),
    ])


def validate_features(features: DataFrame, now: Column, known_evidence: DataFrame | None = None,
                      known_sources: DataFrame | None = None, delay_hours: int = vocab.DELAY_HOURS,
                      max_area_km2: float = vocab.MAX_FEATURE_KM2) -> DataFrame:
    return property_rules(features, now, delay_hours).unionByName(
        reference_rules(features, known_evidence, known_sources)).unionByName(geometry_rules(features, max_area_km2))


def validate_snapshot(documents: DataFrame, now: Column, known_evidence: DataFrame | None = None,
                      known_sources: DataFrame | None = None, delay_hours: int = vocab.DELAY_HOURS,
                      max_area_km2: float = vocab.MAX_FEATURE_KM2) -> DataFrame:
    """All snapshot rules over documents as read (ctx = file); order by ctx, idx, rule for a report."""
    features = cut(feature_rows(documents.filter("_corrupt IS NULL")).withColumn("ctx", F.col("document")))
    return document_rules(documents).unionByName(
        validate_features(features, now, known_evidence, known_sources, delay_hours, max_area_km2))


def validate_collection(collection: Collection, now: Column, known_evidence: DataFrame | None = None,
                        known_sources: DataFrame | None = None, delay_hours: int = vocab.DELAY_HOURS,
                        max_area_km2: float = vocab.MAX_FEATURE_KM2) -> DataFrame:
    """``validate_snapshot`` of snapshots that many tasks have read."""
    features = cut(collection.features.withColumn("ctx", F.col("document")))
    return document_rules(collection.documents).unionByName(
        validate_features(features, now, known_evidence, known_sources, delay_hours, max_area_km2))


def schema_violations(features: DataFrame, collection: str) -> DataFrame:
    """Published constraints of snapshot features (V-J1), ordered by path when reported: (collection, path, message)."""
    path = lambda name: F.concat(F.lit("features."), F.col("idx").cast("string"), F.lit(f".properties.{name}"))
    bad = []
    for name in ("id", "name", "valid_from"):
        bad.append((name, absent(F.col(name)), f"{name} is required and must not be empty"))
    bad += [
        ("status", ~F.coalesce(F.col("status").isin(*vocab.STATUSES), F.lit(False)), "status is not one of the allowed values"),
        ("valid_from", F.col("valid_from").isNotNull() & zoned_timestamp(F.col("valid_from")).isNull(), "valid_from is not a date-time"),
        ("confidence", ~F.coalesce(F.col("confidence").between(vocab.MIN_CONFIDENCE, 1), F.lit(False)), "confidence is outside its range"),
    ]
    for name in ("evidence_ids", "source_ids"):
        bad.append((name, F.coalesce(F.size(name), F.lit(0)) < 1, f"{name} has too few items"))
        bad.append((name, F.size(F.array_distinct(name)) < F.size(name), f"{name} has repeated items"))
    for name in ("decision", "reviewer", "reviewed_at", "rationale"):
        bad.append((f"moderation.{name}", absent(F.col(f"moderation.{name}")), f"{name} is required and must not be empty"))
    bad.append(("moderation.decision", F.coalesce(F.col("moderation.decision") != "approved", F.lit(False)), "decision must be approved"))
    hits = F.array_compact(F.array(*[
        F.when(F.coalesce(test, F.lit(False)), F.struct(path(name).alias("path"), F.lit(text).alias("message")))
        for name, test, text in bad]))
    return features.select(F.lit(collection).alias("collection"), F.explode(hits).alias("v")).select("collection", "v.*")


def evidence_schema_violations(evidence: DataFrame) -> DataFrame:
    """Published constraints of evidence rows (V-J1)."""
    names = (*vocab.EVIDENCE_FIELDS, "independence_group")
    hits = [F.when(absent(F.col(n)), F.struct(F.lit(n).alias("field"), F.lit("required").alias("message"))) for n in names]
    hits.append(F.when(F.col("verification_note").isNull(), F.struct(F.lit("verification_note").alias("field"), F.lit("required").alias("message"))))
    hits.append(F.when(~absent(F.col("evidence_type")) & ~F.col("evidence_type").isin(*vocab.EVIDENCE_TYPES),
                       F.struct(F.lit("evidence_type").alias("field"), F.lit("not allowed").alias("message"))))
    for field, sound, message in (("published_at", is_date_time, "not a date-time"), ("url", is_uri, "not a uri")):
        hits.append(F.when(~absent(F.col(field)) & ~sound(F.col(field)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))))
    return evidence.select("ordinal", F.explode(F.array_compact(F.array(*hits))).alias("v")).select("ordinal", "v.*")


def metadata_schema_violations(documents: DataFrame) -> DataFrame:
    """Published constraints of the document head (V-J1): (document, path, message). Keys must exist even in an empty snapshot."""
    state = F.col("metadata.moderation_status")
    hits = [
        F.when(F.coalesce(F.col("type") != "FeatureCollection", F.lit(True)), F.struct(F.lit("type").alias("path"), F.lit("must be FeatureCollection").alias("message"))),
        F.when(F.col("features").isNull(), F.struct(F.lit("features").alias("path"), F.lit("required").alias("message"))),
        F.when(F.col("metadata.methodology_version").isNull(), F.struct(F.lit("metadata.methodology_version").alias("path"), F.lit("required").alias("message"))),
        F.when(~F.coalesce(state.isin(*vocab.MODERATION_STATES), F.lit(False)),
               F.struct(F.lit("metadata.moderation_status").alias("path"), F.lit("not allowed").alias("message"))),
        F.when(F.col("metadata.snapshot_date").isNotNull() & F.col("metadata.snapshot_date").try_cast("date").isNull(),
               F.struct(F.lit("metadata.snapshot_date").alias("path"), F.lit("not a date").alias("message"))),
    ]
    readable = documents.filter("_corrupt IS NULL")
    return readable.select("document", F.explode(F.array_compact(F.array(*hits))).alias("v")).select("document", "v.*")


def event_schema_violations(events: DataFrame) -> DataFrame:
    """Published constraints of events and claims (V-J1): (ordinal, field, message)."""
    def hit(bad: Column, field: str, message: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))
    hits = [hit(absent(F.col(f)), f, "required and not empty") for f in ("id", "title", "summary")]
    hits += [hit(F.col(f).isNull(), f, "required") for f in ("event_date", "verification_status", *vocab.EVENT_ARRAY_FIELDS)]
    hits += [
        hit(F.col("event_date").try_cast("date").isNull() & F.col("event_date").isNotNull(), "event_date", "not a date"),
        hit(~F.col("verification_status").isin(*vocab.EVENT_STATUSES), "verification_status", "not allowed"),
    ]
    return events.select("ordinal", F.explode(F.array_compact(F.array(*hits))).alias("v")).select("ordinal", "v.*")
