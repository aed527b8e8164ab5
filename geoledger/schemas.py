"""Explicit Spark types of all tables; nothing is inferred from data."""

from __future__ import annotations

MODERATION = "struct<decision:string,reviewer:string,reviewed_at:string,rationale:string>"
MULTIPOLYGON = "array<array<array<array<double>>>>"

SNAPSHOT_DOCUMENT = (
    "type string, metadata struct<snapshot_date:string,methodology_version:string,moderation_status:string>,"
    " features array<struct<type:string,properties:string,geometry:struct<type:string,coordinates:string>>>,"
    " _corrupt string"
)
FEATURE_PROPERTIES = (
    "struct<id:string,name:string,status:string,valid_from:string,confidence:double,evidence_ids:array<string>,"
    f"source_ids:array<string>,moderation:{MODERATION}>"
)
SNAPSHOT_FEATURES = (
    "snapshot_date string, idx bigint, id string, name string, status string, valid_from string, confidence double,"
    f" evidence_ids array<string>, source_ids array<string>, moderation {MODERATION}, geometry {MULTIPOLYGON}"
)
CHANGES = (
    "id string, date string, layer string, from_status string, to_status string, status string, name string, summary string,"
    " area_km2_exact double, area_km2 double, confidence double, evidence_ids array<string>, source_ids array<string>,"
    f" reviews array<{MODERATION}>, geometry {MULTIPOLYGON}"
)
SOURCES = (
    "id string, name string, role string, side string, kind string, url string, health string, health_label string,"
    " license_status string, monitor boolean, usage_note string"
)
EVIDENCE = (
    "id string, source_id string, published_at string, url string, evidence_type string, independence_group string,"
    " verification_note string"
)
EVENTS = (
    "id string, title string, title_uk string, title_en string, summary string, summary_uk string, summary_en string,"
    " event_date string, published_at string, verification_status string, event_kind string, source_ids array<string>,"
    " evidence_ids array<string>, location struct<lat:double,lon:double>, location_label string, settlement_id string,"
    " publication_note string, side string, side_label string"
)
POINTS = (
    "id string, name string, name_uk string, name_ru string, name_en string, aliases array<string>, admin1 string,"
    " lat double, lon double, status string, source_id string"
)
MANIFEST = (
    "date string, published_at timestamp, area_change_km2 double, change_count bigint, settlement_count bigint, sha256 string"
)
AUDIT = "action string, snapshot_date string, published_at timestamp, sha256 string, reviewers array<string>"
STATUS = (
    "state string, snapshot_date string, published_at timestamp, area_change_km2 double, new_settlements bigint,"
    " methodology_version string, snapshot_sha256 string, public_delay_hours int, warning string,"
    " point_feed_date string, point_feed_published_at timestamp, point_feed_updated_at timestamp, point_update_count bigint"
)
DOCUMENTS = (
    "id string, source_id string, title string, url string, published_at_raw string, fetched_at timestamp, review_status string"
)
HEALTH = "source_id string, state string, http_status int, checked_at timestamp, error string"
