"""Vocabularies, thresholds and labels. All of them are defaults of function parameters."""

from __future__ import annotations

# Fixed values shared with existing published data.
STATUSES = ("control_ru", "control_ua", "contested", "unknown")
EVENT_STATUSES = ("claim", "disputed", "probable", "confirmed", "corrected", "withdrawn")
VERIFIED = ("confirmed", "probable", "corrected")
DISPUTED = ("claim", "disputed")
UNVERIFIED = ("claim", "disputed", "withdrawn")
SIDES = ("russian", "ukrainian", "independent", "multiple")
EVIDENCE_TYPES = (
    "official_statement", "geolocated_media", "satellite", "licensed_map", "local_authority", "news_report",
)
MODERATION_STATES = ("not_published", "approved", "published")
FEATURE_PROPERTIES = (
    "id", "status", "name", "valid_from", "confidence", "evidence_ids", "source_ids", "moderation",
)
SOURCE_FIELDS = ("id", "name", "role", "url", "side", "kind", "usage_note", "license_status")
EVIDENCE_FIELDS = ("id", "source_id", "published_at", "url", "evidence_type")
EVENT_TEXT_FIELDS = ("id", "title", "summary", "event_date", "verification_status")
EVENT_ARRAY_FIELDS = ("source_ids", "evidence_ids")
POINT_EVENT_KIND = "territorial_update"

MIN_PART_KM2 = 0.001
MIN_OVERLAP_KM2 = 0.001
MAX_FEATURE_KM2 = 150_000
MIN_CONFIDENCE = 0.93
DELAY_HOURS = 24
STALE_HOURS = 72
PERIOD_DAYS = {"day": 1, "week": 7, "month": 30}

# Texts of published records and labels.
CHANGE_NAME = "Изменение территориального статуса"
STATUS_LABELS = {
    "control_ru": "контроль российских сил",
    "control_ua": "контроль украинских сил",
    "contested": "оспариваемая зона",
    "unknown": "неопределённый статус",
}
EVENT_STATUS_LABELS = {
    "ru": {"confirmed": "Подтверждено", "probable": "Оценка одного OSINT-источника", "corrected": "Уточнено"},
    "uk": {"confirmed": "Підтверджено", "probable": "Оцінка одного OSINT-джерела", "corrected": "Уточнено"},
    "en": {"confirmed": "Confirmed", "probable": "Single-source OSINT assessment", "corrected": "Corrected"},
}
NO_STATUS_LABEL = "без опубликованного статуса"
PUBLICATION_WARNING = (
    "Аналитическая оценка по открытым источникам. Не используйте для решений, связанных с безопасностью."
)
