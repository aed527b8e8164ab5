"""Codes to labels and choice of localised columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoledger import vocab


def labelled(code: Column, labels: dict[str, str], missing: str | None = None) -> Column:
    """Label of a code; unknown codes pass through, NULL becomes ``missing``."""
    pairs = [F.lit(v) for item in labels.items() for v in item]
    known = F.try_element_at(F.create_map(*pairs), F.coalesce(code, F.lit(""))) if pairs else F.lit(None)
    return F.coalesce(known, code, F.lit(missing))


def first_filled(*columns: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def localised_name(language: str, fallback: str = "Без названия") -> Column:
    order = [f"name_{language}", "name", "name_uk", "name_ru", "name_en"]
    return first_filled(*[F.col(c) for c in order], F.lit(fallback))


def localised_text(field: str, language: str) -> Column:
    """``title_<lang>`` or ``summary_<lang>`` with the plain column as fallback."""
    return first_filled(F.col(f"{field}_{language}"), F.col(field))


def event_status_label(status: Column, language: str = "ru", labels: dict[str, dict[str, str]] = vocab.EVENT_STATUS_LABELS) -> Column:
    """The label of a verification status in a language; a status without one is shown as it is."""
    return labelled(status, labels.get(language, {}))
