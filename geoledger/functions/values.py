"""Ids, times, URLs and presence tests as column expressions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONED_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:?\d{2})?(:?\d{2}([.,]\d+)?)?\s*(Z|z|[+-]\d{2}(:?\d{2})?(:?\d{2})?)$"


def short_digest(length: int, *parts: Column) -> Column:
    """First characters of the SHA-256 of the parts joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def utc(moment: datetime) -> Column:
    """Timestamp literal; a naive ``datetime`` is read as UTC."""
    aware = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    micros = int((aware - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)
    return F.timestamp_micros(F.lit(micros))


def zoned_timestamp(text: Column) -> Column:
    """Timestamp of an ISO text that names its zone, else NULL."""
    return F.when(F.rlike(text, F.lit(ZONED_ISO)), F.try_to_timestamp(text))


def age_hours(now: Column, moment: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(moment)) / F.lit(3.6e9)


def released(published: Column, now: Column, delay_hours: int) -> Column:
    """Delay gate: published at least ``delay_hours`` before ``now`` (the exact moment passes)."""
    return published <= now - F.make_dt_interval(F.lit(0), F.lit(delay_hours))


def own_date(text: Column) -> Column:
    """Calendar date in the offset the text itself names."""
    return F.to_date(F.substring(text, 1, 10))


def https_with_host(url: Column) -> Column:
    """HTTPS scheme and a non-empty host part; what the host or the path look like does not matter."""
    return F.rlike(F.coalesce(url, F.lit("")), F.lit(r"^[\x00-\x20]*(?i)https://[^/?#]"))


def is_date_time(text: Column) -> Column:
    """Date, time with seconds and zone in the form that schemas call date-time, and a moment that exists."""
    form = F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"))
    return F.coalesce(form & F.try_to_timestamp(F.upper(text)).isNotNull(), F.lit(False))


def is_uri(text: Column) -> Column:
    """A scheme, and behind it only characters that an address may hold."""
    return F.coalesce(F.rlike(text, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:([!#$&-;=?-\[\]_a-z~]|%[0-9A-Fa-f]{2})*$")), F.lit(False))


def absent(column: Column) -> Column:
    """NULL or empty text."""
    return F.coalesce(column.cast("string"), F.lit("")) == ""


def freshness(snapshot_published: Column, feed_published: Column, now: Column, stale_hours: int = 72) -> Column:
    """``empty`` without any date, ``stale`` beyond the limit, else ``current``; the snapshot's date comes first."""
    reference = F.coalesce(snapshot_published, feed_published)
    return F.when(reference.isNull(), "empty").when(age_hours(now, reference) > stale_hours, "stale").otherwise("current")


def probe_state(http_status: Column, error_class: Column) -> Column:
    """``unavailable`` for network errors, ``ok`` for codes 200 to 399, else ``degraded``."""
    return (F.when(error_class.isNotNull() & http_status.isNull(), "unavailable")
            .when(error_class.isNull() & (http_status >= 200) & (http_status < 400), "ok").otherwise("degraded"))


def located(lat: Column, lon: Column) -> Column:
    """Both coordinates are finite numbers once cast; NULL is not located."""
    def finite(c: Column) -> Column:
        number = c.try_cast("double")
        return F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))
    return finite(lat) & finite(lon)
