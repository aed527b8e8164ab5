"""Delayed point events from message pages, and their merge into the public tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger import schemas, vocab
from geoledger.functions.text import after_marker, before_stops, collapse_space, filled, plain_text, strip_chars
from geoledger.functions.values import own_date, released, short_digest, zoned_timestamp
from geoledger.operators.merges import alias_set, keyed_merge, replace_source, single_row

# Coordinates (six decimals) whose place names are known.
KNOWN_PLACES = (
    ("48.462732", "37.739539", "Іванопілля", "Иванополье", "Ivanopillia", "Донецька область"),
    ("48.424085", "37.229447", "Дорожнє", "Дорожное", "Dorozhnie", "Донецька область"),
)


@dataclass(frozen=True)
class FeedProfile:
    """Where messages come from and how their texts read. Channel, map host and ids belong to the feed."""

    source_id: str
    channel: str
    map_host: str
    id_prefix: str
    feed_name: str
    independence_group: str
    post_base: str = "https://t.me/"
    # Markup and wording of the message pages.
    chunk_start: str = '<div class="tgme_widget_message_wrap'
    marker: str = "Мапу оновлено"
    stops: tuple[str, ...] = ("💬", "У випадку неточностей", "{map_host}", "Мапа 🛑")
    trim_chars: str = " .·⚔️🗺🔄"
    default_label: str = "Участок обновления"
    default_summary: str = "{feed_name} опубликовал геолокированное обновление карты."
    admin1_default: str = "Україна"
    evidence_type: str = "licensed_map"
    verification_status: str = "probable"
    texts: dict = field(default_factory=lambda: {
        "title": "Геолокированное обновление: {ru}",
        "title_uk": "Геолоковане оновлення: {uk}",
        "title_en": "Geolocated map update: {en}",
        "summary": "По оценке {feed_name}, российские силы продвинулись в районе {ru}.",
        "summary_en": "{feed_name} assesses that Russian forces advanced near {en}.",
        "publication_note": "Точка взята из прямой ссылки {feed_name}. Контур территории не публикуется и не выводится из точки.",
        "verification_note": "Публичный пост {channel} содержит прямую ссылку на {feed_name} с координатами. Опубликована только точка сообщения, без копирования полигонов или API-данных.",
    })

    def link_pattern(self) -> str:
        host = self.map_host.replace(".", r"\.")
        return (rf'(?is)<a href="https?://{host}/(?:en/)?#([\d.]+)/(-?[\d.]+)/(-?[\d.]+)"[^>]*>(.*?)</a>')


def message_chunks(pages: DataFrame, profile: FeedProfile) -> DataFrame:
    """One row per message of a page: page_id, page_pos, chunk. Text before the first message is dropped."""
    pieces = F.split("html", "(?i)" + profile.chunk_start)
    return pages.select("page_id", F.posexplode(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))).alias("page_pos", "chunk"))


def dated_messages(pages: DataFrame, profile: FeedProfile) -> DataFrame:
    """Messages that carry the marker, an id and a time. ``published`` is NULL when the time names no zone."""
    chunk = F.col("chunk")
    marked = message_chunks(pages, profile).filter(F.contains(chunk, F.lit(profile.marker)))
    found = marked.withColumns({
        "post_id": filled(F.regexp_extract(chunk, rf'(?i)data-post="{profile.channel}/(\d+)"', 1)),
        "published_text": filled(F.regexp_extract(chunk, r'(?i)<time datetime="([^"]+)"', 1)),
    }).filter("post_id IS NOT NULL AND published_text IS NOT NULL")
    return found.withColumn("published", zoned_timestamp(F.col("published_text")))


def rejected_messages(pages: DataFrame, profile: FeedProfile) -> DataFrame:
    """Messages whose time cannot be placed on the time line; kept apart so that one of them does not stop a run."""
    return dated_messages(pages, profile).filter("published IS NULL").select("page_id", "page_pos", "post_id", "published_text")


def message_summary(chunk: Column, profile: FeedProfile) -> Column:
    stops = [s.format(map_host=profile.map_host) for s in profile.stops]
    text = strip_chars(before_stops(after_marker(plain_text(chunk), profile.marker), stops), profile.trim_chars)
    return F.coalesce(filled(text), F.lit(profile.default_summary.format(feed_name=profile.feed_name)))


def extract_point_updates(pages: DataFrame, now: Column, profile: FeedProfile, delay_hours: int = vocab.DELAY_HOURS) -> DataFrame:
    """One row per coordinate link of every released message (narrow: no shuffle)."""
    return message_updates(dated_messages(pages, profile), now, profile, delay_hours)


def held_messages(messages: DataFrame, now: Column, delay_hours: int = vocab.DELAY_HOURS) -> DataFrame:
    """Messages that are still too fresh at ``now``; released and held messages together are all that have a time."""
    return messages.filter("published IS NOT NULL").filter(~released(F.col("published"), now, delay_hours))


def message_updates(dated: DataFrame, now: Column, profile: FeedProfile, delay_hours: int = vocab.DELAY_HOURS) -> DataFrame:
    """Updates of the messages (rows of ``dated_messages``) that are old enough."""
    return updates_of(dated.filter(released(F.col("published"), now, delay_hours)), profile)


def updates_of(messages: DataFrame, profile: FeedProfile) -> DataFrame:
    """Updates of messages that are to be released, whatever their age."""
    group = lambda g: F.regexp_extract_all("chunk", F.lit(profile.link_pattern()), F.lit(g))
    links = messages.select(
        "page_id", "page_pos", "post_id", "published", "published_text", "chunk",
        F.arrays_zip(group(2).alias("lat"), group(3).alias("lon"), group(4).alias("label")).alias("links"),
    ).filter(F.size("links") > 0)
    with_text = links.withColumn("summary", message_summary(F.col("chunk"), profile)).drop("chunk")
    rows = with_text.select("*", F.posexplode("links").alias("pos", "link")).drop("links")
    label = F.coalesce(filled(plain_text(F.col("link.label"))), F.lit(profile.default_label))
    return rows.select(
        F.concat(F.lit(f"{profile.id_prefix}-"), short_digest(16, F.col("post_id"), F.col("link.lat"), F.col("link.lon"))).alias("id"),
        "post_id", F.concat(F.lit(f"{profile.post_base}{profile.channel}/"), "post_id").alias("post_url"),
        F.col("published").alias("published_at"), own_date(F.col("published_text")).alias("event_date"),
        label.alias("label"), "summary", F.col("link.lat").try_cast("double").alias("lat"),
        F.col("link.lon").try_cast("double").alias("lon"), (F.col("pos") + 1).alias("sequence"), "page_id", "page_pos")


def newest_first(updates: DataFrame) -> DataFrame:
    return updates.orderBy(F.desc("published_at"), "page_id", "page_pos", "sequence")


def gazetteer(spark: SparkSession, places=KNOWN_PLACES) -> DataFrame:
    rows = spark.createDataFrame(list(places), "lat string, lon string, known_uk string, known_ru string, known_en string, known_admin1 string")
    return rows.withColumns({"lat_key": F.col("lat").cast("decimal(9,6)"), "lon_key": F.col("lon").cast("decimal(9,6)")}).drop("lat", "lon")


def named_updates(updates: DataFrame, places: DataFrame) -> DataFrame:
    """Updates with place names from the gazetteer, matched on coordinates rounded to six decimals as decimals."""
    keyed = updates.withColumns({"lat_key": F.round("lat", 6).cast("decimal(9,6)"), "lon_key": F.round("lon", 6).cast("decimal(9,6)")})
    joined = keyed.join(places, ["lat_key", "lon_key"], "left").drop("lat_key", "lon_key")
    uk = F.coalesce("known_uk", "label")
    return joined.select(
        *updates.columns, uk.alias("name_uk"), F.coalesce(F.col("known_ru"), uk).alias("name_ru"),
        F.coalesce(F.col("known_en"), uk).alias("name_en"), "known_ru", "known_en", "known_admin1")


def _template(text: str, profile: FeedProfile) -> Column:
    fixed = text.replace("{feed_name}", profile.feed_name).replace("{channel}", profile.channel)
    pieces, rest = [], fixed
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(before), F.col(f"name_{name}")]
    return F.concat(*pieces, F.lit(rest))


def utc_text(moment: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def update_events(named: DataFrame, profile: FeedProfile) -> DataFrame:
    t = {k: _template(v, profile) for k, v in profile.texts.items()}
    return named.select(
        "id", t["title"].alias("title"), t["title_uk"].alias("title_uk"), t["title_en"].alias("title_en"),
        t["summary"].alias("summary"), F.col("summary").alias("summary_uk"), t["summary_en"].alias("summary_en"),
        F.col("event_date").cast("string").alias("event_date"), utc_text(F.col("published_at")).alias("published_at"),
        F.lit(profile.verification_status).alias("verification_status"), F.lit(vocab.POINT_EVENT_KIND).alias("event_kind"),
        F.array(F.lit(profile.source_id)).alias("source_ids"), F.array(F.concat(F.lit("ev-"), "id")).alias("evidence_ids"),
        F.struct("lat", "lon").alias("location"), F.col("name_uk").alias("location_label"),
        F.concat(F.lit("settlement-"), "id").alias("settlement_id"), t["publication_note"].alias("publication_note"))


def update_evidence(named: DataFrame, profile: FeedProfile) -> DataFrame:
    return named.select(
        F.concat(F.lit("ev-"), "id").alias("id"), F.lit(profile.source_id).alias("source_id"),
        utc_text(F.col("published_at")).alias("published_at"), F.col("post_url").alias("url"),
        F.lit(profile.evidence_type).alias("evidence_type"), F.lit(profile.independence_group).alias("independence_group"),
        F.lit(profile.texts["verification_note"].replace("{feed_name}", profile.feed_name).replace("{channel}", profile.channel)).alias("verification_note"))


def update_points(named: DataFrame, profile: FeedProfile) -> DataFrame:
    return named.select(
        F.concat(F.lit("settlement-"), "id").alias("id"), F.col("name_ru").alias("name"), "name_uk", "name_ru", "name_en",
        alias_set(F.col("label"), F.col("name_uk"), F.col("known_ru"), F.col("known_en")).alias("aliases"),
        F.coalesce("known_admin1", F.lit(profile.admin1_default)).alias("admin1"), "lat", "lon",
        F.lit("unknown").alias("status"), F.lit(profile.source_id).alias("source_id"),
        F.struct("published_at", "page_id", "page_pos", "sequence").alias("_order"))


@dataclass
class MergedTables:
    events: DataFrame
    evidence: DataFrame
    points: DataFrame
    status: DataFrame


def latest_per_id(updates: DataFrame) -> DataFrame:
    """One update per id: a coordinate named twice in a message is one event."""
    whole = F.struct(*updates.columns)
    order = F.struct("published_at", "page_id", "page_pos", "sequence")
    return updates.groupBy("id").agg(F.max_by(whole, order).alias("_u")).select("_u.*")


def merge_point_updates(updates: DataFrame, events: DataFrame, evidence: DataFrame, points: DataFrame, status: DataFrame,
                        places: DataFrame, profile: FeedProfile, now: Column) -> MergedTables:
    """Full refresh of this source's rows in events, evidence and points, and the status record that follows."""
    named = named_updates(latest_per_id(updates), places)
    new_events = replace_source(events, update_events(named, profile), profile.source_id, "source_ids")
    new_evidence = replace_source(evidence, update_evidence(named, profile), profile.source_id)
    fresh = update_points(named, profile)
    others = points.filter(F.coalesce(F.col("source_id") != profile.source_id, F.lit(True)))
    nothing = F.lit(None).cast(fresh.schema["_order"].dataType)
    merged = keyed_merge(others.withColumn("_order", nothing), fresh, "id", "_order").drop("batch", "_order")
    return MergedTables(
        events=new_events, evidence=new_evidence, points=merged,
        status=point_feed_status(new_events, status, now))


def event_order() -> list[Column]:
    return [F.desc(F.coalesce("published_at", "event_date", F.lit(""))), F.desc("id")]


def in_publishing_order(tables: MergedTables) -> MergedTables:
    """The tables as they are published: events and evidence newest first, points by name. Sorted writing keeps the order
    over the files of a table."""
    return MergedTables(
        events=tables.events.orderBy(*event_order()),
        evidence=tables.evidence.orderBy(F.desc(F.coalesce("published_at", F.lit(""))), F.desc("id")),
        points=tables.points.orderBy(F.coalesce("name", F.lit("")), "id"), status=tables.status)


def point_feed_status(events: DataFrame, status: DataFrame, now: Column) -> DataFrame:
    """Status record with the point-feed block renewed; all other keys stay."""
    is_point = ((F.col("event_kind") == vocab.POINT_EVENT_KIND) & F.col("location.lat").isNotNull() & F.col("location.lon").isNotNull())
    key = F.struct(F.coalesce("published_at", "event_date", F.lit("")).alias("t"), F.col("id"))
    facts = events.agg(
        F.max_by(F.struct("event_date", "published_at"), key).alias("_latest"), F.count(F.lit(1)).alias("_events"),
        F.count_if(is_point).alias("_points"),
        F.count_distinct(F.when(is_point, F.coalesce("location_label", F.lit("\u0000")))).alias("_labels"))
    old = single_row(status)
    merged = facts.join(old, F.lit(True), "left")
    own = ("state", "point_feed_date", "point_feed_published_at", "point_feed_updated_at", "point_update_count", "new_settlements")
    keep = [c for c in status.columns if c not in own]
    return merged.select(
        *keep,
        F.when(F.col("_events") > 0, "point_updates_live").otherwise(F.coalesce("state", F.lit("awaiting_first_snapshot"))).alias("state"),
        F.col("_latest.event_date").alias("point_feed_date"),
        F.col("_latest.published_at").cast("timestamp").alias("point_feed_published_at"), now.alias("point_feed_updated_at"),
        F.col("_points").alias("point_update_count"), F.col("_labels").alias("new_settlements"))
