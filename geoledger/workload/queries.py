"""Registered queries: every operator of the library over the given tables."""

from __future__ import annotations

import uuid
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoledger import vocab
from geoledger.functions import text as T
from geoledger.functions import values as V
from geoledger.functions.labels import event_status_label, labelled, localised_name, localised_text
from geoledger.operators import grams as G
from geoledger.operators import merges as M
from geoledger.operators.edges import boundary_area, edge_table, feature_area_km2
from geoledger.operators.overlay import boundary_of, common_boundary, prepared
from geoledger.operators.validity import bounds, invalid_features, overlapping_pairs
from geoledger.plans import diff as D
from geoledger.plans import intake, messages, readside, registry_rules, snapshot_rules
from geoledger.plans.publish import audit_row, publish
from geoledger.session import checkpoint_folder, cut
from geoledger.sources import archive, geojson
from geoledger.sources.tables import read_json_table
from geoledger.workload.standins import load, rect_features, standin

NOW = datetime(2024, 1, 20)
RULES_NOW = datetime(2024, 1, 10, 10)
ANCHOR = date(2001, 8, 1)
PROFILE = messages.FeedProfile(
    source_id="feed-map", channel="ChannelUA", map_host="map.example", id_prefix="feed", feed_name="FeedMap", independence_group="feed")

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- registry rules -------------------------------------------------------------------------------------------------

@query
def evidence_unknown_source(spark, sf):
    evidence, sources = standin(spark, sf, "evidence"), standin(spark, sf, "sources")
    unknown = M.unknown_members(evidence.withColumn("members", F.array("source_id")), ["ordinal", "id"], "members", sources)
    return unknown.select(F.explode("unknown").alias("source_id")).groupBy("source_id").agg(F.count(F.lit(1)).alias("evidence_rows"))


@query
def source_rules(spark, sf):
    return registry_rules.source_rules(standin(spark, sf, "sources"))


@query
def evidence_rules(spark, sf):
    return registry_rules.evidence_rules(standin(spark, sf, "evidence"), standin(spark, sf, "sources"))


@query
def event_rules(spark, sf):
    return registry_rules.event_rules(standin(spark, sf, "events"), "events", standin(spark, sf, "sources"), standin(spark, sf, "evidence"))


@query
def claim_rules(spark, sf):
    return registry_rules.event_rules(standin(spark, sf, "claims"), "claims", standin(spark, sf, "sources"), standin(spark, sf, "evidence"))


@query
def manifest_rules(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"), F.to_date("o_orderdate").alias("date"))
    return registry_rules.manifest_rules(rows)


@query
def registry_rule_counts(spark, sf):
    manifest = load(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"), F.to_date("o_orderdate").alias("date"))
    found = registry_rules.validate_registry(*[standin(spark, sf, n) for n in ("sources", "evidence", "events", "claims")], manifest)
    return found.groupBy("collection", "rule").agg(F.count(F.lit(1)).alias("violations"))


@query
def evidence_schema(spark, sf):
    return snapshot_rules.evidence_schema_violations(standin(spark, sf, "evidence")).groupBy("field", "message").agg(
        F.count(F.lit(1)).alias("violations"))


@query
def event_schema(spark, sf):
    return snapshot_rules.event_schema_violations(standin(spark, sf, "events"))


@query
def duplicate_evidence_ids(spark, sf):
    return M.duplicates(standin(spark, sf, "evidence"), "id")


@query
def later_evidence(spark, sf):
    return M.later_occurrences(standin(spark, sf, "evidence"), "id", "ordinal").groupBy("id").agg(F.count(F.lit(1)).alias("later_rows"))


# --- snapshot rules -------------------------------------------------------------------------------------------------

def _features(spark, sf):
    f = standin(spark, sf, "features")
    moderation = F.struct("decision", "reviewer", F.lit("2024-01-02T00:00:00Z").alias("reviewed_at"), F.lit("seen").alias("rationale"))
    f = f.withColumn("moderation", moderation).drop("decision", "reviewer")
    props = F.to_json(F.struct("id", "status", "name", "valid_from", "confidence", "evidence_ids", "source_ids", "moderation"))
    return f.withColumns({"properties_text": props, "ctx": F.lit("2024-01-10"), "geometry_type": F.lit("Polygon"),
                          "geometry": F.expr("array(array(array(array(0.0D, 0.0D))))")})


@query
def snapshot_property_rules(spark, sf):
    return snapshot_rules.property_rules(_features(spark, sf), V.utc(RULES_NOW)).select("idx", "rule", "message")


@query
def snapshot_reference_rules(spark, sf):
    return snapshot_rules.reference_rules(_features(spark, sf), standin(spark, sf, "evidence"), standin(spark, sf, "sources")).select("idx", "rule", "message")


@query
def snapshot_schema(spark, sf):
    return snapshot_rules.schema_violations(_features(spark, sf), "snapshot").select("path", "message")


@query
def snapshot_documents(spark, sf):
    """Feature rows of GeoJSON documents of up to eight features, parsed from text."""
    docs = standin(spark, sf, "features").join(load(spark, sf, "part").select(F.col("p_partkey").alias("idx"), "p_brand", "p_size"), "idx")
    text = F.to_json(F.struct(
        F.struct("id", "name", "status", "confidence", "evidence_ids").alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.expr("array(array(array(0.0D, 0.0D), array(CAST(p_size AS double), 0.0D), array(0.0D, 1.0D), array(0.0D, 0.0D)))").alias("coordinates")).alias("geometry")))
    schema = "type string, properties string, geometry struct<type:string,coordinates:string>"
    number = F.floor(F.col("idx") / 8)
    parsed = docs.groupBy(number.alias("n")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", text.alias("t")))), lambda x: F.from_json(x["t"], schema)).alias("features")).select(
        "features", F.struct(F.concat(F.lit("d-"), F.col("n") % 25).alias("snapshot_date")).alias("metadata"))
    rows = geojson.feature_rows(parsed)
    return rows.groupBy("snapshot_date").agg(
        F.sum("idx").cast("bigint").alias("positions"), F.countDistinct("idx").alias("places"),
        F.count(F.lit(1)).alias("features"), F.count("confidence").alias("with_confidence"),
        F.sum(F.size("evidence_ids")).cast("bigint").alias("evidence"), F.sum(F.expr("geometry[0][0][1][0]")).alias("widths"))


def _folder(spark):
    return f"{checkpoint_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _write_ordered(rows, file, order, head, text, tail, path):
    """One JSON text for each value of ``file``, its rows in their order. Head and tail stand in the first and the last row: rows that a
    union adds need not come to the same task, and so file, as the others."""
    place = Window.partitionBy(file).orderBy(*order)
    number, last = F.row_number().over(place), F.lead(F.lit(True)).over(place).isNull()
    value = F.concat(F.when(number == 1, head).otherwise(F.lit(",")), text, F.when(last, tail).otherwise(F.lit("")))
    rows.select(file, number.alias("n"), value.alias("value")).sortWithinPartitions(file, "n").select(file, "value").write.partitionBy(file).text(path)


def _written_collections(spark, sf):
    """The features as 25 GeoJSON files, written below the shared folder; some heads and one file are faulty."""
    f = standin(spark, sf, "features").withColumn("doc", F.pmod("idx", F.lit(25)).cast("int"))
    side = (F.col("idx") % 97).cast("double")
    shape = F.when(F.col("idx") % 19 == 0, F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.lit(1.0), F.lit(2.0)).alias("coordinates")))).otherwise(
        F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*[F.array(F.lit(x) * side, F.lit(y) * side) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0))])).alias("coordinates"))))
    props = F.to_json(F.struct("id", F.concat(F.lit('{"}['), "name").alias("name"), "status", "valid_from", "confidence", "evidence_ids", "source_ids"))
    text = F.concat(F.lit('{"type": "Feature",\n "properties": '), props, F.lit(', "geometry": '), shape, F.lit("}"))
    day = F.when(F.col("doc") % 7 == 3, F.lit("null")).otherwise(F.format_string('"2024-01-%02d"', F.col("doc") + 1))
    kind = F.when(F.col("doc") % 5 == 2, F.lit("Features")).otherwise(F.lit("FeatureCollection"))
    head = F.concat(F.lit('{"metadata": {"snapshot_date": '), day, F.lit(', "note": "}, [{"}, "type": "'), kind, F.lit('", "features": [\n'))
    tail = F.when(F.col("doc") == 24, F.lit("\n]")).otherwise(F.lit("\n]}"))
    path = _folder(spark)
    _write_ordered(f, "doc", ["idx"], head, text, tail, path)
    read = geojson.read_collection(spark, path)
    doc = F.regexp_extract("document", "/doc=([0-9]+)/", 1).cast("int").alias("doc")
    return read, doc


@query
def split_snapshots(spark, sf):
    """Features of GeoJSON files that are read by many tasks, with their place in the file."""
    read, doc = _written_collections(spark, sf)
    return read.features.select(doc, "snapshot_date", "idx", "id", "name", "confidence", F.array_join("evidence_ids", ",").alias("evidence_ids"), "geometry_type",
                                F.expr("geometry[0][0][1][0]").alias("side"))


@query
def document_rules(spark, sf):
    read, doc = _written_collections(spark, sf)
    return snapshot_rules.document_rules(read.documents.withColumn("document", doc)).select(F.col("ctx").alias("doc"), "rule", "message")


@query
def metadata_schema(spark, sf):
    read, doc = _written_collections(spark, sf)
    return snapshot_rules.metadata_schema_violations(read.documents.withColumn("document", doc)).withColumnRenamed("document", "doc")


@query
def source_addresses(spark, sf):
    """Which addresses of sources and times of events have the form that the published schemas ask for."""
    urls = standin(spark, sf, "sources").select("id", V.is_uri(F.col("url")).alias("sound"))
    return urls.unionByName(standin(spark, sf, "events").select("id", V.is_date_time(F.coalesce("published_at", "event_date")).alias("sound")))


@query
def geometry_rules(spark, sf):
    """Nested shells, empty geometry, coordinates beyond the globe, large areas and overlaps of what is sound."""
    at = lambda u, v: f"array(r[0][0] + {u}D * (r[2][0] - r[0][0]), r[0][1] + {v}D * (r[2][1] - r[0][1]))"
    inner = f"array({at(0.25, 0.25)}, {at(0.75, 0.25)}, {at(0.75, 0.75)}, {at(0.25, 0.75)}, {at(0.25, 0.25)})"
    kinds = f"""CASE WHEN idx % 13 = 6 THEN slice(geometry, 1, 0) WHEN idx % 7 = 4 THEN transform(geometry[0], r -> array(array(r), array({inner})))[0]
        WHEN idx % 11 = 5 THEN transform(geometry, g -> transform(g, r -> transform(r, p -> array(p[0] + 360D, p[1])))) ELSE geometry END"""
    found = snapshot_rules.geometry_rules(_new(spark, sf).withColumn("geometry", F.expr(kinds)), max_area_km2=900)
    return found.select("idx", "rule", F.regexp_replace("message", " (by )?[0-9.]+ km².*$", "").alias("message"))


@query
def ordered_table(spark, sf):
    """Evidence from JSON arrays, by its order in the files: the first row of each id."""
    rows = standin(spark, sf, "evidence").select("ordinal", "id", "source_id", "evidence_type", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("part"))
    path = _folder(spark)
    _write_ordered(rows, "part", ["ordinal", "id"], F.lit("["), F.to_json(F.struct("id", "source_id", "evidence_type")), F.lit("\n]"), path)
    table = read_json_table(spark, path, "id string, source_id string, evidence_type string", ordinal=True)
    return M.first_match(table, "id", "ordinal").select("id", "source_id", "evidence_type")


# --- geometry -------------------------------------------------------------------------------------------------------

def _old(spark, sf):
    return rect_features(standin(spark, sf, "rects_old"))


def _new(spark, sf):
    return rect_features(standin(spark, sf, "rects_new"))


@query
def feature_area(spark, sf):
    return feature_area_km2(_new(spark, sf), ["id"]).select("id", F.round("area_km2", 3).alias("area_km2"))


@query
def feature_bounds(spark, sf):
    return bounds(_new(spark, sf)).drop("ctx")


@query
def dissolved_area_by_status(spark, sf):
    regions = D.status_regions(_new(spark, sf))
    return regions.groupBy(F.element_at(F.split("ctx", D.SEP), 2).alias("status")).agg(F.round(boundary_area(), 1).alias("area_km2"))


@query
def feature_overlaps(spark, sf):
    return overlapping_pairs(_new(spark, sf), vocab.MIN_OVERLAP_KM2).select("left_id", "right_id", F.round("overlap_km2", 2).alias("overlap_km2"))


@query
def cross_snapshot_overlap(spark, sf):
    both = [prepared(cut(edge_table(f, F.col("ctx"), F.col("id")))) for f in (_old(spark, sf), _new(spark, sf))]
    areas = common_boundary(*both).groupBy("aid", "bid").agg(F.round(boundary_area(), 2).alias("overlap_km2")).filter("overlap_km2 > 0")
    return both[1].named(both[0].named(areas, "aid", "old_id"), "bid", "new_id").select("old_id", "new_id", "overlap_km2")


@query
def gained_area_by_status(spark, sf):
    boundary = boundary_of(D.gained_areas(_old(spark, sf), _new(spark, sf)), "a AND NOT b")
    return boundary.groupBy(F.element_at(F.split("ctx", D.SEP), 2).alias("to_status")).agg(F.round(boundary_area(), 1).alias("area_km2"))


@query
def change_area_by_transition(spark, sf):
    changes = D.changed_parts(_old(spark, sf), _new(spark, sf))
    overlaps = D.origin_areas(changes)
    to = changes.areas.select("ctx", "fid", "to_status")
    return overlaps.join(to, ["ctx", "fid"]).groupBy("from_status", "to_status").agg(F.round(F.sum("overlap_km2"), 1).alias("area_km2"))


@query
def change_summary(spark, sf):
    changes = D.changed_parts(_old(spark, sf), _new(spark, sf)).areas.select(F.col("ctx").alias("date"), "to_status", "area_km2")
    summary = D.change_summary(changes, F.lit("2024-01-01"))
    return summary.select("from", "to", F.round("area_change_km2", 1).alias("area_change_km2"),
                          F.explode("by_status_km2").alias("to_status", "km2")).withColumn("km2", F.round("km2", 1))


@query
def snapshot_diff(spark, sf):
    """Changed areas with provenance. What depends on where a ring starts is checked: the form of the id, that no other
    change has it, and the extent of the geometry."""
    found = D.diff_snapshots(_old(spark, sf), _new(spark, sf))
    flat = F.flatten(F.flatten("geometry"))
    edge = lambda pick, k: pick(F.transform(flat, lambda p: p[k]))
    closed = F.forall(F.flatten("geometry"), lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1)))
    own_id = F.count(F.lit(1)).over(Window.partitionBy("id")) == 1
    return found.select(
        F.rlike("id", F.lit(r"^chg-[0-9]{4}-[0-9]{2}-[0-9]{2}-[0-9a-f]{16}$")).alias("id_form"), own_id.alias("own_id"), closed.alias("closed"), "date", "layer",
        "from_status", "to_status", "area_km2", "confidence", F.array_join("evidence_ids", ",").alias("evidence_ids"),
        F.array_join("source_ids", ",").alias("source_ids"), F.size("reviews").alias("review_count"), edge(F.array_min, 0).alias("minx"),
        edge(F.array_min, 1).alias("miny"), edge(F.array_max, 0).alias("maxx"), edge(F.array_max, 1).alias("maxy"))


@query
def changed_part_records(spark, sf):
    found = D.diff_snapshots(_old(spark, sf), _new(spark, sf))
    return found.select("to_status", "from_status", F.round("area_km2_exact", 2).alias("area_km2"), "confidence",
                        F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join("source_ids", ",").alias("source_ids"),
                        F.size("reviews").alias("review_count"))


@query
def point_changes(spark, sf):
    points = standin(spark, sf, "points").withColumn("ctx", F.lit("2024-01-02"))
    return D.point_status_changes(_old(spark, sf), _new(spark, sf), points).select("id", "previous_status", "status", "changed_at")


@query
def point_index(spark, sf):
    points = standin(spark, sf, "points").withColumn("ctx", F.lit("2024-01-02"))
    return D.point_status_index(_new(spark, sf), points).select("id", "status", "snapshot_date")


@query
def geometry_validity(spark, sf):
    """Bow ties, open rings, too few points, a part inside another, a hole inside a hole, a hole that cuts the area in two."""
    good = rect_features(standin(spark, sf, "rects_new"))
    at = lambda u, v: f"array(r[0][0] + {u}D * (r[2][0] - r[0][0]), r[0][1] + {v}D * (r[2][1] - r[0][1]))"
    box = lambda low, high: f"array({at(low, low)}, {at(high, low)}, {at(high, high)}, {at(low, high)}, {at(low, low)})"
    diamond = f"array({at(0, 0.5)}, {at(0.5, 0.75)}, {at(1, 0.5)}, {at(0.5, 0.25)}, {at(0, 0.5)})"
    shapes = {
        0: f"array(array(r, {box(0.125, 0.875)}), array({box(0.25, 0.75)}))",  # an island in a hole: sound
        1: "array(array(array(r[0], r[2], r[1], r[3], r[0])))", 2: "array(array(slice(r, 1, 4)))", 3: "array(array(array(r[0], r[1], r[0])))",
        4: f"array(array(r), array({box(0.25, 0.75)}))", 5: f"array(array(r, {box(0.125, 0.875)}, {box(0.25, 0.75)}))", 6: f"array(array(r, {diamond}))"}
    cases = " ".join(f"WHEN {k} THEN {shape}" for k, shape in shapes.items())
    bent = good.withColumn("geometry", F.expr(f"transform(geometry[0], r -> CASE idx % 7 {cases} END)[0]"))
    return invalid_features(bent).select("id", "reason")


@query
def features_by_layer(spark, sf):
    new = _new(spark, sf)
    return readside.layer(new, "contested").select("id", "status")


# --- messages and intake --------------------------------------------------------------------------------------------

def _pages(spark, sf):
    p = standin(spark, sf, "message_parts")
    message = """concat('<html><body><p>head</p><div class="tgme_widget_message_wrap js"><div data-post="ChannelUA/', page_id, '">',
      '<b>Intro</b> ', CASE WHEN user_id % 7 = 0 THEN 'Map' ELSE 'Мапу оновлено' END, ' &mdash; ', event_type, '&nbsp;&amp; <i>more</i>',
      CASE WHEN user_id % 9 = 0 THEN '' ELSE concat('<a href="https://map.example/', CASE WHEN user_id % 2 = 0 THEN 'en/' ELSE '' END, '#12.5/', lat_text, '/', lon_text, '" target="_blank">',
        CASE WHEN user_id % 5 = 0 THEN '<b> </b>' ELSE concat('Loc\\n<b>', event_type, '</b> &quot;', user_id, '&quot;') END, '</a>') END,
      CASE WHEN user_id % 4 = 0 THEN concat('<a href="http://map.example/#9/', lon_text, '/', lat_text, '">second</a>') ELSE '' END,
      ' 💬 chat', '<time datetime="', stamp, zone, '"></time></div></div>',
      '<DIV CLASS="tgme_widget_message_wrap"><div data-post="ChannelUA/0', page_id, '">Мапу оновлено<a href="https://map.example/#1/1.5/2.5">x</a></div></div></body></html>')"""
    return p.selectExpr("page_id", f"{message} AS html")


@query
def point_updates(spark, sf):
    found = messages.extract_point_updates(_pages(spark, sf), V.utc(NOW), PROFILE)
    return found.select("id", "post_id", "post_url", messages.utc_text(F.col("published_at")).alias("published_at"),
                        F.col("event_date").cast("string").alias("event_date"), "label", "summary", "lat", "lon", "sequence")


@query
def updates_over_two_polls(spark, sf):
    """An early poll releases what is old enough and holds the rest; a later one releases from the held messages."""
    early = V.utc(datetime(2024, 1, 10))
    dated = messages.dated_messages(_pages(spark, sf), PROFILE)
    first = messages.message_updates(dated, early, PROFILE)
    second = messages.message_updates(messages.held_messages(dated, early), V.utc(NOW), PROFILE)
    return first.withColumn("poll", F.lit(1)).unionByName(second.withColumn("poll", F.lit(2))).select("poll", "id", "sequence")


@query
def rejected_messages(spark, sf):
    return messages.rejected_messages(_pages(spark, sf), PROFILE).select("page_id", "post_id", "published_text")


def _merged(spark, sf):
    updates = messages.extract_point_updates(_pages(spark, sf), V.utc(NOW), PROFILE)
    events = standin(spark, sf, "events").drop("ordinal")
    evidence = standin(spark, sf, "evidence").drop("ordinal")
    points = standin(spark, sf, "points").drop("ordinal")
    full = points.select("id", "name", *[F.lit(None).cast("string").alias(c) for c in ("name_uk", "name_ru", "name_en")],
                         F.array().cast("array<string>").alias("aliases"), F.lit("").alias("admin1"), "lat", "lon",
                         F.lit("unknown").alias("status"), "source_id")
    status = spark.sql("SELECT 'awaiting_first_snapshot' AS state, CAST(NULL AS string) AS snapshot_date")
    return messages.merge_point_updates(updates, events, evidence, full, status, messages.gazetteer(spark), PROFILE, V.utc(NOW))


@query
def merged_events(spark, sf):
    return _merged(spark, sf).events.select("id", "title", "verification_status", "event_kind", "event_date", F.coalesce("location_label", F.lit("?")).alias("label"),
                                            F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_contains("source_ids", "feed-map").alias("from_feed"))


@query
def merged_evidence(spark, sf):
    return _merged(spark, sf).evidence.select("id", "source_id", "evidence_type", "url")


@query
def merged_points(spark, sf):
    return _merged(spark, sf).points.select("id", "name", "admin1", F.array_join("aliases", "|").alias("aliases"), "source_id")


@query
def point_feed_status(spark, sf):
    return _merged(spark, sf).status.select("state", "point_feed_date", "point_update_count", "new_settlements")


@query
def update_point_features(spark, sf):
    found = geojson.point_features(standin(spark, sf, "events"), vocab.POINT_EVENT_KIND)
    return geojson.point_feature_text(found.select("id", "verification_status", "lon", "lat"))


@query
def review_queue(spark, sf):
    found = intake.collect_documents(standin(spark, sf, "feed_texts"), V.utc(NOW))
    return found.select("id", "source_id", "title", "url", "published_at_raw", "review_status")


@query
def source_health(spark, sf):
    probes = standin(spark, sf, "probes").withColumn("checked_at", V.utc(NOW))
    return intake.source_health(standin(spark, sf, "sources"), probes).drop("checked_at")


@query
def source_health_all_failed(spark, sf):
    probes = standin(spark, sf, "probes").withColumns(
        {"checked_at": V.utc(NOW), "http_status": F.lit(None).cast("int"), "error_class": F.lit("TimeoutError")})
    return intake.source_health(standin(spark, sf, "sources"), probes).drop("checked_at")


@query
def page_titles(spark, sf):
    title = T.plain_text(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1))
    return load(spark, sf, "pages").select("page_id", title.alias("title"))


@query
def page_links(spark, sf):
    group = lambda g: F.regexp_extract_all("html", F.lit(r'(?is)<a href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(g))
    links = load(spark, sf, "pages").select("page_id", F.posexplode(F.arrays_zip(group(1).alias("href"), group(2).alias("label"))).alias("pos", "l"))
    return links.select("page_id", (F.col("pos") + 1).alias("sequence"), F.col("l.href").alias("href"), F.col("l.label").alias("label"))


@query
def page_text_length(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.length(T.plain_text(F.col("html"))).cast("bigint").alias("chars"))


@query
def document_digests(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"), V.short_digest(20, F.col("source"), F.col("text")).alias("short_id"))


@query
def page_hosts(spark, sf):
    return load(spark, sf, "pages").select("page_id", V.https_with_host(F.col("url")).alias("https"))


# --- read side ------------------------------------------------------------------------------------------------------

@query
def evidence_bundles(spark, sf):
    found = readside.evidence_bundle(standin(spark, sf, "events"), standin(spark, sf, "evidence"), standin(spark, sf, "sources"))
    return found.select("id", "pos", "evidence_id", "source_id", "evidence_type", "side")


@query
def evidence_matrix(spark, sf):
    return readside.evidence_matrix(standin(spark, sf, "events"), standin(spark, sf, "evidence"), standin(spark, sf, "sources"))


@query
def weakly_confirmed(spark, sf):
    matrix = readside.evidence_matrix(standin(spark, sf, "events"), standin(spark, sf, "evidence"), standin(spark, sf, "sources"))
    return readside.weakly_confirmed(matrix).select("id", "independent_groups")


@query
def record_source_links(spark, sf):
    return readside.source_links(standin(spark, sf, "events"), standin(spark, sf, "sources"))


@query
def record_evidence_links(spark, sf):
    return readside.evidence_links(standin(spark, sf, "claims"), standin(spark, sf, "evidence"))


@query
def source_grid(spark, sf):
    health = standin(spark, sf, "probes").select("source_id", V.probe_state(F.col("http_status"), F.col("error_class")).alias("state"),
                                                 F.lit("2024-01-20").alias("checked_at"), "ordinal")
    return readside.source_grid(standin(spark, sf, "sources"), health)


@query
def source_grid_one_side(spark, sf):
    health = standin(spark, sf, "probes").select("source_id", F.lit("ok").alias("state"), F.lit("2024-01-20").alias("checked_at"), "ordinal")
    return readside.source_grid(standin(spark, sf, "sources"), health, "independent")


@query
def search_points(spark, sf):
    return readside.search_points(standin(spark, sf, "places"), "  BoLt ").select("ordinal", "id", localised_name("uk").alias("shown"))


@query
def search_alias(spark, sf):
    return readside.search_points(standin(spark, sf, "places"), "item 19").select("ordinal", "id")


@query
def search_index(spark, sf):
    """The first eight places for every brand, beginning of a type and two letters of it, through an index of letter runs."""
    places, parts = standin(spark, sf, "places"), load(spark, sf, "part")
    path = _folder(spark)
    names = G.searched_names([F.col(c) for c in ("name", "name_ru", "name_uk", "name_en")], F.col("aliases"))
    G.write_postings(places, "id", names, path)
    texts = F.array("p_brand", F.concat(F.lit(" "), F.substring("p_type", 1, 5)), F.substring("p_type", 2, 2), F.substring("p_type", 1, 1), F.concat("p_type", F.lit("?")))
    queries = parts.select(F.explode(texts).alias("query"))
    return G.search(spark, path, queries, places, "id", names, "ordinal")


@query
def place_names(spark, sf):
    return standin(spark, sf, "places").select(
        "id", localised_name("uk").alias("uk"), localised_name("en").alias("en"),
        labelled(F.col("status"), vocab.STATUS_LABELS, vocab.NO_STATUS_LABEL).alias("status_label"))


@query
def event_status_labels(spark, sf):
    return standin(spark, sf, "events").select(
        "id", *[event_status_label(F.col("verification_status"), language).alias(language) for language in ("ru", "uk", "en")])


@query
def event_titles(spark, sf):
    return standin(spark, sf, "events").select("id", localised_text("title", "uk").alias("title"))


@query
def alias_sets(spark, sf):
    return standin(spark, sf, "places").select("id", F.array_join(M.alias_set(*[F.col(c) for c in ("name", "name_uk", "name_ru", "name_en")]), "|").alias("aliases"))


@query
def point_cards(spark, sf):
    return readside.point_card_counts(standin(spark, sf, "points"), standin(spark, sf, "claims"), standin(spark, sf, "events"))


@query
def point_card(spark, sf):
    return readside.point_card(standin(spark, sf, "points"), standin(spark, sf, "claims"), standin(spark, sf, "events"), "pt-4")


@query
def all_point_cards(spark, sf):
    return readside.point_card(standin(spark, sf, "points"), standin(spark, sf, "claims"), standin(spark, sf, "events"))


@query
def unverified_records(spark, sf):
    return readside.unverified_records(standin(spark, sf, "claims"), standin(spark, sf, "events")).select("origin", "ordinal", "id", "verification_status")


@query
def located_events(spark, sf):
    return readside.located_events(standin(spark, sf, "events")).select("id", "verification_status")


@query
def located_claims(spark, sf):
    return readside.located_claims(standin(spark, sf, "claims"), "russian").select("id")


@query
def dashboard(spark, sf):
    status = spark.sql("SELECT CAST(NULL AS timestamp) AS published_at, TIMESTAMP '2024-01-17 12:00:00' AS point_feed_published_at,"
                       " CAST(NULL AS string) AS snapshot_date, '2024-01-17' AS point_feed_date, CAST(NULL AS string) AS snapshot_sha256,"
                       " CAST(NULL AS bigint) AS new_settlements")
    found = readside.dashboard_status(status, standin(spark, sf, "points"), standin(spark, sf, "events"), standin(spark, sf, "claims"), V.utc(NOW),
                                      None, load(spark, sf, "region"))
    return found.drop("version")


@query
def change_badge(spark, sf):
    return readside.change_badge(standin(spark, sf, "archive"), standin(spark, sf, "events"))


@query
def event_freshness(spark, sf):
    e = load(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    fresh = V.freshness(F.when(F.col("user_id") % 2 == 0, ts), F.when(F.col("user_id") % 3 == 0, ts), V.utc(NOW))
    return e.select("event_id", fresh.alias("freshness"))


@query
def released_events(spark, sf):
    e = load(spark, sf, "events")
    return e.filter(V.released(F.col("ts").cast("timestamp"), V.utc(NOW), 24)).select("event_id", F.round(V.age_hours(V.utc(NOW), F.col("ts").cast("timestamp")), 3).alias("age_hours"))


def _current_changes(archive):
    """The changes of the newest archived date."""
    newest = archive.agg(F.max("snapshot_date").alias("_newest"))
    return archive.join(F.broadcast(newest), F.col("snapshot_date") == F.col("_newest")).drop("snapshot_date", "_newest")


def _period(spark, sf, period):
    archive = standin(spark, sf, "archive")
    return readside.changes_for_period(archive, standin(spark, sf, "manifest"), _current_changes(archive), ANCHOR, period)


@query
def period_changes_week(spark, sf):
    return _period(spark, sf, "week")


@query
def period_changes_month(spark, sf):
    return _period(spark, sf, "month")


@query
def period_total_month(spark, sf):
    return readside.period_total(_period(spark, sf, "month")).withColumn("area_km2", F.round("area_km2", 2))


@query
def period_fallback(spark, sf):
    archive = standin(spark, sf, "archive")
    return readside.changes_for_period(archive, standin(spark, sf, "manifest"), _current_changes(archive), date(2010, 1, 1), "day")


# --- archive, merges, orders ----------------------------------------------------------------------------------------

@query
def archive_dates(spark, sf):
    found = standin(spark, sf, "archive").groupBy(F.col("snapshot_date").alias("date")).agg(
        F.count(F.lit(1)).alias("change_count"), F.round(F.sum("area_km2"), 2).alias("area_change_km2"))
    return archive.ordered_manifest(found).withColumnRenamed("date", "snapshot_date")


@query
def archive_open_date(spark, sf):
    return standin(spark, sf, "archive").filter(F.col("snapshot_date") == F.lit(date(1998, 3, 14))).select("id", "area_km2", "pos")


@query
def published_archive(spark, sf):
    """Both snapshots published through the gate: the audit with what the archive holds of each date."""
    root, points = _folder(spark), standin(spark, sf, "points").drop("ordinal")
    for day, rects in (("2024-01-01", "rects_old"), ("2024-01-02", "rects_new")):
        apart = standin(spark, sf, rects).where("c = 0").withColumns({"x1": F.least("x1", F.col("x0") + 20), "y1": F.least("y1", F.col("y0") + 20)})  # no overlaps
        f = rect_features(apart)
        moderation = F.struct(F.lit("approved").alias("decision"), "moderation.reviewer", F.lit("2024-01-02T00:00:00Z").alias("reviewed_at"), F.lit("seen").alias("rationale"))
        props = F.to_json(F.struct("id", F.col("id").alias("name"), "status", F.lit("2024-01-01T00:00:00Z").alias("valid_from"), "confidence", "evidence_ids", "source_ids", moderation.alias("moderation")))
        text = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), geojson.geometry_struct(), F.lit("}"))
        number = F.row_number().over(Window.partitionBy("ctx").orderBy("idx"))
        lines = f.select(number.alias("n"), F.concat(F.when(number > 1, F.lit(",")).otherwise(F.lit("")), text).alias("value"))
        ends = spark.createDataFrame([(0, '{"type":"FeatureCollection","metadata":{"snapshot_date":"%s"},"features":[' % day), (2**31 - 1, "]}")], "n int, value string")
        candidate = f"{_folder(spark)}/candidate"
        lines.unionByName(ends).coalesce(1).sortWithinPartitions("n").select("value").write.text(candidate)
        publish(spark, candidate, root, True, RULES_NOW, points)
    dates = [r.date for r in archive.read_manifest(spark, root).select("date").collect()]  # two
    counts = [archive.open_snapshot(spark, root, t, d, archive.ARCHIVE_SCHEMAS[t]).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(d).alias("snapshot_date"), F.lit(t).alias("table"), "rows") for d in dates for t in ("current", "changes", "points")]
    wide = reduce(DataFrame.unionByName, counts).groupBy("snapshot_date").pivot("table", ["current", "changes", "points"]).agg(F.max("rows"))
    audit = readside.newest_audit(archive.read_audit(spark, root)).join(archive.read_manifest(spark, root).select(F.col("date").alias("snapshot_date"), "change_count", "settlement_count"), "snapshot_date")
    return audit.join(wide, "snapshot_date").select("seq", "action", "snapshot_date", F.array_join("reviewers", ",").alias("reviewers"), "change_count", "settlement_count",
                                                    F.col("current").alias("areas"), F.col("changes").alias("changes"), F.col("points").alias("moved"))


@query
def manifest_upsert(spark, sf):
    base = standin(spark, sf, "manifest").select("date", "change_count", "settlement_count")
    shipped = load(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.count(F.lit(1)).alias("change_count"), F.count_distinct("l_partkey").alias("settlement_count"))
    return M.upsert(base, shipped, "date")


@query
def latest_change_per_id(spark, sf):
    return M.pick(standin(spark, sf, "archive"), ["id"], F.struct("snapshot_date", "pos"), last=True)


@query
def first_evidence_per_id(spark, sf):
    return M.first_match(standin(spark, sf, "evidence"), "id", "ordinal").select("id", "source_id", "evidence_type")


@query
def keyed_merge(spark, sf):
    """All customers, then all orders by customer: the last one's value at the place of the first."""
    row = lambda df, key, v, pos: df.select(F.concat(F.lit("c"), F.col(key)).alias("id"), F.col(v).alias("v"), F.col(pos).alias("pos"))
    old = row(load(spark, sf, "customer"), "c_custkey", "c_acctbal", "c_custkey")
    new = row(load(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey")
    return M.keyed_merge(old, new, "id", "pos")


@query
def replace_source_events(spark, sf):
    events, claims = standin(spark, sf, "events"), standin(spark, sf, "claims")
    return M.replace_source(events.select("id", "source_ids"), claims.select("id", "source_ids"), "src-7", "source_ids").select(
        "id", F.array_join("source_ids", ",").alias("source_ids"))


@query
def replace_source_evidence(spark, sf):
    evidence = standin(spark, sf, "evidence").select("id", "source_id")
    fresh = load(spark, sf, "part").select(F.concat(F.lit("new-"), "p_partkey").alias("id"), F.lit("src-3").alias("source_id"))
    return M.replace_source(evidence, fresh, "src-3")


@query
def audit_reviewers(spark, sf):
    f = _features(spark, sf).withColumn("snapshot_date", F.col("status"))
    return audit_row(f, "digest", V.utc(RULES_NOW)).select(F.col("snapshot_date").alias("status"), F.array_join("reviewers", ",").alias("reviewers"))


@query
def newest_audit(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.lit("publish_snapshot").alias("action"), F.to_date("o_orderdate").cast("string").alias("snapshot_date"))
    return readside.newest_audit(rows)


@query
def latest_event(spark, sf):
    key = F.struct(F.coalesce("published_at", "event_date", F.lit("")).alias("t"), F.col("id"))
    return standin(spark, sf, "events").agg(F.max_by(F.struct("id", "event_date"), key).alias("e")).select("e.*")


@query
def location_labels(spark, sf):
    return standin(spark, sf, "events").groupBy("event_kind").agg(
        F.count_distinct(F.coalesce("location_label", F.lit("\u0000"))).alias("labels"), F.count(F.lit(1)).alias("updates"))


@query
def coordinate_lookup(spark, sf):
    """Place names by rounded coordinates, joined on decimals."""
    places = standin(spark, sf, "claims").filter("location IS NOT NULL").select(
        F.round("location.lat", 6).cast("decimal(9,6)").alias("lat_key"), F.round("location.lon", 6).cast("decimal(9,6)").alias("lon_key"), "ordinal", "title")
    named = M.pick(places, ["lat_key", "lon_key"], F.col("ordinal"), last=False).select(
        "lat_key", "lon_key", *(F.col("title").alias(c) for c in ("known_uk", "known_ru", "known_en", "known_admin1")))
    updates = standin(spark, sf, "events").select("id", F.coalesce("location_label", F.lit("?")).alias("label"), F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))
    return messages.named_updates(updates, named).select("id", F.col("known_ru").alias("title"), "name_uk")
