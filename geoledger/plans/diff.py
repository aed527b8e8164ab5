"""What changed between two snapshots: changed areas with provenance, and points that switched status.

Feature tables carry ctx, id, status, confidence, evidence_ids, source_ids, moderation, geometry. ``ctx`` names the
snapshot pair, so one job compares any number of pairs (see ``consecutive_pairs``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoledger import vocab
from geoledger.functions.labels import labelled
from geoledger.operators.candidates import box_pairs
from geoledger.operators.edges import boundary_area, edge_table, exact_sum, sheared_sql
from geoledger.operators.locate import point_status, points_in_regions
from geoledger.operators.overlay import (
    LAYERS, SEGMENTS_MEET, boundary_of, common_boundary, dissolve, near_edges, near_segments, partners, prepared, sided_pieces,
    with_segment_terms,
)
from geoledger.operators.rings import labelled_parts, part_polygons
from geoledger.session import cut_spread as cut

SEP = "\u001f"


def consecutive_pairs(archive: DataFrame, date_col: str = "snapshot_date") -> tuple[DataFrame, DataFrame]:
    """(previous, current) feature tables with ctx = the later date, for every two neighbouring dates of an archive.

    The unpartitioned window only sees the distinct dates, one row per published day.
    """
    days = archive.select(date_col).distinct()
    follow = days.withColumn("_next", F.lead(date_col).over(Window.orderBy(date_col)))
    current = archive.withColumn("ctx", F.col(date_col).cast("string"))
    previous = archive.join(follow.filter("_next IS NOT NULL"), date_col).withColumn("ctx", F.col("_next").cast("string")).drop("_next")
    return previous, current


def _status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.coalesce("status", F.lit("unknown")))


def status_regions(features: DataFrame) -> DataFrame:
    """Union of the features of each status: an edge table with ctx = pair + status."""
    keyed = _status(features)
    edges = cut(edge_table(keyed, F.concat_ws(SEP, "ctx", "status"), F.col("id")))
    return cut(dissolve(edges))


def gained_areas(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Pieces of all borders, cut at each other within (pair, status), with new (a) and old (b) on both sides.

    A feature that stands in both snapshots with the same status and geometry is one region of both layers, not two that are cut at
    each other; features whose id repeats in a snapshot are left as they are.
    """
    side = lambda df, new: _status(df).filter("id IS NOT NULL").select(
        "ctx", "status", "id", "geometry", F.lit(new).alias("in_a"), F.lit(not new).alias("in_b"))
    named = Window.partitionBy(F.xxhash64("id"), "id", "ctx", "status")
    both = side(previous, False).unionByName(side(current, True)).withColumns({
        "_n": F.count(F.lit(1)).over(named), "_new": F.count_if("in_a").over(named),
        "_same": F.min("geometry").over(named) == F.max("geometry").over(named)})
    kept = F.coalesce((F.col("_n") == 2) & (F.col("_new") == 1) & F.col("_same"), F.lit(False))
    once = both.withColumn("_both", kept).filter("in_a OR NOT _both").withColumn("in_b", F.col("in_b") | F.col("_both"))
    region = F.concat(F.when(~F.col("in_a"), "old ").when(~F.col("in_b"), "new ").otherwise("both "), "id")
    edges = cut(edge_table(once, F.concat_ws(SEP, "ctx", "status"), region, keep=LAYERS))
    return cut(sided_pieces(edges))


@dataclass
class Changes:
    """Changed parts and the tables derived on the way, all written down once."""

    edges: DataFrame      # ctx, fid (part), to_status, x1..y2, inl
    areas: DataFrame      # ctx, fid, to_status, area_km2 (unrounded, small parts dropped)
    old_regions: DataFrame
    parts: DataFrame      # directed edges for ring assembly


def _as_edges(parts: DataFrame, ctx: str, fid: str) -> DataFrame:
    up = f"{sheared_sql('sx', 'sy')} < {sheared_sql('ex', 'ey')}"
    return parts.selectExpr(
        f"{ctx} AS ctx", f"{fid} AS fid",
        f"CASE WHEN {up} THEN sx ELSE ex END AS x1", f"CASE WHEN {up} THEN sy ELSE ey END AS y1",
        f"CASE WHEN {up} THEN ex ELSE sx END AS x2", f"CASE WHEN {up} THEN ey ELSE sy END AS y2",
        f"CAST({up} AS int) AS inl", "status")


def changed_parts(previous: DataFrame, current: DataFrame, min_part_km2: float = vocab.MIN_PART_KM2) -> Changes:
    """Connected parts of every gained area, and the connected parts of the previous statuses.

    Both are labelled in one run; working with connected parts keeps every later join local.
    """
    pieces = gained_areas(previous, current)
    tagged = lambda df, tag: df.withColumn("ctx", F.concat_ws(SEP, "ctx", F.lit(tag)))
    labelled = labelled_parts(tagged(boundary_of(pieces, "a AND NOT b"), "gain").unionByName(tagged(boundary_of(pieces, "b"), "old")))
    word = lambda i: f"element_at(split(ctx, '{SEP}'), {i})"
    named = labelled.selectExpr("*", f"{word(1)} AS pair", f"{word(2)} AS status", f"{word(3)} AS kind")
    gains, old = named.filter("kind = 'gain'"), named.filter("kind = 'old'")
    edges = _as_edges(gains, "pair", "CAST(part AS string)").withColumnRenamed("status", "to_status")
    old_regions = _as_edges(old, "pair", "concat(part, ' ', status)").drop("status")
    areas = cut(edges.groupBy("ctx", "fid", "to_status").agg(F.abs(boundary_area()).alias("area_km2"))
                .filter(F.col("area_km2") >= min_part_km2))
    kept = cut(edges.join(areas.select("ctx", "fid"), ["ctx", "fid"], "left_semi"))
    rings = gains.drop("ctx", "kind").withColumnRenamed("pair", "ctx").join(
        areas.select("ctx", F.col("fid").cast("bigint").alias("part")), ["ctx", "part"], "left_semi")
    return Changes(kept, areas, old_regions, rings)


def origin_areas(changes: Changes) -> DataFrame:
    """(ctx, fid, from_status, overlap_km2): how much of each changed part had each previous status."""
    parts, old = prepared(changes.edges.drop("to_status")), prepared(cut(changes.old_regions))
    pieces = common_boundary(parts, old)
    status = F.expr("substring(region, instr(region, ' ') + 1)")
    by_region = old.named(pieces.groupBy("ctx", "aid", "bid").agg(boundary_area().alias("km2")), "bid", "region")
    by_status = by_region.groupBy("ctx", "aid", status.alias("from_status")).agg(exact_sum(F.abs("km2")).alias("overlap_km2"))
    return parts.named(by_status, "aid", "fid").select("ctx", "fid", "from_status", "overlap_km2")


def dominant_origin(overlaps: DataFrame, min_overlap_km2: float = vocab.MIN_OVERLAP_KM2) -> DataFrame:
    """(ctx, fid, from_status): largest previous status under a part; equal areas give the greater status text."""
    kept = overlaps.filter(F.col("overlap_km2") > min_overlap_km2)
    best = F.max(F.struct(F.round("overlap_km2", 6), "from_status"))
    return kept.groupBy("ctx", "fid").agg(best["from_status"].alias("from_status"))


def touching_features(changes: Changes, current: DataFrame) -> DataFrame:
    """(ctx, fid, id): current features of the part's status that meet the part, touching included."""
    keyed = _status(current)
    feature_edges = cut(edge_table(keyed, F.concat_ws(SEP, "ctx", "status"), F.col("id")))
    part_edges = changes.edges.withColumn("ctx", F.concat_ws(SEP, "ctx", "to_status"))
    parts, shapes = prepared(part_edges), prepared(feature_edges)
    cand = near_edges(parts, partners(parts, shapes))
    border = with_segment_terms(near_segments(cand, shapes.index)).filter(SEGMENTS_MEET).select("ctx", "aid", "bid").distinct()
    border = shapes.named(parts.named(border, "aid", "part"), "bid", "feature").select("ctx", F.col("part").alias("aid"), F.col("feature").alias("bid"))
    first = lambda edges, name: edges.groupBy("ctx", F.col("fid").alias(name)).agg(
        F.min(F.struct("x1", "y1")).alias("p")).select("ctx", F.col(name).alias("pid"), F.col("p.x1").alias("x"), F.col("p.y1").alias("y"))
    inside = points_in_regions(first(part_edges, "part"), feature_edges, shapes).select("ctx", F.col("pid").alias("aid"), "bid")
    around = points_in_regions(first(feature_edges, "feature"), part_edges, parts).select(
        "ctx", F.col("bid").alias("aid"), F.col("pid").alias("bid"))
    met = border.unionByName(inside).unionByName(around).distinct()
    return met.select(F.element_at(F.split("ctx", SEP), 1).alias("ctx"), F.col("aid").alias("fid"), F.col("bid").alias("id"))


def provenance(touching: DataFrame, current: DataFrame) -> DataFrame:
    """Evidence, sources, lowest confidence and reviews behind each part (ctx, fid)."""
    idx = F.col("idx") if "idx" in current.columns else F.col("id")
    facts = current.select("ctx", "id", idx.alias("_idx"), "evidence_ids", "source_ids", "confidence", "moderation")
    joined = cut(touching.join(facts, ["ctx", "id"]))  # read three times
    # Ids are made distinct before they are gathered, so a bundle holds each id once.
    def bundle(column: str) -> DataFrame:
        ids = joined.select("ctx", "fid", F.explode(column).alias("_v")).distinct()
        return ids.groupBy("ctx", "fid").agg(F.sort_array(F.collect_list("_v")).alias(column))
    rest = joined.groupBy("ctx", "fid").agg(
        F.coalesce(F.min("confidence"), F.lit(vocab.MIN_CONFIDENCE)).alias("confidence"),
        F.expr("transform(array_sort(collect_list(CASE WHEN moderation IS NOT NULL THEN struct(_idx, moderation) END)),"
               " r -> r.moderation)").alias("reviews"))
    out = rest.join(bundle("evidence_ids"), ["ctx", "fid"], "left").join(bundle("source_ids"), ["ctx", "fid"], "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("evidence_ids", "source_ids")})


def dirty_features(previous: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What can take part in a change: current features that did not stand there before with the same status and geometry, and
    the previous and the current features whose boxes meet theirs.

    What was gained lies within the changed features: an equal feature covers nothing that its twin did not cover before. So
    borders are cut and overlaid only there, and the cost follows the change and not the map.
    """
    shape = lambda df: _status(df).withColumn("_shape", F.xxhash64("geometry"))
    new, old = shape(current).alias("n"), shape(previous).select("ctx", "status", "_shape", "geometry").alias("o")
    same = ((F.col("n._shape") == F.col("o._shape")) & (F.col("n.ctx") == F.col("o.ctx")) & (F.col("n.status") == F.col("o.status"))
            & (F.col("n.geometry") == F.col("o.geometry")))  # the number first: it is faster to sort
    dirty = cut(new.join(old, same, "left_anti").drop("_shape"))
    flat = F.flatten(F.flatten("geometry"))
    edge = lambda pick, k: pick(F.transform(flat, lambda p: p[k]))
    box = lambda df, name: df.select(
        "ctx", F.col("id").alias(name), edge(F.array_min, 0).alias("minx"), edge(F.array_min, 1).alias("miny"), edge(F.array_max, 0).alias("maxx"),
        edge(F.array_max, 1).alias("maxy")).where("minx IS NOT NULL")
    boxes = cut(box(dirty, "_changed"))

    def near(df: DataFrame) -> DataFrame:
        met = box_pairs(boxes, box(df, "id"), ["_changed"], ["id"]).select("ctx", "id").distinct()
        return cut(df.join(met, ["ctx", "id"], "left_semi"))

    return dirty, near(previous), near(current)


def diff_snapshots(previous: DataFrame, current: DataFrame, min_part_km2: float = vocab.MIN_PART_KM2,
                   labels: dict[str, str] | None = None) -> DataFrame:
    """One row per changed part: id, date, layer, statuses, texts, area, provenance, geometry (ctx = date)."""
    previous, current = cut(previous), cut(current)
    dirty, before, around = dirty_features(previous, current)
    changes = changed_parts(before, dirty, min_part_km2)
    origin = dominant_origin(origin_areas(changes))
    proof = provenance(touching_features(changes, around), around)
    polygons = part_polygons(changes.parts)
    shapes = polygons.select("ctx", F.col("part").cast("string").alias("fid"), "geometry")
    joined = (changes.areas.join(origin, ["ctx", "fid"], "left").join(proof, ["ctx", "fid"], "left")
              .join(shapes, ["ctx", "fid"]))
    digest = F.substring(F.sha2(F.concat_ws("|", F.to_json("geometry"), "ctx", "to_status"), 256), 1, 16)
    label = lambda c: labelled(F.col(c), labels or vocab.STATUS_LABELS, vocab.NO_STATUS_LABEL)
    empty = F.array().cast("array<string>")
    return joined.select(
        F.concat(F.lit("chg-"), "ctx", F.lit("-"), digest).alias("id"), F.col("ctx").alias("date"),
        F.lit("change").alias("layer"), "from_status", "to_status", F.col("to_status").alias("status"),
        F.lit(vocab.CHANGE_NAME).alias("name"),
        F.concat(label("from_status"), F.lit(" → "), label("to_status")).alias("summary"),
        F.col("area_km2").alias("area_km2_exact"), F.round("area_km2", 3).alias("area_km2"),
        F.round(F.coalesce("confidence", F.lit(vocab.MIN_CONFIDENCE)), 3).alias("confidence"),
        F.coalesce("evidence_ids", empty).alias("evidence_ids"), F.coalesce("source_ids", empty).alias("source_ids"),
        "reviews", "geometry")


def change_summary(changes: DataFrame, previous_date: Column | None = None) -> DataFrame:
    """One row per date: from, to, area_change_km2, by_status_km2 (map in key order), feature_count."""
    exact = F.col("area_km2_exact") if "area_km2_exact" in changes.columns else F.col("area_km2")
    by_status = changes.groupBy("date", "to_status").agg(exact_sum(exact).alias("_km2"), F.count(F.lit(1)).alias("_n"))
    entries = F.sort_array(F.collect_list(F.struct("to_status", F.round("_km2", 3).alias("km2"))))
    return by_status.groupBy("date").agg(
        (previous_date if previous_date is not None else F.lit(None).cast("string")).alias("from"),
        F.round(exact_sum(F.col("_km2")), 3).alias("area_change_km2"), F.map_from_entries(entries).alias("by_status_km2"),
        F.sum("_n").alias("feature_count"),
    ).withColumnRenamed("date", "to").select("from", "to", "area_change_km2", "by_status_km2", "feature_count")


def _point_rows(points: DataFrame) -> DataFrame:
    return points.select("ctx", F.col("id").alias("pid"), F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y"))


def point_status_changes(previous: DataFrame, current: DataFrame, points: DataFrame) -> DataFrame:
    """Points whose status differs between both snapshots: previous_status, status (NULL shown as unknown), changed_at."""
    side = lambda df, name: _status(df).select(F.concat_ws(SEP, "ctx", F.lit(name)).alias("ctx"), "id", "status", "geometry")
    probes = _point_rows(points).select("ctx", "pid", "x", "y").withColumn("_s", F.explode(F.array(F.lit("old"), F.lit("new"))))
    probes = probes.withColumn("ctx", F.concat_ws(SEP, "ctx", "_s")).drop("_s")
    found = point_status(probes, side(previous, "old").unionByName(side(current, "new")))
    found = found.select(F.element_at(F.split("ctx", SEP), 1).alias("ctx"), F.element_at(F.split("ctx", SEP), 2).alias("_s"),
                         F.col("pid").alias("id"), "status")
    wide = found.groupBy("ctx", "id").agg(
        F.max(F.when(F.col("_s") == "old", F.col("status"))).alias("previous_status"),
        F.max(F.when(F.col("_s") == "new", F.col("status"))).alias("_after"))
    moved = wide.filter(~F.col("previous_status").eqNullSafe(F.col("_after")))
    base = points.drop("status", "previous_status", "changed_at")
    return base.join(moved, ["ctx", "id"]).withColumn("status", F.coalesce("_after", F.lit("unknown"))).withColumn(
        "changed_at", F.col("ctx")).drop("_after")


def point_status_index(current: DataFrame, points: DataFrame) -> DataFrame:
    """Every point with its status in the snapshot; points nothing covers are ``unknown``."""
    found = point_status(_point_rows(points), _status(current)).withColumnRenamed("pid", "id")
    base = points.drop("status", "snapshot_date")
    return base.join(found, ["ctx", "id"], "left").withColumn("status", F.coalesce("status", F.lit("unknown"))).withColumn(
        "snapshot_date", F.col("ctx"))
