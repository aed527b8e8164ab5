"""Polygon validity: closed rings of at least four points, no self-intersection, holes inside their shell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.operators.edges import TOUCH_DEG, boundary_area, edge_table, ring_segments
from geoledger.operators.locate import points_in_regions
from geoledger.operators.overlay import PROPER_CROSSING, common_boundary, near_segments, prepared, with_segment_terms
from geoledger.session import cut_spread as cut, spread

SEP = "\u001f"

def invalid_features(features: DataFrame) -> DataFrame:
    """(ctx, id, reason) of features with invalid geometry, one row per reason.

    ``features`` carry ctx, id, geometry; ids are unique within ctx.
    """
    rings = features.select("ctx", "id", F.posexplode("geometry").alias("part", "rings")).select(
        "ctx", "id", "part", F.posexplode("rings").alias("ring", "pts"))
    shape = rings.select("ctx", "id", F.when(F.size("pts") < 4, "too few points")
                         .when(F.col("pts")[0] != F.element_at("pts", -1), "ring not closed").alias("reason"))
    segs = cut(ring_segments(features.select("ctx", "id", "geometry"), keep=("ctx", "id")))
    flat = segs.select("ctx", "id", "part", "ring", "turn").distinct().filter("turn = 0").select(
        "ctx", "id", F.lit("ring without area").alias("reason"))
    twice = segs.groupBy("ctx", "id", "part", "ring", "ax", "ay").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "ctx", "id", F.lit("ring self-intersection").alias("reason"))
    edges = cut(edge_table(features, F.col("ctx"), F.col("id")))
    same = edges.groupBy("ctx", "fid", "x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "ctx", F.col("fid").alias("id"), F.lit("self-intersection").alias("reason"))
    regions = prepared(edges)
    pairs = with_segment_terms(near_segments(regions.own, regions.index).filter(
        "struct(x1, y1, x2, y2) <> struct(qx1, qy1, qx2, qy2)"))
    overlap = (f"abs(dq1) <= {TOUCH_DEG} AND abs(dq2) <= {TOUCH_DEG}"
               " AND least(greatest(tq1, tq2), 1) - greatest(least(tq1, tq2), 0) > 1e-9")
    crossing = regions.named(pairs.filter(f"({PROPER_CROSSING}) OR ({overlap})").select("ctx", "bid").distinct(), "bid", "id").select(
        "ctx", "id", F.lit("self-intersection").alias("reason"))
    # A hole is probed at the middle of its first edge, which a valid hole never shares with its shell.
    start = segs.filter("ring > 0 AND seq = 0").selectExpr(
        "ctx", "concat_ws('\u001f', id, part) AS owner", "concat_ws('\u001f', id, part, ring) AS pid",
        "(ax + bx) / 2 AS x", "(ay + by) / 2 AS y")
    shells = features.select("ctx", "id", F.posexplode("geometry").alias("part", "rings")).select(
        "ctx", F.concat_ws("\u001f", "id", "part").alias("owner"), F.array(F.slice("rings", 1, 1)).alias("geometry"))
    held = points_in_regions(start.select("ctx", "pid", "x", "y"), edge_table(shells, F.col("ctx"), F.col("owner")))
    outside = start.join(held.select("ctx", "pid", F.col("bid").alias("owner")), ["ctx", "pid", "owner"], "left_anti").select(
        "ctx", F.element_at(F.split("owner", "\u001f"), 1).alias("id"), F.lit("hole lies outside shell").alias("reason"))
    found = shape.filter("reason IS NOT NULL")
    most = features.agg(F.max(F.size("geometry")).alias("parts"), F.max(F.array_max(F.transform("geometry", F.size))).alias("rings")).first()
    nested = [_nested_shells(features)] if (most.parts or 0) > 1 else []
    nested += [_cut_interiors(features)] if (most.rings or 0) > 1 else []
    nested += [_nested_holes(features)] if (most.rings or 0) > 2 else []
    for more in (flat, twice, same, crossing, outside, *nested):
        found = found.unionByName(more)
    return found.distinct()


def _parts(features: DataFrame) -> DataFrame:
    return features.select("ctx", "id", F.size("geometry").alias("n_parts"), F.posexplode("geometry").alias("part", "rings"))


def _probes(df: DataFrame, ring: str, name: str) -> DataFrame:
    """Two points of the first edge of a ring: what lies on one side of a sound neighbour has both there."""
    both = F.explode(F.array(F.lit(0.5), F.lit(0.3125))).alias("_t")
    spot = lambda k: f"{ring}[0][{k}] + _t * ({ring}[1][{k}] - {ring}[0][{k}])"
    return df.filter(f"size({ring}) >= 4").select("*", both).select(
        "area", F.concat_ws(SEP, F.col(name).cast("string"), F.col("_t").cast("string")).alias("pid"), F.expr(spot(0)).alias("x"), F.expr(spot(1)).alias("y"))


def _inside_sibling(probes: DataFrame, regions: DataFrame, reason: str) -> DataFrame:
    """(ctx, id, reason) where both probes of a member lie in one other member of the same area (``ctx`` and ``id`` lead its name)."""
    edges = edge_table(regions, F.col("area"), F.col("member"))
    hits = points_in_regions(probes.select(F.col("area").alias("ctx"), "pid", "x", "y"), edges).withColumn("own", F.split("pid", SEP)[0])
    held = hits.filter("own <> bid").groupBy("ctx", "own", "bid").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    return held.select(F.split("ctx", SEP)[0].alias("ctx"), F.split("ctx", SEP)[1].alias("id"), F.lit(reason).alias("reason")).distinct()


def _nested_shells(features: DataFrame) -> DataFrame:
    """A shell inside the filled area of another part; inside another part's hole it is an island and sound."""
    many = _parts(features).filter("n_parts > 1").withColumn("area", F.concat_ws(SEP, "ctx", "id"))
    regions = many.select("area", F.col("part").cast("string").alias("member"), F.array("rings").alias("geometry"))
    return _inside_sibling(_probes(many, "rings[0]", "part"), regions, "nested shells")


def _nested_holes(features: DataFrame) -> DataFrame:
    holes = _parts(features).filter("size(rings) > 2").select(
        F.concat_ws(SEP, "ctx", "id", "part").alias("area"), F.posexplode(F.slice(F.col("rings"), 2, F.size("rings"))).alias("hole", "pts"))
    regions = holes.select("area", F.col("hole").cast("string").alias("member"), F.array(F.array("pts")).alias("geometry"))
    return _inside_sibling(_probes(holes, "pts", "hole"), regions, "nested holes")


def _cut_interiors(features: DataFrame) -> DataFrame:
    """Parts whose rings touch so that they close a cycle, which cuts the interior in two.

    Rings and the points where they touch form a graph. Rings and points with one link only are taken off until none is
    left; what remains lies on a cycle. Rings that do not cross touch at a vertex of one of them.
    """
    rings = _parts(features).filter("size(rings) > 1").select(
        F.concat_ws(SEP, "ctx", "id", "part").alias("area"), F.posexplode("rings").alias("ring", "pts"))
    edges = edge_table(rings.select("area", "ring", F.array(F.array("pts")).alias("geometry")), F.col("area"), F.col("ring"))
    vertices = rings.select("area", "ring", F.explode("pts").alias("p")).selectExpr("area AS ctx", "ring", "p[0] AS x", "p[1] AS y").distinct()
    named = vertices.withColumn("pid", F.concat_ws(SEP, F.col("ring").cast("string"), F.col("x").cast("string"), F.col("y").cast("string")))
    on = points_in_regions(named.select("ctx", "pid", "x", "y"), edges, border_only=True).withColumn("own", F.split("pid", SEP)[0]).filter("own <> bid")
    point = F.concat_ws(SEP, F.split("pid", SEP)[1], F.split("pid", SEP)[2])
    links = on.select("ctx", point.alias("point"), F.explode(F.array("own", "bid")).alias("ring")).distinct()
    links, before = cut(links), -1
    while (left := links.count()) != before:
        before = left
        for end in ("ring", "point"):
            inner = links.groupBy("ctx", end).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
            links = links.join(spread(inner), ["ctx", end], "left_semi")
        links = cut(links)
    return links.select(F.split("ctx", SEP)[0].alias("ctx"), F.split("ctx", SEP)[1].alias("id"), F.lit("interior is cut in two").alias("reason")).distinct()


def bounds(features: DataFrame) -> DataFrame:
    """(ctx, id, minx, miny, maxx, maxy) in degrees."""
    points = features.select("ctx", "id", F.explode(F.flatten(F.flatten("geometry"))).alias("p"))
    return points.groupBy("ctx", "id").agg(
        F.min(F.col("p")[0]).alias("minx"), F.min(F.col("p")[1]).alias("miny"),
        F.max(F.col("p")[0]).alias("maxx"), F.max(F.col("p")[1]).alias("maxy"))


def overlapping_pairs(features: DataFrame, min_overlap_km2: float) -> DataFrame:
    """(ctx, left_id, right_id, overlap_km2) of unordered feature pairs that overlap by more than the limit."""
    regions = prepared(cut(edge_table(features, F.col("ctx"), F.col("id"))))
    pieces = common_boundary(regions, regions, "aid < bid")
    areas = pieces.groupBy("ctx", "aid", "bid").agg(F.abs(boundary_area()).alias("overlap_km2"))
    named = regions.named(regions.named(areas.filter(F.col("overlap_km2") > min_overlap_km2), "aid", "one"), "bid", "other")
    return named.select("ctx", F.least("one", "other").alias("left_id"), F.greatest("one", "other").alias("right_id"), "overlap_km2")
