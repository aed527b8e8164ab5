"""Polygon columns to edge tables.

A polygon column is ``array<array<array<array<double>>>>``: parts, rings, vertices, (lon, lat).
An *edge table* has one row per boundary segment::

    ctx string   independent problem (snapshot, snapshot pair, pair + status ...)
    fid string   region the edge bounds
    x1 y1 x2 y2  end points, ordered upwards along ``v``
    inl int      1 when the region lies left of the upward direction, else 0

``v = y + SHEAR * x`` replaces the latitude wherever edges are cut by horizontal lines: real borders
have many exactly horizontal edges, practically none of slope ``-SHEAR``, so no edge needs a special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger.functions.projection import edge_area_km2
from geoledger.session import spread

SHEAR = 0.0618033988749895
SNAP_PER_DEGREE = 1e9
TOUCH_DEG = 4e-9

EDGE_COLUMNS = ["ctx", "fid", "x1", "y1", "x2", "y2", "inl"]


def sheared_sql(x: str, y: str) -> str:
    return f"({y} + {x} * {SHEAR})"


def sheared(x: str, y: str) -> Column:
    return F.expr(sheared_sql(x, y))


def snapped(value: Column) -> Column:
    return F.rint(value * F.lit(SNAP_PER_DEGREE)) / F.lit(SNAP_PER_DEGREE)


def ring_segments(features: DataFrame, geometry: str = "geometry", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per ring segment in ring order: ``keep`` columns, part, ring, seq, ring_size, turn, end points.

    ``turn`` is the planar shoelace sum of the ring (positive when counter-clockwise).
    """
    parts = features.select(*keep, F.posexplode(geometry).alias("part", "rings"))
    rings = parts.select(*keep, "part", F.posexplode("rings").alias("ring", "pts"))
    zipped = F.arrays_zip(
        F.slice("pts", F.lit(1), F.size("pts") - 1).alias("a"), F.slice("pts", F.lit(2), F.size("pts") - 1).alias("b")
    )
    rings = rings.filter(F.size("pts") > 1).withColumn("segs", zipped)
    origin = F.col("pts")[0]
    turn = F.aggregate(
        "segs",
        F.lit(0.0),
        lambda acc, s: acc
        + ((s["a"][0] - origin[0]) + (s["b"][0] - origin[0])) / 2 * (s["b"][1] - s["a"][1]),
    )
    rings = rings.withColumn("turn", turn).withColumn("ring_size", F.size("pts"))
    segs = rings.select(*keep, "part", "ring", "ring_size", "turn", F.posexplode("segs").alias("seq", "s"))
    return segs.select(
        *keep, "part", "ring", "ring_size", "turn", "seq",
        snapped(F.col("s.a")[0]).alias("ax"), snapped(F.col("s.a")[1]).alias("ay"),
        snapped(F.col("s.b")[0]).alias("bx"), snapped(F.col("s.b")[1]).alias("by"),
    )


def edge_table(features: DataFrame, ctx: Column, fid: Column, geometry: str = "geometry",
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Edges of valid polygons; ring 0 of a part is its shell, the others are holes."""
    source = features.select(ctx.cast("string").alias("ctx"), fid.cast("string").alias("fid"), geometry, *keep)
    segs = ring_segments(source, geometry, ("ctx", "fid", *keep))
    segs = segs.filter((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))
    up = sheared("ax", "ay") < sheared("bx", "by")
    left_as_drawn = (F.col("turn") > 0) == (F.col("ring") == 0)
    return spread(segs.select(
        "ctx", "fid",
        F.when(up, F.col("ax")).otherwise(F.col("bx")).alias("x1"),
        F.when(up, F.col("ay")).otherwise(F.col("by")).alias("y1"),
        F.when(up, F.col("bx")).otherwise(F.col("ax")).alias("x2"),
        F.when(up, F.col("by")).otherwise(F.col("ay")).alias("y2"),
        (up == left_as_drawn).cast("int").alias("inl"),
        *keep,
    ))


def exact_sum(term: Column) -> Column:
    """Aggregate: a sum that does not depend on the order or the number of partitions.

    Each term is rounded to 2**-44 and added up as two whole numbers, its 1024ths and the rest, which have room for terms of
    10**8 in 7 * 10**7 rows and for a thousand million rows; beyond it the run stops.
    """
    coarse = F.rint(term * 1024)
    fine = F.rint((term - coarse / 1024) * float(1 << 44))
    return F.sum(coarse.cast("bigint")) / F.lit(1024.0) + F.sum(fine.cast("bigint")) / F.lit(float(1 << 44))


def boundary_area() -> Column:
    """Aggregate: area in km2 of the region an edge group bounds."""
    term = edge_area_km2(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return exact_sum(F.when(F.col("inl") == 1, term).otherwise(-term))


def feature_area_km2(features: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """Equal-area surface per feature (empty geometry gives 0)."""
    segs = ring_segments(features.select(*keys, geometry), geometry, tuple(keys))
    term = edge_area_km2(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    oriented = F.when((F.col("turn") > 0) == (F.col("ring") == 0), term).otherwise(-term)
    areas = spread(segs.groupBy(*keys).agg(exact_sum(oriented).alias("area_km2")))
    return features.select(*keys).join(areas, keys, "left").withColumn("area_km2", F.coalesce(F.abs("area_km2"), F.lit(0.0)))


def region_stats(edges: DataFrame, flags: tuple[str, ...] = ()) -> DataFrame:
    """Extent of each region, its number of bands and its ``flags`` (boolean columns of ``edges``).

    Bands are equal slices of the region's own ``v`` range. Their number follows the region's edge count, bounded by
    its mean number of crossings per line, so that copying edges into bands at most triples the table.
    """
    v1, v2 = sheared("x1", "y1"), sheared("x2", "y2")
    stats = edges.groupBy("ctx", "fid").agg(
        F.min(F.least("x1", "x2")).alias("minx"), F.max(F.greatest("x1", "x2")).alias("maxx"),
        F.min(F.least("y1", "y2")).alias("miny"), F.max(F.greatest("y1", "y2")).alias("maxy"),
        F.min(v1).alias("vmin"), F.max(v2).alias("vmax"),
        F.count(F.lit(1)).alias("n"), F.sum(v2 - v1).alias("travel"), *[F.bool_or(f).alias(f) for f in flags],
    )
    height = F.greatest(F.col("vmax") - F.col("vmin"), F.lit(1e-12))
    crossings = F.greatest(F.col("travel") / height, F.lit(1.0))
    bands = F.least(F.col("n") / 4, F.col("n") * 2 / crossings)
    return spread(stats.select(
        "ctx", "fid", "minx", "maxx", "miny", "maxy", "vmin", "vmax", "n",
        F.greatest(F.ceil(bands), F.lit(1)).cast("int").alias("nb"), *flags,
    ))


def with_region(edges: DataFrame, stats: DataFrame) -> DataFrame:
    """Edges with the columns of their region. A hash leads the keys: names begin alike, which makes them slow to sort."""
    hashed = lambda df: df.withColumn("_h", F.xxhash64("ctx", "fid"))
    return hashed(edges).join(hashed(stats), ["_h", "ctx", "fid"]).drop("_h")


def band_sql(v: str) -> str:
    """SQL: band number of ``v`` in a region with columns vmin, vmax, nb (clamped to the region)."""
    return f"CAST(greatest(0, least(floor(({v} - vmin) / greatest(vmax - vmin, 1e-12) * nb), nb - 1)) AS int)"


def in_bands(edges: DataFrame, *keep: str) -> DataFrame:
    """Edges with the bands of their own region (columns vmin, vmax, nb), once for each band: ``keep``, band, qx1..qy2, qv1, qv2."""
    reach = edges.selectExpr("*", f"{sheared_sql('x1', 'y1')} AS qv1", f"{sheared_sql('x2', 'y2')} AS qv2")
    return reach.selectExpr(
        *keep, f"explode(sequence({band_sql('qv1')}, {band_sql('qv2')})) AS band",
        "x1 AS qx1", "y1 AS qy1", "x2 AS qx2", "y2 AS qy2", "qv1", "qv2")
