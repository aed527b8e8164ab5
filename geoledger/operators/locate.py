"""Points against polygons: which regions cover a point, border included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.operators.candidates import box_pairs
from geoledger.operators.edges import band_sql, edge_table, in_bands, region_stats, sheared_sql, with_region
from geoledger.operators.overlay import Regions, _off_line
from geoledger.session import cut_spread as cut, spread

ON_BORDER_DEG = 1e-11


def points_in_regions(points: DataFrame, edges: DataFrame, regions: Regions | None = None, border_only: bool = False) -> DataFrame:
    """(ctx, pid, bid) for every region that covers a point, or only those whose border it lies on. ``points`` carry ctx, pid, x, y;
    ``regions`` are the edges as ``prepared``, if the caller has them."""
    stats = cut(region_stats(edges).withColumn("rid", F.monotonically_increasing_id())) if regions is None else regions.stats
    boxes = points.selectExpr("ctx", "pid", "x", "y", "x AS minx", "x AS maxx", "y AS miny", "y AS maxy")
    pairs = cut(box_pairs(boxes, stats.withColumnRenamed("rid", "bid"), ["pid", "x", "y"], ["bid", "vmin", "vmax", "nb"],
                          left_points=True))
    probe = pairs.selectExpr("*", f"{sheared_sql('x', 'y')} AS vp").selectExpr("*", f"{band_sql('vp')} AS band").drop("vmin", "vmax", "nb")
    if regions is None:  # only regions with a point in their box are indexed
        met = stats.withColumnRenamed("rid", "bid").join(pairs.select("bid").distinct(), "bid", "left_semi")
        index = spread(in_bands(with_region(edges.select("ctx", "fid", "x1", "y1", "x2", "y2"), met.select("ctx", "fid", "bid", "vmin", "vmax", "nb")), "bid"))
    else:
        index = regions.index
    hits = probe.join(index, ["bid", "band"]).filter(
        f"qv1 <= vp AND vp <= qv2 AND least(qx1, qx2) <= x + {ON_BORDER_DEG}")
    off = hits.selectExpr("ctx", "pid", "bid", "x", "qx1", "qx2", "vp < qv2 AS _half", "y", "qy1", "qy2",
                          _off_line(("x", "y"), ("qx1", "qy1"), ("qx2", "qy2")) + " AS _off").filter(f"_off <= {ON_BORDER_DEG}")
    sided = off.selectExpr(
        "ctx", "pid", "bid", f"_half AND _off < -{ON_BORDER_DEG} AS _left",
        f"abs(_off) <= {ON_BORDER_DEG} AND x <= greatest(qx1, qx2) + {ON_BORDER_DEG}"
        f" AND y BETWEEN least(qy1, qy2) - {ON_BORDER_DEG} AND greatest(qy1, qy2) + {ON_BORDER_DEG} AS _on")
    grouped = sided.groupBy("ctx", "pid", "bid").agg(F.expr("count_if(_left) % 2 = 1").alias("_in"), F.bool_or("_on").alias("_on"))
    found = grouped.filter("_on" if border_only else "_in OR _on").select("ctx", "pid", "bid")
    return spread(found.join(stats.selectExpr("rid AS bid", "fid"), "bid").selectExpr("ctx", "pid", "fid AS bid"))


def point_status(points: DataFrame, features: DataFrame, contested: str = "contested") -> DataFrame:
    """(ctx, pid, status) of the points some feature covers; several distinct statuses give ``contested``.

    ``features`` carry ctx, id, status, geometry. Uncovered points are absent: join this from the left.
    """
    region = F.concat_ws("\u001f", F.coalesce("status", F.lit("unknown")), "id")
    edges = edge_table(features, F.col("ctx"), region)
    covered = points_in_regions(points, edges).withColumn("status", F.element_at(F.split("bid", "\u001f"), 1))
    both = covered.groupBy("ctx", "pid").agg(F.min("status").alias("lo"), F.max("status").alias("hi"))
    return both.select("ctx", "pid", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(contested).alias("status"))
