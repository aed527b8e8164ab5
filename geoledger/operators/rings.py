"""Boundary edges back to rings, polygon parts and polygon columns.

Every directed boundary edge has one successor, found by a window per node. Rings are the cycles of this relation.
Edges are numbered in (ctx, start) order, so most rings lie within one block of 2 ** ``BLOCK_BITS`` numbers: those are labelled and
ordered block by block, in one shuffle. The others are labelled by pointer jumping over tables (four hops per round), so a ring of n
edges takes about log4(n) rounds however long it is, and no ring beyond a block is walked inside one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoledger.operators.edges import edge_area_km2, sheared_sql
from geoledger.operators.locate import points_in_regions
from geoledger.session import cut_spread as cut

MAX_ROUNDS = 32
BLOCK_BITS = 20


def directed_edges(boundary: DataFrame) -> DataFrame:
    """Edges with the region on their left, numbered in (ctx, start) order and written down once."""
    turned = boundary.selectExpr(
        "ctx",
        "CASE WHEN inl = 1 THEN x1 ELSE x2 END AS sx", "CASE WHEN inl = 1 THEN y1 ELSE y2 END AS sy",
        "CASE WHEN inl = 1 THEN x2 ELSE x1 END AS ex", "CASE WHEN inl = 1 THEN y2 ELSE y1 END AS ey")
    ordered = turned.orderBy("ctx", "sx", "sy", "ex", "ey")
    return cut(ordered.withColumn("id", F.monotonically_increasing_id()))


def successors(edges: DataFrame, clockwise: bool = True, group: tuple[str, ...] = ("ctx",)) -> DataFrame:
    """(id, next). At a node, turn from the way back clockwise to the first outgoing edge (or counter-clockwise).

    Clockwise keeps to one face of the region: parts that only share a point stay apart. Counter-clockwise, inside
    the edges of one face, separates a hole from a shell it touches in a point.
    """
    turn = F.lit(1 if clockwise else -1)
    arriving = edges.select(*group, F.col("ex").alias("nx"), F.col("ey").alias("ny"),
                            (F.expr("atan2(sy - ey, sx - ex)") * turn).alias("angle"),
                            F.col("id").alias("in_id"), F.lit(None).cast("long").alias("out_id"))
    leaving = edges.select(*group, F.col("sx").alias("nx"), F.col("sy").alias("ny"),
                           (F.expr("atan2(ey - sy, ex - sx)") * turn).alias("angle"),
                           F.lit(None).cast("long").alias("in_id"), F.col("id").alias("out_id"))
    node = Window.partitionBy("nx", "ny", *group).orderBy("angle")
    before = node.rowsBetween(Window.unboundedPreceding, -1)
    around = node.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    linked = arriving.unionByName(leaving).select(
        "in_id", F.coalesce(F.last("out_id", True).over(before), F.last("out_id", True).over(around)).alias("next"))
    return linked.filter("in_id IS NOT NULL").select(F.col("in_id").alias("id"), "next")


def _closed(jump: np.ndarray) -> np.ndarray:
    """Whether each place is never left by ``jump`` (-1: leaves)."""
    reach, left = jump, -1
    while (gone := int((reach < 0).sum())) != left:  # a path that still leads out would let some place leave in the next doubling
        left = gone
        reach = np.where(reach >= 0, reach[reach], -1)
    return reach >= 0


def _block_labels(table: pa.Table) -> pa.Table:
    """id, next, and the ring and dist of the edges from which one never leaves the block (null for the others)."""
    table = table.sort_by("id")
    ids, following = table.column("id").to_numpy(), pc.fill_null(table.column("next"), -1).to_numpy()
    at = np.minimum(np.searchsorted(ids, following), len(ids) - 1)
    jump = np.where(ids[at] == following, at, -1)
    closed = _closed(jump)
    ring, dist, hop, step = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64), np.where(closed, jump, np.arange(len(ids))), 1
    while (lower := ring[hop] < ring).any():
        dist = np.where(lower, dist[hop] + step, dist)
        ring, hop, step = np.minimum(ring, ring[hop]), hop[hop], 2 * step
    return pa.table({"id": table.column("id"), "next": table.column("next"), "ring": pa.array(ids[ring], mask=~closed), "dist": pa.array(dist, mask=~closed)})


def ring_labels(links: DataFrame) -> DataFrame:
    """(id, ring, dist): smallest id on the cycle and the number of steps from here to it."""
    blocks = links.select("id", "next").groupBy(F.shiftright("id", BLOCK_BITS)).applyInArrow(_block_labels, "id long, next long, ring long, dist long")
    labels = cut(blocks)
    done, rest = labels.filter("ring IS NOT NULL").select("id", "ring", "dist"), labels.filter("ring IS NULL").select("id", "next")
    return done if rest.isEmpty() else done.unionByName(_jumped_labels(rest, done))


def _jumped_labels(links: DataFrame, done: DataFrame) -> DataFrame:
    """``ring_labels`` of links that cross blocks; where they run into edges that are labelled already they go on from those labels."""
    ends = links.select(F.col("next").alias("id")).distinct().join(done, "id").select(
        "id", "ring", "dist", F.lit(None).cast("long").alias("jump"), F.lit(False).alias("moved"))
    own = links.select("id")
    table = cut(links.select("id", F.col("id").alias("ring"), F.lit(0).cast("long").alias("dist"),
                             F.col("next").alias("jump"), F.lit(True).alias("moved")).unionByName(ends))
    step = 1
    for _ in range(MAX_ROUNDS):
        hop = [table.selectExpr(f"id AS id{i}", f"ring AS ring{i}", f"dist AS dist{i}", f"jump AS jump{i}") for i in (1, 2, 3)]
        walked = (table.join(hop[0], F.col("jump") == F.col("id1"), "left")
                  .join(hop[1], F.col("jump1") == F.col("id2"), "left")
                  .join(hop[2], F.col("jump2") == F.col("id3"), "left"))
        best = "least(struct(ring, dist), " + ", ".join(
            f"CASE WHEN ring{i} IS NOT NULL THEN struct(ring{i} AS ring, dist{i} + {i * step} AS dist) END"
            for i in (1, 2, 3)) + ")"
        table = cut(walked.selectExpr("id", f"{best} AS b", "ring AS was", "jump3 AS jump").selectExpr(
            "id", "b.ring AS ring", "b.dist AS dist", "jump", "b.ring <> was AS moved"))
        if table.filter("moved").isEmpty():
            return table.select("id", "ring", "dist").join(own, "id", "left_semi")
        step *= 4
    raise RuntimeError("ring labelling did not settle")


def labelled_parts(boundary: DataFrame) -> DataFrame:
    """Boundary edges with the part (connected region) and face ring they belong to.

    Returns ctx, id, sx, sy, ex, ey, ring, dist, part. A face ring of negative area is a hole and joins the smallest
    shell around it.
    """
    edges = directed_edges(boundary)
    rings = cut(edges.join(ring_labels(successors(edges)), "id"))
    turn = rings.groupBy("ctx", "ring").agg(
        F.sum(F.expr("(sx + ex) / 2 * (ey - sy)")).alias("planar"))
    holes = turn.filter("planar <= 0").select("ctx", "ring")
    if holes.isEmpty():
        return rings.withColumn("part", F.col("ring"))
    starts = rings.filter("dist = 0").join(holes, ["ctx", "ring"], "left_semi")
    points = starts.selectExpr("ctx", "ring AS pid", "(sx + ex) / 2 AS x", "(sy + ey) / 2 AS y")
    shells = turn.filter("planar > 0")
    up = f"{sheared_sql('sx', 'sy')} < {sheared_sql('ex', 'ey')}"
    shell_edges = rings.join(shells.select("ctx", "ring"), ["ctx", "ring"], "left_semi").selectExpr(
        "ctx", "CAST(ring AS string) AS fid",
        f"CASE WHEN {up} THEN sx ELSE ex END AS x1", f"CASE WHEN {up} THEN sy ELSE ey END AS y1",
        f"CASE WHEN {up} THEN ex ELSE sx END AS x2", f"CASE WHEN {up} THEN ey ELSE sy END AS y2",
        f"CAST({up} AS int) AS inl")
    around = points_in_regions(points, shell_edges).join(
        shells.selectExpr("ctx", "CAST(ring AS string) AS bid", "ring AS shell", "planar"), ["ctx", "bid"])
    owner = around.groupBy("ctx", "pid").agg(F.min_by("shell", F.struct("planar", "shell")).alias("shell"))
    named = rings.join(owner.withColumnRenamed("pid", "ring"), ["ctx", "ring"], "left")
    return cut(named.withColumn("part", F.coalesce("shell", "ring")).drop("shell"))


def simple_rings(parts: DataFrame) -> DataFrame:
    """Split face rings that visit a node twice into simple rings: adds ``loop`` and ``loop_dist``."""
    visits = parts.groupBy("ctx", "ring", "sx", "sy").count().filter("count > 1").select("ctx", "ring").distinct()
    plain = parts.join(visits, ["ctx", "ring"], "left_anti").withColumns({"loop": F.col("ring"), "loop_dist": F.col("dist")})
    pinched = parts.join(visits, ["ctx", "ring"], "left_semi")
    if pinched.isEmpty():
        return plain
    pinched = cut(pinched)
    labels = ring_labels(successors(pinched, clockwise=False, group=("ctx", "ring")))
    split = pinched.join(labels.selectExpr("id", "ring AS loop", "dist AS loop_dist"), "id")
    return plain.unionByName(split)


def part_polygons(parts: DataFrame) -> DataFrame:
    """(ctx, part, geometry, area_km2): one polygon per part, shell first, as a multipolygon column of one part.

    The coordinates of one polygon end up in one row because a polygon value is one row.
    """
    loops = simple_rings(parts)
    term = edge_area_km2(F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey"))
    rings = loops.groupBy("ctx", "part", "loop").agg(
        F.sort_array(F.collect_list(F.struct((F.col("loop_dist") != 0).alias("later"), (-F.col("loop_dist")).alias("pos"),
                                             F.array("sx", "sy").alias("p")))).alias("pts"),
        F.sum(F.expr("(sx + ex) / 2 * (ey - sy)")).alias("planar"), F.sum(term).alias("km2"))
    closed = rings.selectExpr("ctx", "part", "loop", "planar", "km2",
                              "concat(transform(pts, q -> q.p), array(pts[0].p)) AS ring_pts")
    return closed.groupBy("ctx", "part").agg(
        F.array(F.expr("transform(array_sort(collect_list(struct(planar <= 0 AS hole, loop, ring_pts))), r -> r.ring_pts)")
                ).alias("geometry"),
        F.sum("km2").alias("area_km2"))
