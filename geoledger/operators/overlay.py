"""Polygon overlay on edge tables.

The boundary of any Boolean combination of regions is made of pieces of the input boundaries. So: cut each edge
where the other regions' edges cross or touch it, ask for the middle of every piece whether the other regions lie
on its left and on its right, and keep the pieces where the answer of the combination differs between both sides.
Everything is a join on (region, band); no region is ever gathered in one task. Regions go by numbers, which take less room than names
and sort faster; results of pairs get their names back when they have been summed up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoledger.operators.candidates import box_pairs
from geoledger.operators.edges import (
    SNAP_PER_DEGREE, TOUCH_DEG, band_sql, in_bands, region_stats, sheared_sql, with_region,
)
from geoledger.session import cut_spread as cut, spread

EDGE_KEY = ["x1", "y1", "x2", "y2"]
BOX = ["minx", "maxx", "miny", "maxy"]
BAND = ["vmin", "vmax", "nb"]


def _off_line(p: str, a: str, b: str) -> str:
    """SQL: signed distance of point p from the line a-b, positive on its left."""
    return (f"(({b[0]} - {a[0]}) * ({p[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({p[0]} - {a[0]}))"
            f" / sqrt(({b[0]} - {a[0]}) * ({b[0]} - {a[0]}) + ({b[1]} - {a[1]}) * ({b[1]} - {a[1]}))")


def _along(p: str, a: str, b: str) -> str:
    """SQL: position of the foot of p on a-b, 0 at a and 1 at b."""
    return (f"(({p[0]} - {a[0]}) * ({b[0]} - {a[0]}) + ({p[1]} - {a[1]}) * ({b[1]} - {a[1]}))"
            f" / (({b[0]} - {a[0]}) * ({b[0]} - {a[0]}) + ({b[1]} - {a[1]}) * ({b[1]} - {a[1]}))")


_P1, _P2, _Q1, _Q2 = ("x1", "y1"), ("x2", "y2"), ("qx1", "qy1"), ("qx2", "qy2")
# Distance from the other segment's line, and position along it, of each end of two segments p and q.
_TERMS = {
    "dq1": _off_line(_Q1, _P1, _P2), "dq2": _off_line(_Q2, _P1, _P2),
    "dp1": _off_line(_P1, _Q1, _Q2), "dp2": _off_line(_P2, _Q1, _Q2),
    "tq1": _along(_Q1, _P1, _P2), "tq2": _along(_Q2, _P1, _P2),
    "tp1": _along(_P1, _Q1, _Q2), "tp2": _along(_P2, _Q1, _Q2),
}
_APART = "(({0} > {eps} AND {1} < -{eps}) OR ({0} < -{eps} AND {1} > {eps}))"
PROPER_CROSSING = (_APART.format("dq1", "dq2", eps=TOUCH_DEG) + " AND " + _APART.format("dp1", "dp2", eps=TOUCH_DEG))
SEGMENTS_MEET = f"({PROPER_CROSSING})" + "".join(
    f" OR (abs(d{e}) <= {TOUCH_DEG} AND t{e} BETWEEN 0 AND 1)" for e in ("q1", "q2", "p1", "p2"))


def with_segment_terms(pairs: DataFrame) -> DataFrame:
    return pairs.selectExpr("*", *[f"{sql} AS {name}" for name, sql in _TERMS.items()])


def with_cut_points(pairs: DataFrame) -> DataFrame:
    """One row per point (0 to 3 per pair) at which segment q cuts the inside of segment p: adds nx, ny."""
    def end(e: str) -> str:
        return (f"CASE WHEN abs(d{e}) <= {TOUCH_DEG} AND t{e} > 0 AND t{e} < 1"
                f" THEN named_struct('x', q{'x' + e[1]}, 'y', q{'y' + e[1]}) END")
    # The crossing is computed along the smaller of both segments, so that cutting p and cutting q give one point.
    turn = "nullif((x2 - x1) * (qy2 - qy1) - (y2 - y1) * (qx2 - qx1), 0)"
    crossed = with_segment_terms(pairs).selectExpr(
        "*", f"({PROPER_CROSSING}) AS _x", "struct(x1, y1, x2, y2) < struct(qx1, qy1, qx2, qy2) AS _p_first",
        f"((qx1 - x1) * (qy2 - qy1) - (qy1 - y1) * (qx2 - qx1)) / {turn} AS _tp",
        f"((x1 - qx1) * (y2 - y1) - (y1 - qy1) * (x2 - x1)) / -{turn} AS _tq")
    point = ("CASE WHEN _x AND _p_first THEN named_struct('x', x1 + _tp * (x2 - x1), 'y', y1 + _tp * (y2 - y1))"
             " WHEN _x THEN named_struct('x', qx1 + _tq * (qx2 - qx1), 'y', qy1 + _tq * (qy2 - qy1)) END")
    scale = SNAP_PER_DEGREE
    rounded = f"named_struct('x', rint(_c.x * {scale}) / {scale}, 'y', rint(_c.y * {scale}) / {scale})"
    cuts = crossed.selectExpr("*", f"{point} AS _c").selectExpr(
        "*", f"explode(array_compact(array({end('q1')}, {end('q2')}, CASE WHEN _x THEN {rounded} END))) AS _p")
    return cuts.selectExpr("*", "_p.x AS nx", "_p.y AS ny")


MEETS_BOX = (f"least(x1, x2) <= maxx + {TOUCH_DEG} AND greatest(x1, x2) >= minx - {TOUCH_DEG}"
             f" AND least(y1, y2) <= maxy + {TOUCH_DEG} AND greatest(y1, y2) >= miny - {TOUCH_DEG}")


def to_bands(edges: DataFrame) -> DataFrame:
    """Copy rows with x1..y2 and the other region's vmin, vmax, nb into the bands they touch."""
    reach = edges.selectExpr("*", f"{sheared_sql('x1', 'y1')} - {2 * TOUCH_DEG} AS _lo",
                             f"{sheared_sql('x2', 'y2')} + {2 * TOUCH_DEG} AS _hi").filter("_hi >= vmin AND _lo <= vmax")
    return reach.selectExpr("*", f"explode(sequence({band_sql('_lo')}, {band_sql('_hi')})) AS band")


def near_segments(cand: DataFrame, index: DataFrame) -> DataFrame:
    """Join candidate edges (bid, x1..y2, band columns) with the indexed edges whose boxes they meet."""
    return to_bands(cand).join(index, ["bid", "band"]).filter(
        f"least(x1, x2) <= greatest(qx1, qx2) + {TOUCH_DEG} AND greatest(x1, x2) >= least(qx1, qx2) - {TOUCH_DEG}"
        " AND _lo <= qv2 AND _hi >= qv1")


def cut_edges(edges: DataFrame, cuts: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Split edges at cut points. ``keys`` name one edge; pieces replace x1..y2, ``keep`` columns stay."""
    ends = edges.selectExpr(*keys, *keep, "x1 AS nx", "y1 AS ny")
    order = Window.partitionBy(*keys).orderBy(F.expr(sheared_sql("nx", "ny")), "nx")
    pieces = ends.unionByName(cuts.select(*keys, *keep, "nx", "ny")).withColumn(
        "_next", F.lead(F.struct("nx", "ny")).over(order))
    other = [k for k in keys if k not in EDGE_KEY]
    moved = pieces.selectExpr(*other, *keep, "nx", "ny", "coalesce(_next.nx, x2) AS ex", "coalesce(_next.ny, y2) AS ey")
    return moved.filter("nx <> ex OR ny <> ey").selectExpr(*other, *keep, "nx AS x1", "ny AS y1", "ex AS x2", "ey AS y2")


def sides_of_pieces(pieces: DataFrame, index: DataFrame, keys: list[str], together: tuple[str, ...] = ()) -> DataFrame:
    """bid, ``keys``, l, r (region bid left / right of the piece, 0 or 1) and hit (the piece lies on its boundary) of the pieces
    that lie in or on the region; those outside have no row.

    ``pieces`` carry bid, vmin, vmax, nb and x1..y2; ``keys`` tell them apart. Rows with equal ``together`` (some of ``keys``)
    are brought to one partition, so that the caller can go on grouping by them there.
    """
    probe = pieces.selectExpr("bid", *keys, *BAND, "(x1 + x2) / 2 AS mx", "(y1 + y2) / 2 AS my").selectExpr(
        "bid", *keys, *BAND, "mx", "my", f"{sheared_sql('mx', 'my')} AS vm").selectExpr(
        "bid", *keys, "mx", "my", "vm", f"{band_sql('vm')} AS band")
    # Edges right of the middle say nothing.
    met = probe.join(index, ["bid", "band"]).filter(f"qv1 <= vm AND vm < qv2 AND least(qx1, qx2) <= mx + {TOUCH_DEG}")
    off = met.selectExpr("bid", *keys, _off_line(("mx", "my"), _Q1, _Q2) + " AS _off").filter(f"_off <= {TOUCH_DEG}").selectExpr(
        "bid", *keys, f"_off < -{TOUCH_DEG} AS _left")
    if together:
        off = off.repartition(*together)
    grouped = off.groupBy("bid", *keys).agg(F.expr("count_if(_left)").alias("_c"), F.expr("count_if(NOT _left)").alias("_on"))
    return grouped.selectExpr("bid", *keys, "CAST(_c % 2 AS int) AS l", "CAST((_c + _on) % 2 AS int) AS r", "_on > 0 AS hit")


# Edges of one region are handled in spatial chunks of about this many, so that a huge region meets a small one only
# with the edges nearby.
CHUNK_EDGES = 64


@dataclass
class Regions:
    """An edge table written down once, with the extent and band index of its regions, which go by numbers."""

    edges: DataFrame  # ctx, aid, chunk, x1..y2, inl and extra columns
    stats: DataFrame  # ctx, fid, rid (the number) and what ``region_stats`` tells
    index: DataFrame  # bid, band, qx1..qy2, qv1, qv2
    own: DataFrame    # ctx, bid, x1..y2, vmin, vmax, nb: each edge with the bands of its own region

    def named(self, df: DataFrame, number: str, name: str) -> DataFrame:
        """``df`` with the name of the region in column ``number`` instead of its number."""
        return df.join(self.stats.selectExpr(f"rid AS {number}", f"fid AS {name}"), number).drop(number)


def prepared(edges: DataFrame, flags: tuple[str, ...] = ()) -> Regions:
    """``edges`` should already be cut: they are read several times. ``flags`` are boolean columns of whole regions."""
    stats = cut(cut(region_stats(edges, flags)).orderBy("ctx", "fid").withColumn("rid", F.monotonically_increasing_id()))  # in the order of names
    parts = f"greatest(1, CAST(ceil(sqrt(n / {CHUNK_EDGES})) AS bigint))"
    def step(axis: str) -> str:
        mid = f"({axis}1 + {axis}2) / 2"
        return f"least(_g - 1, CAST(floor(({mid} - min{axis}) / greatest(max{axis} - min{axis}, 1e-12) * _g) AS bigint))"
    sized = with_region(edges, stats.selectExpr("ctx", "fid", "rid AS aid", *BOX, *BAND, f"{parts} AS _g"))
    placed = cut(sized.selectExpr("*", f"{step('x')} * _g + {step('y')} AS chunk").drop("fid", *BOX, "_g"))
    return Regions(placed.drop(*BAND), stats, spread(in_bands(placed, "aid AS bid")), placed.selectExpr("ctx", "aid AS bid", *EDGE_KEY, *BAND))


def partners(a: Regions, b: Regions, where: str = "true", flags: tuple[str, ...] = ()) -> DataFrame:
    """(aid, chunk, bid, extent, bands and ``flags`` of b) for chunks of a's edges whose box meets the box of a region b."""
    boxes = cut(a.edges.groupBy("ctx", "aid", "chunk").agg(
        F.expr("min(least(x1, x2))").alias("minx"), F.expr("max(greatest(x1, x2))").alias("maxx"),
        F.expr("min(least(y1, y2))").alias("miny"), F.expr("max(greatest(y1, y2))").alias("maxy")))
    others = b.stats.withColumnRenamed("rid", "bid")
    met = box_pairs(boxes, others, ["aid", "chunk"], ["bid"]).filter(where).drop("ctx")
    return cut(met.join(others.selectExpr("bid", *BOX, *BAND, *[f"{f} AS b_{f}" for f in flags]), "bid"))


def near_edges(a: Regions, pairs: DataFrame) -> DataFrame:
    """Edges of a with each region b they may touch."""
    return a.edges.join(pairs, ["aid", "chunk"]).filter(MEETS_BOX)


def common_boundary(a: Regions, b: Regions, where: str = "true") -> DataFrame:
    """Boundary edges of ``a and b`` for every pair of regions with equal ctx: ctx, aid, bid (numbers), x1..y2, inl."""
    keys = ["aid", "bid", *EDGE_KEY]
    def inside(src: Regions, dst: Regions, condition: str) -> DataFrame:
        cand = near_edges(src, partners(src, dst, condition)).select("ctx", *keys, "inl", *BAND)
        cuts = with_cut_points(near_segments(cand, dst.index)).select("ctx", *keys, *BAND, "inl", "nx", "ny")
        pieces = cut(cut_edges(cand, cuts, keys, ["ctx", *BAND, "inl"]))
        sides = sides_of_pieces(pieces, dst.index, ["ctx", "aid", *EDGE_KEY, "inl"])
        marked = sides.selectExpr("ctx", "aid", "bid", *EDGE_KEY, "hit", "inl = 1 AND l = 1 AS _l", "inl = 0 AND r = 1 AS _r")
        return marked.filter("_l <> _r").selectExpr("ctx", "aid", "bid", *EDGE_KEY, "CAST(_l AS int) AS inl", "hit")
    swapped = where.replace("aid", "_").replace("bid", "aid").replace("_", "bid")
    of_b = inside(b, a, swapped).filter("NOT hit")  # shared pieces were counted with a
    of_b = of_b.selectExpr("ctx", "bid AS aid", "aid AS bid", *EDGE_KEY, "inl")
    return inside(a, b, where).drop("hit").unionByName(of_b)


LAYERS = ("in_a", "in_b")


def sided_pieces(edges: DataFrame) -> DataFrame:
    """Cut all edges of a ctx at each other and tell, per piece, which layers lie left and right of it.

    ``edges`` carry booleans ``in_a``, ``in_b``: whether the region belongs to the first, to the second layer, or to both. Result:
    ctx, x1..y2, a_l, a_r, b_l, b_r (union of the first and of the second layer); coincident pieces appear once.
    """
    regions = prepared(edges, LAYERS)
    pairs = partners(regions, regions, "aid <> bid", LAYERS)
    cand = near_edges(regions, pairs)
    keys = ["aid", *EDGE_KEY]
    extra = ["ctx", "inl", *LAYERS, "chunk"]
    cuts = with_cut_points(near_segments(cand, regions.index)).select(*keys, *extra, "nx", "ny")
    pieces = cut(cut_edges(regions.edges, cuts, keys, extra).withColumn("piece", F.monotonically_increasing_id()))
    near = pieces.drop("ctx", "inl", *LAYERS).join(pairs, ["aid", "chunk"]).filter(MEETS_BOX)
    sides = sides_of_pieces(near, regions.index, ["piece", "aid", "b_in_a", "b_in_b"], ("piece",))
    seen = sides.groupBy("piece").agg(
        *[F.expr(f"bool_or({side} = 1 AND b_in_{layer})").alias(f"{layer}_{side}") for layer in "ab" for side in "lr"],
        F.expr("bool_or(hit AND bid < aid)").alias("copy"))
    joined = pieces.join(seen, "piece", "left").filter("NOT coalesce(copy, false)")
    return joined.selectExpr("ctx", *EDGE_KEY, *[
        f"coalesce({layer}_{side}, false) OR (in_{layer} AND inl = {inl}) AS {layer}_{side}" for layer in "ab" for side, inl in (("l", 1), ("r", 0))])


def boundary_of(pieces: DataFrame, combination: str) -> DataFrame:
    """Boundary (ctx, x1..y2, inl) of a combination of the layers, such as ``a AND NOT b``."""
    def on(side: str) -> str:
        return " ".join(f"{w}_{side}" if w in ("a", "b") else w for w in combination.split())
    marked = pieces.selectExpr("ctx", *EDGE_KEY, f"({on('l')}) AS _l", f"({on('r')}) AS _r").filter("_l <> _r")
    return marked.selectExpr("ctx", *EDGE_KEY, "CAST(_l AS int) AS inl")


def dissolve(edges: DataFrame, fid: str = "all") -> DataFrame:
    """Union of all regions of one ctx, as the edge table of a single region."""
    pieces = sided_pieces(edges.withColumns({"in_a": F.lit(True), "in_b": F.lit(False)}))
    return boundary_of(pieces, "a").select("ctx", F.lit(fid).alias("fid"), *EDGE_KEY, "inl")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of the regions of a without the union of the regions of b, per ctx: ctx, x1..y2, inl."""
    tagged = lambda df, mark: df.select(
        "ctx", F.concat(F.lit(mark), "fid").alias("fid"), *EDGE_KEY, "inl", F.lit(mark == "a").alias("in_a"), F.lit(mark == "b").alias("in_b"))
    return boundary_of(sided_pieces(cut(tagged(a, "a").unionByName(tagged(b, "b")))), "a AND NOT b")
