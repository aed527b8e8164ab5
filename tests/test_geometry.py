"""Overlay, location and validity against answers known by formula or by counting unit cells."""

import math
import random

from pyspark.sql import functions as F

from conftest import feature, rect
from geoledger.operators.edges import boundary_area, edge_table, exact_sum, feature_area_km2
from geoledger.operators.locate import point_status
from geoledger.operators.overlay import common_boundary, dissolve, prepared, subtract
from geoledger.operators.validity import bounds, invalid_features, overlapping_pairs
from geoledger.session import cut

SHAPES = "ctx string, fid string, geometry array<array<array<array<double>>>>"


def edges(spark, rows):
    df = spark.createDataFrame(rows, SHAPES)
    return cut(edge_table(df, F.col("ctx"), F.col("fid")))


def common(a, b):
    return common_boundary(prepared(a), prepared(b))


def planar(df, *keys):
    term = F.expr("(x1 + x2) / 2 * (y2 - y1)")
    area = F.sum(F.when(F.col("inl") == 1, term).otherwise(-term))
    return {tuple(r)[:-1]: r.area for r in df.groupBy(*keys).agg(area.alias("area")).collect()}


def test_equal_area_of_known_cell(spark):
    df = spark.createDataFrame([("c", "cell", rect(30, 48, 30.05, 48.05)), ("c", "none", [])], SHAPES)
    got = {r.fid: r.area_km2 for r in feature_area_km2(df, ["fid"]).collect()}
    assert abs(got["cell"] - 20.734109) < 1e-6
    assert got["none"] == 0


def test_rectangle_with_triangle_and_bar(spark):
    old = edges(spark, [("c", "o", rect(0, 0, 4, 4))])
    new = cut(dissolve(edges(spark, [("c", "n1", [[[[2.0, 0.0], [8.0, 0.0], [2.0, 6.0], [2.0, 0.0]]]]), ("c", "n2", rect(5, 0, 6, 3))])))
    assert abs(planar(common(new, old), "ctx")[("c",)] - 8) < 1e-9
    assert abs(planar(subtract(new, old), "ctx")[("c",)] - 10.5) < 1e-9
    assert abs(planar(subtract(old, new), "ctx")[("c",)] - 8) < 1e-9


def _cells(rects):
    return {(x, y) for x0, y0, x1, y1 in rects for x in range(x0, x1) for y in range(y0, y1)}


def test_random_rectangles_count_unit_cells(spark):
    rnd = random.Random(11)
    def some():
        out = []
        for _ in range(14):
            x, y = rnd.randint(0, 20), rnd.randint(0, 20)
            out.append((x, y, x + rnd.randint(1, 8), y + rnd.randint(1, 8)))
        return out
    problems = {f"p{i}": (some(), some()) for i in range(4)}
    left = edges(spark, [(p, f"a{i}", rect(*r)) for p, (a, _) in problems.items() for i, r in enumerate(a)])
    right = edges(spark, [(p, f"b{i}", rect(*r)) for p, (_, b) in problems.items() for i, r in enumerate(b)])
    da, db = cut(dissolve(left)), cut(dissolve(right))
    union, both, first = planar(da, "ctx"), planar(common(da, db), "ctx"), planar(subtract(da, db), "ctx")
    for p, (a, b) in problems.items():
        assert abs(union[(p,)] - len(_cells(a))) < 1e-6
        assert abs(both[(p,)] - len(_cells(a) & _cells(b))) < 1e-6
        assert abs(first[(p,)] - len(_cells(a) - _cells(b))) < 1e-6


def _convex(rnd, n=7):
    cx, cy = rnd.uniform(-1, 1), rnd.uniform(-1, 1)
    angles = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + 2 * math.cos(a), cy + 2 * math.sin(a)) for a in angles]


def _clip_area(p, q):
    """Area of the common part of two convex counter-clockwise polygons by half-plane clipping."""
    out = p
    for (ax, ay), (bx, by) in zip(q, q[1:] + q[:1]):
        side = lambda pt: (bx - ax) * (pt[1] - ay) - (by - ay) * (pt[0] - ax)
        nxt = []
        for s, e in zip(out, out[1:] + out[:1]):
            ds, de = side(s), side(e)
            if ds >= 0:
                nxt.append(s)
            if ds * de < 0:
                t = ds / (ds - de)
                nxt.append((s[0] + t * (e[0] - s[0]), s[1] + t * (e[1] - s[1])))
        out = nxt
        if not out:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, out[1:] + out[:1]))) / 2


def test_random_convex_polygons_against_clipping(spark):
    rnd = random.Random(5)
    pairs = {f"p{i}": (_convex(rnd), _convex(rnd)) for i in range(25)}
    ring = lambda p: [[[list(v) for v in p + p[:1]]]]
    a = edges(spark, [(k, "a", ring(p)) for k, (p, _) in pairs.items()])
    b = edges(spark, [(k, "b", ring(q)) for k, (_, q) in pairs.items()])
    both, first, whole = planar(common(a, b), "ctx"), planar(subtract(a, b), "ctx"), planar(a, "ctx")
    for k, (p, q) in pairs.items():
        want = _clip_area(p, q)
        assert abs(both.get((k,), 0.0) - want) < 1e-6, k
        assert abs(both.get((k,), 0.0) + first.get((k,), 0.0) - whole[(k,)]) < 1e-6, k


def _star(rnd, n=16):
    cx, cy = rnd.uniform(-1, 1), rnd.uniform(-1, 1)
    spikes = [(2 * math.pi * i / n, rnd.uniform(0.3, 3)) for i in range(n)]
    return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in spikes]


def test_concave_polygons_keep_the_area_identities(spark):
    """Stars against stars: common + rest = whole on both sides, and union = both wholes - common."""
    rnd = random.Random(9)
    pairs = {f"p{i}": (_star(rnd), _star(rnd, 23)) for i in range(12)}
    ring = lambda p: [[[list(v) for v in p + p[:1]]]]
    a = edges(spark, [(k, "a", ring(p)) for k, (p, _) in pairs.items()])
    b = edges(spark, [(k, "b", ring(q)) for k, (_, q) in pairs.items()])
    both, a_only, b_only = planar(common(a, b), "ctx"), planar(subtract(a, b), "ctx"), planar(subtract(b, a), "ctx")
    union = planar(dissolve(cut(a.unionByName(b))), "ctx")
    for k in [(k,) for k in pairs]:
        size = lambda p: sum(u[0] * v[1] - v[0] * u[1] for u, v in zip(p, p[1:] + p[:1])) / 2
        whole_a, whole_b = (size(p) for p in pairs[k[0]])
        assert abs(both[k] + a_only[k] - whole_a) < 1e-6 and abs(both[k] + b_only[k] - whole_b) < 1e-6
        assert abs(union[k] - (whole_a + whole_b - both[k])) < 1e-6


def test_identical_copies_and_shared_borders(spark):
    one = [("c", "a", rect(0, 0, 2, 2)), ("c", "b", rect(0, 0, 2, 2)), ("c", "d", rect(2, 0, 4, 2))]
    table = edges(spark, one)
    assert abs(planar(dissolve(table), "ctx")[("c",)] - 8) < 1e-9
    features = spark.createDataFrame(one, SHAPES).withColumnRenamed("fid", "id")
    found = {(r.left_id, r.right_id) for r in overlapping_pairs(features, 0.001).collect()}
    assert found == {("a", "b")}


def test_hole_border_and_contested_points(spark, features):
    holed = [[[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]], [[1.0, 1.0], [1.0, 3.0], [3.0, 3.0], [3.0, 1.0], [1.0, 1.0]]]]
    table = features([feature(1, "control_ua", holed), feature(2, "control_ru", rect(4, 0, 6, 4))])
    points = spark.createDataFrame([("2026-01-02", n, x, y) for n, x, y in (
        ("hole", 2.0, 2.0), ("hole border", 1.0, 2.0), ("inside", 0.5, 0.5), ("corner", 0.0, 0.0), ("shared", 4.0, 2.0), ("outside", 9.0, 9.0))],
        "ctx string, pid string, x double, y double")
    got = {r.pid: r.status for r in point_status(points, table).collect()}
    assert got == {"hole border": "control_ua", "inside": "control_ua", "corner": "control_ua", "shared": "contested"}


def test_validity_reasons_and_bounds(spark):
    hole = lambda x0, x1: [[x0, 1.0], [x0, 2.0], [x1, 2.0], [x1, 1.0], [x0, 1.0]]
    shell = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    rows = [
        ("bow", [[[[0.0, 0.0], [1.0, 1.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]]]),
        ("open", [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]]]),
        ("flat", [[[[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 0.0]]]]),
        ("hole outside", [[shell, hole(6.0, 7.0)]]),
        ("hole inside", [[shell, hole(1.0, 2.0)]]),
        ("touching parts", rect(0, 0, 1, 1) + rect(1, 1, 2, 2)),
        ("good", rect(0, 0, 1, 1)),
        ("nested shells", [[shell], [hole(1.0, 2.0)]]),
        ("island", [[shell, [[0.5, 0.5], [0.5, 3.5], [3.5, 3.5], [3.5, 0.5], [0.5, 0.5]]], [hole(1.0, 2.0)]]),
        ("nested holes", [[shell, [[0.5, 0.5], [0.5, 3.5], [3.5, 3.5], [3.5, 0.5], [0.5, 0.5]], hole(1.0, 2.0)]]),
        ("cut by one hole", [[shell, [[0.0, 2.0], [2.0, 3.0], [4.0, 2.0], [2.0, 1.0], [0.0, 2.0]]]]),
        ("cut by two holes", [[shell, [[0.0, 2.0], [1.0, 3.0], [2.0, 2.0], [1.0, 1.0], [0.0, 2.0]], [[2.0, 2.0], [3.0, 3.0], [4.0, 2.0], [3.0, 1.0], [2.0, 2.0]]]]),
        ("hole touches once", [[shell, [[0.0, 2.0], [1.0, 3.0], [2.0, 2.0], [1.0, 1.0], [0.0, 2.0]], [[2.0, 2.0], [3.0, 3.0], [3.5, 2.0], [3.0, 1.0], [2.0, 2.0]]]]),
    ]
    table = spark.createDataFrame([("c", i, g) for i, g in rows], "ctx string, id string, geometry array<array<array<array<double>>>>")
    reasons = {}
    for r in invalid_features(table).collect():
        reasons.setdefault(r.id, set()).add(r.reason)
    assert set(reasons) == {"bow", "open", "flat", "hole outside", "nested shells", "nested holes", "cut by one hole", "cut by two holes"}
    assert reasons["nested shells"] == {"nested shells"} and reasons["nested holes"] == {"nested holes"}
    assert reasons["cut by one hole"] == reasons["cut by two holes"] == {"interior is cut in two"}
    assert "self-intersection" in reasons["bow"] and "ring not closed" in reasons["open"]
    assert "hole lies outside shell" in reasons["hole outside"]
    box = bounds(table).filter("id = 'touching parts'").first()
    assert (box.minx, box.miny, box.maxx, box.maxy) == (0, 0, 2, 2)


def test_edge_area_matches_feature_area(spark):
    table = edges(spark, [("c", "x", rect(10, 50, 11, 51))])
    direct = feature_area_km2(spark.createDataFrame([("c", "x", rect(10, 50, 11, 51))], SHAPES), ["fid"]).first().area_km2
    assert abs(table.agg(boundary_area().alias("a")).first().a - direct) < 1e-9


def test_sums_do_not_hang_on_the_partitions(spark):
    """Equal bits over any number of partitions, where plain sums of doubles differ."""
    rows = spark.range(60_000).selectExpr("id % 7 AS k", "CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END * pow(10, id % 13 - 5) * (1 + rand(3)) AS v")
    rows = cut(rows)
    exact, plain = set(), set()
    for parts in (1, 8, 64):
        dealt = rows.repartition(parts, F.xxhash64("v", F.lit(parts)))
        both = {r.k: (r.e, r.p) for r in dealt.groupBy("k").agg(exact_sum(F.col("v")).alias("e"), F.sum("v").alias("p")).collect()}
        exact.add(tuple(both[k][0].hex() for k in sorted(both)))
        plain.add(tuple(both[k][1].hex() for k in sorted(both)))
        assert all(abs(e - p) <= 1e-6 for e, p in both.values())
    assert len(exact) == 1 and len(plain) > 1
    edge = spark.createDataFrame([("c", "cell", rect(30, 48, 30.05, 48.05))], SHAPES)
    assert len({feature_area_km2(edge.repartition(n), ["fid"]).first().area_km2.hex() for n in (1, 8)}) == 1
    tiny = spark.createDataFrame([("c", "tiny", rect(30, 48, 30.000001, 48.000001))], SHAPES)
    assert 0 < feature_area_km2(tiny, ["fid"]).first().area_km2 < 1e-6
    assert spark.range(0).agg(exact_sum(F.col("id").cast("double")).alias("e")).first().e is None
