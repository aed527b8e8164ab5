"""Pairs of boxes (or points and boxes) that meet, as one equi-join on grid cells of several sizes.

Each box is *native* to the finest grid whose cell is at least as large as the box, so it covers at most four
cells there, and *visits* the coarser grids to which some box of the other side is native. A pair is matched on the coarser of its two native grids, and
reported only from the cell that holds the lower-left corner of the common part: no distinct step is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.operators.edges import TOUCH_DEG
from geoledger.session import spread

# Cell sizes in degrees from coarse to fine; the first one holds the whole globe.
CELL_DEGREES = (512.0, 64.0, 16.0, 4.0, 1.0, 0.25, 0.0625, 0.015625)
_SIZES = "array(" + ", ".join(f"CAST({s} AS double)" for s in CELL_DEGREES) + ")"
_FINEST = len(CELL_DEGREES) - 1
_NATIVE = "CASE " + " ".join(
    f"WHEN _extent <= {CELL_DEGREES[i]} THEN {i}" for i in range(_FINEST, 0, -1)) + " ELSE 0 END"


def _cells(boxes: DataFrame, keep: list[str], prefix: str, point: bool) -> DataFrame:
    """Grid cells of boxes with columns minx..maxy; points visit every grid and are native to none."""
    named = boxes.selectExpr(
        "ctx", *keep, f"minx - {TOUCH_DEG} AS {prefix}minx", f"maxx + {TOUCH_DEG} AS {prefix}maxx",
        f"miny - {TOUCH_DEG} AS {prefix}miny", f"maxy + {TOUCH_DEG} AS {prefix}maxy")
    extent = f"greatest({prefix}maxx - {prefix}minx, {prefix}maxy - {prefix}miny)"
    sized = named.selectExpr("*", f"{extent} AS _extent")
    sized = sized.selectExpr("*", f"{_FINEST + 1 if point else _NATIVE} AS {prefix}n").drop("_extent")
    leveled = sized.selectExpr("*", f"explode(sequence(0, least({prefix}n, {_FINEST}))) AS _level")
    leveled = leveled.selectExpr("*", f"element_at({_SIZES}, _level + 1) AS {prefix}size")
    def span(axis: str) -> str:
        lo, hi, size = f"{prefix}min{axis}", f"{prefix}max{axis}", f"{prefix}size"
        return f"explode(sequence(floor({lo} / {size}), floor({hi} / {size}))) AS _c{axis}"
    return leveled.selectExpr("*", span("x")).selectExpr("*", span("y"))


def _native_levels(boxes: DataFrame) -> list[int]:
    """The grids to which some box is native: at most one row for each grid."""
    grown = boxes.selectExpr(f"greatest((maxx + {TOUCH_DEG}) - (minx - {TOUCH_DEG}), (maxy + {TOUCH_DEG}) - (miny - {TOUCH_DEG})) AS _extent")
    return [r[0] for r in grown.selectExpr(f"{_NATIVE} AS n").distinct().collect()]


def box_pairs(left: DataFrame, right: DataFrame, left_keep: list[str], right_keep: list[str],
              left_points: bool = False) -> DataFrame:
    """Pairs of rows with equal ``ctx`` whose boxes meet (touching included).

    Both inputs carry ctx, minx, maxx, miny, maxy; kept columns must not clash.
    """
    a, b = _cells(left, left_keep, "_a", left_points), _cells(right, right_keep, "_b", False)
    keys = ["_cx", "_cy", "_level", "ctx"]  # numbers first: they are faster to sort
    # One side is always native, so boxes that merely share a coarse cell never meet in the join.
    joined = a.filter("_level < _an").filter(F.col("_level").isin(_native_levels(right))).join(spread(b.filter("_level = _bn")), keys)
    if not left_points:
        visiting = b.filter("_level <= _bn").filter(F.col("_level").isin(_native_levels(left)))
        joined = joined.unionByName(a.filter("_level = _an").join(spread(visiting), keys))
    meet = ("_aminx <= _bmaxx AND _bminx <= _amaxx AND _aminy <= _bmaxy AND _bminy <= _amaxy"
            " AND _cx = floor(greatest(_aminx, _bminx) / _asize) AND _cy = floor(greatest(_aminy, _bminy) / _asize)")
    return spread(joined.filter(meet).select("ctx", *left_keep, *right_keep))
