"""Cylindrical equal-area projection (WGS84, standard parallel 30 degrees) as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and the standard parallel of EPSG:6933.
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563
STANDARD_PARALLEL_DEG = 30.0

E2 = FLATTENING * (2 - FLATTENING)
E1 = math.sqrt(E2)
_SIN0 = math.sin(math.radians(STANDARD_PARALLEL_DEG))
K0 = math.cos(math.radians(STANDARD_PARALLEL_DEG)) / math.sqrt(1 - E2 * _SIN0 * _SIN0)


def project_x(lon: Column) -> Column:
    return F.radians(lon) * F.lit(SEMI_MAJOR_M * K0)


def project_y(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    es = s * F.lit(E1)
    q = F.lit(1 - E2) * (s / (F.lit(1.0) - es * es) - F.log((F.lit(1.0) - es) / (F.lit(1.0) + es)) / F.lit(2 * E1))
    return q * F.lit(SEMI_MAJOR_M / (2 * K0))


def edge_area_km2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Shoelace term of one projected edge, in square kilometres, positive when the region is on its left."""
    return (project_x(x1) + project_x(x2)) / 2 * (project_y(y2) - project_y(y1)) / F.lit(1e6)


# The same projection for DuckDB, used by the checking SQL only.
SQL_PROJECT_Y = (
    "({q}) * " + repr(SEMI_MAJOR_M / (2 * K0))
).format(
    q=f"{1 - E2!r} * (sin(radians($lat)) / (1 - {E2!r} * sin(radians($lat)) * sin(radians($lat)))"
    f" - ln((1 - {E1!r} * sin(radians($lat))) / (1 + {E1!r} * sin(radians($lat)))) / {2 * E1!r})"
)
SQL_METRES_PER_LON_DEGREE = math.radians(1.0) * SEMI_MAJOR_M * K0
