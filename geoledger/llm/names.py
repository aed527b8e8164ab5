"""Column names that cannot clash with those of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare_name(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``df`` has that name in any letter case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
