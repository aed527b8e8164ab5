"""Vector columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_length(df: DataFrame, column: str = "embedding") -> int:
    """The length that most vectors without null or non-finite entries have (of equal numbers the smallest); 0 without any."""
    x = F.col(column)
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    sizes = df.where(x.isNotNull() & whole & (F.size(x) > 0)).groupBy(F.size(x).alias("length")).count()
    row = sizes.orderBy(F.desc("count"), "length").first()
    return row.length if row else 0


def matrix(batch: pa.RecordBatch, dimension: int, limit: float, column: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """The batch's rows with a vector of ``dimension`` finite entries below ``limit`` in size, and those vectors as doubles."""
    lists = batch.column(batch.schema.get_field_index(column))
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), dimension), False).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(lists.take(pa.array(rows)))
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension)  # null entries become not-a-number
    with np.errstate(invalid="ignore"):
        good = (np.abs(values) < limit).all(axis=1)
    return (rows, values) if good.all() else (rows[good], values[good])
