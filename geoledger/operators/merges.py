"""Set operations on keyed tables. Winners are chosen by aggregates, so hot keys are combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: list[str], order: Column, last: bool) -> DataFrame:
    """One whole row per key: the last (or first) in the given order."""
    whole = F.struct(*df.columns)
    chosen = (F.max_by if last else F.min_by)(whole, order)
    return df.groupBy(*keys).agg(chosen.alias("_row")).select("_row.*")


def first_match(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """First row of each id in table order, as a lookup by id would find it."""
    return pick(df, [key], F.col(ordinal), last=False)


def keyed_merge(existing: DataFrame, incoming: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of both tables by key: the last one wins and takes the place of the first (column ``position``)."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)))
    whole = F.struct(*[c for c in both.columns if c not in ("_batch", position)])
    order = F.struct("_batch", position)
    merged = both.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, order).alias("_row"), F.min(order).alias("_first"))
    return merged.select("_row.*", F.col("_first._batch").alias("batch"), F.col(f"_first.{position}").alias(position))


def replace_source(existing: DataFrame, incoming: DataFrame, source_id: str, column: str = "source_id") -> DataFrame:
    """Drop this source's rows and append the new batch. Array columns are tested for membership."""
    is_array = dict(existing.dtypes)[column].startswith("array")
    own = F.array_contains(column, F.lit(source_id)) if is_array else F.col(column) == source_id
    return existing.filter(~F.coalesce(own, F.lit(False))).unionByName(incoming, allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows whose key is not among the incoming ones, plus the incoming rows."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def single_row(df: DataFrame) -> DataFrame:
    """The only row of ``df``, or none; more than one stops the run instead of picking any of them."""
    counted = df.agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*df.columns)).alias("_row")).filter("_n > 0")
    sole = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit("expected one row, found more")).cast(counted.schema["_row"].dataType))
    return counted.select(sole.alias("_row")).select("_row.*")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, occurrences) of keys seen more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def later_occurrences(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Every occurrence of a key after the first."""
    first = df.groupBy(key).agg(F.min(ordinal).alias("_first"))
    return df.join(first, key).filter(F.col(ordinal) > F.col("_first")).drop("_first")


def unknown_members(df: DataFrame, row_keys: list[str], array_col: str, known: DataFrame, known_id: str = "id") -> DataFrame:
    """(row keys, unknown): sorted distinct array members that the registry does not hold."""
    exploded = df.select(*row_keys, F.explode(F.array_distinct(array_col)).alias("_id"))  # row keys are unique
    missing = exploded.join(known.select(F.col(known_id).alias("_id")), "_id", "left_anti")
    return missing.groupBy(*row_keys).agg(F.sort_array(F.collect_list("_id")).alias("unknown"))


def alias_set(*names: Column) -> Column:
    """Distinct non-empty names, sorted."""
    return F.sort_array(F.array_except(F.array_distinct(F.array_compact(F.array(*names))), F.array(F.lit(""))))
