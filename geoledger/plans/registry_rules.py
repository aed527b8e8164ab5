"""Rules over the public registries. Each rule yields (collection, ordinal, rule, message) rows; none means accepted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoledger import vocab
from geoledger.functions.values import absent, https_with_host
from geoledger.operators.merges import duplicates, unknown_members
from geoledger.session import cut

COLUMNS = ("collection", "ordinal", "rule", "message")


def _rows(df: DataFrame, collection: str, rule: str, message: Column) -> DataFrame:
    ordinal = F.col("ordinal") if "ordinal" in df.columns else F.lit(None).cast("bigint")
    return df.select(F.lit(collection).alias("collection"), ordinal.cast("bigint").alias("ordinal"), F.lit(rule).alias("rule"),
                     message.alias("message"))


def _per_row(df: DataFrame, collection: str, checks: list[tuple[str, Column, str]],
             fields: tuple[str, list[Column]]) -> DataFrame:
    """All single-row rules of a table in one pass over it."""
    rule, missing = fields
    hits = [F.when(bad, F.struct(F.lit(name).alias("rule"), F.lit(text).alias("message"))) for name, bad, text in checks]
    hits += [F.when(m.isNotNull(), F.struct(F.lit(rule).alias("rule"), F.concat(F.lit("missing "), m).alias("message")))
             for m in missing]
    found = df.select("ordinal", F.explode(F.array_compact(F.array(*hits))).alias("v"))
    return found.select(F.lit(collection).alias("collection"), F.col("ordinal").cast("bigint").alias("ordinal"), "v.rule", "v.message")


def _missing(fields: tuple[str, ...]) -> list[Column]:
    return [F.when(absent(F.col(f)), F.lit(f)) for f in fields]


def _outside(column: str, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))


def _any(df: DataFrame) -> DataFrame:
    """One row when ``df`` has any, else none: these rules speak about the table, not about a row."""
    return df.agg(F.count(F.lit(1)).alias("found")).filter("found > 0")


def _repeated(df: DataFrame, key: str, collection: str, rule: str, message: str) -> DataFrame:
    return _rows(_any(duplicates(df, key)), collection, rule, F.lit(message))


def source_rules(sources: DataFrame, sides: tuple[str, ...] = vocab.SIDES) -> DataFrame:
    per_row = _per_row(sources, "sources", [
        ("V-D4", _outside("side", sides), "invalid side"),
        ("V-D5", ~https_with_host(F.col("url")), "url must be HTTPS"),
    ], ("V-D3", _missing(vocab.SOURCE_FIELDS)))
    return per_row.unionByName(_repeated(sources, "id", "sources", "V-D1", "duplicate ids"))


def evidence_rules(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    per_row = _per_row(evidence, "evidence", [
        ("V-D8", ~https_with_host(F.col("url")), "url must be HTTPS"),
    ], ("V-D6", _missing(vocab.EVIDENCE_FIELDS)))
    unknown = evidence.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    return per_row.unionByName(_rows(unknown, "evidence", "V-D7", F.lit("unknown source_id"))).unionByName(
        _repeated(evidence, "id", "evidence", "V-D2", "duplicate ids"))


def event_rules(events: DataFrame, collection: str, sources: DataFrame, evidence: DataFrame,
                statuses: tuple[str, ...] = vocab.EVENT_STATUSES) -> DataFrame:
    missing = _missing(vocab.EVENT_TEXT_FIELDS) + [
        F.when(F.col(f).isNull(), F.lit(f)) for f in vocab.EVENT_ARRAY_FIELDS]
    per_row = _per_row(events, collection, [
        ("V-D10", _outside("verification_status", statuses), "invalid verification_status"),
    ], ("V-D9", missing))
    listed = F.array_join("unknown", ", ")
    no_source = unknown_members(events, ["ordinal"], "source_ids", sources)
    no_evidence = unknown_members(events, ["ordinal"], "evidence_ids", evidence)
    return per_row.unionByName(_rows(no_source, collection, "V-D11", F.concat(F.lit("unknown sources "), listed))).unionByName(
        _rows(no_evidence, collection, "V-D12", F.concat(F.lit("unknown evidence "), listed)))


def manifest_rules(manifest: DataFrame) -> DataFrame:
    """Dates unique and newest first, in the order of the ordinals, which may have gaps.

    Neighbours are compared within ranges of ordinals, and the last row of each range with the first one of the next.
    """
    ranges = cut(manifest.select("ordinal", "date").repartitionByRange("ordinal").withColumn("_range", F.spark_partition_id()))
    later = lambda over: F.lead("date").over(over).alias("_later")
    numbered = ranges.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy("ordinal")))
    inner = numbered.select("date", later(Window.partitionBy("_range").orderBy("_n")))
    end = lambda pick: pick(F.struct("date"), "_n")["date"]
    ends = numbered.groupBy("_range").agg(end(F.min_by).alias("_first"), end(F.max_by).alias("date"))  # one row a range
    outer = ends.select("date", F.lead("_first").over(Window.orderBy("_range")).alias("_later"))
    rising = _any(inner.unionByName(outer).filter(F.col("_later") > F.col("date")))
    return _rows(rising, "manifest", "V-D15", F.lit("dates must be reverse chronological")).unionByName(
        _repeated(manifest, "date", "manifest", "V-D14", "duplicate dates"))


def validate_registry(sources: DataFrame, evidence: DataFrame, events: DataFrame, claims: DataFrame,
                      manifest: DataFrame) -> DataFrame:
    parts = [source_rules(sources), evidence_rules(evidence, sources), event_rules(events, "events", sources, evidence),
             event_rules(claims, "claims", sources, evidence), manifest_rules(manifest)]
    return reduce(DataFrame.unionByName, parts)
