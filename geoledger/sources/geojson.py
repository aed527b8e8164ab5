"""Snapshots as GeoJSON: documents to feature rows and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger import schemas
from geoledger.session import cut
from geoledger.sources.jsonsplit import SKELETON_SHOWN, read_json_objects


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; unreadable files keep their text in ``_corrupt`` and become rule failures."""
    reader = spark.read.schema(schemas.SNAPSHOT_DOCUMENT).option("multiLine", True)
    parsed = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return cut(parsed.withColumn("document", F.col("_metadata.file_path")))  # parsed once, read by every rule


@dataclass
class Collection:
    """Snapshots read by many tasks. ``documents``: one row a file as ``read_snapshot`` gives it, without the features but
    with their number; ``features``: rows as ``feature_rows`` gives them, of the readable files."""

    documents: DataFrame
    features: DataFrame


def read_collection(spark: SparkSession, path: str) -> Collection:
    """Feature collections of any size. A file whose structure or any of whose features cannot be read is one row with its
    beginning in ``_corrupt`` and has no features. An empty file has no row."""
    read = read_json_objects(spark, path, "features")
    permissive = {"columnNameOfCorruptRecord": "_bad"}
    feature = "type string, properties string, geometry struct<type:string,coordinates:string>, _bad string"
    parsed = cut(read.objects.select(F.col("path").alias("document"), "idx", F.from_json("text", feature, permissive).alias("f")))
    head = ("type string, metadata struct<snapshot_date:string,methodology_version:string,moderation_status:string>, features array<string>, _bad string")
    broken = parsed.where("f._bad IS NOT NULL").select("document").distinct().withColumn("_broken", F.lit(True))
    documents = read.files.select(F.col("path").alias("document"), "objects", "fault", "skeleton", F.from_json("skeleton", head, permissive).alias("h")).join(broken, "document", "left")
    # the skeleton's own array holds what is no object
    unreadable = F.col("fault") | F.coalesce("_broken", F.lit(False)) | F.col("h").isNull() | F.col("h._bad").isNotNull() | (F.coalesce(F.size("h.features"), F.lit(0)) > 0)
    documents = cut(documents.select(
        "document", F.when(~unreadable, F.col("h.type")).alias("type"), F.when(~unreadable, F.col("h.metadata")).alias("metadata"),
        F.when(~unreadable, F.col("h.features")).alias("features"), F.when(~unreadable, F.col("objects")).alias("feature_count"),
        F.when(unreadable, F.substring("skeleton", 1, SKELETON_SHOWN)).alias("_corrupt")))
    readable = documents.where("_corrupt IS NULL").select("document", F.col("metadata.snapshot_date").alias("snapshot_date"))
    rows = parsed.join(readable, "document").select(
        "document", "snapshot_date", "idx", F.col("f.properties").alias("properties_text"), F.col("f.geometry.type").alias("geometry_type"),
        F.col("f.geometry.coordinates").alias("coordinates"), F.from_json("f.properties", schemas.FEATURE_PROPERTIES).alias("p"))
    features = rows.select("document", "snapshot_date", "idx", "properties_text", "geometry_type", "coordinates", "p.*").withColumn("geometry", to_multipolygon())
    return Collection(documents, features)


def to_multipolygon(kind: str = "geometry_type", coordinates: str = "coordinates"):
    """Polygon or MultiPolygon coordinate text as one multipolygon column; NULL when unreadable or another type."""
    single = F.from_json(F.col(coordinates), "array<array<array<double>>>")
    many = F.from_json(F.col(coordinates), schemas.MULTIPOLYGON)
    return F.when(F.col(kind) == "Polygon", F.when(single.isNotNull(), F.array(single))).when(
        F.col(kind) == "MultiPolygon", many)


def feature_rows(documents: DataFrame) -> DataFrame:
    """One row per feature with its index; ``properties_text`` keeps the raw object for key tests."""
    own = [c for c in ("document",) if c in documents.columns]
    rows = documents.select(
        *own, F.col("metadata.snapshot_date").alias("snapshot_date"), F.posexplode("features").alias("idx", "f"))
    typed = rows.select(
        *own, "snapshot_date", F.col("idx").cast("bigint").alias("idx"), F.col("f.properties").alias("properties_text"),
        F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"),
        F.from_json("f.properties", schemas.FEATURE_PROPERTIES).alias("p"))
    return typed.select(*own, "snapshot_date", "idx", "properties_text", "geometry_type", "coordinates", "p.*").withColumn(
        "geometry", to_multipolygon())


def geometry_struct(geometry: str = "geometry"):
    """Polygon for one part, MultiPolygon otherwise, as JSON text (the two nest differently)."""
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.col(geometry)[0].alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col(geometry).alias("coordinates")))
    return F.when(F.size(geometry) == 1, one).otherwise(many)


def as_features(df: DataFrame, properties: list[str], geometry_json) -> DataFrame:
    """One GeoJSON feature text per row, with the row's id as the feature's; absent properties are left out."""
    props = F.to_json(F.struct(*properties))
    own_id = F.regexp_replace(F.to_json(F.struct("id")), r"^\{|\}$", "") if "id" in df.columns else F.lit("")
    own_id = F.when(own_id != "", F.concat(own_id, F.lit(","))).otherwise("")
    text = F.concat(F.lit('{"type":"Feature",'), own_id, F.lit('"properties":'), props, F.lit(',"geometry":'), geometry_json, F.lit("}"))
    return df.select(text.alias("value"))


def write_features(features: DataFrame, path: str) -> None:
    """Line-delimited GeoJSON, written in parallel."""
    features.write.mode("overwrite").text(path)


CHANGE_PROPERTIES = ["id", "date", "layer", "from_status", "to_status", "status", "name", "summary", "area_km2", "confidence",
                     "evidence_ids", "source_ids", "reviews"]


def change_features(changes: DataFrame) -> DataFrame:
    """Changed areas as feature texts."""
    return as_features(changes, CHANGE_PROPERTIES, geometry_struct())


def collection_head(summary: DataFrame) -> DataFrame:
    """The metadata text of a change collection from a row of ``change_summary``."""
    names = ["from", "to", "area_change_km2", "by_status_km2", "feature_count"]
    return summary.select(F.concat(F.lit('{"type":"FeatureCollection","metadata":'), F.to_json(F.struct(*names)), F.lit("}")).alias("value"))


def write_changes(changes: DataFrame, summary: DataFrame, path: str) -> None:
    """A change collection that is read and written in parallel: ``features`` one a line, ``head`` with the metadata."""
    write_features(change_features(changes), f"{path}/features")
    write_features(collection_head(summary), f"{path}/head")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited features as ``feature_rows`` gives them, without limits on a file's size; ``idx`` follows the files."""
    lines = spark.read.text(path).select(F.from_json("value", "struct<properties:string,geometry:struct<type:string,coordinates:string>>").alias("f"))
    typed = lines.select(
        F.monotonically_increasing_id().alias("idx"), F.col("f.properties").alias("properties_text"), F.col("f.geometry.type").alias("geometry_type"),
        F.col("f.geometry.coordinates").alias("coordinates"), F.from_json("f.properties", schemas.FEATURE_PROPERTIES).alias("p"))
    return typed.select("idx", "properties_text", "geometry_type", "coordinates", "p.*").withColumn("geometry", to_multipolygon())


def point_features(events: DataFrame, kind: str) -> DataFrame:
    """Point features of located events of one kind."""
    located = events.filter(
        (F.col("event_kind") == kind) & F.col("location.lat").isNotNull() & F.col("location.lon").isNotNull())
    keep = [c for c in ("id", "title", "title_uk", "title_en", "summary", "summary_uk", "summary_en", "event_date",
                        "published_at", "verification_status", "source_ids", "evidence_ids", "location_label")
            if c in events.columns]
    return located.select(*keep, F.col("location.lon").alias("lon"), F.col("location.lat").alias("lat"))


def point_feature_text(points: DataFrame) -> DataFrame:
    geometry = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    return as_features(points, [c for c in points.columns if c not in ("lon", "lat")], geometry)
