"""Reading and writing the flat tables: JSON arrays at the edges, Parquet inside."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from geoledger.session import cut
from geoledger.sources.jsonsplit import read_json_objects


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _only_missing(problem: AnalysisException) -> None:
    """Raise again unless the path does not exist: anything else unreadable must not pass for an empty table."""
    if problem.getCondition() != "PATH_NOT_FOUND":
        raise problem


def read_json_table(spark: SparkSession, path: str, schema: str, required: bool = False, ordinal: bool = False) -> DataFrame:
    """JSON array (or lines) with a fixed schema; an absent path gives an empty table unless ``required``.

    With ``ordinal`` each row carries its place, over all files in the order of their names; a file is then read by many tasks
    whatever its size, and one that is no array of objects stops the run.
    """
    try:
        if ordinal:
            return _ordered_table(spark, path, schema)
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as problem:
        if required:
            raise
        _only_missing(problem)
        return empty_table(spark, f"{schema}, ordinal bigint" if ordinal else schema)


def _ordered_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    read = read_json_objects(spark, path)
    files = cut(read.files)
    # a whole array or nothing but lines is left around the objects
    bad = files.where(F.col("fault") | ~F.rlike("skeleton", F.lit(r"^[ \t\r\n]*(\[[ \t\r\n]*\])?[ \t\r\n]*$"))).select("path").first()
    if bad:
        raise ValueError(f"{bad.path} is not an array of JSON objects")
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    base = files.select("path", F.coalesce(F.sum("objects").over(earlier), F.lit(0)).alias("base"))
    rows = read.objects.join(base, "path").select(F.from_json("text", schema).alias("r"), (F.col("base") + F.col("idx")).cast("bigint").alias("ordinal"))
    return rows.select("r.*", "ordinal")


def read_parquet_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        _only_missing(problem)
        return empty_table(spark, schema)


def write_version(df: DataFrame, path: str, version: int) -> None:
    """Add a numbered version of a small table. Older versions stay, so a run that breaks off loses nothing; a version
    that was written before by the same run is replaced."""
    dated = df.drop("version").withColumn("version", F.lit(version).cast("bigint"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def read_newest_version(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the highest version, with the column ``version``; an empty frame before the first one."""
    every = read_parquet_table(spark, path, f"{schema}, version bigint")
    newest = every.agg(F.max("version").alias("_newest"))
    return every.join(F.broadcast(newest), F.col("version") == F.col("_newest")).drop("_newest")  # one row


def write_table(df: DataFrame, path: str) -> None:
    """Replace a whole table."""
    df.write.mode("overwrite").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines for interchange; NULL fields are left out."""
    df.write.mode("overwrite").json(path)


WHOLE_BYTES = 1 << 30  # larger files are not read as one row


def content_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of raw file bytes, for files of any size."""
    files = spark.read.format("binaryFile").load(path)
    if (files.agg(F.max("length")).first()[0] or 0) > WHOLE_BYTES:
        return streamed_digest(spark, path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def streamed_digest(spark: SparkSession, path: str) -> DataFrame:
    """``content_digest`` by streaming: a digest takes its bytes in order, so one task reads the records of a file, one
    after another. NULL where the records are not the whole file (a byte order mark is lost in reading)."""
    records = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").cast("binary").alias("value"))
    ordered = records.repartition("path").sortWithinPartitions("path", "block", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = digest = None
        size = seen = 0
        row = lambda: pa.RecordBatch.from_pydict({"path": [path], "sha256": [digest.hexdigest() if seen == size else None]}, _DIGEST)
        for batch in batches:
            for p, s, value in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "value"))):
                if p != path:
                    if path is not None:
                        yield row()
                    path, size, seen, digest = p, s, 0, hashlib.sha256()
                value = value + b"}" if seen + len(value) < size else value  # the last record may lack its end
                digest.update(value)
                seen += len(value)
        if path is not None:
            yield row()

    return ordered.select("path", "size", "value").mapInArrow(run, "path string, sha256 string")


_DIGEST = pa.schema([("path", pa.string()), ("sha256", pa.string())])
