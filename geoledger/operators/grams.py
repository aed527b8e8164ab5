"""Substring search by an index of two- and three-letter runs.

``posting_table`` lists for every run of letters the rows whose names hold it. It is written by ``write_postings`` in folders by
a hash of the run and sorted by run, so a search reads the folders, and in them the pages, of its own runs only. A search
looks up the rarest run of each query and compares the rows listed there with the whole query; the rest of the table is not
read. Any number of queries go in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoledger.session import cut

BUCKETS = 64


def runs_of(text: Column, size: int) -> Column:
    """All runs of ``size`` characters of a text, each once; none if it is shorter."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, F.lit(size))))


def searched_names(names: list[Column], aliases: Column) -> Column:
    """The lower-cased texts of a row that a search looks into."""
    every = F.concat(F.array(*names), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.array_distinct(F.transform(F.filter(every, lambda n: n.isNotNull()), lambda n: F.lower(n)))


def _bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")


def posting_table(rows: DataFrame, key: str, names: Column) -> DataFrame:
    """(run, key): every run of two or three letters in any of the names of a row."""
    runs = F.array_distinct(F.flatten(F.transform(names, lambda n: F.concat(runs_of(n, 2), runs_of(n, 3)))))
    return rows.select(F.explode(runs).alias("run"), F.col(key).alias("key"))


def write_postings(rows: DataFrame, key: str, names: Column, path: str) -> None:
    """Write postings/ and the number of rows of each run, runs/. A frequent run is spread over files."""
    listed = posting_table(rows, key, names).withColumn("bucket", _bucket(F.col("run")))
    salted = listed.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "run")
    salted.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    written = rows.sparkSession.read.parquet(f"{path}/postings")
    counts = written.groupBy("bucket", "run").agg(F.count(F.lit(1)).alias("rows"))
    counts.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/runs")


def search(spark: SparkSession, path: str, queries: DataFrame, rows: DataFrame, key: str, names: Column, order: str, limit: int = 8) -> DataFrame:
    """The first ``limit`` rows for each query (``query``) in the order of ``order``, with their place (``rank``).

    Queries are trimmed and read without case; those of fewer than two characters find nothing.
    """
    wanted = queries.select("query").distinct().withColumn("text", F.lower(F.trim("query"))).where(F.length("text") >= 2)
    runs = F.when(F.length("text") == 2, F.array("text")).otherwise(runs_of(F.col("text"), 3))
    asked = cut(wanted.withColumn("run", F.explode(runs)).withColumn("bucket", _bucket(F.col("run"))))
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS numbers: they prune folders
    sizes = spark.read.parquet(f"{path}/runs").where(F.col("bucket").isin(buckets))
    counted = asked.join(sizes, ["bucket", "run"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    rarest = cut(counted.groupBy("query", "text").agg(F.min(F.struct("rows", "run", "bucket")).alias("r")).where("r.rows > 0").select("query", "text", "r.run", "r.bucket"))
    used = [r.bucket for r in rarest.select("bucket").distinct().collect()]
    postings = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(used))
    listed = postings.join(rarest, ["bucket", "run"]).select("query", "text", "key")
    shown = rows.select(F.col(key).alias("key"), F.col(order).alias("_order"), names.alias("_names"))
    met = listed.join(shown, "key").where(F.exists("_names", lambda n: F.contains(n, F.col("text"))))
    place = F.row_number().over(Window.partitionBy("query").orderBy("_order", "key"))
    return met.withColumn("rank", place).where(F.col("rank") <= limit).select("query", "rank", F.col("key").alias(key))
