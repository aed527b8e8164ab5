"""Dated archive with a log of commits.

Each publication writes its tables below a version folder of its own and is then committed by one row in one new file, whose number is the
next of the log. Nothing that was written before is touched, so whatever step breaks off, and whoever reads in between, the archive
is the old one or the new one as a whole. The manifest (one row for each date: its newest commit) and the audit (all
commits) are two views of the log. Versions that no date points to any more stay readable until ``vacuum`` takes them away.

One publisher works at a time; a second one that takes the same number fails and may run again.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoledger import schemas
from geoledger.operators.merges import pick
from geoledger.sources.tables import read_parquet_table

#: Tables of an archived date and what a reader of one sees; moved points carry the columns of the registry besides.
ARCHIVE_SCHEMAS = {
    "current": schemas.SNAPSHOT_FEATURES, "changes": schemas.CHANGES, "points": f"{schemas.POINTS}, previous_status string, changed_at string",
    "events": schemas.EVENTS, "status": schemas.STATUS,
}
COMMITS = f"{schemas.MANIFEST}, version string, publication string, action string, reviewers array<string>"


def new_version(snapshot_date: str) -> str:
    """The name of a version folder that no other run uses."""
    return f"{snapshot_date}-{uuid.uuid4().hex}"


def write_archived(df: DataFrame, root: str, version: str, table: str, snapshot_date: str) -> None:
    """Write one table of a version that is not committed yet."""
    dated = df.drop("snapshot_date").withColumn("snapshot_date", F.lit(snapshot_date))
    dated.write.mode("overwrite").parquet(f"{root}/versions/{version}/{table}")


def read_commits(spark: SparkSession, root: str) -> DataFrame:
    """The log: a row for each commit with its number ``seq``, from 1."""
    return read_parquet_table(spark, f"{root}/commits", f"{COMMITS}, seq bigint")


def commit_manifest_row(row: DataFrame, root: str) -> int:
    """Commit a publication: one row in one file of a new folder, which appears at once. Returns the commit's number."""
    spark = row.sparkSession
    seq = (read_commits(spark, root).agg(F.max("seq")).first()[0] or 0) + 1
    names = [f.split()[0] for f in COMMITS.split(", ")]
    row.select(*names).coalesce(1).write.mode("error").parquet(f"{root}/commits/seq={seq}")
    return seq


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row for each published date, with the version that holds it; no order is implied (``ordered_manifest`` gives one)."""
    return pick(read_commits(spark, root), ["date"], F.col("seq"), last=True).drop("publication", "action", "reviewers")


def read_audit(spark: SparkSession, root: str) -> DataFrame:
    """A row for each publication with its number, for ever."""
    return read_commits(spark, root).select("seq", "action", F.col("date").alias("snapshot_date"), "published_at", "sha256", "reviewers")


def open_version(spark: SparkSession, root: str, version: str | None, table: str, schema: str) -> DataFrame:
    """One table of a version; no version, or no such table in it, gives an empty frame."""
    full = schema if "snapshot_date " in schema else f"{schema}, snapshot_date string"
    return read_parquet_table(spark, f"{root}/versions/{version or 'none'}/{table}", full)


def version_of(manifest: DataFrame, snapshot_date: str | None) -> str | None:
    row = manifest.filter(F.col("date") == F.lit(snapshot_date)).select("version").first()
    return row.version if row else None


def open_snapshot(spark: SparkSession, root: str, table: str, snapshot_date: str, schema: str) -> DataFrame:
    """Rows of one archived date as it stands now; later commits do not change a frame that is open. An unknown date or table gives
    an empty frame."""
    return open_version(spark, root, version_of(read_manifest(spark, root), snapshot_date), table, schema)


def vacuum(spark: SparkSession, root: str, now: datetime, keep: timedelta = timedelta(days=7)) -> list[str]:
    """Delete version folders that no date points to and that nobody has written to within ``keep``; returns their names.

    ``keep`` must be longer than a publication or a read takes: what breaks off leaves a folder without a commit, which goes too.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    listed = {f.getPath().getName(): f for f in files.listStatus(folder)}  # one name a version, before the log is read
    used = {r.version for r in read_manifest(spark, root).select("version").collect()}  # one row a date
    limit = (now if now.tzinfo else now.replace(tzinfo=timezone.utc)).timestamp() * 1000 - keep.total_seconds() * 1000
    gone = []
    for name, found in sorted(listed.items()):
        inner = [found.getModificationTime(), *(f.getModificationTime() for f in files.listStatus(found.getPath()))]
        if name not in used and max(inner) < limit:
            files.delete(found.getPath(), True)
            gone.append(name)
    return gone


def ordered_manifest(manifest: DataFrame) -> DataFrame:
    """The manifest newest first, as it is published, with its position (one row for each date, so one task is enough)."""
    return manifest.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("date"))).cast("bigint") - 1)


def previous_date(manifest: DataFrame, snapshot_date: str) -> DataFrame:
    """One row (date): the latest other published date; NULL before the first publication."""
    return manifest.filter(F.col("date") != snapshot_date).agg(F.max("date").alias("date"))


def archive_record(manifest: DataFrame, snapshot_date: str) -> DataFrame:
    """The manifest row of a date: no row, no archive."""
    return manifest.filter(F.col("date") == snapshot_date)


def open_archive(spark: SparkSession, root: str, selected: str = "current") -> dict[str, DataFrame]:
    """The tables a reader sees: of the newest published date (``current``) or of an archived one.

    Besides the archived tables there is ``previous``, the areas of the date before; it is empty for an archived date,
    which is shown alone. A date that the manifest does not name gives empty tables. The log is read once, so all tables
    are of one state of the archive.
    """
    versions = {r.date: r.version for r in read_manifest(spark, root).select("date", "version").collect()}  # one row a date
    day = max(versions, default="") if selected == "current" else selected
    tables = {name: open_version(spark, root, versions.get(day), name, schema) for name, schema in ARCHIVE_SCHEMAS.items()}
    before = max((d for d in versions if d < day), default=None) if selected == "current" else None
    tables["previous"] = open_version(spark, root, versions.get(before), "current", schemas.SNAPSHOT_FEATURES)
    return tables
