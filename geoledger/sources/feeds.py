"""RSS and Atom documents, message pages and the feed configuration."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.functions.text import collapse_space

FEED_CONFIG = "id string, side string, kind string, homepage string, enabled boolean, license_review string, feed_url string"


def feed_config(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Configured feeds (a short driver-side list) that are enabled and have an address."""
    names = [f.split()[0] for f in FEED_CONFIG.split(", ")]
    rows = [tuple(s.get(n) for n in names) for s in sources]
    config = spark.createDataFrame(rows, FEED_CONFIG)
    return config.filter(F.coalesce("enabled", F.lit(False)) & (F.coalesce("feed_url", F.lit("")) != ""))


def read_message_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages, one row per file: page_id (file order is not meaningful) and html."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page_id"), F.col("value").alias("html"))


#: Local names, in any namespace: what an entry is called, and which elements give its fields.
_ENTRIES = {"item", "entry"}
_FIELDS = {"title": "title", "link": "link", "pubDate": "time", "published": "time", "updated": "time"}


def entries_of(xml: str) -> list[dict[str, tuple[int, str]]]:
    """Entries of a document in the order they begin, at any depth. Each field is the text of its first element, in the
    order of the document, that has any; ``href`` is that of the first link. A field comes with its element's number."""
    parser = ElementTree.XMLPullParser(("start", "end"))
    parser.feed(xml)
    parser.close()
    found, inside, numbers, count = [], [], [], 0
    for event, element in parser.read_events():
        name = element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""
        if event == "start":
            count += 1
            numbers.append(count)
            if name in _ENTRIES:
                inside.append({})
                found.append(inside[-1])
            continue
        number = numbers.pop()
        here = {_FIELDS[name]: " ".join(element.text.split())} if name in _FIELDS and element.text else {}
        if name == "link":
            here["href"] = element.get("href", "")
        for field, text in here.items():
            for entry in inside:  # an element inside an inner one belongs to all around it
                if field not in entry or number < entry[field][0]:
                    entry[field] = (number, text)
        if name in _ENTRIES:
            inside.pop()
    return found


def _feed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for feed in batch.to_pylist():
            rows = []
            try:
                for at, entry in enumerate(entries_of(feed["xml"] or "")):
                    text = lambda field: entry.get(field, (0, ""))[1]  # noqa: E731, B023
                    rows.append((feed["source_id"], feed["feed_pos"], at, text("title"), text("link") or text("href"), text("time"), None))
            except ElementTree.ParseError:
                rows = [(feed["source_id"], feed["feed_pos"], None, None, None, None, feed["xml"] or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)


_ROWS = pa.schema([("source_id", pa.string()), ("feed_pos", pa.int64()), ("entry_pos", pa.int32()), *((c, pa.string()) for c in (
    "title", "url", "published_at_raw", "broken"))])


def parsed_feeds(feeds: DataFrame) -> DataFrame:
    """Entries of feed documents (source_id, feed_pos, xml), and a row with the text in ``broken`` for each that is not XML."""
    return feeds.select(F.col("source_id").cast("string").alias("source_id"), F.col("feed_pos").cast("bigint").alias("feed_pos"), "xml").mapInArrow(
        _feed_rows, "source_id string, feed_pos bigint, entry_pos int, title string, url string, published_at_raw string, broken string")


def rejected_feeds(feeds: DataFrame) -> DataFrame:
    """(source_id, feed_pos, xml) of documents that are not well-formed XML; kept apart so that one does not stop a run."""
    return parsed_feeds(feeds).filter("broken IS NOT NULL").select("source_id", "feed_pos", F.col("broken").alias("xml"))


def feed_entries(feeds: DataFrame) -> DataFrame:
    """Entries of feed documents: source_id, feed_pos, entry_pos, title, url, published_at_raw.

    ``feeds`` carry source_id, feed_pos and xml. Entries are ``item`` or ``entry`` elements at any depth and in any namespace;
    the link falls back to its href attribute. Documents that hold no such element or are no XML give no rows.
    """
    return parsed_feeds(feeds).filter("broken IS NULL").drop("broken")


def read_feed_files(spark: SparkSession, path: str, source_id: str, row_tag: str = "item") -> DataFrame:
    """Large feed files through Spark's XML reader, which splits them by element."""
    schema = "title string, link string, pubDate string, published string, updated string"
    if row_tag == "entry":
        schema = schema.replace("link string", "link array<struct<_href:string>>")
    items = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    link = F.col("link") if row_tag == "item" else F.get(F.col("link._href"), F.lit(0))
    return items.select(F.lit(source_id).alias("source_id"), F.lit(0).alias("feed_pos"),
                        F.monotonically_increasing_id().alias("entry_pos"), collapse_space(F.col("title")).alias("title"),
                        collapse_space(link).alias("url"),
                        F.coalesce("pubDate", "published", "updated", F.lit("")).alias("published_at_raw"))
