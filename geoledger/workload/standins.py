"""The library's tables derived from the given ones. The SQL is shared by Spark and by the checking engine.

``$arr(...)`` stands for the array constructor; ``{table}`` for a given table. Rectangles stand on a lattice of 512 columns and 390
rows between 30 degrees south and 47 degrees north; every further 199,680 parts make a snapshot pair of their own (column ``c``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages",
          "benchmark", "labels", "embeddings", "conversations")

SQL = {
    "sources": """
SELECT s_suppkey AS ordinal, 'src-' || CAST(s_suppkey AS STRING) AS id,
  CASE WHEN s_suppkey % 11 = 3 THEN '' ELSE s_name END AS name, 'supplier in ' || n_name AS role,
  CASE r_name WHEN 'AFRICA' THEN 'russian' WHEN 'AMERICA' THEN 'ukrainian' WHEN 'ASIA' THEN 'independent'
    WHEN 'EUROPE' THEN 'multiple' ELSE 'unlisted' END AS side,
  'official' AS kind,
  CASE WHEN s_suppkey % 7 = 2 THEN 'http://s' WHEN s_suppkey % 7 = 4 THEN 'HTTPS://my_s' WHEN s_suppkey % 7 = 5 THEN 'https://источник'
    WHEN s_suppkey % 7 = 6 THEN 'https:///s' ELSE 'https://s' END || CAST(s_suppkey AS STRING) || '.example.org/a b|{{c}}' AS url,
  CASE WHEN s_acctbal < 0 THEN 'paused' ELSE 'ok' END AS health, 'declared' AS health_label,
  CASE WHEN s_suppkey % 13 = 5 THEN NULL ELSE 'review_required' END AS license_status,
  CASE WHEN s_suppkey % 5 = 0 THEN false WHEN s_suppkey % 5 = 1 THEN NULL ELSE true END AS monitor, 'usage note' AS usage_note
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "evidence": """
SELECT (l_partkey * 1000000 + l_suppkey) * 4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS ordinal,
  'ev-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id,
  'src-' || CAST(CASE WHEN l_partkey % 50 = 0 THEN l_suppkey + 1000000 ELSE l_suppkey END AS STRING) AS source_id,
  CAST(CAST(l_shipdate AS DATE) AS STRING) AS published_at,
  CASE WHEN l_suppkey % 50 = 7 THEN 'http://e.example.org/' ELSE 'https://e.example.org/' END
    || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING) AS url,
  CASE l_returnflag WHEN 'A' THEN 'satellite' WHEN 'N' THEN 'geolocated_media' ELSE '' END AS evidence_type,
  'group-' || CAST(l_suppkey % 25 AS STRING) AS independence_group, 'note' AS verification_note
FROM {lineitem}""",
    "events": """
SELECT o_orderkey AS ordinal, 'event-' || CAST(o_orderkey AS STRING) AS id,
  CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE 'Order ' || CAST(o_orderkey AS STRING) END AS title,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Замовлення ' || CAST(o_orderkey AS STRING) END AS title_uk,
  'Order no. ' || CAST(o_orderkey AS STRING) AS title_en,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE 'priority ' || o_orderpriority END AS summary,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS event_date,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T10:00:00+00:00' END AS published_at,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'confirmed' WHEN '2-HIGH' THEN 'probable' WHEN '3-MEDIUM' THEN 'claim'
    WHEN '4-NOT SPECIFIED' THEN 'disputed'
    ELSE CASE o_orderstatus WHEN 'F' THEN 'withdrawn' WHEN 'O' THEN 'corrected' ELSE 'other' END END AS verification_status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'territorial_update' ELSE 'report' END AS event_kind,
  $arr('src-' || CAST(o_custkey % 130 AS STRING), CASE WHEN o_orderkey % 40 = 0 THEN 'src-x' ELSE 'src-1' END) AS source_ids,
  $arr('ev-' || CAST(o_orderkey AS STRING) || '-1', 'ev-' || CAST(o_orderkey AS STRING) || '-2',
       'ev-' || CAST(o_orderkey AS STRING) || '-3') AS evidence_ids,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 180 AS DOUBLE) - 90 END AS lat,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 360 AS DOUBLE) - 180 END AS lon,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'label ' || CAST(o_custkey % 500 AS STRING) END AS location_label,
  'pt-' || CAST(o_custkey AS STRING) AS settlement_id
FROM {orders}""",
    "claims": """
SELECT c_custkey AS ordinal, 'claim-' || CAST(c_custkey AS STRING) AS id, 'Claim by ' || c_name AS title,
  'segment ' || c_mktsegment AS summary, '2001-01-01' AS event_date,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'claim' WHEN 'MACHINERY' THEN 'disputed' ELSE 'withdrawn' END AS verification_status,
  CASE c_nationkey % 3 WHEN 0 THEN 'russian' WHEN 1 THEN 'ukrainian' ELSE 'independent' END AS side,
  $arr('src-' || CAST(c_custkey % 130 AS STRING)) AS source_ids, $arr('ev-' || CAST(c_custkey AS STRING) || '-1') AS evidence_ids,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_custkey % 170 AS DOUBLE) - 85 END AS lat,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_custkey % 350 AS DOUBLE) - 175 END AS lon,
  'pt-' || CAST(c_custkey - c_custkey % 2 AS STRING) AS settlement_id
FROM {customer}""",
    "points": """
SELECT c_custkey AS ordinal, 'pt-' || CAST(c_custkey AS STRING) AS id, c_name AS name,
  (CAST(c_custkey * 37 % 12800 AS DOUBLE) + 0.5 - 6400) / 128 AS lon,
  (CAST(c_custkey * 11 % 200 AS DOUBLE) + 0.5 - 3840) / 128 AS lat, 'pub' AS source_id
FROM {customer}""",
    "places": """
SELECT p_partkey AS ordinal, 'pp-' || CAST(p_partkey AS STRING) AS id,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS name_uk,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE upper(p_name) END AS name_ru, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE '' END AS name_en,
  $arr(p_type, 'Item ' || CAST(p_partkey AS STRING)) AS aliases, p_retailprice, p_size,
  CASE p_partkey % 5 WHEN 0 THEN 'control_ru' WHEN 1 THEN 'control_ua' WHEN 2 THEN 'contested' WHEN 3 THEN 'other' ELSE NULL END AS status
FROM {part}""",
    "archive": """
SELECT 'chg-' || CAST(o_custkey AS STRING) AS id, CAST(o_orderdate AS DATE) AS snapshot_date, o_totalprice AS area_km2,
  o_orderkey AS pos, o_orderpriority AS summary FROM {orders}""",
    "manifest": """
SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS change_count, count(DISTINCT o_custkey) AS settlement_count,
  CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '2005-01-01') AS BIGINT) AS ordinal
FROM {orders} GROUP BY CAST(o_orderdate AS DATE)""",
    "probes": """
SELECT 'src-' || CAST(s_suppkey AS STRING) AS source_id,
  CASE CAST(s_suppkey % 6 AS INT) WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 404 WHEN 3 THEN 503 WHEN 4 THEN 199 ELSE NULL END AS http_status,
  CASE s_suppkey % 6 WHEN 2 THEN 'HTTPError' WHEN 3 THEN 'HTTPError' WHEN 5 THEN 'URLError' ELSE NULL END AS error_class,
  s_suppkey AS ordinal FROM {supplier}""",
    "feed_texts": """
SELECT 'feed-' || CAST(page_id % 7 AS STRING) AS source_id, page_id AS feed_pos,
  CASE WHEN page_id % 2 = 0 THEN '<?xml version="1.0"?><rss><channel><title>all</title><item><title>old ' || CAST(page_id AS STRING)
      || '</title><link>' || replace(url, '&', '&amp;') || '</link></item><item><title>' || CASE WHEN page_id % 10 = 0 THEN '' ELSE 'Page  ' || CAST(page_id AS STRING) END
      || '</title><link>' || replace(url, '&', '&amp;') || '</link><pubDate>day ' || CAST(page_id AS STRING) || '</pubDate></item></channel></rss>'
    WHEN page_id % 9 = 0 THEN 'not markup at all'
    ELSE '<feed xmlns="http://www.w3.org/2005/Atom"><a:entry xmlns:a="http://www.w3.org/2005/Atom"><a:title>Page <![CDATA[x]]></a:title>'
      || '<a:link href="' || replace(url, '&', '&amp;') || '"/><a:updated>day ' || CAST(page_id AS STRING) || '</a:updated></a:entry></feed>' END AS xml,
  page_id, url FROM {pages}""",
    "message_parts": """
SELECT event_id AS page_id, user_id, event_type, ts,
  replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T') AS stamp,
  CASE WHEN user_id % 3 = 0 THEN '+02:00' WHEN user_id % 3 = 1 THEN '+00:00' ELSE '' END AS zone,
  '48.' || lpad(CAST(event_id AS STRING), CAST(greatest(6, length(CAST(event_id AS STRING))) AS INT), '0') AS lat_text, '-37.' || lpad(CAST(event_id % 1000 AS STRING), 3, '0') AS lon_text,
  value FROM {events}""",
    "rects_old": """
SELECT p_partkey AS k, CAST((p_partkey - p_partkey % 199680) / 199680 AS BIGINT) AS c, (p_partkey % 512) * 25 AS x0, CAST((p_partkey % 199680 - p_partkey % 512) / 512 AS BIGINT) * 25 AS y0,
  (p_partkey % 512) * 25 + p_size AS x1, CAST((p_partkey % 199680 - p_partkey % 512) / 512 AS BIGINT) * 25 + p_size AS y1,
  CASE (p_partkey + CAST((p_partkey % 199680 - p_partkey % 512) / 512 AS BIGINT)) % 4 WHEN 0 THEN 'control_ru' WHEN 1 THEN 'control_ua'
    WHEN 2 THEN 'contested' ELSE 'unknown' END AS status FROM {part}""",
    "rects_new": """
SELECT p_partkey AS k, CAST((p_partkey - p_partkey % 199680) / 199680 AS BIGINT) AS c,
  (p_partkey % 512) * 25 + CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 0 END AS x0,
  CAST((p_partkey % 199680 - p_partkey % 512) / 512 AS BIGINT) * 25 + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS y0,
  (p_partkey % 512) * 25 + p_size + CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 0 END AS x1,
  CAST((p_partkey % 199680 - p_partkey % 512) / 512 AS BIGINT) * 25 + p_size + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS y1,
  CASE (p_partkey + CAST((p_partkey % 199680 - p_partkey % 512) / 512 AS BIGINT) + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) % 4
    WHEN 0 THEN 'control_ru' WHEN 1 THEN 'control_ua' WHEN 2 THEN 'contested' ELSE 'unknown' END AS status FROM {part}""",
    "features": """
SELECT p_partkey AS idx, CASE WHEN p_partkey % 101 = 0 THEN 'f-same' WHEN p_partkey % 103 = 5 THEN '' ELSE 'f-' || CAST(p_partkey AS STRING) END AS id,
  p_name AS name, CASE WHEN p_size = 50 THEN 'lost' ELSE 'contested' END AS status,
  CASE p_partkey % 4 WHEN 0 THEN '2024-01-01T00:00:00Z' WHEN 1 THEN '2024-01-09T12:00:00+02:00' WHEN 2 THEN '2024-01-01T00:00:00' ELSE '2024-01-09T00:00:00+00:00' END AS valid_from,
  CASE WHEN p_size = 7 THEN NULL WHEN p_size = 8 THEN 1.5 ELSE (90 + p_partkey % 10) / 100.0E0 END AS confidence,
  CASE WHEN p_partkey % 9 = 0 THEN $arr('ev-1-1', 'ev-1-1') ELSE $arr('ev-' || CAST(p_partkey AS STRING) || '-1', 'ev-' || CAST(p_partkey AS STRING) || '-2') END AS evidence_ids,
  $arr('src-' || CAST(p_partkey % 130 AS STRING)) AS source_ids,
  CASE WHEN p_brand = 'Brand#1' THEN 'pending' ELSE 'approved' END AS decision, CASE WHEN p_brand = 'Brand#2' THEN '' ELSE 'rev ' || p_type END AS reviewer
FROM {part}""",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the given timestamps carry no zone
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SQL[name].replace("$arr", "array").replace("datediff('day', ", "datediff(DAY, ")
    used = {t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    df = spark.sql(text, **used)
    if {"lat", "lon"} <= set(df.columns) and name in ("events", "claims"):
        df = df.withColumn("location", F.when(F.col("lat").isNotNull(), F.struct("lat", "lon"))).drop("lat", "lon")
    return df


def oracle_cte(*names: str) -> str:
    """``WITH`` clause that defines the same tables for the checking engine."""
    plain = {t: t for t in TABLES}
    return "WITH " + ", ".join(f"{'s_' + n} AS ({SQL[n].replace('$arr', 'list_value').format(**plain)})" for n in names)


def rect_features(rects: DataFrame) -> DataFrame:
    """Rectangles on the 1/128 degree lattice as polygon features."""
    lon = lambda c: f"(CAST({c} AS double) - 6400) / 128"
    lat = lambda c: f"(CAST({c} AS double) - 3840) / 128"
    corner = lambda x, y: f"array({lon(x)}, {lat(y)})"
    rects = rects.repartition(max(32, 4 * rects.sparkSession.sparkContext.defaultParallelism), "k")  # a small file of many rows is read by one task
    ring = "array(" + ", ".join(corner(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))) + ")"
    return rects.selectExpr(
        "CAST(date_add(DATE '2024-01-02', CAST(c AS int)) AS string) AS ctx", "k AS idx", "concat('f-', k) AS id", "status", "(93 + k % 7) / 100.0E0 AS confidence",
        "array(concat('ev-', k)) AS evidence_ids", "array(concat('src-', k % 10)) AS source_ids",
        "named_struct('decision', 'approved', 'reviewer', concat('rev-', k % 5)) AS moderation", f"array(array({ring})) AS geometry")
