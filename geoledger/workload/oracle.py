"""Checking SQL for the registered queries, written against the same derived tables."""

from __future__ import annotations

from geoledger import vocab
from geoledger.functions.projection import SQL_METRES_PER_LON_DEGREE, SQL_PROJECT_Y
from geoledger.workload.standins import oracle_cte

ORACLE: dict[str, str] = {}


def _sql(name: str, tables: tuple[str, ...], body: str, more: str = "") -> None:
    head = oracle_cte(*tables) if tables else "WITH s_none AS (SELECT 1)"
    clause = head + (", " + more if more else "")
    ORACLE[name] = clause.replace("WITH ", "WITH RECURSIVE ", 1) + " " + body


def _y(expr: str) -> str:
    return SQL_PROJECT_Y.replace("$lat", f"(({expr}) - 3840) / 128.0")


def _missing(table: str, rule: str, fields: tuple[str, ...], collection: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{collection}' AS collection, ordinal, '{rule}' AS rule, 'missing {f}' AS message FROM {table} WHERE coalesce(CAST({f} AS VARCHAR), '') = ''"
        for f in fields)


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_SOURCES = (
    _missing("s_sources", "V-D3", vocab.SOURCE_FIELDS, "sources")
    + f" UNION ALL SELECT 'sources', ordinal, 'V-D4', 'invalid side' FROM s_sources WHERE side NOT IN {_list(vocab.SIDES)}"
    + " UNION ALL SELECT 'sources', ordinal, 'V-D5', 'url must be HTTPS' FROM s_sources WHERE NOT regexp_matches(url, '(?i)^https://[^/?#]')"
    + " UNION ALL SELECT 'sources', NULL, 'V-D1', 'duplicate ids' FROM (SELECT 1 FROM s_sources GROUP BY id HAVING count(*) > 1 LIMIT 1)")
_EVIDENCE = (
    _missing("s_evidence", "V-D6", vocab.EVIDENCE_FIELDS, "evidence")
    + " UNION ALL SELECT 'evidence', ordinal, 'V-D7', 'unknown source_id' FROM s_evidence WHERE source_id NOT IN (SELECT id FROM s_sources)"
    + " UNION ALL SELECT 'evidence', ordinal, 'V-D8', 'url must be HTTPS' FROM s_evidence WHERE NOT regexp_matches(url, '(?i)^https://[^/?#]')"
    + " UNION ALL SELECT 'evidence', NULL, 'V-D2', 'duplicate ids' FROM (SELECT 1 FROM s_evidence GROUP BY id HAVING count(*) > 1 LIMIT 1)")


def _event_rules(table: str, collection: str) -> str:
    def unknown(column: str, known: str, rule: str, what: str) -> str:
        return (f" UNION ALL SELECT '{collection}', ordinal, '{rule}', 'unknown {what} ' || string_agg(v, ', ' ORDER BY v)"
                f" FROM (SELECT DISTINCT ordinal, unnest({column}) AS v FROM {table}) WHERE v NOT IN (SELECT id FROM {known}) GROUP BY ordinal")
    return (_missing(table, "V-D9", vocab.EVENT_TEXT_FIELDS, collection)
            + f" UNION ALL SELECT '{collection}', ordinal, 'V-D10', 'invalid verification_status' FROM {table}"
              f" WHERE verification_status NOT IN {_list(vocab.EVENT_STATUSES)}"
            + unknown("source_ids", "s_sources", "V-D11", "sources") + unknown("evidence_ids", "s_evidence", "V-D12", "evidence"))


_MANIFEST = (
    "SELECT 'manifest' AS collection, CAST(NULL AS BIGINT) AS ordinal, 'V-D15' AS rule, 'dates must be reverse chronological' AS message FROM"
    " (SELECT 1 FROM (SELECT CAST(o_orderdate AS DATE) AS d, lead(CAST(o_orderdate AS DATE)) OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n > d LIMIT 1)"
    " UNION ALL SELECT 'manifest', NULL, 'V-D14', 'duplicate dates' FROM (SELECT 1 FROM orders GROUP BY CAST(o_orderdate AS DATE) HAVING count(*) > 1 LIMIT 1)")

_sql("evidence_unknown_source", ("sources", "evidence"),
     "SELECT source_id, count(*) AS evidence_rows FROM s_evidence WHERE source_id NOT IN (SELECT id FROM s_sources) GROUP BY source_id")
_sql("source_rules", ("sources",), _SOURCES)
_sql("evidence_rules", ("sources", "evidence"), _EVIDENCE)
_sql("event_rules", ("sources", "evidence", "events"), _event_rules("s_events", "events"))
_sql("claim_rules", ("sources", "evidence", "claims"), _event_rules("s_claims", "claims"))
_sql("manifest_rules", (), _MANIFEST)
_sql("registry_rule_counts", ("sources", "evidence", "events", "claims"),
     "SELECT collection, rule, count(*) AS violations FROM (" + " UNION ALL ".join(
         [_SOURCES, _EVIDENCE, _event_rules("s_events", "events"), _event_rules("s_claims", "claims"), _MANIFEST]) + ") GROUP BY collection, rule")
_sql("evidence_schema", ("evidence",),
     """SELECT 'evidence_type' AS field, 'required' AS message, count(*) AS violations FROM s_evidence WHERE evidence_type = ''
UNION ALL SELECT 'published_at', 'not a date-time', count(*) FROM s_evidence""")
_sql("event_schema", ("events",), f"""
SELECT ordinal, 'title' AS field, 'required and not empty' AS message FROM s_events WHERE title = ''
UNION ALL SELECT ordinal, 'summary', 'required and not empty' FROM s_events WHERE summary IS NULL
UNION ALL SELECT ordinal, 'verification_status', 'not allowed' FROM s_events WHERE verification_status NOT IN {_list(vocab.EVENT_STATUSES)}""")
_sql("duplicate_evidence_ids", ("evidence",), "SELECT id, count(*) AS occurrences FROM s_evidence GROUP BY id HAVING count(*) > 1")
_sql("later_evidence", ("evidence",),
     "SELECT id, count(*) AS later_rows FROM (SELECT id, rank() OVER (PARTITION BY id ORDER BY ordinal) AS rk FROM s_evidence) WHERE rk > 1 GROUP BY id")

_MOMENT = "TIMESTAMP '2024-01-10 10:00:00'"
_VALID = ("CASE idx % 4 WHEN 0 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN 1 THEN TIMESTAMP '2024-01-09 10:00:00'"
          " WHEN 3 THEN TIMESTAMP '2024-01-09 00:00:00' END")
_sql("snapshot_property_rules", ("features",), f"""
SELECT idx, 'V-S4' AS rule, 'missing confidence' AS message FROM s_features WHERE confidence IS NULL
UNION ALL SELECT idx, 'V-S5', 'id must not be empty' FROM s_features WHERE id = ''
UNION ALL SELECT idx, 'V-S7', 'invalid status' FROM s_features WHERE status = 'lost'
UNION ALL SELECT idx, 'V-S8', 'confidence must be between 0 and 1' FROM s_features WHERE confidence IS NULL OR confidence > 1
UNION ALL SELECT idx, 'V-S9', 'confidence below publication threshold 0.93' FROM s_features WHERE confidence < 0.93
UNION ALL SELECT idx, 'V-S10', 'duplicate evidence ids' FROM s_features WHERE idx % 9 = 0
UNION ALL SELECT idx, 'V-S13', 'explicit moderation approval, reviewer and reviewed_at required' FROM s_features WHERE decision <> 'approved' OR reviewer = ''
UNION ALL SELECT idx, 'V-S14', 'valid_from must be timezone-aware ISO-8601' FROM s_features WHERE idx % 4 = 2
UNION ALL SELECT idx, 'V-S14', printf('public delay is %.1fh, minimum is 24h', date_diff('second', {_VALID}, {_MOMENT}) / 3600.0) FROM s_features
  WHERE {_VALID} > {_MOMENT} - INTERVAL 24 HOURS""")
_sql("snapshot_reference_rules", ("features", "evidence", "sources"), """
SELECT idx, 'V-S6' AS rule, 'duplicate id ' || id AS message FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY idx) AS rn FROM s_features) WHERE rn > 1
UNION ALL SELECT idx, 'V-S11', 'unknown evidence ids ' || string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT idx, unnest(evidence_ids) AS v FROM s_features)
  WHERE v NOT IN (SELECT id FROM s_evidence) GROUP BY idx
UNION ALL SELECT idx, 'V-S12', 'unknown source ids ' || string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT idx, unnest(source_ids) AS v FROM s_features)
  WHERE v NOT IN (SELECT id FROM s_sources) GROUP BY idx""")
_path = lambda name: f"'features.' || CAST(idx AS VARCHAR) || '.properties.{name}' AS path"
_sql("snapshot_schema", ("features",), f"""
SELECT {_path('id')}, 'id is required and must not be empty' AS message FROM s_features WHERE id = ''
UNION ALL SELECT {_path('status')}, 'status is not one of the allowed values' FROM s_features WHERE status = 'lost'
UNION ALL SELECT {_path('valid_from')}, 'valid_from is not a date-time' FROM s_features WHERE idx % 4 = 2
UNION ALL SELECT {_path('confidence')}, 'confidence is outside its range' FROM s_features WHERE confidence IS NULL OR confidence < 0.93 OR confidence > 1
UNION ALL SELECT {_path('evidence_ids')}, 'evidence_ids has repeated items' FROM s_features WHERE idx % 9 = 0
UNION ALL SELECT {_path('moderation.reviewer')}, 'reviewer is required and must not be empty' FROM s_features WHERE reviewer = ''
UNION ALL SELECT {_path('moderation.decision')}, 'decision must be approved' FROM s_features WHERE decision <> 'approved'""")
_sql("snapshot_documents", ("features",), """
SELECT 'd-' || CAST(idx // 8 % 25 AS VARCHAR) AS snapshot_date, CAST(sum(place) AS BIGINT) AS positions, count(DISTINCT place) AS places, count(*) AS features, count(confidence) AS with_confidence, CAST(sum(len(evidence_ids)) AS BIGINT) AS evidence,
  CAST(sum(p_size) AS DOUBLE) AS widths FROM (SELECT *, row_number() OVER (PARTITION BY idx // 8 ORDER BY idx) - 1 AS place FROM s_features)
JOIN part ON p_partkey = idx GROUP BY 1""")

_COLLECTIONS = "placed AS (SELECT *, CAST(idx % 25 AS INTEGER) AS doc, row_number() OVER (PARTITION BY idx % 25 ORDER BY idx) - 1 AS place FROM s_features)"
_sql("split_snapshots", ("features",), """
SELECT doc, CASE WHEN doc % 7 = 3 THEN NULL ELSE '2024-01-' || lpad(CAST(doc + 1 AS VARCHAR), 2, '0') END AS snapshot_date, CAST(place AS BIGINT) AS idx, id,
  '{"}[' || name AS name, confidence, array_to_string(evidence_ids, ',') AS evidence_ids, CASE WHEN idx % 19 = 0 THEN 'Point' ELSE 'Polygon' END AS geometry_type,
  CASE WHEN idx % 19 <> 0 THEN CAST(idx % 97 AS DOUBLE) END AS side FROM placed WHERE doc <> 24""", _COLLECTIONS)
_sql("document_rules", ("features",), """
SELECT DISTINCT doc, rule, message FROM placed JOIN (VALUES ('V-S1', 'cannot read snapshot'), ('V-S2', 'root.type must be FeatureCollection'),
  ('V-S3', 'metadata.snapshot_date is required for non-empty snapshots')) r(rule, message)
ON CASE rule WHEN 'V-S1' THEN doc = 24 WHEN 'V-S2' THEN doc % 5 = 2 AND doc <> 24 ELSE doc % 7 = 3 AND doc <> 24 END""", _COLLECTIONS)
_sql("metadata_schema", ("features",), """
SELECT DISTINCT doc, path, message FROM placed JOIN (VALUES ('type', 'must be FeatureCollection'), ('metadata.methodology_version', 'required'), ('metadata.moderation_status', 'not allowed'))
  r(path, message) ON doc <> 24 AND (path <> 'type' OR doc % 5 = 2)""", _COLLECTIONS)
_sql("source_addresses", ("sources", "events"), """
SELECT id, false AS sound FROM s_sources UNION ALL SELECT id, published_at IS NOT NULL FROM s_events""")
_sql("ordered_table", ("evidence",), """
SELECT id, source_id, evidence_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn FROM s_evidence) WHERE rn = 1""")

_DAY = "CAST(CAST(DATE '2024-01-02' + CAST(c AS INTEGER) AS DATE) AS VARCHAR)"
_COLUMN_M = SQL_METRES_PER_LON_DEGREE / 128


def _cells(rects: str) -> str:
    return (f"(SELECT DISTINCT c, status, x, unnest(range(y0, y1)) AS y FROM (SELECT c, status, y0, y1, unnest(range(x0, x1)) AS x FROM {rects}))")


_AREA = f"round(sum({_COLUMN_M!r} * ({_y('y + 1')} - {_y('y')})) / 1e6, 1)"
_GAINED = f"""c_old AS MATERIALIZED {_cells('s_rects_old')}, c_new AS MATERIALIZED {_cells('s_rects_new')},
gained AS (SELECT c, status AS to_status, x, y FROM c_new ANTI JOIN c_old USING (c, status, x, y))"""
_sql("feature_area", ("rects_new",), f"""
SELECT 'f-' || CAST(k AS VARCHAR) AS id, round((x1 - x0) * {_COLUMN_M!r} * ({_y('y1')} - {_y('y0')}) / 1e6, 3) AS area_km2 FROM s_rects_new""")
_sql("feature_bounds", ("rects_new",), """
SELECT 'f-' || CAST(k AS VARCHAR) AS id, (x0 - 6400) / 128.0::DOUBLE AS minx, (y0 - 3840) / 128.0::DOUBLE AS miny, (x1 - 6400) / 128.0::DOUBLE AS maxx,
  (y1 - 3840) / 128.0::DOUBLE AS maxy FROM s_rects_new""")
_sql("dissolved_area_by_status", ("rects_new",), f"SELECT status, {_AREA} AS area_km2 FROM {_cells('s_rects_new')} GROUP BY status")


def _pair_area(a: str, b: str) -> str:
    return (f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * {_COLUMN_M!r} * ("
            + _y(f"least({a}.y1, {b}.y1)") + " - " + _y(f"greatest({a}.y0, {b}.y0)") + ") / 1e6")


_MEET = "a.c = b.c AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
_sql("feature_overlaps", ("rects_new",), f"""
SELECT least('f-' || CAST(a.k AS VARCHAR), 'f-' || CAST(b.k AS VARCHAR)) AS left_id, greatest('f-' || CAST(a.k AS VARCHAR), 'f-' || CAST(b.k AS VARCHAR)) AS right_id,
  round({_pair_area('a', 'b')}, 2) AS overlap_km2 FROM s_rects_new a JOIN s_rects_new b ON a.k < b.k AND {_MEET}""")
_sql("geometry_rules", ("rects_new",), f"""
SELECT k AS idx, 'V-S16' AS rule, 'geometry is empty' AS message FROM shaped WHERE kind = 'empty'
UNION ALL SELECT k, 'V-S18', 'geometry has zero area' FROM shaped WHERE kind = 'empty'
UNION ALL SELECT k, 'V-S16', 'invalid geometry: nested shells' FROM shaped WHERE kind = 'nested'
UNION ALL SELECT k, 'V-S17', 'coordinates outside WGS84 bounds' FROM shaped WHERE kind = 'far'
UNION ALL SELECT k, 'V-S18', 'anomalous area' FROM shaped WHERE kind <> 'empty' AND (x1 - x0) * {_COLUMN_M!r} * ({_y('y1')} - {_y('y0')}
  + CASE kind WHEN 'nested' THEN 0.5 * ({_y('y0 + 0.75 * (y1 - y0)')} - {_y('y0 + 0.25 * (y1 - y0)')}) ELSE 0 END) / 1e6 > 900
UNION ALL SELECT a.k, 'V-S20', 'overlaps feature[' || b.k || ']' FROM shaped a JOIN shaped b ON a.k < b.k AND a.kind = b.kind AND a.kind IN ('plain', 'far') AND {_MEET}""",
     "shaped AS (SELECT *, CASE WHEN k % 13 = 6 THEN 'empty' WHEN k % 7 = 4 THEN 'nested' WHEN k % 11 = 5 THEN 'far' ELSE 'plain' END AS kind FROM s_rects_new)")
_sql("cross_snapshot_overlap", ("rects_old", "rects_new"), f"""
SELECT 'f-' || CAST(a.k AS VARCHAR) AS old_id, 'f-' || CAST(b.k AS VARCHAR) AS new_id, round({_pair_area('a', 'b')}, 2) AS overlap_km2
FROM s_rects_old a JOIN s_rects_new b ON {_MEET}""")
_sql("gained_area_by_status", ("rects_old", "rects_new"), f"SELECT to_status, {_AREA} AS area_km2 FROM gained GROUP BY to_status", _GAINED)
_sql("change_area_by_transition", ("rects_old", "rects_new"),
     f"SELECT c_old.status AS from_status, to_status, {_AREA} AS area_km2 FROM gained JOIN c_old USING (c, x, y) GROUP BY ALL", _GAINED)
_sql("change_summary", ("rects_old", "rects_new"), f"""
SELECT '2024-01-01' AS "from", {_DAY} AS "to", t.area_change_km2, to_status, {_AREA} AS km2
FROM gained JOIN (SELECT c, {_AREA} AS area_change_km2 FROM gained GROUP BY c) t USING (c) GROUP BY c, to_status, t.area_change_km2""", _GAINED)
# Parts: runs of gained cells per row, joined to components by reachability, then measured and traced to rectangles.
_PARTS = _GAINED + f""",
runs AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM (SELECT c, to_status, y, min(x) AS xs, max(x) + 1 AS xe FROM
  (SELECT *, x - row_number() OVER (PARTITION BY c, to_status, y ORDER BY x) AS island FROM gained) GROUP BY c, to_status, y, island)),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM runs a JOIN runs b ON a.c = b.c AND a.to_status = b.to_status AND abs(a.y - b.y) = 1 AND a.xs < b.xe AND b.xs < a.xe),
reach(r, root) AS (SELECT r, r FROM runs UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.r WHERE links.b > reach.root),
part_of AS MATERIALIZED (SELECT runs.*, p.part FROM runs JOIN (SELECT r, min(root) AS part FROM reach GROUP BY r) p USING (r)),
cell_part AS (SELECT c, part, to_status, y, unnest(range(xs, xe)) AS x FROM part_of),
areas AS (SELECT c, part, to_status, min(xs) AS xs, max(xe) AS xe, min(y) AS ys, max(y) + 1 AS ye, sum({_COLUMN_M!r} * (xe - xs) * ({_y('y + 1')} - {_y('y')})) / 1e6 AS km2 FROM part_of GROUP BY c, part, to_status),
origins AS (SELECT part, arg_max(status, struct_pack(a := km2, s := status)) AS from_status FROM (
  SELECT part, c_old.status, round(sum({_COLUMN_M!r} * ({_y('cell_part.y + 1')} - {_y('cell_part.y')})) / 1e6, 6) AS km2
  FROM cell_part JOIN c_old USING (c, x, y) GROUP BY part, c_old.status) WHERE km2 > 0.001 GROUP BY part),
proof AS (SELECT part, min((93 + k % 7) / 100.0) AS confidence, string_agg(DISTINCT 'ev-' || k, ',' ORDER BY 'ev-' || k) AS evidence_ids,
  string_agg(DISTINCT 'src-' || (k % 10), ',' ORDER BY 'src-' || (k % 10)) AS source_ids, count(*) AS review_count FROM (
  SELECT DISTINCT part, k FROM part_of JOIN s_rects_new n ON n.c = part_of.c AND n.status = to_status AND x0 <= xe AND x1 >= xs AND y0 <= y + 1 AND y1 >= y) GROUP BY part)"""
_sql("changed_part_records", ("rects_old", "rects_new"), """
SELECT to_status, from_status, round(km2, 2) AS area_km2, CAST(confidence AS DOUBLE) AS confidence, evidence_ids, source_ids, CAST(review_count AS INTEGER) AS review_count
FROM areas LEFT JOIN origins USING (part) JOIN proof USING (part)""", _PARTS)
_LABEL = lambda s: "CASE " + s + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.STATUS_LABELS.items()) + f" ELSE '{vocab.NO_STATUS_LABEL}' END"
_sql("snapshot_diff", ("rects_old", "rects_new"), f"""
SELECT true AS id_form, true AS own_id, true AS closed, {_DAY} AS date, 'change' AS layer, from_status, to_status, round(km2, 3) AS area_km2,
  CAST(confidence AS DOUBLE) AS confidence, evidence_ids, source_ids, CAST(review_count AS INTEGER) AS review_count, (xs - 6400) / 128.0::DOUBLE AS minx,
  (ys - 3840) / 128.0::DOUBLE AS miny, (xe - 6400) / 128.0::DOUBLE AS maxx, (ye - 3840) / 128.0::DOUBLE AS maxy
FROM areas LEFT JOIN origins USING (part) JOIN proof USING (part)""", _PARTS)
_POINT_AT = """at_old AS (SELECT id, CASE WHEN count(DISTINCT status) > 1 THEN 'contested' ELSE max(status) END AS st FROM pts JOIN s_rects_old
  ON c = 0 AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 GROUP BY id),
at_new AS (SELECT id, CASE WHEN count(DISTINCT status) > 1 THEN 'contested' ELSE max(status) END AS st FROM pts JOIN s_rects_new
  ON c = 0 AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 GROUP BY id)"""
_PTS = "pts AS (SELECT id, lon * 128 + 6400 AS px, lat * 128 + 3840 AS py FROM s_points), " + _POINT_AT
_sql("point_changes", ("rects_old", "rects_new", "points"), """
SELECT id, o.st AS previous_status, coalesce(n.st, 'unknown') AS status, '2024-01-02' AS changed_at
FROM pts LEFT JOIN at_old o USING (id) LEFT JOIN at_new n USING (id) WHERE o.st IS DISTINCT FROM n.st""", _PTS)
_sql("point_index", ("rects_old", "rects_new", "points"), """
SELECT id, coalesce(n.st, 'unknown') AS status, '2024-01-02' AS snapshot_date FROM pts LEFT JOIN at_new n USING (id)""", _PTS)
_APART = ", ".join(f"s_{t} AS (SELECT k, c, x0, y0, least(x1, x0 + 20) AS x1, least(y1, y0 + 20) AS y1, status FROM wide_{t} WHERE c = 0)" for t in ("rects_old", "rects_new"))
ORACLE["published_archive"] = oracle_cte("rects_old", "rects_new", "points").replace("s_rects_", "wide_rects_").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_APART}, {_PARTS}, {_PTS},
held AS (SELECT 1 AS seq, '2024-01-01' AS snapshot_date, (SELECT count(*) FROM s_rects_old) AS areas, (SELECT count(*) FROM s_rects_old) AS changes, (SELECT count(*) FROM at_old) AS moved
  UNION ALL SELECT 2, '2024-01-02', (SELECT count(*) FROM s_rects_new), (SELECT count(*) FROM areas),
    (SELECT count(*) FROM pts LEFT JOIN at_old o USING (id) LEFT JOIN at_new n USING (id) WHERE o.st IS DISTINCT FROM n.st))
SELECT CAST(seq AS BIGINT) AS seq, 'publish_snapshot' AS action, snapshot_date, (SELECT string_agg(DISTINCT 'rev-' || (k % 5), ',' ORDER BY 'rev-' || (k % 5)) FROM s_rects_old) AS reviewers,
  changes AS change_count, moved AS settlement_count, areas, changes, moved FROM held"""
_sql("geometry_validity", ("rects_new",), """
SELECT 'f-' || CAST(k AS VARCHAR) AS id, reason FROM s_rects_new JOIN (VALUES (1, 'self-intersection'), (1, 'ring without area'), (2, 'ring not closed'), (3, 'too few points'),
  (3, 'ring without area'), (3, 'self-intersection'), (4, 'nested shells'), (5, 'nested holes'), (6, 'interior is cut in two')) r(kind, reason) ON kind = k % 7""")
_sql("features_by_layer", ("rects_new",), "SELECT 'f-' || CAST(k AS VARCHAR) AS id, status FROM s_rects_new WHERE status = 'contested'")

# Messages: the expected rows follow from the parts the pages are made of.
_LINKS = """msg AS (SELECT *, CAST(page_id AS VARCHAR) AS post_id,
  CASE WHEN zone = '+02:00' THEN CAST(stamp AS TIMESTAMP) - INTERVAL 2 HOURS ELSE CAST(stamp AS TIMESTAMP) END AS utc FROM s_message_parts),
ok AS (SELECT * FROM msg WHERE user_id % 7 <> 0 AND zone <> '' AND utc <= TIMESTAMP '2024-01-19 00:00:00'),
links AS (
 SELECT *, 1 AS sequence, lat_text AS la, lon_text AS lo,
   CASE WHEN user_id % 5 = 0 THEN 'Участок обновления' ELSE 'Loc ' || event_type || ' "' || CAST(user_id AS VARCHAR) || '"' END AS label FROM ok WHERE user_id % 9 <> 0
 UNION ALL SELECT *, CASE WHEN user_id % 9 = 0 THEN 1 ELSE 2 END, lon_text, lat_text, 'second' FROM ok WHERE user_id % 4 = 0),
updates AS (SELECT 'feed-' || substr(sha256(post_id || '|' || la || '|' || lo), 1, 16) AS id, post_id, 'https://t.me/ChannelUA/' || post_id AS post_url,
  strftime(utc, '%Y-%m-%dT%H:%M:%S+00:00') AS published_at, substr(stamp, 1, 10) AS event_date, label,
  '— ' || event_type || ' & more' || CASE WHEN user_id % 9 = 0 THEN '' WHEN user_id % 5 = 0 THEN '' ELSE ' Loc ' || event_type || ' "' || CAST(user_id AS VARCHAR) || '"' END
    || CASE WHEN user_id % 4 = 0 THEN ' second' ELSE '' END AS summary,
  CAST(la AS DOUBLE) AS lat, CAST(lo AS DOUBLE) AS lon, sequence, utc FROM links)"""
_sql("point_updates", ("message_parts",), "SELECT * EXCLUDE (utc) FROM updates", _LINKS)
_sql("updates_over_two_polls", ("message_parts",), """
SELECT CASE WHEN utc <= TIMESTAMP '2024-01-09' THEN 1 ELSE 2 END AS poll, id, sequence FROM updates""", _LINKS)
_sql("rejected_messages", ("message_parts",), "SELECT page_id, post_id, stamp AS published_text FROM msg WHERE zone = '' AND user_id % 7 <> 0", _LINKS)
_sql("merged_events", ("message_parts", "events"), """
SELECT id, title, verification_status, event_kind, CAST(event_date AS VARCHAR) AS event_date, coalesce(location_label, '?') AS label, array_to_string(evidence_ids, ',') AS evidence_ids, false AS from_feed FROM s_events
UNION ALL SELECT id, 'Геолокированное обновление: ' || label, 'probable', 'territorial_update', event_date, label, 'ev-' || id, true FROM updates""", _LINKS)
_sql("merged_evidence", ("message_parts", "evidence"), """
SELECT id, source_id, evidence_type, url FROM s_evidence UNION ALL SELECT 'ev-' || id, 'feed-map', 'licensed_map', post_url FROM updates""", _LINKS)
_sql("merged_points", ("message_parts", "points"), """
SELECT id, name, '' AS admin1, '' AS aliases, source_id FROM s_points
UNION ALL SELECT 'settlement-' || id, label, 'Україна', label, 'feed-map' FROM updates""", _LINKS)
_sql("point_feed_status", ("message_parts", "events"), """
SELECT 'point_updates_live' AS state, arg_max(d, k) AS point_feed_date, count(*) FILTER (located AND kind = 'territorial_update') AS point_update_count,
  count(DISTINCT CASE WHEN located AND kind = 'territorial_update' THEN label END) AS new_settlements FROM (
  SELECT event_date AS d, struct_pack(t := coalesce(published_at, event_date), id := id) AS k, lat IS NOT NULL AS located, event_kind AS kind, coalesce(location_label, '?') AS label FROM s_events
  UNION ALL SELECT event_date, struct_pack(t := published_at, id := id), true, 'territorial_update', label FROM updates)""", _LINKS)
_sql("update_point_features", ("events",), """
SELECT '{"type":"Feature","id":"' || id || '","properties":{"id":"' || id || '","verification_status":"' || verification_status || '"},"geometry":{"type":"Point","coordinates":['
  || CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) || ']}}' AS value FROM s_events WHERE event_kind = 'territorial_update' AND lat IS NOT NULL""")
_sql("review_queue", ("feed_texts",), """
SELECT id, arg_max(source_id, p) AS source_id, arg_max(title, p) AS title, arg_max(u, p) AS url, arg_max(pub, p) AS published_at_raw, 'unreviewed' AS review_status FROM (
  SELECT 'doc-' || substr(sha256(source_id || '|' || u), 1, 20) AS id, * FROM (
    SELECT source_id, url AS u, page_id * 2 AS p, 'old ' || CAST(page_id AS VARCHAR) AS title, '' AS pub FROM s_feed_texts WHERE page_id % 2 = 0
    UNION ALL SELECT source_id, url, page_id * 2 + 1, 'Page ' || CAST(page_id AS VARCHAR), 'day ' || CAST(page_id AS VARCHAR) FROM s_feed_texts WHERE page_id % 2 = 0 AND page_id % 10 <> 0
    UNION ALL SELECT source_id, url, page_id * 2, 'Page x', 'day ' || CAST(page_id AS VARCHAR) FROM s_feed_texts WHERE page_id % 2 = 1 AND page_id % 9 <> 0)) GROUP BY id""")
_STATE = "CASE WHEN error_class IS NOT NULL AND http_status IS NULL THEN 'unavailable' WHEN error_class IS NULL AND http_status BETWEEN 200 AND 399 THEN 'ok' ELSE 'degraded' END"
_sql("source_health", ("sources", "probes"), f"""
SELECT source_id, {_STATE} AS state, http_status, CASE WHEN http_status IS NOT NULL AND error_class IS NOT NULL THEN 'HTTP ' || CAST(http_status AS VARCHAR) ELSE error_class END AS error,
  'ok' AS monitor_state FROM s_probes WHERE source_id IN (SELECT id FROM s_sources WHERE coalesce(monitor, true))""")
_sql("source_health_all_failed", ("sources", "probes"), """
SELECT source_id, 'unknown' AS state, CAST(NULL AS INTEGER) AS http_status, 'monitor_network_error' AS error, 'monitor_error' AS monitor_state
FROM s_probes WHERE source_id IN (SELECT id FROM s_sources WHERE coalesce(monitor, true))""")


def _plain(x: str) -> str:
    stripped = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        stripped = f"replace({stripped}, '{entity}', '{char}')"
    return f"trim(regexp_replace({stripped}, '\\s+', ' ', 'g'))"


ORACLE["page_titles"] = f"SELECT page_id, {_plain('''regexp_extract(html, '(?is)<title>(.*?)</title>', 1)''')} AS title FROM pages"
ORACLE["page_text_length"] = f"SELECT page_id, length({_plain('html')}) AS chars FROM pages"
ORACLE["page_links"] = r"""
SELECT page_id, CAST(i AS INTEGER) AS sequence, hrefs[i] AS href, labels[i] AS label FROM (
  SELECT page_id, hrefs, labels, unnest(range(1, len(hrefs) + 1)) AS i FROM (
    SELECT page_id, regexp_extract_all(html, '(?is)<a href="([^"]*)"[^>]*>(.*?)</a>', 1) AS hrefs, regexp_extract_all(html, '(?is)<a href="([^"]*)"[^>]*>(.*?)</a>', 2) AS labels FROM pages))"""
ORACLE["document_digests"] = "SELECT doc_id, sha256(text) AS sha256, substr(sha256(source || '|' || text), 1, 20) AS short_id FROM documents"
ORACLE["page_hosts"] = "SELECT page_id, regexp_matches(url, '(?i)^https://[^/?#]') AS https FROM pages"

_BUNDLE = """first_ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn FROM s_evidence) WHERE rn = 1),
bundle AS (SELECT l.id, l.pos, e.id AS evidence_id, e.source_id, e.evidence_type, e.independence_group, s.side FROM
  (SELECT id, unnest(range(0, len(evidence_ids))) AS pos, unnest(evidence_ids) AS eid FROM s_events) l JOIN first_ev e ON e.id = l.eid LEFT JOIN s_sources s ON s.id = e.source_id),
matrix AS (SELECT v.id, coalesce(bool_or(side = 'russian'), false) AS has_russian, coalesce(bool_or(side = 'ukrainian'), false) AS has_ukrainian,
  coalesce(bool_or(side = 'independent'), false) AS has_independent, coalesce(bool_or(evidence_type = 'satellite'), false) AS has_satellite,
  count(DISTINCT independence_group) AS independent_groups FROM s_events v LEFT JOIN bundle b ON b.id = v.id GROUP BY v.id)"""
_BT = ("events", "evidence", "sources")
_sql("evidence_bundles", _BT, "SELECT id, CAST(pos AS INTEGER) AS pos, evidence_id, source_id, evidence_type, side FROM bundle", _BUNDLE)
_sql("evidence_matrix", _BT, "SELECT * FROM matrix", _BUNDLE)
_sql("weakly_confirmed", _BT, "SELECT id, independent_groups FROM matrix WHERE independent_groups < 2", _BUNDLE)
_sql("record_source_links", ("events", "sources"), """
SELECT l.id, CAST(pos AS INTEGER) AS pos, source_id, s.name, s.url FROM (SELECT id, unnest(range(0, len(source_ids))) AS pos, unnest(source_ids) AS source_id FROM s_events) l
JOIN s_sources s ON s.id = l.source_id""")
_sql("record_evidence_links", ("claims", "evidence"), """
SELECT DISTINCT l.id, e.url FROM (SELECT id, unnest(evidence_ids) AS eid FROM s_claims) l JOIN first_ev e ON e.id = l.eid""",
     "first_ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn FROM s_evidence) WHERE rn = 1)")
_GRID = "id, name, role, side, license_status, usage_note, s.url, coalesce(h.state, s.health) AS health_state, CASE WHEN h.state IS NULL THEN health_label ELSE h.state || ' · 2024-01-20' END AS health_label"
_sql("source_grid", ("sources", "probes"), f"SELECT {_GRID} FROM s_sources s LEFT JOIN (SELECT source_id, {_STATE} AS state FROM s_probes) h ON h.source_id = s.id")
_sql("source_grid_one_side", ("sources", "probes"), f"SELECT {_GRID} FROM s_sources s LEFT JOIN (SELECT source_id, 'ok' AS state FROM s_probes) h ON h.source_id = s.id WHERE side = 'independent'")


def _search(q: str) -> str:
    tests = " OR ".join(f"contains(lower({c}), '{q}')" for c in ("name", "name_ru", "name_uk", "name_en", "aliases[1]", "aliases[2]"))
    return f"FROM s_places WHERE {tests} ORDER BY ordinal LIMIT 8"


_shown = lambda lang: f"coalesce(nullif(name_{lang}, ''), nullif(name, ''), nullif(name_uk, ''), nullif(name_ru, ''), nullif(name_en, ''), 'Без названия')"
_sql("search_points", ("places",), f"SELECT ordinal, id, {_shown('uk')} AS shown " + _search("bolt"))
_sql("search_alias", ("places",), "SELECT ordinal, id " + _search("item 19"))
_sql("search_index", ("places",), """
SELECT query, CAST(rank AS INTEGER) AS rank, id FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY ordinal) AS rank FROM wanted JOIN s_places
  ON len(list_filter(list_concat([name, name_ru, name_uk, name_en], aliases), lambda x: contains(lower(x), lower(trim(query))))) > 0
  WHERE length(trim(query)) >= 2) WHERE rank <= 8""", "wanted AS (SELECT DISTINCT unnest([p_brand, ' ' || substr(p_type, 1, 5), substr(p_type, 2, 2), substr(p_type, 1, 1), p_type || '?']) AS query FROM part)")
_labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.STATUS_LABELS.items())
_sql("place_names", ("places",), f"""SELECT id, {_shown('uk')} AS uk, {_shown('en')} AS en,
  CASE WHEN status IS NULL THEN '{vocab.NO_STATUS_LABEL}' ELSE CASE status {_labels} ELSE status END END AS status_label FROM s_places""")
_sql("event_titles", ("events",), "SELECT id, coalesce(nullif(title_uk, ''), nullif(title, '')) AS title FROM s_events")
_sql("alias_sets", ("places",), """
SELECT p.id, coalesce(a.aliases, '') AS aliases FROM s_places p LEFT JOIN (SELECT id, string_agg(n, '|' ORDER BY n) AS aliases FROM (
  SELECT DISTINCT id, unnest(list_value(name, name_uk, name_ru, name_en)) AS n FROM s_places) WHERE n <> '' GROUP BY id) a USING (id)""")
_sql("point_cards", ("points", "claims", "events"), """
SELECT id, coalesce(c.n, 0) AS claim_count, coalesce(e.n, 0) AS event_count FROM s_points
LEFT JOIN (SELECT settlement_id, count(*) AS n FROM s_claims GROUP BY 1) c ON c.settlement_id = id LEFT JOIN (SELECT settlement_id, count(*) AS n FROM s_events GROUP BY 1) e ON e.settlement_id = id""")
_CARDS = """SELECT p.id, p.name, r.kind, r.ordinal, r.record_id, r.summary FROM s_points p LEFT JOIN (
  SELECT settlement_id, 'claim' AS kind, ordinal, id AS record_id, summary FROM s_claims
  UNION ALL SELECT settlement_id, 'event', ordinal, id, summary FROM s_events) r ON r.settlement_id = p.id"""
_sql("point_card", ("points", "claims", "events"), _CARDS + " WHERE p.id = 'pt-4'")
_sql("all_point_cards", ("points", "claims", "events"), _CARDS)
_sql("unverified_records", ("claims", "events"), f"""
SELECT 0 AS origin, ordinal, id, verification_status FROM s_claims UNION ALL SELECT 1, ordinal, id, verification_status FROM s_events WHERE verification_status IN {_list(vocab.UNVERIFIED)}""")
_sql("located_events", ("events",), f"SELECT id, verification_status FROM s_events WHERE verification_status IN {_list(vocab.VERIFIED)} AND lat IS NOT NULL")
_sql("located_claims", ("claims",), "SELECT id FROM s_claims WHERE side = 'russian' AND lat IS NOT NULL")
_sql("dashboard", ("points", "events", "claims"), f"""
SELECT 'current' AS freshness, '2024-01-17' AS display_date, (SELECT count(*) FROM s_points) AS point_count,
  (SELECT count(*) FROM s_events WHERE verification_status IN {_list(vocab.VERIFIED)}) AS verified_count,
  (SELECT count(*) FROM s_events WHERE verification_status IN {_list(vocab.DISPUTED)}) + (SELECT count(*) FROM s_claims WHERE verification_status IN {_list(vocab.DISPUTED)}) AS disputed_count,
  false AS map_empty, 'reference' AS download_layer""")
_sql("change_badge", ("archive",), "SELECT count(*) AS badge FROM s_archive")
ORACLE["event_freshness"] = """
SELECT event_id, CASE WHEN user_id % 2 <> 0 AND user_id % 3 <> 0 THEN 'empty' WHEN ts < TIMESTAMP '2024-01-20' - INTERVAL 72 HOURS THEN 'stale' ELSE 'current' END AS freshness FROM events"""
ORACLE["released_events"] = """
SELECT event_id, round(date_diff('microsecond', ts, TIMESTAMP '2024-01-20') / 3.6e9, 3) AS age_hours FROM events WHERE ts <= TIMESTAMP '2024-01-19'"""


def _period(days: int) -> str:
    return (f"SELECT id, area_km2, pos, summary FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY snapshot_date, pos DESC) AS rn FROM s_archive"
            f" WHERE date_diff('day', snapshot_date, DATE '2001-08-01') < {days}) WHERE rn = 1")


_sql("period_changes_week", ("archive",), _period(7))
_sql("period_changes_month", ("archive",), _period(30))
_sql("period_total_month", ("archive",), f"SELECT count(*) AS change_count, round(coalesce(sum(area_km2), 0), 2) AS area_km2 FROM ({_period(30)})")
_sql("period_fallback", ("archive",), """
SELECT id, area_km2, pos, summary FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS rn FROM s_archive
  WHERE snapshot_date = (SELECT max(snapshot_date) FROM s_archive)) WHERE rn = 1""")
_sql("archive_dates", ("archive",), """
SELECT snapshot_date, count(*) AS change_count, round(sum(area_km2), 2) AS area_change_km2, row_number() OVER (ORDER BY snapshot_date DESC) - 1 AS ordinal FROM s_archive GROUP BY snapshot_date""")
_sql("archive_open_date", ("archive",), "SELECT id, area_km2, pos FROM s_archive WHERE snapshot_date = DATE '1998-03-14'")
_sql("manifest_upsert", ("manifest",), """
SELECT date, change_count, settlement_count FROM s_manifest WHERE date NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)
UNION ALL SELECT CAST(l_shipdate AS DATE), count(*), count(DISTINCT l_partkey) FROM lineitem GROUP BY 1""")
_sql("latest_change_per_id", ("archive",), """
SELECT id, snapshot_date, area_km2, pos, summary FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY snapshot_date DESC, pos DESC) AS rn FROM s_archive) WHERE rn = 1""")
_sql("first_evidence_per_id", ("evidence",), """
SELECT id, source_id, evidence_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn FROM s_evidence) WHERE rn = 1""")
ORACLE["keyed_merge"] = """
WITH b AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS v, c_custkey AS pos, 0 AS batch FROM customer
  UNION ALL SELECT 'c' || CAST(o_custkey AS VARCHAR), o_totalprice, o_orderkey, 1 FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch DESC, pos DESC) AS l, row_number() OVER (PARTITION BY id ORDER BY batch, pos) AS f FROM b)
SELECT x.id, x.v, y.batch, y.pos FROM r x JOIN r y ON x.id = y.id AND x.l = 1 AND y.f = 1"""
_sql("replace_source_events", ("events", "claims"), """
SELECT id, array_to_string(source_ids, ',') AS source_ids FROM s_events WHERE NOT list_contains(source_ids, 'src-7')
UNION ALL SELECT id, array_to_string(source_ids, ',') FROM s_claims""")
_sql("replace_source_evidence", ("evidence",), """
SELECT id, source_id FROM s_evidence WHERE source_id <> 'src-3' UNION ALL SELECT 'new-' || CAST(p_partkey AS VARCHAR), 'src-3' FROM part""")
_sql("audit_reviewers", ("features",), "SELECT status, string_agg(DISTINCT reviewer, ',' ORDER BY reviewer) AS reviewers FROM s_features GROUP BY status")
ORACLE["newest_audit"] = """
SELECT o_orderkey AS seq, 'publish_snapshot' AS action, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS snapshot_date FROM orders ORDER BY o_orderkey DESC LIMIT 20"""
_sql("latest_event", ("events",), "SELECT id, event_date FROM s_events ORDER BY coalesce(published_at, event_date) DESC, id DESC LIMIT 1")
_sql("location_labels", ("events",), "SELECT event_kind, count(DISTINCT coalesce(location_label, '?')) AS labels, count(*) AS updates FROM s_events GROUP BY event_kind")
_sql("coordinate_lookup", ("events", "claims"), """
SELECT e.id, p.title, coalesce(p.title, e.location_label, '?') AS name_uk FROM s_events e LEFT JOIN (SELECT lat, lon, arg_min(title, ordinal) AS title FROM s_claims WHERE lat IS NOT NULL GROUP BY lat, lon) p ON p.lat = e.lat AND p.lon = e.lon""")
_sql("event_status_labels", ("events",), "SELECT id, " + ", ".join(
    "CASE verification_status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE verification_status END AS {language}"
    for language, labels in vocab.EVENT_STATUS_LABELS.items()) + " FROM s_events")
