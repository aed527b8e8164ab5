"""Readers, text functions, messages and merges at their limits."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from geoledger import schemas
from geoledger.functions import text as T
from geoledger.functions.values import https_with_host, is_date_time, is_uri, utc, zoned_timestamp
from geoledger.plans.intake import collect_documents, queue_entries, source_health
from geoledger.plans.messages import FeedProfile, extract_point_updates, gazetteer, merge_point_updates, newest_first
from geoledger.operators.grams import search, searched_names, write_postings
from geoledger.sources.feeds import feed_config, feed_entries, read_feed_files, read_message_pages, rejected_feeds
from geoledger.sources.tables import content_digest, empty_table, export_json, read_json_table

NOW = datetime(2026, 8, 22, 12)
PROFILE = FeedProfile("map-feed", "SomeChannel", "map.example", "upd", "SomeMap", "some")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text_functions(spark):
    assert one(spark, T.plain_text(F.lit(" a&nbsp;<b>b</b>\t&mdash; c &lt;d&gt; "))) == "a b — c <d>"
    assert one(spark, T.after_marker(F.lit("x MARK y MARK z"), "MARK")) == " y MARK z"
    assert one(spark, T.before_stops(F.lit("one 💬 two · three"), ("💬", "two"))) == "one "
    assert one(spark, T.strip_chars(F.lit(" .·⚔️text.🗺"), PROFILE.trim_chars)) == "text"


def test_urls_and_times(spark):
    cases = {"https://a.example/x": True, "HTTPS://a.example": True, "http://a.example": False, "https://": False, "": False, None: False, "no url": False,
             "https://my_host.example/x": True, "https://пример.рф/a b|{c}": True, "https:///x": False, "https://?x": False}
    for url, want in cases.items():
        assert one(spark, https_with_host(F.lit(url).cast("string"))) is want, url
    assert one(spark, zoned_timestamp(F.lit("2026-01-01T02:00:00+02:00"))) == one(spark, utc(datetime(2026, 1, 1)))
    moments = {"2026-01-01T00:00:00Z": True, "2026-01-01t00:00:00.5+02:00": True, "2026-01-01T00:00:00": False, "2026-13-01T00:00:00Z": False, "2026-01-01": False, None: False}
    uris = {"https://a.example/x?y=%20#z": True, "urn:a:b": True, "http://[::1]/": True, "https://a b": False, "//a.example": False, "x": False, "https://a/%zz": False, "https://a/{b}": False, None: False}
    for sound, cases in ((is_date_time, moments), (is_uri, uris)):
        assert [one(spark, sound(F.lit(v).cast("string"))) for v in cases] == list(cases.values())
    for bad in ("2026-01-01T00:00:00", "yesterday", "", "2026-13-01T00:00:00Z"):
        assert one(spark, zoned_timestamp(F.lit(bad))) is None


def message(post, at, body):
    return f'<div class="tgme_widget_message_wrap x"><div data-post="SomeChannel/{post}">{body}<time datetime="{at}">t</time></div></div>'


def test_message_pages(spark, tmp_path):
    link = lambda lat, lon, label, lang="": f'<a href="https://map.example/{lang}#10/{lat}/{lon}" target=x>{label}</a>'
    exact = (NOW - timedelta(hours=24)).isoformat() + "+00:00"
    html = "head" + "".join([
        message(1, exact, "Мапу оновлено! Ворог просунувся " + link("48.462732", "37.739539", "<b>Raw\nname</b>") + link("48.5", "-37.5", " ", "en/") + " 💬 chat"),
        message(2, (NOW - timedelta(hours=23)).isoformat() + "+00:00", "Мапу оновлено " + link(1, 2, "fresh")),
        message(3, "2026-08-20T01:00:00+03:00", "Мапу оновлено 💬" + link(3, 4, "night") + link(3, 4, "again")),
        message(4, "2026-08-20T01:00:00+03:00", "мапу оновлено " + link(5, 6, "marker differs in case")),
        message(5, "2026-08-20T01:00:00+03:00", "Мапу оновлено без посилань"),
    ])
    (tmp_path / "page.html").write_text(html, encoding="utf-8")
    pages = read_message_pages(spark, str(tmp_path / "page.html"))
    updates = extract_point_updates(pages, utc(NOW), PROFILE)
    rows = newest_first(updates).collect()
    assert [(r.post_id, r.sequence, r.label) for r in rows] == [("1", 1, "Raw name"), ("1", 2, "Участок обновления"), ("3", 1, "night"), ("3", 2, "again")]
    assert rows[0].summary == "! Ворог просунувся Raw name" and rows[2].summary == "SomeMap опубликовал геолокированное обновление карты."
    assert str(rows[2].event_date) == "2026-08-20" and rows[1].lon == -37.5 and rows[2].id == rows[3].id

    events = spark.createDataFrame([], schemas.EVENTS)
    old = spark.createDataFrame([("p0", "Я", "map-feed"), ("p1", "Б", "other")], "id string, name string, source_id string")
    points = empty_table(spark, schemas.POINTS).unionByName(old, allowMissingColumns=True)
    status = spark.createDataFrame([("kept", "2026-01-01")], "state string, snapshot_date string")
    merged = merge_point_updates(updates, events, spark.createDataFrame([], schemas.EVIDENCE), points, status, gazetteer(spark), PROFILE, utc(NOW))
    by_label = {e.location_label: e for e in merged.events.collect()}
    assert set(by_label) == {"Іванопілля", "Участок обновления", "again"}
    assert by_label["Іванопілля"].title == "Геолокированное обновление: Иванополье"
    assert by_label["Іванопілля"].published_at == exact
    found = {p.id: p for p in merged.points.collect()}
    assert "p0" not in found and "p1" in found and len(found) == 4
    known = next(p for p in found.values() if p.name == "Иванополье")
    assert known.aliases == sorted(["Ivanopillia", "Raw name", "Иванополье", "Іванопілля"]) and known.admin1 == "Донецька область"
    record = merged.status.first()
    assert (record.state, record.snapshot_date, record.point_update_count, record.new_settlements) == ("point_updates_live", "2026-01-01", 3, 3)


def test_feeds(spark, tmp_path):
    rss = ("<rss><channel><title>channel</title><item><title> A  b </title><link>https://x.example/1</link><pubDate>d1</pubDate></item>"
           "<item><title>later</title><link>https://x.example/1</link></item><item><title> </title><link>https://x.example/2</link></item>"
           "<item><title>no link</title></item></channel></rss>")
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T &amp; t</title><link href="https://y.example/1"/>'
            "<updated>d2</updated></entry></feed>")
    (tmp_path / "a.xml").write_text(rss)
    (tmp_path / "b.xml").write_text(atom)
    mixed = ("<rss><channel><!-- <item><title>no</title><link>https://z.example/no</link></item> --><item><title>Page <![CDATA[x & y]]></title>"
             "<link>https://z.example/1?a&amp;b</link></item></channel></rss>")
    feeds = spark.createDataFrame([("s1", 0, rss), ("s2", 1, atom), ("s3", 2, "<html>not a feed"), ("s4", 3, mixed)], "source_id string, feed_pos bigint, xml string")
    got = {(r.source_id, r.title, r.url, r.published_at_raw) for r in collect_documents(feeds, utc(NOW)).collect()}
    assert got == {("s1", "later", "https://x.example/1", ""), ("s2", "T & t", "https://y.example/1", "d2"), ("s4", "Page x & y", "https://z.example/1?a&b", "")}
    assert [r.source_id for r in rejected_feeds(feeds).collect()] == ["s3"]
    files = read_feed_files(spark, str(tmp_path / "a.xml"), "s1").filter("length(title) > 0 AND length(url) > 0")
    assert {r.title for r in queue_entries(files, utc(NOW)).collect()} == {"later"}
    entries = read_feed_files(spark, str(tmp_path / "b.xml"), "s2", "entry").collect()
    assert [(e.title, e.url, e.published_at_raw) for e in entries] == [("T & t", "https://y.example/1", "d2")]
    config = feed_config(spark, [{"id": "on", "enabled": True, "feed_url": "https://f"}, {"id": "off", "feed_url": "https://f"}, {"id": "bare", "enabled": True}])
    assert [r.id for r in config.collect()] == ["on"]


def test_entries_at_any_depth_and_in_document_order(spark):
    deep = ('<r:RDF xmlns:r="urn:r" xmlns="urn:f"><group><list><item><meta><title>deep</title></meta><updated>u</updated><published>p</published><link/>'
            '<link href="https://b.example/second">https://b.example/text</link></item></list></group>'
            "<entry><title> </title><title>second</title><link>  </link><link href='https://c.example/2'/><pubDate></pubDate><published>p2</published></entry>"
            "<item><entry><title>inner</title><link href='https://d.example/in'/></entry><title>outer</title><link>https://d.example/out</link></item></r:RDF>")
    rows = feed_entries(spark.createDataFrame([("s", 0, deep), ("s", 1, None), ("s", 2, ""), ("s", 3, "<r/>")], "source_id string, feed_pos int, xml string")).orderBy("entry_pos").collect()
    assert [(r.entry_pos, r.title, r.url, r.published_at_raw) for r in rows] == [
        (0, "deep", "https://b.example/text", "u"), (1, "", "", "p2"),  # white space counts as found; the first link has no address
        (2, "inner", "https://d.example/out", ""), (3, "inner", "https://d.example/in", "")]


def test_search_by_index_equals_the_scan(spark, tmp_path):
    words = ["Bolt", "bo", "Größe", "Київ", "ab", "a", "", "olt b", "100%_x", "aaa aaaa", "BOLTED bolt"]
    rows = [(f"p{k}", k, words[k % len(words)], None if k % 3 else words[(k * 7) % len(words)], None if k % 4 == 1 else [words[(k * 5) % len(words)], None]) for k in range(60)]
    places = spark.createDataFrame(rows, "id string, ordinal int, name string, name_uk string, aliases array<string>")
    names = [F.col("name"), F.col("name_uk")]
    asked = ["  BoLt ", "bo", "b", "", "київ", "ИЇ", "%_", "aaaa", "lt b", "größe", "zz", "nothing here", None]
    write_postings(places, "id", searched_names(names, F.col("aliases")), str(tmp_path))
    got = {}
    for r in search(spark, str(tmp_path), spark.createDataFrame([(q,) for q in asked], "query string"), places, "id", searched_names(names, F.col("aliases")), "ordinal").collect():
        got.setdefault(r.query, {})[r.rank] = r.id
    for q in asked:
        want = [] if q is None else [r.id for r in places.filter(T.name_matches(q, names, F.col("aliases"))).orderBy("ordinal").limit(8).collect()]
        assert [v for _, v in sorted(got.get(q, {}).items())] == want, q
    plan = spark.read.parquet(f"{tmp_path}/postings").where(F.col("bucket").isin([3]))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan


def test_health(spark):
    sources = spark.createDataFrame([("a", None), ("b", True), ("c", False)], "id string, monitor boolean")
    schema = "source_id string, http_status int, error_class string, checked_at timestamp"
    ok = spark.createDataFrame([("a", 200, None, NOW), ("b", None, "URLError", NOW), ("c", 500, "HTTPError", NOW)], schema)
    assert {r.source_id: (r.state, r.monitor_state) for r in source_health(sources, ok).collect()} == {"a": ("ok", "ok"), "b": ("unavailable", "ok")}
    down = spark.createDataFrame([("a", None, "URLError", NOW), ("b", None, "TimeoutError", NOW), ("c", 200, None, NOW)], schema)
    assert {(r.state, r.error, r.monitor_state) for r in source_health(sources, down).collect()} == {("unknown", "monitor_network_error", "monitor_error")}
    assert source_health(sources, ok.limit(0)).count() == 0


def test_tables(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('[{"id": "e1", "source_id": "s"}, {"id": "e2"}]')
    table = read_json_table(spark, str(path), schemas.EVIDENCE)
    assert [r.id for r in table.orderBy("id").collect()] == ["e1", "e2"]
    export_json(table, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["id", "source_id"]
    import hashlib
    assert content_digest(spark, str(path)).first().sha256 == hashlib.sha256(path.read_bytes()).hexdigest()


def test_ordered_and_exported_outputs(spark, tmp_path):
    import json

    from geoledger.plans.messages import MergedTables, in_publishing_order
    from geoledger.sources.geojson import read_features, write_changes

    events = spark.createDataFrame([("a", None, "2026-01-01"), ("b", "2026-01-03", None), ("c", "2026-01-03", None), ("d", None, None)],
                                   "id string, published_at string, event_date string")
    evidence = spark.createDataFrame([("x", None), ("y", "2026-01-01"), ("z", "2026-01-01")], "id string, published_at string")
    points = spark.createDataFrame([("1", "Я"), ("2", None), ("3", "А")], "id string, name string")
    sorted_tables = in_publishing_order(MergedTables(events, evidence, points, events))
    ids = lambda df: [r.id for r in df.collect()]
    assert (ids(sorted_tables.events), ids(sorted_tables.evidence), ids(sorted_tables.points)) == (["c", "b", "a", "d"], ["z", "y", "x"], ["2", "3", "1"])
    changes = spark.sql("SELECT 'chg-\"1' AS id, '2026-01-02' AS date, 'change' AS layer, 'contested' AS status, 0.5D AS area_km2, CAST(NULL AS string) AS from_status,"
                        " 'contested' AS to_status, 'n' AS name, 's' AS summary, 0.95D AS confidence, array('e') AS evidence_ids, array('s') AS source_ids,"
                        " array('r') AS reviews, array(array(array(array(0D, 0D), array(1D, 0D), array(1D, 1D), array(0D, 0D)))) AS geometry")
    summary = spark.sql("SELECT '2026-01-01' AS from, '2026-01-02' AS to, 0.5D AS area_change_km2, map('contested', 0.5D) AS by_status_km2, 1L AS feature_count")
    write_changes(changes, summary, str(tmp_path / "changes"))
    feature = json.loads(spark.read.text(str(tmp_path / "changes/features")).first().value)
    assert feature["id"] == feature["properties"]["id"] == 'chg-"1' and feature["geometry"]["type"] == "Polygon"
    head = json.loads(spark.read.text(str(tmp_path / "changes/head")).first().value)
    assert head["metadata"] == {"from": "2026-01-01", "to": "2026-01-02", "area_change_km2": 0.5, "by_status_km2": {"contested": 0.5}, "feature_count": 1}
    row = read_features(spark, str(tmp_path / "changes/features")).first()
    assert (row.id, row.confidence, len(row.geometry[0][0])) == ('chg-"1', 0.95, 4)
