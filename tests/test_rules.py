"""Snapshot and registry rules, including exact limits."""

import json
from datetime import datetime, timedelta, timezone

import pytest

from conftest import rect
from geoledger import schemas
from geoledger.functions.values import utc
from geoledger.plans.publish import Rejected, publish
from geoledger.plans.registry_rules import validate_registry
from geoledger.plans.snapshot_rules import validate_snapshot
from geoledger.plans.readside import newest_audit
from geoledger.sources.archive import open_archive, open_snapshot, ordered_manifest, read_audit, read_commits, read_manifest, vacuum
from geoledger.sources.geojson import read_snapshot
from geoledger.sources.tables import empty_table, read_json_table, read_newest_version, read_parquet_table
from geoledger.streaming.release import publish_held, read_released, release_stream

NOW = datetime(2026, 1, 10, 12, tzinfo=timezone.utc)


def snapshot_feature(i, geometry, kind="Polygon", **changes):
    props = {"id": f"f{i}", "name": "n", "status": "contested", "valid_from": (NOW - timedelta(hours=24)).isoformat(), "confidence": 0.93,
             "evidence_ids": ["ev-1"], "source_ids": ["s-1"],
             "moderation": {"decision": "approved", "reviewer": f"r{i}", "reviewed_at": "2026-01-09T00:00:00Z", "rationale": "seen"}}
    props.update(changes)
    return {"type": "Feature", "properties": {k: v for k, v in props.items() if v is not ...}, "geometry": {"type": kind, "coordinates": geometry}}


def document(path, features, day="2026-01-10", **changes):
    doc = {"type": "FeatureCollection", "metadata": {"snapshot_date": day, "methodology_version": "1.1"}, "features": features}
    doc.update(changes)
    path.write_text(json.dumps(doc), encoding="utf-8")
    return str(path)


def square(x, y=0, size=0.05):
    return rect(x, y, x + size, y + size)[0]


def test_every_snapshot_rule(spark, tmp_path):
    rows = [
        snapshot_feature(0, square(0)),                                           # age and confidence exactly at the limit
        snapshot_feature(1, square(0.02)),                                        # overlaps feature 0
        snapshot_feature(2, square(1), valid_from=(NOW - timedelta(hours=23)).isoformat(), confidence=0.8),
        snapshot_feature(3, square(2), valid_from="2026-01-01T00:00:00", confidence=True),
        snapshot_feature(4, square(3), id="f3", status="lost", evidence_ids=[], source_ids=["s-9"]),
        snapshot_feature(5, square(4), name=..., moderation={"decision": "pending"}, evidence_ids=["ev-1", "ev-1", "ev-9"]),
        snapshot_feature(6, [1.0, 2.0], kind="Point"),
        snapshot_feature(7, "broken"),
        snapshot_feature(8, [[[10, 0], [11, 1], [11, 0], [10, 1], [10, 0]]]),     # bow tie
        snapshot_feature(9, square(179.98)),                                      # leaves the globe
        snapshot_feature(10, [square(20, size=10)[0]], kind="Polygon"),           # too large
        snapshot_feature(11, [square(40), square(50)], kind="MultiPolygon"),
    ]
    docs = read_snapshot(spark, document(tmp_path / "s.geojson", rows))
    known = lambda v: spark.createDataFrame([(v,)], "id string")
    found = {(r.idx, r.rule) for r in validate_snapshot(docs, utc(NOW), known("ev-1"), known("s-1")).collect()}
    assert found == {
        (0, "V-S20"), (2, "V-S9"), (2, "V-S14"), (3, "V-S14"), (3, "V-S8"), (4, "V-S6"), (4, "V-S7"), (4, "V-S10"), (4, "V-S12"),
        (5, "V-S4"), (5, "V-S10"), (5, "V-S11"), (5, "V-S13"), (6, "V-S15"), (7, "V-S19"), (8, "V-S16"), (9, "V-S17"), (10, "V-S18"),
    }


def test_document_rules_and_fallback(spark, tmp_path):
    broken = tmp_path / "broken.geojson"
    broken.write_text("{not json", encoding="utf-8")
    assert [r.rule for r in validate_snapshot(read_snapshot(spark, str(broken)), utc(NOW)).collect()] == ["V-S1"]
    odd = document(tmp_path / "odd.geojson", [snapshot_feature(0, square(0))], day=None, type="Feature")
    assert {r.rule for r in validate_snapshot(read_snapshot(spark, odd), utc(NOW)).collect()} == {"V-S2", "V-S3"}
    assert read_json_table(spark, str(tmp_path / "absent.json"), schemas.EVIDENCE).count() == 0


def test_registry_accepts_sound_tables(spark):
    sources = spark.createDataFrame([(0, "s-1", "n", "r", "independent", "k", "https://a.example/", None, None, "l", None, "u")],
                                    "ordinal bigint, " + schemas.SOURCES)
    evidence = spark.createDataFrame([(0, "ev-1", "s-1", "2026-01-01T00:00:00Z", "https://a.example/1", "satellite", "g", "n")],
                                     "ordinal bigint, " + schemas.EVIDENCE)
    events = spark.sql("SELECT 0L AS ordinal, 'e' AS id, 't' AS title, 's' AS summary, '2026-01-01' AS event_date, 'claim' AS verification_status,"
                       " array('s-1') AS source_ids, array('ev-1') AS evidence_ids")
    manifest = spark.createDataFrame([(0, "2026-01-02"), (1, "2026-01-01")], "ordinal bigint, date string")
    assert validate_registry(sources, evidence, events, events.limit(0), manifest).count() == 0
    rising = spark.createDataFrame([(0, "2026-01-01"), (1, "2026-01-02"), (2, "2026-01-02")], "ordinal bigint, date string")
    assert {r.rule for r in validate_registry(sources, evidence, events, events.limit(0), rising).collect()} == {"V-D14", "V-D15"}


def test_publication_end_to_end(spark, tmp_path):
    root = str(tmp_path / "out")
    points = spark.createDataFrame([("p1", 0.01, 0.01), ("p2", 0.06, 0.01)], "id string, lon double, lat double")
    first = document(tmp_path / "first.geojson", [snapshot_feature(0, square(0))], "2026-01-09")
    second = document(tmp_path / "second.geojson", [snapshot_feature(1, square(0)), snapshot_feature(2, square(0.05))], "2026-01-10")
    try:
        publish(spark, first, root, False, NOW, points)
        raise AssertionError("published without approval")
    except Rejected:
        pass
    overlapping = document(tmp_path / "bad.geojson", [snapshot_feature(0, square(0)), snapshot_feature(1, square(0.01))])
    try:
        publish(spark, overlapping, root, True, NOW, points)
        raise AssertionError("published a rejected snapshot")
    except Rejected as refused:
        assert {r.rule for r in refused.violations.collect()} == {"V-S20"}
    assert publish(spark, first, root, True, NOW, points) == "2026-01-09"
    publish(spark, second, root, True, NOW, points)
    publish(spark, second, root, True, NOW, points)  # a repeated run replaces its own date
    manifest = {r.date: r for r in read_manifest(spark, root).collect()}
    assert set(manifest) == {"2026-01-09", "2026-01-10"}
    assert (manifest["2026-01-10"].change_count, manifest["2026-01-10"].settlement_count) == (1, 1)
    from geoledger.schemas import CHANGES
    old, new = (open_snapshot(spark, root, "changes", d, CHANGES).collect() for d in ("2026-01-09", "2026-01-10"))
    assert len(old) == 1 and len(new) == 1 and new[0].geometry[0][0][0] == [0.05, 0.0]
    assert open_snapshot(spark, root, "changes", "2020-01-01", CHANGES).count() == 0
    audit = newest_audit(read_audit(spark, root)).collect()  # the repeated run is no publication of its own
    assert [(a.seq, a.snapshot_date, a.reviewers) for a in audit] == [(2, "2026-01-10", ["r1", "r2"]), (1, "2026-01-09", ["r0"])]
    status = read_newest_version(spark, f"{root}/status_current", schemas.STATUS).collect()
    assert [(r.snapshot_date, r.version) for r in status] == [("2026-01-10", 2)]
    shown = open_archive(spark, root)
    assert (shown["current"].count(), shown["changes"].count(), shown["previous"].count()) == (2, 1, 1)
    assert open_archive(spark, root, "2026-01-09")["previous"].count() == open_archive(spark, root, "2020-01-01")["current"].count() == 0
    assert [(r.date, r.ordinal) for r in ordered_manifest(read_manifest(spark, root)).orderBy("ordinal").collect()] == [("2026-01-10", 0), ("2026-01-09", 1)]


def test_a_broken_publication_leaves_the_old_archive(spark, tmp_path, monkeypatch):
    """Whatever step breaks off, readers see the old state whole; one more run completes it with one commit."""
    root = str(tmp_path / "out")
    points = spark.createDataFrame([("p1", 0.01, 0.01)], "id string, lon double, lat double")
    first = document(tmp_path / "first.geojson", [snapshot_feature(0, square(0))], "2026-01-09")
    second = document(tmp_path / "second.geojson", [snapshot_feature(1, square(0.05))], "2026-01-09")
    publish(spark, first, root, True, NOW, points)
    reader = open_archive(spark, root)
    state = lambda tables: ([r.id for r in tables["current"].collect()], tables["changes"].count(), [r.snapshot_sha256 for r in tables["status"].collect()])
    old = state(reader)
    for step in ("commit_manifest_row",):
        with monkeypatch.context() as broken, pytest.raises(OSError):
            broken.setattr(f"geoledger.plans.publish.{step}", lambda *_, **__: (_ for _ in ()).throw(OSError("gone")))
            publish(spark, second, root, True, NOW, points)
        assert state(open_archive(spark, root)) == old and read_commits(spark, root).count() == 1
    with monkeypatch.context() as broken, pytest.raises(OSError):
        broken.setattr("geoledger.plans.publish.write_version", lambda *_, **__: (_ for _ in ()).throw(OSError("gone")))
        publish(spark, second, root, True, NOW, points)
    publish(spark, second, root, True, NOW, points)
    assert [r.seq for r in read_audit(spark, root).orderBy("seq").collect()] == [1, 2]
    assert [(r.version) for r in read_newest_version(spark, f"{root}/status_current", schemas.STATUS).collect()] == [2]
    new = state(open_archive(spark, root))
    assert new[0] == ["f1"] and new != old
    assert state(reader) == old  # the date was published anew; who has it open still sees what it was
    assert vacuum(spark, root, datetime.now(timezone.utc)) == []
    gone = vacuum(spark, root, datetime.now(timezone.utc) + timedelta(days=8))
    assert len(gone) >= 2 and state(open_archive(spark, root)) == new
    (tmp_path / "file").write_text("not parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer"):  # unreadable is not absent
        read_parquet_table(spark, str(tmp_path / "file"), schemas.MANIFEST).count()


def test_delayed_release_stream(spark, tmp_path):
    """A message too fresh for the first run is released by a later one, without arriving again."""
    from geoledger.workload.queries import PROFILE

    message = lambda i, at: (f'<div class="tgme_widget_message_wrap"><div data-post="ChannelUA/{i}"><time datetime="{at}"></time>'
                             f'Мапу оновлено<a href="https://map.example/#9/48.{i}/37.5">place {i}</a>'
                             f'<a href="https://map.example/#9/48.{i}/37.5">again</a></div></div>')
    inbox = tmp_path / "in"
    inbox.mkdir()
    spark.createDataFrame([("a", message(1, "2026-01-08T00:00:00+00:00")), ("b", message(2, "2026-01-10T00:00:00+02:00"))],
                          "page_id string, html string").coalesce(1).write.mode("append").parquet(str(inbox))
    def run(now):
        pages = spark.readStream.schema("page_id string, html string").parquet(str(inbox))
        release_stream(pages, str(tmp_path / "out"), str(tmp_path / "cp"), PROFILE, lambda: utc(now)).awaitTermination()
        return sorted(r.post_id for r in read_released(spark, str(tmp_path / "out")).collect())
    assert run(datetime(2026, 1, 10, 12)) == ["1"]
    spark.createDataFrame([("c", message(3, "2026-01-09T00:00:00+00:00"))], "page_id string, html string").coalesce(1).write.mode("append").parquet(str(inbox))
    assert run(datetime(2026, 1, 11, 12)) == ["1", "2", "3"]
    no_zone = message(4, "2026-01-09T00:00:00")
    spark.createDataFrame([("d", no_zone), ("e", message(5, "2026-01-11T10:00:00+00:00"))], "page_id string, html string").coalesce(1).write.mode("append").parquet(str(inbox))
    assert run(datetime(2026, 1, 11, 13)) == ["1", "2", "3"]
    assert [r.post_id for r in spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()] == ["4"]
    batch = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "held").iterdir() if p.name.startswith("batch_id="))
    publish_held(spark, str(tmp_path / "out"), batch, utc(datetime(2026, 1, 12, 13)), PROFILE)
    assert sorted(r.post_id for r in read_released(spark, str(tmp_path / "out")).collect()) == ["1", "2", "3", "5"]
