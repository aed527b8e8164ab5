"""JSON files read by many tasks against Python's parser, with blocks smaller than the objects."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from geoledger import schemas
from geoledger.functions.values import utc
from geoledger.operators.merges import first_match
from geoledger.plans.snapshot_rules import validate_collection, validate_snapshot
from geoledger.sources.geojson import feature_rows, read_collection, read_snapshot
from geoledger.sources.jsonsplit import find_brace, read_json_objects
from geoledger.sources.tables import read_json_table, streamed_digest

from test_rules import NOW, document, snapshot_feature, square

ODD = ["plain", "br}ace", 'quo"te', "back\\slash\\", "{[}]", '"Feature"', "", "é中\n", '\\"}', "[{"]


@pytest.fixture
def small_blocks(spark):
    """Blocks so small that strings, objects and heads cross their ends."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "400")
    spark.conf.set(names[1], "1")
    yield 400
    for n, v in before.items():
        spark.conf.set(n, v)


def _feature(rnd, k):
    return {"type": "Feature", "properties": {"id": f"f{k}", "name": rnd.choice(ODD), "moderation": {"a": [{"b": {}}]}},
            "geometry": {"type": "Polygon", "coordinates": [[[rnd.random(), 1.5]] * rnd.randint(1, 5)]}}


def test_members_of_collections(spark, tmp_path, small_blocks):
    rnd = random.Random(1)
    sound = {
        "nested": {"type": "FeatureCollection", "metadata": {"date": 'x}{"', "n": {"m": [{}, {"features": [{}]}]}}, "features": [_feature(rnd, k) for k in range(9)]},
        "others": {"features": [_feature(rnd, k) for k in range(4)], "other": [{"x": 1}, {"y": 2}], "type": "FeatureCollection"},
        "behind": {"other": [{"x": 1}, {"y": 2}], "pre": 'a } " { b', "features": [_feature(rnd, 1)], "post": [[{"q": 1}]]},
        "empty": {"other": [{"x": 1}], "features": [], "z": "}"}, "none": {"type": "FeatureCollection"}}
    broken = {"comma": '{"features":[{"a":1}{"b":2}]}', "open": '{"features":[{"a":1},{"b":2}', "behind": '{"features":[{"a":1}]} x', "string": '{"features":[{"a":"1}]}',
              "braces": '{"features":[{"a":1}]}}', "twice": '{"features":[{"a":1}]}{"features":[]}'}
    for name, value in sound.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=1 if name == "nested" else None, ensure_ascii=False), encoding="utf-8")
    for name, text in broken.items():
        (tmp_path / f"broken-{name}.json").write_text(text + "\n")
    read = read_json_objects(spark, str(tmp_path), "features")
    name_of = lambda path: os.path.basename(path)[:-5]
    files, objects = {name_of(r.path): r for r in read.files.collect()}, {}
    for r in read.objects.collect():
        objects.setdefault(name_of(r.path), {})[r.idx] = r.text
    for name, value in sound.items():
        want, got = value.get("features", []), objects.get(name, {})
        assert not files[name].fault and files[name].objects == len(want) == len(got)
        assert [json.loads(got[k]) for k in range(len(want))] == want
        assert json.loads(files[name].skeleton) == {k: [] if k == "features" else v for k, v in value.items()}
    assert all(files[f"broken-{name}"].fault for name in broken)


def test_many_blocks_are_really_read(spark, tmp_path, small_blocks):
    rows = [{"id": f"e{k}", "source_id": ODD[k % len(ODD)], "n": k} for k in range(60)]
    path = tmp_path / "table.json"
    path.write_text(json.dumps(rows, indent=2), encoding="utf-8")
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() >= 4
    table = read_json_table(spark, str(path), "id string, source_id string, n int", ordinal=True)
    assert [(r.ordinal, r.id, r.source_id, r.n) for r in table.orderBy("ordinal").collect()] == [(k, f"e{k}", ODD[k % len(ODD)], k) for k in range(60)]


def test_order_of_tables(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps([{"id": "b", "url": "one"}, {"id": "a", "url": "two"}]))
    (tmp_path / "2.json").write_text('{"id": "a", "url": "three"}\n{"id": "b", "url": "four"}\n')  # lines
    (tmp_path / "3.json").write_text(" [ ] ")
    table = read_json_table(spark, str(tmp_path), "id string, url string", ordinal=True)
    assert [(r.ordinal, r.id, r.url) for r in table.orderBy("ordinal").collect()] == [(0, "b", "one"), (1, "a", "two"), (2, "a", "three"), (3, "b", "four")]
    assert {r.id: r.url for r in first_match(table, "id", "ordinal").collect()} == {"b": "one", "a": "two"}
    assert read_json_table(spark, str(tmp_path / "absent.json"), "id string", ordinal=True).columns == ["id", "ordinal"]
    for text in ('[{"id": "a"} {"id": "b"}]', '[{"id": "a"}, 5]', '{"id": "a"', "[1]", "x"):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError):
            read_json_table(spark, str(tmp_path / "bad.json"), "id string", ordinal=True)


def test_collections_are_judged_like_whole_files(spark, tmp_path, small_blocks):
    rows = [snapshot_feature(0, square(0)), snapshot_feature(1, square(0.01)), snapshot_feature(2, square(1), confidence=0.5), snapshot_feature(3, [[[0, 0]]])]
    document(tmp_path / "a.geojson", rows)
    document(tmp_path / "b.geojson", [snapshot_feature(0, square(0))], day=None, type="Feature")
    (tmp_path / "c.geojson").write_text("{not json")
    (tmp_path / "d.geojson").write_text('{"type": "FeatureCollection", "metadata": {}, "features": [{"type": }]}')
    (tmp_path / "e.geojson").write_text('{"type": "FeatureCollection", "metadata": {}, "features": [{"type": "Feature", "properties": {}}, null]}')
    whole, split = read_snapshot(spark, str(tmp_path)), read_collection(spark, str(tmp_path))
    said = lambda rules: sorted((os.path.basename(r.ctx), str(r.idx), r.rule, r.message) for r in rules.collect())
    got, want = said(validate_collection(split, utc(NOW))), said(validate_snapshot(whole, utc(NOW)))
    assert [r for r in got if r[0] != "e.geojson"] == [r for r in want if r[0] != "e.geojson"]
    assert [r[2] for r in got if r[0] == "e.geojson"] == ["V-S1"]  # an entry that is no object
    columns = ["document", "snapshot_date", "idx", "geometry_type", "id", "evidence_ids", "moderation", "geometry"]
    names = lambda df: sorted(str(tuple(r)) for r in df.where(~F.col("document").endswith("e.geojson")).select(columns).collect())
    assert names(split.features) == names(feature_rows(whole.where("_corrupt IS NULL")))


def test_digest_by_streaming(spark, tmp_path, small_blocks):
    texts = {"a": '{"a": {"b": "é}"}}\n', "b": '{"a": 1}', "c": "no brace\n\n", "d": "}" * 400}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = {os.path.basename(r.path): r.sha256 for r in streamed_digest(spark, str(tmp_path)).collect()}
    assert got == {n: hashlib.sha256(t.encode()).hexdigest() for n, t in texts.items()}


def test_find_brace():
    assert find_brace('x" {', True, 1) == 3 and find_brace('{"a{": {', False, 2) == 7
    with pytest.raises(ValueError):
        find_brace('"{"', False, 1)


def test_schema_of_the_snapshot_is_the_same(spark, tmp_path):
    path = document(tmp_path / "a.geojson", [snapshot_feature(0, square(0))])
    assert set(schemas.SNAPSHOT_FEATURES.split()) and read_collection(spark, path).features.columns == feature_rows(read_snapshot(spark, path)).columns
