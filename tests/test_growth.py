"""What went wrong on larger tables, with rows that show it on small ones."""

import datetime

import pytest

from conftest import feature, rect
from geoledger.operators import candidates, overlay, rings
from geoledger.operators.validity import invalid_features
from geoledger.plans import diff
from geoledger.plans.registry_rules import manifest_rules
from geoledger.workload import queries as W

_LINEITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_returnflag string, l_shipdate date"


@pytest.fixture
def small_partitions(spark):
    """Shuffles of few rows keep several partitions, as those of many rows do."""
    names = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2kb", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1kb"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_a_json_array_is_one_file_whatever_the_partitions(spark, small_partitions, tmp_path):
    day = datetime.date(1998, 3, 1)
    rows = [(k % 900, k % 53, k % 7, 1 + k % 3, "ANR"[k % 3], day) for k in range(1200)]
    spark.createDataFrame(rows, _LINEITEM).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(tuple(r) for r in W.ordered_table(spark, str(tmp_path)).collect())
    assert got == sorted(tuple(r) for r in W.first_evidence_per_id(spark, str(tmp_path)).collect())
    assert len(got) == 900


def test_validity_sends_no_growing_table_through_the_driver(spark):
    found = invalid_features(spark.createDataFrame([(f"c{k}", f"f{k}", rect(k, 0, k + 1, 1)) for k in range(4)], "ctx string, id string, geometry array<array<array<array<double>>>>"))
    kinds = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert kinds and not [k for k in kinds if "Broadcast" in k]


def test_boxes_visit_only_grids_that_hold_boxes(spark):
    box = "ctx string, {0} long, minx double, maxx double, miny double, maxy double"
    left = spark.createDataFrame([("c", k, k * 0.5, k * 0.5 + 0.4, 0.0, 0.4) for k in range(20)], box.format("a"))
    right = spark.createDataFrame([("c", 0, 0.0, 10.0, 0.0, 10.0), ("c", 1, 1.1, 1.15, 0.1, 0.15), ("d", 2, 0.0, 1.0, 0.0, 1.0)], box.format("b"))
    assert sorted(candidates._native_levels(left)) == [4] and len(candidates._native_levels(right)) == 3
    got = sorted((r.a, r.b) for r in candidates.box_pairs(left, right, ["a"], ["b"]).collect())
    assert got == sorted([(k, 0) for k in range(20)] + [(2, 1)])


def _rising(spark, rows):
    found = manifest_rules(spark.createDataFrame(rows, "ordinal long, date date"))
    return sorted(r.rule for r in found.collect())


def test_neighbours_of_a_long_manifest(spark, small_partitions):
    days = [(k, datetime.date(2000, 1, 1) + datetime.timedelta(days=2000 - k)) for k in range(2000)]
    assert _rising(spark, days) == []
    for wrong in (1, 700, 1999):  # one day too late, whatever the range it comes to
        assert "V-D15" in _rising(spark, [(k, d + datetime.timedelta(days=5 if k == wrong else 0)) for k, d in days])


def test_manifest_rows_are_not_one_task(spark):
    rows = spark.range(0, 4000, 1, 4).selectExpr("id AS ordinal", "date_sub(DATE '2020-01-01', CAST(id AS int)) AS date")
    plan = manifest_rules(rows)._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and "windowspecdefinition(ordinal" not in plan


def _cycles(sizes):
    """(id, next) of rings of the given sizes, their edges dealt over all numbers."""
    count = sum(sizes)
    step = next(k for k in range(count // 3 + 2, 10 * count) if all(k % p for p in range(2, count + 1) if count % p == 0))
    ids, low, links = [k * step % count for k in range(count)], 0, []
    for n in sizes:
        mine = ids[low:low + n]
        links += zip(mine, mine[1:] + mine[:1])
        low += n
    return links


def _walked(links):
    after, out = dict(links), {}
    for start in after:
        ring, at, n = [start], after[start], 1
        while at != start:
            ring.append(at)
            at = after[at]
        out[start] = (min(ring), ring.index(min(ring)))
    return out


def test_rings_inside_a_block_take_no_rounds(spark, monkeypatch):
    links = _cycles([1, 2, 3, 4, 40, 7, 5])
    monkeypatch.setattr(rings, "MAX_ROUNDS", 0)
    got = {r.id: (r.ring, r.dist) for r in rings.ring_labels(spark.createDataFrame(links, "id long, next long")).collect()}
    assert got == _walked(links)


@pytest.mark.parametrize("bits", [0, 2, 4])
def test_rings_across_blocks(spark, monkeypatch, bits):
    links = _cycles([1, 2, 3, 4, 40, 7, 6])
    table = spark.createDataFrame(links + [(100, 101), (101, links[0][0]), (200, None)], "id long, next long")  # two that run into a ring, one that ends
    monkeypatch.setattr(rings, "BLOCK_BITS", bits, raising=False)
    got = {r.id: (r.ring, r.dist) for r in rings.ring_labels(table).collect()}
    ring, dist = _walked(links)[links[0][0]]
    assert got == {**_walked(links), 100: (ring, dist + 2), 101: (ring, dist + 1), 200: (200, 0)}


def test_what_stands_in_both_snapshots_is_one_region(spark, features, monkeypatch):
    seen, plain = [], overlay.prepared

    def counted(*given):
        found = plain(*given)
        seen.append(found.stats.count())
        return found

    monkeypatch.setattr(overlay, "prepared", counted)
    old = features([feature(1, "lost", rect(0, 0, 2, 2)), feature(2, "lost", rect(1, 0, 3, 2))])
    new = features([feature(1, "lost", rect(0, 0, 2, 2)), feature(2, "lost", rect(1, 0, 4, 2))])
    pieces = diff.gained_areas(old, new)
    assert seen == [3]
    gained = overlay.boundary_of(pieces, "a AND NOT b")
    assert sorted({x for r in gained.collect() for x in (r.x1, r.x2)}) == [3.0, 4.0]


def test_overlay_joins_by_numbers(spark, features):
    from geoledger.operators.edges import edge_table
    table = features([feature(1, "lost", rect(0, 0, 2, 2)), feature(2, "lost", rect(1, 1, 3, 3))])
    regions = overlay.prepared(edge_table(table, diff.F.col("ctx"), diff.F.col("id")))
    assert "string" not in dict(regions.index.dtypes).values()
    assert overlay.common_boundary(regions, regions, "aid < bid").select("aid", "bid").distinct().count() == 1
