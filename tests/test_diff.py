"""Changes between snapshots. All cases are pairs (ctx) of one job, as in production."""

import pytest

from conftest import feature, rect
from geoledger.plans.diff import change_summary, consecutive_pairs, diff_snapshots, point_status_changes, point_status_index
from geoledger.session import cut

TRIANGLE = [[[[2.0, 0.0], [3.0, 1.0], [1.0, 1.0], [2.0, 0.0]]]]
SAME = [(1, "control_ua", rect(30, 48, 30.05, 48.05)), (2, "contested", rect(30.05, 48, 30.1, 48.05))]
PREVIOUS = {
    "same": SAME,
    "tie": [(1, "control_ru", rect(0, 0, 2, 1)), (2, "contested", rect(2, 0, 4, 1)), (3, "control_ua", rect(20, 0, 21, 1))],
    "holes": [(1, "a", rect(1, 1, 2, 2)), (2, "a", rect(2, 2, 3, 3))],
    "touch": [(1, "a", TRIANGLE)],
    "island": [(1, "a", rect(1, 1, 9, 9))],
    "split": [(1, "a", rect(1, 0, 2, 4))],
    "loss": [(1, "a", rect(0, 0, 1, 1))],
}
CURRENT = {
    "new": [(1, "control_ua", rect(30, 48, 30.05, 48.05))],
    "same": SAME,
    "tie": [
        (11, "control_ua", rect(0, 0, 4, 1), 0.97, ("e2", "e1"), ("s2",)),  # equal overlap with two statuses
        (12, "control_ua", rect(4, 1, 5, 2), 0.94, ("e3",), ("s1",)),       # touches the first in a corner
        (13, "contested", rect(20, 0, 21, 1), None, ("e4",), ("s3",)),
    ],
    "holes": [(1, "a", rect(0, 0, 4, 4))],
    "touch": [(2, "a", rect(0, 0, 4, 4))],
    "island": [(3, "a", rect(0, 0, 10, 10))],
    "split": [(4, "a", rect(0, 0, 4, 4))],
    "small": [(1, "a", rect(0, 0, 0.0001, 0.0001)), (2, "a", rect(1, 1, 1.001, 1.001))],
    "summary": [(1, "b", rect(0, 0, 1, 1)), (2, "a", rect(3, 0, 4, 1))],
}


@pytest.fixture(scope="module")
def diff(features):
    table = lambda cases: features([feature(*row, ctx=name) for name, rows in cases.items() for row in rows])
    return cut(diff_snapshots(table(PREVIOUS), table(CURRENT)))


@pytest.fixture(scope="module")
def found(diff):
    out = {}
    for r in diff.collect():
        out.setdefault(r.date, []).append(r)
    return out


def rings(rows):
    return sorted([len(part) for part in r.geometry] for r in rows)


def test_new_area_is_one_change(found):
    row, = found["new"]
    assert abs(row.area_km2 - 20.734) < 1e-9 and row.from_status is None
    assert row.summary == "без опубликованного статуса → контроль украинских сил"


def test_no_change_and_gains_only(found):
    assert "same" not in found and "loss" not in found


def test_origin_provenance_and_tie(found):
    assert len(found["tie"]) == 3
    tie = next(r for r in found["tie"] if r.from_status == "control_ru")
    assert tie.evidence_ids == ["e1", "e2", "e3"] and tie.source_ids == ["s1", "s2"] and tie.confidence == 0.94
    assert [r.reviewer for r in tie.reviews] == ["reviewer-11", "reviewer-12"]
    turned = next(r for r in found["tie"] if r.to_status == "contested")
    assert turned.from_status == "control_ua" and turned.confidence == 0.93
    assert turned.id.startswith("chg-tie-") and len(turned.id) == len("chg-tie-") + 16


def test_holes_and_pinched_rings(found):
    assert rings(found["holes"]) == [[3]] and rings(found["touch"]) == [[2]] and rings(found["island"]) == [[2]]
    assert rings(found["split"]) == [[1], [1]]
    for name in ("holes", "touch", "island", "split"):
        for row in found[name]:
            for part in row.geometry:
                for ring in part:
                    assert ring[0] == ring[-1] and len({tuple(p) for p in ring}) == len(ring) - 1


def test_small_parts_are_dropped(found):
    assert len(found["small"]) == 1


def test_summary(diff):
    row = change_summary(diff.filter("date = 'summary'")).first()
    assert list(row.by_status_km2) == ["a", "b"] and row.feature_count == 2
    assert abs(sum(row.by_status_km2.values()) - row.area_change_km2) < 0.002


def test_points(spark, features):
    previous = features([feature(1, "a", rect(0, 0, 4, 4)), feature(2, "b", rect(6, 0, 7, 1))])
    current = features([feature(1, "a", rect(0, 0, 8, 4)), feature(2, "b", rect(8, 0, 9, 4))])
    points = spark.createDataFrame(
        [("2026-01-02", n, "old", x, y) for n, x, y in (("gain", 5.0, 1.0), ("swap", 6.5, 0.5), ("same", 1.0, 1.0), ("edge", 8.0, 1.0), ("far", 50.0, 50.0))],
        "ctx string, id string, status string, lon double, lat double")
    moved = {r.id: (r.previous_status, r.status, r.changed_at) for r in point_status_changes(previous, current, points).collect()}
    assert moved == {"gain": (None, "a", "2026-01-02"), "swap": ("b", "a", "2026-01-02"), "edge": (None, "contested", "2026-01-02")}
    index = {r.id: r.status for r in point_status_index(current, points).collect()}
    assert index == {"gain": "a", "swap": "a", "same": "a", "edge": "contested", "far": "unknown"}
    gone = {r.id: r.status for r in point_status_changes(current, features([]), points).collect()}
    assert gone == {"gain": "unknown", "swap": "unknown", "same": "unknown", "edge": "unknown"}


def test_archive_dates_pair_up(features):
    archive = features([feature(1, "a", rect(0, 0, 1 + d, 1), ctx=f"2026-01-0{d + 1}") for d in range(3)]).withColumnRenamed("ctx", "snapshot_date")
    previous, current = consecutive_pairs(archive)
    assert sorted((r.snapshot_date, r.ctx) for r in previous.collect()) == [("2026-01-01", "2026-01-02"), ("2026-01-02", "2026-01-03")]
    assert current.count() == 3


def test_only_what_changed_is_overlaid(spark, features, monkeypatch):
    """A map of which little changed gives the rows of the overlay of the whole map, from few features."""
    import random

    from geoledger.plans import diff as D

    rnd, statuses = random.Random(5), ("contested", "control_ua", "control_ru")
    place = lambda k: ((k % 8) * 1.0, (k // 8) * 1.0)
    old = [(k, statuses[k % 3], rect(x, y, x + 1, y + 1)) for k, (x, y) in ((k, place(k)) for k in range(40))]
    new = list(old)
    new[9] = (9, statuses[1], old[9][2])                                  # another status
    x, y = place(20)
    new[20] = (20, old[20][1], rect(x - 0.25, y, x + 1, y + 0.5))         # another shape, over its neighbour
    new[33] = (133, old[33][1], old[33][2])                               # another id only
    new = [f for f in new if f[0] not in (5, 19)] + [(50, "contested", rect(20, 20, 21, 21))]
    rnd.shuffle(new)
    table = lambda rows: features([feature(k, s, g) for k, s, g in rows])
    dirty, before, around = D.dirty_features(table(old), table(new))
    assert sorted(r.id for r in dirty.collect()) == ["f20", "f50", "f9"] and before.count() < 20 and around.count() < 20
    rows = lambda: sorted((r.to_status, str(r.from_status), r.area_km2_exact.hex(), r.confidence, str(r.evidence_ids), str(r.reviews),
                           sorted(str(p) for part in r.geometry for ring in part for p in ring[1:])) for r in diff_snapshots(table(old), table(new)).collect())
    quick = rows()
    monkeypatch.setattr(D, "dirty_features", lambda previous, current: (current, previous, current))
    assert quick == rows() and len(quick) >= 3
