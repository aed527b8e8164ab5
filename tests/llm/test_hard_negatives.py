"""Hard negatives: whole tables against a plain search over all pairs, bounds of the segments, odd rows."""

import numpy as np
import pytest

from geoledger.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def _plain(rows):
    """All pairs, one anchor after another; ``rows`` are (vec_id, vector, label)."""
    good = [(i, v, y) for i, v, y in rows if y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    good = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in good]
    last = float("inf")
    out = []
    for a, va, ya in good:
        if a is None or a % 100:
            continue
        scored = [(sum(p * q for p, q in zip(va, v)), i, y) for i, v, y in good if i != a]
        order = lambda part: sorted(part, key=lambda s: (-s[0], last if s[1] is None else s[1]))
        for ps, p, _ in order([s for s in scored if s[2] == ya])[:5]:
            fit = order([s for s in scored if s[2] != ya and 30 * ps <= 100 * s[0] <= 90 * ps])[:10]
            out += [(a, p, k + 1, i, ps, s) for k, (s, i, _) in enumerate(fit)]
    return sorted(out, key=str)


def _mined(df):
    rows = hn.mine(df)
    assert rows.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.mark.parametrize("sizes", [(4096, 512, 131_072), (100, 2, 150)])
def test_given_embeddings(spark, sf_dir, monkeypatch, sizes):
    for name, value in zip(("ROWS", "ANCHORS", "SLICE_ROWS"), sizes):
        monkeypatch.setattr(hn, name, value)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = _plain([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert want and _mined(df.repartition(3)) == want


def _rows(seed, count, dimension=9, spread=1.0):
    random = np.random.default_rng(seed)
    heart = random.standard_normal((4, dimension))
    return [(int(i) * 25, (heart[i % 4] + spread * random.standard_normal(dimension)).astype(np.float32).tolist(), int(random.integers(0, 10))) for i in range(count)]


def test_ties_copies_and_a_hot_label(spark):
    rows = _rows(1, 60, spread=0.3)
    rows += [(10_000 + k, rows[4][1], 1) for k in range(40)] + [(20_000 + k, rows[4][1], 2) for k in range(40)] + [(30_001 + 10 * k, [0.0] * 9, 1) for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "label AS k", "label AS anchor", "label AS slice", "label AS n")
    assert _mined(df) == _plain(rows)


def test_odd_rows(spark):
    rows = _rows(2, 50) + [(None, [0.5] * 9, 3), (500, [0.1] * 9, None), (600, None, 1), (700, [float("nan")] * 9, 1), (800, [None] + [1.0] * 8, 1),
                           (900, [float("-inf")] * 9, 1), (25, [0.2] * 9, 4), (50, _rows(2, 50)[2][1], 5), (-100, [0.3] * 9, 2), (-7, [0.4] * 9, 9)]
    want = _plain(rows)
    assert _mined(spark.createDataFrame(rows, SCHEMA)) == want
    ragged = rows + [(1000, [1.0, 2.0], 1), (1100, [], 1), (1200, [3e38] * 9, 1)]
    assert _mined(spark.createDataFrame(ragged, SCHEMA)) == want
    df = spark.createDataFrame(rows, SCHEMA)
    for part in ("vec_id = 0", "vec_id IN (0, 400)", "vec_id IN (600, 700)", "false"):
        assert hn.mine(df.where(part)).count() == 0


def test_large_entries_are_scored_exactly(spark):
    random = np.random.default_rng(3)
    rows = [(k * 50, (random.standard_normal(8) * 3e4 + 2e5).astype(np.float32).tolist(), k % 3) for k in range(30)]
    assert _mined(spark.createDataFrame(rows, SCHEMA)) == _plain(rows)


def test_bounds_hold_and_every_way_finds_the_same_pairs(monkeypatch):
    random = np.random.default_rng(4)
    a, x = (random.integers(-300, 300, (n, 64)).cumsum(axis=1) // 8 for n in (20, 300))
    scores = a @ x.T
    for segments in hn.LEVELS:
        (ma, da), (mx, dx) = hn.summaries(a.astype(float), segments), hn.summaries(x.astype(float), segments)
        middle, spread = ma @ mx.T, da @ dx.T
        assert (scores <= middle + spread + 1e-3).all() and (scores >= middle - spread - 1e-3).all()
    least, most = np.sort(scores, axis=1)[:, -9], np.sort(scores, axis=1)[:, -4]
    allowed = random.random(scores.shape) < 0.9
    i, j = np.nonzero(allowed & (scores >= least[:, None]) & (scores <= most[:, None]))
    for dense in (0.0, 0.05, 2.0):
        monkeypatch.setattr(hn, "DENSE", dense)
        found = hn.close_pairs(hn.Side(a), hn.Side(x), least, most, allowed)
        assert sorted(zip(*(f.tolist() for f in found))) == sorted(zip(i.tolist(), j.tolist(), scores[i, j].tolist()))
