"""Whole results of near-duplicate links and of benchmark overlaps, against brute force."""

import collections
import itertools

import numpy as np
import pyarrow as pa

from geoledger.llm import order_minhash, spaced_seeds
from geoledger.llm.wordarrays import Words

from .conftest import spoken


def _similar(a, b):
    now = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, now = now, [i + 1]
        for j, y in enumerate(b):
            now.append(min(before[j] + (x != y), before[j + 1] + 1, now[j] + 1))
    return now[-1] <= int(0.2 * max(len(a), len(b)) + 1e-9)


def _plain_classes(rows):
    """Every pair that shares a key."""
    split = {i: t.split() for i, t in rows}
    keys = dict(zip(split, order_minhash.order_sketches(Words(pa.array([t for _, t in rows], pa.large_string())))))
    links, top = collections.Counter(), {i: i for i in split}
    for a, b in itertools.combinations(sorted(split), 2):
        if (keys[a] == keys[b]).any() and _similar(split[a], split[b]):
            links.update((a, b))
            old, new = sorted((top[a], top[b]))[::-1]
            top = {i: new if t == old else t for i, t in top.items()}
    return {i: (top[i], links[i]) for i in split}


def test_every_pair_of_a_bucket_is_tested_and_counted(documents, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 7)
    base = spoken(71, 60, 4000)
    rows = [(k, " ".join(f"k{k}" if p == 10 + k else w for p, w in enumerate(base))) for k in range(30)]  # mutual near copies
    walk = spoken(72, 60, 4000)
    for k in range(20):  # each is near the next ones only
        rows.append((100 + k, " ".join(walk)))
        walk[57 - 2 * k:59 - 2 * k] = [f"s{k}", f"t{k}"]
    rows += [(200 + k, " ".join(spoken(73, 30, 4000) + spoken(500 + k // 2, 24, 4000) + [f"e{k}"])) for k in range(24)]  # one passage in pairs
    got = {r.doc_id: (r.class_id, r.n_links) for r in order_minhash.near_duplicate_classes(documents(rows)).collect()}
    want = _plain_classes(rows)
    assert got == want
    assert want[5] == (0, 29) and want[201][0] == 200


def _plain_bounds(rows):
    """Links between texts that share a key, and between all texts, by text; classes over texts that share a key."""
    texts = sorted({" ".join(t.split()) for _, t in rows})
    split = [t.split() for t in texts]
    keys = order_minhash.order_sketches(Words(pa.array(texts, pa.large_string())))
    shared, similar, top = collections.Counter(), collections.Counter(), list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if _similar(split[a], split[b]):
            similar.update((a, b))
            if (keys[a] == keys[b]).any():
                shared.update((a, b))
                old, new = max(top[a], top[b]), min(top[a], top[b])
                top = [new if t == old else t for t in top]
    least = {c: min((i for i, t in rows if i is not None and top[texts.index(" ".join(t.split()))] == c), default=None) for c in set(top)}
    return {t: (shared[k], similar[k], least[top[k]]) for k, t in enumerate(texts)}


def test_cliques_lose_no_link(documents, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 5)
    base, rows = spoken(81, 50, 4000), []
    for k in range(40):  # a few edits at many places: leaders of cliques are too far apart to settle all their members
        words = list(base)
        for e in range(1 + k % 4):
            words[(7 * k + 13 * e) % 50] = f"m{k}_{e}"
        if k % 5 == 0:
            words.insert(3 * k % 50, f"i{k}")
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(spoken(82, 30, 4000) + spoken(600 + k, 30, 4000))) for k in range(12)]  # a passage only
    got = {r.doc_id: (r.class_id, r.n_links) for r in order_minhash.near_duplicate_classes(documents(rows)).collect()}
    want = _plain_bounds(rows)
    for i, text in rows:
        shared, similar, least = want[" ".join(text.split())]
        assert got[i][0] == least and shared <= got[i][1] <= similar
    assert sum(got[k][0] == 0 for k in range(40)) > 30 and all(got[100 + k] == (100 + k, 0) for k in range(12))


def test_pairs_of_cliques_are_settled_or_tested(documents, monkeypatch):
    """All texts share their keys, so links equal those of all pairs, whether a clique's pairs are settled by radii or tested."""
    monkeypatch.setattr(order_minhash, "BLOCK", 4)
    monkeypatch.setattr(order_minhash, "order_sketches", lambda words: np.ones((int((words.counts > 0).sum()), order_minhash.SKETCHES), dtype=np.uint64))
    base, rows = spoken(83, 40, 4000), []
    for k in range(36):
        words = [f"p{k % 6}_{x}" if x % 10 < k % 6 and x < 20 else w for x, w in enumerate(base)]
        words[20 + k % 20] = f"q{k}"
        rows.append((k, " ".join(words[:40 - k % 3])))
    similar = collections.Counter(x for a, b in itertools.combinations(range(36), 2) if _similar(rows[a][1].split(), rows[b][1].split()) for x in (a, b))
    got = {r.doc_id: r.n_links for r in order_minhash.near_duplicate_classes(documents(rows)).collect()}
    assert got == {k: similar[k] for k in range(36)} and 0 < min(similar.values()) < 35


def test_rows_that_repeat_an_id_and_null_ids(documents):
    a, b, c = (spoken(90 + k, 60, 4000) for k in range(3))
    near = lambda words, mark: " ".join([*words[:30], mark, *words[31:]])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, near(a, "x")), (9, near(b, "y")), (7, " ".join(a)),
            (None, " ".join(c)), (5, " ".join(c)), (6, " ".join(c)), (11, near(c, "z")), (None, None), (12, "")]
    got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in order_minhash.near_duplicate_classes(documents(rows)).collect())
    assert got == collections.Counter([(7, 7, 1)] * 3 + [(8, 7, 1), (9, 7, 1), (None, 5, 1), (5, 5, 1), (6, 5, 1), (11, 5, 1), (None, None, 0), (12, 12, 0)])
    kept = order_minhash.keep_one_of_each(documents(rows).selectExpr("*", "source AS mark", "n_chars AS rep", "lang AS unit"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(7, " ".join(a)), (7, " ".join(b)), (5, " ".join(c)), (None, None), (12, "")], key=str)
    only_null = [(None, " ".join(a)), (None, near(a, "x"))]
    assert [(r.class_id, r.n_links) for r in order_minhash.near_duplicate_classes(documents(only_null)).collect()] == [(None, 1)] * 2
    assert order_minhash.keep_one_of_each(documents(only_null)).count() == 1


def _most_equal(equal):
    """Most equal tokens of a stretch of positive score."""
    return max((sum(equal[b:e]) for b in range(len(equal)) for e in range(b + 1, len(equal) + 1)
                if 3 * sum(equal[b:e]) > 2 * (e - b)), default=0)


def test_overlaps_count_equal_tokens_whatever_stretch_scores_best(spark, documents):
    items, rows = [], []
    random = np.random.default_rng(11)
    for k, n in enumerate([15] * 40 + [30] * 20):
        item = spoken(1000 + k, n, 50_000)
        if k == 0:
            gone = {10, 12}
        elif k == 1:
            gone = {2, 4}
        elif k == 2:
            gone = {12, 14}
        else:
            gone = set(random.choice(n, int(random.integers(1, 4 if n == 15 else 12)), replace=False).tolist())
        items.append((k, item))
        rows.append((k, ["zz" if p in gone else w for p, w in enumerate(item)]))
    want = set()
    for (k, item), (_, doc) in zip(items, rows):
        equal = [x == y for x, y in zip(item, doc)]
        seeded = any(all(equal[p + o] for o in m) for m in spaced_seeds.MASKS for p in range(len(equal) - m[-1]))
        if seeded and _most_equal(equal) >= min(13, int(np.ceil(0.8 * len(item)))):
            want.add(k)
    df = documents([(k, " ".join(doc)) for k, doc in rows])
    benchmark = spark.createDataFrame([(k, " ".join(item)) for k, item in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in spaced_seeds.find_overlaps(df, benchmark).collect()}
    assert {0, 1, 2} <= want and got == {(k, k) for k in want}
