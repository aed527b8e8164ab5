"""Substring and near-duplicate removal, and decontamination, against plain versions."""

import collections
import hashlib
import re

import numpy as np
import pytest

from geoledger.llm import order_minhash, spaced_seeds, substring_dedup

from .conftest import spoken


def _plain_removals(rows):
    """Window by window, as the definition says."""
    least, out = {}, {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - 49):
            key = tuple(w[p:p + 50])
            least[key] = min(i, least.get(key, i))
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if least[tuple(w[p:p + 50])] < i:
                gone[p:p + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.setdefault(i, []).append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


def _removals(df):
    out = collections.defaultdict(list)
    for r in substring_dedup.removal_digests(df).collect():
        out[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
    return {i: sorted(v) for i, v in out.items()}


@pytest.fixture(scope="module")
def passages():
    shared, other = spoken(1, 60), spoken(2, 200)
    rows = [(7, " ".join(spoken(3, 80) + shared + spoken(4, 13))), (2, " ".join(shared)), (9, "\n".join(spoken(5, 7) + shared + shared)),
            (4, " ".join(other)), (5, "  ".join(other[:120]) + " \t" + " ".join(other[130:])), (6, " ".join(other[40:89])),
            (8, " ".join(other[41:91])), (1, None), (3, ""), (10, " \n "), (11, " ".join(["a"] * 300)), (12, " ".join(["a"] * 49)),
            (13, " ".join(["a"] * 51)), (14, " ".join(spoken(6, 30_000) + shared)), (4, " ".join(other)), (2, "short row with a used id")]
    return rows + [(100 + k, " ".join(spoken(9, 70))) for k in range(40)]


def test_substring_removal_is_exact(documents, passages, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 1500)
    assert _removals(documents(passages)) == _plain_removals(passages)


def test_substring_removal_on_given_documents(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 1 << 15)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert _removals(df) == _plain_removals([(r.doc_id, r.text) for r in df.collect()])


def test_repeats_are_cut_out_and_everything_else_stays(spark, documents, passages):
    df = documents(passages).selectExpr("*", "source AS chunk", "n_chars AS blob", "lang AS bucket")
    want = {i: v for i, v in _plain_removals(passages).items() if len(v) == 1}
    got = substring_dedup.remove_repeats(df)
    assert got.columns == df.columns and got.count() == len(passages)
    given = dict(passages)
    for r in got.collect():
        if r.doc_id in want:
            n, removed, digest = want[r.doc_id][0]
            assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == digest
            assert removed or r.text == given[r.doc_id]
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0
    assert substring_dedup.removal_digests(df.limit(0)).count() == 0


def test_chunks_are_made_of_small_batches(spark, documents, monkeypatch):
    """A worker is sent some thousand texts at a time, not ten thousand."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 10_000)
    try:
        df = documents([(k, f"text {k}") for k in range(9000)]).coalesce(1)
        assert substring_dedup.chunk_table(df).count() >= 5  # a chunk never joins two batches
    finally:
        spark.conf.set(name, before)


def _edited(words, every, mark):
    return [f"{mark}{k}" if k % every == every // 2 else w for k, w in enumerate(words)]


def test_near_copies_share_a_class_and_others_do_not(documents):
    base, long = spoken(21, 300), spoken(22, 20_000)
    rows = [(50, " ".join(base)), (51, " ".join(_edited(base, 40, "x"))), (52, " ".join(base[:280])), (53, "\n".join(base)), (30, " ".join(long)),
            (31, " ".join(_edited(long, 60, "y"))), (1, "one two"), (2, "one  two"), (3, "one three"), (4, None), (5, ""), (6, " "),
            (60, " ".join(spoken(23, 300))), (61, " ".join(base[150:] + base[:150])), (53, "\n".join(base))]
    rows += [(200 + k, " ".join(_edited(spoken(24, 150), 75, f"k{k}_"))) for k in range(60)]
    rows += [(400 + k, " ".join(spoken(300 + k, 60) + spoken(25, 40))) for k in range(30)]  # one passage in different documents
    df = documents(rows).selectExpr("*", "source AS keys", "n_chars AS id", "lang AS copy", "source AS words")
    got = collections.defaultdict(set)
    for r in order_minhash.near_duplicate_classes(df).collect():
        got[r.doc_id].add(r.class_id)
    want = {i: {i} for i, _ in rows} | {i: {50} for i in (50, 51, 52, 53)} | {31: {30}, 2: {1}} | {200 + k: {200} for k in range(60)}
    assert got == want
    kept = sorted(r.doc_id for r in order_minhash.keep_one_of_each(df).collect())
    assert kept == sorted(i for i, c in want.items() if c == {i})
    assert order_minhash.near_duplicate_classes(df.limit(0)).count() == 0


def test_near_duplicate_recall_against_all_pairs(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    classes = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(df).collect()}
    shingles = {r.doc_id: collections.Counter(zip(*[(w := r.text.split())[k:] for k in range(5)])) for r in df.collect() if len(r.text.split()) >= 5}
    ids, pairs, found = sorted(shingles), 0, 0
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = shingles[i], shingles[j]
            if 5 * sum((a & b).values()) >= 4 * sum((a | b).values()):
                pairs, found = pairs + 1, found + (classes[i] == classes[j])
    assert pairs and found == pairs


def test_order_matters_to_sketches():
    import pyarrow as pa

    from geoledger.llm.wordarrays import Words

    words = spoken(31, 400, 5000)
    swapped = words[200:] + words[:200]
    keys = order_minhash.order_sketches(Words(pa.array([" ".join(words), " ".join(words), " ".join(swapped)], pa.large_string())))
    assert (keys[0] == keys[1]).all() and (keys[0] == keys[2]).mean() < 0.9


def _tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def _plain_overlaps(docs, items):
    """Every shift of every item over every document that one seed agrees on."""
    out = {}
    for doc_id, text in docs:
        h = _tokens(text)
        for item_id, item in items:
            t = _tokens(item)
            for shift in range(-len(t) + 1, len(h)):
                low, high = max(0, -shift), min(len(t), len(h) - shift)
                equal = [h[j + shift] == t[j] for j in range(low, high)]
                if not any(all(equal[p + o] for o in m) for m in spaced_seeds.MASKS for p in range(len(equal) - m[-1])):
                    continue
                score = run = best = 0
                for e in equal:
                    score, run = (score + 1, run + 1) if e else (score - 2, run)
                    if score <= 0:
                        score = run = 0
                    best = max(best, (score, run)) if best else (score, run)
                if best[1] >= min(13, int(np.ceil(0.8 * len(t)))):
                    out[doc_id, item_id] = max(out.get((doc_id, item_id), 0), best[1])
    return out


def test_overlaps_with_replaced_words_are_found(spark, documents):
    item = spoken(41, 40, 3000)
    replaced = ["zz" if k % 7 == 3 else w for k, w in enumerate(item)]
    short = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, " ".join(spoken(42, 50) + item)), (2, (" ".join(replaced) + " tail of text").upper()), (3, ", ".join(item[:15]) + "."), (4, " ".join(item[:10])),
            (5, None), (6, ""), (7, " ".join(reversed(item))), (8, "so " + short + " ends"), (9, " ".join(spoken(43, 20_000) + item[5:])), (1, "another row")]
    items = [(10, " ".join(item)), (11, " ".join(item)), (12, short), (13, None), (14, ""), (15, "too short to find")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "text AS seed", "item_id AS shift")
    df = documents(rows).selectExpr("*", "source AS leak", "n_chars AS h", "lang AS item")
    got = {(r.doc_id, r.item_id): r.n_matches for r in spaced_seeds.find_overlaps(df, benchmark).collect()}
    assert got == _plain_overlaps(rows, [(10, " ".join(item)), (12, short)])
    assert {i for i, _ in got} == {1, 2, 3, 8, 9}
    kept = spaced_seeds.drop_contaminated(df, benchmark)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7]
    assert spaced_seeds.find_overlaps(df.limit(0), benchmark).count() == spaced_seeds.find_overlaps(df, benchmark.limit(0)).count() == 0


def test_overlaps_do_not_depend_on_broadcasts(spark, sf_dir, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    first = sorted(map(tuple, spaced_seeds.find_overlaps(docs, benchmark).collect()))
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(spaced_seeds, "BROADCAST_HITS", 0)
    assert first and first == sorted(map(tuple, spaced_seeds.find_overlaps(docs, benchmark).collect()))
