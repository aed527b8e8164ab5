"""Mixture-controlled packing: exact tokens, full windows, proportions, and the round-robin by itself."""

import collections
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from geoledger.llm import mixture_packing as mp
from geoledger.llm.queries import vocabulary_path
from geoledger.llm.wordids import Vocabulary, parts_at_space

from .conftest import spoken


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary_path())


def _check(rows, texts, tokenizer):
    """Every id lies in exactly one piece, pieces carry their ids, sequences are gapless and 4096 or a power of two long."""
    tokens = collections.defaultdict(list)
    for doc_id, text in texts:
        tokens[doc_id].append(np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens, bytes(r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(tokens)
    for doc_id, parts in pieces.items():
        if len(tokens[doc_id]) == 1:
            own, end = tokens[doc_id][0], 0
            for start, length, whole, ids in sorted(parts):
                assert start == end and whole == len(own) and ids == own[start:start + length].tobytes()
                end += length
            assert end == len(own)
        else:
            assert sum(p[1] for p in parts) == sum(map(len, tokens[doc_id]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 4096 or end & (end - 1) == 0 and end < 4096
    total = sum(len(t) for ts in tokens.values() for t in ts)
    assert sum(n == 4096 for n in (sum(x[1] for x in s) for s in sequences.values())) == total // 4096
    return sequences


def test_given_documents_fill_windows_in_proportion(spark, sf_dir, tokenizer):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mp.pack_mixture(df.repartition(5), vocabulary_path()).collect()
    _check(rows, [(r.doc_id, r.text) for r in df.collect()], tokenizer)
    share, full = collections.Counter(), max(r.sequence_id for r in rows if r.offset + r.length == 4096) + 1
    for r in rows:
        share[r.queue] += r.length
    total, given = sum(share.values()), collections.Counter()
    by_window = collections.defaultdict(collections.Counter)
    for r in rows:
        by_window[r.sequence_id][r.queue] += r.length
    for w in range(full):
        given.update(by_window[w])
        for q, n in share.items():
            assert abs(given[q] - n / total * 4096 * (w + 1)) <= 2 * mp.TURN + 2


def test_odd_documents(documents, tokenizer):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "a<|endoftext|>b it's don't ÀÉ ﬁ 123 4a5  x\x1cy 👍🏽 漢字"), (5, " ".join(spoken(1, 30_000))), (5, "same id"), (5, "same id"),
             (None, "no id"), (6, "x" * 30_000), (7, "!!!???$$$ #*& a|b <x>")]
    df = documents(texts).selectExpr("*", "source AS queue", "n_chars AS length", "lang AS start", "lang AS key", "lang AS part")
    _check(mp.pack_mixture(df, vocabulary_path()).collect(), texts, tokenizer)
    _check(mp.pack_mixture(df.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS source"), vocabulary_path()).collect(), texts, tokenizer)
    _check(mp.pack_mixture(df.select("doc_id", "text"), vocabulary_path()).collect(), texts, tokenizer)
    assert mp.pack_mixture(df.limit(0), vocabulary_path()).count() == 0


def test_targets_rule_until_a_source_is_empty(spark, tokenizer):
    texts = [(k, " ".join(spoken(k, 400)), "a" if k % 4 else "b") for k in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    rows = mp.pack_mixture(df, vocabulary_path(), {"a": 1.0, "b": 1.0}).collect()
    _check(rows, [t[:2] for t in texts], tokenizer)
    by = {k: s for k, _, s in texts}
    first = [r for r in rows if r.sequence_id < 4]
    taken = sum(r.length for r in first if by[r.doc_id] == "b") / sum(r.length for r in first)
    assert abs(taken - 0.5) < 0.03
    with pytest.raises(ValueError):
        mp.pack_mixture(df, vocabulary_path(), {"a": 0.0})


def test_many_sources_share_the_last_queue(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(mp, "QUEUES", 4)
    texts = [(k, " ".join(spoken(k, 50)), f"s{min(k, 60) // 10 if k < 60 else k}") for k in range(100)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    rows = mp.pack_mixture(df, vocabulary_path()).collect()
    _check(rows, [t[:2] for t in texts], tokenizer)
    assert {r.queue for r in rows} == {0, 1, 2, 3}


def test_service_is_exact_and_never_falls():
    random = np.random.default_rng(0)
    for trial in range(60):
        totals = random.integers(0, 5000, random.integers(1, 12))
        weights = totals.clip(1).astype(float) if trial % 2 else random.random(len(totals)) + 0.01
        total, before = int(totals.sum()), np.zeros(len(totals), dtype=int)
        merged = sorted(((j + 0.5) / weights[q], q) for q in range(len(totals)) for j in range(totals[q]))
        positions = sorted({0, total, *random.integers(0, total + 1, 10).tolist()})
        for position, now in zip(positions, mp.served_before(np.array(positions), totals, weights)):
            assert now.sum() == position and (now >= before).all() and (now <= totals).all()
            plain = np.bincount([q for _, q in merged[:position]], minlength=len(totals))
            assert np.abs(now - plain).max() <= 1  # equal times but for rounding
            assert (now == mp.served_before(np.array([position]), totals, weights)[0]).all()
            before = now


def test_windows_are_full_and_deficits_stay_small():
    random = np.random.default_rng(1)
    for _ in range(60):
        queues, windows = random.integers(1, 30), int(random.integers(1, 60))
        amounts = np.floor(random.dirichlet(np.ones(queues) * random.choice([0.05, 0.5, 5])) * windows * 4096).astype(int)
        amounts[0] += windows * 4096 - amounts.sum()
        edges = mp.served_before(np.arange(windows + 1) * 4096, amounts, amounts.clip(1).astype(float))
        filled = mp.fill_windows(np.diff(edges, axis=0))
        assert (filled >= 0).all() and (filled.sum(1) == 4096).all() and (filled.sum(0) == amounts).all()
        assert np.abs(filled.cumsum(0) - np.outer(np.arange(1, windows + 1), amounts / windows)).max() <= 2 * mp.TURN + 2


def test_blocks_of_windows_join_without_a_gap(monkeypatch):
    monkeypatch.setattr(mp, "BLOCK", 3)
    totals, at = np.array([40_000, 7, 13_000, 900]), np.zeros(4, dtype=int)
    for block in range(5):
        rows = mp._block_turns(block, totals, totals.astype(float), 4096).to_pylist()
        for r in sorted(rows, key=lambda r: r["first"]):
            assert r["first"] == at[r["queue"]]
            at[r["queue"]] += r["amount"]
    assert (at == totals).all()


def test_tail_is_cut_at_powers_of_two():
    for tail in (0, 1, 1000, 4095):
        parts = mp.tail_lengths(tail)
        assert sum(n for _, n in parts) == tail and all(n & (n - 1) == 0 for _, n in parts)


def test_words_are_tokenised_alike_whatever_is_remembered(tokenizer, monkeypatch):
    import pyarrow as pa

    assert parts_at_space(vocabulary_path())
    known = Vocabulary(vocabulary_path())
    assert known.direct
    texts = [" ".join(spoken(k, 300, 3000)) + " don't I'LL 99bottles straße*** Ünïcode! naïve\"') x'" for k in range(6)] + ["", "THE the The <|EndOfText|> <|endoftext|>"]
    for _ in range(2):
        ids, bounds = known.encode(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr("geoledger.llm.wordids.KEEP_WORDS", 10)
    ids, bounds = known.encode(pa.array(texts, pa.large_string()))
    assert ids[bounds[0]:bounds[1]].tolist() == tokenizer.encode(texts[0], add_special_tokens=False).ids


def test_digests(spark, documents):
    row = mp.piece_digests(mp.pack_mixture(documents([(1, "word")]), vocabulary_path())).first()
    ids = np.array(Tokenizer.from_file(vocabulary_path()).encode("word", add_special_tokens=False).ids + [2], dtype="<u4")
    assert row.ids_crc32 == zlib.crc32(ids[row.start:row.start + row.length].tobytes())
