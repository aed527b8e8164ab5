"""Packing: exact tokens, complete and gapless sequences, and few of them."""

import collections
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from geoledger.llm import packing
from geoledger.llm.queries import vocabulary_path

from .conftest import spoken


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary_path())


def _check(rows, texts, tokenizer):
    """All pieces are there, and sequences are gapless; returns sequences and the least possible number."""
    want = collections.Counter()
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start:start + 4096]
            want[doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    return len(sequences), -(-sum(r.length for r in rows) // 4096)


def test_odd_documents(documents, tokenizer):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "a<|endoftext|>b it's don't ÀÉ ﬁ 123 4a5  x\x1cy 👍🏽 漢字"), (5, " ".join(spoken(1, 9000))), (5, "same id"), (5, "same id"),
             (None, "no id"), (6, "x" * 30_000), (7, "!!!???$$$ #*& a|b <x>")]
    df = documents(texts).selectExpr("*", "source AS shard", "n_chars AS length", "lang AS start")
    assert _check(packing.pack(df, vocabulary_path()).collect(), texts, tokenizer)[0] <= 12
    assert packing.pack(df.limit(0), vocabulary_path()).count() == 0


def test_given_documents_fill_their_sequences(spark, sf_dir, tokenizer):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in df.collect()]
    used, least = _check(packing.pack(df, vocabulary_path()).collect(), texts, tokenizer)
    assert used <= least + 1
    used, _ = _check(packing.pack(df, vocabulary_path(), shard_pieces=50).collect(), texts, tokenizer)
    assert used <= least + 6


def test_crossover_keeps_every_item_once_and_evolution_does_not_get_worse():
    random = np.random.default_rng(1)
    lengths = random.integers(200, 2500, 400).tolist()
    first = packing.Packing([], [])
    first.best_fit(random.permutation(400).tolist(), lengths)
    second = packing.Packing([], [])
    second.best_fit(np.argsort(lengths)[::-1].tolist(), lengths)
    child = packing.crossover(first, second, lengths, random)
    assert sorted(i for b in child.bins for i in b) == list(range(400))
    assert child.loads == [sum(lengths[i] for i in b) for b in child.bins] and max(child.loads) <= 4096
    best = packing.evolve(lengths, [first], 3)[0]
    assert len(best.bins) <= min(len(first.bins), len(second.bins))
    again = packing.Packing.of(best.numbers(400), lengths)
    assert again.fitness == best.fitness
    assert packing.evolve([5], [], 1)[0].bins == [[0]]


def test_crossovers_beat_best_fit_decreasing():
    """Lengths just over a third and the like, which best-fit decreasing packs badly."""
    random = np.random.default_rng(7)
    better = 0
    for seed in range(12):
        lengths = np.concatenate([random.integers(1366, 1500, 60), random.integers(820, 1000, 60), random.integers(300, 700, 60)]).tolist()
        first = packing.Packing([], [])
        first.best_fit(np.argsort(-np.array(lengths), kind="stable").tolist(), lengths)
        best = packing.evolve(lengths, [], seed)[0]
        assert best.fitness >= first.fitness and sorted(i for b in best.bins for i in b) == list(range(180))
        better += best.fitness > first.fitness
    assert better >= 6
