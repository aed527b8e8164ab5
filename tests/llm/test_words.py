import numpy as np
import pyarrow as pa

from geoledger.llm.alignment import within
from geoledger.llm.wordarrays import PUNCTUATED, Words, row_chunks


def _array(texts):
    return pa.array(texts, pa.large_string())


def test_words_are_runs_without_ascii_space():
    texts = ["  a bb\tccc\n", "", "é x y", "\x0b\x0c", "end"]
    words = Words(_array(texts))
    assert words.counts.tolist() == [len(t.encode().split()) for t in texts]
    assert words.words(0, len(words.starts)) == [w for t in texts for w in t.encode().split()]


def test_texts_do_not_run_together_and_slices_work():
    words = Words(_array(["skip", "ab", "cd", "ab"]).slice(1))
    assert words.counts.tolist() == [1, 1, 1]
    assert words.hashes[0] == words.hashes[2] != words.hashes[1]


def test_equal_words_hash_equal_whatever_the_case_or_place():
    words = Words(_array(["The x, the", "THE"]), PUNCTUATED, lower=True)
    assert len(set(words.hashes[[0, 2, 3]].tolist())) == 1


def test_windows_stay_in_their_text_and_compare_by_words():
    words = Words(_array(["a b c d", "x a  b\nc", "a b"]))
    first, hashes = words.windows(3)
    assert first.tolist() == [0, 1, 4, 5]
    assert hashes[0] == hashes[3] and len(set(hashes.tolist())) == 3


def test_chunks_cover_all_rows_and_isolate_long_texts():
    texts = _array(["a" * 10, "b" * 100, "", "c" * 10, "d" * 10])
    assert list(row_chunks(texts, 25)) == [(0, 1), (1, 2), (2, 5)]
    assert list(row_chunks(_array([]), 25)) == []


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_banded_alignment_agrees_with_plain_edit_distance():
    random = np.random.default_rng(3)
    pairs = []
    for _ in range(300):
        a = random.integers(0, 20, int(random.integers(0, 50))).tolist()
        b = list(a)
        for _ in range(int(random.integers(0, 12))):
            k = int(random.integers(0, len(b) + 1))
            kind = int(random.integers(0, 3))
            b[k:k + (kind != 2)] = [] if kind == 1 else [int(random.integers(0, 20))]
        pairs.append((np.array(a, dtype=np.uint32), np.array(b[5:] if random.random() < 0.2 else b, dtype=np.uint32)))
    wanted = [_distance(a.tolist(), b.tolist()) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in pairs]
    assert within(pairs, 0.2).tolist() == wanted
    assert 50 < sum(wanted) < 250


def test_squeezed_integers_come_back():
    from geoledger.llm.substring_dedup import squeeze, unsqueeze

    random = np.random.default_rng(5)
    for kind in (np.uint32, np.uint64):
        values = np.unique(random.integers(0, np.iinfo(kind).max, 1000, dtype=kind, endpoint=True))
        assert (unsqueeze(squeeze(values), kind) == values).all() and len(unsqueeze(squeeze(values[:0]), kind)) == 0
    ids = random.integers(-5, 2**62, 100)
    assert (unsqueeze(squeeze(ids, rising=False), np.int64, rising=False) == ids).all()


def test_packing_workers_load_no_pandas():
    """What a worker imports stays with it, and executors run many."""
    import subprocess
    import sys
    code = "import sys, geoledger.llm.packing; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0


def test_many_alignments_agree_with_plain_edit_distance():
    from geoledger.llm.alignment import FAR, _bits, bounds

    random = np.random.default_rng(5)
    pairs = []
    for vocabulary in (3, 100, 10 ** 6):
        for _ in range(60):
            a = random.integers(0, vocabulary, random.integers(1, 150)).tolist()
            b = list(a)
            for _ in range(int(random.integers(0, 1 + len(a) // 3))):
                at = int(random.integers(0, len(b) + 1))
                b[at:at + int(random.integers(0, 2))] = random.integers(0, vocabulary, random.integers(0, 2)).tolist()
            pairs.append((np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32)))

    def plain(a, b):
        now = list(range(len(b) + 1))
        for i, x in enumerate(a):
            before, now = now, [i + 1]
            for j, y in enumerate(b):
                now.append(min(before[j] + (x != y), before[j + 1] + 1, now[j] + 1))
        return now[-1]

    want = [plain(a.tolist(), b.tolist()) for a, b in pairs]
    limits = [max(len(a), len(b)) // 5 for a, b in pairs]
    assert [d < FAR for d in bounds(pairs, limits)] == [w <= most for w, most in zip(want, limits)]
    worded = [k for k, (_, b) in enumerate(pairs) if len(b)]
    for width in (63, 64, 150):
        assert [w for k, w in zip(worded, _bits([pairs[k] for k in worded], width).tolist()) if want[k] <= width] == [want[k] for k in worded if want[k] <= width]
