"""Quality classifier: a generalised additive model with pairwise interactions over surface features of a text.

Cyclic boosting with shallow trees learns one lookup table for each feature; further rounds learn tables over pairs of
features where the residuals still depend on both. A text is scored by adding the values of its bins.

Defined results: a null or empty text has all features 0 and is scored like any other; without labels of both classes the
score is constant; repeated rows are scored one by one; only ``doc_id`` and ``text`` are read, never language or source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.llm.labelled import label_sample, sigmoid
from geoledger.llm.memory import tidy
from geoledger.llm.wordarrays import Words, by_text, row_chunks, text_column

#: Labelled documents of either class that may be used for learning.
PER_CLASS = 10_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
PAIR_ROUNDS = 40
RATE = 0.1
LEAVES = 3
SMOOTHING = 5.0

FEATURES = ("log_words", "mean_word", "upper", "digits", "symbols", "other_marks", "foreign_bytes", "line_ends", "ends_in_symbol",
            "repeated_lines", "repeated_triples", "distinct_words", "commonest_word", "short_words", "long_words", "one_sign_words")

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,#*$%&|<>" for b in range(256)])


def _class_share(words: Words, flags: np.ndarray) -> np.ndarray:
    return by_text(flags[words.data], words.offsets) / np.maximum(np.diff(words.offsets), 1)


def _repeats(keys: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: keys that occurred before, distinct keys, most frequent key's count."""
    if not len(keys):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    new = np.append(True, (k[1:] != k[:-1]) | (t[1:] != t[:-1]))
    runs = np.diff(np.append(np.flatnonzero(new), len(k)))
    most = np.zeros(n)
    np.maximum.at(most, t[new], runs)
    distinct = np.bincount(t[new], minlength=n)
    return np.bincount(t, minlength=n) - distinct, distinct, most


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    words = Words(texts, lower=True)
    n, text = len(texts), words.text_of_word()
    count = words.counts
    size = np.maximum(count, 1)
    lengths = words.lengths
    last = words.data[words.starts + lengths - 1] if len(lengths) else words.data[:0]
    _, distinct, most = _repeats(words.hashes, text, n)
    first, triples = words.windows(3)
    again, _, _ = _repeats(triples, text[first] if len(first) else first, n)
    lines = Words(texts, separators=np.arange(256) == 10)
    lines_again, _, _ = _repeats(lines.hashes, lines.text_of_word(), n)
    upper, digit = np.zeros(256, bool), np.zeros(256, bool)
    upper[65:91], digit[48:58] = True, True
    newline = np.arange(256) == 10
    return np.column_stack([
        np.log1p(count), by_text(lengths, words.bounds) / size, _class_share(words, upper), _class_share(words, digit),
        _class_share(words, _SYMBOL), _class_share(words, _MARK), _class_share(words, np.arange(256) >= 128),
        _class_share(words, newline), by_text(_SYMBOL[last], words.bounds) / size, lines_again / np.maximum(lines.counts, 1),
        again / size, distinct / size, most / size, by_text(lengths <= 3, words.bounds) / size,
        by_text(lengths >= 12, words.bounds) / size, by_text((lengths == 1) & _SYMBOL[last], words.bounds) / size])


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and its ``features``, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            for low, high in row_chunks(texts):
                found = features(texts.slice(low, high - low)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(list(found), pa.list_(pa.float32()))],
                                                 names=["doc_id", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, features array<float>")


def _tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values of a tree of at most ``LEAVES`` leaves over ordered bins, by greatest gain at each split."""
    g, h = np.append(0, np.cumsum(gradient)), np.append(0, np.cumsum(weight))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + SMOOTHING)
    leaves = [(0, len(gradient))]
    while len(leaves) < LEAVES:
        best = (1e-9, None, None)
        for a, b in leaves:
            cuts = np.arange(a + 1, b)
            cuts = cuts[(h[cuts] - h[a] >= 1e-3) & (h[b] - h[cuts] >= 1e-3)]
            if len(cuts):
                gains = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (gains[k], (a, b), int(cuts[k]))
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(gradient))
    for a, b in leaves:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + SMOOTHING)
    return out


def _grid_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values of a two-level tree over a grid: one cut of the rows, then one cut of the columns on each side (or transposed)."""
    best_gain, best = -1.0, np.zeros_like(gradient)
    score = lambda g, h: g * g / (h + SMOOTHING)
    for turned in (False, True):
        g, h = (gradient.T, weight.T) if turned else (gradient, weight)
        for cut in range(1, g.shape[0]):
            total, values = 0.0, np.zeros_like(g)
            for side in (slice(0, cut), slice(cut, None)):
                gs, hs = np.append(0, np.cumsum(g[side].sum(axis=0))), np.append(0, np.cumsum(h[side].sum(axis=0)))
                gains = score(gs, hs) + score(gs[-1] - gs, hs[-1] - hs)
                k = int(np.argmax(gains))
                total += gains[k]
                values[side, :k] = gs[k] / (hs[k] + SMOOTHING)
                values[side, k:] = (gs[-1] - gs[k]) / (hs[-1] - hs[k] + SMOOTHING)
            if total > best_gain:
                best_gain, best = total, values.T if turned else values
    return best


class AdditiveModel:
    """Bin edges, one table for each feature and for each chosen pair, and a constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        d = x.shape[1]
        grid = lambda bins: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(d)]
        self.edges, self.pair_edges = grid(BINS), grid(PAIR_BINS)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        rate = (y.sum() + 1) / (len(y) + 2)
        self.constant = float(np.log(rate / (1 - rate)))
        if len(set(y.tolist())) < 2:
            return
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
        total = np.full(len(y), self.constant)
        for _ in range(ROUNDS):
            for j, b in enumerate(bins):
                p = sigmoid(total)
                size = len(self.tables[j])
                step = RATE * _tree(np.bincount(b, weights=y - p, minlength=size), np.bincount(b, weights=p * (1 - p), minlength=size))
                self.tables[j] += step
                total += step[b]
        p = sigmoid(total)
        ranked = []
        for i in range(d):
            for j in range(i + 1, d):
                g, h = self._grid(coarse, i, j, y - p), self._grid(coarse, i, j, p * (1 - p))
                ranked.append((float(np.sum(g * _grid_tree(g, h))), i, j))
        chosen = [(i, j) for _, i, j in sorted(ranked, reverse=True)[:PAIRS]]
        tables = {pair: np.zeros((len(self.pair_edges[pair[0]]) + 1, len(self.pair_edges[pair[1]]) + 1)) for pair in chosen}
        for _ in range(PAIR_ROUNDS):
            for i, j in chosen:
                p = sigmoid(total)
                step = RATE * _grid_tree(self._grid(coarse, i, j, y - p), self._grid(coarse, i, j, p * (1 - p)))
                tables[i, j] += step
                total += step[coarse[i], coarse[j]]
        self.pairs = [(i, j, tables[i, j]) for i, j in chosen]

    def _grid(self, coarse: list[np.ndarray], i: int, j: int, values: np.ndarray) -> np.ndarray:
        rows, columns = len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1
        return np.bincount(coarse[i] * columns + coarse[j], weights=values, minlength=rows * columns).reshape(rows, columns)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.constant)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return sigmoid(total)


def train(measured: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> AdditiveModel:
    """The model from at most ``per_class`` measured documents of either class that are not held out."""
    sample = label_sample(labels, "quality", per_class)
    rows = measured.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "features").orderBy("doc_id").toArrow()  # at most 2 * per_class ids
    x = np.array(rows.column("features").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return AdditiveModel(x, rows.column("label").to_numpy().astype(float))


def score_quality(measured: DataFrame, model: AdditiveModel) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` from measured documents, by adding the values of their bins."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("features")
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(FEATURES))
            found = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    kind = measured.schema["doc_id"].dataType.simpleString()
    return measured.select("doc_id", "features").mapInArrow(tidy(run), f"doc_id {kind}, score double, predicted int")
