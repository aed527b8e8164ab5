"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary texts.

Both classes back off to one shared distribution of continuation counts, so a rare expression that neither class knows well
weighs nothing in the comparison. A text's evidence is the difference of its two log-likelihoods per word; a logistic curve
fitted on training documents that were not counted turns it into a score.

Defined results: words are lower-cased runs between white space and ASCII punctuation; a null or empty text has evidence
0; with no labels at all every score is 0.5; repeated rows are scored one by one; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.session import cut
from geoledger.llm.labelled import fit_logistic, label_sample, sigmoid
from geoledger.llm.memory import tidy
from geoledger.llm.wordarrays import PUNCTUATED, Words, by_text, mix, row_chunks, text_column

#: Labelled documents of either class that may be used: about four fifths are counted, the rest fits the curve.
PER_CLASS = 2500
DISCOUNT = 0.75
UNSEEN = 0.5
THRESHOLD = 0.7
EVIDENCE = 15.0  # log-likelihood ratio from which class counts are told apart (about one chance in 10,000)

_PAIR = np.uint64(0xA24BAED4963EE407)
_COUNTED = pa.schema([("label", pa.int32()), ("prev", pa.int64()), ("word", pa.int64()), ("n", pa.int64())])


def _pairs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word, 0 at the start of a text."""
    before = np.zeros_like(words.hashes)
    before[1:] = words.hashes[:-1]
    heads = words.bounds[:-1][words.counts > 0]
    before[heads] = 0
    return before, words.hashes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a class each word (``prev`` 0) and each word pair occurs."""
    for batch in batches:
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        texts = text_column(batch)
        for low, high in row_chunks(texts):
            words = Words(texts.slice(low, high - low), PUNCTUATED, lower=True)
            before, word = _pairs(words)
            text = words.text_of_word().astype(np.uint64)
            rows = np.vstack([np.column_stack([text, np.zeros_like(word), word]), np.column_stack([text, before, word])[before != 0]])
            rows = np.unique(rows, axis=0)
            rows[:, 0] = labels[low:high][rows[:, 0].astype(np.int64)]
            found, n = np.unique(rows, axis=0, return_counts=True)
            columns = [found[:, 0].astype(np.int32), found[:, 1].astype(np.int64), found[:, 2].astype(np.int64), n.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_COUNTED)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four minimum hashes over five-word windows (over words in shorter texts), to tell copies among training texts."""
    for batch in batches:
        texts, keys = text_column(batch), []
        for row in range(len(texts)):
            words = Words(texts.slice(row, 1), PUNCTUATED, lower=True)
            hashes = words.windows(5)[1] if len(words.hashes) >= 5 else words.hashes
            keys.append([int((mix(hashes ^ np.uint64(k))).min().astype(np.int64)) if len(hashes) else 0 for k in (1, 2, 3, 4)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("text"),
                                          *[pa.array([k[i] for k in keys], pa.int64()) for i in range(4)]],
                                         names=["doc_id", "label", "text", "k1", "k2", "k3", "k4"])


def telling(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Whether class counts differ by more than ``EVIDENCE`` in the log-likelihood ratio of a two-by-two table."""
    texts = np.maximum(texts.astype(float), 1)[:, None]
    rate = counts.sum(axis=0) / texts.sum()
    total = np.zeros(counts.shape[1])
    for hits, misses in zip(counts, texts - counts):
        n = hits + misses
        for part, expected in ((hits, n * rate), (misses, n * (1 - rate))):
            total += np.where(part > 0, part * np.log(np.maximum(part, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return 2 * total > EVIDENCE


class KneserNeyPair:
    """Both models as sorted arrays: words, contexts and word pairs with what the comparison needs of each.

    Counts are numbers of training texts. An expression keeps discounted counts of its own in the two classes only where
    they differ more than chance explains (``telling``); every other one gets its probability from the shared counts.
    """

    def __init__(self, words: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, texts: np.ndarray):
        """words: hash, shared continuation count, counts by class. contexts: hash, totals by class. pairs: two hashes, counts."""
        order = np.argsort(words["word"].astype(np.uint64))
        words = words[order]
        self.word = words["word"].astype(np.uint64)
        shared = words["shared"] + UNSEEN
        known = shared / (shared.sum() + UNSEEN) if len(words) else shared
        counts = np.vstack([words["n0"], words["n1"]]).astype(float)
        own = np.maximum(counts - DISCOUNT, 0) * telling(counts, texts) / np.maximum(counts.sum(axis=1), 1)[:, None]
        back = 1 - own.sum(axis=1)
        unigram = own + back[:, None] * known
        self.log_unknown = float(np.log(back[1]) - np.log(back[0]))

        order = np.argsort(contexts["prev"].astype(np.uint64))
        contexts = contexts[order]
        self.context = contexts["prev"].astype(np.uint64)
        sums = np.maximum(np.vstack([contexts["n0"], contexts["n1"]]), 1).astype(float)
        seen = np.vstack([pairs["n0"], pairs["n1"]]).astype(float)
        pairs, seen = pairs[telling(seen, texts)], seen[:, telling(seen, texts)]
        key = mix(pairs["prev"].astype(np.uint64) * _PAIR + pairs["word"].astype(np.uint64))
        order = np.argsort(key)
        pairs, seen, self.pair = pairs[order], seen[:, order], key[order]
        at = np.searchsorted(self.context, pairs["prev"].astype(np.uint64))
        which = np.searchsorted(self.word, pairs["word"].astype(np.uint64))
        share = np.maximum(seen - DISCOUNT, 0) / sums[:, at]
        used = np.vstack([np.bincount(at, weights=row, minlength=len(self.context)) for row in share])
        backoff = np.maximum(1 - used, 1e-6)
        kept = np.flatnonzero(used.any(axis=0))
        bigram = share + backoff[:, at] * unigram[:, which]
        self.context = self.context[kept]
        self.log_backoff = (np.log(backoff[1]) - np.log(backoff[0]))[kept]
        self.log_unigram = np.log(unigram[1]) - np.log(unigram[0])
        self.log_bigram = np.log(bigram[1]) - np.log(bigram[0])
        own_words = np.flatnonzero(own.any(axis=0))  # all others have the evidence of an unknown word
        self.word, self.log_unigram = self.word[own_words], self.log_unigram[own_words]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.full(len(wanted), missing), np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        return np.where(hit, values[at], missing), hit

    def evidence(self, words: Words) -> np.ndarray:
        """Per text: toxic minus ordinary log-likelihood, divided by the words, and the same by their square root."""
        before, word = _pairs(words)
        single, _ = self._find(self.word, word, self.log_unigram, self.log_unknown)
        back, _ = self._find(self.context, before, self.log_backoff, 0.0)
        pair, hit = self._find(self.pair, mix(before * _PAIR + word), self.log_bigram, 0.0)
        sums = by_text(np.where(hit, pair, single + back), words.bounds)
        n = np.maximum(words.counts, 1)
        return np.column_stack([sums / n, sums / np.sqrt(n)])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[KneserNeyPair, np.ndarray]:
    """Models and curve from at most ``per_class`` labelled training documents of either class."""
    sample = label_sample(labels, "toxic", per_class)
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 2 * per_class ids
              .mapInArrow(tidy(_sketch), f"doc_id {kind}, label int, text string, k1 long, k2 long, k3 long, k4 long"))
    for key in ("k1", "k2", "k3", "k4"):  # one text of each group of copies is counted
        chosen = chosen.groupBy("label", key).agg(F.min(F.struct(*[c for c in chosen.columns if c not in ("label", key)])).alias("row")).select("label", "row.*")
    chosen = cut(chosen.select("doc_id", "label", "text"))
    counted = F.pmod(F.xxhash64("doc_id"), F.lit(5)) > 0
    pairs = (chosen.where(counted).select("label", "text").mapInArrow(tidy(_count), "label int, prev long, word long, n long")
             .groupBy("prev", "word").agg(*[F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)])
             .persist())
    both = [F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)]
    alone, after = pairs.where("prev = 0").select("word", "n0", "n1"), pairs.where("prev <> 0")
    shared = after.groupBy("word").agg(F.count("*").alias("shared"))
    words = alone.join(shared, "word", "left").select("word", F.coalesce("shared", F.lit(0)).alias("shared"), "n0", "n1")
    often = F.col("n0") + F.col("n1") > EVIDENCE / 4  # fewer texts than this never tell the classes apart
    arrays = []
    for df in (words, after.groupBy("prev").agg(*both), after.where(often)):
        table = df.toArrow()  # bounded by the sample
        arrays.append(np.rec.fromarrays([table.column(c).to_numpy().astype(np.int64) for c in table.column_names], names=table.column_names))
    texts = {r["label"]: r["n"] for r in chosen.where(counted).groupBy("label").agg(F.count("*").alias("n")).collect()}
    model = KneserNeyPair(*arrays, np.array([texts.get(0, 0), texts.get(1, 0)]))
    pairs.unpersist()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _evidence(shared.value, text_column(batch))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["label", "a", "b"])

    rows = chosen.where(~counted).select("label", "text").mapInArrow(tidy(measure), "label int, a double, b double").toArrow()
    x = np.column_stack([rows.column("a").to_numpy(), rows.column("b").to_numpy()])
    return model, fit_logistic(x, rows.column("label").to_numpy().astype(float), ridge=1e-2)


def _evidence(model: KneserNeyPair, texts: pa.Array) -> np.ndarray:
    parts = [model.evidence(Words(texts.slice(low, high - low), PUNCTUATED, lower=True)) for low, high in row_chunks(texts)]
    return np.vstack(parts) if parts else np.zeros((0, 2))


def score_toxicity(docs: DataFrame, trained: tuple[KneserNeyPair, np.ndarray]) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` for every row of ``docs``; narrow, one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(trained)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = shared.value
        for batch in batches:
            found = sigmoid(_evidence(model, text_column(batch)) @ weights[:-1] + weights[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(score), f"doc_id {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, trained: tuple[KneserNeyPair, np.ndarray]) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text is not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(trained)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = shared.value
        for batch in batches:
            found = sigmoid(_evidence(model, text_column(batch)) @ weights[:-1] + weights[-1])
            yield batch.filter(pa.array(found < THRESHOLD))

    return docs.mapInArrow(tidy(keep), docs.schema)
