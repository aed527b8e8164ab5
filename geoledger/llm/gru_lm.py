"""Language-model scores of whole documents by a gated recurrent network with a class-factored output.

The frequent words form classes of equal size; the network predicts the class of the next token, then the token within its
class. All other words share one token whose probability is divided by their corpus counts, so the score is a proper log
probability of the text over an open vocabulary. The network learns from all training documents, by truncated backpropagation
through time in numpy inside the tasks: a hash deals the documents over rounds and, within a round, over trainers; each trainer
goes on from the network of the round before, and the mean of what they arrive at is the network of the next round. The number of
trainers follows the tokens, and each has a task of its own. For scoring, documents are strung together in streams and the state is
carried from window to window and cleared between documents, so a document of any length is scored as a whole.

Data flow: counts are summed by Spark. The ``KEPT`` most frequent words travel to the tasks; the counts of all rarer words
are met by a join on the word's hash (a rare word has few occurrences, so no key is hot) and summed up by document.

Defined results: null and empty texts consist of the end token; without training documents all counts are 0; repeated rows
are scored one by one; only ``doc_id`` and ``text`` are read; words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.llm.memory import tidy
from geoledger.llm.wordarrays import Words, by_text, row_chunks, text_column
from geoledger.session import cut

KEPT = 1 << 17
CLASSES = 32
CLASS_SIZE = 32
HIDDEN = 24
STREAMS = 64
WINDOW = 32
EPOCHS = 2
ROUNDS = 4
SHARE = 1 << 19  # tokens that a trainer gets in a round, about
SLICES = 16  # parts in which weights are shuffled to be averaged
MOST_TASKS = 1024  # tasks of a round; beyond it a task holds several trainers, one after another
RATE = 4e-3
ADDED = 0.1
BATCH = 256
CHUNK = 3 << 20

END = np.int64(-0x61C8864680B583EB)  # the end token's place among the word hashes


def _hashes(texts: pa.Array) -> Words:
    return Words(texts, lower=True)


def count_words(docs: DataFrame) -> DataFrame:
    """``word``, ``c`` over all tokens of ``docs``; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            for low, high in row_chunks(texts, CHUNK):
                words, n = np.unique(_hashes(texts.slice(low, high - low)).hashes.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(words, END)), pa.array(np.append(n, high - low).astype(np.int64))],
                                                 names=["word", "n"])

    return cut(docs.select("text").mapInArrow(tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("c")))


class Vocabulary:
    """The most frequent words with their counts, the network's tokens among them, and the totals."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, distinct: int):
        """Words by falling count."""
        size = CLASSES * CLASS_SIZE - 1  # the last token stands for all other words
        heads = words[:size].tolist()
        if END not in heads and size:
            heads = heads[:size - 1] + [int(END)]
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.tokens, self.distinct = tokens, distinct
        self.total = tokens + ADDED * (distinct + 1)
        known = dict(zip(words.tolist(), counts.tolist()))
        head_counts = np.array([known.get(w, 0) for w in heads], dtype=float)
        self.rest = max(self.total - float((head_counts + ADDED).sum()), ADDED)
        self.shares = np.append(head_counts + ADDED, self.rest) / self.total
        place = {w: k for k, w in enumerate(heads)}
        self.other = len(heads)
        self.end = place.get(int(END), self.other)
        self.token = np.array([place.get(w, self.other) for w in self.words.tolist()], dtype=np.int32)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (-1: not among the kept words) and network tokens."""
        if not len(self.words):
            return np.full(len(hashes), -1), np.full(len(hashes), self.other, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = self.words[at] == hashes
        return np.where(hit, self.counts[at], -1), np.where(hit, self.token[at], self.other).astype(np.int32)


def read_vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(KEPT).toArrow()  # at most KEPT rows
    return Vocabulary(top.column("word").to_numpy(), top.column("c").to_numpy(), int(total["n"] or 0), int(total["v"]))


def _softmax_of(scores: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the log of the softmax at its target, and the softmax."""
    rows = np.arange(len(targets))
    with np.errstate(over="ignore"):
        shares = np.exp(scores)
    sums = shares @ np.ones(shares.shape[1], dtype=shares.dtype)
    if len(sums) and not (sums.min() > 1e-30 and sums.max() < 1e30):  # far from zero: shifted first
        scores = scores - scores.max(axis=1, keepdims=True)
        shares = np.exp(scores)
        sums = shares.sum(axis=1)
    shares /= sums[:, None]
    return scores[rows, targets] - np.log(sums), shares


class GatedNetwork:
    """A gated recurrent layer over tokens, with softmax outputs for the class and within each class."""

    def __init__(self, shares: np.ndarray, end: int, seed: int = 7):
        random = np.random.default_rng(seed)
        normal = lambda *shape: (random.standard_normal(shape) * 0.08).astype(np.float32)
        padded = np.full(CLASSES * CLASS_SIZE, 1e-12)
        padded[:len(shares)] = np.maximum(shares, 1e-12)
        grid = padded.reshape(CLASSES, CLASS_SIZE)
        self.end = end
        self.p = {
            "x": normal(CLASSES * CLASS_SIZE, 3 * HIDDEN), "u": normal(HIDDEN, 3 * HIDDEN), "c": normal(HIDDEN, CLASSES),
            "cb": np.log(grid.sum(axis=1)).astype(np.float32), "w": normal(CLASSES, HIDDEN, CLASS_SIZE),
            "wb": np.log(grid / grid.sum(axis=1, keepdims=True)).astype(np.float32),
        }

    def states(self, tokens: np.ndarray, h: np.ndarray, keep: bool = False):
        """Hidden states after each of the tokens (rows: sequences); the state is cleared where a document begins.

        Inside, a sequence is a column, so each gate is one block of memory, and the weights carry the factors that the
        exponentials need: the gates are 1 / (1 + exp(-x)), the candidate 2 / (1 + exp(-2x)) - 1."""
        p, n_steps, width = self.p, tokens.shape[1], len(h)
        factor = np.full(3 * HIDDEN, -1, dtype=p["x"].dtype)
        factor[2 * HIDDEN:] = -2
        gates = np.ascontiguousarray((p["x"] * factor)[tokens.T].transpose(0, 2, 1))
        u = np.ascontiguousarray((p["u"] * factor).T)
        ended = tokens.T == self.end
        cleared = ended.any(axis=1).tolist()
        h = np.ascontiguousarray(h.T, dtype=p["x"].dtype)
        kept = n_steps if keep else 1  # without gradients each step overwrites the one before
        before, n = (np.empty((kept, HIDDEN, width), h.dtype) for _ in range(2))
        zr, sums = np.empty((kept, 2 * HIDDEN, width), h.dtype), np.empty((kept, 3 * HIDDEN, width), h.dtype)
        out = np.empty((n_steps, HIDDEN, width), h.dtype)
        with np.errstate(over="ignore"):
            for t in range(n_steps):
                k = t if keep else 0
                old, new, both, s, o = before[k], n[k], zr[k], sums[k], out[t]
                if cleared[t]:
                    np.multiply(h, ~ended[t], out=old)
                elif keep:
                    old[:] = h
                else:
                    old = h
                np.dot(u, old, out=s)
                np.add(gates[t, :2 * HIDDEN], s[:2 * HIDDEN], out=both)
                np.exp(both, out=both)
                both += 1
                np.reciprocal(both, out=both)
                np.multiply(both[HIDDEN:], s[2 * HIDDEN:], out=new)
                new += gates[t, 2 * HIDDEN:]
                np.exp(new, out=new)
                new += 1
                np.divide(2, new, out=new)
                new -= 1
                np.subtract(old, new, out=o)
                o *= both[:HIDDEN]
                o += new
                h = o
        return out.transpose(0, 2, 1), np.ascontiguousarray(h.T), (before, zr, n, sums) if keep else ()

    def log_probabilities(self, h: np.ndarray, targets: np.ndarray, gradient: dict | None = None):
        """Natural log probability of each target after its state; with ``gradient``, also adds the loss gradients and
        returns the gradient for the states."""
        p = self.p
        group = (targets // CLASS_SIZE).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        group, inside = group[order], (targets % CLASS_SIZE)[order]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:len(group)])
        borders = list(zip(group[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(group)]))
        states = np.ones((len(h), HIDDEN + 1), dtype=h.dtype)  # the last column meets the offsets
        states[:, :HIDDEN] = h[order]
        first, classes = _softmax_of(states @ np.concatenate([p["c"], p["cb"][None]]), group)
        weights = np.concatenate([p["w"], p["wb"][:, None]], axis=1)
        scores = np.empty((len(h), CLASS_SIZE), dtype=h.dtype)
        for k, low, high in borders:
            np.dot(states[low:high], weights[k], out=scores[low:high])
        second, words = _softmax_of(scores, inside)
        out = np.empty_like(first)
        out[order] = first + second
        if gradient is None:
            return out, None
        rows = np.arange(len(h))
        classes[rows, group] -= 1
        words[rows, inside] -= 1
        across = states.T @ classes
        gradient["c"] += across[:HIDDEN]
        gradient["cb"] += across[HIDDEN]
        back, inner, turned = classes @ p["c"].T, np.empty_like(states[:, :HIDDEN]), np.ascontiguousarray(p["w"].transpose(0, 2, 1))
        for k, low, high in borders:
            own = np.dot(states[low:high].T, words[low:high])
            gradient["w"][k] += own[:HIDDEN]
            gradient["wb"][k] += own[HIDDEN]
            np.dot(words[low:high], turned[k], out=inner[low:high])
        back += inner
        spread = np.empty_like(back)
        spread[order] = back
        return out, spread

    def train(self, stream: np.ndarray, begun: float = 0.0, part: float = 1.0) -> None:
        """Adam over windows of ``STREAMS`` parallel streams; gradients stop at window borders, states go on. The rate falls to
        zero over the whole training, of which this is ``part`` after the share ``begun``."""
        streams = min(STREAMS, max((len(stream) - 1) // WINDOW, 1))
        length = (len(stream) - 1) // streams
        if length < 1:
            return
        inputs = stream[:streams * length].reshape(streams, length)
        targets = stream[1:streams * length + 1].reshape(streams, length)
        values, own = self._views(np.concatenate([self.p[k].reshape(-1) for k in sorted(self.p)]))
        changes, gradient = self._views(np.zeros_like(values))
        self.p = own
        first, second, step_of = np.zeros_like(values), np.zeros_like(values), np.empty_like(values)
        step, total = 0, EPOCHS * -(-length // WINDOW)
        for _ in range(EPOCHS):
            h = np.zeros((streams, HIDDEN), dtype=np.float32)
            for low in range(0, length, WINDOW):
                tokens = inputs[:, low:low + WINDOW]
                out, h, steps = self.states(tokens, h, keep=True)
                changes[:] = 0
                goal = targets[:, low:low + WINDOW].T.reshape(-1)
                _, back = self.log_probabilities(out.reshape(-1, HIDDEN), goal, gradient)
                self._backward(tokens, steps, back.reshape(out.shape), gradient)
                step += 1
                rate = RATE * (1 - begun - part * step / (total + 1))
                changes *= 1.0 / len(goal)
                first *= 0.9
                second *= 0.99
                first += np.multiply(changes, 0.1, out=step_of)
                changes *= changes
                second += np.multiply(changes, 0.01, out=step_of)
                np.sqrt(np.multiply(second, 1 / (1 - 0.99 ** step), out=step_of), out=step_of)
                step_of += 1e-8
                np.divide(first, step_of, out=step_of)
                step_of *= rate / (1 - 0.9 ** step)
                values -= step_of

    def _views(self, values: np.ndarray) -> tuple[np.ndarray, dict]:
        """One array of all weights, and its parts under their names."""
        parts, at = {}, 0
        for k in sorted(self.p):
            parts[k] = values[at:at + self.p[k].size].reshape(self.p[k].shape)
            at += self.p[k].size
        return values, parts

    def weights(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in sorted(self.p)]).astype(np.float64)

    def set_weights(self, values: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            self.p[k] = values[at:at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size

    def _backward(self, tokens: np.ndarray, steps: tuple, back: np.ndarray, gradient: dict) -> None:
        before, zr, n, sums = steps
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        back = np.ascontiguousarray(back.transpose(0, 2, 1))
        rest = 1 - z
        to_n, to_z, to_r = rest * (1 - n * n), (before - n) * z * rest, sums[:, 2 * HIDDEN:] * -0.5 * r * (1 - r)
        ended = tokens.T == self.end
        cleared = ended.any(axis=1).tolist()
        every, candidates, later, u = np.empty_like(sums), np.empty_like(n), np.zeros_like(back[0]), self.p["u"]
        for t in range(len(n) - 1, -1, -1):
            d, dn, e = back[t], candidates[t], every[t]
            d += later
            np.multiply(d, to_n[t], out=dn)
            np.multiply(d, to_z[t], out=e[:HIDDEN])
            np.multiply(dn, to_r[t], out=e[HIDDEN:2 * HIDDEN])
            np.multiply(dn, r[t], out=e[2 * HIDDEN:])
            later = u @ e
            d *= z[t]
            later += d
            if cleared[t]:
                later *= ~ended[t]
        gradient["u"] += np.matmul(before, every.transpose(0, 2, 1)).sum(axis=0)
        every[:, 2 * HIDDEN:] = candidates
        flat = tokens.T.reshape(-1)
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        flat = flat[order]
        starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        gradient["x"][flat[starts]] += np.add.reduceat(every.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)[order], starts, axis=0)

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each token sequence (its last token is the end), in windows with carried state.

        Documents follow each other in streams of about equal length: the end token of one clears the state for the next."""
        if not documents:
            return np.zeros(0)
        sizes = np.array([len(d) for d in documents])
        streams: list[list[int]] = [[] for _ in range(min(BATCH, max(1, int(sizes.sum() // sizes.max()))))]
        filled = [(0, k) for k in range(len(streams))]
        for k in np.argsort(-sizes, kind="stable").tolist():
            size, at = filled[0]
            streams[at].append(k)
            heapq.heapreplace(filled, (size + int(sizes[k]), at))
        streams.sort(key=lambda s: -int(sizes[s].sum()))
        order = [k for s in streams for k in s]
        flat = np.concatenate([documents[k] for k in order])
        logs = np.empty(len(flat), dtype=np.float64)
        stops = np.cumsum([int(sizes[s].sum()) for s in streams])
        starts = np.append(0, stops[:-1])
        lengths = stops - starts
        h = np.zeros((len(streams), HIDDEN), dtype=np.float32)
        for at in range(0, int(lengths[0]), WINDOW):
            live = int(np.count_nonzero(lengths > at))  # streams are sorted by falling length
            place = (starts[:live] + at)[:, None] + np.arange(min(WINDOW, int(lengths[0]) - at))
            real = place < stops[:live, None]
            before = np.where(place > starts[:live, None], flat[np.minimum(place, len(flat)) - 1], self.end)
            states, h, _ = self.states(before, h[:live])
            real = real.T.reshape(-1)
            wanted = place.T.reshape(-1)[real]
            logs[wanted], _ = self.log_probabilities(states.reshape(-1, HIDDEN)[real], flat[wanted])
        out = np.zeros(len(documents))
        out[order] = np.add.reduceat(logs, np.append(0, np.cumsum(sizes[order])[:-1]))
        return out


def train_network(training: DataFrame, vocabulary: Vocabulary) -> GatedNetwork:
    """A network that has learnt from every document of ``training``, each in one round and there ``EPOCHS`` times."""
    shared = training.sparkSession.sparkContext.broadcast(vocabulary)
    trainers = max(1, -(-vocabulary.tokens // (ROUNDS * SHARE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            for low, high in row_chunks(texts):
                words = _hashes(texts.slice(low, high - low))
                tokens = shared.value.look_up(words.hashes.view(np.int64))[1].astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("place").slice(low, high - low),
                     pa.array([tokens[a:b].tobytes() for a, b in zip(words.bounds[:-1], words.bounds[1:])], pa.binary())], names=["place", "tokens"])

    dealt = training.select(F.xxhash64("doc_id", "text").alias("place"), "text").mapInArrow(tidy(run), "place long, tokens binary")
    turn, trainer = F.pmod("place", F.lit(ROUNDS)), F.pmod(F.floor(F.col("place") / ROUNDS), F.lit(trainers))
    learning = cut(dealt.select("place", "tokens", turn.cast("int").alias("turn"), trainer.cast("long").alias("trainer"))
                   .withColumn("task", F.col("trainer") % min(trainers, MOST_TASKS)).join(F.broadcast(_seats(training.sparkSession, trainers)), "task", "left")
                   .withColumn("seat", F.coalesce("seat", "task")))
    network = GatedNetwork(vocabulary.shares, vocabulary.end)
    if vocabulary.tokens:
        for number in range(ROUNDS):
            mine = learning.where(F.col("turn") == number).drop("turn")
            network.set_weights(_next_weights(mine, network, number, trainers))
    return network


def _seats(spark: SparkSession, trainers: int) -> DataFrame:
    """``task``, ``seat``: for each task of a round a number that is shuffled to a partition of its own. The tasks' own numbers would
    meet in some partitions and leave others empty, and the round would last as long as the fullest."""
    tasks = min(trainers, MOST_TASKS)
    return spark.range(64 * tasks).groupBy(F.pmod(F.hash("id"), F.lit(tasks)).cast("long").alias("task")).agg(F.min("id").alias("seat"))


def _next_weights(learning: DataFrame, network: GatedNetwork, number: int, trainers: int) -> np.ndarray:
    """The mean of the weights at which the trainers of a round arrive, each weighted by its tokens."""
    model = learning.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, key, parts = None, 0, None, []

        def learn() -> None:
            nonlocal total, seen
            own = GatedNetwork.__new__(GatedNetwork)
            own.end, own.p = model.value.end, {k: v.copy() for k, v in model.value.p.items()}
            end = np.array([own.end], dtype=np.int32)
            pieces = [end]
            for tokens in parts:
                pieces += [np.frombuffer(tokens, dtype=np.int16).astype(np.int32), end]
            stream = np.concatenate(pieces)
            own.train(stream, number / ROUNDS, 1 / ROUNDS)
            weighted = own.weights() * len(stream)
            total, seen = weighted if total is None else total + weighted, seen + len(stream)

        for batch in batches:
            for trainer, tokens in zip(batch.column("trainer").to_pylist(), batch.column("tokens").to_pylist()):
                if trainer != key and parts:
                    learn()
                    parts = []
                key = trainer
                parts.append(tokens)
        if parts:
            learn()
        if seen:
            slices = [x.tobytes() for x in np.array_split(total, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([seen] * SLICES, pa.int64()), pa.array(slices, pa.binary())],
                                             names=["slice", "seen", "total"])

    def mean(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(t) for t in table.column("total").to_pylist()], axis=0)
        value = total / sum(table.column("seen").to_pylist())
        return pa.table({"slice": table.column("slice").slice(0, 1), "value": pa.array([value.tobytes()], pa.binary())})

    ordered = learning.repartition(min(trainers, MOST_TASKS), "seat").sortWithinPartitions("trainer", "place", "tokens")
    found = ordered.mapInArrow(tidy(run), "slice int, seen long, total binary").groupBy("slice").applyInArrow(mean, "slice int, value binary")
    rows = {r["slice"]: r["value"] for r in found.collect()}  # the weights of one network
    return np.concatenate([np.frombuffer(rows[k]) for k in sorted(rows)]) if rows else network.weights()


def score_documents(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, network: GatedNetwork) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score``, ``score`` for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        number = TaskContext.get().partitionId() << 36
        end_count = int(known.look_up(np.array([END]))[0][0])
        for batch in batches:
            texts = text_column(batch)
            for low, high in row_chunks(texts, CHUNK):
                words = _hashes(texts.slice(low, high - low))
                hashes = words.hashes.view(np.int64)
                c, tokens = known.look_up(hashes)
                kept = c >= 0
                logs = np.log10(np.where(kept, c, 0) + ADDED)
                base = by_text(np.where(kept, logs - np.log10(known.total), 0.0), words.bounds)
                other = by_text(np.where(kept & (tokens == known.other), logs - np.log10(known.rest), 0.0), words.bounds)
                sequences = [np.append(tokens[a:b], np.int32(known.end)) for a, b in zip(words.bounds[:-1], words.bounds[1:])]
                score = model.score(sequences) / np.log(10) + other
                base += np.log10(max(end_count, 0) + ADDED) - np.log10(known.total)
                if known.end == known.other:
                    score += np.log10(max(end_count, 0) + ADDED) - np.log10(known.rest)
                rare = np.flatnonzero(~kept)
                splits = np.searchsorted(rare, words.bounds)
                n = high - low
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(number, number + n)), batch.column("doc_id").slice(low, n), pa.array(words.counts + 1),
                     pa.array(by_text(kept, words.bounds) + (end_count > 0)), pa.array(base), pa.array(score),
                     pa.ListArray.from_arrays(pa.array(splits.astype(np.int32)), pa.array(hashes[rare]))],
                    names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])
                number += n

    scored = cut(docs.select("doc_id", "text").mapInArrow(
        tidy(run), f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<long>"))
    log = F.log10(F.coalesce("c", F.lit(0)) + ADDED)
    rest = (scored.select("row", F.explode("rare").alias("word")).join(counts, "word", "left").groupBy("row")
            .agg(F.count("c").alias("more_known"), F.count("*").alias("n"), F.sum(log).alias("logs")))
    share = lambda total: F.coalesce(F.col("logs") - F.col("n") * float(np.log10(total)), F.lit(0.0))
    return scored.drop("rare").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + share(vocabulary.total)).alias("base_score"), (F.col("score") + share(vocabulary.rest)).alias("score"))


def language_model_scores(docs: DataFrame, is_training: Column) -> DataFrame:
    """Scores of all documents by counts and a network from those with ``is_training``; adds ``train_tokens``."""
    training = docs.where(is_training)
    counts = count_words(training)
    vocabulary = read_vocabulary(counts)
    network = train_network(training, vocabulary)
    return score_documents(docs, counts, vocabulary, network).withColumn("train_tokens", F.lit(vocabulary.tokens).cast("long"))
