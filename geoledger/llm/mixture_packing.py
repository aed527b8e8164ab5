"""Packing with a controlled mixture: deficit round-robin over source queues.

Each source is a queue of its documents' tokens; the largest ``QUEUES - 1`` sources have a queue each, all further ones share
the last. A window of ``capacity`` tokens is filled from the queues in the proportions ``targets`` (by default those of the
corpus, so that all queues end together). In each window every queue's credit grows by its quantum; a queue with a credit of
``TURN`` tokens or more is served its whole tokens, smaller credits wait and are carried to the next windows, and what is
still free goes to the queues that are owed most, which lowers their credit. A queue that has run dry leaves its part to the
others. Windows are dealt to tasks in blocks of ``BLOCK``. What each queue has given before a block follows from the block's
number alone (tokens merged by virtual time), so a block starts with the deficits that its predecessor leaves.

Data flow: tokenise once, each task numbering its tokens by queue (no shuffle); add what earlier tasks hold of the queue; plan
the blocks; meet turns with documents in stretches of a queue by an equi-join; slice. Stretches bound the rows of a key, so a
source with a third of all rows is spread like the rest. Through the driver go at most ``QUEUES`` sums.

The last tokens, fewer than ``capacity``, become sequences whose lengths are powers of two: nothing is padded.

Defined results: null and empty texts have one token, the end token; a null source, or a missing column, is a source of its own; an empty table
gives no pieces; repeated rows are packed as often as they occur; other columns are not read. Documents are cut at turns; every
token lies in exactly one piece. Target weights must be positive; sources without one get the smallest weight given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoledger.llm.memory import tidy
from geoledger.llm.wordarrays import row_chunks, text_column
from geoledger.llm.wordids import tokenizer, vocabulary
from geoledger.session import cut

CAPACITY = 4096
END = 2
QUEUES = 1024
TURN = 64
BLOCK = 256  # windows
BROADCAST_PARTS = 500_000  # rows of 20 bytes: (queue, task) pairs whose offsets may be broadcast
STRETCH = 16_384  # tokens of a queue that share a join key; a stored run of ids is no longer

_RUN = "doc_id long, queue int, part long, at long, start long, doc_tokens long, ids binary"


def queue_numbers(docs: DataFrame, source: str, targets: dict[str, float] | None) -> tuple[DataFrame, dict[int, float]]:
    """(name, queue) of the largest sources, at most ``QUEUES - 1`` rows, and the weight of each named queue."""
    largest = (docs.groupBy(F.col(source).cast("string").alias("name")).count()
               .orderBy(F.desc("count"), F.asc_nulls_first("name")).limit(QUEUES - 1).select(F.xxhash64("name").alias("key"), "name").collect())
    numbers = docs.sparkSession.createDataFrame([(r.key, k) for k, r in enumerate(largest)], "key long, queue int")
    return numbers, {k: float(targets[r.name]) for k, r in enumerate(largest) if targets and r.name in targets}


def id_bytes(path: str, end: int) -> int:
    """Bytes that an id takes while it is stored and shuffled."""
    return 2 if max(tokenizer(path).get_vocab_size(), end + 1) <= 1 << 16 else 4


def tokenised_runs(docs: DataFrame, path: str, end: int = END, source: str = "source", numbers: DataFrame | None = None) -> DataFrame:
    """Runs of at most ``STRETCH`` ids with their place in the task's part of the queue; one pass over the texts."""
    stored = f"<u{id_bytes(path, end)}"
    own = F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", F.xxhash64(own).alias("key"))
    rows = rows.join(F.broadcast(numbers), "key", "left") if numbers is not None else rows.withColumn("queue", F.lit(0))  # under QUEUES rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, given = vocabulary(path), TaskContext.get().partitionId(), [0] * QUEUES
        for batch in batches:
            texts = text_column(batch)
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            queues = batch.column("queue").fill_null(QUEUES - 1).to_pylist()
            for low, high in row_chunks(texts, 2 << 20):
                tokens, bounds = known.encode(texts.slice(low, high - low))
                rows = []
                for k in range(low, high):
                    own = np.append(tokens[bounds[k - low]:bounds[k - low + 1]], np.uint32(end)).astype(stored)
                    q = queues[k]
                    for start in range(0, len(own), STRETCH):
                        rows.append((ids[k], q, part, given[q] + start, start, len(own), own[start:start + STRETCH].tobytes()))
                    given[q] += len(own)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in _RUN.split(", ")])

    return rows.select("doc_id", "text", "queue").mapInArrow(tidy(run), _RUN)


def served_before(positions: np.ndarray, totals: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Tokens that each queue has given (columns) among the first tokens of the stream up to each position (rows).

    Token j of a queue has the virtual time (j + 1/2) / weight; the stream takes tokens by that time, then by queue.
    """
    def given(v: np.ndarray) -> np.ndarray:
        return np.minimum(totals, np.floor(weights * v[:, None] + 0.5).astype(np.int64))

    positions = np.asarray(positions, dtype=np.int64)
    low, high = np.zeros(len(positions)), np.full(len(positions), ((totals + 1) / weights).max())
    while True:  # until no number lies between them, or all positions are met
        middle = low + (high - low) / 2
        below = given(middle).sum(axis=1) <= positions
        if ((middle <= low) | (middle >= high)).all():
            break
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    out = given(low)
    rest = given(high) - out  # tokens of one virtual time, as far as numbers can tell
    order = np.lexsort((np.broadcast_to(np.arange(len(totals)), out.shape), (out + 0.5) / weights), axis=1)
    ranked = np.take_along_axis(rest, order, axis=1)
    before = np.cumsum(ranked, axis=1) - ranked
    taken = np.clip((positions - out.sum(axis=1))[:, None] - before, 0, ranked)
    np.put_along_axis(rest, order, taken, axis=1)
    return out + rest


def fill_windows(quanta: np.ndarray, turn: int = TURN) -> np.ndarray:
    """Tokens that each queue gives to each window (windows x queues), by deficit round-robin.

    ``quanta`` holds what each window adds to the queues' credits; a row's sum is the room of its window. Credits add up to
    nothing after each window, and to nothing for each queue after the last one.
    """
    out = np.zeros_like(quanta)
    left, credit, number = quanta.sum(axis=0), np.zeros(quanta.shape[1], dtype=np.int64), np.arange(quanta.shape[1])
    for w, quantum in enumerate(quanta):
        credit += quantum
        serve = np.minimum(np.where((credit >= turn) | (credit >= left), np.maximum(credit, 0), 0), left)
        free = int(quantum.sum() - serve.sum())
        if free < 0:  # credits of earlier windows come due together; the smallest ones wait
            for q in np.lexsort((number, credit)):
                back = min(-free, int(serve[q]))
                serve[q] -= back
                free += back
                if not free:
                    break
        elif free:
            for least in (turn, int(quantum.sum())):  # short turns first; whole windows only if nothing else is left
                for q in np.lexsort((np.roll(number, w), serve - credit)):  # equal credits take turns
                    more = min(free, int(left[q] - serve[q]), max(least, int(credit[q] - serve[q])))
                    serve[q] += more
                    free -= more
                    if not free:
                        break
                if not free:
                    break
        out[w] = serve
        left -= serve
        credit -= serve
    return out


def _block_turns(block: int, totals: np.ndarray, weights: np.ndarray, capacity: int) -> pa.RecordBatch:
    """The turns of one block: queue, first token in the queue, number of tokens, sequence and place in it."""
    total, size = int(totals.sum()), BLOCK * capacity
    low, high = block * size, min((block + 1) * size, total)
    edges = served_before(np.unique(np.append(np.arange(low, high, capacity), high)), totals, weights)
    filled = fill_windows(np.diff(edges, axis=0))
    before = edges[0]
    starts = before + np.cumsum(filled, axis=0) - filled
    offsets = np.cumsum(filled, axis=1) - filled
    w, q = np.nonzero(filled)
    return pa.RecordBatch.from_arrays(
        [pa.array(q, pa.int32()), pa.array(starts[w, q]), pa.array(filled[w, q]), pa.array(low // capacity + w), pa.array(offsets[w, q])],
        names=["queue", "first", "amount", "window", "place"])


def tail_lengths(tail: int) -> list[tuple[int, int]]:
    """(place, length) of the powers of two that make up the last window, largest first."""
    out, place = [], 0
    for bit in reversed(range(tail.bit_length())):
        if tail >> bit & 1:
            out.append((place, 1 << bit))
            place += 1 << bit
    return out


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of two bytes as ids of four."""
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        ids = pa.concat_arrays([batch.column(at).cast(pa.binary())])
        offsets = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset: ids.offset + len(ids) + 1]
        data = np.frombuffer(ids.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]].view("<u2").astype("<u4")
        wide = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(((offsets - offsets[0]) * 2).astype(np.int32)), pa.py_buffer(data)])
        yield batch.set_column(at, "ids", wide)


def pack_mixture(docs: DataFrame, path: str, targets: dict[str, float] | None = None, source: str = "source", end: int = END,
                 capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their ids (``doc_id``, ``queue``, ``start``, ``length``, ``doc_tokens``, ``ids`` as little-endian 32-bit
    numbers) and their ``sequence_id`` and ``offset``. ``targets`` are weights of sources."""
    spark, width = docs.sparkSession, id_bytes(path, end)
    numbers, named = queue_numbers(docs, source, targets) if source in docs.columns else (None, {})
    runs = cut(tokenised_runs(docs, path, end, source, numbers))
    held = cut(runs.groupBy("queue", "part").agg(F.sum(F.length("ids") / width).cast("long").alias("n")))
    base = held.select("queue", "part", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("base"))
    if held.count() <= BROADCAST_PARTS:  # else the runs are shuffled once more
        base = F.broadcast(base)
    sums = {r.queue: r.n for r in held.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # at most QUEUES rows
    totals = np.array([sums.get(q, 0) for q in range(max(sums, default=0) + 1)], dtype=np.int64)
    weights = np.array([named.get(q, min(named.values())) if named else max(float(t), 1.0) for q, t in enumerate(totals)], dtype=np.float64)
    if (weights <= 0).any():
        raise ValueError("target weights must be positive")
    total = int(totals.sum())
    blocks = -(-total // (BLOCK * capacity))

    def turns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                yield _block_turns(block, totals, weights, capacity)

    tasks = max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism))
    turns = spark.range(0, blocks, 1, tasks).mapInArrow(turns_of, "queue int, first long, amount long, window long, place long")
    if total % capacity:  # the last window is several sequences
        last, parts = total // capacity, tail_lengths(total % capacity)
        pieces = F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.lit(n).cast("long").alias("n"), F.lit(k).cast("long").alias("k"))
                           for k, (p, n) in enumerate(parts)])
        low = lambda e: F.greatest("place", e["p"])
        high = lambda e: F.least(F.col("place") + F.col("amount"), e["p"] + e["n"])
        whole = turns.where(F.col("window") < last)
        split = turns.where(F.col("window") == last).select("*", F.explode(pieces).alias("e")).where(low(F.col("e")) < high(F.col("e")))
        e = F.col("e")
        split = split.select("queue", (F.col("first") + low(e) - F.col("place")).alias("first"), (high(e) - low(e)).alias("amount"),
                             (F.col("window") + e["k"]).alias("window"), (low(e) - e["p"]).alias("place"))
        turns = whole.unionByName(split)

    def stretches(df: DataFrame, low: str, size) -> DataFrame:
        first = F.floor(F.col(low) / STRETCH)
        return df.withColumn("first_stretch", first).withColumn("stretch", F.explode(F.sequence(first, F.floor((F.col(low) + size - 1) / STRETCH))))

    placed = runs.join(base, ["queue", "part"]).withColumn("head", F.col("base") + F.col("at")).withColumn("n", F.length("ids") / width)
    placed = stretches(placed.withColumn("n", F.col("n").cast("long")), "head", F.col("n"))
    given = stretches(turns, "first", F.col("amount")).withColumnRenamed("first_stretch", "turn_stretch")
    low, high = F.greatest("head", "first"), F.least(F.col("head") + F.col("n"), F.col("first") + F.col("amount"))
    # a merge join: the planner cannot know how many turns a task makes from its few block numbers, and would broadcast them
    met = placed.hint("merge").join(given, ["queue", "stretch"]).where((low < high) & (F.col("stretch") == F.greatest("first_stretch", "turn_stretch")))
    length = (high - low).cast("int")
    pieces = met.select(
        "doc_id", "queue", (F.col("start") + low - F.col("head")).alias("start"), length.cast("long").alias("length"), "doc_tokens",
        F.col("ids").substr(((low - F.col("head")) * width + 1).cast("int"), length * width).alias("ids"),
        F.col("window").alias("sequence_id"), (F.col("place") + low - F.col("first")).alias("offset"))
    return pieces if width == 4 else pieces.mapInArrow(tidy(_widened), pieces.schema)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")
