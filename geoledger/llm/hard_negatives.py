"""Hard negatives by segment summary filtering.

A component c becomes the whole number floor(256 c); a score is the integer inner product with an anchor. A vector is cut
into segments; a segment's mean m and deviation s (root of the mean square distance from m) bound its share of a score: the
shares of x and y lie within size * (mx * my +- sx * sy). Those bounds are inner products of the summaries, so a block of
anchors meets a block of rows by one small matrix product. Pairs that can still enter a result go on to finer segments, and
what is left is scored exactly; where a level keeps most of its pairs, the next step works on the whole block, which is cheaper
than on single pairs.

The first search gives each anchor its positives, the second its negatives in the window of each positive. A task keeps the
best rows so far of an anchor block, whose worst scores tighten the filter, and a ranking over all tasks follows.

Data flow: rows become blocks where they are read; blocks are dealt to slices, and every anchor block visits every slice by an
equi-join on the slice's number. Nothing is broadcast; a task holds one slice's blocks on the JVM side and one pair of blocks in
Python. Labels do not take part in the distribution, so a label with a third of the rows is like any other.

Defined results: rows with a null label, a null vector, or null or non-finite entries take no part, nor do vectors of another
length than most have, nor entries so large that 100 times a score might exceed a long (2**25 at 64 dimensions, after
scaling). Rows with a null id have no ties to win: they come after all ids. Rows that repeat an id count one by one; an anchor's positives
and negatives never carry its own id. Anchors without positives and positives without negatives give no rows. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoledger.llm.memory import tidy
from geoledger.llm.vectors import common_length, matrix
from geoledger.session import cut

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # percent of the positive's score
ROWS = 4096  # of a block of rows
ANCHORS = 512  # of a block of anchors
FIRST_ROWS = 256  # of a block are searched first, to have limits for the others
SLICE_ROWS = 131_072
LEVELS = (4, 16, 32)  # segments
DENSE = 0.05  # share of pairs left from which a whole block is scored

NO_ID = np.iinfo(np.int64).max


def usable_rows(df: DataFrame, dimension: int) -> DataFrame:
    """Blocks of usable rows: ids and labels as 64-bit numbers, vectors as 32-bit ones, and how many there are."""
    limit = (2.0**56 / max(dimension, 1)) ** 0.5 / SCALE - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = matrix(batch, dimension, limit)
            labels = batch.column("label")
            known = np.flatnonzero(labels.is_valid().to_numpy(zero_copy_only=False)[rows])
            rows, values = rows[known], np.floor(SCALE * values[known]).astype("<i4")
            ids = batch.column("vec_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()[rows]
            label = labels.cast(pa.int64()).fill_null(0).to_numpy()[rows]
            label = np.where((ids != NO_ID) & (ids % 7 == 0), (label + 1) % 10, label)
            for low in range(0, len(rows), ROWS):
                part = slice(low, low + ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(ids[part])], pa.int32()), *(pa.array([np.ascontiguousarray(a[part]).tobytes()], pa.binary()) for a in (ids, label, values))],
                    names=["n", "ids", "labels", "vectors"])

    return df.select("vec_id", "label", "embedding").mapInArrow(tidy(run), "n int, ids binary, labels binary, vectors binary")


def anchors_of(blocks: DataFrame, dimension: int) -> DataFrame:
    """(anchor_id, label, vector) of the rows whose id is a multiple of ``ANCHOR_EVERY``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids, labels = np.frombuffer(b["ids"], dtype=np.int64), np.frombuffer(b["labels"], dtype=np.int64)
                vectors = np.frombuffer(b["vectors"], dtype="<i4").reshape(-1, dimension)
                at = np.flatnonzero((ids != NO_ID) & (ids % ANCHOR_EVERY == 0))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(labels[at]), pa.array([vectors[k].tobytes() for k in at], pa.binary())],
                                                     names=["anchor_id", "label", "vector"])

    return blocks.select("ids", "labels", "vectors").mapInArrow(tidy(run), "anchor_id long, label long, vector binary")


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments, each times the root of the segment's size; single entries are their own means."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    sizes = np.diff(edges)
    means = np.add.reduceat(x, edges[:-1], axis=1) / sizes
    away = x - np.repeat(means, sizes, axis=1)
    return means * np.sqrt(sizes), np.sqrt(np.add.reduceat(away * away, edges[:-1], axis=1))


class Side:
    """Vectors of one block with their summaries at every level."""

    def __init__(self, vectors: np.ndarray):
        self.exact = vectors.astype(np.float64)
        self.levels = [summaries(self.exact, s) for s in LEVELS if s < vectors.shape[1]]
        # scores below 2**53 are exact in doubles; others are summed as whole numbers
        self.largest = float(np.abs(self.exact).max(initial=0))
        self.whole = vectors.astype(np.int64)

    def part(self, rows: slice) -> Side:
        out = object.__new__(Side)
        out.exact, out.whole, out.largest = self.exact[rows], self.whole[rows], self.largest
        out.levels = [(m[rows], d[rows]) for m, d in self.levels]
        return out


def _products(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (i, j), in bounded pieces."""
    out = np.empty(len(i), dtype=a.dtype)
    for low in range(0, len(i), 1 << 16):
        part = slice(low, low + (1 << 16))
        out[part] = (a[i[part]] * x[j[part]]).sum(axis=1)
    return out


def close_pairs(anchors: Side, rows: Side, least: np.ndarray, most: np.ndarray, open_pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) among ``open_pairs`` with ``least <= score <= most`` of the anchor, and their exact scores.

    Level by level the bounds of the scores rule pairs out. Bounds are widened by what rounding may take from them.
    """
    left, pairs = open_pairs, None
    slack = 1e-9 * anchors.exact.shape[1] * (anchors.largest + 1) * (rows.largest + 1)
    for (ma, da), (mx, dx) in zip(anchors.levels, rows.levels):
        if pairs is None:
            middle, spread = ma @ mx.T, da @ dx.T
            left = left & (middle + spread + slack >= least[:, None]) & (middle - spread - slack <= most[:, None])
            if left.mean() < DENSE:
                pairs = np.nonzero(left)
        else:
            i, j = pairs
            middle, spread = _products(ma, mx, i, j), _products(da, dx, i, j)
            kept = (middle + spread + slack >= least[i]) & (middle - spread - slack <= most[i])
            pairs = i[kept], j[kept]
    small = anchors.exact.shape[1] * anchors.largest * rows.largest < 2.0**53
    a, x = (anchors.exact, rows.exact) if small else (anchors.whole, rows.whole)
    if pairs is None:
        scores = a @ x.T
        i, j = np.nonzero(left & (scores >= least[:, None]) & (scores <= most[:, None]))
        return i, j, scores[i, j].astype(np.int64)
    i, j = pairs
    scores = _products(a, x, i, j)
    kept = (scores >= least[i]) & (scores <= most[i])
    return i[kept], j[kept], scores[kept].astype(np.int64)


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` entries of each group, by falling score and rising id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, dtype=int)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[rank < count]


class Best:
    """The best rows so far of the wants (anchor rows or windows) of one anchor block."""

    def __init__(self, wants: int, count: int, floor: np.ndarray):
        self.count, self.floor = count, floor
        self.want, self.score, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.least = floor.copy()

    def add(self, want: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(want):
            return
        want, score, ids = np.append(self.want, want), np.append(self.score, score), np.append(self.ids, ids)
        kept = best(want, score, ids, self.count)
        self.want, self.score, self.ids = want[kept], score[kept], ids[kept]
        full = np.bincount(self.want, minlength=len(self.floor)) >= self.count
        worst = np.full(len(self.floor), np.iinfo(np.int64).max)
        np.minimum.at(worst, self.want, self.score)
        self.least = np.where(full, np.maximum(worst, self.floor), self.floor)


def search(blocks: DataFrame, wanted: DataFrame, dimension: int, count: int, same_label: bool) -> DataFrame:
    """(anchor, k, score, other_id): the best ``count`` rows of every task for each want, same or different label.

    ``wanted`` has blocks of anchors: ``slice``, ``block``, ``anchors`` (numbers), ``anchor_ids``, ``anchor_labels``,
    ``anchor_vectors`` and, per anchor, the same number of windows ``lows``/``highs``; ``k`` numbers an anchor's windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if current is None or row["block"] != current["block"]:
                    if state is not None:
                        yield from _flush(current, state)
                    current = {"block": row["block"], "anchors": np.frombuffer(row["anchors"], dtype=np.int64)}
                    ids = np.frombuffer(row["anchor_ids"], dtype=np.int64)
                    labels = np.frombuffer(row["anchor_labels"], dtype=np.int64)
                    side = Side(np.frombuffer(row["anchor_vectors"], dtype="<i4").reshape(-1, dimension))
                    lows = np.frombuffer(row["lows"], dtype=np.int64)
                    highs = np.frombuffer(row["highs"], dtype=np.int64).reshape(len(ids), -1)
                    current["windows"] = windows = highs.shape[1]
                    state = Best(len(lows), count, lows.copy())
                others = np.frombuffer(row["ids"], dtype=np.int64)
                their = np.frombuffer(row["labels"], dtype=np.int64)
                block = Side(np.frombuffer(row["vectors"], dtype="<i4").reshape(-1, dimension))
                for part in (slice(0, FIRST_ROWS), slice(FIRST_ROWS, len(others))):
                    if not len(others[part]):
                        continue
                    allowed = (labels[:, None] == their[part][None]) == same_label
                    allowed &= ids[:, None] != others[part][None]
                    floors = state.least.reshape(len(ids), windows)
                    i, j, scores = close_pairs(side, block.part(part), floors.min(axis=1), highs.max(axis=1), allowed)
                    for k in range(windows):
                        fits = (scores >= floors[i, k]) & (scores <= highs[i, k])
                        state.add(i[fits] * windows + k, scores[fits], others[part][j[fits]])
        if state is not None:
            yield from _flush(current, state)

    def _flush(current: dict, state: Best) -> Iterator[pa.RecordBatch]:
        if len(state.want):
            yield pa.RecordBatch.from_arrays(
                [pa.array(current["anchors"][state.want // current["windows"]]), pa.array((state.want % current["windows"]).astype(np.int32)),
                 pa.array(state.score), pa.array(state.ids)], names=["anchor", "k", "score", "other_id"])

    met = wanted.hint("merge").join(blocks, "slice")  # anchor blocks come one after another, each with all blocks of the slice
    columns = ["block", "anchors", "anchor_ids", "anchor_labels", "anchor_vectors", "lows", "highs", "ids", "labels", "vectors"]
    return met.select(*columns).mapInArrow(tidy(run), "anchor long, k int, score long, other_id long")


def _blocks_of_anchors(anchors: DataFrame, slices: int, dimension: int) -> DataFrame:
    """Anchors (anchor, anchor_id, label, vector, lows, highs) as blocks, one copy a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ANCHORS):
                part = batch.slice(low, ANCHORS).to_pydict()
                fields = [np.array(part[c], dtype=np.int64).tobytes() for c in ("anchor", "anchor_id", "label")]
                fields += [b"".join(part["vector"]), np.array(part["lows"], dtype=np.int64).tobytes(), np.array(part["highs"], dtype=np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([part["anchor"][0]], pa.int64()), *(pa.array([f], pa.binary()) for f in fields)],
                                                 names=["block", "anchors", "anchor_ids", "anchor_labels", "anchor_vectors", "lows", "highs"])

    packed = anchors.select("anchor", "anchor_id", "label", "vector", "lows", "highs").mapInArrow(
        tidy(run), "block long, anchors binary, anchor_ids binary, anchor_labels binary, anchor_vectors binary, lows binary, highs binary")
    return packed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))


def _ranked(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(df: DataFrame) -> DataFrame:
    """The hard negatives of every anchor and positive."""
    spark = df.sparkSession
    dimension = common_length(df)
    blocks = cut(usable_rows(df, dimension))
    rows = blocks.agg(F.sum("n")).first()[0] or 0
    if not rows:
        return spark.createDataFrame([], _OUT)
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(-(-rows // SLICE_ROWS), min(cores, -(-rows // ROWS)))
    dealt = blocks.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int"))
    tasks = -(-rows // (ANCHOR_EVERY * ANCHORS))
    anchors = cut(anchors_of(blocks, dimension).coalesce(int(tasks)).withColumn("anchor", F.monotonically_increasing_id()))

    everything = F.array(F.lit(-(1 << 62)).cast("long")), F.array(F.lit(1 << 62).cast("long"))
    wanted = _blocks_of_anchors(anchors.withColumn("lows", everything[0]).withColumn("highs", everything[1]), slices, dimension)
    positives = cut(_ranked(search(dealt, wanted, dimension, POSITIVES, True), ["anchor"], POSITIVES).select(
        "anchor", (F.col("rank") - 1).alias("k"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # LOW * positive <= 100 * negative <= HIGH * positive, as whole limits; missing positives get an empty window
    limits = positives.select("anchor", F.struct("k", F.ceil(F.col("positive_score") * LOW / F.lit(100).cast("decimal(3,0)")).cast("long").alias("low"),
                                                 F.floor(F.col("positive_score") * HIGH / F.lit(100).cast("decimal(3,0)")).cast("long").alias("high")).alias("w"))
    windows = limits.groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("w"))  # POSITIVES entries at most
    empty = F.array_repeat(F.lit(1 << 62).cast("long"), F.lit(POSITIVES) - F.size("w")), F.array_repeat(F.lit(-(1 << 62)).cast("long"), F.lit(POSITIVES) - F.size("w"))
    narrowed = cut(anchors.join(windows, "anchor").withColumn("lows", F.concat(F.col("w.low"), empty[0])).withColumn("highs", F.concat(F.col("w.high"), empty[1])).drop("w"))
    wanted = _blocks_of_anchors(narrowed.coalesce(int(tasks)), slices, dimension)
    negatives = _ranked(search(dealt, wanted, dimension, NEGATIVES, False), ["anchor", "k"], NEGATIVES)
    absent = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    named = negatives.withColumnRenamed("other_id", "negative_id").withColumnRenamed("score", "negative_score").join(positives, ["anchor", "k"])
    return named.join(anchors.select("anchor", "anchor_id"), "anchor").select(
        "anchor_id", absent("positive_id"), "rank", absent("negative_id"), "positive_score", "negative_score")
