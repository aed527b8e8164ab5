"""Packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

A document's tokens are cut into pieces of at most 4096; whole pieces are sequences of their own, the others are dealt by
hash into shards of about 2000 pieces. Each shard is worked on by several islands, rows of one table that Spark spreads
over the cluster. An island keeps a small population of packings; a crossover injects whole well-filled bins of one parent
into another, removes the bins that hold duplicates, and best-fits the displaced pieces. Between epochs the best packing of
each island migrates to the next island of its shard by a join. The fullest packing of a shard is its result.

Defined results: null and empty texts have one token, the end token; an empty table gives no pieces; repeated rows are
packed as often as they occur; other columns are not read. Packings depend on the data only, not on timing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.llm.memory import tidy
from geoledger.llm.wordarrays import row_chunks, text_column
from geoledger.llm.wordids import vocabulary
from geoledger.session import cut

CAPACITY = 4096
END = 1
SHARD_PIECES = 2000
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
CROSSOVERS = 10
WELL_FILLED = 0.98
TEXT_BYTES = 1 << 19  # of text at a time: word arrays take some 30 times that

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            texts, ids = text_column(batch), batch.column("doc_id").cast(pa.int64())
            for low, high in row_chunks(texts, TEXT_BYTES):
                rows = []
                every, bounds = known.encode(texts.slice(low, high - low))
                for k, doc_id in enumerate(ids.slice(low, high - low).to_pylist()):
                    tokens = np.append(every[bounds[k]:bounds[k + 1]], np.uint32(END)).astype("<u4")
                    for piece, start in enumerate(range(0, len(tokens), CAPACITY)):
                        cut_out = tokens[start:start + CAPACITY]
                        rows.append((doc_id, piece, start, len(cut_out), zlib.crc32(cut_out.tobytes())))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), _PIECE)


class Packing:
    """Bins of item numbers, with their loads."""

    def __init__(self, bins: list[list[int]], loads: list[int]):
        self.bins, self.loads = bins, loads

    @property
    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (mean of squared fill)."""
        return -len(self.bins), sum(x * x for x in self.loads) / max(len(self.loads), 1)

    def best_fit(self, items: list[int], lengths: list[int]) -> None:
        """Put each item where it leaves the least room, or in a new bin."""
        rooms = sorted((CAPACITY - load, k) for k, load in enumerate(self.loads) if load < CAPACITY)
        for item in items:
            at = bisect_left(rooms, (lengths[item], -1))
            if at == len(rooms):
                room, k = CAPACITY, len(self.bins)
                self.bins.append([])
                self.loads.append(0)
            else:
                room, k = rooms.pop(at)
            self.bins[k].append(item)
            self.loads[k] += lengths[item]
            if room > lengths[item]:
                insort(rooms, (room - lengths[item], k))

    def numbers(self, count: int) -> np.ndarray:
        """The bin of each item."""
        out = np.zeros(count, dtype=np.int32)
        for k, items in enumerate(self.bins):
            out[items] = k
        return out

    @classmethod
    def of(cls, numbers: np.ndarray, lengths: list[int]) -> Packing:
        bins: list[list[int]] = [[] for _ in range(int(numbers.max()) + 1 if len(numbers) else 0)]
        for item, k in enumerate(numbers.tolist()):
            bins[k].append(item)
        return cls(bins, [sum(lengths[i] for i in items) for items in bins])


def crossover(mother: Packing, father: Packing, lengths: list[int], random: np.random.Generator) -> Packing:
    """The mother with some well-filled bins of the father; bins with duplicates go, displaced items are best-fitted."""
    well = [k for k, load in enumerate(father.loads) if load >= WELL_FILLED * CAPACITY] or [int(np.argmax(father.loads))]
    taken = random.choice(len(well), size=max(1, len(well) // 4), replace=False)
    injected = [father.bins[well[k]] for k in taken]
    inside = {i for items in injected for i in items}
    bins, loads, displaced = [], [], []
    for items, load in zip(mother.bins, mother.loads):
        if inside.isdisjoint(items):
            bins.append(list(items))
            loads.append(load)
        else:
            displaced += [i for i in items if i not in inside]
    for items in injected:
        bins.append(list(items))
        loads.append(sum(lengths[i] for i in items))
    # the least filled bins are opened as well, so that their items can fill gaps
    order = sorted(range(len(bins)), key=loads.__getitem__)[: max(1, len(bins) // 50)]
    opened = set(order)
    displaced += [i for k in order for i in bins[k]]
    child = Packing([b for k, b in enumerate(bins) if k not in opened], [x for k, x in enumerate(loads) if k not in opened])
    child.best_fit(sorted(displaced, key=lambda i: -lengths[i]), lengths)
    return child


def evolve(lengths: list[int], population: list[Packing], seed: int) -> list[Packing]:
    """``CROSSOVERS`` steps on a population, which is first filled up with perturbed best-fit-decreasing packings."""
    random = np.random.default_rng(seed)
    sizes = np.array(lengths)
    while len(population) < POPULATION:
        noise = random.uniform(1, 1.05 if population else 1 + 1e-9, len(sizes))
        packing = Packing([], [])
        packing.best_fit(np.argsort(-sizes * noise, kind="stable").tolist(), lengths)
        population.append(packing)
    bound = -(-int(sizes.sum()) // CAPACITY)
    for _ in range(CROSSOVERS):
        population.sort(key=lambda p: p.fitness, reverse=True)
        if len(population[0].bins) <= bound or len(lengths) < 2:
            break
        a, b = random.choice(len(population), size=2, replace=False)
        child = crossover(population[min(a, b)], population[max(a, b)], lengths, random)
        if child.fitness > population[-1].fitness:
            population[-1] = child
    population.sort(key=lambda p: p.fitness, reverse=True)
    return population


def _epoch(islands: DataFrame, epoch: int) -> DataFrame:
    """``shard``, ``island``, ``lengths``, ``elite``, ``n_bins``, ``fill`` after one epoch of rows with (maybe) elites in ``layouts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                lengths = row["lengths"]
                population = [Packing.of(np.frombuffer(b, dtype=np.int32), lengths) for b in row["layouts"]]
                seed = (row["shard"] * ISLANDS + row["island"]) * EPOCHS + epoch
                best = evolve(lengths, population, seed)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([lengths], pa.list_(pa.int32())),
                     pa.array([best.numbers(len(lengths)).tobytes()], pa.binary()), pa.array([len(best.bins)], pa.int32()),
                     pa.array([best.fitness[1]], pa.float64())], names=["shard", "island", "lengths", "elite", "n_bins", "fill"])

    return islands.mapInArrow(tidy(run), "shard long, island int, lengths array<int>, elite binary, n_bins int, fill double")


def pack(docs: DataFrame, path: str, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``."""
    pieces = cut(tokenised_pieces(docs, path))
    open_pieces = pieces.where(F.col("length") < CAPACITY)
    shards = max(1, -(-open_pieces.count() // shard_pieces))
    number = F.monotonically_increasing_id()  # over a written table: tells repeated rows apart
    dealt = open_pieces.withColumn("n", number).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n"), F.lit(shards)))
    item = F.struct((-F.col("length")).alias("less"), "doc_id", "piece", "n", "start", "length", "ids_crc32")
    # about shard_pieces rows a group, dealt by a hash of distinct numbers
    members = cut(dealt.groupBy("shard").agg(F.sort_array(F.collect_list(item)).alias("items")))
    lengths = F.transform("items", lambda x: x["length"].cast("int"))
    none = F.array().cast("array<binary>")
    islands = (members.select("shard", lengths.alias("lengths"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
               .repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "island"))
    state = cut(_epoch(islands.withColumn("layouts", none), 0))
    for epoch in range(1, EPOCHS):
        moved = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elite").alias("guest"))
        met = state.join(moved, ["shard", "island"]).select("shard", "island", "lengths", F.array("elite", "guest").alias("layouts"))
        state = cut(_epoch(met, epoch))
    best = state.groupBy("shard").agg(F.max_by("elite", F.struct(-F.col("n_bins"), "fill", -F.col("island"))).alias("elite"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                bins, used, rows = np.frombuffer(row["elite"], dtype=np.int32).tolist(), {}, []
                for item, number in zip(row["items"], bins):
                    rows.append((item["doc_id"], item["piece"], item["start"], item["length"], item["ids_crc32"],
                                 (row["shard"] << 24) | number, used.get(number, 0)))
                    used[number] = used.get(number, 0) + item["length"]
                columns = list(zip(*rows))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = members.join(best, "shard").mapInArrow(tidy(place), _PIECE + ", sequence_id long, offset long")
    whole = pieces.where(F.col("length") == CAPACITY).select("*", (-1 - number).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole)
