"""Near-duplicate documents by order MinHash with banded alignment.

The five-word windows of a text, each labelled with its number among equal ones, are hashed by several functions. For each
function a text keeps the two smallest labelled windows in the order in which they stand in the text; texts that agree in
such an ordered pair are candidates, so texts with the same windows in another order rarely are. A candidate is a link if
the edit distance of the word sequences, found by alignment in a band, is at most a fifth of the longer one.

Skew: exact copies are reduced to one representative, told apart by a digest of its words, before anything else. In buckets of more
than one block of ``BLOCK`` texts (fewer where texts are long) each block is then reduced to cliques: leaders are taken in rising
length, and a text within a fifteenth of the leader's length (a third of the limit) joins it. Edit distance is a metric and the leader is the shortest, so all
members of a leader are linked to each other, which needs neither tests nor more than one row a member. A text is dealt to a block
in the largest of its buckets only. From then on a clique is one unit with its members' keys, and a bucket of n close texts holds
about n / 256 units.

The units of a bucket are dealt over blocks and every two blocks form a group, so no task holds more than two blocks. Two texts
outside cliques are tested only in the first bucket they share, which their keys tell without a shuffle; a batch of groups returns how
many links each has there and a spanning forest of them. For a clique the distance of the leaders and the radii tell whether all
its members are linked to those of the other unit, or none; only the pairs left over are tested member by member. Lengths and word
histograms settle many tests, the others are aligned by bit vectors, thousands at a time. Classes are the connected components, found by jobs over tables.

Links are the similar pairs that share a key, belong to one clique, or belong to cliques that share a key.

Defined results: a text with fewer than five words is one window; null and texts without words form classes of their own;
rows that repeat a ``doc_id`` are told apart by their texts; a class is named by its smallest id that is not null (null if it has
none), so classes that share such an id share the name; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.llm.alignment import FAR, bounds
from geoledger.llm.memory import tidy
from geoledger.llm.names import spare_name
from geoledger.llm.wordarrays import Words, mix, row_chunks, text_column
from geoledger.session import cut

SHINGLE = 5
SKETCHES = 16
SIMILARITY = 0.8
BLOCK = 256
BLOCK_WORDS = 1 << 20
BINS = 256
PAIRS = 512
BROADCAST_IDS = 1_000_000

_ODD = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)
_OCCURRENCE = np.uint64(0xC2B2AE3D27D4EB4F)
_JOIN = np.uint64(0x165667B19E3779F9)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def order_sketches(words: Words) -> np.ndarray:
    """One row of ``SKETCHES`` keys for each text with words (in the order of those texts)."""
    first, hashes = words.windows(SHINGLE)
    text = words.text_of_word()[first] if len(first) else first
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):  # the whole text as one window
        whole = mix(sequence_hash(words, short))
        text, hashes = np.concatenate([text, short]), np.concatenate([hashes, whole])
        order = np.argsort(text, kind="stable")
        text, hashes = text[order], hashes[order]
    if not len(text):
        return np.zeros((0, SKETCHES), dtype=np.uint64)
    order = np.lexsort((hashes, text))  # stable: equal windows stay in text order
    t, h = text[order], hashes[order]
    new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))
    number = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    labelled = np.empty_like(hashes)
    labelled[order] = mix(h + number.astype(np.uint64) * _OCCURRENCE)
    heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    sizes = np.diff(np.append(heads, len(text)))
    out = np.empty((len(heads), SKETCHES), dtype=np.uint64)
    single = sizes == 1
    for k in range(SKETCHES):
        values = labelled * _ODD[k]
        one = np.flatnonzero(values == np.repeat(np.minimum.reduceat(values, heads), sizes))
        values[one] = _TOP
        two = one.copy()
        found = np.flatnonzero(values == np.repeat(np.minimum.reduceat(values, heads), sizes))
        two[~single] = found[np.searchsorted(found, heads[~single])]
        before, after = labelled[np.minimum(one, two)], labelled[np.maximum(one, two)]
        out[:, k] = mix(before * _JOIN + after + np.uint64(k))
    return out


def sequence_hash(words: Words, texts: np.ndarray) -> np.ndarray:
    """A hash of the whole word sequence of each of some texts."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for k, t in enumerate(texts.tolist()):
        for value in words.hashes[words.bounds[t]:words.bounds[t + 1]]:
            out[k:k + 1] = out[k:k + 1] * _JOIN + value
    return out


def _sequence_digest(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    place = (np.arange(len(words.hashes)) - np.repeat(words.bounds[:-1], words.counts)).astype(np.uint64)
    sums = []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A68DF):
        total = np.zeros(len(words.hashes) + 1, dtype=np.uint64)
        np.cumsum(mix(words.hashes + place * np.uint64(salt | 1)), out=total[1:])
        sums.append((total[words.bounds[1:]] - total[words.bounds[:-1]]).view(np.int64))
    return sums[0], sums[1]


def _digests(words: Words) -> pa.Array:
    """16 bytes that stand for each text's word sequence."""
    both = np.stack(_sequence_digest(words), axis=1)
    return pa.array([row.tobytes() for row in both], pa.binary())


def sketch_table(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text), ``rep`` (a digest of its words), ``n_words``, ``keys``; written, one pass over the texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            for low, high in row_chunks(texts):
                words = Words(texts.slice(low, high - low))
                keys = iter(order_sketches(words).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), batch.column("mark").slice(low, high - low), _digests(words), pa.array(words.counts),
                     pa.array([next(keys) if n else None for n in words.counts.tolist()], pa.list_(pa.int64()))],
                    names=["doc_id", "mark", "rep", "n_words", "keys"])

    return cut(docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
               .mapInArrow(tidy(run), f"doc_id {kind}, mark long, rep binary, n_words long, keys array<long>"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _word_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rep`` and its word hashes (32 bits each) for the representatives ``rep``, ``id`` in ``wanted``; written."""
    ids = _few(cut(wanted.select(F.col("id").alias("__id")).distinct()))
    reps = _few(cut(wanted.select("rep").distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            for low, high in row_chunks(texts):
                words = Words(texts.slice(low, high - low))
                short = words.hashes.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [_digests(words),
                     pa.array([short[a:b].tobytes() for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())], pa.binary())],
                    names=["rep", "words"])

    chosen = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    return cut(chosen.mapInArrow(tidy(run), "rep binary, words binary").join(reps, "rep", "left_semi")
               .groupBy("rep").agg(F.max("words").alias("words")))


_GROUP = ("k", "key", "p", "q")


def _whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = _GROUP) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches that end where a group ends, and the borders of their groups; rows come sorted by group."""
    held = None
    for batch in batches:
        batch = batch if held is None else pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        starts = [0, *(np.flatnonzero(new) + 1).tolist()]
        held = batch.slice(starts[-1])
        if starts[-1]:
            yield batch.slice(0, starts[-1]), starts
    if held is not None and held.num_rows:
        yield held, [0, held.num_rows]


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _borders(starts: list[int], end: int) -> Iterator[tuple[int, int]]:
    return zip(starts, starts[1:] + [end] * (starts[-1] < end))


class _Units:
    """Sizes of the units of a batch, and how far apart the leaders of two units may be."""

    def __init__(self, batch: pa.RecordBatch, share: float):
        self.n, self.members, self.radius, self.longest = (batch.column(c).to_numpy() for c in ("n_words", "members", "radius", "longest"))
        self.keys, self.share = _numbers(batch.column("keys"), SKETCHES), share

    def limit(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """If leaders are farther apart, no member of one unit is linked to one of the other."""
        return (self.share * np.maximum(self.longest[i], self.longest[j]) + 1e-9).astype(np.int64) + self.radius[i] + self.radius[j]

    def all_linked(self, x: int, y: int, distance: int) -> bool:
        return distance + self.radius[x] + self.radius[y] <= int(self.share * max(self.n[x], self.n[y]) + 1e-9)

    def single(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.members[i] == 1) & (self.members[j] == 1)


def _untested(group: pa.RecordBatch, units: _Units, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the group that begins at row ``at`` whose lengths allow a link, of single texts only those that share no earlier
    bucket; with two blocks only pairs across."""
    n, (k, p, q) = group.num_rows, (group.column(c)[0].as_py() for c in ("k", "p", "q"))
    split = n if p == q else int(np.searchsorted(group.column("side").to_numpy(), 1))
    for low in range(0, split, 64):
        mine = at + np.arange(low, min(low + 64, split))
        others = at + np.arange(low + 1 if p == q else split, n)
        left = mine[:, None]
        fits = (np.abs(units.n[left] - units.n[others]) <= units.limit(left, others)) & (left < others)
        earlier = np.zeros(fits.shape, dtype=bool)
        for e in range(k):
            earlier |= units.keys[left, e] == units.keys[others, e]
        i, j = np.nonzero(fits & ~(earlier & units.single(left, others)))
        yield mine[i], others[j]


def _histograms(words: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.bincount(w % np.uint32(BINS), minlength=BINS) for w in words]).astype(np.int32)


def _possible(sizes: np.ndarray, bins: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether the words that the pairs have in common allow distances within the limit."""
    possible = np.zeros(len(i), dtype=bool)
    for low in range(0, len(i), PAIRS):
        a, b = i[low:low + PAIRS], j[low:low + PAIRS]
        common = np.minimum(bins[a], bins[b]).sum(axis=1)  # no pair has more words in common
        possible[low:low + PAIRS] = np.maximum(sizes[a], sizes[b]) - common <= limit[low:low + PAIRS]
    return possible


def _measured(words: list[np.ndarray], bins: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Bounds of the distances of pairs, ``FAR`` beyond the limit."""
    found = np.full(len(i), FAR, dtype=np.int64)
    rest = np.flatnonzero(_possible(np.array([len(w) for w in words]), bins, i, j, limit))
    found[rest] = bounds([(words[a], words[b]) for a, b in zip(i[rest].tolist(), j[rest].tolist())], limit[rest].tolist())
    return found


class _Waiting:
    """Pairs of rows of one batch, tested many at a time."""

    def __init__(self, texts: list[np.ndarray]):
        self.texts, self.parts, self.n = texts, [], 0

    def add(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> bool:
        """Whether it is time to test."""
        self.parts.append((i, j, limit))
        self.n += len(i)
        return self.n >= 16 * PAIRS

    def linked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The waiting pairs within their limits, with their distances; none waits afterwards."""
        if not self.n:
            self.parts = []
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        i, j, limit = (np.concatenate(c) for c in zip(*self.parts))
        distances = bounds([(self.texts[x], self.texts[y]) for x, y in zip(i.tolist(), j.tolist())], limit.tolist())
        near, self.parts, self.n = distances < FAR, [], 0
        return i[near], j[near], distances[near]


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs that connect what all ``pairs`` connect, without a circle."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = above[x]
        return x

    out = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _members(reps: DataFrame) -> DataFrame:
    return reps.select("rep", "n_words", F.posexplode("keys").alias("k", "key"))


def _blocks() -> F.Column:
    return F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_WORDS)).cast("int")


def _cliques(docs: DataFrame, reps: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """``unit`` (the leader), ``rep``, ``off`` (a bound of the distance between them) of the texts of large buckets, and their words;
    written. A text alone is no clique."""
    large = cut(_members(reps).groupBy("k", "key").agg(F.count("*").alias("n"), F.sum("n_words").alias("total"))
                .withColumn("g", _blocks()).where("g > 1 AND n > 2"))
    homes = cut(_members(reps).join(large, ["k", "key"]).groupBy("rep", "n_words").agg(F.max(F.struct("n", "k", "key", "g")).alias("h"))
                .selectExpr("rep", "n_words", "h.k", "h.key", "cast(pmod(xxhash64(rep), h.g) AS int) AS p").withColumn("q", F.col("p")))
    words = _word_table(docs, homes.join(reps.select("rep", "id"), "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_groups(batches):
            names, sizes = batch.column("rep"), batch.column("n_words").to_numpy()
            texts = [np.frombuffer(x, dtype=np.uint32) for x in batch.column("words").to_pylist()]
            for low, high in _borders(starts, batch.num_rows):
                bins, left = _histograms(texts[low:high]), np.arange(high - low)
                while len(left) > 1:
                    head, others = left[:1], left[1:]
                    radius = int(share / 3 * sizes[low + head[0]] + 1e-9)  # so leaders as close as members settle their cliques
                    close = others[sizes[low + others] - sizes[low + head[0]] <= radius]
                    off = _measured(texts[low:high], bins, np.repeat(head, len(close)), close, np.full(len(close), radius))
                    joined = close[off < FAR]
                    if len(joined):
                        rows = np.append(head, joined)
                        yield pa.RecordBatch.from_arrays(
                            [names.take(pa.array(np.full(len(rows), low + head[0]))), names.take(pa.array(low + rows)), pa.array(np.append(0, off[off < FAR]))],
                            names=["unit", "rep", "off"])
                    left = others[~np.isin(others, joined)]

    dealt = homes.join(words, "rep").select(*_GROUP, "rep", "n_words", "words").repartition(*_GROUP).sortWithinPartitions(*_GROUP, "n_words", "rep")
    return cut(dealt.mapInArrow(tidy(run), "unit binary, rep binary, off long")), words


_UNIT = ("rep", "n_words", "members", "radius", "longest", "keys")
_UNIT_TYPES = "rep binary, n_words long, members long, radius long, longest long, keys array<long>"


def _groups_to_test(reps: DataFrame, cliques: DataFrame, units: DataFrame, share: float) -> DataFrame:
    """Groups of at most two blocks of a bucket: ``k``, ``key``, ``p``, ``q``, ``side`` and the units with a pair to be tested there; written."""
    own = _members(reps).join(cliques.select("rep", "unit"), "rep", "left")
    found = cut(own.where("unit IS NULL").select("k", "key", "rep").unionByName(
        own.where("unit IS NOT NULL").select("k", "key", F.col("unit").alias("rep")).distinct()))
    sized = found.join(units.select("rep", "n_words"), "rep")
    sizes = cut(sized.groupBy("k", "key").agg(F.count("*").alias("n"), F.sum("n_words").alias("total")).where("n > 1"))
    placed = (found.join(sizes, ["k", "key"]).withColumn("g", _blocks()).withColumn("mine", F.pmod(F.xxhash64("rep"), "g").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
              .select("k", "key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"),
                      (F.col("mine") > F.col("other")).cast("int").alias("side"), "rep").join(units, "rep").select(*_GROUP, "side", *_UNIT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_groups(batches):
            sized, wanted = _Units(batch, share), np.zeros(batch.num_rows, dtype=bool)
            for low, high in _borders(starts, batch.num_rows):
                if high - low > 1:
                    for i, j in _untested(batch.slice(low, high - low), sized, low):
                        wanted[i] = wanted[j] = True
            if wanted.any():
                yield batch.filter(pa.array(wanted))

    dealt = placed.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "side")
    return cut(dealt.mapInArrow(tidy(run), f"k int, key long, p int, q int, side int, {_UNIT_TYPES}"))


_FOREST, _DEGREE, _ALL, _SOME = range(4)


def _linked_groups(groups: DataFrame, words: DataFrame, share: float) -> DataFrame:
    """``a``, ``b``, ``kind``, ``n``; written. For single texts the links of a spanning forest of each batch of groups, and for each text ``a``
    its number ``n`` of links there; for pairs with a clique whether all members are linked, or some may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_groups(batches):
            units, ids = _Units(batch, share), batch.column("rep")
            texts = [np.frombuffer(x, dtype=np.uint32) for x in batch.column("words").to_pylist()]
            names, sizes = ids.to_pylist(), np.array([len(t) for t in texts])
            first: dict = {}
            row = np.array([first.setdefault(name, x) for x, name in enumerate(names)])  # one row stands for a unit, in whatever groups it is
            forests: list[tuple[int, int]] = []
            waiting = _Waiting(texts)
            met: dict[tuple[int, int], int] = {}
            counts = np.zeros(len(names), dtype=np.int64)

            def settle() -> None:  # links so far are counted and reduced to a forest
                i, j, distances = waiting.linked()
                alone = units.single(i, j)
                x, y = row[i[alone]], row[j[alone]]
                np.add.at(counts, np.concatenate([x, y]), 1)
                forests[:] = _forest(forests + list(zip(x.tolist(), y.tolist())))
                for x, y, distance in zip(*(c[~alone].tolist() for c in (i, j, distances))):
                    pair = (int(row[x]), int(row[y])) if names[x] < names[y] else (int(row[y]), int(row[x]))
                    met[pair] = min(met.get(pair, _SOME), _ALL if units.all_linked(x, y, distance) else _SOME)

            for low, high in _borders(starts, batch.num_rows):
                if high - low < 2:
                    continue
                bins = _histograms(texts[low:high])
                for i, j in _untested(batch.slice(low, high - low), units, low):
                    limit = units.limit(i, j)
                    possible = _possible(sizes[low:high], bins, i - low, j - low, limit)
                    if waiting.add(i[possible], j[possible], limit[possible]):
                        settle()
            settle()
            degree = {x: int(counts[x]) for x in np.flatnonzero(counts).tolist()}
            out = ([(a, b, _FOREST, None) for a, b in forests] + [(a, None, _DEGREE, n) for a, n in degree.items()]
                   + [(a, b, kind, None) for (a, b), kind in met.items()])
            if out:
                one, two, kinds, n = (pa.array(c, pa.int64()) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([ids.take(one), ids.take(two), kinds, n], names=["a", "b", "kind", "n"])

    met = groups.join(words, "rep").select(*_GROUP, "side", *_UNIT, "words")
    dealt = met.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "side")
    return cut(dealt.mapInArrow(tidy(run), "a binary, b binary, kind long, n long"))


def _linked_members(pairs: DataFrame, cliques: DataFrame, units: DataFrame, words: DataFrame, share: float) -> DataFrame:
    """For pairs ``a``, ``b`` of units: the pairs with a link (``rep`` null), and for each ``rep`` its number ``n`` of links there; written.

    The larger unit of a pair is at home; its guests are dealt over groups of about ``BLOCK`` texts, so the members of a unit travel
    once a group and not once a pair."""
    alone = units.where("members = 1").select(F.col("rep").alias("unit"), "rep")
    texts = cliques.select("unit", "rep").unionByName(alone).join(words, "rep")
    size = units.select(F.struct("members", F.col("rep").alias("unit"), "longest").alias("s"), "rep")
    sized = (pairs.join(size.select(F.col("rep").alias("a"), F.col("s").alias("one")), "a")
             .join(size.select(F.col("rep").alias("b"), F.col("s").alias("two")), "b")
             .select(F.greatest("one", "two").alias("h"), F.least("one", "two").alias("v")))
    visits = cut(sized.selectExpr("h.unit AS home", "v.unit AS guest", "v.members AS texts", "v.members * v.longest AS words"))
    room = (visits.groupBy("home").agg(F.sum("texts").alias("n"), F.sum("words").alias("total")).select("home", _blocks().alias("g")))
    dealt = cut(visits.join(room, "home").select("home", "guest", F.pmod(F.xxhash64("guest"), "g").cast("int").alias("part")))
    sides = (dealt.select("home", "part", F.lit(1).alias("side"), F.col("guest").alias("unit"))
             .unionByName(dealt.select("home", "part", F.lit(0).alias("side"), F.col("home").alias("unit")).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_groups(batches, ("home", "part")):
            side, unit = batch.column("side").to_numpy(), batch.column("unit").to_numpy(zero_copy_only=False)
            texts = [np.frombuffer(x, dtype=np.uint32) for x in batch.column("words").to_pylist()]
            sizes, waiting = np.array([len(t) for t in texts]), _Waiting(texts)
            counts, linked = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)

            def settle() -> None:
                i, j, _ = waiting.linked()
                np.add.at(counts, np.concatenate([i, j]), 1)
                linked[j] = True

            for low, high in _borders(starts, batch.num_rows):
                bins, split = _histograms(texts[low:high]), low + int(np.searchsorted(side[low:high], 1))
                for at in range(low, split, 64):
                    mine, others = np.arange(at, min(at + 64, split))[:, None], np.arange(split, high)
                    limit = (share * np.maximum(sizes[mine], sizes[others]) + 1e-9).astype(np.int64)
                    x, y = np.nonzero(np.abs(sizes[mine] - sizes[others]) <= limit)
                    i, j, limit = at + x, others[y], limit[x, y]
                    possible = _possible(sizes[low:high], bins, i - low, j - low, limit)
                    if waiting.add(i[possible], j[possible], limit[possible]):
                        settle()
            settle()
            near, counted = np.flatnonzero(linked), np.flatnonzero(counts)
            met = {(h, u) for h, u in zip(batch.column("home").take(pa.array(near)).to_pylist(), unit[near].tolist())}
            blank = [None] * len(counted)
            yield pa.RecordBatch.from_arrays(
                [pa.array([pair[k] for pair in met] + blank, pa.binary()) for k in (0, 1)]
                + [pa.array([None] * len(met) + batch.column("rep").take(pa.array(counted)).to_pylist(), pa.binary()),
                   pa.array([None] * len(met) + counts[counted].tolist(), pa.int64())], names=["a", "b", "rep", "n"])

    met = sides.join(texts, "unit").select("home", "part", "side", "unit", "rep", "words")
    return cut(met.repartition("home", "part").sortWithinPartitions("home", "part", "side", "unit")
               .mapInArrow(tidy(run), "a binary, b binary, rep binary, n long"))


def find_links(docs: DataFrame, sketches: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Representatives ``rep``, ``id`` (the smallest that is not null), ``unit``, ``n_links`` of equal texts, and links ``a``, ``b`` of units that
    connect all linked representatives."""
    share = 1 - similarity
    reps = cut(sketches.where("n_words > 0").groupBy("rep").agg(
        F.min("doc_id").alias("id"), F.min("n_words").alias("n_words"), F.min("keys").alias("keys")))
    cliques, clique_words = _cliques(docs, reps, share)
    joined = reps.join(cliques, "rep", "left").withColumn("unit", F.coalesce("unit", "rep"))
    shape = joined.groupBy(F.col("unit").alias("rep")).agg(
        F.count("*").alias("members"), F.coalesce(F.max("off"), F.lit(0)).cast("long").alias("radius"), F.max("n_words").alias("longest"))
    units = cut(reps.join(shape, "rep").select(*_UNIT))
    groups = _groups_to_test(reps, cliques, units, share)
    words = _word_table(docs, groups.select("rep").distinct().join(reps.select("rep", "id"), "rep"))
    found = _linked_groups(groups, words, share)

    pairs = cut(found.where(f"kind >= {_ALL}").groupBy("a", "b").agg(F.min("kind").alias("kind")))
    sure, open_pairs = pairs.where(f"kind = {_ALL}").select("a", "b"), pairs.where(f"kind = {_SOME}").select("a", "b")
    every = words.unionByName(clique_words).groupBy("rep").agg(F.max("words").alias("words"))
    tested = _linked_members(open_pairs, cliques, units, every, share)
    both = sure.unionByName(sure.select(F.col("b").alias("a"), F.col("a").alias("b")))
    by_unit = (both.join(units.select(F.col("rep").alias("b"), "members"), "b").select("a", F.col("members").alias("n"))
               .unionByName(found.where(f"kind = {_DEGREE}").select("a", "n"))
               .groupBy(F.col("a").alias("unit")).agg(F.sum("n").alias("whole")))
    by_text = tested.where("rep IS NOT NULL").groupBy("rep").agg(F.sum("n").alias("single"))
    counted = (joined.select("rep", "id", "unit").join(units.select(F.col("rep").alias("unit"), "members"), "unit")
               .join(by_unit, "unit", "left").join(by_text, "rep", "left")
               .selectExpr("rep", "id", "unit", "members - 1 + coalesce(whole, 0) + coalesce(single, 0) AS n_links"))
    links = (found.where(f"kind = {_FOREST}").select("a", "b").unionByName(sure)
             .unionByName(tested.where("rep IS NULL").select("a", "b")))
    return cut(counted), links


def components(links: DataFrame) -> DataFrame:
    """``id``, ``class_id``: the smallest id reachable over links, for every id that has one.

    Each round takes the smallest label among an id and its neighbours, then follows that label's own label; the number of
    rounds grows with the logarithm of a component's diameter.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("c")))
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("near"))
                .select(F.col("a").alias("id"), "near"))
        lower = cut(labels.join(near, "id").select("id", F.col("c").alias("old"), F.least("c", "near").alias("c")))
        jumped = lower.select(F.col("id").alias("c"), F.col("c").alias("next"))
        labels = cut(lower.join(jumped, "c").select("id", "old", F.least("c", "next").alias("c")))
        if labels.where("c <> old").isEmpty():
            return labels.select("id", F.col("c").alias("class_id"))
        labels = labels.select("id", "c")


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The sketches, and for each ``rep`` its class ``part`` (a digest), the name ``class_id`` of that class, and ``n_links``; written."""
    sketches = sketch_table(docs)
    reps, links = find_links(docs, sketches, similarity)
    parts = components(links).select(F.col("id").alias("unit"), F.col("class_id").alias("part"))
    placed = cut(reps.join(parts, "unit", "left").withColumn("part", F.coalesce("part", "unit")))
    names = placed.groupBy("part").agg(F.min("id").alias("class_id"))
    return sketches, cut(placed.join(names, "part").selectExpr("rep", "part", "class_id", "cast(n_links AS long) AS n_links"))


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``class_id`` (the smallest id of the class), ``n_links`` (links of its text to other texts), per row of ``docs``."""
    sketches, classes = _classes(docs, similarity)
    worded = sketches.where("n_words > 0").select("doc_id", "rep").join(classes, "rep").select("doc_id", "class_id", "n_links")
    empty = sketches.where("n_words = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return worded.unionByName(empty)


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class, all columns kept: a row with its smallest id that is not null (of several texts with that id the one
    of the smallest hash; of equal rows any one). All rows without words stay."""
    sketches, classes = _classes(docs, similarity)
    rows = cut(sketches.where("n_words > 0").groupBy("doc_id", "mark", "rep").agg(F.count("*").alias("rows"))
               .join(classes.select("rep", "part"), "rep").select("doc_id", "mark", "part", "rows"))
    best = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("best")).select(
        "part", F.col("best.doc_id").alias("best_id"), F.col("best.mark").alias("best_mark"))
    mine = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("mark") == F.col("best_mark"))
    judged = cut(rows.join(best, "part").select("doc_id", "mark", mine.alias("stays"), "rows"))
    copy, mark = spare_name(docs, "copy"), spare_name(docs, "mark")
    named = (F.col("doc_id").alias(copy), F.col("mark").alias(mark))
    same = F.col("doc_id").eqNullSafe(F.col(copy)) & (F.xxhash64("text") == F.col(mark))
    kept = docs.join(_few(cut(judged.where("NOT stays").select(*named))), same, "left_anti")
    repeated = cut(judged.where("stays AND rows > 1").select(*named))
    if repeated.isEmpty():
        return kept
    return kept.join(_few(repeated), same, "left_anti").unionByName(
        kept.join(_few(repeated), same, "left_semi").dropDuplicates(["doc_id", "text"]))
