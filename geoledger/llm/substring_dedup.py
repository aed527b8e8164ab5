"""Exact substring deduplication with fixed-block anchors.

Documents are cut into non-overlapping blocks of 25 words, the index. Every rolling window of 25 words of every document
probes it. A repeat of 50 words holds at least one whole block of the document it repeats, so a block found in another
document anchors every repeat; around the anchors the 50-word windows are compared, and runs of equal windows are the
maximal exact repeats. A word goes if a window that covers it also starts in a document with a smaller id.

Data flow: documents are packed into compressed chunks of about 1 MB of text, written once. A chunk sends each bucket of
the hash space its distinct window hashes (so a passage in a third of all documents is sent once a chunk, not once a
document), the bucket answers which of them are anchors, and the chunk, met again by a join, sends the 50-word windows
around them in the same way and is told which start in smaller documents of other chunks. Buckets grow in number with the
corpus, so their size is bounded; nothing is collected at the driver. Hashes: anchors may collide (that costs a comparison
only); windows are told apart by 64 bits plus the bucket number, so the bits grow with the corpus.

Defined results: null and empty texts have no words; windows never cross documents; rows with the same id never delete
each other's words; a null id counts as larger than all others; all columns of the input are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.llm.memory import small_batches, tidy
from geoledger.llm.wordarrays import Words, by_text, mix, row_chunks, text_column
from geoledger.session import cut

WINDOW = 50
BLOCK = 25  # a window of 50 words holds one whole block wherever it starts
CHUNK_BYTES = 1 << 20
BUCKET_WINDOWS = 1_000_000

_LOW = np.uint64(0xFFFFFFFF)
_SECOND = np.uint64(0x5851F42D4C957F2D)
_NO_ID = np.iinfo(np.int64).max


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def squeeze(values: np.ndarray, rising: bool = True) -> bytes:
    """Integers in few bytes: differences of rising values, byte by byte, compressed."""
    if not len(values):
        return b""
    if rising:
        values = np.append(values[:1], values[1:] - values[:-1])
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueeze(blob: bytes, kind: type, rising: bool = True) -> np.ndarray:
    """The values that ``squeeze`` got."""
    if not blob:
        return np.zeros(0, dtype=kind)
    n, size = int.from_bytes(blob[:4], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(blob[4:], decompressed_size=n * size, codec="zstd", asbytes=True)
    values = np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(size, n).T).view(kind).reshape(n)
    return np.cumsum(values, dtype=kind) if rising else values


def chunk_table(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in compressed chunks: ``chunk``, ``n_words``, ``blob``; written, so that chunks never change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = text_column(batch)
            for low, high in row_chunks(texts, CHUNK_BYTES):
                n_words = len(Words(texts.slice(low, high - low)).starts)
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(low, high - low)]) for c in batch.columns], schema=batch.schema)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n_words], pa.int64()), pa.array([_pack(part)], pa.binary())],
                                                 names=["chunk", "n_words", "blob"])
                number += 1

    return cut(small_batches(docs).mapInArrow(tidy(run), "chunk long, n_words long, blob binary"))


def _opened(blob: bytes) -> tuple[pa.RecordBatch, Words, np.ndarray]:
    batch = unpack(blob)
    ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
    return batch, Words(text_column(batch)), ids


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in a sorted array."""
    if len(buckets):
        heads = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
        for low, high in zip(heads.tolist(), np.append(heads[1:], len(buckets)).tolist()):
            yield int(buckets[low]), slice(low, high)


def _short_keys(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    first, hashes = words.windows(BLOCK)
    return first, (((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (hashes & _LOW)


def _long_keys(words: Words, starts: np.ndarray | None, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, buckets and second hashes of the 50-word windows (of those that start at ``starts``)."""
    first, one = words.windows(WINDOW)
    _, two = words.windows(WINDOW, mix(words.hashes ^ _SECOND))
    if starts is not None:
        keep = starts[first]
        first, one, two = first[keep], one[keep], two[keep]
    return first, (one >> np.uint64(32)) % np.uint64(buckets), two


def _rows(blobs: Callable, schema: pa.Schema) -> Callable:
    """A mapInArrow function that turns each chunk row into rows of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(blobs(batch.slice(k, 1)))
                for low in range(0, len(rows), 1024):
                    columns = list(zip(*rows[low:low + 1024]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return tidy(run)


def _anchors(chunks: DataFrame, buckets: int) -> DataFrame:
    """``chunk``, ``bucket``, ``found``: the hashes of the chunk's windows that equal a block of another document."""
    sent = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("one", pa.binary()), ("many", pa.binary()), ("blocks", pa.binary())])

    def probe(row: pa.RecordBatch) -> Iterator[tuple]:
        chunk = row.column("chunk")[0].as_py()
        _, words, ids = _opened(row.column("blob")[0].as_py())
        first, keys = _short_keys(words, buckets)
        if not len(keys):
            return
        texts = words.text_of_word()[first]
        order = np.lexsort((ids[texts], keys))
        k, d = keys[order], ids[texts[order]]
        new = np.append(True, k[1:] != k[:-1])
        other = np.append(False, (d[1:] != d[:-1]) & ~new[1:])
        heads = np.flatnonzero(new)
        many = np.logical_or.reduceat(other, heads)
        unique = k[heads]
        block = np.zeros(len(unique), dtype=bool)
        block[np.searchsorted(unique, keys[(first - words.bounds[texts]) % BLOCK == 0])] = True
        low = (unique & _LOW).astype(np.uint32)
        for bucket, at in _by_bucket(unique >> np.uint64(32)):
            yield (bucket, chunk, *(squeeze(low[at][kind]) for kind in (~many[at], many[at], block[at])))

    def meet(table: pa.Table) -> pa.Table:
        read = lambda name: [unsqueeze(b, np.uint32) for b in table.column(name).to_pylist()]
        one, many, blocks = read("one"), read("many"), read("blocks")
        values, n = np.unique(np.concatenate([*one, *many, *many]), return_counts=True)
        shared = np.intersect1d(values[n > 1], np.concatenate(blocks))
        rows = []
        for chunk, a, b in zip(table.column("chunk").to_pylist(), one, many):
            mine = np.sort(np.concatenate([a, b]))
            hit = mine[np.isin(mine, shared, assume_unique=True)]
            if len(hit):
                rows.append((chunk, squeeze(hit)))
        bucket = table.column("bucket")[0].as_py()
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()),
                         pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "bucket", "found"])

    return (chunks.select("chunk", "blob").mapInArrow(_rows(probe, sent), "bucket int, chunk long, one binary, many binary, blocks binary")
            .groupBy("bucket").applyInArrow(meet, "chunk long, bucket int, found binary"))


def _earlier(chunks: DataFrame, anchors: DataFrame, buckets: int) -> DataFrame:
    """``chunk``, ``found``: second hashes of its 50-word windows that start in a smaller document of another chunk."""
    answers = anchors.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "found")).alias("answers"))  # no more than the chunk sent
    sent = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("least", pa.binary())])

    def extend(row: pa.RecordBatch) -> Iterator[tuple]:
        chunk = row.column("chunk")[0].as_py()
        _, words, ids = _opened(row.column("blob")[0].as_py())
        first, keys = _short_keys(words, buckets)
        known = np.sort(np.concatenate([unsqueeze(a["found"], np.uint32).astype(np.uint64) | np.uint64(a["bucket"] << 32)
                                        for a in row.column("answers")[0].as_py()]))
        at = first[known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys]
        # windows that hold a whole anchor start up to 25 words before it, in the same document
        edge = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        heads = words.bounds[words.text_of_word()[at]]
        np.add.at(edge, np.maximum(at - (WINDOW - BLOCK), heads), 1)
        np.add.at(edge, at + 1, -1)
        first, bucket, two = _long_keys(words, np.cumsum(edge)[:-1] > 0, buckets)
        if not len(first):
            return
        own = ids[words.text_of_word()[first]]
        order = np.lexsort((own, two, bucket))
        bucket, two, own = bucket[order], two[order], own[order]
        new = np.append(True, (two[1:] != two[:-1]) | (bucket[1:] != bucket[:-1]))
        bucket, two, own = bucket[new], two[new], own[new]
        for b, at in _by_bucket(bucket):
            yield b, chunk, squeeze(two[at]), squeeze(own[at], rising=False)

    def least(table: pa.Table) -> pa.Table:
        hashes = [unsqueeze(b, np.uint64) for b in table.column("hashes").to_pylist()]
        ids = [unsqueeze(b, np.int64, rising=False) for b in table.column("least").to_pylist()]
        every, own = np.concatenate(hashes), np.concatenate(ids)
        order = np.lexsort((own, every))
        new = np.append(True, every[order][1:] != every[order][:-1])
        values, smallest = every[order][new], own[order][new]
        rows = []
        for chunk, mine, local in zip(table.column("chunk").to_pylist(), hashes, ids):
            hit = mine[smallest[np.searchsorted(values, mine)] < local]
            if len(hit):
                rows.append((chunk, squeeze(hit)))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "found"])

    return (chunks.select("chunk", "blob").join(answers, "chunk")
            .mapInArrow(_rows(extend, sent), "bucket int, chunk long, hashes binary, least binary")
            .groupBy("bucket").applyInArrow(least, "chunk long, found binary"))


def removed_words(words: Words, ids: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which words are covered by a window that starts in a smaller document: of this chunk, or of another (``found``)."""
    first, _, two = _long_keys(words, None, 1)
    own = ids[words.text_of_word()[first]] if len(first) else np.zeros(0, dtype=np.int64)
    order = np.lexsort((own, two))
    new = np.append(True, two[order][1:] != two[order][:-1])[: len(order)]
    smallest = np.empty(len(first), dtype=np.int64)
    smallest[order] = own[order][new][np.cumsum(new) - 1] if len(order) else own
    gone = (smallest < own) | np.isin(two, found)
    edge = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    np.add.at(edge, first[gone], 1)
    np.add.at(edge, first[gone] + WINDOW, -1)
    return np.cumsum(edge)[:-1] > 0


def _decided(docs: DataFrame, emit: Callable, schema: str) -> DataFrame:
    """``emit(batch, words, gone)`` for every chunk, with its words' verdicts."""
    chunks = chunk_table(docs)
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_WINDOWS))
    earlier = _earlier(chunks, _anchors(chunks, buckets), buckets)
    answers = earlier.groupBy("chunk").agg(F.collect_list("found").alias("found"))  # no more than the chunk sent
    joined = chunks.select("chunk", "blob").join(answers, "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, words, ids = _opened(batch.column("blob")[k].as_py())
                found = [unsqueeze(b, np.uint64) for b in batch.column("found")[k].as_py() or ()]
                yield emit(rows, words, removed_words(words, ids, np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)))

    return joined.mapInArrow(tidy(run), schema)


def removal_digests(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` of the kept words joined by one space."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def emit(rows: pa.RecordBatch, words: Words, gone: np.ndarray) -> pa.RecordBatch:
        removed = by_text(gone, words.bounds)
        digests = []
        for k, text in enumerate(text_column(rows)):
            split = text.as_py().encode().split()
            if removed[k]:
                split = [w for w, g in zip(split, gone[words.bounds[k]:words.bounds[k + 1]].tolist()) if not g]
            digests.append(hashlib.sha256(b" ".join(split)).hexdigest())
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(words.counts), pa.array(removed), pa.array(digests)],
                                          names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _decided(docs.select("doc_id", "text"), emit, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; the white space around kept words stays as it was."""

    def emit(rows: pa.RecordBatch, words: Words, gone: np.ndarray) -> pa.RecordBatch:
        removed = by_text(gone, words.bounds)
        texts = rows.column("text").to_pylist()
        for k in np.flatnonzero(removed).tolist():
            low, high = int(words.bounds[k]), int(words.bounds[k + 1])
            raw, flags = texts[k].encode(), gone[low:high]
            starts = np.append(words.starts[low:high], words.offsets[k + 1]) - words.offsets[k]
            turns = np.flatnonzero(np.append(True, flags[1:] != flags[:-1])).tolist() + [high - low]
            kept = [raw[starts[a]:starts[b]] for a, b in zip(turns, turns[1:]) if not flags[a]]
            texts[k] = b"".join(kept).decode().strip(" \t\n\r\x0b\x0c")
        at = rows.schema.get_field_index("text")
        return rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))

    return _decided(docs, emit, docs.schema)
