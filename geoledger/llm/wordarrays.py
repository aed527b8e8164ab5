"""Texts of one Arrow batch as flat numpy arrays: words, their hashes, and windows of words.

A word is a run of bytes that are not separators; by default the separators are ASCII white space, so words are the
matches of ``[^\\x20\\x09-\\x0D]+``. Null texts count as empty. A batch is cut into chunks of bounded size; only a single
longer text makes a larger chunk, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation; letters, digits and all bytes of other scripts stay.
PUNCTUATED = np.array([SPACE[b] or (b < 128 and not chr(b).isalnum()) for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all bits depend on all bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    out = np.full(count, base, dtype=np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The batch's texts without nulls and with 64-bit offsets."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def row_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes of text, or of one row."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, min(high, len(texts))
        low = high


class Words:
    """Words of some texts: ``starts``/``ends`` in ``data``, ``bounds[i]:bounds[i+1]`` the words of text i."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACE, lower: bool = False):
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        raw = np.frombuffer(buffers[2], dtype=np.uint8)[low:high] if high > low else np.zeros(0, dtype=np.uint8)
        self.data, self.offsets = raw, offsets - low
        data = LOWER[raw] if lower else raw
        inside = ~separators[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = self.offsets[:-1]
        heads = heads[heads < len(data)]
        first[heads] |= inside[heads]
        kept = np.flatnonzero(inside).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        self.starts = np.flatnonzero(first)
        at = np.flatnonzero(first[kept])
        self.lengths = np.diff(np.append(at, len(kept)))
        self.bounds = np.searchsorted(self.starts, self.offsets)
        if len(at):
            place = np.arange(len(kept), dtype=kept.dtype) - np.repeat(at.astype(kept.dtype), self.lengths)
            sums = np.add.reduceat(_CODES[data[kept]] * powers(_BASE, int(self.lengths.max()))[place], at)
            self.hashes = mix(sums + self.lengths.astype(np.uint64) * _STEP)
        else:
            self.hashes = np.zeros(0, dtype=np.uint64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of_word(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def words(self, low: int, high: int) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[s:s + n] for s, n in zip(self.starts[low:high].tolist(), self.lengths[low:high].tolist())]

    def windows(self, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``size`` words inside one text, and the windows' hashes."""
        values = self.hashes if hashes is None else hashes
        if len(values) < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        scale = powers(_STEP, len(values))
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * scale, out=total[1:])
        first = np.arange(len(values) - size + 1)
        room = np.repeat(self.bounds[1:], self.counts)[: len(first)]
        first = first[first + size <= room]
        sums = (total[first + size] - total[first]) * powers(_STEP_INVERSE, len(values))[first]
        return first, mix(sums + np.uint64(size))


def by_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive bounds."""
    total = np.zeros(len(flags) + 1, dtype=np.float64 if flags.dtype.kind == "f" else np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])
