"""Token ids of whole texts, by tokenising each distinct word once in a Python worker.

The tokeniser files used here drop white space and never join words across it, so the ids of a text are those of its words
in order. Words are told apart by a 64-bit hash of their bytes; a worker remembers the ids of the words it has met in flat
arrays and serves all its tasks from them. A text's words are looked up and their ids gathered without a loop over words.

A new word of lower-case letters, maybe with ASCII marks behind, is one run of letters and one of marks to the tokeniser, which
neither normalises nor splits them further: its letters go straight to the tokeniser's merging step, and marks recur. All other
words take the tokeniser's whole way. What is assumed here about a tokeniser file is tried when it is loaded.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from geoledger.llm.wordarrays import Words

KEEP_WORDS = 1_500_000  # about 40 MB in a Python worker; beyond it the memory starts anew
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"  # lower case, each a letter of its own in any Unicode version
_STEM_AND_MARKS = re.compile(f"([{LETTERS}]+)([!-/:-@\\[-`{{-~]*)").fullmatch


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallel work
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def parts_at_space(path: str) -> bool:
    """Whether the tokeniser treats words alone as it treats them between any white space; checked on a few hard ones."""
    t = tokenizer(path)
    words = ["don't", "a1", "x.", "...", "É", "é", "́", "中文", "'s", "ß", "👍🏽", "<|", "0", "AbC"]
    alone = [i for w in words for i in t.encode(w, add_special_tokens=False).ids]
    return all(t.encode(gap.join(words), add_special_tokens=False).ids == alone for gap in (" ", "\n", "\t", " \r\n ", "\x0b", "\x0c"))


class Vocabulary:
    """Ids of the words met so far: sorted hashes, and for each the place and number of its ids in one array."""

    def __init__(self, path: str):
        if not parts_at_space(path):
            raise ValueError(f"{path} does not tokenise texts word by word")
        self.tokenizer = tokenizer(path)
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        encode = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        self.folds = encode(letters) == encode(letters.lower()) and encode(" ".join(letters)) == encode(" ".join(letters.lower()))
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        from tokenizers.pre_tokenizers import ByteLevel

        spelt = {c: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in LETTERS}
        self.spelling = str.maketrans({c: t for c, t in spelt.items() if c != t})
        trial = [*LETTERS, LETTERS, LETTERS[::-1], "straße", "thequick", "élémentaire", "lichkeiten", "s", "ll", "aaaaaaaaaaaaaaaaaaaaaa"]
        marked = [w + m for w in trial for m in ("", ".", "***", "'", "\"')", "&|<")]
        self.direct = all(self._whole(w) == self._merged(w) for w in trial) and all(
            self._whole(w) == [i for part in _STEM_AND_MARKS(w).groups() if part for i in self._whole(part)] for w in marked)
        self.marks: dict[str, list[int]] = {}
        self._clear()

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _merged(self, letters: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(letters.translate(self.spelling))]

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        others, model, spelling, marks, stems = [], self.tokenizer.model, self.spelling, self.marks, {}
        for k, word in enumerate(words):
            found = self.direct and _STEM_AND_MARKS(word)
            if not found:
                others.append(k)
                continue
            stem, behind = found.groups()
            ids = stems.get(stem)
            if ids is None:
                ids = stems[stem] = [t.id for t in model.tokenize(stem.translate(spelling))]
            if behind:
                if behind not in marks:
                    if len(marks) > 100_000:
                        marks.clear()
                    marks[behind] = self._whole(behind)
                ids = ids + marks[behind]
            out[k] = ids
        for k, e in zip(others, self.tokenizer.encode_batch_fast([words[k] for k in others], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.starts, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        encoded = self._encode_words(b"\n".join(words).decode().split("\n"))
        sizes = np.fromiter(map(len, encoded), dtype=np.int32, count=len(encoded))
        flat = np.fromiter((i for ids in encoded for i in ids), dtype=np.uint32, count=int(sizes.sum()))
        starts = np.cumsum(sizes, dtype=np.int64) - sizes + len(self.ids)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.starts, self.sizes = np.insert(self.starts, at, starts[order]), np.insert(self.sizes, at, sizes[order])
        self.ids = np.concatenate([self.ids, flat])

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is unknown."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return np.where(known, at, -1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (64-bit offsets, no nulls) one after another, and the bounds of each text in them."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
        raw = b"" if texts.buffers()[2] is None else bytes(memoryview(texts.buffers()[2])[int(offsets[0]):int(offsets[-1])])
        low = raw.lower()
        fold = self.folds and not any(t in low for t in self.added)  # added tokens mind the case
        raw = low if fold else raw
        words = Words(texts, lower=fold)
        coded = pa.array(words.hashes).dictionary_encode()  # by first appearance
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        if not len(distinct):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        place = self._places(distinct)
        if len(self.keys) + int((place < 0).sum()) > KEEP_WORDS:
            self._clear()
            place[:] = -1
        missing = np.flatnonzero(place < 0)
        if len(missing):
            first = np.empty(len(distinct), dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            heads, lengths = words.starts[first[missing]].tolist(), words.lengths[first[missing]].tolist()
            self._learn(distinct[missing], [raw[s:s + n] for s, n in zip(heads, lengths)])
            place = self._places(distinct)
        starts, sizes = self.starts[place][codes], self.sizes[place][codes].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        picked = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)
        return self.ids[picked], ends[words.bounds]


#: Vocabularies of this Python worker by tokeniser file; a worker serves many tasks.
_REMEMBERED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _REMEMBERED:
        _REMEMBERED[path] = Vocabulary(path)
    return _REMEMBERED[path]
