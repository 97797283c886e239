"""Texts to ids by Arrow and numpy: batches are split and dictionary-encoded, only new segments meet a tokenizer.

A segment is white space and the other characters after it. Where a text has only single spaces, it is cut at them and each chunk but
the first stands for itself after one space. No Python runs per word: words are numbers from the dictionary on, and their ids are
gathered from one array.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The characters of Unicode's White_Space property.
_MORE_WHITE = (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WHITE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, _MORE_WHITE))
_ADJACENT = f"[{WHITE}][{WHITE}]"
_SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

# Signs that are neither letters, numbers nor white space, without the apostrophe, which can begin a match.
SIGNS = ".,;:!?*&%$#|)]}\""

MEMORY_SEGMENTS = 400_000
BATCH_BYTES = 4 << 20

Learn = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]  # segments -> all ids, ids of each


def byte_batches(batches, column: int, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of ``column`` hold about ``size`` bytes at a time, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def _strings(texts: pa.Array) -> list[str]:
    """As Python strings; several times faster than ``to_pylist``."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class _Store:
    """Numbered segments and their ids, one after the other."""

    def __init__(self):
        self.spaced: dict[str, int] = {}  # segments of one space and a chunk, by the chunk
        self.whole: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 12, dtype=np.uint32), 0
        self.start, self.length, self.count = np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int64), 0

    def add(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of the new segments."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(counts) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.used : self.used + len(flat)] = flat
        numbers = np.arange(self.count, self.count + len(counts))
        self.start[numbers] = self.used + np.cumsum(counts) - counts
        self.length[numbers] = counts
        self.used, self.count = self.used + len(flat), self.count + len(counts)
        return numbers

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.length[numbers]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[numbers] - (ends - length), length) + np.arange(total)], length


class SegmentPool:
    """Encodes batches of texts; segments not met again while ``memory`` others were are forgotten. Results do not depend on the memory.

    ``learn_spaced`` gives the ids of chunks after one space, ``learn_whole`` those of segments as they are. Signs that close a word
    are a match of their own for the split patterns, so words are learnt without them. Texts that hold one of ``apart`` are one segment each.
    """

    def __init__(self, learn_spaced: Learn, learn_whole: Learn, memory: int = MEMORY_SEGMENTS, apart: list[str] | None = None):
        self.learn = {"spaced": learn_spaced, "whole": learn_whole}
        self.memory, self.apart = memory, apart or []
        self.store, self.older = _Store(), _Store()

    def _numbers(self, segments: list[str], kind: str) -> np.ndarray:
        """Numbers of distinct segments; new ones are learnt."""
        known, before = getattr(self.store, kind), getattr(self.older, kind)
        out = np.fromiter(map(known.get, segments, repeat(-1)), dtype=np.int64, count=len(segments))
        copied: list[int] = []
        new: list[int] = []
        for i in np.flatnonzero(out < 0).tolist():
            (copied if segments[i] in before else new).append(i)
        parts = []
        if copied:
            parts.append((copied, self.older.gather(np.array([before[segments[i]] for i in copied]))))
        if new:
            parts.append((new, self.learn[kind]([segments[i] for i in new])))
        for places, (flat, counts) in parts:
            numbers = self.store.add(flat, counts)
            out[places] = numbers
            known.update(zip([segments[i] for i in places], numbers.tolist()))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, an array of strings without nulls, and how many each has."""
        if len(self.store.spaced) + len(self.store.whole) > self.memory:
            self.older, self.store = self.store, _Store()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        alone = np.zeros(len(texts), dtype=bool)
        for s in self.apart:
            alone |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, _ADJACENT).to_numpy(zero_copy_only=False) & ~alone
        plain = ~alone & ~odd
        words: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        if plain.any():
            lists = pc.split_pattern(texts.filter(pa.array(plain)), " ")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            numbers, offsets = self._chunks(lists.flatten().dictionary_encode(), offsets)
            if plain.all():
                return self._lengths(numbers, offsets)
            for place, a, b in zip(np.flatnonzero(plain).tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                words[place] = numbers[a:b]
        for place in np.flatnonzero(~plain).tolist():
            text = texts[place].as_py()
            parts = [text] if alone[place] else _SEGMENT.findall(text)
            words[place] = self._of_all(parts)
        return self._lengths(np.concatenate(words), np.concatenate([[0], np.cumsum([len(w) for w in words])]))

    def _chunks(self, chunks: pa.DictionaryArray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all chunks, one or two each, and where those of each text begin; ``offsets`` count chunks."""
        distinct = chunks.dictionary
        core = pc.utf8_rtrim(distinct, characters=SIGNS)
        signed = pc.and_(pc.not_equal(core, distinct), pc.match_substring_regex(core, r"[\p{L}\p{N}]$"))
        cores = pc.if_else(signed, core, distinct).dictionary_encode()
        word = self._numbers(_strings(cores.dictionary), "spaced")[cores.indices.to_numpy()]
        signed = signed.to_numpy(zero_copy_only=False)
        sign = np.zeros(len(word), dtype=np.int64)
        places = pa.array(np.flatnonzero(signed))
        tails = [s[len(c) :] for s, c in zip(_strings(distinct.take(places)), _strings(core.take(places)))]
        sign[signed] = self._of_all(tails)
        code = chunks.indices.to_numpy()
        two = signed[code]
        heads = offsets[:-1]  # a text's first chunk stands after no space
        two[heads] = False
        begin = np.concatenate([[0], np.cumsum(1 + two)])
        numbers = np.empty(begin[-1], dtype=np.int64)
        numbers[begin[:-1]] = word[code]
        numbers[begin[:-1][two] + 1] = sign[code[two]]
        numbers[begin[heads]] = self._of_all(_strings(chunks.take(pa.array(heads)).dictionary_decode()))
        return numbers, begin[offsets]

    def _of_all(self, segments: list[str]) -> np.ndarray:
        """Numbers of segments as they are, with repeats."""
        distinct = list(dict.fromkeys(segments))
        number = dict(zip(distinct, self._numbers(distinct, "whole").tolist()))
        return np.array([number[s] for s in segments], dtype=np.int64)

    def _lengths(self, numbers: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, length = self.store.gather(numbers)
        ends = np.concatenate([[0], np.cumsum(length)])
        return flat, ends[offsets[1:]] - ends[offsets[:-1]]


def with_end(flat: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after the ids of each text."""
    return np.insert(flat, np.cumsum(counts), end_id), counts + 1
