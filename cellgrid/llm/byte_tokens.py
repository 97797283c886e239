"""Ids of whole texts by the tokenizers library, with a bounded per-worker memory of text segments."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import claim_memory
from .segment_pool import MEMORY_SEGMENTS, WHITE, SegmentPool

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task its core


class SegmentEncoder:
    """Encodes texts with a byte-level BPE file of the tokenizers library.

    Such a tokenizer splits a text before the merges, and never inside a white-space run that
    a non-space run follows. So each segment (white space, then other characters) has ids of its
    own, whatever surrounds it; known segments are looked up and new ones encoded together.
    Texts that hold a special token's string go to the tokenizer whole.
    """

    def __init__(self, path: str, memory: int = MEMORY_SEGMENTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        # In a byte-level vocabulary each character of a token stands for one byte.
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.pool = SegmentPool(lambda chunks: self._joined([" " + c for c in chunks]), self._whole, memory, self.special)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Segments that begin with white space, encoded in long texts whose ids are cut at the segments' ends."""
        flats, counts = [], []
        for at in range(0, len(segments), 20_000):
            part = segments[at : at + 20_000]
            ids = np.array(self._ids(["".join(part)])[0], dtype=np.uint32)
            ends = np.cumsum([len(s.encode()) for s in part])
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends, side="left") + 1
            flats.append(ids)
            counts.append(np.diff(cuts, prepend=0))
        return (np.concatenate(flats), np.concatenate(counts)) if flats else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _whole(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Any segments: those between which nothing is lost are encoded together, others one by one."""
        together = [i for i, s in enumerate(segments) if s and s[0] in WHITE and s[-1] not in WHITE and not any(x in s for x in self.special)]
        rest = sorted(set(range(len(segments))).difference(together))
        ids: list = [None] * len(segments)
        flat, counts = self._joined([segments[i] for i in together])
        for i, part in zip(together, np.split(flat, np.cumsum(counts)[:-1]) if together else ()):
            ids[i] = part
        for i, found in zip(rest, self._ids([segments[i] for i in rest])):
            ids[i] = np.array(found, dtype=np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of strings without nulls, and how many each text has."""
        return self.pool.encode(texts)


_ENCODERS: dict[str, SegmentEncoder] = {}


def encoder(path: str) -> SegmentEncoder:
    """The worker's encoder for ``path``; workers are reused, so its memory lasts over tasks."""
    claim_memory("byte_tokens", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = SegmentEncoder(path)
    return _ENCODERS[path]
