"""Byte-level BPE by dynamic programming over prefixes.

For every byte prefix of a piece the encoding's last token is unique: it is the one token that
ends the prefix and forms a valid pair with the last token of what stands before it. A pair is
valid when the merges, run on both tokens' bytes together, give back just these two tokens. So one
pass over the bytes stores a last token per prefix; the encoding is read off backwards, an
append goes on where the array ends, and an edit keeps the array up to its place.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .common import claim_memory, record_batch, row_batches, text_or_empty
from .segment_pool import MEMORY_SEGMENTS, SegmentPool, byte_batches

MEMORY_PAIRS = 1_000_000


class PrefixBpe:
    """Ranks of a vocabulary, the split of each token, and the test for valid pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.known: dict[tuple[int, int], bool] = {}  # pairs tested before
        self.pairs: dict[tuple[int, int], int] = {}  # two tokens -> the token they merge to
        self.split: dict[int, tuple[int, int]] = {}  # a token -> the two it is merged from last
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.split[rank] = (rank, rank)
                continue
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left in self.split and right in self.split and left < rank > right and self.valid(left, right):
                    self.pairs[left, right] = rank
                    self.split[rank] = (left, right)
                    break
        # A token without a split is never the result of merges: it stands for whole pieces only.
        reachable = {b: r for b, r in ranks.items() if r in self.split}
        # Every end of a token -> its rank, or -1 where the end is no token itself.
        self.ends = {t[i:]: -1 for t in reachable for i in range(len(t))} | reachable

    @classmethod
    def from_file(cls, path: str) -> PrefixBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def valid(self, left: int, right: int) -> bool:
        """No merge across the border between two adjacent tokens ever comes first.

        Undo merges on either side from the latest back; a merge across the border would have
        happened if its rank is below the ranks of the merges undone so far.
        """
        limit = 1 << 62
        while True:
            merged = self.pairs.get((left, right))
            if merged is not None and merged < limit:
                return False
            left_parts, right_parts = self.split[left], self.split[right]
            # Of two merges the one with the higher rank came later; on a tie the left one came first.
            if left > right:
                if left_parts[0] == left_parts[1] == left:
                    return True
                limit, left = left, left_parts[1]
            else:
                if right_parts[0] == right_parts[1] == right:
                    return True
                limit, right = right + 1, right_parts[0]

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """``last`` holds the last token of each prefix of ``piece`` it covers; grow it to the whole piece.

        Only one token fits, so the order of trying is free: ends grow until no token ends so.
        """
        get, known = self.ends.get, self.known
        if len(known) > MEMORY_PAIRS:
            known.clear()
        for end in range(len(last) + 1, len(piece) + 1):
            for begin in range(end - 1, -1, -1):
                token = get(piece[begin:end])
                if token is None:
                    raise ValueError("the vocabulary lacks a byte")
                if token < 0:
                    continue
                if begin:
                    pair = last[begin - 1], token
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = self.valid(*pair)
                    if not fits:
                        continue
                last.append(token)
                break
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding that ends in the last entry of ``last``."""
        out, at, bytes_of = [], len(last), self.bytes_of
        while at:
            out.append(last[at - 1])
            at -= len(bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tokens(self.extend(piece, []))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EditableEncoding:
    """A text with its ids, kept exact under appends and edits; work is near the change only.

    Pieces are the matches of the split pattern. A match ends at most ``REACH`` characters before
    the last one it looked at, so matches further from a change stay as they are.
    """

    REACH = 4

    def __init__(self, bpe: PrefixBpe, pattern: str, text: str = ""):
        self.bpe, self.pattern = bpe, regex.compile(pattern)
        self.text, self.starts, self.lasts = "", [], []
        self.replace(0, 0, text)

    def _prefixes(self, piece: str, old: tuple[str, list[int]] | None) -> list[int]:
        raw = piece.encode()
        if old is None:
            return self.bpe.extend(raw, [])
        before = old[0].encode()
        same = 0
        for a, b in zip(raw, before):
            if a != b:
                break
            same += 1
        return self.bpe.extend(raw, old[1][:same])

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, begin: int, end: int, new: str) -> None:
        """``text[begin:end]`` becomes ``new``."""
        text = self.text[:begin] + new + self.text[end:]
        keep = len(self.starts)
        while keep and self.starts[keep - 1] > max(0, begin - self.REACH):
            keep -= 1
        keep = max(0, keep - 1)  # the match before may have run up to the change
        moved = len(text) - len(self.text)
        old_at = {s: i for i, s in enumerate(self.starts)}
        starts, lasts = self.starts[:keep], self.lasts[:keep]
        at = self.starts[keep] if keep < len(self.starts) else (self._end(keep - 1) if keep else 0)
        while at < len(text):
            if at - moved in old_at and at >= begin + len(new) + self.REACH:
                # Past the change and in step with the old matches: the rest is the same.
                i = old_at[at - moved]
                starts += [s + moved for s in self.starts[i:]]
                lasts += self.lasts[i:]
                break
            piece = self.pattern.match(text, at).group()
            old = old_at.get(at)
            starts.append(at)
            lasts.append(self._prefixes(piece, None if old is None else (self.text[at : self._end(old)], self.lasts[old])))
            at += len(piece)
        self.text, self.starts, self.lasts = text, starts, lasts

    def _end(self, i: int) -> int:
        return self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)

    @property
    def ids(self) -> list[int]:
        out: list[int] = []
        for i, last in enumerate(self.lasts):
            whole = self.bpe.ranks.get(self.text[self.starts[i] : self._end(i)].encode())
            out += [whole] if whole is not None else self.bpe.tokens(last)
        return out


class TextCoder:
    """Encodes batches of texts with a bounded memory of segments and pieces; results do not depend on the memory.

    A segment's matches of the split pattern are pieces, each encoded by its prefixes. Decoding takes the bytes of the ids.
    """

    def __init__(self, bpe: PrefixBpe, pattern: str, memory: int = MEMORY_SEGMENTS):
        self.bpe, self.find, self.memory = bpe, regex.compile(pattern).findall, memory
        self.pieces: dict[str, list[int]] = {}
        self.pool = SegmentPool(lambda chunks: self._learn([" " + c for c in chunks]), self._learn, memory)
        size = max(bpe.bytes_of) + 1
        self.token_bytes = pa.array([bpe.bytes_of.get(i) for i in range(size)], pa.binary())
        self.digits = pa.array([f"{i}," for i in range(size)], pa.string())

    def _learn_pieces(self, pieces: set[str]) -> None:
        """In sorted order each piece takes over the prefixes it shares with the one before."""
        before, last = b"", []
        for raw, piece in sorted((p.encode(), p) for p in pieces):
            whole = self.bpe.ranks.get(raw)
            if whole is not None:
                self.pieces[piece] = [whole]
                continue
            same, most = 0, min(len(before), len(raw))
            while same < most and before[same] == raw[same]:
                same += 1
            before, last = raw, self.bpe.extend(raw, last[:same])
            self.pieces[piece] = self.bpe.tokens(last)

    def _learn(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pieces) > self.memory:
            self.pieces = {}
        found = [self.find(s) for s in segments]
        self._learn_pieces(set(chain.from_iterable(found)).difference(self.pieces))
        piece = self.pieces.__getitem__
        ids = [piece(f[0]) if len(f) == 1 else list(chain.from_iterable(map(piece, f))) for f in found]
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(counts.sum())), counts

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of strings without nulls, and how many each text has."""
        return self.pool.encode(texts)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch(pa.array([text], pa.string()))[0].tolist()

    def joined(self, flat: np.ndarray, counts: np.ndarray, of: pa.Array) -> Iterator[memoryview]:
        """Per text the values of ``of`` (token bytes or digits) for its ids, one after the other."""
        whole = of.take(pa.array(flat))
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(whole).to_numpy(zero_copy_only=False).astype(np.int64))])
        raw = memoryview(whole.buffers()[2] or b"")
        at = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return (raw[a:b] for a, b in zip(at, at[1:]))


_CODERS: dict[tuple[str, str], TextCoder] = {}


def coder(path: str, pattern: str) -> TextCoder:
    claim_memory("prefix_bpe", _CODERS.clear)
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = TextCoder(PrefixBpe.from_file(path), pattern)
    return _CODERS[path, pattern]


def encode_texts(df: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every whole text; null is empty, empty gives no ids. A row in, a row out; other columns are left out."""

    def run(batches):
        for batch in byte_batches(batches, 1):
            flat, counts = coder(ranks, pattern).encode_batch(batch.column(1))
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield record_batch({"doc_id": (batch.column(0), None), "ids": (pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.int32))), None)})

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` from ``doc_id, ids``; null ids are empty."""

    def run(batches):
        for batch in row_batches(batches):
            c, ids = coder(ranks, pattern), batch.column(1)
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            raw = [bytes(b) for b in c.joined(ids.flatten().to_numpy(zero_copy_only=False), counts, c.token_bytes)]
            yield record_batch({"doc_id": (batch.column(0), None), "bytes": (raw, pa.binary())})

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(
    df: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode and decode in one pass, digests only."""

    def run(batches):
        c = coder(ranks, pattern)
        for batch in byte_batches(batches, 1):
            flat, counts = c.encode_batch(batch.column(1))
            yield record_batch({
                "doc_id": (batch.column(0), None), "n_tokens": (counts, pa.int64()),
                "ids_sha256": ([hashlib.sha256(d[:-1]).hexdigest() for d in c.joined(flat, counts, c.digits)], pa.string()),
                "decoded_sha256": ([hashlib.sha256(b).hexdigest() for b in c.joined(flat, counts, c.token_bytes)], pa.string()),
            })

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
